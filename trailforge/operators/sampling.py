"""Deterministic sampling: a hash of a seed and a key orders rows, in any engine and at any number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailforge.operators.etl import hash_number


def draw(seed: str, key: Column | str) -> Column:
    return hash_number(F.concat_ws("|", F.lit(seed), key))


def sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows, each as likely as another (D10): a distributed top-n by hash."""
    return rows.orderBy(draw(seed, key), key).limit(n)


def quota_pools(rows: DataFrame, key: str, quotas: dict[str, int], seed: str) -> DataFrame:
    """Exact numbers for each label, by hash rank (D14); only the drawn rows are ranked."""
    total = sum(quotas.values())
    rank = F.row_number().over(Window.orderBy(draw(seed, key), key))
    ranked, label, upto = sample(rows, key, total, seed).withColumn("__r", rank), None, 0
    for name, n in quotas.items():
        upto += n
        label = F.when(F.col("__r") <= upto, name) if label is None else label.when(F.col("__r") <= upto, name)
    return ranked.withColumn("difficulty", label).drop("__r")


#: Rows that are sorted in one task at most to find a cut.
SORTED_ROWS = 100_000


def nth(rows: DataFrame, value: Column, key: str, n: int) -> tuple:
    """(value, key) of the n-th row by a number and then a key. Approximate quantiles bracket it and exact counts say what lies below the
    bracket, again and again until few enough rows are left to be sorted; no task gathers a share of the table."""
    left, rest, error = rows.select(value.cast("double").alias("v"), F.col(key).alias("k")), n, 0.002
    size = left.count()
    while size > SORTED_ROWS:
        low, high = left.approxQuantile("v", [max(0.0, rest / size - error), min(1.0, rest / size + error)], error / 4)
        counts = left.agg(F.count_if(F.col("v") < low).alias("below"), F.count_if(F.col("v").between(low, high)).alias("inside")).first()
        if counts["inside"] == size:  # one value, told apart by the key alone
            left = left.select(F.col("k").cast("double").alias("v"), "k")
            if low == high and left.agg(F.min("v") == F.max("v")).first()[0]:
                break
            continue
        if not counts["below"] < rest <= counts["below"] + counts["inside"]:
            error *= 4
            continue
        left, rest, size = left.where(F.col("v").between(low, high)), rest - counts["below"], counts["inside"]
    found = left.orderBy("v", "k").limit(rest).agg(F.max(F.struct("v", "k")).alias("m")).first()["m"]
    return (found["v"], found["k"]) if found else (None, None)


def split(rows: DataFrame, key: str, share: float, least: int, seed: str) -> DataFrame:
    """Rows with part eval or train; eval has floor(share * n) rows, at least `least`.

    The cut is the hash of the last eval row; rows are compared with it where they are.
    """
    own = draw(seed, key)
    cut, cut_key = nth(rows, own, key, max(least, int(rows.count() * share)))
    inside = (own < cut) | ((own == cut) & (F.col(key) <= cut_key))
    return rows.select(*rows.columns, F.when(inside, "eval").otherwise("train").alias("part"))


def tail(rows: DataFrame, order: str, share: float, least: int) -> DataFrame:
    """The last rows by a number that no two rows share, a share of all but at least `least`."""
    _, last = nth(rows, -F.col(order), order, max(least, int(rows.count() * share)))
    return rows.where(F.col(order) >= last)


def head_of_each(rows: DataFrame, stratum: str, order: str, n: int) -> DataFrame:
    """The first n rows of each stratum (T09); partitions are cut to n each before the shuffle."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy(order))).where(F.col("__r") <= n).drop("__r")
