"""Corpus cleaning: picks, tags, stable ids, dedup and fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def hash_number(key: Column) -> Column:
    """The first 32 bits of the md5 of a key, as a number that every engine agrees on."""
    return F.conv(F.left(F.md5(key.cast("string").cast("binary")), F.lit(8)), 16, 10).cast("long")


def hash_bucket(key: Column, n: int) -> Column:
    return hash_number(key) % n


def remap_paths(paths: DataFrame, present: DataFrame, column: str, prefixes: tuple[str, ...], markers: tuple[str, ...], root: str) -> DataFrame:
    """paths with `resolved` (X24): the path if it is present, else what follows a prefix or a marker under the root if that is present,
    tried in this order, else the path. present (path) lists what is there; candidates meet it in one join."""
    raw, norm = F.col(column), F.replace(F.col(column), F.lit("\\"), F.lit("/"))
    under = lambda rest: F.concat(F.lit(root.rstrip("/") + "/"), F.ltrim(rest, F.lit("/")))
    tries = [raw] + [F.when(norm.startswith(p), under(F.substr(norm, F.lit(len(p) + 1)))) for p in prefixes]
    tries += [F.when(F.contains(norm, F.lit(m)), under(F.substr(norm, F.instr(norm, m) + len(m)))) for m in markers]
    spread = paths.select(column).distinct().select(column, F.posexplode(F.array(*tries)).alias("__k", "__path")).where("__path IS NOT NULL")
    there = present.select(F.col("path").alias("__path")).distinct()
    found = spread.join(there, "__path", "left_semi").groupBy(column).agg(F.min_by("__path", "__k").alias("resolved"))
    return paths.join(found, column, "left").withColumn("resolved", F.coalesce("resolved", column))


def pick_language(languages: Column, captions: Column, titles: Column, wanted: str = "en") -> Column:
    """(caption, title) of the wanted language from parallel arrays, null where the language is absent."""
    at = F.array_position(languages, wanted).cast("int")
    pick = lambda values: F.when(at > 0, F.get(values, at - 1))
    return F.struct(pick(captions).alias("caption"), pick(titles).alias("title"))


def category_tags(text: Column, keywords: tuple[str, ...]) -> Column:
    """The keywords that stand anywhere in the lower-cased text, also within words."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, k))


def prioritised(rows: DataFrame, flag: str, order: str, n: int) -> DataFrame:
    """Flagged rows first, the others fill up to n (F06); a top-n, not a full sort."""
    return rows.orderBy(F.desc(flag), order).limit(n)


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key (W15); an aggregation with map-side minima, not a window."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    if not rest:
        return rows.groupBy(*keys).agg(F.min(order).alias(order))
    return rows.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("r")).select(*keys, "r.*")


def image_path(qid: Column) -> Column:
    """A sub-folder of up to four characters, then the id."""
    return F.concat_ws("/", F.when(F.length(qid) <= 4, qid).otherwise(F.left(qid, F.lit(4))), F.concat(qid, F.lit(".jpg")))


def image_folder(qid: str) -> str:
    """The same rule for one id on the driver."""
    return f"{qid[:4]}/{qid}.jpg"


def repeats_itself(text: Column, n: int, least: float) -> Column:
    """Whether less than this share of the character n-grams is distinct (W11). Characters of one width are cut where they lie, and
    n-grams are told apart by a hash, so that a long text costs in proportion to its length."""
    count, wide = F.length(text) - (n - 1), F.encode(text, "UTF-32")

    def share(data: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: F.xxhash64(F.substr(data, 4 * k + 1, F.lit(4 * n))))
        return F.size(F.array_distinct(grams)) / count

    return F.coalesce((count > 0) & (F.get(F.transform(F.array(wide), share), F.lit(0)) < least), F.lit(False))
