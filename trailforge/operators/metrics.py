"""Retrieval and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailforge.operators.retrieval import bounded
from trailforge.session import checkpoint

#: Where recall is cut, and the bins of the rank histogram.
CUTS = (1, 3, 5, 6, 10)
BINS = (("1", 1, 1), ("2-5", 2, 5), ("6-10", 6, 10), ("11-20", 11, 20), ("21-50", 21, 50), ("51-100", 51, 100), (">100", 101, 1 << 40))
RECALL_SQL = ", ".join(f"round(avg(CASE WHEN rank BETWEEN 1 AND {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_{k}" for k in CUTS) + (
    ", round(avg(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr, round(avg(rank), 6) AS avg_rank, count(*) FILTER (WHERE rank IS NULL) AS misses"
)


def _share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def recall_report(best: DataFrame, *by: str) -> DataFrame:
    """recall@k, MRR (a miss adds 0), mean rank of hits and misses of rows with the best `rank` of each query, null for a miss."""
    recalls = [F.round(_share(F.col("rank").between(1, k)), 6).alias(f"recall_{k}") for k in CUTS]
    mrr = F.round(F.avg(F.when(F.col("rank") > 0, 1.0 / F.col("rank")).otherwise(0.0)), 6).alias("mrr")
    return best.groupBy(*by).agg(F.count("*").alias("n"), *recalls, mrr, F.round(F.avg("rank"), 6).alias("avg_rank"), F.count_if(F.col("rank").isNull()).alias("misses"))


def hit_report(best: DataFrame, top: int = 20, *by: str) -> DataFrame:
    """hit@1/5/20, mean and exact median rank with a miss as top + 1, and misses."""
    rank = F.coalesce(F.col("rank"), F.lit(top + 1))
    hits = [F.round(_share(rank <= k), 6).alias(f"hit_{k}") for k in (1, 5, 20)]
    return best.groupBy(*by).agg(F.count("*").alias("n"), *hits, F.round(F.avg(rank), 6).alias("mean_rank"), F.median(rank).alias("median_rank"), F.count_if(rank > top).alias("not_found"))


def rank_histogram(best: DataFrame) -> DataFrame:
    """Queries per rank bin, empty bins too; a miss is 101."""
    spark = best.sparkSession
    bins = F.broadcast(spark.createDataFrame(BINS, "bin string, lo long, hi long"))
    rank = best.select(F.coalesce(F.col("rank").cast("long"), F.lit(101)).alias("r"))
    return bins.join(rank, F.col("r").between(F.col("lo"), F.col("hi")), "left").groupBy("bin").agg(F.count("r").alias("n"))


def report(rows: DataFrame, level: str, **measures: Column) -> DataFrame:
    """Counts and measures by level and over all, in one pass with grouping sets."""
    named = {"success": "success_rate", "steps": "mean_steps"}
    g = rows.cube(level).agg(F.count("*").alias("n"), F.grouping(level).alias("__g"), *[F.round(m, 6).alias(named.get(k, k)) for k, m in measures.items()])
    return g.withColumn("level", F.when(F.col("__g") == 1, "all").otherwise(F.col(level))).drop(level, "__g")


#: The names of failures, in the order in which they are looked for, and the coverage that is low.
FAILURES = ("Success", "FormatOrActionError", "GTNotInCandidates", "NeverOpenedGT", "OpenedGTButNeverCited", "CitedButNotSubmitted", "SubmittedWithLowCoverage", "NeedsManualReview")
SHOP_FAILURES = ("Success", "FormatOrActionError", "NeverClickedGT_NotInCandidates", "NeverClickedGT", "ClickedGTButFinalWrong", "PossibleNeedsZoomOrCrop", "NeedsManualReview_AfterZoom")
LOW_COVERAGE = 0.5
#: Names and bounds of the root causes of lost documents.
CAUSES = ("no_samples", "mismatch", "top_k_cut", "mismatch_likely")
LOST_SHARE, FOUND_SHARE, FAR_RANK, CUT_SHARE, NEAR_SHARE = 0.4, 0.5, 50, 0.2, 0.7


def _first_of(names: tuple[str, ...], *conditions: Column) -> Column:
    """The name of the first condition that holds, the last name if none does."""
    return F.coalesce(*[F.when(c, name) for c, name in zip(conditions, names)], F.lit(names[-1]))


def running_mean(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Adds mean: the mean of a value over a group's rows up to this one.

    Rows are dealt to ordered ranges; a range starts from the sums of the group's ranges before it, which are as many rows as the
    group has ranges. No task holds more than a range, however many rows a group has. order is unique in a group.
    """
    dealt = checkpoint(rows.repartitionByRange(group, order).withColumn("__part", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(group, "__part").agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    start = sums.select(group, "__part", F.coalesce(F.sum("__s").over(before), F.lit(0.0)).alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"))
    here = Window.partitionBy(group, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mean = F.try_divide(F.col("__s") + F.coalesce(F.sum(value).over(here), F.lit(0.0)), F.col("__n") + F.count(value).over(here))
    return dealt.join(bounded(start), [group, "__part"]).select(*rows.columns, mean.alias("mean"))


def failure_bucket(success: Column, malformed: Column, in_candidates: Column, opened: Column, cited: Column, submitted: Column, coverage: Column) -> Column:
    """The first thing that went wrong."""
    return _first_of(FAILURES, success, malformed, ~in_candidates, ~opened, ~cited, ~submitted, coverage < LOW_COVERAGE)


def shopping_failure(success: Column, malformed: Column, in_candidates: Column, clicked: Column, bought: Column, zoomed: Column) -> Column:
    """The first thing that went wrong in the shopping world."""
    return _first_of(SHOP_FAILURES, success, malformed, ~in_candidates, ~clicked, bought, ~zoomed)


def root_cause(best: DataFrame) -> DataFrame:
    """One row (total, lost, top6, top20, top50, mid, cause) from the ranks of wanted documents, 101 for one that is not found."""
    rank = F.col("rank")
    s = best.agg(F.count("*").alias("total"), F.count_if(rank > 100).alias("lost"), *[F.count_if(rank <= k).alias(f"top{k}") for k in (6, 20, 50)], F.median(rank).alias("mid"))
    total, found = F.col("total"), F.col("total") - F.col("lost")
    mismatch = (F.col("lost") >= F.greatest(F.lit(1), F.floor(total * LOST_SHARE))) | (found <= total * FOUND_SHARE) | (F.col("mid") > FAR_RANK)
    cut = (F.col("top50") - F.col("top6") >= F.greatest(F.lit(2), F.floor(total * CUT_SHARE))) | ((F.col("top20") > F.col("top6")) & (F.col("top50") >= total * NEAR_SHARE))
    return s.withColumn("cause", _first_of(CAUSES, total == 0, mismatch, cut))


def treatment_report(rows: DataFrame, arm: str, parts: dict[str, str]) -> DataFrame:
    """Arms 0 and 1 side by side, over all and by each of parts (label, column), in one pass (A15). rows: (success, reward, steps)."""
    columns, out = list(parts.values()), []
    for name, value in (("base", 0), ("treat", 1)):
        own = lambda c: F.when(F.col(arm) == value, c)  # noqa: B023, E731
        reward = own(F.col("reward"))
        out += [F.count(reward).alias(f"{name}_n"), F.avg(own(F.col("success").cast("int"))).alias(f"{name}_success"), F.avg(reward).alias(f"{name}_mean"), F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias(f"{name}_std"), F.min(reward).alias(f"{name}_min"), F.max(reward).alias(f"{name}_max"), F.avg(own(F.col("steps"))).alias(f"{name}_steps")]
    g = rows.groupingSets([*([c] for c in columns), []], *columns).agg(*out, *[F.grouping(c).alias(f"__{c}") for c in columns])
    label = F.coalesce(*[F.when(F.col(f"__{c}") == 0, F.concat(F.lit(f"{k}:"), c)) for k, c in parts.items()], F.lit("all"))
    rounded = [F.round(f"{a}_{m}", 6).alias(f"{a}_{m}") for a in ("base", "treat") for m in ("success", "mean", "std")]
    deltas = [F.round(F.col("treat_mean") - F.col("base_mean"), 6).alias("delta"), F.round(F.col("treat_steps") - F.col("base_steps"), 6).alias("steps_delta")]
    return g.where("base_n > 0 AND treat_n > 0").select(label.alias("part"), "base_n", "treat_n", *rounded, "base_min", "treat_min", "base_max", "treat_max", *deltas)
