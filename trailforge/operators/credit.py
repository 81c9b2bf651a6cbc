"""Rewards, group-relative advantages and step credit over trajectories.

trajectories: (question, traj, outcome); steps: (question, traj, step, retrieved, is_error, tokens, action);
gold: (question, pos, entity). A question's trajectories are one group; everything is partitioned by question or
trajectory, both of which are bounded by the number of samples and steps of one question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6


def episode_advantage(trajectories: DataFrame) -> DataFrame:
    """(question, traj, episode): z-score of the outcome within its question, with the sample deviation, 1 for a single one."""
    w = Window.partitionBy("question")
    z = (F.col("outcome") - F.avg("outcome").over(w)) / (F.coalesce(F.stddev_samp("outcome").over(w), F.lit(1.0)) + EPS)
    return trajectories.select("question", "traj", z.alias("episode"))


def first_hits(steps: DataFrame, gold: DataFrame) -> DataFrame:
    """(question, traj, pos, hit): the first step that retrieved each gold entity."""
    return steps.join(gold, (steps["question"] == gold["question"]) & (steps["retrieved"] == gold["entity"])).groupBy(steps["question"], "traj", "pos").agg(F.min("step").alias("hit"))


def anchor_advantage(hits: DataFrame, trajectories: DataFrame) -> DataFrame:
    """(question, traj, pos, hit, adv) in groups of one question and gold entity that have two members or more and differ in outcome."""
    w = Window.partitionBy("question", "pos")
    joined = hits.join(trajectories.select("question", "traj", "outcome"), ["question", "traj"])
    marked = joined.withColumns({"members": F.count("*").over(w), "mean": F.avg("outcome").over(w), "std": F.coalesce(F.stddev_samp("outcome").over(w), F.lit(0.0))})
    return marked.where((F.col("members") >= 2) & (F.col("std") > EPS)).select("question", "traj", "pos", "hit", ((F.col("outcome") - F.col("mean")) / (F.col("std") + EPS)).alias("adv"))


def hop_advantage(steps: DataFrame, anchors: DataFrame) -> DataFrame:
    """(traj, step, hop): for each step the advantage of the latest anchor at or before it; on ties the earlier gold entity.

    The inequality is a residual of an equi-join on the trajectory.
    """
    met = steps.select("traj", "step").join(anchors.select("traj", "pos", "hit", "adv"), "traj").where(F.col("step") >= F.col("hit"))
    return met.groupBy("traj", "step").agg(F.max_by("adv", F.struct("hit", -F.col("pos"))).alias("hop"))


def mixed_advantage(steps: DataFrame, episode: DataFrame, hop: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(question, traj, step, final): alpha times episode plus the rest times hop, 0 where no anchor reaches."""
    joined = steps.join(episode.select("traj", "episode"), "traj").join(hop, ["traj", "step"], "left")
    return joined.withColumn("final", alpha * F.col("episode") + (1 - alpha) * F.coalesce("hop", F.lit(0.0)))


def token_advantage(steps: DataFrame, trajectories: DataFrame, hits: DataFrame, anchored: Column, alpha: float = 0.5) -> DataFrame:
    """(traj, step, adv): the variant without a fatal mask (V18). Groups whose deviation is below EPS are skipped, one at EPS is not; only
    trajectories that `anchored` holds for take part in groups, the others have the episode's advantage alone."""
    w = Window.partitionBy("question", "pos")
    joined = hits.where(anchored).join(trajectories.select("question", "traj", "outcome"), ["question", "traj"])
    marked = joined.withColumns({"members": F.count("*").over(w), "mean": F.avg("outcome").over(w), "std": F.coalesce(F.stddev_samp("outcome").over(w), F.lit(0.0))})
    anchors = marked.where((F.col("members") >= 2) & (F.col("std") >= EPS)).select("traj", "pos", "hit", ((F.col("outcome") - F.col("mean")) / (F.col("std") + EPS)).alias("adv"))
    mixed = mixed_advantage(steps, episode_advantage(trajectories), hop_advantage(steps, anchors), alpha)
    return mixed.select("traj", "step", F.when(anchored, F.col("final")).otherwise(F.col("episode")).alias("adv"))


def fatal_starts(steps: DataFrame, run: int = 3) -> DataFrame:
    """(traj, fatal): where the first run of at least `run` errors in a row begins (W04), by gaps and islands."""
    w = Window.partitionBy("traj").orderBy("step")
    island = F.sum(F.when(F.col("is_error"), 0).otherwise(1)).over(w)
    errors = steps.withColumn("island", island).where("is_error")
    numbered = errors.withColumn("n", F.row_number().over(Window.partitionBy("traj", "island").orderBy("step")))
    return numbered.where(F.col("n") == run).groupBy("traj").agg((F.min("step") - run + 1).alias("fatal"))


def fatal_mask(final: DataFrame, fatal: DataFrame) -> DataFrame:
    """Advantages from the fatal step on are 0, those before it not below 0; other trajectories stay."""
    masked = F.when(F.col("fatal").isNull(), F.col("final")).when(F.col("step") >= F.col("fatal"), 0.0).otherwise(F.greatest("final", F.lit(0.0)))
    return final.join(fatal, "traj", "left").withColumn("masked", masked)


def token_offsets(steps: DataFrame) -> DataFrame:
    """(start, end) of each step in its trajectory's tokens."""
    w = Window.partitionBy("traj").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("tokens").over(w)
    return steps.withColumns({"start": end - F.col("tokens"), "end": end})


def gate(ratio: Column, adv: Column, tau_up: float = 1.0, tau_down: float = 1.05) -> Column:
    """The smooth gate 4/tau * sigmoid(tau * (ratio - 1)) with its own tau for each sign of the advantage."""
    tau = F.when(adv > 0, tau_up).otherwise(tau_down)
    return 4 / tau / (1 + F.exp(-tau * (ratio - 1)))


def gated_loss(tokens: DataFrame, *by: str, kl_coef: float = 0.001) -> DataFrame:
    """Loss, KL penalty and total over rows (logp, logp_old, logp_ref, adv, mask)."""
    ratio = F.exp(F.col("logp") - F.col("logp_old"))
    loss = -gate(ratio, F.col("adv")) * F.col("adv")
    masked = F.try_divide(F.sum(loss * F.col("mask")), F.when(F.sum("mask") > 0, F.sum("mask")))
    kl = kl_coef * F.sum((F.col("logp") - F.col("logp_ref")) * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1.0))
    return tokens.groupBy(*by).agg(F.coalesce(masked, F.sum(loss)).alias("loss"), kl.alias("kl"), F.avg(ratio).alias("mean_ratio")).withColumn("total", F.col("loss") + F.col("kl"))


def repeated_actions(steps: DataFrame, n: int = 3, threshold: float = 0.5) -> DataFrame:
    """(traj, repeats): whether less than 1 - threshold of the n-grams of the last 4n actions is distinct; false under 2n actions."""
    last = F.row_number().over(Window.partitionBy("traj").orderBy(F.desc("step")))
    tail = steps.withColumn("r", last).where(F.col("r") <= 4 * n)
    gram = F.concat_ws("|", F.collect_list("action").over(Window.partitionBy("traj").orderBy("step").rowsBetween(0, n - 1)))
    size = F.count("*").over(Window.partitionBy("traj").orderBy("step").rowsBetween(0, n - 1))
    grams = tail.select("traj", gram.alias("g"), (size == n).alias("whole"))
    found = grams.groupBy("traj").agg(F.count("*").alias("actions"), F.count_if("whole").alias("all"), F.count_distinct(F.when(F.col("whole"), F.col("g"))).alias("distinct"))
    return found.select("traj", F.when(F.col("actions") < 2 * n, False).otherwise(F.col("distinct") / F.col("all") < 1 - threshold).alias("repeats"))


def total_rewards(rewards: DataFrame, success: float = 1.5, step_cost: float = 0.02, low: float = -4.0, high: float = 8.0) -> DataFrame:
    """(question, traj, total): step rewards, a bonus for success, a cost for each step after the first, clamped; all 0 in a
    question whose totals hardly differ (A26)."""
    raw = rewards.groupBy("question", "traj").agg((F.sum("reward") + success * F.max("success") - step_cost * (F.count("*") - 1)).alias("raw"))
    raw = raw.withColumn("raw", F.greatest(F.lit(low), F.least(F.lit(high), F.col("raw"))))
    std = F.coalesce(F.stddev_samp("raw").over(Window.partitionBy("question")), F.lit(0.0))
    return raw.select("question", "traj", F.when(std < 1e-6, 0.0).otherwise(F.col("raw")).alias("total"))


# step rewards: ladders over flags of one step


def retrieval_reward(called: Column, id_hit: Column, overlap: Column, zoom: Column) -> Column:
    """.5 for the id, then by token overlap; -.1 without results; a fifth more for a good result after a zoom; 0 if nothing was called."""
    base = F.when(id_hit, 0.5).when(overlap.isNull(), -0.1).when(overlap > 0.5, 0.3).when(overlap > 0.2, 0.1).when(overlap > 0.05, -0.1).otherwise(-0.3)
    return F.when(~called, 0.0).when(zoom & (base > 0), base * 1.2).otherwise(base)


def research_reward(action: Column, valid: Column, gold: Column, coverage: Column, enough: Column) -> Column:
    """The research world's step reward, clamped to [-2, 3]."""
    part = (
        F.when(action == "search", F.when(gold, 0.15).otherwise(0.05))
        .when(action == "cite_source", F.when(gold, 0.3).otherwise(0.05))
        .when(action == "refine_query", 0.03)
        .when(action == "open_result", F.when(gold, 0.2).otherwise(0.0))
        .when(action == "submit_report", 2.0 * coverage - F.when(enough, 0.0).otherwise(1.0))
        .otherwise(0.0)
    )
    return F.greatest(F.lit(-2.0), F.least(F.lit(3.0), F.when(valid, part - 0.02).otherwise(-0.52)))


def shopping_reward(action: Column, valid: Column, gold: Column, changed: Column) -> Column:
    """The shopping world's step reward."""
    part = (
        F.when(action == "search", F.when(gold, 0.4).otherwise(-0.1))
        .when(action == "click_product", F.when(gold, 0.3).otherwise(-0.1))
        .when(action == "zoom", F.when(gold, 0.2).otherwise(0.0))
        .when(action == "buy", F.when(gold, 2.0).when(changed, -1.0).otherwise(-0.5))
        .when(action == "add_cart", F.when(gold, 0.5).otherwise(-0.3))
        .when(action == "back", -0.1)
        .otherwise(0.0)
    )
    return F.when(valid, part - 0.05).otherwise(-0.85)
