"""Writers. Each is a Spark write, so a lost task leaves no partial file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines."""
    df.write.mode(mode).json(path)


def json_arrays(df: DataFrame, path: str, rows: int = 10_000) -> None:
    """JSON arrays of at most `rows` objects, one to a line (K01); no task holds more than one array's rows at a time."""
    numbered = df.select(F.struct(*df.columns).alias("r"), F.floor(F.monotonically_increasing_id() / rows).alias("k"))
    numbered.groupBy("k").agg(F.to_json(F.collect_list("r")).alias("value")).select("value").write.mode("overwrite").text(path)


def episodes(df: DataFrame, path: str) -> None:
    """Episode lines with action and parameters as one JSON string."""
    rest = [c for c in df.columns if c not in ("action", "params")]
    df.select(*rest, F.to_json(F.struct("action", "params")).alias("completion")).write.mode("overwrite").json(path)


def bundle(df: DataFrame, path: str, light: list[str], level: str) -> None:
    """A benchmark as meta (counts by level), light (some columns) and full."""
    df.groupBy(level).agg(F.count("*").alias("n")).write.mode("overwrite").json(f"{path}/meta")
    df.select(*light).write.mode("overwrite").json(f"{path}/light")
    df.write.mode("overwrite").parquet(f"{path}/full")


def vector_store(df: DataFrame, path: str) -> None:
    """Vectors and their metadata."""
    df.write.mode("overwrite").parquet(path)


def index(postings: DataFrame, lengths: DataFrame, stats: DataFrame, path: str, buckets: int = 64) -> None:
    """An inverted index: postings dealt and sorted by token so that a probe reads few row groups, lengths and one row of statistics."""
    postings.repartition(buckets, "token").sortWithinPartitions("token", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    stats.write.mode("overwrite").parquet(f"{path}/stats")


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Written and read again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Results as they come."""
    df.write.mode("append").parquet(path)
