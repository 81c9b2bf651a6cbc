"""Results saved as they come, exactly once: a stream, a checkpoint, and a list of the batches that count.

A batch is written to a folder of its own, named by its number, and then listed, with its rows and its sums. A batch that
was stopped while it was written is written anew over what it left; one that is listed already, but that the stream
does not know to be done, is left as it is. Readers see listed batches only, so no row is lost and none comes twice,
wherever a run ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def save(results: DataFrame, path: str, sums: tuple[str, ...] = (), written: Callable[[int], None] | None = None) -> None:
    """Run a stream of results to the end of what has arrived; the next call goes on where this one ended.

    sums: number columns whose totals are listed with each batch. written: called between a batch and its entry in the list.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark, entry = batch.sparkSession, f"{path}/listed/{number:09d}"
        if _exists(spark, f"{entry}/_SUCCESS"):
            return
        batch.write.mode("overwrite").parquet(f"{path}/batches/{number:09d}")
        if written:
            written(number)
        kept = spark.read.schema(batch.schema).parquet(f"{path}/batches/{number:09d}")
        kept.agg(F.lit(number).cast("long").alias("batch"), F.count("*").alias("n"), *[F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in sums]).coalesce(1).write.mode("overwrite").json(entry)

    query = results.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def listed(spark: SparkSession, path: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """(batch, n, *sums) of the batches that count."""
    schema = ", ".join(["batch long", "n long", *(f"`{c}` double" for c in sums)])
    return spark.read.schema(schema).json(f"{path}/listed/*") if _exists(spark, f"{path}/listed") else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that count, with their batch."""
    numbers = [r["batch"] for r in listed(spark, path).select("batch").collect()]  # one for each batch
    rows = spark.createDataFrame([], f"{schema}, batch long")
    if numbers:
        rows = spark.read.schema(schema).parquet(*[f"{path}/batches/{k:09d}" for k in numbers])
        rows = rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"/batches/(\d+)/", 1).cast("long"))
    return rows


def report(spark: SparkSession, path: str, hits: tuple[str, ...]) -> DataFrame:
    """Share of hits over all results so far, in percent, for each kind of hit."""
    total = listed(spark, path, hits).agg(F.sum("n").alias("evaluated"), *[F.sum(c).alias(c) for c in hits])
    return total.select(F.coalesce("evaluated", F.lit(0)).alias("evaluated"), *[F.coalesce(F.round(100 * F.col(c) / F.col("evaluated"), 6), F.lit(0.0)).alias(c) for c in hits])
