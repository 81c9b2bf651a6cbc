"""Session factory and table loading."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def session(master: str = "local[8]", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings that every query assumes: UTC, ANSI and adaptive execution."""
    build = (
        SparkSession.builder.master(master)
        .appName("trailforge")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        build = build.config(key.replace("__", "."), value)
    spark = build.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; sf_dir may be any path or URI that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] | list[str] = tuple(TABLES)) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; one of our own only where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            warnings.warn("spark.checkpoint.dir is not set: a folder of this machine is used, which executors elsewhere do not see", stacklevel=2)
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="trailforge-checkpoint-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_built: dict[tuple[str, str, int], str] = {}
#: Bytes of input files for each bucket of a stored table, so that what a task sorts does not grow with the tables.
BUCKET_BYTES = 6_000_000


def _files(source: DataFrame) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of the files that a table is read from."""
    spark = source.sparkSession
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    files = []
    for f in sorted(source.inputFiles()):
        place = hadoop.Path(f)
        status = place.getFileSystem(conf).getFileStatus(place)
        files.append((f, status.getLen(), status.getModificationTime()))
    return files


def _once(source: DataFrame, name: str, make: Callable[[], str]) -> str:
    """The folder that `make` filled for this application, this name and the files of a table as they are; made again if it has gone."""
    spark = source.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    key = (spark.sparkContext.applicationId, name, hash(tuple(_files(source))))
    place = hadoop.Path(_built.get(key, "/"))
    if key not in _built or not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        _built[key] = make()
    return _built[key]


def built(source: DataFrame, name: str, write: Callable[[str], object]) -> str:
    """The folder of what `write` makes of a table read from files, written once."""

    def make() -> str:
        write(path := scratch(source.sparkSession, name))
        return path

    return _once(source, name, make)


def built_table(source: DataFrame, name: str, rows: Callable[[int], DataFrame], key: str) -> DataFrame:
    """The rows that `rows` makes of tables read from files, as a table that is bucketed and sorted by a key, written once.

    `rows` takes the number of buckets and deals its rows to as many partitions by the key, as repartition or a plan over a table
    with the same buckets does. There are as many buckets as shuffle partitions, and more where the files of `source` are large:
    a join by the key shuffles the other side only, to the table's buckets, and sorts the other side only: a bucket is one file,
    and its order is told to the planner.
    """
    spark = source.sparkSession
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(size for _, size, _ in _files(source)) // BUCKET_BYTES))

    def title(path: str) -> str:
        return path.rsplit("/", 1)[-1].replace("-", "_")

    def make() -> str:
        path = scratch(spark, name)
        rows(buckets).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(title(path))
        return path

    return spark.table(title(_once(source, f"{name}-{buckets}", make)))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless they find it on the path that they share with the driver."""
    root, context = repo_root(), spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_trailforge_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="trailforge-")
    context.addPyFile(shutil.make_archive(os.path.join(folder, "trailforge"), "zip", root, "trailforge"))
    context._trailforge_shipped = True


def repo_root() -> str:
    return os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
