"""Session settings and the reliable working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Frees the shuffle files of a query when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_folder: dict[str, str] = {}


def build(master: str | None = None, **extra: str) -> SparkSession:
    """Session for tests, the bench and small local runs; a cluster brings its own."""
    builder = SparkSession.builder.appName("rollgrid")
    if master:
        builder = builder.master(master)
    options = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        **extra,
    }
    for name, value in options.items():
        builder = builder.config(name, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Settings every job here relies on; safe to apply to any session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # stateful folds need it
    return spark


def reliable_folder(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``. Only a local session may go without and gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        folder = _own_folder.setdefault(app, tempfile.mkdtemp(prefix="rollgrid-"))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def task_count(spark: SparkSession) -> int:
    """Tasks for steps whose work is Python time, which Spark cannot see from the size of the rows.

    Passing a number to ``repartition`` keeps adaptive execution from merging such tasks.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a key together in one task, for a map over partitions that relies on it.

    The hash of the keys, not the keys themselves: Spark drops a repartition its input already
    satisfies, and adaptive execution may afterwards turn the join that satisfied it into a
    broadcast join, which does not.
    """
    return df.repartition(task_count(df.sparkSession), F.xxhash64(*keys))


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the reliable folder: computed once, with a short lineage from here on."""
    path = fresh_path(df.sparkSession, label)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Tables written here stand for the work before them, so the shuffle files that led to them go at once."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the reliable folder that nothing else uses."""
    return f"{reliable_folder(spark)}/{label}-{uuid.uuid4().hex}"
