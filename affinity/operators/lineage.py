"""Lineage cuts at the reliable checkpoint folder, and sessions with settings of their own."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and return it with its lineage cut.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. A temporary one
    is set only where that setting is absent and all runs on one machine (tests, a laptop);
    executors elsewhere would not see it.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints, which all executors see."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="affinity-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new place in the folder that all executors see, deleted when the driver ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark), f"affinity-{uuid.uuid4().hex}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return place.toString()


def dropped(spark: SparkSession, place: str) -> None:
    """Deletes what ``scratch`` named before the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut, and a reader takes only the columns it needs.

    A tenth of a checkpoint's bytes for numbers. The shuffles that made it are dropped.
    """
    spark, place = df.sparkSession, scratch(df.sparkSession)
    with dropped_shuffles(spark):
        df.write.option("compression", "zstd").parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def own_session(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session with the settings of ``spark`` and these: frames that are read in it are planned by them, others are not."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and spark.conf.isModifiable(name):
            own.conf.set(name, value)
    for name, value in settings.items():
        own.conf.set(name, value)
    return own


#: Spark's setting that deletes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Plans made and run in here leave no shuffle files, which would else wait for the driver's collector.

    For plans that run once, up to a ``cut`` or a ``collect``, and hold nothing persisted.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
