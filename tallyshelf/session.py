"""Session settings this library is written for."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Applies to a side whose size Spark has measured; nothing in the library forces a broadcast.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


#: Tables written by ``settle`` in this session; see ``drop_settled``.
_SETTLED: list[str] = []


def build_session(app: str = "tallyshelf", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the library's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only a local session without
    that setting gets a folder of its own; anywhere else a missing setting is an error, since a
    machine-local folder would not survive the loss of its machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tallyshelf-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Compute a table once that several later branches read, and cut its lineage.

    The rows are written as a table beside the checkpoints, in the folder all executors share, so
    they survive the loss of an executor; Spark then knows their real size when it plans joins.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _SETTLED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_later(path: str) -> str:
    """Let ``drop_settled`` delete a folder too."""
    _SETTLED.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what is settled inside the block at its end; for work whose results are written by then."""
    before = len(_SETTLED)
    try:
        yield
    finally:
        drop_settled(spark, before)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Let the shuffle files of each job inside the block go when it ends, not when their plan is garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drop_settled(spark: SparkSession, before: int = 0) -> None:
    """Delete the tables this session has settled, all but the first ``before``, once their readers are done."""
    conf = spark._jsc.hadoopConfiguration()
    while len(_SETTLED) > before:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SETTLED.pop())
        path.getFileSystem(conf).delete(path, True)
