"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "repeatwise", cpus: str = "*", **conf: str) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own session."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "20g",
        "spark.sql.shuffle.partitions": "8",
    }
    settings.update(conf)
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application inside the shared folder named by ``spark.checkpoint.dir``; ``clear_scratch`` ends it.

    Only a local master may fall back to a folder of its own: on a cluster the executors would not see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="repeatwise-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return f"{configured.rstrip('/')}/run-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has written to its scratch folder; frames that still read it are lost."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def arrow_batches(spark: SparkSession, size: str | None):
    """What runs inside hands Python batches of at most ``size`` (none: of the session's size); the session's own setting comes back at the end."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key, None)
    if size:
        spark.conf.set(key, size)
    try:
        yield
    finally:
        if size:
            spark.conf.unset(key) if own is None else spark.conf.set(key, own)


def written(df: DataFrame, label: str, batch: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back.

    Cuts the lineage, survives lost executors, runs the plan exactly once, and gives the optimizer the real
    size of the table, so that a later join broadcasts it only when it fits. ``batch``: see ``arrow_batches``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with arrow_batches(spark, batch):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
