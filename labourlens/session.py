"""Session settings, checkpointing and scratch folders.

Everything that has to survive a lost executor goes through the shared folder
named by ``spark.checkpoint.dir``.  A folder of our own is made only when the
session runs in local mode and names none.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Keep splitting hot join partitions even where it costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # What a finished step has shuffled goes with it, not when the driver happens to collect its garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
# Fixed at start-up: call sites per column cost more than the columns when expressions are long.
STARTUP_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build(app: str = "labourlens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **STARTUP_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to a foreign session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set up on first use."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="labourlens-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new, never reused path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Write the frame to the checkpoint folder and drop its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """The frame as a Parquet table under the shared folder, for results read more
    than once: computed once, scanned by column, safe when executors are lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when a scan yields fewer tasks than there are cores.

    Only a small or single-file input takes the exchange; a large table already
    has more splits than cores and passes through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
