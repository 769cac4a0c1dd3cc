"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every kairos job relies on: UTC session time (all timestamps are
# TIMESTAMP_NTZ, but literals and date_trunc must not drift), AQE for runtime
# coalescing / skew-join splitting, Arrow for the pandas paths.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    # bigger Arrow batches: fewer Python round trips in the Gram pass
    "spark.sql.execution.arrow.maxRecordsPerBatch": "50000",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "kairos", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the kairos defaults.

    On a cluster leave ``master`` unset and size ``spark.sql.shuffle.partitions``
    from the input (AQE coalesces); locally tests pass ``local[*]`` and 8.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.ui.enabled", "false")
        conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_runtime_conf(spark: SparkSession) -> None:
    """Pin the SQL settings kairos depends on for an already running session."""
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
              "spark.sql.execution.arrow.pyspark.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"):
        spark.conf.set(k, DEFAULT_CONF[k])


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster setting always wins.  Only when it is unset *and* the master is
    local (tests, a laptop) do we pick a fresh scratch folder; on a cluster an
    unset value is an error, because a machine-local folder would not survive
    the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before fitting models")
    path = tempfile.mkdtemp(prefix="kairos-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by writing a Parquet table into ``spark.checkpoint.dir``.

    Used for small, reused intermediate tables (per-entity Gram matrices) that
    iterative fits scan many times; after an executor loss they are re-read
    from the shared folder instead of replaying the full-data aggregation.
    (``DataFrame.checkpoint`` on an unpersisted plan would compute it twice.)
    """
    root = checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{root}/kairos-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
