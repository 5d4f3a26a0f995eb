"""Spark session helper.

On a cluster the session comes from the platform; this helper only fills in
settings that are unset, so a cluster's own values always win.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: AQE re-plans shuffles at runtime (partition
# coalescing, skew-join splitting, broadcast conversion when a side is measured
# small), ANSI keeps strict casts strict, UTC pins timestamp text.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "speclab",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: executors live in the driver JVM
            builder = builder.config("spark.driver.memory", os.environ.get("SPECLAB_DRIVER_MEMORY", "8g"))
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, creating a local one only when unset.

    A cluster names a shared folder in ``spark.checkpoint.dir``; it is used as is.
    Only a local session without that setting (tests, bench) gets a fresh
    scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="speclab-ckpt-", dir=os.environ.get("SPECLAB_SCRATCH", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df):
    """Cut the lineage with a table written under the shared checkpoint folder.

    Survives executor loss (never a local checkpoint). Writing parquet and
    reading it back computes the input once; ``Dataset.checkpoint`` on an
    uncached plan runs it twice (one job to count, one to write the files).
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, "speclab-tables", uuid.uuid4().hex)
    df.write.mode("overwrite").parquet(path)
    release_at_exit(spark, path)
    out = spark.read.parquet(path)
    out._written_at = path
    return out


def drop_written(*tables) -> None:
    """Delete tables of ``cut_lineage`` now. Everything made from them must be written already."""
    for t in tables:
        spark = t.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._written_at)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system delete ``path`` when the application ends.

    Results are lazy, so a written intermediate table is needed until then; nothing
    is left in the shared folder afterwards.
    """
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
