"""Sources and sinks.

Everything is a plain Spark reader / writer: the scan stays lazy so filters and
column pruning reach the file format, and split datasets are ONE parquet
dataset partitioned by ``split`` so reading one split prunes directories.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_table(spark: SparkSession, path: str | None = None, fmt: str = "parquet",
               options: Mapping[str, str] | None = None, table: str | None = None) -> DataFrame:
    """A1: read a named table through any Spark source (format + options + load)."""
    if table is not None:
        return spark.read.table(table)
    reader = spark.read.format(fmt)
    if options:
        reader = reader.options(**options)
    return reader.load(path) if path is not None else reader.load()


def spread_small_scan(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give a scan at least as many partitions as the session has task slots.

    A big table arrives in thousands of splits and is returned untouched (no
    shuffle). Only an input with fewer splits than slots - e.g. one parquet
    file with a single row group - is spread round-robin, so the map-side
    work after the scan (expressions, join probes, partial aggregation) does
    not run in one task.
    """
    spark = df.sparkSession
    if spark.conf.get("speclab.spreadSmallScans", "true").lower() != "true":
        return df
    try:
        target = min_partitions or spark.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - sessions without RDD access: leave the scan as is
        return df
    if splits >= target:
        return df
    return df.repartition(target)


def register_view(df: DataFrame, name: str) -> DataFrame:
    """A2: name a frame for SQL."""
    df.createOrReplaceTempView(name)
    return df


def write_dataset(df: DataFrame, path: str, compression: str = "none",
                  partition_by: list[str] | None = None) -> str:
    """A3: parquet, overwrite, uncompressed by default (as the reference saves)."""
    w = df.write.mode("overwrite").option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_split_datasets(frames: Mapping[str, DataFrame] | DataFrame, path: str,
                         split_col: str = "split", compression: str = "none") -> str:
    """A4: save named splits.

    Given one keyed frame with a ``split`` column it is written once,
    partitioned by split. Given a mapping of name -> frame, every value must be a
    DataFrame (``ValueError`` otherwise, as the reference guards) and they are
    unioned by name under their split label and written in one job.
    """
    if isinstance(frames, DataFrame):
        combined = frames
    else:
        parts = []
        for name, frame in frames.items():
            if not isinstance(frame, DataFrame):
                raise ValueError(f"{name} is not a DataFrame")
            parts.append(frame.withColumn(split_col, F.lit(name)))
        if not parts:
            raise ValueError("no frames to write")
        combined = parts[0]
        for p in parts[1:]:
            combined = combined.unionByName(p, allowMissingColumns=True)
    return write_dataset(combined, path, compression=compression, partition_by=[split_col])


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A5."""
    return spark.read.parquet(path)


def read_split_datasets(spark: SparkSession, path: str, names=("train", "test", "val"),
                        split_col: str = "split") -> dict[str, DataFrame]:
    """One lazy frame per split; the filter on the partition column prunes folders."""
    base = spark.read.parquet(path)
    return {n: base.where(F.col(split_col) == n) for n in names}


def save_model(model, path: str) -> str:
    """Persist a fitted Spark ML model / pipeline model."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str):
    """Load a model saved by A7; its metadata names the class."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import DecisionTreeClassificationModel
    spark = SparkSession.getActiveSession()
    kind = json.loads(spark.read.text(f"{path}/metadata").first()["value"])["class"].rpartition(".")[2]
    return {"PipelineModel": PipelineModel, "DecisionTreeClassificationModel": DecisionTreeClassificationModel}[kind].load(path)
