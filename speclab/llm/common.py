"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speclab.session import cut_lineage, drop_written  # noqa: F401  (re-exported for the operators)

# Arrow batches handed to Python are bounded by bytes, so a run of very long
# texts cannot fill a worker; used only where the session left the setting open.
BATCH_BYTES = "8m"
UNSET_BATCH_BYTES = "67108864b"      # Spark's own default
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == UNSET_BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def map_texts(df: DataFrame, id_col: str, text_col: str, more: list[str], schema: str,
              make: Callable[[list[str | None]], dict]) -> DataFrame:
    """Run ``make`` over Arrow batches of ``text_col``.

    Only ``id_col``, ``more`` and the text leave the JVM (clashing extra columns
    never reach Python); ``make`` turns the batch's texts into result columns of the
    same length, which follow the passed-through columns. ``schema`` is the whole
    result schema.
    """
    bounded_batches(df.sparkSession)
    keep = [id_col, *more]
    # positional names: the input may hold any other column
    slim = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keep)], df[text_col].alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(batch.column(len(keep)).to_pylist())
            cols = [batch.column(i) for i in range(len(keep))] + [pa.array(v) if not isinstance(v, pa.Array) else v
                                                                  for v in made.values()]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *made])

    return slim.mapInArrow(run, schema)


def type_of(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def ascii_lower(col):
    """Lower-case A-Z only, as the word rules ask (other letters keep their case)."""
    return F.translate(col, UPPER, LOWER)
