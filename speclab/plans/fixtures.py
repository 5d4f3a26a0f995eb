"""Derived inputs for the registered queries (FIXTURES.md).

``scored``: a scored table without a model, for exact metric oracles:
label from the flow rule, score = (l_partkey % 101) / 100, prediction =
score >= 0.5, split and fold from the row key's md5 hex digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speclab.sources.io import scan_table, spread_small_scan


def _hex2int(c, start: int, n: int = 2):
    return F.conv(F.substring(c, start, n), 16, 10).cast("int")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spread_small_scan(scan_table(spark, f"{sf_dir}/lineitem.parquet"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    day = F.date_format(F.col("l_shipdate"), "yyyy-MM-dd")
    row_id = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in
                                      ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
                               cents.cast("string"), day))
    score = (F.col("l_partkey") % 101) / 100.0
    b = _hex2int(F.col("row_id"), 1)
    return (li.select(row_id.alias("row_id"),
                      F.when((F.col("l_quantity") > 25) & (F.col("l_discount") < 0.08), 1).otherwise(0).alias("label"),
                      score.alias("score"))
              .withColumn("prediction", F.when(F.col("score") >= 0.5, 1).otherwise(0))
              .withColumn("split", F.when(b < 179, "train").when(b < 217, "test").otherwise("val"))
              .withColumn("fold", (_hex2int(F.col("row_id"), 3) % 10).cast("int")))
