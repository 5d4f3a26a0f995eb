"""The ``readings`` wide table: process readings joined to lab results.

The supplied tables are TPC-H-like, so the wide process table of the reference
is derived from ``lineitem`` joined to ``part`` (see FIXTURES.md section 1). The
derivation is column arithmetic on one equi-join; Catalyst decides the join
strategy from measured sizes (broadcast only below the size threshold, sort-merge
beyond it, AQE skew splitting for a hot part key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speclab.sources.io import scan_table, spread_small_scan

# Fixed values of the derived view (they define the fixture, both engines use them).
BATCH_SOURCES = ["  100%  liquid milk ", "100% powder", "50% liquid milk + 50%   powder"]
SWIRLS = ["SW6", "SW5", "SW9"]
GRADES = ["A+", "A-", "A", "B"]

READINGS_COLUMNS = [
    "row_id", "product", "test_code", "order_no", "batch_source", "method", "swirl",
    "feed_flow", "heat_temp", "heat_temp_2", "discount", "tax_text", "size",
    "line_status", "plant", "unit_cost", "result_int", "result_dbl", "result_flow",
    "result_grade", "result_code", "result_foam",
]


def _pick(index: Column, values: list[str]) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(index == i, F.lit(v)) if expr is None else expr.when(index == i, F.lit(v))
    return expr


def readings_from(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    li = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                         "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                         "l_linestatus", "l_shipdate")
    p = part.select("p_partkey", "p_brand", "p_size", "p_retailprice")
    j = li.join(p, li.l_partkey == p.p_partkey, "inner")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    day = F.date_format(F.col("l_shipdate"), "yyyy-MM-dd")
    row_id = F.md5(F.concat_ws("|", *[c.cast("string") for c in (
        F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"),
        cents)], day))
    tax_pct = F.round(F.col("l_tax") * 100).cast("bigint")
    return j.select(
        row_id.alias("row_id"),
        F.col("p_brand").alias("product"),
        F.col("l_returnflag").alias("test_code"),
        F.col("l_orderkey").alias("order_no"),
        _pick(F.col("l_linenumber") % 3, BATCH_SOURCES).alias("batch_source"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("string"))
         .when(F.col("l_linestatus") == "F", F.lit("Da Vinci"))
         .otherwise(F.lit("Original")).alias("method"),
        _pick(F.col("l_suppkey") % 3, SWIRLS).alias("swirl"),
        F.when(F.col("l_quantity") == 13, F.lit(None).cast("double"))
         .otherwise(F.col("l_quantity")).alias("feed_flow"),
        F.col("l_extendedprice").alias("heat_temp"),
        (F.col("l_extendedprice") * 1.1 + F.col("l_tax")).alias("heat_temp_2"),
        F.col("l_discount").alias("discount"),
        F.when(tax_pct == 3, F.lit("n/a")).otherwise(tax_pct.cast("string")).alias("tax_text"),
        F.col("p_size").alias("size"),
        F.col("l_linestatus").alias("line_status"),
        F.lit("P1").alias("plant"),
        F.col("p_retailprice").alias("unit_cost"),
        F.when(F.col("l_suppkey") % 50 == 0, F.lit("#"))
         .otherwise(F.col("l_linenumber").cast("string")).alias("result_int"),
        (F.lit(0.40) + F.col("l_tax") + F.col("l_discount")).cast("decimal(4,2)")
         .cast("string").alias("result_dbl"),
        F.when((F.col("l_quantity") > 25) & (F.col("l_discount") < 0.08), 1)
         .otherwise(0).alias("result_flow"),
        _pick(F.col("l_orderkey") % 4, GRADES).alias("result_grade"),
        (F.col("l_linenumber") % 4).cast("string").alias("result_code"),
        (F.lit(10) * (F.col("l_suppkey") % 5 + 1)).cast("string").alias("result_foam"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_from(spread_small_scan(scan_table(spark, f"{sf_dir}/lineitem.parquet")),
                         scan_table(spark, f"{sf_dir}/part.parquet"))
