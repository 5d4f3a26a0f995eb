"""Exact order statistics without putting a whole group in one task.

Spark's ``median`` / ``percentile`` / ``mode`` aggregates keep every distinct
value of a group in one buffer, and a window ``partitionBy(group)`` sends a
whole group to one task; with few groups (variables x labels) over 100 TB either
one is a straggler or an OOM. Here:

1. ``value_counts_by`` = ``groupBy(keys, value).count()``: map-side partial
   aggregation first, so a hot key or value is collapsed before the shuffle.
2. The counts are dealt into value ranges by Spark's range partitioner on (keys,
   value): its boundaries follow the data, so readings in a narrow band, or a hot
   key, spread over as many ranges as their rows ask for. The range number is
   written with the rows (one evaluation, so a lost executor cannot number them
   differently). Per-(key, range) totals are a small frame - one row a range -
   and a running sum over it gives each range's starting rank.
3. Only the ranges that hold a wanted rank are opened: their rows are ranked
   with a window partitioned by (key, range).
4. All joins are between a big side and a small derived table; Catalyst / AQE
   broadcast the small side only once it is measured small.

Quantiles use linear interpolation between closest ranks (numpy / pandas
"linear", DuckDB ``quantile_cont``, Spark ``percentile``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from speclab.session import cut_lineage


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], ranges: int | None = None) -> DataFrame:
    """``df`` with ``_b``: the number of the value range of each row, ascending by ``order`` inside
    a key. ``order`` must tell any two rows of a key apart for the ranges to be even."""
    spark = df.sparkSession
    n = ranges or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return cut_lineage(df.repartitionByRange(n, *keys, *order).withColumn("_b", F.spark_partition_id()))


def value_counts_by(df: DataFrame, keys: Sequence[str], value: str, count_col: str = "cnt") -> DataFrame:
    """(keys, value, cnt) for non-null values: the one shuffle of the raw data."""
    return (df.where(F.col(value).isNotNull())
              .groupBy(*keys, value)
              .agg(F.count(F.lit(1)).alias(count_col)))


def _range_offsets(vc: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and starting rank of every (key, range), and the key's size."""
    bt = vc.groupBy(*keys, "_b").agg(F.sum("cnt").alias("_bcnt"))
    w = Window.partitionBy(*keys).orderBy("_b")
    return bt.select(*keys, "_b", "_bcnt",
                     F.coalesce(F.sum("_bcnt").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                F.lit(0)).alias("_boff"),
                     F.sum("_bcnt").over(Window.partitionBy(*keys)).alias("n"))


def rank_of(df: DataFrame, keys: Sequence[str], value: str, tie: str, ranges: int | None = None) -> DataFrame:
    """Every row plus ``_rank``: its 0-based position by (value, tie) inside its key."""
    keys = list(keys)
    rows = ranged(df, keys, [value, tie], ranges)
    offs = _range_offsets(rows.withColumn("cnt", F.lit(1).cast("long")), keys).select(*keys, "_b", "_boff")
    w = Window.partitionBy(*keys, "_b").orderBy(value, tie)
    return (rows.join(offs, keys + ["_b"])
                .withColumn("_rank", F.col("_boff") + F.row_number().over(w) - 1)
                .drop("_b", "_boff"))


def average_ranks(vc: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, rank, n) from value counts: the rank, from 1, that equal values of a key share, and the key's rows."""
    keys = list(keys)
    vc = ranged(vc, keys, [value]) if "_b" not in vc.columns else vc
    below = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (vc.join(_range_offsets(vc, keys).select(*keys, "_b", "_boff", "n"), keys + ["_b"])
              .select(*keys, value, (F.col("_boff") + F.coalesce(F.sum("cnt").over(below), F.lit(0)) + (F.col("cnt") + 1) / 2).alias("rank"), "n"))


def exact_quantiles(df: DataFrame | None, keys: Sequence[str], value: str, probs: Sequence[float],
                    vc: DataFrame | None = None) -> DataFrame:
    """(keys, prob, quantile) with linear interpolation; exact, distributed.

    The wanted ranks are computed row-wise on the small range-offset table
    (it carries the group size), which also says which ranges to open; the
    value counts are joined to those few ranges only and ranked inside them.
    """
    keys = list(keys)
    if vc is None:
        vc = value_counts_by(df, keys, value)
    vc = ranged(vc, keys, [value]) if "_b" not in vc.columns else vc
    offs = _range_offsets(vc, keys)
    pos = (F.col("n") - 1) * F.col("prob")
    in_b = lambda r: (F.col("_boff") <= r) & (r < F.col("_boff") + F.col("_bcnt"))
    tb = (offs.select(*keys, "_b", "_boff", "_bcnt", "n",
                      F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
              .select(*keys, "_b", "_boff", "_bcnt", "prob", F.floor(pos).cast("long").alias("r_lo"),
                      F.ceil(pos).cast("long").alias("r_hi"), (pos - F.floor(pos)).alias("frac"))
              .where(in_b(F.col("r_lo")) | in_b(F.col("r_hi")))
              .drop("_bcnt"))
    cand = vc.join(tb, keys + ["_b"])
    w = Window.partitionBy(*keys, "prob", "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    r0 = F.col("_boff") + F.coalesce(F.sum("cnt").over(w), F.lit(0))
    ranked = cand.withColumn("_r0", r0)
    hit = lambda r: (F.col("_r0") <= r) & (r < F.col("_r0") + F.col("cnt"))
    out = (ranked.groupBy(*keys, "prob")
                 .agg(F.max(F.when(hit(F.col("r_lo")), F.col(value))).alias("_vlo"),
                      F.max(F.when(hit(F.col("r_hi")), F.col(value))).alias("_vhi"),
                      F.max("frac").alias("_frac")))
    return out.select(*keys, "prob",
                      (F.col("_vlo") + F.col("_frac") * (F.col("_vhi") - F.col("_vlo"))).alias("quantile"))


def quantiles_wide(df: DataFrame | None, keys: Sequence[str], value: str, probs: dict[str, float],
                   vc: DataFrame | None = None) -> DataFrame:
    """One row per key with one column per named probability."""
    q = exact_quantiles(df, keys, value, list(probs.values()), vc=vc)
    aggs = [F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("quantile"))).alias(name)
            for name, p in probs.items()]
    return q.groupBy(*keys).agg(*aggs)


def mode_from_counts(vc: DataFrame, keys: Sequence[str], value: str, count_col: str = "cnt") -> DataFrame:
    """Most frequent value per key, smallest value on ties (pandas ``mode().iloc[0]``).

    ``min(struct(-cnt, value))`` is an ordinary partial aggregate: no group is
    ever held whole.
    """
    best = F.min(F.struct((-F.col(count_col)).alias("nc"), F.col(value).alias("v")))
    return vc.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.v").alias("mode"))
