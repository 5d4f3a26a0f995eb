"""Splitting (G1, G2), stratified folds (H11 input), key pairing.

A split is a column, not separate frames: ``split`` in {train, test, val} on one
keyed DataFrame. Rows are ordered by a seeded hash of the row key (md5, the
same in Spark and DuckDB). The exact sklearn sizes (test = ceil(n * f)) are
kept WITHOUT a global sort: the (hash, key) at rank ceil(n * f) is found by counting
rows by leading hash digits, narrowing to a handful of rows, and the split is a
threshold comparison - a narrow, per-row operation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speclab.operators.quantiles import rank_of
from speclab.session import cut_lineage

_HEX = 13                 # 52 bits of md5: exact in a double
_DIGITS = 3               # hex digits looked at in one step: 4,096 counts reach the driver
_FEW = 4096               # rows that may reach the driver to pick the threshold among them


def hash_order(key: str, seed) -> Column:
    """First 52 bits of md5(key || '|' || seed), as 13 hex digits: ordered like the number."""
    return F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), 1, _HEX)


def threshold_at(hashed: DataFrame, h: str, key: str, frac: float) -> tuple[str, str] | None:
    """(hash, key) of the row at rank ceil(n * frac) (1-based) by (hash, key).

    Rows are counted by their next hex digits inside the digits already fixed, so each step
    narrows the range 4,096 times; once at most ``_FEW`` rows are left they are read.
    Rows equal in all digits are told apart by the key the same way. What reaches
    the driver is bounded whatever the size.
    """
    rest = hashed.select(F.concat(F.col(h), F.md5(F.col(key).cast("string"))).alias("_d"), F.col(h).alias("_h"), F.col(key).alias("_k"))
    fixed, k, n = "", None, None
    while True:
        at = len(fixed) + 1
        counts = sorted((r["_p"], r["n"]) for r in rest.where(F.col("_d").startswith(fixed)).groupBy(
            F.substring("_d", at, _DIGITS).alias("_p")).agg(F.count(F.lit(1)).alias("n")).collect())
        if k is None:
            n = sum(c for _, c in counts)
            k = math.ceil(n * frac) - 1
            if n == 0 or k < 0:
                return None
        for p, c in counts:
            if k < c:
                break
            k -= c
        fixed += p
        if c <= _FEW or len(fixed) >= _HEX + 32:
            rows = sorted((r["_d"], r["_h"], r["_k"]) for r in rest.where(F.col("_d").startswith(fixed)).limit(_FEW).collect())
            return rows[min(k, len(rows) - 1)][1:]


def _upto(h: Column, key: str, at: tuple[str, str] | None) -> Column:
    """Whether a row is at or before the threshold row: a narrow comparison, no join, no sort."""
    if at is None:
        return F.lit(False)
    own, limit = F.md5(F.col(key).cast("string")), F.md5(F.lit(at[1]).cast("string"))
    return (h < F.lit(at[0])) | ((h == F.lit(at[0])) & (own <= limit))


def split_80_20(df: DataFrame, key: str = "row_id", seed: int = 42, test_frac: float = 0.2,
                names=("train", "val")) -> DataFrame:
    """G1: shuffle split, not stratified; the held-out part has ceil(n * 0.2) rows.

    The input is read twice: once for the written (key, hash) table, once for the result.
    """
    h = hash_order(key, seed)
    at = threshold_at(cut_lineage(df.select(key, h.alias("_h1"))), "_h1", key, test_frac)
    return df.withColumn("split", F.when(_upto(h, key, at), F.lit(names[1])).otherwise(F.lit(names[0])))


def split_70_15_15(df: DataFrame, key: str = "row_id", seed: int = 42, temp_frac: float = 0.3,
                   val_frac: float = 0.5) -> DataFrame:
    """70 / 30, then the 30 in halves (validation = ceil(half)); input reads as in G1."""
    h1, h2 = hash_order(key, seed), hash_order(key, f"{seed}|b")
    hashed = cut_lineage(df.select(key, h1.alias("_h1"), h2.alias("_h2")))
    t1 = threshold_at(hashed, "_h1", key, temp_frac)
    t2 = threshold_at(hashed.where(_upto(F.col("_h1"), key, t1)), "_h2", key, val_frac)
    return df.withColumn("split", F.when(~_upto(h1, key, t1), F.lit("train"))
                                   .when(_upto(h2, key, t2), F.lit("val")).otherwise(F.lit("test")))


def stratified_folds(df: DataFrame, label: str = "label", key: str = "row_id", k: int = 10,
                     seed: int = 123) -> DataFrame:
    """Fold id in [0, k) balanced per class: rank within class by (hash, key), modulo k.

    The rank comes from range totals, so no class is ranked inside one task.
    """
    base = df.withColumn("_h", hash_order(key, seed))
    return (rank_of(base, [label], "_h", tie=key)
            .withColumn("fold", (F.col("_rank") % k).cast("int"))
            .drop("_h", "_rank"))


def pair_features_labels(x: DataFrame, y: DataFrame, key: str = "row_id") -> DataFrame:
    """X and y matched by key (never by position)."""
    return x.join(y, key, "inner")
