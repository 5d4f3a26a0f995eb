"""Projections, filters and row cleaning.

All narrow transformations: no shuffle, filters and projections are pushed into
the parquet scan by Catalyst.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speclab.functions.scalar import not_sentinel


def filter_product_test(df: DataFrame, product: str | None, tests: Iterable[str],
                        product_col: str = "product", test_col: str = "test_code") -> DataFrame:
    """B1: WHERE product = ? AND test IN (...); product None keeps every product."""
    cond = F.col(test_col).isin(list(tests))
    if product is not None:
        cond = (F.col(product_col) == F.lit(product)) & cond
    return df.where(cond)


def _check_names(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")


def drop_columns(df: DataFrame, names: Sequence[str], strict: bool = True) -> DataFrame:
    """Drop a named list; like pandas, an absent name is an error when strict."""
    if strict:
        _check_names(df, names)
    return df.drop(*names)


def drop_sentinel_rows(df: DataFrame, col: str, sentinel: str = "#") -> DataFrame:
    """Remove rows equal to the sentinel, keep NULL rows."""
    return df.where(not_sentinel(col, sentinel))


def _null_or_nan(df: DataFrame, c: str):
    dt = df.schema[c].dataType
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.col(c).isNull() | F.isnan(F.col(c))
    return F.col(c).isNull()


def dropna_subset(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop rows NULL (or NaN) in any of the listed columns."""
    _check_names(df, subset)
    return df.na.drop(how="any", subset=list(subset))


def dropna_any(df: DataFrame) -> DataFrame:
    """Drop rows with any NULL / NaN.

    Only columns the schema marks nullable can hold NULL, so only those are
    tested (same result); a derived non-null column such as the md5 row key is
    then not computed just for the test, and column pruning still applies."""
    nullable = [f.name for f in df.schema.fields if f.nullable or isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.na.drop(how="any", subset=nullable) if nullable else df


def unmapped_rows(df: DataFrame, code_col: str) -> DataFrame:
    """Rows whose mapped code is NULL (audit)."""
    return df.where(F.col(code_col).isNull())


def split_features_label(df: DataFrame, label: str, key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """X and y as two projections that keep the row key on both sides."""
    x = df.drop(label)
    y = df.select(key, label)
    return x, y


def select_by_kind(df: DataFrame, kinds: dict[str, str], wanted: Iterable[str] = ("category",),
                   key: str | None = "row_id") -> DataFrame:
    """Choose columns by kind metadata (category / numeric) or Spark type name."""
    wanted = set(wanted)
    types = dict(df.dtypes)
    cols = [c for c in df.columns if c != key and (kinds.get(c) in wanted or types[c] in wanted)]
    return df.select(*(([key] if key and key in df.columns else []) + cols))


def select_features_except(df: DataFrame, features: Sequence[str], exclude: Iterable[str]) -> DataFrame:
    """Feature list minus named columns."""
    ex = set(exclude)
    return df.select(*[c for c in features if c not in ex])


def preview_rows(df: DataFrame, n: int = 5, order_by: str = "row_id") -> DataFrame:
    """head(n) made deterministic by an order (a top-n: limit is the feature)."""
    return df.orderBy(order_by).limit(n)
