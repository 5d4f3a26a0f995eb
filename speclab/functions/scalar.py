"""Column expressions (S1-S12): all JVM-side, inside whole-stage codegen.

No Python UDF is used; every row-level rule of the reference (dict maps, label
lambdas, coercions) is a Catalyst expression.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code tables of the reference (categorical text -> numeric code).
METHOD_CODES = {"Da Vinci": 0, "Original": 1}
SWIRL_CODES = {"SW6": 0, "SW5": 1}
MILK_SOURCE_CODES = {"100% liquid milk": 0, "100% powder": 1, "50% liquid milk + 50% powder": 2}
RECONSTITUTION_LABELS = {0: 1, 1: 1, 2: 0, 3: 0}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_codes(c, mapping: Mapping) -> Column:
    """Dict lookup; a value that is not listed becomes NULL (no ELSE)."""
    c = _col(c)
    out = None
    for k, v in mapping.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    return out


def normalize_whitespace(c) -> Column:
    """Strip, then every run of whitespace (Unicode-aware, so tab / NBSP too) -> one blank."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def cast_strict(c, to: str = "int") -> Column:
    """Text -> number; dirty text raises under ANSI, like astype."""
    return _col(c).cast(to)


def coerce_numeric(c, to: str = "double") -> Column:
    """Text -> number; dirt becomes NULL (errors='coerce')."""
    return F.expr(f"try_cast({c} as {to})") if isinstance(c, str) else c.try_cast(to)


def label_in_set(c, values: Iterable) -> Column:
    """1 if value in the set else 0 (NULL -> 0)."""
    return F.when(_col(c).isin(list(values)), 1).otherwise(0)


def label_equals(c, value) -> Column:
    """S8."""
    return F.when(_col(c) == F.lit(value), 1).otherwise(0)


def label_in_range(c, lo: float, hi: float) -> Column:
    """Lo <= x <= hi -> 1 else 0."""
    return F.when(_col(c).between(lo, hi), 1).otherwise(0)


def not_sentinel(c, sentinel: str = "#") -> Column:
    """B4 predicate: drop '#', keep NULL (pandas != keeps NaN)."""
    return ~_col(c).eqNullSafe(F.lit(sentinel))


def round2(c, digits: int = 2) -> Column:
    """Round half away from zero on the scaled binary value, i.e.
    ``round(x * 10^d) / 10^d`` - the same arithmetic DuckDB's ``round(x, d)``
    performs, so both engines agree on every tie."""
    scale = float(10 ** digits)
    return F.round(_col(c) * scale, 0) / scale


def null_if_nan(c) -> Column:
    c = _col(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def safe_corr(x, y) -> Column:
    """Pearson r as an aggregate that gives NULL (never an error) on constant input.

    ``F.corr`` raises DIVIDE_BY_ZERO under ANSI on a constant column, so r is
    written as covariance over the product of standard deviations with
    ``try_divide``; both inputs are nulled unless both are present, so it is
    pairwise complete like pandas ``.corr``. Partial-aggregable: one pass.
    """
    x, y = _col(x).cast("double"), _col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    xs = F.when(both, x)
    ys = F.when(both, y)
    return F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))


def abs_col(c) -> Column:
    """S12."""
    return F.abs(_col(c))
