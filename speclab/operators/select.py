"""Feature selection (M1-M7, F1).

The data-sized work (correlations, contingency counts, distinct counts) runs as
single-pass partial aggregates. Only k- or k*k-row results reach the driver,
where the reference's greedy walks (M3, M6) choose which columns to drop.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speclab.functions.scalar import coerce_numeric, safe_corr
from speclab.operators import gram
from speclab.operators.profile import distinct_counts, first_distinct
from speclab.session import cut_lineage

# The reference's thresholds.
CATEGORY_MAX_DISTINCT = 5   # fewer than this many distinct values -> category
CORR_THRESHOLD = 0.8
TARGET_CORR_THRESHOLD = 0.03
CHI2_ALPHA = 0.05
JVM_PAIRS = 400            # pairs of one JVM aggregate


# ---------------------------------------------------------------- M7

def infer_column_kind(df: DataFrame, columns: Sequence[str] | None = None,
                      max_distinct: int = CATEGORY_MAX_DISTINCT) -> DataFrame:
    """M7: (column_name, n_distinct, kind): fewer than 5 distinct -> category, else numeric."""
    dc = distinct_counts(df, columns)
    return dc.withColumn("kind", F.when(F.col("n_distinct") < max_distinct, "category").otherwise("numeric"))


def apply_kinds(df: DataFrame, kinds: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Coerce the numeric-kind columns to double (dirt -> NULL); others untouched."""
    out = []
    for c in df.columns:
        if c not in keep and kinds.get(c) == "numeric":
            out.append(coerce_numeric(F.col(c).cast("string") if df.schema[c].dataType == T.BooleanType()
                                      else F.col(c)).cast("double").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def kinds_of(df: DataFrame, columns: Sequence[str] | None = None,
             max_distinct: int = CATEGORY_MAX_DISTINCT) -> dict[str, str]:
    """M7 as the pipelines use it: a column with fewer than ``max_distinct`` values found by that
    many least-value passes (exact, no shuffle) is a category."""
    cols = list(columns or df.columns)
    found = first_distinct(df, cols, max_distinct)
    return {c: "category" if len(found[c]) < max_distinct else "numeric" for c in cols}


# ---------------------------------------------------------------- M1 / M2

def correlation_matrix(df: DataFrame, columns: Sequence[str], full: bool = True) -> DataFrame:
    """M1: pairwise-complete Pearson r for every pair, one scan whatever the number of columns.

    Up to ``JVM_PAIRS`` pairs are one aggregate of the JVM; more would outgrow its generated code and go
    through ``gram.pair_sums``. Long form (col_a, col_b, pos_a, pos_b, r); with ``full`` both triangles and
    the diagonal (1 for a non-constant column, NULL for a constant one). NaN is missing.
    """
    cols = list(columns)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    if len(pairs) > JVM_PAIRS:
        return gram.named(gram.correlation_of(gram.pair_sums(df, cols)[0]), cols, full)
    x = gram.doubles(df, cols)
    wide = x.agg(*[(F.when(F.stddev_pop(f"v{i}") > 0, F.lit(1.0)) if i == j else safe_corr(f"v{i}", f"v{j}")).alias(f"r_{i}_{j}") for i, j in pairs])
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("pos_a"), F.lit(j).alias("pos_b"), F.col(f"r_{i}_{j}").alias("r")) for i, j in pairs]))
    return gram.named(wide.select(cells.alias("p")).select("p.*"), cols, full)


def correlated_pairs(df: DataFrame, columns: Sequence[str], threshold: float = CORR_THRESHOLD) -> DataFrame:
    """M2: upper-triangle pairs with |r| > threshold."""
    m = correlation_matrix(df, columns, full=False)
    return m.where(F.abs("r") > threshold).select("col_a", "col_b", "pos_a", "pos_b", "r")


def greedy_correlated_drop(pairs: list[tuple[int, int, float]], columns: Sequence[str],
                           threshold: float = CORR_THRESHOLD) -> list[tuple[str, str, float]]:
    """M3 walk on the (small) pair list: each column in order, dropped ones
    included, drops the FIRST later column with |r| > t not dropped yet."""
    cols = list(columns)
    by_anchor: dict[int, list[tuple[int, float]]] = {}
    for a, b, r in pairs:
        if r is not None and not math.isnan(r) and abs(r) > threshold and a < b:
            by_anchor.setdefault(a, []).append((b, r))
    dropped: list[str] = []
    out = []
    for a in range(len(cols)):
        for b, r in sorted(by_anchor.get(a, [])):
            if cols[b] not in dropped:
                dropped.append(cols[b])
                out.append((cols[a], cols[b], abs(r)))
                break
    return out


def remove_highly_correlated_features(df: DataFrame, columns: Sequence[str],
                                      threshold: float = CORR_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """M3: returns (df without the dropped columns, report(anchor, dropped, abs_r))."""
    pairs = [(r["pos_a"], r["pos_b"], r["r"])
             for r in correlated_pairs(df, columns, threshold).collect()]
    walk = greedy_correlated_drop(pairs, columns, threshold)
    report = df.sparkSession.createDataFrame(walk, "anchor string, dropped string, abs_r double")
    return df.drop(*[d for _, d, _ in walk]), report


# ---------------------------------------------------------------- M4 / F1

def target_correlation(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """(column_name, r) of every feature with the label (label itself included, r = 1)."""
    cols = [c for c in features if c != label] + [label]
    wide = df.agg(*[safe_corr(c, label).alias(f"r{i}") for i, c in enumerate(cols)])
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"r{i}").alias("r"))
                                for i, c in enumerate(cols)]))
    return wide.select(stack.alias("p")).select("p.*")


def target_correlation_ranked(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """correlation with the label, descending (NULL last)."""
    return target_correlation(df, features, label).orderBy(F.desc_nulls_last("r"))


def low_target_correlation(df: DataFrame, features: Sequence[str], label: str = "label",
                           threshold: float = TARGET_CORR_THRESHOLD) -> DataFrame:
    """M4 report: (column_name, r, dropped); -t < r < t is dropped, NULL r is kept."""
    tc = target_correlation(df, features, label)
    return tc.withColumn("dropped", F.coalesce((F.col("r") > -threshold) & (F.col("r") < threshold),
                                               F.lit(False)))


def drop_low_target_correlation(df: DataFrame, features: Sequence[str], label: str = "label",
                                threshold: float = TARGET_CORR_THRESHOLD) -> tuple[DataFrame, list[str]]:
    rep = low_target_correlation(df, features, label, threshold).where("dropped").collect()
    drop = [r["column_name"] for r in rep]
    return df.drop(*drop), drop


# ---------------------------------------------------------------- M5 / M6

def _chi2_sf(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution (closed forms for integer dof)."""
    if dof <= 0 or x is None or math.isnan(x):
        return float("nan") if dof > 0 else 1.0
    if x <= 0:
        return 1.0
    h = x / 2.0
    # sums of Poisson-like terms, each from its logarithm: no overflow at any dof
    if dof % 2 == 0:
        return min(1.0, sum(math.exp(-h + i * math.log(h) - math.lgamma(i + 1)) for i in range(dof // 2)))
    return min(1.0, math.erfc(math.sqrt(h)) + sum(
        math.exp(-h + (i - 0.5) * math.log(h) - math.lgamma(i + 0.5)) for i in range(1, (dof + 1) // 2)))


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(stat: pd.Series, dof: pd.Series) -> pd.Series:
    """Vectorised over the small k*k result only."""
    return pd.Series([_chi2_sf(float(s), int(d)) if s is not None and not np.isnan(s) else np.nan
                      for s, d in zip(stat, dof)])


def chi2_pairwise(df: DataFrame, columns: Sequence[str], correction: bool = True,
                  with_p: bool = True) -> DataFrame:
    """M5: chi-square independence statistic, dof (and p) for every unordered pair.

    One pass: every row emits (pair, a, b) for the k(k-1)/2 pairs, counted with a
    partial aggregate (the output is at most pairs x cells). The counts are written
    once; margins and the statistic come from that small table, from observed cells
    alone except for 2 x 2 tables. Yates' correction (|O - E| reduced by up to 0.5) when dof = 1,
    as scipy's default does.
    """
    cols = list(columns)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if not pairs:
        schema = "col_a string, col_b string, statistic double, dof long" + (", p_value double" if with_p else "")
        return df.sparkSession.createDataFrame([], schema)
    txt = {c: F.col(c).cast("string") for c in cols}
    items = F.explode(F.array(*[F.struct(F.lit(i).alias("pa"), F.lit(j).alias("pb"),
                                         txt[cols[i]].alias("a"), txt[cols[j]].alias("b"))
                                for i, j in pairs]))
    obs = cut_lineage(df.select(items.alias("x")).select("x.*")
                      .where(F.col("a").isNotNull() & F.col("b").isNotNull())
                      .groupBy("pa", "pb", "a", "b").agg(F.count(F.lit(1)).alias("o")))
    rows = obs.groupBy("pa", "pb", "a").agg(F.sum("o").alias("ra"))
    colm = obs.groupBy("pa", "pb", "b").agg(F.sum("o").alias("cb"))
    tot = obs.groupBy("pa", "pb").agg(F.sum("o").alias("n"), F.countDistinct("a").alias("nr"),
                                      F.countDistinct("b").alias("nc"))
    tot = tot.withColumn("dof", (F.col("nr") - 1) * (F.col("nc") - 1))
    # observed cells alone give the statistic: sum (o - e)^2 / e = n (sum o^2 / (r c) - 1)
    cells = obs.join(rows, ["pa", "pb", "a"]).join(colm, ["pa", "pb", "b"])
    plain = (cells.groupBy("pa", "pb").agg(F.sum(F.col("o").cast("double") * F.col("o") / (F.col("ra").cast("double") * F.col("cb"))).alias("_s"))
                  .join(tot, ["pa", "pb"]).select("pa", "pb", (F.col("n") * (F.col("_s") - 1.0)).alias("statistic"), "dof"))
    # the corrected statistic of a 2 x 2 table needs all of its four cells
    two = tot.where(F.col("dof") == 1)
    grid = (rows.join(two, ["pa", "pb"]).join(colm, ["pa", "pb"])
                .join(obs, ["pa", "pb", "a", "b"], "left")
                .withColumn("o", F.coalesce("o", F.lit(0)))
                .withColumn("e", F.col("ra").cast("double") * F.col("cb") / F.col("n")))
    diff = F.col("e") - F.col("o")
    adj = F.col("o") + F.signum(diff) * F.least(F.lit(0.5), F.abs(diff))
    yates = grid.groupBy("pa", "pb").agg(F.sum((adj - F.col("e")) ** 2 / F.col("e")).alias("_yates"))
    stat = plain.join(yates, ["pa", "pb"], "left") if correction else plain.withColumn("_yates", F.lit(None).cast("double"))
    stat = stat.select("pa", "pb", F.when(F.col("dof") == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.coalesce("_yates", "statistic"))).alias("statistic"), F.col("dof").cast("long").alias("dof"))
    names = F.array(*[F.lit(c) for c in cols])
    out = stat.select(F.element_at(names, F.col("pa") + 1).alias("col_a"),
                      F.element_at(names, F.col("pb") + 1).alias("col_b"), "statistic", "dof")
    if with_p:
        out = out.withColumn("p_value", F.when(F.col("dof") == 0, F.lit(1.0))
                                         .otherwise(chi2_pvalue("statistic", "dof")))
    return out


def associated_drop_walk(results: list[tuple[str, str, float]], columns: Sequence[str],
                         alpha: float = CHI2_ALPHA) -> list[str]:
    """M6 walk: ordered pairs (a, b), a != b, in column order; when p < alpha
    and neither was removed, remove b."""
    p = {}
    for a, b, pv in results:
        p[(a, b)] = pv
        p[(b, a)] = pv
    removed: list[str] = []
    for a in columns:
        for b in columns:
            if a == b:
                continue
            pv = p.get((a, b))
            if pv is not None and not math.isnan(pv) and pv < alpha and a not in removed and b not in removed:
                removed.append(b)
    return removed


def drop_associated_categoricals(df: DataFrame, columns: Sequence[str],
                                 alpha: float = CHI2_ALPHA) -> tuple[DataFrame, DataFrame]:
    """M6: returns (df without removed columns, report(column_name))."""
    res = [(r["col_a"], r["col_b"], r["p_value"]) for r in chi2_pairwise(df, columns).collect()]
    removed = associated_drop_walk(res, columns, alpha)
    rep = df.sparkSession.createDataFrame([(c,) for c in removed], "column_name string")
    return df.drop(*removed), rep
