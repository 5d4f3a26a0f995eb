"""Profiling aggregates (D1-D18), shares.

Shape of every operator: at most one shuffle of the raw rows, and it is always
pre-aggregated map-side (partial hash aggregation). Wide-to-long goes through
``DataFrame.unpivot`` so every variable of a group is profiled in the same
shuffle, instead of a Python loop of one job per column. Shares use a
``Window.partitionBy(group)`` only over already aggregated, small frames, and a
scalar subquery for grand totals (no cross join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from speclab.functions.scalar import coerce_numeric, round2
from speclab.operators.quantiles import mode_from_counts, quantiles_wide, ranged, value_counts_by

FLOATS = (T.DoubleType, T.FloatType)


def _is_float(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, FLOATS)


def _null_test(df: DataFrame, c: str):
    return (F.col(c).isNull() | F.isnan(F.col(c))) if _is_float(df, c) else F.col(c).isNull()


def _nan_to_null(df: DataFrame, c: str):
    return F.when(~F.isnan(F.col(c)), F.col(c)) if _is_float(df, c) else F.col(c)


def _names_frame(spark, names: Sequence[str], col: str = "variable") -> DataFrame:
    """Small frame of column names (metadata, k rows) with their position."""
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"{col} string, pos int")


def _total(df: DataFrame, col: str = "n"):
    """Grand total as a scalar subquery: evaluated once, no cross join."""
    return df.agg(F.sum(col)).scalar()


# ---------------------------------------------------------------- D1 / D16 / D17

def null_counts(df: DataFrame, columns: Sequence[str] | None = None, keep_zero: bool = False) -> DataFrame:
    """NULL (and NaN) count per column in ONE aggregate pass; keep those > 0."""
    cols = list(columns or df.columns)
    wide = df.agg(*[F.count_if(_null_test(df, c)).alias(c) for c in cols])
    long = wide.unpivot([], cols, "column_name", "null_count")
    return long if keep_zero else long.where(F.col("null_count") > 0)


def dataset_profile(df: DataFrame) -> DataFrame:
    """D16 (``info()``): column, type, non-null count, rows; one aggregate pass."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__rows"),
                  *[F.count_if(~_null_test(df, c)).alias(c) for c in cols])
    long = wide.unpivot(["__rows"], cols, "column_name", "non_null")
    types = df.sparkSession.createDataFrame(
        [(c, t, i) for i, (c, t) in enumerate(df.dtypes)], "column_name string, dtype string, pos int")
    return (long.join(types, "column_name")
                .select("pos", "column_name", "dtype", "non_null", F.col("__rows").alias("rows")))


def dataset_shape(df: DataFrame) -> DataFrame:
    """Rows x columns."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("long"))


# ---------------------------------------------------------------- D2 / D3 / D4

def _as_text_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value) with NaN treated as missing, values as text (one zero)."""
    proj = df.select(*[(_nan_to_null(df, c) + F.lit(0).cast(df.schema[c].dataType) if _is_float(df, c) else F.col(c)).cast("string").alias(c)
                       for c in cols])
    return proj.unpivot([], list(cols), "column_name", "value")


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Non-null distinct count per column, NaN not counted (pandas ``nunique``).

    One scan: (column, value as text) pairs are reduced by a partial aggregate before the shuffle, so a value
    shared by a third of the rows collapses map-side, and the distinct pairs are counted by column.
    """
    cols = list(columns or df.columns)
    pairs = _as_text_long(df, cols).where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.lit(1).alias("_one"))
    found = pairs.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    return (_names_frame(df.sparkSession, cols, "column_name").join(found, "column_name", "left")
            .select("column_name", F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct")))


def first_distinct(df: DataFrame, columns: Sequence[str], k: int) -> dict[str, list]:
    """Up to ``k`` smallest distinct non-null values of each column, by ``k`` narrow aggregates.

    Each pass asks every unfinished column for its least value above the last one: a
    partial aggregate of one row a task, no shuffle of values, exact at any cardinality.
    """
    found: dict[str, list] = {c: [] for c in columns}
    open_ = list(columns)
    for _ in range(k):
        if not open_:
            break
        aggs = []
        for i, c in enumerate(open_):
            v = _nan_to_null(df, c)
            aggs.append(F.min(F.when(v > F.lit(found[c][-1]).cast(df.schema[c].dataType), v) if found[c] else v).alias(f"_m{i}"))
        row = df.agg(*aggs).first()
        least = {c: row[f"_m{i}"] for i, c in enumerate(open_)}
        open_ = [c for c in open_ if least[c] is not None]
        for c in open_:
            found[c].append(least[c])
    return found


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """D3: columns with exactly one distinct non-null value, and that value (as text).

    One aggregate: a column is constant when its least and greatest value agree. No row is shuffled."""
    cols = list(columns or df.columns)
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, value string")
    wide = df.agg(*[f(_nan_to_null(df, c)).alias(f"_{n}{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))])
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.when(F.col(f"_lo{i}") == F.col(f"_hi{i}"), F.col(f"_lo{i}"))
                                         .cast("string").alias("value")) for i, c in enumerate(cols)]))
    return wide.select(stack.alias("p")).select("p.*").where(F.col("value").isNotNull())


def drop_constant_columns(df: DataFrame, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Drop the D3 columns. Only k-row results reach the driver; dropping columns
    cannot make another column constant, so one pass suffices."""
    cand = [c for c in df.columns if c not in set(keep)]
    found = [r["column_name"] for r in constant_columns(df, cand).collect()] if cand else []
    drop = [c for c in df.columns if c in set(found) and c not in set(keep)]
    return df.drop(*drop), drop


# ---------------------------------------------------------------- D5-D8, E1, E2

def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency of each value, NULL ignored, descending."""
    return (df.where(_null_test(df, col) == F.lit(False))
              .groupBy(col).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), F.asc(col)))


def share_of_total(counts: DataFrame, n: str = "n", digits: int = 1, name: str = "pct_total") -> DataFrame:
    """N / total * 100 over an aggregated frame (total via scalar subquery)."""
    return counts.withColumn(name, round2(F.col(n) * 100.0 / _total(counts, n), digits))


def share_within_group(counts: DataFrame, group: str, n: str = "n", digits: int = 2,
                       name: str = "pct_within") -> DataFrame:
    """N / sum(n) over its group * 100, window over the aggregated frame."""
    return counts.withColumn(name, round2(F.col(n) * 100.0 / F.sum(n).over(Window.partitionBy(group)), digits))


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Count per label and percent of the total (1 dp)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return share_of_total(counts, "n", 1, "pct")


def group_label_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Count per (a, b); groups with a NULL key are dropped (pandas groupby)."""
    return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
              .groupBy(a, b).agg(F.count(F.lit(1)).alias("n")))


def categorical_summary(df: DataFrame, c1: str, c2: str) -> DataFrame:
    """Count per (c1, c2), percent within c1 (2 dp) and of the grand total (1 dp)."""
    counts = group_label_counts(df, c1, c2)
    return share_of_total(share_within_group(counts, c1, "n", 2, "pct_within"), "n", 1, "pct_total")


def contingency_table(df: DataFrame, a: str, b: str, wide: bool = False) -> DataFrame:
    """``pd.crosstab`` - long (a, b, n) or wide (pivot on b, zero filled)."""
    long = group_label_counts(df, a, b)
    if not wide:
        return long
    return long.groupBy(a).pivot(b).agg(F.first("n")).na.fill(0)


# ---------------------------------------------------------------- D9

def unique_values_long(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """D9 long form: (variable, value, n, n_unique) - value counts of every variable
    in one shuffle; NULL values are listed with n = count of NULLs (``unique()``
    lists NaN) but are not counted in n_unique (``nunique``)."""
    long = _as_text_long(df, variables).withColumnRenamed("column_name", "variable")
    vc = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    nu = vc.groupBy("variable").agg(F.count("value").alias("n_unique"))
    return vc.join(nu, "variable")


def unique_values_table(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """D9 as the reference shows it: per variable unique count, value list and
    value -> count map (NULL kept in the list, left out of the map). A display of
    categorical variables: a variable's values become one row, so use
    ``unique_values_long`` where a variable may have many."""
    lv = unique_values_long(df, variables)
    out = (lv.groupBy("variable")
             .agg(F.max("n_unique").alias("unique_count"),
                  F.sort_array(F.collect_list(F.col("value"))).alias("_vals"),
                  F.max(F.col("value").isNull().cast("int")).alias("_has_null"),
                  F.map_from_entries(F.collect_list(
                      F.when(F.col("value").isNotNull(), F.struct("value", "n")))).alias("value_counts")))
    vals = F.when(F.col("_has_null") == 1, F.concat("_vals", F.array(F.lit(None).cast("string")))) \
        .otherwise(F.col("_vals"))
    return out.select("variable", "unique_count", vals.alias("unique_values"), "value_counts")


# ---------------------------------------------------------------- D10-D13

def melt_features(df: DataFrame, id_vars: Sequence[str], variables: Sequence[str],
                  var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """Wide -> long with numeric coercion (dirty text -> NULL, NaN -> NULL)."""
    def num(c):
        if isinstance(df.schema[c].dataType, (T.StringType, T.BooleanType)):
            v = coerce_numeric(F.col(c).cast("string"))
            return F.when(~F.isnan(v), v)          # the text "nan" is missing too
        return F.when(~F.isnan(F.col(c)), F.col(c)) if _is_float(df, c) else coerce_numeric(F.col(c))
    proj = df.select(*id_vars, *[num(c).cast("double").alias(c) for c in variables])
    return proj.unpivot(list(id_vars), list(variables), var_name, value_name)


def _moments(vc: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """n, min, max, mean, sample var from value counts: two passes over the
    (already reduced) counts so the variance is computed around the mean."""
    first = vc.groupBy(*keys).agg(
        F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("unique_count"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        (F.sum(F.col(value) * F.col("cnt")) / F.sum("cnt")).alias("mean"))
    ss = (vc.join(first.select(*keys, "mean"), list(keys))
            .groupBy(*keys)
            .agg(F.sum(F.col("cnt") * (F.col(value) - F.col("mean")) ** 2).alias("ss")))
    return (first.join(ss, list(keys))
                 .withColumn("var", F.try_divide(F.col("ss"), (F.col("n") - 1).cast("double")))
                 .withColumn("var", F.when(F.col("n") > 1, F.col("var")))
                 .withColumn("sd", F.sqrt("var"))
                 .drop("ss"))


def label_value_counts(df: DataFrame, id_var: str, variables: Sequence[str]) -> DataFrame:
    """(id_var, variable, value, cnt) of every variable, dealt into value ranges and written: the one
    pass that the statistics, grouped statistics, box plot and class tables of a report share."""
    long = melt_features(df, [id_var], variables)
    keys = [id_var, "variable"]
    return ranged(value_counts_by(long, keys, "value"), keys, ["value"])


def numeric_statistics(df: DataFrame | None, variables: Sequence[str], digits: int | None = 2,
                       counts: DataFrame | None = None) -> DataFrame:
    """Per variable Unique_Count, Min, Max, Mean, Median, Mode, SD, Var (2 dp).

    One unpivot, one pre-aggregated shuffle into value counts; moments, mode and
    median are all derived from those counts. Variables that coerce to all-NULL
    keep their row (unique_count 0, NULL stats), as pandas prints them. ``counts``: a
    ``label_value_counts`` table to derive everything from instead of reading ``df``.
    """
    if counts is None:
        vc = value_counts_by(melt_features(df, [], variables), ["variable"], "value")
    else:
        vc = counts.groupBy("variable", "value").agg(F.sum("cnt").alias("cnt"))
    vc = ranged(vc, ["variable"], ["value"])
    mom = _moments(vc, ["variable"])
    med = quantiles_wide(None, ["variable"], "value", {"median": 0.5}, vc=vc)
    mode = mode_from_counts(vc, ["variable"], "value")
    names = _names_frame(vc.sparkSession, variables)
    out = (names.join(mom, "variable", "left").join(med, "variable", "left").join(mode, "variable", "left"))
    r = (lambda c: round2(c, digits)) if digits is not None else (lambda c: c)
    return out.select(
        "variable",
        F.coalesce("unique_count", F.lit(0)).cast("long").alias("unique_count"),
        r(F.col("min")).alias("min"), r(F.col("max")).alias("max"), r(F.col("mean")).alias("mean"),
        r(F.col("median")).alias("median"), r(F.col("mode")).alias("mode"),
        r(F.col("sd")).alias("sd"), r(F.col("var")).alias("var"))


def grouped_statistics(df: DataFrame | None, id_var: str, variables: Sequence[str], digits: int | None = 2,
                       counts: DataFrame | None = None) -> DataFrame:
    """Melt, coerce, drop NULL, then min / max / mean / median by (id_var, variable)."""
    keys = [id_var, "variable"]
    vc = (counts if counts is not None else label_value_counts(df, id_var, variables)).where(F.col(id_var).isNotNull())
    stats = vc.groupBy(*keys).agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        (F.sum(F.col("value") * F.col("cnt")) / F.sum("cnt")).alias("mean_value"))
    med = quantiles_wide(None, keys, "value", {"median_value": 0.5}, vc=vc)
    out = stats.join(med, keys)
    r = (lambda c: round2(c, digits)) if digits is not None else (lambda c: c)
    return out.select(*keys, *[r(F.col(c)).alias(c) for c in
                               ("min_value", "max_value", "mean_value", "median_value")])


def boxplot_summary(df: DataFrame, id_var: str, variables: Sequence[str], whisker: float = 1.5,
                    digits: int | None = 6, counts: DataFrame | None = None) -> DataFrame:
    """What a box plot draws per (id_var, variable): quartiles, IQR fences,
    whiskers (most extreme points inside the fences) and the outlier count."""
    keys = [id_var, "variable"]
    vc = (counts if counts is not None else label_value_counts(df, id_var, variables)).where(F.col(id_var).isNotNull())
    q = quantiles_wide(None, keys, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, vc=vc)
    q = (q.withColumn("iqr", F.col("q3") - F.col("q1"))
          .withColumn("lower_fence", F.col("q1") - whisker * F.col("iqr"))
          .withColumn("upper_fence", F.col("q3") + whisker * F.col("iqr")))
    v = F.col("value")
    inside = (v >= F.col("lower_fence")) & (v <= F.col("upper_fence"))
    tails = (vc.join(q.select(*keys, "lower_fence", "upper_fence"), keys)
               .groupBy(*keys)
               .agg(F.sum("cnt").alias("n"),
                    F.min(F.when(inside, v)).alias("whisker_low"),
                    F.max(F.when(inside, v)).alias("whisker_high"),
                    F.sum(F.when(~inside, F.col("cnt")).otherwise(0)).alias("n_outliers")))
    out = q.join(tails, keys)
    r = (lambda c: round2(c, digits)) if digits is not None else (lambda c: c)
    return out.select(*keys, F.col("n").cast("long").alias("n"),
                      *[r(F.col(c)).alias(c) for c in ("q1", "median", "q3", "iqr", "lower_fence",
                                                        "upper_fence", "whisker_low", "whisker_high")],
                      F.col("n_outliers").cast("long").alias("n_outliers"))


# ---------------------------------------------------------------- D14 / D18

def label_balance(df: DataFrame, split_col: str = "split", label: str = "label") -> DataFrame:
    """Count of label 1 and 0 per split."""
    return df.groupBy(split_col).agg(F.count_if(F.col(label) == 1).alias("n_pos"),
                                     F.count_if(F.col(label) == 0).alias("n_neg"))


def cv_score_summary(scores: DataFrame, score_col: str = "score") -> DataFrame:
    """Mean and population std of fold scores."""
    return scores.agg(F.avg(score_col).alias("mean_score"), F.stddev_pop(score_col).alias("std_score"))
