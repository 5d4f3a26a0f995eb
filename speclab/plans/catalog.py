"""Registered queries: one per operator of the inventory, each with its oracle.

``QUERIES[name] = fn(spark, sf_dir) -> DataFrame``; ``ORACLE[name]`` is the
DuckDB SQL over the supplied tables (absent for model / IO queries, which get
the rows-only check). Every query reads the given tables (or frames Spark
derives from them) in full.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speclab.functions import scalar as S
from speclab.operators import clean as B
from speclab.operators import metrics as H
from speclab.operators import models as ML
from speclab.operators import profile as D
from speclab.operators import select as M
from speclab.operators import split as G
from speclab.plans import oracle_sql as O
from speclab.plans.fixtures import scored
from speclab.plans.pipelines import labelled, preprocess
from speclab.plans.targets import MISSING, PRODUCT, TARGETS
from speclab.session import ensure_checkpoint_dir
from speclab.sources import io as A
from speclab.sources.readings import readings

QUERIES: dict = {}
ORACLE: dict = {}

# The column groups the registered queries profile.
NUMERIC_VARS = ["feed_flow", "heat_temp", "heat_temp_2", "discount", "tax_text", "size", "unit_cost", "method"]
CORR_VARS = ["feed_flow", "heat_temp", "heat_temp_2", "discount", "size", "unit_cost"]
BOX_VARS = ["feed_flow", "heat_temp", "discount", "size"]
TEXT_VARS = ["batch_source", "method", "swirl", "tax_text", "size"]
CAT_VARS = ["test_code", "line_status", "swirl", "method", "result_grade"]


def q(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


_VIEWS: dict = {}


def R(spark, sf):
    """The readings view, built once per session and folder (a lazy plan: no data is cached)."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _VIEWS:
        _VIEWS[key] = readings(spark, sf)
    return _VIEWS[key]


def lab(spark, sf, t):
    return labelled(R(spark, sf), TARGETS[t], drop_constants=False)[0]


def r6(df: DataFrame, cols, d: int = 6) -> DataFrame:
    return df.select(*[S.round2(F.col(c), d).alias(c) if c in cols else F.col(c) for c in df.columns])


def scratch_path(spark: SparkSession, name: str) -> str:
    """Output folder under the session's shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "speclab-out", f"{name}-{uuid.uuid4().hex}")


ALL = "SELECT * FROM readings"

# ------------------------------------------------------------------ A: sources / sinks


@q("scan_table", O.with_readings(ALL))
def _scan(spark, sf):
    return R(spark, sf)


@q("register_view", O.with_readings(
    "SELECT test_code, CAST(count(*) AS BIGINT) AS n FROM readings GROUP BY test_code"))
def _view(spark, sf):
    A.register_view(R(spark, sf), "readings")
    return spark.sql("SELECT test_code, count(*) AS n FROM readings GROUP BY test_code")


@q("write_dataset", O.with_readings(ALL))
def _write(spark, sf):
    path = A.write_dataset(R(spark, sf), scratch_path(spark, "readings"))
    return A.read_dataset(spark, path)


@q("read_dataset", O.with_readings(ALL))
def _read(spark, sf):
    return _write(spark, sf)


SPLIT70_CTE = """h AS (SELECT row_id, row_number() OVER (ORDER BY md5(row_id || '|42')) AS rn,
                    count(*) OVER () AS n FROM readings)"""
SPLIT70_BODY = """SELECT row_id, CASE WHEN rn > CAST(ceil(n * 0.3) AS BIGINT) THEN 'train'
                    WHEN rn2 <= CAST(ceil(n2 * 0.5) AS BIGINT) THEN 'val' ELSE 'test' END AS split
FROM (SELECT h.*, t.rn2, t.n2 FROM h LEFT JOIN (
        SELECT row_id, row_number() OVER (ORDER BY md5(row_id || '|42|b')) AS rn2, count(*) OVER () AS n2
        FROM h WHERE rn <= CAST(ceil(n * 0.3) AS BIGINT)) t USING (row_id))"""


def _split_70_sql():
    return O.with_readings(SPLIT70_BODY, SPLIT70_CTE)


@q("write_split_datasets", O.with_readings(
    f"SELECT split, CAST(count(*) AS BIGINT) AS n FROM ({SPLIT70_BODY}) GROUP BY split", SPLIT70_CTE))
def _write_splits(spark, sf):
    s = G.split_70_15_15(R(spark, sf).select("row_id", "heat_temp"))
    path = A.write_split_datasets(s, scratch_path(spark, "splits"))
    return A.read_dataset(spark, path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@q("read_split_datasets", O.with_readings(
    """SELECT row_id, heat_temp, CASE WHEN rn <= CAST(ceil(n * 0.2) AS BIGINT) THEN 'val' ELSE 'train' END AS split FROM h""",
    """h AS (SELECT row_id, heat_temp, row_number() OVER (ORDER BY md5(row_id || '|42')) AS rn,
                count(*) OVER () AS n FROM readings)"""))
def _read_splits(spark, sf):
    s = G.split_80_20(R(spark, sf).select("row_id", "heat_temp"))
    path = A.write_split_datasets({"train": s.where("split = 'train'").drop("split"),
                                   "val": s.where("split = 'val'").drop("split")},
                                  scratch_path(spark, "splits2"))
    parts = A.read_split_datasets(spark, path, names=("train", "val"))
    return parts["train"].unionByName(parts["val"]).select("row_id", "heat_temp", "split")

# ------------------------------------------------------------------ B: filters, projections


@q("filter_product_test", O.with_readings(
    f"SELECT * FROM readings WHERE product = '{PRODUCT}' AND test_code IN ('A', 'R')"))
def _b1(spark, sf):
    return B.filter_product_test(R(spark, sf), PRODUCT, ["A", "R"])


@q("drop_columns", O.with_readings("SELECT * EXCLUDE (product, order_no, batch_source, method) FROM readings"))
def _b2(spark, sf):
    return B.drop_columns(R(spark, sf), ["product", "order_no", "batch_source", "method"])


@q("drop_known_constants", O.with_readings("SELECT * EXCLUDE (plant, test_code) FROM readings"))
def _b3(spark, sf):
    return B.drop_columns(R(spark, sf), ["plant", "test_code"])


@q("drop_sentinel_rows", O.with_readings(
    "SELECT row_id, result_int FROM readings WHERE result_int IS DISTINCT FROM '#'"))
def _b4(spark, sf):
    return B.drop_sentinel_rows(R(spark, sf), "result_int").select("row_id", "result_int")


@q("dropna_subset", O.with_readings(
    "SELECT * FROM readings WHERE method IS NOT NULL AND feed_flow IS NOT NULL "
    "AND batch_source IS NOT NULL AND swirl IS NOT NULL"))
def _b5(spark, sf):
    return B.dropna_subset(R(spark, sf), ["method", "feed_flow", "batch_source", "swirl"])


@q("dropna_any", O.with_readings(
    "SELECT * FROM readings WHERE method IS NOT NULL AND feed_flow IS NOT NULL"))
def _b6(spark, sf):
    return B.dropna_any(R(spark, sf))


@q("unmapped_rows", O.with_readings(
    "SELECT row_id, swirl, CAST(NULL AS INTEGER) AS swirl_code FROM readings "
    "WHERE (CASE swirl WHEN 'SW6' THEN 0 WHEN 'SW5' THEN 1 END) IS NULL"))
def _b7(spark, sf):
    df = R(spark, sf).select("row_id", "swirl", S.map_codes("swirl", S.SWIRL_CODES).alias("swirl_code"))
    return B.unmapped_rows(df, "swirl_code")


@q("split_features_label", O.with_lab("t2", "SELECT * FROM lab"))
def _b8(spark, sf):
    x, y = B.split_features_label(lab(spark, sf, "t2"), "label")
    return x.join(y, "row_id")


@q("select_by_kind", O.with_readings("SELECT row_id, test_code, line_status, plant FROM readings"))
def _b9(spark, sf):
    rd = R(spark, sf)
    kinds = M.kinds_of(rd.drop("row_id"), ["test_code", "line_status", "plant", "heat_temp", "size"])
    return B.select_by_kind(rd.select("row_id", "test_code", "line_status", "plant", "heat_temp", "size"), kinds)


@q("select_features_except", O.with_readings("SELECT feed_flow, heat_temp, discount FROM readings"))
def _b10(spark, sf):
    return B.select_features_except(R(spark, sf), ["feed_flow", "heat_temp", "swirl", "discount", "method"],
                                    ["swirl", "method"])


@q("preview_rows", O.with_readings("SELECT * FROM readings ORDER BY row_id LIMIT 5"))
def _b11(spark, sf):
    return B.preview_rows(R(spark, sf))

# ------------------------------------------------------------------ C: joins


@q("pair_features_labels", O.with_lab("t2", "SELECT * FROM lab"))
def _c1(spark, sf):
    x, y = B.split_features_label(lab(spark, sf, "t2"), "label")
    return G.pair_features_labels(x, y)

# ------------------------------------------------------------------ D: aggregates


def _null_counts_sql():
    cols = ["row_id", "product", "test_code", "order_no", "batch_source", "method", "swirl", "feed_flow",
            "heat_temp", "heat_temp_2", "discount", "tax_text", "size", "line_status", "plant", "unit_cost",
            "result_int", "result_dbl", "result_flow", "result_grade", "result_code", "result_foam"]
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_count FROM readings"
        for c in cols)
    return O.with_readings(f"SELECT * FROM ({parts}) WHERE null_count > 0")


@q("null_counts", _null_counts_sql())
def _d1(spark, sf):
    return D.null_counts(R(spark, sf))


def _distinct_sql():
    from speclab.sources.readings import READINGS_COLUMNS
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM readings"
        for c in READINGS_COLUMNS)
    return O.with_readings(parts)


@q("distinct_counts", _distinct_sql())
def _d2(spark, sf):
    return D.distinct_counts(R(spark, sf))


@q("constant_columns", O.with_readings("SELECT 'plant' AS column_name, min(plant) AS value FROM readings "
                                       "HAVING count(DISTINCT plant) = 1"))
def _d3(spark, sf):
    return D.constant_columns(R(spark, sf))


@q("drop_constant_columns", O.with_readings("SELECT * EXCLUDE (plant) FROM readings"))
def _d4(spark, sf):
    return D.drop_constant_columns(R(spark, sf))[0]


@q("value_counts", O.with_readings(
    "SELECT result_grade, CAST(count(*) AS BIGINT) AS n FROM readings WHERE result_grade IS NOT NULL "
    "GROUP BY result_grade"))
def _d5(spark, sf):
    return D.value_counts(R(spark, sf), "result_grade")


def _class_sql(t):
    return O.with_lab(t, """SELECT label, CAST(count(*) AS BIGINT) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct FROM lab WHERE label IS NOT NULL GROUP BY label""")


@q("class_distribution", _class_sql("t5"))
def _d6(spark, sf):
    return D.class_distribution(lab(spark, sf, "t5"))


@q("group_label_counts", O.with_lab("t6", "SELECT order_no, label, CAST(count(*) AS BIGINT) AS n "
                                          "FROM readings_lab GROUP BY order_no, label",
                                    "readings_lab AS (SELECT r.order_no, l.label FROM lab l "
                                    "JOIN readings r USING (row_id))"))
def _d7(spark, sf):
    rd = R(spark, sf)
    lb = lab(spark, sf, "t6").select("row_id", "label")
    return D.group_label_counts(lb.join(rd.select("row_id", "order_no"), "row_id"), "order_no", "label")


CAT_SUMMARY_SQL = O.with_readings("""SELECT line_status, result_grade, n,
  round(n * 100.0 / sum(n) OVER (PARTITION BY line_status), 2) AS pct_within,
  round(n * 100.0 / sum(n) OVER (), 1) AS pct_total
FROM (SELECT line_status, result_grade, CAST(count(*) AS BIGINT) AS n FROM readings
      WHERE line_status IS NOT NULL AND result_grade IS NOT NULL GROUP BY 1, 2)""")


@q("categorical_summary", CAT_SUMMARY_SQL)
def _d8(spark, sf):
    return D.categorical_summary(R(spark, sf), "line_status", "result_grade")


@q("unique_values_table", O.with_readings(f"""SELECT variable, value, n, n_unique FROM
  (SELECT variable, value, CAST(count(*) AS BIGINT) AS n FROM ({O.melt_sql('readings', TEXT_VARS, text=True)})
   GROUP BY variable, value) a
  JOIN (SELECT variable, CAST(count(DISTINCT value) AS BIGINT) AS n_unique
        FROM ({O.melt_sql('readings', TEXT_VARS, text=True)}) GROUP BY variable) b USING (variable)"""))
def _d9(spark, sf):
    return D.unique_values_long(R(spark, sf), TEXT_VARS)


@q("numeric_statistics", O.numeric_statistics_sql((), "readings", NUMERIC_VARS, O.with_readings))
def _d10(spark, sf):
    return D.numeric_statistics(R(spark, sf), NUMERIC_VARS)


def _grouped_sql(t, variables):
    return O.with_lab(t, f"""SELECT label, variable, round(min(value), 2) AS min_value,
  round(max(value), 2) AS max_value, round(avg(value), 2) AS mean_value,
  round(quantile_cont(value, 0.5), 2) AS median_value
FROM ({O.melt_sql('lab', variables, ids=['label'])}) WHERE value IS NOT NULL AND label IS NOT NULL
GROUP BY label, variable""")


@q("grouped_statistics", _grouped_sql("t6", BOX_VARS))
def _d11(spark, sf):
    return D.grouped_statistics(lab(spark, sf, "t6"), "label", BOX_VARS)


@q("melt_features", O.with_readings(
    f"SELECT * FROM ({O.melt_sql('readings', ['feed_flow', 'tax_text', 'size'], ids=['row_id'])})"))
def _d12(spark, sf):
    return D.melt_features(R(spark, sf), ["row_id"], ["feed_flow", "tax_text", "size"])


def _box_sql(t, variables):
    return O.with_lab(t, f"""SELECT q.label, q.variable, q.n, round(q1, 6) AS q1, round(med, 6) AS median,
  round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, round(q1 - 1.5 * (q3 - q1), 6) AS lower_fence,
  round(q3 + 1.5 * (q3 - q1), 6) AS upper_fence,
  round(min(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END), 6) AS whisker_low,
  round(max(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END), 6) AS whisker_high,
  CAST(count(*) FILTER (WHERE NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers
FROM m JOIN (SELECT label, variable, CAST(count(*) AS BIGINT) AS n, quantile_cont(value, 0.25) AS q1,
                    quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3
             FROM m GROUP BY label, variable) q USING (label, variable)
GROUP BY q.label, q.variable, q.n, q1, med, q3""",
                     f"m AS (SELECT * FROM ({O.melt_sql('lab', variables, ids=['label'])}) "
                      "WHERE value IS NOT NULL AND label IS NOT NULL)")


@q("boxplot_summary", _box_sql("t2", BOX_VARS))
def _d13(spark, sf):
    return D.boxplot_summary(lab(spark, sf, "t2"), "label", BOX_VARS)


@q("label_balance", O.with_lab("t2", f"""SELECT split, CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS n_pos,
  CAST(count(*) FILTER (WHERE label = 0) AS BIGINT) AS n_neg FROM (
  SELECT l.label, CASE WHEN rn > CAST(ceil(n * 0.3) AS BIGINT) THEN 'train'
         WHEN rn2 <= CAST(ceil(n2 * 0.5) AS BIGINT) THEN 'val' ELSE 'test' END AS split
  FROM lab l JOIN h USING (row_id) LEFT JOIN (
      SELECT row_id, row_number() OVER (ORDER BY md5(row_id || '|42|b')) AS rn2, count(*) OVER () AS n2
      FROM h WHERE rn <= CAST(ceil(n * 0.3) AS BIGINT)) t USING (row_id)) GROUP BY split""",
                                     """h AS (SELECT row_id, row_number() OVER (ORDER BY md5(row_id || '|42')) AS rn,
                count(*) OVER () AS n FROM lab)"""))
def _d14(spark, sf):
    return D.label_balance(G.split_70_15_15(lab(spark, sf, "t2")))


@q("contingency_table", O.with_readings(
    "SELECT swirl, line_status, CAST(count(*) AS BIGINT) AS n FROM readings "
    "WHERE swirl IS NOT NULL AND line_status IS NOT NULL GROUP BY swirl, line_status"))
def _d15(spark, sf):
    return D.contingency_table(R(spark, sf), "swirl", "line_status")


def _profile_sql():
    from speclab.sources.readings import READINGS_COLUMNS
    types = {"order_no": "bigint", "feed_flow": "double", "heat_temp": "double", "heat_temp_2": "double",
             "discount": "double", "size": "int", "unit_cost": "double", "result_flow": "int"}
    parts = " UNION ALL ".join(
        f"SELECT {i} AS pos, '{c}' AS column_name, '{types.get(c, 'string')}' AS dtype, "
        f"CAST(count({c}) AS BIGINT) AS non_null, CAST(count(*) AS BIGINT) AS rows FROM readings"
        for i, c in enumerate(READINGS_COLUMNS))
    return O.with_readings(parts)


@q("dataset_profile", _profile_sql())
def _d16(spark, sf):
    return D.dataset_profile(R(spark, sf))


@q("dataset_shape", O.with_readings("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(22 AS BIGINT) AS columns "
                                    "FROM readings"))
def _d17(spark, sf):
    return D.dataset_shape(R(spark, sf))


@q("cv_score_summary", O.with_scored("""SELECT round(avg(acc), 6) AS mean_score, round(stddev_pop(acc), 6) AS std_score
FROM (SELECT fold, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS acc FROM scored GROUP BY fold)"""))
def _d18(spark, sf):
    sc = scored(spark, sf)
    per_fold = H.accuracy(sc, by=["fold"]).withColumnRenamed("accuracy", "score")
    return r6(D.cv_score_summary(per_fold), ["mean_score", "std_score"])

# ------------------------------------------------------------------ E: windows


@q("share_within_group", O.with_readings("""SELECT line_status, result_grade, n,
  round(n * 100.0 / sum(n) OVER (PARTITION BY line_status), 2) AS pct_within
FROM (SELECT line_status, result_grade, CAST(count(*) AS BIGINT) AS n FROM readings GROUP BY 1, 2)"""))
def _e1(spark, sf):
    return D.share_within_group(D.group_label_counts(R(spark, sf), "line_status", "result_grade"), "line_status")


@q("share_of_total", O.with_readings("""SELECT result_grade, n, round(n * 100.0 / sum(n) OVER (), 1) AS pct_total
FROM (SELECT result_grade, CAST(count(*) AS BIGINT) AS n FROM readings GROUP BY 1)"""))
def _e2(spark, sf):
    counts = R(spark, sf).groupBy("result_grade").agg(F.count(F.lit(1)).alias("n"))
    return D.share_of_total(counts)


@q("roc_running_counts", O.with_scored("""SELECT score, pos, neg,
  CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp,
  CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp
FROM (SELECT score, CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS pos,
             CAST(count(*) FILTER (WHERE label <> 1) AS BIGINT) AS neg FROM scored GROUP BY score)"""))
def _e3(spark, sf):
    return H.roc_running_counts(scored(spark, sf))

# ------------------------------------------------------------------ F: ranking


@q("target_correlation_ranked", O.with_lab("t5", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(CASE WHEN isnan(corr({c}, label)) THEN NULL "
    f"ELSE corr({c}, label) END, 6) AS r FROM lab" for c in ["feed_flow", "heat_temp", "discount", "size", "label"])))
def _f1(spark, sf):
    return r6(M.target_correlation_ranked(lab(spark, sf, "t5"), ["feed_flow", "heat_temp", "discount", "size"],
                                          "label"), ["r"])

# ------------------------------------------------------------------ S: scalar functions


@q("encode_binary_codes", O.with_readings(
    "SELECT row_id, CASE method WHEN 'Da Vinci' THEN 0 WHEN 'Original' THEN 1 END AS method_code, "
    "CASE swirl WHEN 'SW6' THEN 0 WHEN 'SW5' THEN 1 END AS swirl_code FROM readings"))
def _s1(spark, sf):
    return R(spark, sf).select("row_id", S.map_codes("method", S.METHOD_CODES).alias("method_code"),
                               S.map_codes("swirl", S.SWIRL_CODES).alias("swirl_code"))


@q("normalize_whitespace", O.with_readings(
    "SELECT row_id, trim(regexp_replace(batch_source, '\\s+', ' ', 'g')) AS batch_source FROM readings"))
def _s2(spark, sf):
    return R(spark, sf).select("row_id", S.normalize_whitespace("batch_source").alias("batch_source"))


@q("encode_text_codes", O.with_readings(
    "SELECT row_id, CASE trim(regexp_replace(batch_source, '\\s+', ' ', 'g')) WHEN '100% liquid milk' THEN 0 "
    "WHEN '100% powder' THEN 1 WHEN '50% liquid milk + 50% powder' THEN 2 END AS batch_code FROM readings"))
def _s3(spark, sf):
    return R(spark, sf).select(
        "row_id", S.map_codes(S.normalize_whitespace("batch_source"), S.MILK_SOURCE_CODES).alias("batch_code"))


@q("cast_strict", O.with_readings("SELECT row_id, CAST(result_dbl AS DOUBLE) AS result_value, "
                                  "CAST(result_code AS INTEGER) AS result_code FROM readings"))
def _s4(spark, sf):
    return R(spark, sf).select("row_id", S.cast_strict("result_dbl", "double").alias("result_value"),
                               S.cast_strict("result_code", "int").alias("result_code"))


@q("coerce_numeric", O.with_readings("SELECT row_id, TRY_CAST(tax_text AS DOUBLE) AS tax, "
                                     "TRY_CAST(result_int AS DOUBLE) AS result_value FROM readings"))
def _s5(spark, sf):
    return R(spark, sf).select("row_id", S.coerce_numeric("tax_text").alias("tax"),
                               S.coerce_numeric("result_int").alias("result_value"))


@q("label_from_map", O.with_readings(
    "SELECT row_id, CASE CAST(result_code AS INTEGER) WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 0 END "
    "AS label FROM readings"))
def _s6(spark, sf):
    return R(spark, sf).select("row_id", TARGETS["t1"].label_expr(F.col("result_code")).alias("label"))


@q("label_in_set_int", O.with_readings(
    "SELECT row_id, CASE WHEN CAST(result_int AS INTEGER) IN (0, 1, 2, 3) THEN 1 ELSE 0 END AS label_t2, "
    "CASE WHEN CAST(result_foam AS INTEGER) IN (10, 20) THEN 1 ELSE 0 END AS label_t3 "
    "FROM readings WHERE result_int IS DISTINCT FROM '#'"))
def _s7(spark, sf):
    rd = B.drop_sentinel_rows(R(spark, sf), "result_int")
    return rd.select("row_id", TARGETS["t2"].label_expr(F.col("result_int")).alias("label_t2"),
                     TARGETS["t3"].label_expr(F.col("result_foam")).alias("label_t3"))


@q("label_equals", O.with_readings(
    "SELECT row_id, CASE WHEN result_grade = 'A' THEN 1 ELSE 0 END AS label FROM readings"))
def _s8(spark, sf):
    return R(spark, sf).select("row_id", TARGETS["t4"].label_expr(F.col("result_grade")).alias("label"))


@q("label_in_range", O.with_readings(
    "SELECT row_id, CASE WHEN CAST(result_dbl AS DOUBLE) BETWEEN 0.49 AND 0.51 THEN 1 ELSE 0 END AS label "
    "FROM readings"))
def _s9(spark, sf):
    return R(spark, sf).select("row_id", TARGETS["t5"].label_expr(F.col("result_dbl")).alias("label"))


@q("label_in_set_text", O.with_readings(
    "SELECT row_id, CASE WHEN result_grade IN ('A+', 'A-') THEN 1 ELSE 0 END AS label FROM readings"))
def _s10(spark, sf):
    return R(spark, sf).select("row_id", TARGETS["t6"].label_expr(F.col("result_grade")).alias("label"))


@q("round_stats", O.with_readings("SELECT row_id, round(heat_temp_2, 2) AS heat_temp_2, "
                                  "round(unit_cost / 7, 2) AS unit_cost_7 FROM readings"))
def _s11(spark, sf):
    rd = R(spark, sf)
    return rd.select("row_id", S.round2("heat_temp_2").alias("heat_temp_2"),
                     S.round2(F.col("unit_cost") / 7).alias("unit_cost_7"))


def _corr_sql(cols, abs_=False, upper=False, thr=None):
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if upper and not i < j:
                continue
            if i == j:
                r = f"CASE WHEN stddev_pop({a}) > 0 THEN 1.0 END"
            else:
                r = (f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END")
            r = f"abs({r})" if abs_ else r
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {i} AS pos_a, {j} AS pos_b, round({r}, 6) AS r "
                         "FROM readings")
    body = " UNION ALL ".join(parts)
    if thr is not None:
        body = f"SELECT * FROM ({body}) WHERE abs(r) > {thr}"
    return O.with_readings(body)


@q("abs_correlation", _corr_sql(CORR_VARS, abs_=True))
def _s12(spark, sf):
    m = M.correlation_matrix(R(spark, sf), CORR_VARS)
    return r6(m.withColumn("r", S.abs_col("r")), ["r"])

# ------------------------------------------------------------------ M: statistics / selection


@q("correlation_matrix", _corr_sql(CORR_VARS))
def _m1(spark, sf):
    return r6(M.correlation_matrix(R(spark, sf), CORR_VARS), ["r"])


@q("correlated_pairs", _corr_sql(CORR_VARS, upper=True, thr=0.8))
def _m2(spark, sf):
    return r6(M.correlated_pairs(R(spark, sf), CORR_VARS), ["r"])


def _greedy_walk_sql(cols, threshold=0.8):
    """The M3 walk in SQL: a recursive CTE visits the columns in order (dropped
    ones too) and drops each anchor's first later partner above the threshold
    that is not dropped yet."""
    pairs = " UNION ALL ".join(
        f"SELECT {i} AS pos_a, {j} AS pos_b, '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM readings"
        for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j)
    sql = O.with_readings(f"""SELECT x.anchor, x.dropped, round(x.abs_r, 6) AS abs_r
FROM (SELECT unnest(picks) AS x FROM walk WHERE step = {len(cols)})""",
                          f"""p AS (SELECT * FROM ({pairs}) WHERE abs(r) > {threshold} AND NOT isnan(r))""",
                           f"""walk(step, dropped, picks) AS (
  SELECT 0, CAST([] AS VARCHAR[]), CAST([] AS STRUCT(anchor VARCHAR, dropped VARCHAR, abs_r DOUBLE)[])
  UNION ALL
  SELECT w.step + 1,
         CASE WHEN pk.col_b IS NULL THEN w.dropped ELSE list_append(w.dropped, pk.col_b) END,
         CASE WHEN pk.col_b IS NULL THEN w.picks
              ELSE list_append(w.picks, struct_pack(anchor := pk.col_a, dropped := pk.col_b, abs_r := abs(pk.r))) END
  FROM walk w LEFT JOIN LATERAL (
      SELECT col_a, col_b, r FROM p WHERE p.pos_a = w.step AND NOT list_contains(w.dropped, p.col_b)
      ORDER BY pos_b LIMIT 1) pk ON true
  WHERE w.step < {len(cols)})""")
    return "WITH RECURSIVE " + sql[len("WITH "):]


@q("remove_highly_correlated_features", _greedy_walk_sql(CORR_VARS))
def _m3(spark, sf):
    return r6(M.remove_highly_correlated_features(R(spark, sf), CORR_VARS)[1], ["abs_r"])


@q("drop_low_target_correlation", O.with_lab("t5", "SELECT column_name, round(r, 6) AS r, "
                                             "coalesce(r > -0.03 AND r < 0.03, false) AS dropped FROM (" +
                                             " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CASE WHEN isnan(corr({c}, label)) THEN NULL ELSE corr({c}, label) END AS r "
    "FROM lab" for c in ["feed_flow", "heat_temp", "discount", "size", "swirl", "label"]) + ")"))
def _m4(spark, sf):
    return r6(M.low_target_correlation(lab(spark, sf, "t5"), ["feed_flow", "heat_temp", "discount", "size", "swirl"],
                                       "label"), ["r"])


def _chi2_pairs_cte(cols):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST({a} AS VARCHAR) AS a, "
                         f"CAST({b} AS VARCHAR) AS b FROM readings WHERE {a} IS NOT NULL AND {b} IS NOT NULL")
    return "x AS (" + " UNION ALL ".join(parts) + ")"


CHI2_STAT_SQL = """SELECT col_a, col_b,
  CASE WHEN dof = 0 THEN 0.0 ELSE sum(power(adj - e, 2) / e) END AS statistic, CAST(dof AS BIGINT) AS dof
FROM (SELECT g.*, CASE WHEN dof = 1 THEN o + sign(e - o) * least(0.5, abs(e - o)) ELSE o END AS adj
      FROM (SELECT ra.col_a, ra.col_b, ra.a, cb.b, coalesce(ob.o, 0) AS o, ra.ra * cb.cb * 1.0 / t.n AS e,
                   (t.nr - 1) * (t.nc - 1) AS dof
            FROM (SELECT col_a, col_b, a, count(*) AS ra FROM x GROUP BY 1, 2, 3) ra
            JOIN (SELECT col_a, col_b, b, count(*) AS cb FROM x GROUP BY 1, 2, 3) cb USING (col_a, col_b)
            JOIN (SELECT col_a, col_b, count(*) AS n, count(DISTINCT a) AS nr, count(DISTINCT b) AS nc
                  FROM x GROUP BY 1, 2) t USING (col_a, col_b)
            LEFT JOIN (SELECT col_a, col_b, a, b, count(*) AS o FROM x GROUP BY 1, 2, 3, 4) ob
                   ON ob.col_a = ra.col_a AND ob.col_b = ra.col_b AND ob.a = ra.a AND ob.b = cb.b) g)
GROUP BY col_a, col_b, dof"""


def _chi2_sql(cols):
    """Statistic and dof of every pair; p in its closed form where dof is even (odd dof need the error
    function, which this SQL lacks: pytest holds those against a published table)."""
    return O.with_readings("""SELECT col_a, col_b, round(statistic, 6) AS statistic, dof, round(CASE dof WHEN 0 THEN 1.0
  WHEN 2 THEN exp(-h) WHEN 4 THEN exp(-h) * (1 + h) WHEN 6 THEN exp(-h) * (1 + h + h * h / 2) END, 6) AS p_value
FROM (SELECT *, statistic / 2 AS h FROM stat)""", _chi2_pairs_cte(cols), f"stat AS ({CHI2_STAT_SQL})")


# Published upper 5 % points of the chi-square distribution, degrees of freedom 1 to 12.
CHI2_CRITICAL = (3.841459, 5.991465, 7.814728, 9.487729, 11.070498, 12.591587, 14.067140, 15.507313, 16.918978,
                 18.307038, 19.675138, 21.026070)


def _m6_sql(cols):
    """M6 walk in SQL: significant ordered pairs (statistic above the critical
    value of its dof, i.e. p < 0.05) in column order; a recursive CTE removes the
    second column unless either was removed already."""
    pos = " UNION ALL ".join(f"SELECT '{c}' AS col, {i} AS pos" for i, c in enumerate(cols))
    crit = ", ".join(f"({d}, {c!r})" for d, c in enumerate(CHI2_CRITICAL, 1))
    ordered = """SELECT a.pos AS pa, b.pos AS pb, s.col_a AS ca, s.col_b AS cb, s.statistic, s.dof FROM stat s
        JOIN cols a ON a.col = s.col_a JOIN cols b ON b.col = s.col_b
      UNION ALL
      SELECT b.pos, a.pos, s.col_b, s.col_a, s.statistic, s.dof FROM stat s
        JOIN cols a ON a.col = s.col_a JOIN cols b ON b.col = s.col_b"""
    sql = O.with_readings(f"""SELECT unnest(removed) AS column_name FROM walk
WHERE step = (SELECT count(*) FROM sig)""",
                          _chi2_pairs_cte(cols), f"stat AS ({CHI2_STAT_SQL})", f"cols AS ({pos})",
                          f"crit(dof, c) AS (VALUES {crit})",
                          f"""sig AS (SELECT row_number() OVER (ORDER BY pa, pb) AS idx, ca, cb
            FROM ({ordered}) o JOIN crit USING (dof) WHERE o.statistic > crit.c)""",
                          """walk(step, removed) AS (
  SELECT 0, CAST([] AS VARCHAR[])
  UNION ALL
  SELECT w.step + 1, CASE WHEN list_contains(w.removed, s.ca) OR list_contains(w.removed, s.cb)
                          THEN w.removed ELSE list_append(w.removed, s.cb) END
  FROM walk w JOIN sig s ON s.idx = w.step + 1)""")
    return "WITH RECURSIVE " + sql[len("WITH "):]


@q("chi2_pairwise", _chi2_sql(CAT_VARS))
def _m5(spark, sf):
    out = M.chi2_pairwise(R(spark, sf), CAT_VARS)
    return r6(out.withColumn("p_value", F.when(F.col("dof") % 2 == 0, F.col("p_value"))), ["statistic", "p_value"])


@q("drop_associated_categoricals", _m6_sql(CAT_VARS))
def _m6(spark, sf):
    return M.drop_associated_categoricals(R(spark, sf), CAT_VARS)[1]


@q("infer_column_kind", O.with_readings(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, "
    f"CASE WHEN count(DISTINCT {c}) < 5 THEN 'category' ELSE 'numeric' END AS kind FROM readings"
    for c in ["test_code", "batch_source", "method", "swirl", "feed_flow", "discount", "tax_text", "size",
              "line_status", "plant", "result_grade", "result_foam"])))
def _m7(spark, sf):
    return M.infer_column_kind(R(spark, sf), ["test_code", "batch_source", "method", "swirl", "feed_flow",
                                              "discount", "tax_text", "size", "line_status", "plant",
                                              "result_grade", "result_foam"])

# ------------------------------------------------------------------ G: splits


@q("split_80_20", O.with_readings("""SELECT row_id, CASE WHEN rn <= CAST(ceil(n * 0.2) AS BIGINT) THEN 'val'
  ELSE 'train' END AS split FROM h""", """h AS (SELECT row_id, row_number() OVER (ORDER BY md5(row_id || '|42')) AS rn,
                count(*) OVER () AS n FROM readings)"""))
def _g1(spark, sf):
    return G.split_80_20(R(spark, sf).select("row_id")).select("row_id", "split")


@q("split_70_15_15", _split_70_sql())
def _g2(spark, sf):
    return G.split_70_15_15(R(spark, sf).select("row_id")).select("row_id", "split")


@q("stratified_folds", O.with_lab("t6", """SELECT row_id, label,
  CAST((row_number() OVER (PARTITION BY label ORDER BY md5(row_id || '|123')) - 1) % 10 AS INTEGER) AS fold
FROM lab"""))
def _g_folds(spark, sf):
    return G.stratified_folds(lab(spark, sf, "t6").select("row_id", "label"))

# ------------------------------------------------------------------ H: metrics on the scored table


@q("accuracy", O.with_scored("SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) "
                             "AS accuracy FROM scored"))
def _h6(spark, sf):
    return r6(H.accuracy(scored(spark, sf)), ["accuracy"])


@q("confusion_matrix", O.with_scored("""SELECT a.actual, p.predicted,
  CAST((SELECT count(*) FROM scored s WHERE s.label = a.actual AND s.prediction = p.predicted) AS BIGINT) AS n
FROM (VALUES (0), (1)) a(actual), (VALUES (0), (1)) p(predicted)"""))
def _h7(spark, sf):
    return H.confusion_matrix(scored(spark, sf))


REPORT_SQL = O.with_scored("""SELECT row_label, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, support FROM (
  SELECT CAST(c AS VARCHAR) AS row_label, p AS precision, r AS recall,
         coalesce(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END, 0.0) AS f1, sup AS support FROM per
  UNION ALL SELECT 'accuracy', NULL, NULL, (SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END)
         FROM scored), (SELECT CAST(count(*) AS BIGINT) FROM scored)
  UNION ALL SELECT 'macro avg', avg(p), avg(r),
         avg(coalesce(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END, 0.0)), CAST(sum(sup) AS BIGINT) FROM per
  UNION ALL SELECT 'weighted avg', sum(p * sup) / sum(sup), sum(r * sup) / sum(sup),
         sum(coalesce(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END, 0.0) * sup) / sum(sup),
         CAST(sum(sup) AS BIGINT) FROM per)""", """per AS (
  SELECT c, coalesce(tp * 1.0 / nullif(pp, 0), 0.0) AS p, coalesce(tp * 1.0 / nullif(sup, 0), 0.0) AS r, sup
  FROM (SELECT c.c, count(*) FILTER (WHERE label = c.c AND prediction = c.c) AS tp,
               count(*) FILTER (WHERE prediction = c.c) AS pp,
               CAST(count(*) FILTER (WHERE label = c.c) AS BIGINT) AS sup
        FROM scored, (VALUES (0), (1)) c(c) GROUP BY c.c))""")


@q("classification_report", REPORT_SQL)
def _h8(spark, sf):
    return r6(H.classification_report(scored(spark, sf)), ["precision", "recall", "f1"])


def _roc_sql(score_expr):
    curve = f"""(SELECT threshold, tp, fp, sum(pos) OVER () AS pp, sum(neg) OVER () AS nn,
             sum(neg * (tp - pos / 2.0)) OVER () AS area
      FROM (SELECT threshold, pos, neg, sum(pos) OVER (ORDER BY threshold DESC) AS tp,
                   sum(neg) OVER (ORDER BY threshold DESC) AS fp
            FROM (SELECT CAST({score_expr} AS DOUBLE) AS threshold, count(*) FILTER (WHERE label = 1) AS pos,
                         count(*) FILTER (WHERE label <> 1) AS neg FROM scored GROUP BY 1)))"""
    return O.with_scored(f"""SELECT threshold, round(fp * 1.0 / nn, 6) AS fpr, round(tp * 1.0 / pp, 6) AS tpr,
  round(area / (pp * nn * 1.0), 6) AS roc_auc
FROM (SELECT * FROM {curve} UNION ALL SELECT DISTINCT CAST('Infinity' AS DOUBLE), 0, 0, pp, nn, area FROM {curve})""")


@q("roc_auc_from_labels", _roc_sql("prediction"))
def _h9(spark, sf):
    return r6(H.roc_auc_from_labels(scored(spark, sf)), ["fpr", "tpr", "roc_auc"])


@q("roc_curve_from_scores", _roc_sql("score"))
def _h10(spark, sf):
    return r6(H.roc_curve_from_scores(scored(spark, sf)), ["fpr", "tpr", "roc_auc"])


EVAL_SQL = O.with_scored("""SELECT split, n, tp, fp, tn, fn, round((tp + tn) * 1.0 / n, 6) AS accuracy,
  round(p1, 6) AS precision, round(r1, 6) AS recall, round(f1_1, 6) AS f1,
  round((f1_1 + f1_0) / 2, 6) AS macro_f1, round((r1 + r0) / 2, 6) AS auc_hard
FROM (SELECT *, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0.0) AS f1_1,
                coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0.0) AS f1_0
      FROM (SELECT *, coalesce(tp * 1.0 / nullif(tp + fp, 0), 0.0) AS p1, coalesce(tp * 1.0 / nullif(tp + fn, 0), 0.0) AS r1,
                      coalesce(tn * 1.0 / nullif(tn + fn, 0), 0.0) AS p0, coalesce(tn * 1.0 / nullif(tn + fp, 0), 0.0) AS r0
            FROM (SELECT split, CAST(count(*) AS BIGINT) AS n,
                         CAST(count(*) FILTER (WHERE label = 1 AND prediction = 1) AS BIGINT) AS tp,
                         CAST(count(*) FILTER (WHERE label = 0 AND prediction = 1) AS BIGINT) AS fp,
                         CAST(count(*) FILTER (WHERE label = 0 AND prediction = 0) AS BIGINT) AS tn,
                         CAST(count(*) FILTER (WHERE label = 1 AND prediction = 0) AS BIGINT) AS fn
                  FROM scored GROUP BY split)))""")


@q("evaluate_model", EVAL_SQL)
def _h15(spark, sf):
    return r6(H.evaluate_model(scored(spark, sf)),
              ["accuracy", "precision", "recall", "f1", "macro_f1", "auc_hard"])

# ------------------------------------------------------------------ C2 / G3: SMOTE

KNN_VARS = ["heat_temp", "feed_flow", "discount", "size"]


def _knn_sql():
    d2 = " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in KNN_VARS)
    return O.with_lab("t5", f"""SELECT row_id, nn_rank, nn_row_id, round(sqrt(d2), 6) AS distance FROM (
  SELECT row_id, nn_row_id, d2, CAST(row_number() OVER (PARTITION BY row_id ORDER BY d2, nn_row_id) AS INTEGER) AS nn_rank
  FROM (SELECT a.row_id, b.row_id AS nn_row_id, {d2} AS d2 FROM p a JOIN p b ON a.row_id <> b.row_id))
WHERE nn_rank <= 5""", "p AS (SELECT row_id, " + ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in KNN_VARS) +
                      " FROM lab WHERE label = 1)")


@q("nearest_minority_neighbours", _knn_sql())
def _c2(spark, sf):
    from speclab.operators.smote import nearest_neighbours
    pts = lab(spark, sf, "t5").where("label = 1")
    return r6(nearest_neighbours(pts, KNN_VARS), ["distance"])


@q("smote_oversample", O.with_lab("t2", f"""SELECT split,
  CAST(CASE WHEN split = 'val' THEN n_pos ELSE greatest(n_pos, n_neg) END AS BIGINT) AS n_pos,
  CAST(CASE WHEN split = 'val' THEN n_neg ELSE greatest(n_pos, n_neg) END AS BIGINT) AS n_neg
FROM (SELECT split, count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg
      FROM (SELECT l.label, CASE WHEN rn > CAST(ceil(n * 0.3) AS BIGINT) THEN 'train'
                 WHEN rn2 <= CAST(ceil(n2 * 0.5) AS BIGINT) THEN 'val' ELSE 'test' END AS split
            FROM lab l JOIN h USING (row_id) LEFT JOIN (
              SELECT row_id, row_number() OVER (ORDER BY md5(row_id || '|42|b')) AS rn2, count(*) OVER () AS n2
              FROM h WHERE rn <= CAST(ceil(n * 0.3) AS BIGINT)) t USING (row_id)) GROUP BY split)""",
                                     """h AS (SELECT row_id, row_number() OVER (ORDER BY md5(row_id || '|42')) AS rn,
                count(*) OVER () AS n FROM lab)"""))
def _g3(spark, sf):
    from speclab.operators.smote import smote_oversample
    d = G.split_70_15_15(lab(spark, sf, "t2").select("row_id", *KNN_VARS, "label"))
    return D.label_balance(smote_oversample(d, KNN_VARS, "label", splits=("train", "test")))

# ------------------------------------------------------------------ H1-H5, H11-H14, H16, A7, A8: models (rows-only)

MODEL_VARS = ["feed_flow", "heat_temp", "heat_temp_2", "discount", "size", "unit_cost"]
_MEMO: dict = {}


def _model_data(spark, sf):
    key = ("data", spark.sparkContext.applicationId, sf)
    if key not in _MEMO:
        d = G.split_70_15_15(lab(spark, sf, "t2").select("row_id", *MODEL_VARS, "label"))
        from speclab.session import cut_lineage
        _MEMO[key] = cut_lineage(d)
    return _MEMO[key]


def _model(spark, sf, depth):
    key = ("tree", spark.sparkContext.applicationId, sf, depth)
    if key not in _MEMO:
        d = _model_data(spark, sf)
        _MEMO[key] = ML.fit_tree(d.where("split = 'train'"), MODEL_VARS, "label", depth)
    return _MEMO[key]


def _grid(spark, sf):
    """All 45 settings on T2's hand-picked variables."""
    from speclab.operators import trees
    from speclab.session import cut_lineage
    key = ("grid", spark.sparkContext.applicationId, sf)
    if key not in _MEMO:
        train = _model_data(spark, sf).where("split = 'train'")
        _MEMO[key] = trees.full_grid(cut_lineage(G.stratified_folds(train)), MODEL_VARS, MISSING)
    return _MEMO[key]


def _test(spark, sf):
    return _model_data(spark, sf).where("split = 'test'")


@q("tree_default")
def _h1(spark, sf):
    return ML.predict_labels(_model(spark, sf, None), _test(spark, sf))


@q("tree_depth_limited")
def _h2(spark, sf):
    return ML.predict_labels(_model(spark, sf, TARGETS["t2"].max_depth), _test(spark, sf))


@q("tree_shape")
def _h3(spark, sf):
    return ML.tree_shape(spark, _model(spark, sf, TARGETS["t2"].max_depth))


@q("predict_labels")
def _h4(spark, sf):
    return ML.predict_labels(_model(spark, sf, TARGETS["t2"].max_depth), _test(spark, sf)).drop("probability")


@q("predict_probability")
def _h5(spark, sf):
    return ML.predict_labels(_model(spark, sf, TARGETS["t2"].max_depth), _test(spark, sf)) \
        .select("row_id", "probability")


@q("cross_validation_scores")
def _h11(spark, sf):
    train = _model_data(spark, sf).where("split = 'train'")
    from speclab.session import cut_lineage
    return ML.cross_validation_scores(cut_lineage(G.stratified_folds(train)), MODEL_VARS, "label",
                                      max_depth=TARGETS["t2"].max_depth)


@q("grid_search")
def _h12(spark, sf):
    cols = ("max_depth", "min_samples_leaf", "min_samples_split", "mean_accuracy")
    return spark.createDataFrame([tuple(g[c] for c in cols) for g in _grid(spark, sf)],
                                 "max_depth int, min_samples_leaf int, min_samples_split int, mean_accuracy double")


@q("best_params")
def _h13(spark, sf):
    from speclab.operators import trees
    best = trees.best_setting(_grid(spark, sf))
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in best.items()], "param string, value double")


@q("tree_rules")
def _h14(spark, sf):
    """One row a node: its rule, or its class where it is a leaf."""
    from speclab.operators import trees
    nodes = trees.node_table(spark, trees.nodes_of(spark, _model(spark, sf, TARGETS["t2"].max_depth), MODEL_VARS))
    rule = F.when(F.col("feature").isNotNull(), F.concat_ws(" <= ", "feature", F.col("threshold").cast("string"))) \
        .otherwise(F.concat(F.lit("class: "), F.col("prediction").cast("string")))
    return nodes.withColumn("rule", rule)


@q("feature_importance_ranked")
def _f2(spark, sf):
    return ML.feature_importance_ranked(spark, _model(spark, sf, TARGETS["t2"].max_depth), MODEL_VARS)


_TEST_ROWS = O.with_lab("t2", f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_same FROM lab JOIN ({SPLIT70_BODY}) USING (row_id) "
                              "WHERE split = 'test'", SPLIT70_CTE.replace("FROM readings", "FROM lab"))


def _same_scores(spark, sf, other):
    """Test rows, and those to which a stored model gives exactly the scores of the fitted one."""
    mine = ML.predict_labels(_model(spark, sf, TARGETS["t2"].max_depth), _test(spark, sf)).select(
        "row_id", F.col("prediction").alias("_p"), F.col("probability").alias("_q"))
    both = mine.join(other, "row_id", "left")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("_p") == F.col("prediction")) & (F.col("_q") == F.col("probability"))).alias("n_same"))


@q("save_model", _TEST_ROWS)
def _a7(spark, sf):
    """The stored files, read as Spark stores them and walked as a node table, score as the fitted model does."""
    from speclab.operators import trees
    path = A.save_model(_model(spark, sf, TARGETS["t2"].max_depth), scratch_path(spark, "model"))
    nodes = trees.nodes_of(spark, A.load_model(path), MODEL_VARS)
    return _same_scores(spark, sf, trees.score_nodes(_test(spark, sf), nodes, MODEL_VARS, MISSING))


@q("load_model", _TEST_ROWS)
def _a8(spark, sf):
    """A model saved and loaded scores as the fitted one does."""
    path = A.save_model(_model(spark, sf, TARGETS["t2"].max_depth), scratch_path(spark, "model"))
    return _same_scores(spark, sf, ML.predict_labels(A.load_model(path), _test(spark, sf)))


@q("validate_model")
def _h16(spark, sf):
    m = A.load_model(A.save_model(_model(spark, sf, TARGETS["t2"].max_depth), scratch_path(spark, "model")))
    val = ML.predict_labels(m, _model_data(spark, sf).where("split = 'val'"))
    from speclab.plans.pipelines import _melted
    out = (_melted(H.accuracy(val), "accuracy", F.lit("all"))
           .unionByName(_melted(H.confusion_matrix(val), "confusion_matrix", F.concat_ws("/", F.col("actual"), F.col("predicted"))))
           .unionByName(_melted(H.classification_report(val), "classification_report", F.col("row_label")))
           .unionByName(_melted(H.roc_curve_from_scores(val, "label", "probability"), "roc_curve", F.col("threshold").cast("string"))))
    return r6(out, ["value"])

# ------------------------------------------------------------------ P: pipelines


def _prep(spark, sf, t):
    key = ("prep", spark.sparkContext.applicationId, sf, t)
    if key not in _MEMO:
        _MEMO[key] = preprocess(spark, sf, TARGETS[t])
    return _MEMO[key]


def _pre_sql(t):
    """Every labelled row with its split: 80 / 20 for T1 and T4, 70 / 15 / 15 for the others. The
    steps are the null rule, code maps, label and split; nothing else removes a row."""
    if TARGETS[t].split == "80_20":
        return O.with_lab(t, """SELECT row_id, CAST(label AS INTEGER) AS label,
  CASE WHEN rn <= CAST(ceil(n * 0.2) AS BIGINT) THEN 'val' ELSE 'train' END AS split
FROM (SELECT row_id, label, row_number() OVER (ORDER BY md5(row_id || '|42')) AS rn, count(*) OVER () AS n FROM lab)""")
    return O.with_lab(t, f"SELECT row_id, CAST(label AS INTEGER) AS label, split FROM lab JOIN ({SPLIT70_BODY}) USING (row_id)",
                      SPLIT70_CTE.replace("FROM readings", "FROM lab"))


def _balance_sql(t):
    """Rows of each class and split after balancing train and test."""
    return O.with_lab(t, f"""SELECT split, CAST(CASE WHEN split = 'val' THEN n_pos ELSE greatest(n_pos, n_neg) END AS BIGINT) AS n_pos,
  CAST(CASE WHEN split = 'val' THEN n_neg ELSE greatest(n_pos, n_neg) END AS BIGINT) AS n_neg
FROM (SELECT split, count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg
      FROM lab JOIN ({SPLIT70_BODY}) USING (row_id) GROUP BY split)""", SPLIT70_CTE.replace("FROM readings", "FROM lab"))


def _reg_pre(t):
    @q(f"preprocess_{t}", _pre_sql(t))
    def _p(spark, sf):
        """The rows of the input (synthetic rows are counted by ``preprocess_balance``)."""
        return _prep(spark, sf, t).df.where("not synthetic").select("row_id", F.col("label").cast("int").alias("label"), "split")

    if TARGETS[t].smote:
        @q(f"preprocess_balance_{t}", _balance_sql(t))
        def _b(spark, sf):
            return D.label_balance(_prep(spark, sf, t).df)


for _t in ("t1", "t2", "t3", "t4", "t5", "t6"):
    _reg_pre(_t)

T1_VARS = ["order_no", "batch_source", "method", "swirl", "feed_flow", "heat_temp", "discount", "tax_text",
           "size", "unit_cost"]


REPORT_VARS = {"t1": T1_VARS, "t2": NUMERIC_VARS[:-1] + ["swirl"], "t3": NUMERIC_VARS[:-1] + ["swirl"],
               "t4": T1_VARS, "t5": NUMERIC_VARS[:-1] + ["swirl"], "t6": NUMERIC_VARS[:-1] + ["swirl"]}
REPORT_SQLS = {
    "class_distribution": lambda t: _class_sql(t),
    "numeric_statistics": lambda t: O.numeric_statistics_sql((O.LAB_CTES[t],), "lab", REPORT_VARS[t], O.with_readings),
    "grouped_statistics": lambda t: _grouped_sql(t, REPORT_VARS[t]),
    "boxplot_summary": lambda t: _box_sql(t, REPORT_VARS[t]),
}


def _descriptive(spark, sf, table):
    """One stage-02 table of all six targets."""
    from speclab.plans.pipelines import descriptive_report
    out = None
    for t in TARGETS:
        key = ("descriptive", spark.sparkContext.applicationId, sf, t)
        if key not in _MEMO:
            _MEMO[key] = descriptive_report(lab(spark, sf, t), REPORT_VARS[t])
        part = _MEMO[key][table].withColumn("target", F.lit(t))
        out = part if out is None else out.unionByName(part)
    return out


def _reg_descriptive(table):
    @q(f"descriptive_{table}", "\nUNION ALL ".join(f"SELECT *, '{t}' AS target FROM ({REPORT_SQLS[table](t)})" for t in TARGETS))
    def _p(spark, sf):
        return _descriptive(spark, sf, table)


for _table in REPORT_SQLS:
    _reg_descriptive(_table)


@q("descriptive_report", O.numeric_statistics_sql((O.LAB_CTES["t1"],), "lab", T1_VARS,
                                                  O.with_readings))
def _p7(spark, sf):
    from speclab.plans.pipelines import descriptive_report
    return descriptive_report(lab(spark, sf, "t1"), T1_VARS)["numeric_statistics"]


def _trained(spark, sf, t):
    from speclab.plans.pipelines import train_report
    key = ("trained", spark.sparkContext.applicationId, sf, t)
    if key not in _MEMO:
        _MEMO[key] = train_report(_prep(spark, sf, t))
    return _MEMO[key]


@q("train_report")
def _p8(spark, sf):
    """Accuracy, confusion cells and class metrics of T2's chosen tree on train and test."""
    return _trained(spark, sf, "t2").tables["evaluation"]


@q("validation_report")
def _p9(spark, sf):
    from speclab.plans.pipelines import validation_report
    return r6(validation_report(spark, _trained(spark, sf, "t2"), _prep(spark, sf, "t2")), ["value"])


def _reg_stages(t):
    @q(f"train_report_{t}")
    def _train(spark, sf):
        return r6(_trained(spark, sf, t).tables["report"], ["value"])

    @q(f"tree_nodes_{t}")
    def _nodes(spark, sf):
        return _trained(spark, sf, t).tables["rules"]

    @q(f"validation_report_{t}")
    def _validate(spark, sf):
        from speclab.plans.pipelines import validation_report
        return r6(validation_report(spark, _trained(spark, sf, t), _prep(spark, sf, t)), ["value"])


for _t in ("t2", "t3", "t5", "t6"):
    _reg_stages(_t)

from speclab.plans import insights  # noqa: E402,F401  (registers its queries)
