"""Registered queries of the analysis steps after the stages (X1-X13): rank correlation, components, regression,
trade-offs, dependence, scenarios, imputation, limits, histograms, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from speclab.functions import scalar as S
from speclab.operators import ensembles, gram, impute, limits, metrics, scenarios, skyline, trees
from speclab.operators import profile as D
from speclab.operators import split as G
from speclab.plans import oracle_sql as O
from speclab.plans.catalog import CORR_VARS, MODEL_VARS, SPLIT70_BODY, SPLIT70_CTE, R, _model_data, lab, q, r6
from speclab.plans.targets import MISSING, TARGETS
from speclab.session import cut_lineage

# ------------------------------------------------------------------ X4, X6, X7: moments


def _spearman_sql(cols):
    pairs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i < j:
                inner = f"""SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
  rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM readings WHERE {a} IS NOT NULL AND {b} IS NOT NULL"""
                pairs.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {i} AS pos_a, {j} AS pos_b, corr(ra, rb) AS r FROM ({inner})")
    ones = " UNION ALL ".join(f"SELECT '{c}', '{c}', {i}, {i}, 1.0" for i, c in enumerate(cols))
    return O.with_readings(f"""SELECT col_a, col_b, CAST(pos_a AS INTEGER) AS pos_a, CAST(pos_b AS INTEGER) AS pos_b, round(r, 6) AS r FROM (
  SELECT * FROM p UNION ALL SELECT col_b, col_a, pos_b, pos_a, r FROM p UNION ALL {ones})""", "p AS (" + " UNION ALL ".join(pairs) + ")")


@q("spearman_matrix", _spearman_sql(CORR_VARS))
def _x4(spark, sf):
    return r6(gram.spearman_matrix(R(spark, sf), CORR_VARS), ["r"])


PCA_VARS = ["feed_flow", "heat_temp", "heat_temp_2", "discount", "size", "unit_cost"]


def _complete(cols):
    return "d AS (SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols) + " FROM readings WHERE " + \
        " AND ".join(f"{c} IS NOT NULL" for c in cols) + ")"


@q("pca_components")
def _x6(spark, sf):
    return r6(gram.Components(R(spark, sf), PCA_VARS).table(spark), ["loading", "variance", "share"])


@q("pca_features")
def _x6_scores(spark, sf):
    rows = R(spark, sf)
    return r6(gram.Components(rows, PCA_VARS).scores(rows, ["row_id"], 3), ["pc1", "pc2", "pc3"])


@q("pca_reconstruction", O.with_readings(" UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS value FROM d" for a in PCA_VARS for b in PCA_VARS),
    _complete(PCA_VARS)))
def _x6_back(spark, sf):
    """The matrix the components came from, put together again from them (its oracle reads the rows)."""
    t = gram.Components(R(spark, sf), PCA_VARS).table(spark)
    other = t.select("component", F.col("column_name").alias("col_b"), F.col("loading").alias("other"))
    back = t.join(other, "component").groupBy(F.col("column_name").alias("col_a"), "col_b").agg(
        F.sum(F.col("variance") * F.col("loading") * F.col("other")).alias("value"))
    return r6(back, ["value"])


REGRESSION = ("heat_temp", ["feed_flow", "unit_cost"])


def _regression_sql(y, x1, x2):
    return O.with_readings(f"""SELECT term, round(coefficient, 6) AS coefficient, round(std_error, 6) AS std_error,
  round(coefficient / std_error, 6) AS t_value, n, n - 3 AS dof, round(1 - sse / syy, 6) AS r2, round(sqrt(sse / (n - 3)), 6) AS residual_sd
FROM (
  SELECT 'intercept' AS term, my - b1 * m1 - b2 * m2 AS coefficient,
    sqrt(sse / (n - 3) * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det)) AS std_error, * FROM b
  UNION ALL SELECT '{x1}', b1, sqrt(sse / (n - 3) * s22 / det), * FROM b
  UNION ALL SELECT '{x2}', b2, sqrt(sse / (n - 3) * s11 / det), * FROM b)""", _complete([y, x1, x2]),
                           f"""s AS (
  SELECT count(*) AS n, avg({x1}) AS m1, avg({x2}) AS m2, avg({y}) AS my, var_pop({x1}) * count(*) AS s11, var_pop({x2}) * count(*) AS s22,
    covar_pop({x1}, {x2}) * count(*) AS s12, covar_pop({x1}, {y}) * count(*) AS s1y, covar_pop({x2}, {y}) * count(*) AS s2y,
    var_pop({y}) * count(*) AS syy FROM d)""",
                           """a AS (
  SELECT *, s11 * s22 - s12 * s12 AS det, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1,
    (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s)""", "b AS (SELECT *, syy - b1 * s1y - b2 * s2y AS sse FROM a)")


@q("linear_regression", _regression_sql(REGRESSION[0], *REGRESSION[1]))
def _x7(spark, sf):
    return r6(gram.linear_regression(R(spark, sf), *REGRESSION), ["coefficient", "std_error", "t_value", "r2", "residual_sd"])


@q("linear_regression_label")
def _x7_label(spark, sf):
    """Linear probability of T2's label on all model variables; heat_temp_2 nearly repeats heat_temp."""
    return r6(gram.linear_regression(lab(spark, sf, "t2"), "label", MODEL_VARS), ["coefficient", "std_error", "t_value", "r2", "residual_sd"])

# ------------------------------------------------------------------ X5, X11


@q("derived_features", O.with_readings("""SELECT row_id, round(heat_temp_2 - heat_temp, 6) AS heat_difference,
  CASE WHEN feed_flow <> 0 THEN round(heat_temp / feed_flow, 6) END AS heat_per_flow,
  CASE WHEN size <> 0 THEN round(unit_cost / size, 6) END AS cost_per_size FROM readings"""))
def _x5(spark, sf):
    out = R(spark, sf).select("row_id", (F.col("heat_temp_2") - F.col("heat_temp")).alias("heat_difference"),
                              F.try_divide("heat_temp", "feed_flow").alias("heat_per_flow"),
                              F.try_divide("unit_cost", F.col("size").cast("double")).alias("cost_per_size"))
    return r6(out, ["heat_difference", "heat_per_flow", "cost_per_size"])


OBJECTIVES = {"feed_flow": "max", "discount": "min", "heat_temp": "min"}


def _beats(a, b):
    sides = [(f"{a}.{c}", f"{b}.{c}") if way == "min" else (f"{b}.{c}", f"{a}.{c}") for c, way in OBJECTIVES.items()]
    return " AND ".join(f"{x} <= {y}" for x, y in sides) + " AND (" + " OR ".join(f"{x} < {y}" for x, y in sides) + ")"


@q("multi_objective_tradeoff", O.with_readings(
    f"SELECT row_id, {', '.join(OBJECTIVES)} FROM p a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE {_beats('b', 'a')})",
    f"p AS (SELECT row_id, {', '.join(OBJECTIVES)} FROM readings WHERE feed_flow IS NOT NULL)",
    f"v AS (SELECT feed_flow, discount, min(heat_temp) AS heat_temp FROM p GROUP BY ALL)"))
def _x11(spark, sf):
    """The best heat for each flow and discount is all that can beat a row; the SQL uses that."""
    return skyline.multi_objective_tradeoff(R(spark, sf).select("row_id", *OBJECTIVES), OBJECTIVES)

# ------------------------------------------------------------------ X1-X3, X13: data preparation and distribution

IMPUTED = ["feed_flow", "tax_text"]


@q("impute_missing", O.with_readings(
    "SELECT row_id, split, " + ", ".join(f"round(coalesce(TRY_CAST(v.{c} AS DOUBLE), g.{c}, o.{c}), 6) AS {c}" for c in IMPUTED) +
    " FROM v LEFT JOIN g ON g.test_code = v.test_code, o", SPLIT70_CTE, f"sp AS ({SPLIT70_BODY})",
    "v AS (SELECT readings.*, split FROM readings JOIN sp USING (row_id))",
    "g AS (SELECT test_code, " + ", ".join(f"quantile_cont(TRY_CAST({c} AS DOUBLE), 0.5) AS {c}" for c in IMPUTED) + " FROM v WHERE split = 'train' GROUP BY 1)",
    "o AS (SELECT " + ", ".join(f"quantile_cont(TRY_CAST({c} AS DOUBLE), 0.5) AS {c}" for c in IMPUTED) + " FROM v WHERE split = 'train')"))
def _x2(spark, sf):
    rows = G.split_70_15_15(R(spark, sf).select("row_id", "test_code", *IMPUTED))
    medians = cut_lineage(impute.fit_medians(rows.where("split = 'train'"), IMPUTED, "test_code"))
    return r6(impute.impute_missing(rows, medians, IMPUTED, "test_code").select("row_id", "split", *IMPUTED), IMPUTED)


LIMITED_SQL = """r AS (SELECT l_orderkey, l_linenumber, l_returnflag AS test, CAST(l_shipdate AS DATE) AS day, 0.40 + l_tax + l_discount AS value FROM lineitem),
p AS (SELECT test, CAST(date_trunc('quarter', day) AS DATE) AS valid_from, CAST(date_trunc('quarter', day) + INTERVAL 4 MONTH AS DATE) AS valid_to,
        (min(value) + max(value)) / 2 AS target, min(value) + 0.03 AS low, max(value) - 0.03 AS high
      FROM r WHERE quarter(day) <> 2 GROUP BY ALL)"""


@q("spec_limits", f"""WITH {LIMITED_SQL},
b AS (SELECT r.test, r.day, max(valid_from) AS valid_from FROM (SELECT DISTINCT test, day FROM r) r JOIN p ON p.test = r.test AND r.day >= valid_from AND r.day < valid_to GROUP BY ALL)
SELECT l_orderkey, l_linenumber, r.test, round(value, 6) AS value, round(target, 6) AS target, round(low, 6) AS low, round(high, 6) AS high,
  CASE WHEN p.test IS NOT NULL THEN value >= low AND value <= high END AS in_spec, round(value - target, 6) AS off_target
FROM r LEFT JOIN b ON b.test = r.test AND b.day = r.day LEFT JOIN p ON p.test = b.test AND p.valid_from = b.valid_from""")
def _x1(spark, sf):
    """Results against the limits of their quarter, which run one month into the next; second quarters set none of their own."""
    day = F.col("l_shipdate").cast("date")
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("test"), day.alias("day"),
                                                               (F.lit(0.40).cast("double") + F.col("l_tax") + F.col("l_discount")).alias("value"))
    start = F.trunc("day", "quarter")
    periods = rows.where(F.quarter("day") != 2).groupBy("test", start.alias("valid_from")).agg(F.min("value").alias("a"), F.max("value").alias("b")).select(
        "test", "valid_from", F.add_months("valid_from", 4).alias("valid_to"), ((F.col("a") + F.col("b")) / 2).alias("target"),
        (F.col("a") + 0.03).alias("low"), (F.col("b") - 0.03).alias("high"))
    out = limits.spec_limits(rows, periods, "test", "day", "value").drop("day")
    return r6(out, ["value", "target", "low", "high", "off_target"])


HIST_VARS = ["feed_flow", "heat_temp", "discount", "tax_text", "size", "unit_cost"]


@q("histogram", O.with_readings("""SELECT g.variable, CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * ((hi - lo) / 10), 6) AS lower, round(lo + (g.bin + 1) * ((hi - lo) / 10), 6) AS upper,
  CAST(coalesce(n, 0) AS BIGINT) AS n
FROM (SELECT variable, lo, hi, unnest(range(10)) AS bin FROM e) g LEFT JOIN (
  SELECT v.variable, least(9, CAST(floor((value - lo) * 10 / (hi - lo)) AS INTEGER)) AS bin, count(*) AS n
  FROM v JOIN e ON e.variable = v.variable GROUP BY ALL) c ON c.variable = g.variable AND c.bin = g.bin""",
    f"v AS (SELECT * FROM ({O.melt_sql('readings', HIST_VARS)}) WHERE value IS NOT NULL)",
    "e AS (SELECT variable, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo, "
    "CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi FROM v GROUP BY variable)"))
def _x3(spark, sf):
    return r6(limits.histogram(R(spark, sf), HIST_VARS), ["lower", "upper"])


@q("contrast_products", O.with_readings("""SELECT product, variable, round(min(value), 2) AS min_value, round(max(value), 2) AS max_value,
  round(avg(value), 2) AS mean_value, round(quantile_cont(value, 0.5), 2) AS median_value FROM v WHERE value IS NOT NULL GROUP BY product, variable""",
    f"v AS ({O.melt_sql('readings', ['feed_flow', 'heat_temp', 'size'], ['product'])})"))
def _x13(spark, sf):
    return D.grouped_statistics(R(spark, sf), "product", ["feed_flow", "heat_temp", "size"])

# ------------------------------------------------------------------ X8-X10, X12: models, scenarios, history


def _prepared(spark, sf):
    """T2's split rows, missing features filled with the training medians."""
    rows = _model_data(spark, sf)
    medians = cut_lineage(impute.fit_medians(rows.where("split = 'train'"), MODEL_VARS))
    return cut_lineage(impute.impute_missing(rows, medians, MODEL_VARS))


def _tree(rows):
    from speclab.operators import models as ML
    spark = rows.sparkSession
    return trees.nodes_of(spark, ML.fit_tree(rows.where("split = 'train'"), MODEL_VARS, "label", 8, min_leaf=20), MODEL_VARS)


@q("forest_report")
def _x8_forest(spark, sf):
    """Ten trees on T2: accuracy out of bag on train, and on the other splits."""
    rows = _prepared(spark, sf)
    train = rows.where("split = 'train'")
    table = ensembles.fit_forest(train, MODEL_VARS, max_depth=TARGETS["t2"].max_depth)
    oob = ensembles.out_of_bag(train, table, MODEL_VARS, MISSING).where("votes > 0").withColumn("split", F.lit("out_of_bag"))
    scored = ensembles.score(rows.where("split != 'train'"), table, MODEL_VARS, MISSING, keep=("split", "label"))
    return metrics.evaluate_model(scored.unionByName(oob.select("split", "label", "prediction", "probability")))


@q("forest_nodes")
def _x8_nodes(spark, sf):
    train = _prepared(spark, sf).where("split = 'train'")
    return ensembles.node_table(spark, ensembles.fit_forest(train, MODEL_VARS, count=3, max_depth=TARGETS["t2"].max_depth))


@q("boosted_report")
def _x8_boosted(spark, sf):
    rows = _prepared(spark, sf)
    table = ensembles.fit_boosted(rows.where("split = 'train'"), MODEL_VARS)
    return metrics.evaluate_model(ensembles.score(rows, table, MODEL_VARS, MISSING, boosted=True, keep=("split", "label")))


@q("partial_dependence")
def _x9(spark, sf):
    rows = _prepared(spark, sf)
    scorer = ensembles.Scorer(ensembles.from_nodes(_tree(rows)), MODEL_VARS)
    grid = scenarios.quantile_grid(rows, MODEL_VARS, [i / 10 for i in range(11)])
    return r6(scenarios.partial_dependence(rows, scorer, grid, MISSING), ["value", "dependence"])


@q("scenario_grid_search")
def _x10(spark, sf):
    """The ten best settings of a lattice of five quantiles a variable between the 5 % and 95 % points."""
    rows = _prepared(spark, sf)
    scorer = ensembles.Scorer(ensembles.from_nodes(_tree(rows)), MODEL_VARS)
    return scenarios.scenario_grid_search(spark, scorer, scenarios.quantile_grid(rows, MODEL_VARS, [0.05, 0.275, 0.5, 0.725, 0.95]))


def _best_boxes(rows, k=10):
    grid = scenarios.quantile_grid(rows, MODEL_VARS, [0.05, 0.95])
    return scenarios.leaf_boxes(_tree(rows), {f: (v[0], v[-1]) for f, v in grid.items()}, k, least_rows=20)


@q("scenario_boxes")
def _x10_boxes(spark, sf):
    return scenarios.box_table(spark, _best_boxes(_prepared(spark, sf)))


@q("scenario_validation")
def _x12_boxes(spark, sf):
    """Held-out rows inside the best box of the tree against those outside."""
    rows = _prepared(spark, sf)
    held = rows.where("split != 'train'")
    return scenarios.historical_validation(held, scenarios.inside(_best_boxes(rows, 1)[0]["box"]))


SETTINGS = ["feed_flow", "heat_temp"]


@q("historical_validation", O.with_lab("t5", """SELECT n_inside, good_inside, round(p, 6) AS share_inside, n_outside, good_outside, round(q, 6) AS share_outside,
  round(p - q, 6) AS difference, round(p - q - sqrt(power(p - lp, 2) + power(uq - q, 2)), 6) AS lower, round(p - q + sqrt(power(up - p, 2) + power(q - lq, 2)), 6) AS upper
FROM (SELECT *, (p + z2 / (2 * n_inside) - z * sqrt(p * (1 - p) / n_inside + z2 / (4.0 * n_inside * n_inside))) / (1 + z2 / n_inside) AS lp,
    (p + z2 / (2 * n_inside) + z * sqrt(p * (1 - p) / n_inside + z2 / (4.0 * n_inside * n_inside))) / (1 + z2 / n_inside) AS up,
    (q + z2 / (2 * n_outside) - z * sqrt(q * (1 - q) / n_outside + z2 / (4.0 * n_outside * n_outside))) / (1 + z2 / n_outside) AS lq,
    (q + z2 / (2 * n_outside) + z * sqrt(q * (1 - q) / n_outside + z2 / (4.0 * n_outside * n_outside))) / (1 + z2 / n_outside) AS uq
  FROM (SELECT *, good_inside * 1.0 / n_inside AS p, good_outside * 1.0 / n_outside AS q, 1.959963984540054 AS z, 1.959963984540054 * 1.959963984540054 AS z2 FROM t))""",
    "e AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.25) AS lo_{c}, quantile_cont({c}, 0.75) AS hi_{c}" for c in SETTINGS) + " FROM lab WHERE label = 1)",
    "m AS (SELECT label, " + " AND ".join(f"{c} BETWEEN lo_{c} AND hi_{c}" for c in SETTINGS) + " AS inside FROM lab, e)",
    "t AS (SELECT count(*) FILTER (WHERE inside) AS n_inside, count(*) FILTER (WHERE inside AND label = 1) AS good_inside, "
    "count(*) FILTER (WHERE NOT inside) AS n_outside, count(*) FILTER (WHERE NOT inside AND label = 1) AS good_outside FROM m)"))
def _x12(spark, sf):
    """T5's rows whose settings lie in the middle half of the in-spec rows' settings, against the others."""
    rows = lab(spark, sf, "t5")
    grid = scenarios.quantile_grid(rows.where("label = 1"), SETTINGS, [0.25, 0.75])
    out = scenarios.historical_validation(rows, scenarios.inside({f: (v[0], v[-1]) for f, v in grid.items()}, closed=True))
    return r6(out, ["share_inside", "share_outside", "difference", "lower", "upper"])
