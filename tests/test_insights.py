"""Rank correlation, components, regression, trade-offs, ensembles, scenarios, imputation, limits: brute force and edges."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from speclab.operators import ensembles, gram, impute, limits, scenarios, select, skyline, trees
from speclab.operators import models as ML

XY = "a double, b double, c double, d double"


def table(spark, rows, schema=XY):
    return spark.createDataFrame(rows, schema)


def noisy(n, seed, holes=0.1):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a = r.choice([1.0, 2.0, 2.0, 3.5, r.gauss(5, 2)])
        row = [a, a * 2 + r.gauss(0, 1), float(r.randint(0, 3)), 7.0]
        out.append(tuple(None if r.random() < holes and i < 3 else v for i, v in enumerate(row)))
    return out


# ---- pair moments

def pearson(x, y):
    x, y = np.array(x), np.array(y)
    if len(x) < 2 or x.std() == 0 or y.std() == 0:
        return None
    return float(np.corrcoef(x, y)[0, 1])


def ranks(x):
    return [sum(v < w for v in x) + (sum(v == w for v in x) + 1) / 2 for w in x]


def check_matrix(got, rows, cols, how):
    cells = {(r["col_a"], r["col_b"]): r["r"] for r in got.collect()}
    assert len(cells) == len(cols) ** 2
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None and not math.isnan(r[i]) and not math.isnan(r[j])]
            want = how([p[0] for p in both], [p[1] for p in both])
            got_ = cells[(a, b)]
            assert (got_ is None) == (want is None), (a, b)
            assert want is None or abs(got_ - want) < 1e-9, (a, b, got_, want)


def test_pearson_and_spearman_by_brute_force(spark):
    rows = noisy(400, 1) + [(float("nan"), 1.0, 1.0, 7.0), (None, None, None, None), (0.0, -0.0, 0.0, 7.0), (-0.0, 0.0, 0.0, 7.0)]
    df = table(spark, rows).repartition(5)
    check_matrix(select.correlation_matrix(df, list("abcd")), rows, list("abcd"), pearson)
    check_matrix(gram.spearman_matrix(df, list("abcd")), rows, list("abcd"), lambda x, y: pearson(ranks(x), ranks(y)))
    upper = gram.spearman_matrix(df, list("abcd"), full=False).collect()
    assert sorted((r["pos_a"], r["pos_b"]) for r in upper) == list(itertools.combinations(range(4), 2))


def test_correlation_keeps_its_digits_far_from_zero(spark):
    rows = [(1e9 + x, 1e9 - 2 * x + y, 0.0, 0.0) for x, y in ((random.Random(i).random(), random.Random(i + 999).random()) for i in range(300))]
    got = {(r["col_a"], r["col_b"]): r["r"] for r in select.correlation_matrix(table(spark, rows), ["a", "b"]).collect()}
    assert abs(got[("a", "b")] - pearson([r[0] for r in rows], [r[1] for r in rows])) < 1e-6


def test_matrices_of_nothing(spark):
    none = table(spark, [])
    for fn in (select.correlation_matrix, gram.spearman_matrix):
        assert all(r["r"] is None for r in fn(none, ["a", "b"]).collect())
        assert all(r["r"] is None for r in fn(table(spark, [(1.0, 2.0, 3.0, 4.0)]), ["a", "b"]).collect())


def test_correlation_is_one_scan_of_many_columns(spark):
    wide = spark.range(500).select(*[((F.col("id") * (i + 3)) % (11 + i)).cast("double").alias(f"c{i}") for i in range(60)])
    cols = wide.columns
    df = select.correlation_matrix(wide, cols)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Range" not in plan          # derived from the written task sums, rows are not read again
    x = np.array([tuple(r) for r in wide.collect()])
    want = np.corrcoef(x.T)
    assert all(abs(r["r"] - want[r["pos_a"], r["pos_b"]]) < 1e-9 for r in df.collect())


def test_components_by_numpy(spark):
    rows = noisy(300, 2)
    full = np.array([r for r in rows if None not in r])
    for scaled in (True, False):
        comp = gram.Components(table(spark, rows).repartition(3), list("abcd"), scaled)
        unit = np.where(full.std(0, ddof=1) > 1e-9, full.std(0, ddof=1), 1) if scaled else np.ones(4)
        z = (full - full.mean(0)) / unit
        value = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
        assert np.allclose(comp.variance, value, atol=1e-9)
        assert np.allclose(comp.loading.T @ comp.loading, np.eye(4), atol=1e-9)
        assert np.allclose(comp.loading @ np.diag(comp.variance) @ comp.loading.T, np.cov(z.T), atol=1e-9)
        assert all(col[np.argmax(np.round(np.abs(col), 9))] > 0 for col in comp.loading.T)
        got = comp.scores(table(spark, rows), [], 4).collect()
        back = np.array([tuple(r) for r in got if r["pc1"] is not None])
        assert len(back) == len(full) and np.allclose(back @ comp.loading.T, z, atol=1e-9)      # nothing is lost
        assert sum(r["pc1"] is None for r in got) == len(rows) - len(full)
    assert len(gram.Components(table(spark, []), ["a", "b"]).table(spark).collect()) == 4


def test_regression_by_numpy(spark):
    r = random.Random(3)
    rows = [(x, z, 2 * x - 0.5 * z + 3 + r.gauss(0, 0.3), 2 * x + z) for x, z in ((r.gauss(100, 5), r.random()) for _ in range(200))]
    got = {t["term"]: t for t in gram.linear_regression(table(spark, rows + [(None, 1.0, 2.0, 3.0)]), "c", ["a", "b", "d"]).collect()}
    x = np.array([(1.0, p[0], p[1]) for p in rows])
    y = np.array([p[2] for p in rows])
    beta, sse = np.linalg.lstsq(x, y, rcond=None)[:2]
    s2 = sse[0] / (len(rows) - 3)
    error = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * s2)
    for i, term in enumerate(("intercept", "a", "b")):
        assert abs(got[term]["coefficient"] - beta[i]) < 1e-6 and abs(got[term]["std_error"] - error[i]) < 1e-6
    assert got["d"]["coefficient"] is None and got["d"]["n"] == 200 and got["d"]["dof"] == 197      # a and b explain it
    assert abs(got["a"]["r2"] - (1 - sse[0] / ((y - y.mean()) ** 2).sum())) < 1e-9


def test_regression_without_enough_rows(spark):
    none = gram.linear_regression(table(spark, []), "c", ["a"]).collect()
    assert all(r["coefficient"] is None and r["std_error"] is None and r["n"] == 0 for r in none)
    two = {r["term"]: r for r in gram.linear_regression(table(spark, [(1.0, 0.0, 2.0, 0.0), (2.0, 0.0, 4.0, 0.0)]), "c", ["a", "b"]).collect()}
    assert two["b"]["coefficient"] is None and two["intercept"]["n"] == 2
    one = {r["term"]: r for r in gram.linear_regression(table(spark, [(1.0, 5.0, 2.0, 0.0)] * 4), "c", ["a", "b"]).collect()}
    assert one["a"]["coefficient"] is None and one["intercept"]["coefficient"] == 2.0


# ---- trade-offs

def brute_skyline(rows, ways):
    turned = [tuple(v if w == "min" else -v for v, w in zip(r, ways)) for r in rows]
    points = set(turned)
    keep = {p for p in points if not any(q != p and all(x <= y for x, y in zip(q, p)) for q in points)}
    return sorted(r for r, t in zip(rows, turned) if t in keep)


@pytest.mark.parametrize("levels", [4, 1000])
def test_skyline_by_brute_force(spark, levels):
    r = random.Random(levels)
    rows = [tuple(float(r.randint(0, levels)) for _ in range(3)) for _ in range(700)]
    rows += rows[:200] + [(0.0, -0.0, 5.0), (0.0, 0.0, 5.0)]
    ways = ["min", "max", "min"]
    df = spark.createDataFrame(rows, "x double, y double, z double").repartition(7)
    got = skyline.multi_objective_tradeoff(df, dict(zip("xyz", ways)), partitions=20).collect()
    assert sorted(tuple(g) for g in got) == brute_skyline(rows, ways)


def test_skyline_of_many_rows(spark):
    rows = spark.range(100_000).select("id", *[(F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1 << 20)) / (1 << 20)).alias(f"o{s}") for s in range(3)])
    got = {r["id"] for r in skyline.multi_objective_tradeoff(rows, {"o0": "min", "o1": "min", "o2": "max"}).collect()}
    p = rows.toPandas()
    x = np.stack([p["o0"], p["o1"], -p["o2"]], 1)
    order = np.argsort(x.sum(1))
    window = np.zeros((0, 3))
    for i in order:
        if not (window <= x[i]).all(1).any():
            window = np.concatenate([window, x[i:i + 1]])
            assert p["id"][i] in got
        else:
            assert p["id"][i] not in got
    assert len(got) == len(window)


def test_skyline_edges(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, float("nan"), 1.0), (3, 2.0, 2.0), (3, 2.0, 2.0), (4, 2.0, 3.0)], "_o0 int, x double, y double").withColumnRenamed("_o0", "id")
    got = skyline.multi_objective_tradeoff(df, {"x": "min", "y": "min"})
    assert got.columns == ["id", "x", "y"] and sorted(r["id"] for r in got.collect()) == [3, 3]
    assert skyline.multi_objective_tradeoff(df.limit(0), {"x": "min"}).count() == 0
    # all in one front: every row stays
    front = spark.range(3000).select(F.col("id").cast("double").alias("x"), (-F.col("id")).cast("double").alias("y"))
    assert skyline.multi_objective_tradeoff(front, {"x": "min", "y": "min"}).count() == 3000
    with pytest.raises(ValueError):
        skyline.multi_objective_tradeoff(df, {"x": "best"})


# ---- ensembles and scenarios

FEATS = ["x", "y"]


@pytest.fixture(scope="module")
def sample(spark):
    r = random.Random(6)
    rows = []
    for i in range(600):
        x, y = round(r.random() * 10, 1), r.randint(0, 5) * 1.0
        rows.append((f"k{i}", x, None if r.random() < 0.05 else y, int((x > 4 and y < 3) != (r.random() < 0.1))))
    return spark.createDataFrame(rows, "row_id string, x double, y double, label int").fillna(-1.0, subset=FEATS).repartition(3).cache()


def walk(table, t, row):
    nodes = {r["id"]: r for r in table if r["tree"] == t}
    at = nodes[0]
    while at["left"] is not None:
        at = nodes[at["left"] if row[at["feature"]] <= at["threshold"] else at["right"]]
    return at["value"]


def test_forest_replay_and_out_of_bag(spark, sample):
    table = ensembles.fit_forest(sample, FEATS, count=4, max_depth=4)
    stored = [r.asDict() for r in ensembles.node_table(spark, table).collect()]
    rows = {r["row_id"]: r for r in sample.collect()}
    scored = ensembles.score(sample, stored, FEATS, -1.0, keep=["row_id"]).collect()
    assert len(scored) == len(rows)
    for s in scored[:80]:
        assert abs(s["probability"] - np.mean([walk(table, t, rows[s["row_id"]]) for t in range(4)])) < 1e-12
    weights = {r["row_id"]: [r[f"w{t}"] for t in range(4)] for r in
               sample.select("row_id", *[ensembles.bootstrap_weight("row_id", t).alias(f"w{t}") for t in range(4)]).collect()}
    drawn = np.array(list(weights.values()))
    assert 0.85 < drawn.mean() < 1.15 and 0.3 < (drawn == 0).mean() < 0.43       # about 1 / e stay out
    for o in ensembles.out_of_bag(sample, table, FEATS, -1.0).collect():
        out = [t for t in range(4) if weights[o["row_id"]][t] == 0]
        assert o["votes"] == len(out)
        assert (o["probability"] is None) == (not out)
        if out:
            assert abs(o["probability"] - np.mean([walk(table, t, rows[o["row_id"]]) for t in out])) < 1e-12
    root = {t: next(r for r in table if r["tree"] == t and r["id"] == 0)["n"] for t in range(4)}
    assert all(root[t] == (drawn[:, t] > 0).sum() or root[t] == drawn[:, t].sum() for t in root)


def test_boosted_replay_equals_the_engine(spark, sample):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    table = ensembles.fit_boosted(sample, FEATS, count=5, max_depth=3)
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATS, outputCol="features"),
                             GBTClassifier(featuresCol="features", labelCol="label", maxIter=5, maxDepth=3, stepSize=0.1, seed=ML.SEED, maxBins=ML.MAX_BINS)]).fit(sample)
    want = {r["row_id"]: r["p"] for r in model.transform(sample).select("row_id", vector_to_array("probability")[1].alias("p")).collect()}
    for s in ensembles.score(sample, table, FEATS, -1.0, boosted=True, keep=["row_id"]).collect():
        assert abs(s["probability"] - want[s["row_id"]]) < 1e-9


def scorer_of(spark, sample, depth=4):
    nodes = trees.nodes_of(spark, ML.fit_tree(sample, FEATS, "label", depth), FEATS)
    return nodes, ensembles.Scorer(ensembles.from_nodes(nodes), FEATS)


def test_partial_dependence_by_brute_force(spark, sample):
    nodes, scorer = scorer_of(spark, sample)
    grid = scenarios.quantile_grid(sample, FEATS, [0.0, 0.25, 0.5, 1.0])
    xs = sorted(r["x"] for r in sample.collect())
    assert grid["x"][0] == xs[0] and grid["x"][-1] == xs[-1] and abs(grid["x"][2] - np.median(xs)) < 1e-12
    rows = [(r["x"], r["y"]) for r in sample.collect()]
    got = {(r["feature"], r["value"]): r for r in scenarios.partial_dependence(sample, scorer, grid, -1.0).collect()}
    assert len(got) == sum(map(len, grid.values()))
    table = ensembles.from_nodes(nodes)
    for (f, v), r in got.items():
        want = np.mean([walk(table, 0, {"x": a, "y": b, f: v}) for a, b in rows])
        assert r["n"] == len(rows) and abs(r["dependence"] - want) < 1e-12
    assert scenarios.partial_dependence(sample.limit(0), scorer, grid, -1.0).count() == 0


def test_scenarios_by_enumeration(spark, sample):
    nodes, scorer = scorer_of(spark, sample)
    levels = {"x": [0.5, 3.0, 4.2, 6.0, 9.0], "y": [0.0, 1.0, 2.0, 3.0, 4.0]}
    table = ensembles.from_nodes(nodes)
    every = [(-walk(table, 0, {"x": a, "y": b}), i, a, b) for i, (a, b) in enumerate(itertools.product(levels["x"], levels["y"]))]
    want = [(i, -s, a, b) for s, i, a, b in sorted(every)[:7]]
    got = scenarios.scenario_grid_search(spark, scorer, levels, 7, block=3).orderBy(F.desc("score"), "setting").collect()
    assert [(r["setting"], r["score"], r["x"], r["y"]) for r in got] == want
    # the best box holds a setting as good as any of a fine lattice inside the ranges
    ranges = {"x": (0.5, 9.0), "y": (0.0, 4.0)}
    boxes = scenarios.leaf_boxes(nodes, ranges, k=1000)
    fine = max(walk(table, 0, {"x": a, "y": b}) for a in np.linspace(0.5, 9.0, 171) for b in np.linspace(0, 4, 41))
    assert boxes[0]["score"] >= fine - 1e-12
    for b in boxes:
        (x0, x1), (y0, y1) = b["settings"]["x"], b["settings"]["y"]
        assert abs(walk(table, 0, {"x": x1, "y": y1}) - b["score"]) < 1e-12       # upper ends are inside
        assert x0 <= x1 and y0 <= y1
    assert scenarios.scenario_grid_search(spark, scorer, {"x": [], "y": [1.0]}, 3).count() == 0


def test_boxes_split_history(spark, sample):
    nodes, scorer = scorer_of(spark, sample)
    best = scenarios.leaf_boxes(nodes, {"x": (0.0, 10.0), "y": (0.0, 5.0)}, 1)[0]
    got = scenarios.historical_validation(sample, scenarios.inside(best["box"])).first()
    leaf = next(n for n in nodes if n["id"] == best["node"])
    assert (got["n_inside"], got["good_inside"]) == (leaf["n"], int(leaf["n1"]))      # the tree's own rows
    assert got["n_inside"] + got["n_outside"] == 600 and got["lower"] < got["difference"] < got["upper"]
    none = scenarios.historical_validation(sample, F.lit(True)).first()
    assert none["n_outside"] == 0 and none["share_outside"] is None and none["difference"] is None and none["lower"] is None
    odd = spark.createDataFrame([(None, 1), (1.0, None), (1.0, 1)], "x double, label int")
    got = scenarios.historical_validation(odd, scenarios.inside({"x": (-math.inf, 2.0)})).first()
    assert (got["n_inside"], got["n_outside"]) == (1, 1)


# ---- imputation, limits, histograms

def test_imputation(spark):
    rows = [("a", "1"), ("a", "3"), ("a", "x"), ("a", None), ("b", "10"), ("b", "nan"), (None, "7"), (None, None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v string").withColumn("gone", F.lit(None).cast("double")).withColumn("_m0", F.lit("clash"))
    m = impute.fit_medians(df, ["v", "gone"], "g")
    assert sorted((r["level"], r["group_value"] or "", r["variable"], r["value"]) for r in m.collect()) == [
        ("group", "", "v", 7.0), ("group", "a", "v", 2.0), ("group", "b", "v", 10.0), ("overall", "", "v", 5.0)]
    got = impute.impute_missing(df, m, ["v", "gone"], "g")
    assert got.columns == ["g", "v", "gone", "_m0"]
    want = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 3.0), ("b", 10.0), ("b", 10.0), ("c", 5.0), (None, 7.0), (None, 7.0)]
    assert sorted(((r["g"], r["v"]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert all(r["gone"] is None for r in got.collect())
    plain = impute.impute_missing(df, impute.fit_medians(df, ["v"]), ["v"])
    assert sorted(r["v"] for r in plain.collect()) == [1.0, 3.0, 5.0, 5.0, 5.0, 5.0, 5.0, 7.0, 10.0]
    empty = df.limit(0)
    assert impute.impute_missing(empty, impute.fit_medians(empty, ["v"], "g"), ["v"], "g").count() == 0


def test_limits_by_brute_force(spark):
    r = random.Random(11)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    periods = []
    for i in range(40):
        a = r.choice([None, *range(0, 900, 30)])
        b = r.choice([None, *range(0, 900, 45)])
        periods.append((r.choice("AB"), None if a is None else day(a), None if b is None else day(b), float(i), r.choice([None, float(i) - 1]), float(i) + 1))
    rows = [(i, r.choice(["A", "B", "C", None]), r.choice([None, day(r.randint(-200, 1200))]), r.choice([None, "x", str(r.randint(0, 40))])) for i in range(600)]
    df = spark.createDataFrame(rows + rows[:3], "id int, t string, day date, v string")
    lim = spark.createDataFrame(periods, "test string, valid_from date, valid_to date, target double, low double, high double")
    got = limits.spec_limits(df.withColumn("target", F.lit("old")), lim, "t", "day", "v").collect()
    assert len(got) == len(rows) + 3
    far, near = dt.date(9999, 12, 31), dt.date(1, 1, 1)
    for g in got:
        cover = [p for p in periods if g["day"] and p[0] == g["t"] and (p[1] or near) <= g["day"] < (p[2] or far)]
        if not cover:
            assert g["target"] is None and g["in_spec"] is None
            continue
        best = min(cover, key=lambda p: (-(p[1] or near).toordinal(), p[2] or far, p[3]))
        assert g["target"] == best[3] and g["high"] == best[5] and g["low"] == best[4]
        v = float(g["v"]) if g["v"] not in (None, "x") else None
        assert g["in_spec"] == (None if v is None else (best[4] is None or v >= best[4]) and v <= best[5])
        assert g["off_target"] == (None if v is None else v - best[3])
    assert limits.spec_limits(df, lim.limit(0), "t", "day", "v").where("target is not null").count() == 0
    assert limits.spec_limits(df.limit(0), lim, "t", "day", "v").count() == 0
    spans = limits.disjoint_limits(lim).collect()
    for a in spans:
        assert all(a == b or a["test"] != b["test"] or a["valid_to"] <= b["valid_from"] or b["valid_to"] <= a["valid_from"] for b in spans)


def test_limits_plan_has_no_nested_loop(spark):
    df = spark.createDataFrame([("A", dt.date(2020, 1, 5), 1.0), ("B", dt.date(2020, 1, 6), 2.0)], "t string, day date, v double")
    lim = spark.createDataFrame([("A", dt.date(2020, 1, 1), None, 1.0, 0.0, 2.0)], "test string, valid_from date, valid_to date, target double, low double, high double")
    plan = limits.spec_limits(df, lim, "t", "day", "v")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_histogram_by_numpy(spark):
    r = random.Random(2)
    rows = [(r.gauss(0, 1), 5.0, str(r.randint(0, 3)), None) for _ in range(500)] + [(None, 5.0, "x", None), (float("nan"), 5.0, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c string, d double")
    got = {}
    for h in limits.histogram(df, list("abcd"), 7).collect():
        got.setdefault(h["variable"], {})[h["bin"]] = (h["lower"], h["upper"], h["n"])
    assert set(got) == {"a", "b", "c"}
    for i, c in enumerate("abc"):
        values = [float(x[i]) for x in rows if x[i] not in (None, "x") and not math.isnan(float(x[i]))]
        n, edges = np.histogram(values, 7)
        assert [got[c][k][2] for k in range(7)] == n.tolist()
        assert np.allclose([got[c][k][0] for k in range(7)], edges[:-1])
