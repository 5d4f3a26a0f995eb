"""Edge fixtures (FIXTURES.md section 2): tiny literal frames for null, NaN, '#',
ties, constants, zero division and small classes."""

import math

import pytest
from pyspark.sql import functions as F

from speclab.functions import scalar as S
from speclab.operators import clean as B
from speclab.operators import metrics as H
from speclab.operators import profile as D
from speclab.operators import select as M


def test_sentinel_keeps_null(spark):
    df = spark.createDataFrame([(1, "1"), (2, "#"), (3, None), (4, "A")], "id long, result string")
    kept = sorted(r.id for r in B.drop_sentinel_rows(df, "result").collect())
    assert kept == [1, 3, 4]
    coerced = {r.id: r.v for r in df.select("id", S.coerce_numeric("result").alias("v")).collect()}
    assert coerced == {1: 1.0, 2: None, 3: None, 4: None}


def test_strict_cast_raises_on_dirt(spark):
    df = spark.createDataFrame([("1",), ("#",)], "result string")
    with pytest.raises(Exception):
        df.select(S.cast_strict("result", "int")).collect()


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (1.0,), (1.0,), (5.0,)], "v double")
    st = D.numeric_statistics(df, ["v"]).first()
    assert st["mode"] == 1.0 and st["median"] == 2.0 and st["unique_count"] == 3
    assert st["var"] == pytest.approx(2.7, abs=0.01)


def test_all_null_keeps_row(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    st = D.numeric_statistics(df, ["v"]).first()
    assert st["unique_count"] == 0 and st["min"] is None and st["sd"] is None


def test_nan_counts_as_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    nc = {r.column_name: r.null_count for r in D.null_counts(df).collect()}
    assert nc == {"v": 2}
    dc = {r.column_name: r.n_distinct for r in D.distinct_counts(df).collect()}
    assert dc == {"v": 1}
    assert B.dropna_any(df).count() == 1


def test_constant_columns_and_corr_guard(spark):
    df = spark.createDataFrame([(7, float(i)) for i in range(6)], "a int, b double")
    const = {r.column_name: r.value for r in D.constant_columns(df).collect()}
    assert const == {"a": "7"}
    kept, dropped = D.drop_constant_columns(df)
    assert dropped == ["a"] and kept.columns == ["b"]
    r = M.correlation_matrix(df, ["a", "b"]).where("col_a = 'a' and col_b = 'b'").first()["r"]
    assert r is None   # no DIVIDE_BY_ZERO under ANSI, NULL like pandas NaN
    low = {x.column_name: x.dropped for x in M.low_target_correlation(df, ["a"], "b").collect()}
    assert low["a"] is False   # NULL r is kept


def test_corr_chain_greedy_order(spark):
    rows = [(float(i), float(i) + (0.3 if i % 2 else -0.3), float(i) + (0.6 if i % 3 else -0.6))
            for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    out, rep = M.remove_highly_correlated_features(df, ["a", "b", "c"])
    pairs = [(r.anchor, r.dropped) for r in rep.collect()]
    # a drops b; b (already dropped) still anchors and drops c
    assert pairs == [("a", "b"), ("b", "c")]
    assert out.columns == ["a"]


def test_whitespace_unicode(spark):
    df = spark.createDataFrame([("\t100%  liquid  milk \n",), ("  a  b  ",)], "s string")
    got = [r.s for r in df.select(S.normalize_whitespace("s").alias("s")).collect()]
    assert got == ["100% liquid milk", "a b"]


def _twobytwo(spark):
    rows = [("x", "p")] * 20 + [("x", "q")] * 5 + [("y", "p")] * 5 + [("y", "q")] * 10
    return spark.createDataFrame(rows, "a string, b string")


def test_chi2_yates_and_plain(spark):
    df = _twobytwo(spark)
    corrected = M.chi2_pairwise(df, ["a", "b"]).first()
    plain = M.chi2_pairwise(df, ["a", "b"], correction=False).first()
    # by hand: E = (15, 10, 10, 6.667); plain 2x2 statistic 9.6, Yates 7.84...
    n, a, b, c, d = 40, 20, 5, 5, 10
    exp_plain = n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    exp_yates = n * (abs(a * d - b * c) - n / 2) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    assert plain["statistic"] == pytest.approx(exp_plain)
    assert corrected["statistic"] == pytest.approx(exp_yates)
    assert corrected["dof"] == 1
    assert corrected["p_value"] == pytest.approx(math.erfc(math.sqrt(exp_yates / 2)))


def test_chi2_pvalue_closed_forms():
    # chi2 survival at known points (dof 2: exp(-x/2); dof 4: exp(-x/2)(1 + x/2))
    assert M._chi2_sf(3.0, 2) == pytest.approx(math.exp(-1.5))
    assert M._chi2_sf(3.0, 4) == pytest.approx(math.exp(-1.5) * 2.5)
    assert M._chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert M._chi2_sf(7.814727903251178, 3) == pytest.approx(0.05, abs=1e-9)
    # published upper points (probability 0.05 and 0.01) for odd and even degrees of freedom
    for dof, x05, x01 in [(1, 3.841459, 6.634897), (3, 7.814728, 11.344867), (5, 11.070498, 15.086272), (7, 14.067140, 18.475307),
                          (9, 16.918978, 21.665994), (10, 18.307038, 23.209251), (30, 43.772972, 50.892181)]:
        assert M._chi2_sf(x05, dof) == pytest.approx(0.05, abs=1e-6)
        assert M._chi2_sf(x01, dof) == pytest.approx(0.01, abs=1e-6)
    for dof in (999, 1000, 5000):
        for x in (0.0, 1.0, dof * 0.5, dof, dof * 1.8, 1e6):
            assert 0.0 <= M._chi2_sf(x, dof) <= 1.0
    assert M._chi2_sf(1074.679, 1000) == pytest.approx(0.05, abs=1e-4)


def test_associated_walk():
    res = [("a", "b", 0.01), ("a", "c", 0.5), ("b", "c", 0.01)]
    # (a,b): drop b; (b,c) skipped because b is gone; (c,b) skipped too
    assert M.associated_drop_walk(res, ["a", "b", "c"]) == ["b"]


def test_one_class_zero_division(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 1)], "label int, prediction int")
    rep = {r.row_label: r for r in H.classification_report(df).collect()}
    assert rep["0"].precision == 0.0 and rep["0"].recall == 0.0 and rep["0"].f1 == 0.0
    assert rep["1"].precision == pytest.approx(1 / 3) and rep["1"].recall == 1.0
    assert rep["accuracy"].f1 == pytest.approx(1 / 3) and rep["accuracy"].support == 3
    cm = {(r.actual, r.predicted): r.n for r in H.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 0, (0, 1): 2, (1, 0): 0, (1, 1): 1}


def test_roc_ties_and_hard_auc(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, score double")
    auc = H.roc_curve_from_scores(df).first()["roc_auc"]
    assert auc == pytest.approx(0.875)   # sklearn roc_auc_score on the same input
    points = sorted((r["threshold"], r["fpr"], r["tpr"]) for r in H.roc_curve_from_scores(df).collect())
    assert points == [(0.1, 1.0, 1.0), (0.5, 0.5, 1.0), (0.9, 0.0, 0.5), (math.inf, 0.0, 0.0)]
    hard = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1)], "label int, prediction int")
    tpr, tnr = 1 / 2, 2 / 3
    assert H.roc_auc_from_labels(hard).first()["roc_auc"] == pytest.approx((tpr + tnr) / 2)
    ev = H.evaluate_model(hard.withColumn("split", F.lit("test"))).first()
    assert ev["auc_hard"] == pytest.approx((tpr + tnr) / 2)


def test_minority_smaller_than_k(spark):
    from speclab.operators.smote import nearest_neighbours, smote_oversample
    rows = [(f"m{i}", 1, float(i), float(i * 2)) for i in range(3)] + \
           [(f"M{i}", 0, float(i), float(-i)) for i in range(10)]
    df = spark.createDataFrame(rows, "row_id string, label int, x double, y double").withColumn("split", F.lit("train"))
    nn = nearest_neighbours(df.where("label = 1"), ["x", "y"])
    assert nn.count() == 3 * 2          # each of 3 points has 2 others
    out = smote_oversample(df, ["x", "y"], splits=("train",))
    counts = {r.label: r.n for r in out.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 10, 1: 10}
    syn = out.where("label = 1 and row_id not like 'm%'").collect()
    for r in syn:                       # on the segment between two minority points: y = 2x
        assert r.y == pytest.approx(2 * r.x) and 0 <= r.x <= 2


def test_knn_hot_duplicate_vector_and_brute_force(spark):
    import numpy as np
    from speclab.operators.smote import nearest_neighbours
    rng = np.random.default_rng(7)
    rows = [(f"h{i:04d}", 1.0, 1.0) for i in range(200)]                      # one hot vector
    rows += [(f"r{i:04d}", float(rng.integers(0, 4)), float(rng.integers(0, 3))) for i in range(60)]
    rows += [(f"c{i:04d}", float(rng.normal(10, 3)), float(rng.normal(-5, 2))) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id string, x double, y double")
    got = {(r.row_id, r.nn_rank): (r.nn_row_id, r.distance)
           for r in nearest_neighbours(df, ["x", "y"], k=5).collect()}
    keys = [r[0] for r in rows]
    pts = np.array([[r[1], r[2]] for r in rows])
    for i, p in enumerate(keys):
        d2 = ((pts - pts[i]) ** 2).sum(axis=1)
        order = sorted((d2[j], keys[j]) for j in range(len(keys)) if j != i)[:5]
        for rank, (dd, q) in enumerate(order, start=1):
            assert got[(p, rank)][0] == q
            assert got[(p, rank)][1] == pytest.approx(dd ** 0.5)


def test_spread_small_scan_leaves_split_inputs(spark):
    from speclab.sources.io import spread_small_scan
    many = spark.range(0, 1000, numPartitions=16)
    assert spread_small_scan(many) is many
    one = spark.range(0, 1000, numPartitions=1)
    assert spread_small_scan(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_knn_candidates_stay_flat_in_several_dimensions(monkeypatch):
    """Four uniform features: positions looked at per position do not grow with their number."""
    import numpy as np
    from speclab.operators import smote
    monkeypatch.setattr(smote, "CELL_POSITIONS", 128)
    per_point = {}
    for n in (2000, 16000):
        x = np.random.default_rng(1).random((n, 4))
        cells = smote._Cells(x, n)
        cell = cells.of(x)
        assert np.bincount(cell).max() <= 4 * 128
        lo = np.array([x[cell == c].min(0) for c in range(cells.leaves)])
        hi = np.array([x[cell == c].max(0) for c in range(cells.leaves)])
        size = np.bincount(cell, minlength=cells.leaves)
        seen = []
        for i in range(0, n, n // 200):
            own = np.sort(((x[cell == cell[i]] - x[i]) ** 2).sum(1))
            gap = np.maximum(0, np.maximum(lo - x[i], x[i] - hi))
            seen.append(size[(gap ** 2).sum(1) <= own[6]].sum())
        per_point[n] = np.mean(seen)
    # eight times the positions; cells at the rim of a small cube have fewer neighbours, hence the slack
    assert per_point[16000] <= 2 * per_point[2000]
    assert per_point[16000] < 0.05 * 16000


def test_knn_matches_brute_force_over_many_cells(spark, monkeypatch):
    import numpy as np
    from speclab.operators import smote
    monkeypatch.setattr(smote, "CELL_POSITIONS", 16)
    x = np.random.default_rng(3).normal(0, 1, (400, 3)) * [1, 10, 0.1]
    rows = [(f"p{i:03d}", *map(float, v), "u" if i % 3 else "v") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id string, a double, b double, c double, g string")
    got = {}
    for r in smote.nearest_neighbours(df, ["a", "b", "c"], k=3, group="g").collect():
        got.setdefault(r["row_id"], []).append((r["nn_rank"], r["nn_row_id"]))
    for i in range(400):
        same = [j for j in range(400) if (j % 3 == 0) == (i % 3 == 0) and j != i]
        want = sorted(((float(((x[i] - x[j]) ** 2).sum()), f"p{j:03d}") for j in same))[:3]
        assert [q for _, q in sorted(got[f"p{i:03d}"])] == [q for _, q in want]


def test_cells_are_cut_where_most_readings_are_missing():
    """60 % of the widest feature at its least value: cells stay of bounded size."""
    import numpy as np

    from speclab.operators.smote import CELL_POSITIONS, _Cells
    rng = np.random.default_rng(1)
    x = np.stack([np.where(rng.random(50_000) < 0.6, -1.0, rng.random(50_000) * 1000), rng.random(50_000), rng.random(50_000) * 5], 1)
    sizes = np.bincount(_Cells(x, len(x)).of(x))
    assert len(sizes) >= 90 and sizes.max() <= 2 * CELL_POSITIONS
    same = np.zeros((3000, 2))
    assert _Cells(same, 3000).leaves == 1


def test_synthetic_rows_lie_between_near_neighbours(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from speclab.operators.smote import smote_oversample
    rng = np.random.default_rng(3)
    rows = [(f"r{i}", float(a), float(b), int(i < 40), "train") for i, (a, b) in enumerate(rng.random((200, 2)) * 10)]
    df = spark.createDataFrame(rows, "row_id string, x double, y double, label int, split string")
    out = smote_oversample(df, ["x", "y"], k=3)
    made = np.array([(r["x"], r["y"]) for r in out.where("synthetic").collect()])
    assert len(made) == 120 and out.where(F.col("label") == 1).count() == 160
    p = np.array([r[1:3] for r in rows if r[3] == 1])
    d = ((p[:, None] - p[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1)[:, :3]
    for s in made:
        # on a segment from a minority row to one of its three neighbours
        ok = False
        for i in range(len(p)):
            for j in near[i]:
                v, w = p[j] - p[i], s - p[i]
                t = w @ v / (v @ v)
                ok |= -1e-9 <= t <= 1 + 1e-9 and abs(w - t * v).max() < 1e-9
        assert ok
