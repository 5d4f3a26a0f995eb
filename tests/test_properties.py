"""Property tests on the supplied tables (sf0.001) and model round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from speclab.operators import metrics as H
from speclab.operators import models as ML
from speclab.operators import profile as D
from speclab.operators import quantiles as Q
from speclab.operators import select as M
from speclab.operators import split as G
from speclab.plans.catalog import CORR_VARS, lab
from speclab.sources import io as A
from speclab.sources.readings import readings


@pytest.fixture(scope="module")
def rd(spark, sf):
    return readings(spark, sf).cache()


def test_split_is_partition_with_exact_sizes(rd):
    n = rd.count()
    s = G.split_80_20(rd.select("row_id"))
    c = {r.split: r.n for r in s.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert c["val"] == int(np.ceil(n * 0.2)) and c["train"] + c["val"] == n
    s3 = G.split_70_15_15(rd.select("row_id"))
    c3 = {r.split: r.n for r in s3.groupBy("split").agg(F.count("*").alias("n")).collect()}
    temp = int(np.ceil(n * 0.3))
    assert c3["train"] == n - temp and c3["val"] == int(np.ceil(temp * 0.5)) and sum(c3.values()) == n
    assert s3.select("row_id").distinct().count() == n


def test_stratified_folds_balanced(spark, sf):
    f = G.stratified_folds(lab(spark, sf, "t6").select("row_id", "label"))
    per = f.groupBy("label", "fold").agg(F.count("*").alias("n")).toPandas()
    for _, g in per.groupby("label"):
        assert g["n"].max() - g["n"].min() <= 1


def test_shares_sum_to_100(rd):
    cs = D.categorical_summary(rd, "line_status", "result_grade").toPandas()
    assert cs["pct_total"].sum() == pytest.approx(100, abs=0.5)
    for _, g in cs.groupby("line_status"):
        assert g["pct_within"].sum() == pytest.approx(100, abs=0.05)


def test_corr_matrix_symmetric_and_matches_numpy(rd):
    m = M.correlation_matrix(rd, CORR_VARS).toPandas()
    piv = m.pivot(index="col_a", columns="col_b", values="r").astype(float)
    assert np.allclose(piv.values, piv.values.T, equal_nan=True)
    pdf = rd.select(*CORR_VARS).toPandas().astype(float)
    ref = pdf.corr()
    assert np.allclose(piv.loc[CORR_VARS, CORR_VARS].values, ref.loc[CORR_VARS, CORR_VARS].values, atol=1e-9)


def test_no_surviving_pair_violates_rule(rd):
    out, rep = M.remove_highly_correlated_features(rd, CORR_VARS)
    left = [c for c in CORR_VARS if c in out.columns]
    pairs = M.correlated_pairs(out, left).collect()
    assert pairs == [] and "heat_temp_2" not in out.columns


def test_quantiles_match_pandas(rd):
    long = D.melt_features(rd, ["line_status"], ["feed_flow", "heat_temp", "size"])
    q = Q.exact_quantiles(long, ["line_status", "variable"], "value", [0.1, 0.25, 0.5, 0.9]).toPandas()
    pdf = long.toPandas().dropna()
    for _, r in q.iterrows():
        v = pdf[(pdf.line_status == r.line_status) & (pdf.variable == r.variable)]["value"]
        assert r["quantile"] == pytest.approx(v.quantile(r["prob"]))


def test_rank_of_is_dense_permutation(rd):
    r = Q.rank_of(rd.select("row_id", "test_code", "heat_temp"), ["test_code"], "heat_temp", tie="row_id").toPandas()
    for _, g in r.groupby("test_code"):
        assert sorted(g["_rank"]) == list(range(len(g)))
        assert (g.sort_values("_rank")["heat_temp"].diff().dropna() >= 0).all()


def test_roc_matches_numpy_trapezoid(spark, sf):
    from speclab.plans.fixtures import scored
    sc = scored(spark, sf)
    roc = H.roc_curve_from_scores(sc).toPandas().sort_values("threshold", ascending=False)
    fpr = np.concatenate([[0], roc["fpr"].values])
    tpr = np.concatenate([[0], roc["tpr"].values])
    assert roc["roc_auc"].iloc[0] == pytest.approx(np.trapezoid(tpr, fpr))


def test_model_determinism_and_round_trip(spark, sf, tmp_path):
    d = G.split_80_20(lab(spark, sf, "t5").select("row_id", "heat_temp", "feed_flow", "discount", "size", "label"))
    feats = ["heat_temp", "feed_flow", "discount", "size"]
    train = d.where("split = 'train'")
    m1 = ML.fit_tree(train, feats, max_depth=5)
    m2 = ML.fit_tree(train, feats, max_depth=5)
    p1 = ML.predict_labels(m1, d).orderBy("row_id").toPandas()
    p2 = ML.predict_labels(m2, d).orderBy("row_id").toPandas()
    assert p1.equals(p2)
    path = A.save_model(m1, str(tmp_path / "m"))
    p3 = ML.predict_labels(A.load_model(path), d).orderBy("row_id").toPandas()
    assert p1.equals(p3)
    shape = ML.tree_shape(spark, m1).first()
    assert shape.depth <= 5 and shape.n_leaves == (shape.num_nodes + 1) // 2


def test_write_split_datasets_guard(spark, tmp_path):
    with pytest.raises(ValueError):
        A.write_split_datasets({"train": [1, 2]}, str(tmp_path / "x"))


def test_split_datasets_round_trip(spark, rd, tmp_path):
    s = G.split_80_20(rd.select("row_id", "heat_temp"))
    path = A.write_split_datasets(s, str(tmp_path / "s"))
    parts = A.read_split_datasets(spark, path, names=("train", "val"))
    assert parts["train"].count() + parts["val"].count() == rd.count()
