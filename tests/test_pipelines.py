"""Stage pipelines on sf0.001: every target preprocesses, the train / validation
reports run, and the invariants the reference checks by eye hold."""

import dataclasses
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from speclab.operators import models as ML
from speclab.operators import profile as D
from speclab.operators import trees
from speclab.plans import pipelines as P
from speclab.plans.targets import MISSING, TARGETS
from speclab.sources.readings import readings


@pytest.fixture(scope="module")
def rd(spark, sf):
    return readings(spark, sf).cache()


@pytest.mark.parametrize("t", ["t1", "t2", "t3", "t4", "t5", "t6"])
def test_preprocess_invariants(spark, sf, rd, t):
    spec = TARGETS[t]
    prep = P.preprocess(spark, sf, spec, rd=rd)
    df = prep.df
    assert set(df.columns) == {"row_id", "label", "split", "synthetic", *prep.features}
    # every labelled row is in exactly one split
    assert df.where("not synthetic").count() == prep.report["rows"]["labelled"]
    if spec.smote:
        # every split is complete, filled by medians of the training rows
        assert D.null_counts(df.drop("label")).count() == 0
        assert df.where("synthetic and split = 'val'").count() == 0
        assert set(prep.report["imputation"]) == set(prep.features)
        kept = P.preprocess(spark, sf, dataclasses.replace(spec, missing="keep"), rd=rd)
        gaps = kept.report["rows"]["missing_feature"]
        assert gaps == prep.report["rows"]["missing_feature"]
        # without imputation the validation rows keep their gaps
        val = kept.df.where("split = 'val'")
        assert gaps.get("val", 0) == val.count() - val.na.drop(subset=kept.features).count()
        for f, m in prep.report["imputation"].items():
            seen = [r[0] for r in kept.df.where("split = 'train' and not synthetic").select(f).collect() if r[0] != MISSING]
            assert m == pytest.approx(statistics.median(seen))
    splits = {r.split for r in df.select("split").distinct().collect()}
    assert splits == ({"train", "val"} if spec.split == "80_20" else {"train", "test", "val"})
    bal = {r.split: (r.n_pos, r.n_neg) for r in D.label_balance(df).collect()}
    if spec.smote:
        for s in spec.balance_splits:
            if min(bal[s]) > 0:
                assert bal[s][0] == bal[s][1]      # minority raised to the majority
    assert df.select("label").distinct().count() <= 2


def test_constant_and_known_drops(spark, sf, rd):
    df, rep = P.labelled(rd, TARGETS["t2"])
    assert set(rep["constant_columns"]) == {"test_code", "plant"}
    assert "result" not in df.columns and "label" in df.columns


def test_missing_rows_can_be_dropped_from_balanced_splits(spark, sf, rd):
    spec = dataclasses.replace(TARGETS["t5"], missing="drop")
    prep = P.preprocess(spark, sf, spec, rd=rd)
    gaps = prep.report["rows"]["missing_feature"]
    kept = prep.df.where("not synthetic").count()
    assert kept == prep.report["rows"]["labelled"] - sum(n for s, n in gaps.items() if s != "val")


def test_reports_run(spark, sf, rd):
    prep = P.preprocess(spark, sf, TARGETS["t5"], rd=rd)
    rep = P.train_report(prep, parallelism=4, folds=2)
    ev = {r.split: r for r in rep.tables["evaluation"].collect()}
    assert set(ev) == {"train", "test"} and all(0 <= r.accuracy <= 1 for r in ev.values())
    long = rep.tables["report"].collect()
    assert sum(r.table == "cv_scores" for r in long) == 2
    assert sum(r.table == "grid_search" for r in long) == 45
    assert {r.metric for r in long if r.table == "tree_default"} >= {"effective_depth", "depth_limit_hit", "n_leaves"}
    chosen = {r.metric: r.value for r in long if r.table == "best_params"}
    assert chosen["mean_accuracy"] == max(r.value for r in long if r.table == "grid_search")
    val = P.validation_report(spark, rep, prep).collect()
    assert {r.table for r in val} == {"accuracy", "confusion_matrix", "classification_report", "roc_curve"}
    assert sum(r.value for r in val if r.table == "confusion_matrix" and r.metric == "n") == prep.df.where("split = 'val'").count()


def test_saved_tree_replayed_in_sql(spark, sf, rd, tmp_path):
    """The node table, walked by a recursive SQL query, gives the stored predictions and probabilities."""
    prep = P.preprocess(spark, sf, TARGETS["t6"], rd=rd)
    rep = P.train_report(prep, parallelism=4, folds=2)
    rep.tables["rules"].toPandas().to_parquet(tmp_path / "nodes.parquet")
    rep.tables["scored"].toPandas().to_parquet(tmp_path / "scored.parquet")
    data = prep.df.where("split != 'val'").toPandas()
    data.to_parquet(tmp_path / "data.parquet")
    long = ", ".join(f"coalesce({f}, {MISSING}) AS {f}" for f in prep.features)
    con = duckdb.connect()
    got = con.execute(f"""WITH RECURSIVE nodes AS (SELECT * FROM '{tmp_path}/nodes.parquet'),
      d AS (SELECT row_id, {long} FROM '{tmp_path}/data.parquet'),
      x AS (UNPIVOT d ON {", ".join(prep.features)} INTO NAME feature VALUE value),
      walk AS (SELECT row_id, 0 AS id FROM d
        UNION ALL SELECT w.row_id, CASE WHEN x.value <= n.threshold THEN n."left" ELSE n."right" END
        FROM walk w JOIN nodes n USING (id) JOIN x ON x.row_id = w.row_id AND x.feature = n.feature)
      SELECT count(*), count(*) FILTER (WHERE s.prediction = n.prediction AND abs(s.probability - n.n1 / (n.n0 + n.n1)) < 1e-12)
      FROM walk w JOIN nodes n USING (id) JOIN '{tmp_path}/scored.parquet' s USING (row_id) WHERE n.feature IS NULL""").fetchone()
    assert got[0] == got[1] == len(data)


def test_truncated_tree_equals_a_refit(spark, sf, rd):
    """Cutting a deep tree at a depth gives the tree fitted with that depth; small nodes stay leaves."""
    prep = P.preprocess(spark, sf, TARGETS["t3"], rd=rd)
    d = prep.df.fillna(MISSING, subset=prep.features).where("split = 'train'").cache()
    deep = trees.nodes_of(spark, ML.fit_tree(d, prep.features), prep.features)
    for depth in (1, 3, 6):
        model = ML.fit_tree(d, prep.features, max_depth=depth)
        want = {r.row_id: r.prediction for r in ML.predict_labels(model, d).collect()}
        got = {r.row_id: r.prediction for r in trees.score_nodes(d, trees.truncated(deep, depth, 2), prep.features, MISSING).collect()}
        assert got == want
    assert all(x["left"] is None for x in trees.truncated(deep, None, 50) if x["n"] < 50)


def test_descriptive_report(spark, sf, rd):
    lab, _ = P.labelled(rd, TARGETS["t1"], drop_constants=False)
    rep = P.descriptive_report(lab, ["feed_flow", "heat_temp", "size"])
    assert rep["numeric_statistics"].count() == 3
    d = rep["class_distribution"].toPandas()
    assert d["pct"].sum() == pytest.approx(100, abs=0.2)


def test_unique_values_map_form(spark, rd):
    t = {r.variable: r for r in D.unique_values_table(rd, ["swirl", "method"]).collect()}
    assert t["swirl"].unique_count == 3 and sorted(t["swirl"].unique_values) == ["SW5", "SW6", "SW9"]
    assert sum(t["swirl"].value_counts.values()) == rd.count()
    # NULL is listed among the values (unique()) but not counted (nunique)
    assert None in t["method"].unique_values and t["method"].unique_count == 2
    assert rd.where(F.col("method").isNull()).count() > 0
