"""Trees grown in bounded steps are those of Spark ML, and no tree of the grid passes the driver."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from speclab.operators import growth, trees
from speclab.operators import models as ML
from speclab.session import cut_lineage

FEATS = ["a", "b", "c"]


def _rows(spark, n=900, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), float(rng.randrange(4)), round(rng.random() * 40) / 8
        rows.append((f"r{i}", a, b, c, int(a + b / 3 + rng.gauss(0, 1) > 0.7), i * 7 % 3))
    rows += [(f"t{i}", 0.0, 1.0, -0.0, i % 2, i % 3) for i in range(40)]          # equal rows of both classes
    return cut_lineage(spark.createDataFrame(rows, "row_id string, a double, b double, c double, label int, fold int").repartition(3))


def _plain(nodes):
    return [{k: v for k, v in x.items() if k != "gain"} for x in nodes]


SETTINGS = ((None, 1, 256), (4, 1, 16), (None, 4, 256))


@pytest.fixture(scope="module")
def fitted(spark):
    """The same trees fitted by Spark ML: nodes, importances, depth report and shape."""
    d, out = _rows(spark, 500), {}
    for depth, leaf, bins in SETTINGS:
        model = ML.fit_tree(d, FEATS, "label", depth, leaf, max_bins=bins)
        out[(depth, leaf, bins)] = (trees.nodes_of(spark, model, FEATS),
                                    {r["feature"]: r["importance"] for r in ML.feature_importance_ranked(spark, model, FEATS).collect()},
                                    ML.depth_report(model, depth), tuple(ML.tree_shape(spark, model).first()))
    return d, out


@pytest.mark.parametrize("local", [1 << 17, 60, 9])
def test_same_nodes_as_spark(fitted, monkeypatch, local):
    monkeypatch.setattr(growth, "LOCAL_ROWS", local)
    monkeypatch.setattr(growth, "OPEN_NODES", 3 if local == 9 else 4096)
    d, theirs = fitted
    for depth, leaf, bins in SETTINGS:
        nodes, importance, report, shape = theirs[(depth, leaf, bins)]
        mine = trees.fit_nodes(d, FEATS, -1.0, "label", depth, leaf, max_bins=bins)
        assert _plain(mine) == nodes
        assert dict(trees.feature_importance(mine, FEATS)) == pytest.approx(importance, abs=1e-12)
        assert trees.depth_report(mine, depth) == report
        assert tuple(trees.shape_of(mine).values()) == shape


@pytest.mark.parametrize("local", [1 << 17, 9])
def test_grid_is_that_of_fitted_trees(spark, monkeypatch, local):
    monkeypatch.setattr(growth, "LOCAL_ROWS", local)
    d = _rows(spark, 260)
    asked = dict(depths=[None, 2, 5, 50], leaves=[1, 3], splits=[2, 30])
    grid = trees.full_grid(d, FEATS, -1.0, k=3, **asked)
    want = {}
    for leaf in asked["leaves"]:
        for f in range(3):
            nodes = trees.nodes_of(spark, ML.fit_tree(d.where(F.col("fold") != f), FEATS, "label", None, leaf), FEATS)
            held = d.where(F.col("fold") == f)
            for depth in asked["depths"]:
                for split in asked["splits"]:
                    s = trees.score_nodes(held, trees.truncated(nodes, depth, split), FEATS, -1.0).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
                    want.setdefault((depth, leaf, split), []).append(s)
    assert {(g["max_depth"], g["min_samples_leaf"], g["min_samples_split"]): g["mean_accuracy"] for g in grid} == \
        pytest.approx({k: float(np.mean(v)) for k, v in want.items()}, abs=1e-12)
    scores = {r["fold"]: r["score"] for r in ML.cross_validation_scores(d, FEATS, k=3, max_depth=5).collect()}
    assert [scores[f] for f in range(3)] == pytest.approx(want[(5, 1, 2)], abs=1e-12)


def test_grid_collects_no_model(spark, monkeypatch):
    """Every fitted tree was collected by the driver."""
    def refuse(*_, **__):
        raise AssertionError("a tree of the grid reached the driver")
    monkeypatch.setattr(trees, "nodes_of", refuse)
    monkeypatch.setattr(ML, "fit_tree", refuse)
    monkeypatch.setattr(growth.Grower, "grown", refuse)
    grid = trees.full_grid(_rows(spark, 200), FEATS, -1.0, k=3, leaves=[1], splits=[2])
    assert len(grid) == 5 and all(0 < g["mean_accuracy"] < 1 for g in grid)


@pytest.mark.parametrize("local", [1 << 17, 9])
def test_tree_of_many_rows_is_not_held_by_the_driver(spark, monkeypatch, local):
    """The chosen tree was collected and sent back; its shape, cuts, importances and scores came from the driver's list."""
    monkeypatch.setattr(growth, "LOCAL_ROWS", local)
    d = _rows(spark, 260)
    asked = dict(depths=[None, 3, 50], leaves=[1, 3], splits=[2, 30], k=3)
    lists = {(depth, leaf): trees.fit_nodes(d, FEATS, -1.0, "label", depth, leaf) for depth, leaf in ((None, 1), (3, 1), (5, 3))}

    def refuse(*_, **__):
        raise AssertionError("a tree reached the driver")
    monkeypatch.setattr(growth.Grower, "grown", refuse)
    made, init = [], growth.Grower.__init__
    monkeypatch.setattr(growth.Grower, "__init__", lambda self, *a, **kw: made.append(1) or init(self, *a, **kw))
    grower = trees.grown_together(d, FEATS, -1.0, cv_depth=5, **asked)
    for (depth, leaf), nodes in lists.items():
        table = trees.fit_table(d, FEATS, -1.0, "label", depth, leaf, grower=grower)
        assert trees.nodes_from_table(trees.node_table(spark, table)) == _plain(nodes)
        assert trees.shape_of(table) == trees.shape_of(nodes) and trees.depth_report(table, depth) == trees.depth_report(nodes, depth)
        assert dict(trees.feature_importance(table, FEATS)) == pytest.approx(dict(trees.feature_importance(nodes, FEATS)), abs=1e-12)
        for deep, least in ((None, 2), (None, 40), (2, 2), (4, 10)):
            cut = trees.truncated(nodes, deep, least)
            assert trees.nodes_from_table(trees.node_table(spark, trees.truncated(table, deep, least))) == _plain(cut)
        # the last cut, walked whole and subtree by subtree
        want = {tuple(r) for r in trees.score_nodes(d, cut, FEATS, -1.0, keep=("fold",)).collect()}
        cut = trees.truncated(table, deep, least)
        monkeypatch.setattr(trees, "SLOT_ROWS", 7)
        for few in (1 << 14, 0):
            monkeypatch.setattr(trees, "WALK_NODES", few)
            assert {tuple(r) for r in trees.score_nodes(d, cut, FEATS, -1.0, keep=("fold",)).collect()} == want
    grid = trees.full_grid(d, FEATS, -1.0, grower=grower, **asked)
    scores = [r["score"] for r in ML.cross_validation_scores(d, FEATS, k=3, max_depth=5, grower=grower).collect()]
    assert len(made) == 1
    assert grid == trees.full_grid(d, FEATS, -1.0, **asked)
    assert scores == [r["score"] for r in ML.cross_validation_scores(d, FEATS, k=3, max_depth=5).collect()]


def test_missing_feature_and_label(spark):
    d = _rows(spark, 60)
    gap = d.withColumn("a", F.when(F.col("row_id") != "r7", F.col("a")))
    with pytest.raises(Exception, match="missing"):
        ML.cross_validation_scores(gap, FEATS, k=3)
    assert trees.fit_nodes(gap, FEATS, -9.0)[0]["n"] == 100
    with pytest.raises(ValueError, match="0 or 1"):
        trees.fit_nodes(d.withColumn("label", F.lit(2)), FEATS, -1.0)


def test_rows_meet_their_ranks_without_being_taken_apart(spark, monkeypatch):
    """X4 spread every row over all rankings and put it together again by two shuffles of that."""
    from speclab.operators import gram
    seen, kept = [], gram.pair_sums
    monkeypatch.setattr(gram, "pair_sums", lambda df, *a: seen.append(df) or kept(df, *a))
    rows = [(float(i % 7), None if i % 5 == 0 else float(i * i % 11), -0.0 if i % 3 else float(i)) for i in range(60)]
    d = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["col_a"], r["col_b"]): r["r"] for r in gram.spearman_matrix(d, FEATS).collect()}
    want = d.toPandas().corr("spearman")
    assert got == pytest.approx({(a, b): want.loc[a, b] for a in FEATS for b in FEATS})
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_only_sample_makers_look_for_neighbours(spark, monkeypatch):
    """Every minority point was searched, however few samples were needed."""
    from speclab.operators import smote
    rng = random.Random(5)
    rows = [(f"k{i}", rng.random(), rng.random(), int(i >= 40), "train") for i in range(83)]
    d = spark.createDataFrame(rows, "row_id string, a double, b double, label int, split string")
    asked, search = [], smote.nearest_neighbours

    def spy(points, *a, **kw):
        out = search(points, *a, **kw)
        asked.append(out.select("row_id").distinct().count())
        whole = {tuple(r) for r in search(points, *a, **{**kw, "ask": None}).collect()}
        assert {tuple(r) for r in out.collect()} <= whole
        return out
    monkeypatch.setattr(smote, "nearest_neighbours", spy)
    out = smote.smote_oversample(d, ["a", "b"])
    assert out.where("synthetic").count() == 3 and asked == [3]


def test_product_rows_are_written_before_their_metadata_passes(spark, sf, monkeypatch):
    """The constant columns were looked for in the joined tables, which were then read and joined again."""
    from speclab.plans import pipelines as P
    from speclab.plans.targets import TARGETS
    from speclab.sources.readings import readings
    seen, kept = [], P.D.drop_constant_columns
    monkeypatch.setattr(P.D, "drop_constant_columns", lambda df, **kw: seen.append(df) or kept(df, **kw))
    P.labelled(readings(spark, sf), TARGETS["t6"])
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
