"""Trees as node tables: rules, truncation and the full grid.

A fitted Spark tree is stored by Spark itself; its nodes are read back as a table
(id, depth, feature, threshold, left, right, n, n0, n1). A smaller ``max_depth`` and
a ``min_samples_split`` only cut nodes off a greedily grown tree, so one fit per fold and leaf
size gives every setting of the grid: rows walk the tree once and are counted for all settings.

A tree of many rows stays a written table (``fit_table``, ``growth.TABLE_SCHEMA``): its shape, importances and cuts are
aggregates and filters of that table, and rows meet the subtree they fall into in a join. The functions below
take either form.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speclab.operators import models as ML
from speclab.operators.growth import Grower, Plan
from speclab.session import cut_lineage, ensure_checkpoint_dir, release_at_exit

WALK_NODES = 1 << 14       # trees of more nodes are not sent to every task
SLOT_ROWS = 1 << 17        # rows that meet one subtree in one task

NODE_SCHEMA = ("id int, depth int, feature string, threshold double, left int, right int, n long, n0 double, n1 double, "
               "prediction int")


def stored_model(spark: SparkSession, model, name: str = "tree") -> str:
    """Save a fitted tree under the shared folder (deleted when the application ends)."""
    path = os.path.join(ensure_checkpoint_dir(spark), "speclab-models", f"{name}-{uuid.uuid4().hex}")
    ML.tree_of(model).write().overwrite().save(path)
    release_at_exit(spark, path)
    return path


def nodes_of(spark: SparkSession, model, features: Sequence[str]) -> list[dict]:
    """Nodes of a fitted tree in id order. A model is held by the driver whole; so is this list."""
    rows = sorted(spark.read.parquet(f"{stored_model(spark, model)}/data").collect(), key=lambda r: r["id"])
    depth = {0: 0}
    out = []
    for r in rows:
        inner = r["leftChild"] >= 0
        if inner:
            depth[r["leftChild"]] = depth[r["rightChild"]] = depth[r["id"]] + 1
        stats = [*r["impurityStats"], 0.0, 0.0]
        out.append({"id": r["id"], "depth": depth[r["id"]], "feature": features[r["split"]["featureIndex"]] if inner else None,
                    "threshold": r["split"]["leftCategoriesOrThreshold"][0] if inner else None,
                    "left": r["leftChild"] if inner else None, "right": r["rightChild"] if inner else None,
                    "n": int(sum(r["impurityStats"])), "n0": stats[0], "n1": stats[1], "prediction": int(r["prediction"])})
    return out


def truncated(nodes: list[dict] | DataFrame, max_depth: int | None, min_split: int) -> list[dict] | DataFrame:
    """The nodes left when nodes at ``max_depth`` or with fewer than ``min_split`` rows stay leaves."""
    if isinstance(nodes, DataFrame):
        # rows get fewer and depths grow on the way down, so a node is left where its parent splits
        kept = nodes.where((F.col("parent_n") < 0) | (F.col("parent_n") >= min_split))
        ends = F.col("n") < min_split
        if max_depth is not None:
            kept, ends = kept.where(F.col("depth") <= max_depth), ends | (F.col("depth") >= max_depth)
        return kept.select(*[F.when(~ends, F.col(c)).alias(c) if c in ("feature", "threshold", "left", "right") else c for c in kept.columns])
    by_id, out, todo = {x["id"]: x for x in nodes}, [], [0]
    while todo:
        x = dict(by_id[todo.pop()])
        if x["left"] is not None and x["n"] >= min_split and (max_depth is None or x["depth"] < max_depth):
            todo += [x["right"], x["left"]]
        else:
            x["feature"] = x["threshold"] = x["left"] = x["right"] = None
        out.append(x)
    return sorted(out, key=lambda x: x["id"])


def node_table(spark: SparkSession, nodes: list[dict] | DataFrame) -> DataFrame:
    """One row a node; a row goes left where its feature is at most the threshold."""
    cols = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
    if isinstance(nodes, DataFrame):
        return nodes.select(*cols)
    return spark.createDataFrame([tuple(x[c] for c in cols) for x in nodes], NODE_SCHEMA)


def nodes_from_table(table: DataFrame) -> list[dict]:
    return table.toArrow().sort_by("id").to_pylist()


def fit_nodes(train: DataFrame, features: Sequence[str], missing: float, label: str = "label", max_depth: int | None = None,
              min_leaf: int = 1, seed: int = ML.SEED, max_bins: int = ML.MAX_BINS) -> list[dict]:
    """H1 / H2 for deep trees of large tables: the tree ``ML.fit_tree`` fits, as nodes (with ``gain``)."""
    return Grower(train, features, missing, [Plan(None, min_leaf, ML.spark_depth(max_depth))], label, None, max_bins, seed).grown()


def fit_table(train: DataFrame, features: Sequence[str], missing: float, label: str = "label", max_depth: int | None = None,
              min_leaf: int = 1, seed: int = ML.SEED, max_bins: int = ML.MAX_BINS, grower: Grower | None = None) -> DataFrame:
    """``fit_nodes`` as a written table that the driver does not hold. ``grower``: trees of these rows grown together."""
    depth = ML.spark_depth(max_depth)
    if grower is None:
        grower = Grower(train, features, missing, [Plan(None, min_leaf, depth)], label, None, max_bins, seed)
    return grower.written(grower.number_of(None, min_leaf, depth), depth)


def grown_together(folded: DataFrame, features: Sequence[str], missing: float, label: str = "label", fold_col: str = "fold", k: int = 10,
                   depths: Sequence[int | None] = ML.GRID_MAX_DEPTH, leaves: Sequence[int] = ML.GRID_MIN_SAMPLES_LEAF,
                   splits: Sequence[int] = ML.GRID_MIN_SAMPLES_SPLIT, seed: int = ML.SEED, max_bins: int = ML.MAX_BINS,
                   cv_depth: int | None = None, whole: bool = True) -> Grower:
    """The trees of ``full_grid``, of ``cross_validation_scores`` at ``cv_depth`` and (``whole``) of all rows, in the same passes."""
    deepest = max(ML.spark_depth(d) for d in depths)
    plans = [Plan(f, leaf, deepest) for f in [*range(k), *([None] if whole else [])] for leaf in leaves]
    settings = [(d, s) for d in depths for s in splits] + ([(ML.spark_depth(cv_depth), 0)] if whole else [])
    return Grower(folded, features, missing, plans, label, fold_col, max_bins, seed, settings)


def shape_of(nodes: list[dict] | DataFrame) -> dict:
    """H3 of a fitted tree."""
    if isinstance(nodes, DataFrame):
        r = nodes.agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n")).first()
        return {"depth": r["depth"], "num_nodes": r["n"], "n_leaves": (r["n"] + 1) // 2}
    return {"depth": max(x["depth"] for x in nodes), "num_nodes": len(nodes), "n_leaves": (len(nodes) + 1) // 2}


def depth_report(nodes: list[dict] | DataFrame, asked: int | None) -> dict:
    """``ML.depth_report`` of a fitted tree."""
    reached = shape_of(nodes)["depth"]
    return {"asked_depth": asked, "effective_depth": reached,
            "limit_hit": reached >= ML.SPARK_MAX_DEPTH and (asked is None or asked > ML.SPARK_MAX_DEPTH)}


def feature_importance(nodes: list[dict] | DataFrame, features: Sequence[str]) -> list[tuple[str, float]]:
    """F2 of a fitted tree: gains weighed by rows, as shares; (feature, importance) descending."""
    total = dict.fromkeys(features, 0.0)
    if isinstance(nodes, DataFrame):
        sums = nodes.where("left is not null").groupBy("feature").agg(F.sum(F.col("gain") * F.col("n")).alias("s"))
        total |= {r["feature"]: r["s"] for r in sums.collect()}
    else:
        for x in nodes:
            if x["left"] is not None:
                total[x["feature"]] += x["gain"] * x["n"]
    whole = sum(total.values())
    return sorted(((f, v / whole if whole else 0.0) for f, v in total.items()), key=lambda r: (-r[1], r[0]))


class _Walk:
    """Vectorised walk of a node list."""

    def __init__(self, nodes: list[dict], features: Sequence[str]):
        self.index = {x["id"]: i for i, x in enumerate(nodes)}
        at = {f: i for i, f in enumerate(features)}
        self.feature = np.array([at[x["feature"]] if x["feature"] is not None else -1 for x in nodes])
        self.threshold = np.array([x["threshold"] if x["threshold"] is not None else 0.0 for x in nodes])
        self.left = np.array([self.index[x["left"]] if x["left"] is not None else -1 for x in nodes])
        self.right = np.array([self.index[x["right"]] if x["right"] is not None else -1 for x in nodes])
        self.n, self.depth = np.array([x["n"] for x in nodes]), np.array([x["depth"] for x in nodes])
        self.prediction = np.array([x["prediction"] for x in nodes])
        total = np.array([max(1.0, x["n0"] + x["n1"]) for x in nodes])
        self.probability = np.array([x["n1"] for x in nodes]) / total

    def leaves(self, x: np.ndarray, settings: Sequence[tuple[int | None, int]]) -> np.ndarray:
        """Node index at which each row stops, per (max_depth, min_split) setting."""
        node = np.zeros(len(x), np.int64)
        stop = np.full((len(settings), len(x)), -1)
        while True:
            inner = self.left[node] >= 0
            for s, (depth, split) in enumerate(settings):
                ends = ~inner | (self.n[node] < split) | (False if depth is None else self.depth[node] >= depth)
                stop[s] = np.where((stop[s] < 0) & ends, node, stop[s])
            if not inner.any():
                return stop
            go = np.flatnonzero(inner)
            f = self.feature[node[go]]
            node[go] = np.where(x[go, f] <= self.threshold[node[go]], self.left[node[go]], self.right[node[go]])


def _matrix(batch, features, missing: float) -> np.ndarray:
    cols = [np.asarray(batch.column(batch.schema.get_field_index(f)).to_numpy(zero_copy_only=False), float) for f in features]
    return np.nan_to_num(np.stack(cols, axis=1), nan=missing)


def score_nodes(df: DataFrame, nodes: list[dict] | DataFrame, features: Sequence[str], missing: float, key: str = "row_id",
                label: str = "label", keep: Sequence[str] = ()) -> DataFrame:
    """H4 + H5 from a tree's nodes: class and share of class 1 in the row's leaf."""
    if isinstance(nodes, DataFrame):
        if nodes.count() > WALK_NODES:
            return _score_by_subtree(df, nodes, features, missing, [key, label, *keep])
        nodes = nodes_from_table(nodes)
    walk = _Walk(nodes, features)
    cols = [key, label, *keep]
    types = dict(df.dtypes)

    def run(batches):
        for b in batches:
            leaf = walk.leaves(_matrix(b, features, missing), [(None, 0)])[0] if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(c)) for c in cols]
                + [pa.array(walk.prediction[leaf].astype(np.int32)), pa.array(walk.probability[leaf])], names=[*cols, "prediction", "probability"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in cols) + ", prediction int, probability double"
    return df.select(*dict.fromkeys([*cols, *features])).mapInArrow(run, schema)


def _score_by_subtree(df: DataFrame, table: DataFrame, features: Sequence[str], missing: float, cols: list[str]) -> DataFrame:
    """``score_nodes`` for a tree that no task holds whole: rows walk its upper nodes and meet the subtree below in a join.

    The upper nodes and the roots of the subtrees (one for some ten thousand rows learned) travel with the tasks. A subtree that
    many rows fall into is given to several tasks.
    """
    top = nodes_from_table(table.where("part = -1 or id = part"))
    roots = {x["id"] for x in top if x["part"] == x["id"] and x["left"] is not None}
    for x in top:
        if x["id"] in roots:
            x["feature"] = x["threshold"] = x["left"] = x["right"] = None
    upper, types = _Walk(top, features), dict(df.dtypes)
    part = np.array([x["id"] if x["id"] in roots else -1 for x in top])
    result = ", ".join(f"`{c}` {types[c]}" for c in cols) + ", prediction int, probability double"
    inputs = list(dict.fromkeys([*cols, *features]))

    def route(batches):
        for b in batches:
            leaf = upper.leaves(_matrix(b, features, missing), [(None, 0)])[0] if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part[leaf].astype(np.int32)), pa.array(upper.prediction[leaf].astype(np.int32)),
                                              pa.array(upper.probability[leaf])], names=[*b.schema.names, "_part", "prediction", "probability"])

    routed = cut_lineage(df.select(*inputs).mapInArrow(
        route, ", ".join(f"`{c}` {types[c]}" for c in inputs) + ", _part int, prediction int, probability double"))
    done = routed.where("_part = -1").select(*cols, "prediction", "probability")
    slots = (routed.where("_part >= 0").groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
             .select("_part", F.ceil(F.col("_n") / SLOT_ROWS).cast("int").alias("_slots")))
    rows = (routed.where("_part >= 0").drop("prediction", "probability").join(F.broadcast(slots), "_part")
            .withColumn("_slot", F.pmod(F.xxhash64(*inputs), F.col("_slots")).cast("int")).drop("_slots"))
    below = (table.where("part >= 0").withColumnRenamed("part", "_part").join(F.broadcast(slots), "_part")
             .withColumn("_slot", F.explode(F.sequence(F.lit(0), F.col("_slots") - 1))).drop("_slots"))

    def walk(left, right):
        cells = {c: left.column(c) for c in cols}
        if not left.num_rows:
            return pa.table({**cells, "prediction": pa.array([], pa.int32()), "probability": pa.array([], pa.float64())})
        tree = _Walk(right.sort_by("id").to_pylist(), features)
        x = np.nan_to_num(np.stack([np.asarray(left.column(f).to_numpy(), float) for f in features], axis=1), nan=missing)
        leaf = tree.leaves(x, [(None, 0)])[0]
        return pa.table({**cells, "prediction": pa.array(tree.prediction[leaf].astype(np.int32)), "probability": pa.array(tree.probability[leaf])})

    met = (rows.groupBy("_part", "_slot").cogroup(below.groupBy("_part", "_slot"))
           .applyInArrow(lambda left, right: walk(left, right), result))
    return done.unionByName(met)


def full_grid(folded: DataFrame, features: Sequence[str], missing: float, label: str = "label", fold_col: str = "fold", k: int = 10,
              depths: Sequence[int | None] = ML.GRID_MAX_DEPTH, leaves: Sequence[int] = ML.GRID_MIN_SAMPLES_LEAF,
              splits: Sequence[int] = ML.GRID_MIN_SAMPLES_SPLIT, seed: int = ML.SEED, parallelism: int | None = None,
              max_bins: int = ML.MAX_BINS, grower: Grower | None = None) -> list[dict]:
    """Mean fold accuracy of every (max_depth, min_samples_leaf, min_samples_split).

    ``folded`` should be a written table (it is read once a pass). A fold and leaf size is fitted once, at the
    engine's depth limit; all those trees grow together (``growth``, so ``parallelism`` has no effect), each in the
    tasks that hold its rows, where the held-out rows are judged too. Counts alone reach the driver. ``grower``: trees
    of ``grown_together`` with the same arguments.
    """
    settings = [(d, s) for d in depths for s in splits]
    if grower is None:
        grower = grown_together(folded, features, missing, label, fold_col, k, depths, leaves, splits, seed, max_bins, whole=False)
    got = grower.held_out(settings)
    parts = [{(p.min_leaf, s): got[(t, s)][0] / got[(t, s)][1] if got.get((t, s), (0, 0))[1] else None for s in range(len(settings))}
             for t, p in enumerate(grower.plans) if p.fold is not None]
    out = []
    for s, (d, split) in enumerate(settings):
        for leaf in leaves:
            acc = [p[(leaf, s)] for p in parts if p.get((leaf, s)) is not None]
            out.append({"max_depth": d, "min_samples_leaf": leaf, "min_samples_split": split,
                        "mean_accuracy": float(np.mean(acc)) if acc else None})
    order = {d: i for i, d in enumerate(depths)}
    return sorted(out, key=lambda x: (order[x["max_depth"]], x["min_samples_leaf"], x["min_samples_split"]))


def best_setting(grid: list[dict]) -> dict:
    """The first setting, in grid order, with the highest mean accuracy."""
    return max(grid, key=lambda x: x["mean_accuracy"] if x["mean_accuracy"] is not None else -1.0)
