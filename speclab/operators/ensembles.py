"""Forests and boosted trees, kept as node tables.

A forest is a number of fits on weighted rows: a row's weight in tree ``t`` is a Poisson draw from a hash of its key and
``t`` (a bootstrap without moving rows), so the rows a tree did not see are known and vote on it out of bag. Boosted
trees are Spark's own. Either way the model is one node table (tree, weight, node columns), and scoring,
dependence and scenarios need nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speclab.operators import models as ML
from speclab.operators import trees

POISSON_TERMS = 8             # a draw above it has a chance below 1 in a million
COLUMNS = ["id", "depth", "feature", "threshold", "left", "right", "n", "n0", "n1", "prediction"]
SCHEMA = "tree int, weight double, id int, depth int, feature string, threshold double, left int, right int, value double, n double"


class Scorer:
    """Share of class 1 from trees: the mean of the leaves' values, or the logistic of twice their weighted sum."""

    def __init__(self, table: list[dict], features: Sequence[str], boosted: bool = False):
        self.features, self.boosted = list(features), boosted
        at = {f: i for i, f in enumerate(self.features)}
        self.trees, self.weights = [], []
        for t in sorted({r["tree"] for r in table}):
            rows = sorted((r for r in table if r["tree"] == t), key=lambda r: r["id"])
            place = {r["id"]: i for i, r in enumerate(rows)}
            inner = [r["left"] is not None for r in rows]
            self.trees.append((np.array([at[r["feature"]] if x else -1 for r, x in zip(rows, inner)]),
                               np.array([r["threshold"] if x else 0.0 for r, x in zip(rows, inner)]),
                               np.array([place[r["left"]] if x else -1 for r, x in zip(rows, inner)]),
                               np.array([place[r["right"]] if x else -1 for r, x in zip(rows, inner)]),
                               np.array([r["value"] for r in rows])))
            self.weights.append(rows[0]["weight"])

    def leaf_values(self, x: np.ndarray, t: int) -> np.ndarray:
        feature, threshold, left, right, value = self.trees[t]
        node = np.zeros(len(x), np.int64)
        while True:
            go = np.flatnonzero(left[node] >= 0)
            if not len(go):
                return value[node]
            at = node[go]
            node[go] = np.where(x[go, feature[at]] <= threshold[at], left[at], right[at])

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t, w in enumerate(self.weights):
            total += w * self.leaf_values(x, t)
        return 1.0 / (1.0 + np.exp(-2.0 * total)) if self.boosted else total / max(1, len(self.trees))


def from_nodes(nodes: list[dict]) -> list[dict]:
    """One tree's nodes (``trees.nodes_of``) as an ensemble of one."""
    return [{"tree": 0, "weight": 1.0, **{c: x[c] for c in ("id", "depth", "feature", "threshold", "left", "right")},
             "value": x["n1"] / max(1.0, x["n0"] + x["n1"]), "n": float(x["n"])} for x in nodes]


def node_table(spark: SparkSession, table: list[dict]) -> DataFrame:
    """One row a node of every tree; a row goes left where its feature is at most the threshold."""
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in table], SCHEMA)


def _stored(spark: SparkSession, model, features: Sequence[str], boosted: bool) -> list[dict]:
    """The node table of a fitted Spark ensemble, from what Spark itself stores."""
    rows = spark.read.parquet(f"{trees.stored_model(spark, model, 'ensemble')}/data").collect()
    weights = list(ML.tree_of(model).treeWeights)
    depth = {}
    for r in sorted(rows, key=lambda r: (r["treeID"], r["nodeData"]["id"])):
        d = r["nodeData"]
        if d["leftChild"] >= 0:
            below = depth.get((r["treeID"], d["id"]), 0) + 1
            depth[(r["treeID"], d["leftChild"])] = depth[(r["treeID"], d["rightChild"])] = below
    out = []
    for r in rows:
        d = r["nodeData"]
        inner, stats = d["leftChild"] >= 0, [*d["impurityStats"], 0.0]
        out.append({"tree": r["treeID"], "weight": float(weights[r["treeID"]]), "id": d["id"], "depth": depth.get((r["treeID"], d["id"]), 0),
                    "feature": features[d["split"]["featureIndex"]] if inner else None,
                    "threshold": d["split"]["leftCategoriesOrThreshold"][0] if inner else None,
                    "left": d["leftChild"] if inner else None, "right": d["rightChild"] if inner else None,
                    "value": float(d["prediction"]) if boosted else stats[1] / max(1e-12, stats[0] + stats[1]), "n": float(d["rawCount"])})
    return out


def bootstrap_weight(key: str, tree: int, seed: int = ML.SEED):
    """How often a row stands in the tree's sample: a Poisson draw of mean 1 from a hash of its key."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(tree)), F.lit(str(seed)))), 1, 13), 16, 10).cast("double") / float(16 ** 13)
    edges = np.cumsum([math.exp(-1.0) / math.factorial(i) for i in range(POISSON_TERMS)])
    return sum((F.when(u >= float(e), 1).otherwise(0) for e in edges), F.lit(0)).cast("double")


def fit_forest(train: DataFrame, features: Sequence[str], label: str = "label", key: str = "row_id", count: int = 10,
               max_depth: int | None = None, min_leaf: int = 1, seed: int = ML.SEED, max_bins: int = ML.MAX_BINS,
               parallelism: int | None = None) -> list[dict]:
    """The node table of ``count`` trees; each split looks at a random root of the features. ``train`` should be written: every fit reads it."""
    spark, feats = train.sparkSession, list(features)

    def one(t):
        rows = train.withColumn("_w", bootstrap_weight(key, t, seed)).where("_w > 0")
        rf = RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="_w", numTrees=1, bootstrap=False, subsamplingRate=1.0,
                                    featureSubsetStrategy="sqrt", maxDepth=ML.spark_depth(max_depth), minInstancesPerNode=min_leaf,
                                    maxBins=max_bins, seed=seed + t, cacheNodeIds=True)
        model = Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="error"), rf]).fit(rows)
        return [{**r, "tree": t} for r in _stored(spark, model, feats, False)]

    with ThreadPoolExecutor(max_workers=parallelism or ML.default_parallelism(spark)) as ex:
        return [r for part in ex.map(one, range(count)) for r in part]


def fit_boosted(train: DataFrame, features: Sequence[str], label: str = "label", count: int = 10, max_depth: int = 5,
                step: float = 0.1, seed: int = ML.SEED, max_bins: int = ML.MAX_BINS) -> list[dict]:
    """The node table of boosted trees (values are margins, weights their step sizes)."""
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=count, maxDepth=max_depth, stepSize=step, seed=seed, maxBins=max_bins)
    model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error"), gbt]).fit(train)
    return _stored(train.sparkSession, model, list(features), True)


def _matrix(batch, features: Sequence[str], missing: float) -> np.ndarray:
    return trees._matrix(batch, features, missing) if batch.num_rows else np.zeros((0, len(features)))


def score(df: DataFrame, table: list[dict], features: Sequence[str], missing: float, boosted: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` and ``prediction``, ``probability`` of every row; missing features are seen as ``missing``."""
    scorer, types = Scorer(table, features, boosted), dict(df.dtypes)
    keep = list(keep)

    def run(batches):
        for b in batches:
            p = scorer.probability(_matrix(b, scorer.features, missing))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array((p > 0.5).astype(np.int32)), pa.array(p)],
                                             names=[*keep, "prediction", "probability"])

    return df.select(*dict.fromkeys([*keep, *features])).mapInArrow(
        run, "".join(f"`{c}` {types[c]}, " for c in keep) + "prediction int, probability double")


def out_of_bag(train: DataFrame, table: list[dict], features: Sequence[str], missing: float, label: str = "label", key: str = "row_id",
               seed: int = ML.SEED) -> DataFrame:
    """``(key, label, votes, prediction, probability)`` of the training rows from the trees that did not see them.

    A row that every tree saw has no vote: prediction and probability are null.
    """
    scorer, types = Scorer(table, features), dict(train.dtypes)
    numbers = sorted({r["tree"] for r in table})
    rows = train.select(*dict.fromkeys([key, label, *features]), F.array(*[bootstrap_weight(key, t, seed) == 0 for t in numbers]).alias("_out"))

    def run(batches):
        for b in batches:
            x = _matrix(b, scorer.features, missing)
            out = np.array(b.column(b.schema.get_field_index("_out")).to_pylist(), bool).reshape(len(x), len(numbers))
            total = np.zeros(len(x))
            for t in range(len(numbers)):
                seen = np.flatnonzero(out[:, t])
                total[seen] += scorer.leaf_values(x[seen], t)
            votes = out.sum(1)
            p = total / np.maximum(votes, 1)
            none = votes == 0
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(key)), b.column(b.schema.get_field_index(label)), pa.array(votes.astype(np.int32)),
                 pa.array((p > 0.5).astype(np.int32), mask=none), pa.array(p, mask=none)], names=[key, label, "votes", "prediction", "probability"])

    return rows.mapInArrow(run, f"`{key}` {types[key]}, `{label}` {types[label]}, votes int, prediction int, probability double")
