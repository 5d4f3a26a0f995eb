"""Decision trees with Spark ML.

Training, cross-validation and scoring are Spark jobs over the keyed frame; the
driver only holds models and k-row metric lists. Differences from a
single-machine CART, stated once: Spark caps depth at 30 (deeper / unlimited
settings map to 30; ``depth_report`` says whether that cut a tree) and bins continuous
features (``max_bins``, 256 unless set). ``min_samples_split`` and the full grid are in
``trees``; the trees of large tables are grown by ``growth``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK_MAX_DEPTH = 30
MAX_BINS = 256
SEED = 123
# The reference's grid (depth None means unlimited).
GRID_MAX_DEPTH = [None, 10, 20, 30, 50]
GRID_MIN_SAMPLES_LEAF = [1, 2, 4]
GRID_MIN_SAMPLES_SPLIT = [2, 5, 10]


def default_parallelism(spark: SparkSession, cap: int = 8) -> int:
    """Concurrent fits for CV / grid search: the session's task slots, capped."""
    return max(1, min(cap, spark.sparkContext.defaultParallelism))


def spark_depth(d: int | None) -> int:
    return SPARK_MAX_DEPTH if d is None else min(int(d), SPARK_MAX_DEPTH)


def tree_pipeline(features: Sequence[str], label: str = "label", max_depth: int | None = None,
                  min_leaf: int = 1, seed: int = SEED, max_bins: int = MAX_BINS) -> Pipeline:
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    dt = DecisionTreeClassifier(featuresCol="features", labelCol=label, impurity="gini",
                                maxDepth=spark_depth(max_depth), minInstancesPerNode=min_leaf,
                                maxBins=max_bins, seed=seed,
                                # deep trees: keep each row's node id on the executors instead of
                                # shipping the growing tree every level (checkpointed every 10)
                                cacheNodeIds=True)
    return Pipeline(stages=[asm, dt])


def fit_tree(train: DataFrame, features: Sequence[str], label: str = "label",
             max_depth: int | None = None, min_leaf: int = 1, seed: int = SEED, max_bins: int = MAX_BINS) -> PipelineModel:
    """H1 (max_depth None -> 30) / H2 (depth limited). ``max_bins``: split points tried per feature."""
    return tree_pipeline(features, label, max_depth, min_leaf, seed, max_bins).fit(train)


def depth_report(model, asked: int | None) -> dict:
    """The depth asked for, the depth reached, and whether the engine's limit cut the tree."""
    reached = int(tree_of(model).depth)
    return {"asked_depth": asked, "effective_depth": reached,
            "limit_hit": reached >= SPARK_MAX_DEPTH and (asked is None or asked > SPARK_MAX_DEPTH)}


def tree_of(model):
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def tree_shape(spark: SparkSession, model) -> DataFrame:
    """H3: depth, node count and leaves ((nodes + 1) / 2 in a binary tree)."""
    t = tree_of(model)
    return spark.createDataFrame([(int(t.depth), int(t.numNodes), int((t.numNodes + 1) // 2))],
                                 "depth int, num_nodes int, n_leaves int")


def predict_labels(model, df: DataFrame, key: str = "row_id", label: str = "label",
                   keep: Sequence[str] = ()) -> DataFrame:
    """H4 + H5: class and P(class 1) per row (plus any ``keep`` columns)."""
    out = model.transform(df)
    cols = [c for c in (key, label, *keep) if c in df.columns]
    return out.select(*cols, F.col("prediction").cast("int").alias("prediction"),
                      vector_to_array("probability")[1].alias("probability"))


def feature_importance_ranked(spark: SparkSession, model, features: Sequence[str]) -> DataFrame:
    """(feature, importance) descending."""
    imp = tree_of(model).featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, [float(v) for v in imp])),
                                 "feature string, importance double").orderBy(F.desc("importance"), "feature")


def tree_rules(spark: SparkSession, model, features: Sequence[str]) -> DataFrame:
    """The tree as text, one rule per row, feature indices replaced by names."""
    text = tree_of(model).toDebugString
    for i in sorted(range(len(features)), reverse=True):
        text = text.replace(f"feature {i} ", f"{features[i]} ")
    lines = [ln for ln in text.splitlines()[1:] if ln.strip()]
    return spark.createDataFrame([(i, ln.rstrip()) for i, ln in enumerate(lines)], "line int, rule string")


def cross_validation_scores(df: DataFrame, features: Sequence[str], label: str = "label",
                            fold_col: str = "fold", k: int = 10, max_depth: int | None = None,
                            min_leaf: int = 1, seed: int = SEED, parallelism: int | None = None, grower=None) -> DataFrame:
    """Accuracy per fold (stratified fold column). The folds' trees grow together (``growth``; ``parallelism``
    has no effect). A missing feature is an error, as in ``fit_tree``. ``grower``: deeper trees of the same rows and folds, without
    missing features, to judge at ``max_depth``."""
    from speclab.operators.growth import Grower, Plan
    depth = spark_depth(max_depth)
    if grower is None:
        grower = Grower(df, features, None, [Plan(f, min_leaf, depth) for f in range(k)], label, fold_col, MAX_BINS, seed)
    got, number = grower.held_out([(depth, 0)]), [grower.number_of(f, min_leaf, depth) for f in range(k)]
    scores = [(f, got[(t, 0)][0] / got[(t, 0)][1] if got.get((t, 0), (0, 0))[1] else None) for f, t in enumerate(number)]
    return df.sparkSession.createDataFrame(scores, "fold int, score double")
