"""Stage pipelines (P1-P9) over a ``TargetSpec``.

Stage 01 (preprocess) is one lazy chain; the driver only receives k-row
metadata (constant columns, column kinds, correlations, chi-square results) to
choose the next ``select``. The cleaned frame and the final keyed frame
(features, label, split) are written to the shared checkpoint folder, so lost
executors recompute from stored data, not from the whole lineage.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speclab.functions import scalar as S
from speclab.operators import clean as B
from speclab.operators import impute
from speclab.operators import metrics as H
from speclab.operators import models as ML
from speclab.operators import profile as D
from speclab.operators import select as M
from speclab.operators import split as G
from speclab.operators import trees
from speclab.plans.targets import MISSING, RESULT_COLUMNS, TargetSpec
from speclab.session import cut_lineage, ensure_checkpoint_dir, release_at_exit
from speclab.sources.readings import readings

KEY, LABEL = "row_id", "label"


@dataclass
class Prepared:
    spec: TargetSpec
    df: DataFrame                       # row_id, features..., label, split
    features: list[str]
    report: dict = field(default_factory=dict)


def labelled(rd: DataFrame, spec: TargetSpec, drop_constants: bool = True) -> tuple[DataFrame, dict]:
    """B1 -> B2 -> B5/B6 -> B3/D4 -> S1-S3 -> B4 -> S4 -> S6-S10."""
    rep: dict = {}
    df = rd.drop(*[c for c in RESULT_COLUMNS if c != spec.result_col]).withColumnRenamed(spec.result_col, "result")
    df = B.filter_product_test(df, spec.product, spec.tests)
    df = B.drop_columns(df, spec.drop_cols)
    df = B.dropna_subset(df, spec.null_subset) if spec.null_rule == "subset" else B.dropna_any(df)
    if spec.known_constants:
        df = B.drop_columns(df, [c for c in spec.known_constants if c in df.columns], strict=False)
    elif drop_constants:
        df = cut_lineage(df)      # the product's rows: the tables are read and joined once
        df, rep["constant_columns"] = D.drop_constant_columns(df, keep=[KEY, "result"])
    if "swirl" in df.columns:
        df = df.withColumn("swirl", S.map_codes("swirl", S.SWIRL_CODES))
    if spec.encode_text:
        if "method" in df.columns:
            df = df.withColumn("method", S.map_codes("method", S.METHOD_CODES))
        if "batch_source" in df.columns:
            df = df.withColumn("batch_source",
                               S.map_codes(S.normalize_whitespace("batch_source"), S.MILK_SOURCE_CODES))
    if spec.sentinel:
        df = B.drop_sentinel_rows(df, "result", spec.sentinel)
    df = df.withColumn(LABEL, spec.label_expr(F.col("result"))).drop("result")
    return df, rep


def select_features(df: DataFrame, spec: TargetSpec) -> tuple[DataFrame, list[str], dict]:
    """M7 -> M3 -> M4 -> M5/M6 on the columns; every row stays."""
    rep: dict = {}
    feats = [c for c in df.columns if c not in (KEY, LABEL)]
    if not spec.use_corr and not spec.use_chi2:
        return df, feats, rep                       # T1, T4: no typing, no selection
    kinds = M.kinds_of(df, feats)
    rep["kinds"] = kinds
    df = M.apply_kinds(df, kinds, keep=[KEY, LABEL])
    numeric = [c for c in feats if kinds[c] == "numeric"]
    if spec.use_corr and numeric:
        df, r3 = M.remove_highly_correlated_features(df, numeric)
        rep["correlated_dropped"] = [r["dropped"] for r in r3.collect()]
        numeric = [c for c in numeric if c in df.columns]
        df, rep["low_target_corr_dropped"] = M.drop_low_target_correlation(df, numeric, LABEL)
    if spec.use_chi2:
        cats = [c for c in df.columns if kinds.get(c) == "category"]
        df, r6 = M.drop_associated_categoricals(df, cats)
        rep["chi2_dropped"] = [r["column_name"] for r in r6.collect()]
    return df, [c for c in df.columns if c not in (KEY, LABEL)], rep


def coerce_features(df: DataFrame, feats: list[str]) -> tuple[DataFrame, list[str], dict]:
    """Every feature numeric (dirt -> NULL) in every split; a column without any numeric value is
    dropped. No row is: the report counts the rows of each split with a missing feature."""
    others = [c for c in df.columns if c not in feats]
    df = df.select(*others, *[S.coerce_numeric(F.col(c).cast("string")).cast("double").alias(c) for c in feats])
    df = df.withColumn(LABEL, F.col(LABEL).cast("int"))
    nn = df.agg(*[F.count(c).alias(c) for c in feats]).first().asDict() if feats else {}
    empty = [c for c in feats if not nn[c]]
    feats = [c for c in feats if c not in empty]
    df = df.drop(*empty)
    return df, feats, {"non_numeric_dropped": empty}


def preprocess(spark: SparkSession, sf_dir: str, spec: TargetSpec, rd: DataFrame | None = None,
               smote_k: int = 5) -> Prepared:
    """Stage 01 end to end -> keyed frame with ``split`` (and ``synthetic``).

    T1 / T4: labelled rows are split as they are. The others select columns, split, coerce, fill missing
    readings (``TargetSpec.missing``) and balance train and test; the validation split keeps every row. ``report["rows"]``:
    rows after each step and, by split, rows with a missing feature.
    """
    rd = rd if rd is not None else readings(spark, sf_dir)
    df, rep = labelled(rd, spec)
    df = cut_lineage(df)          # the metadata passes and the result read this table
    rep["rows"] = {"labelled": df.count()}
    if "swirl" in df.columns:
        rep["rows"]["unmapped_swirl"] = B.unmapped_rows(df, "swirl").count()
    sel, feats, rep2 = select_features(df, spec)
    rep.update(rep2)
    out = G.split_80_20(sel, KEY) if spec.split == "80_20" else G.split_70_15_15(sel, KEY)
    if spec.smote:
        out, feats, rep3 = coerce_features(out, feats)
        rep.update(rep3)
        if feats:
            gap = F.greatest(*[F.col(c).isNull() for c in feats]) if len(feats) > 1 else F.col(feats[0]).isNull()
            rep["rows"]["missing_feature"] = {r["split"]: r["n"] for r in
                                              out.where(gap).groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
            if spec.missing == "drop":
                out = out.where(~(gap & F.col("split").isin(list(spec.balance_splits))))
            elif spec.missing == "impute":
                # fitted on the training rows alone, applied to every split
                medians = cut_lineage(impute.fit_medians(out.where("split = 'train'"), feats))
                out = impute.impute_missing(out, medians, feats)
                rep["imputation"] = {r["variable"]: r["value"] for r in medians.collect()}
        from speclab.operators.smote import smote_oversample
        filled = out.select(*[c for c in out.columns if c not in feats],
                            *[F.coalesce(F.col(c), F.when(F.col("split").isin(list(spec.balance_splits)), F.lit(MISSING))).alias(c)
                              for c in feats])
        out = smote_oversample(filled, feats, LABEL, splits=spec.balance_splits, k=smote_k)
    else:
        out = out.withColumn("synthetic", F.lit(False))
    return Prepared(spec, cut_lineage(out), feats, rep)


def descriptive_report(df: DataFrame, variables: list[str], label: str = LABEL) -> dict[str, DataFrame]:
    """The stage-02 profile of one target's variables against its label.

    The input is read twice: once for the class distribution, once for the written
    (label, variable, value) counts that the other three tables derive from.
    """
    counts = D.label_value_counts(df, label, variables)
    return {
        "class_distribution": D.class_distribution(df, label),
        "numeric_statistics": D.numeric_statistics(None, variables, counts=counts),
        "grouped_statistics": D.grouped_statistics(None, label, variables, counts=counts),
        "boxplot_summary": D.boxplot_summary(None, label, variables, counts=counts),
    }


@dataclass
class Trained:
    """Stage 03: the chosen tree (as saved), its features, and all result tables."""
    nodes_path: str
    features: list[str]
    tables: dict[str, DataFrame]


def _long(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(t, k, m, None if v is None else float(v)) for t, k, m, v in rows],
                                 "table string, item string, metric string, value double")


def _melted(df: DataFrame, table: str, item) -> DataFrame:
    """A result table in long form (table, item, metric, value)."""
    numbers = [c for c, t in df.dtypes if t in ("int", "bigint", "double")]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers]))
    return df.select(F.lit(table).alias("table"), item.alias("item"), cells.alias("c")).select("table", "item", "c.*")


def train_report(prep: Prepared, parallelism: int | None = None, folds: int = 10, max_bins: int = ML.MAX_BINS) -> Trained:
    """Default and depth-limited trees, CV scores, the whole grid, the chosen tree refitted, saved and evaluated.

    Everything after the grid uses the chosen tree. The folded training frame is written once; all trees of the
    stage grow in the same passes over it, and a tree of all rows is a written table that the driver does not hold.
    """
    spark, feats = prep.df.sparkSession, prep.features
    filled = prep.df.fillna(MISSING, subset=feats)
    train = filled.where(F.col("split") == "train")
    fit_on = filled.where(F.col("split").isin("train", "test"))
    folded = cut_lineage(G.stratified_folds(train, LABEL, KEY, k=folds))
    rows: list[tuple] = []
    grower = trees.grown_together(folded, feats, MISSING, LABEL, k=folds, max_bins=max_bins, cv_depth=prep.spec.max_depth)
    for name, depth in (("tree_default", None), ("tree_limited", prep.spec.max_depth)):
        nodes = trees.fit_table(folded, feats, MISSING, LABEL, depth, max_bins=max_bins, grower=grower)
        rep = trees.depth_report(nodes, depth)
        rows += [(name, "shape", k, v) for k, v in trees.shape_of(nodes).items()]
        rows += [(name, "shape", "effective_depth", rep["effective_depth"]), (name, "shape", "depth_limit_hit", int(rep["limit_hit"]))]
        scored = trees.score_nodes(fit_on, nodes, feats, MISSING, keep=("split",))
        rows += [(name, r["split"], m, r[m]) for r in H.evaluate_model(scored).collect() for m in r.asDict() if m != "split"]
    cv = ML.cross_validation_scores(folded, feats, LABEL, k=folds, max_depth=prep.spec.max_depth, parallelism=parallelism,
                                    grower=grower if max_bins == ML.MAX_BINS else None)
    scores = {r["fold"]: r["score"] for r in cv.collect()}
    rows += [("cv_scores", str(f), "score", s) for f, s in scores.items()]
    rows += [("cv_summary", "all", m, v) for m, v in D.cv_score_summary(cv).first().asDict().items()]
    grid = trees.full_grid(folded, feats, MISSING, LABEL, k=folds, parallelism=parallelism, max_bins=max_bins, grower=grower)
    rows += [("grid_search", f"{g['max_depth']}/{g['min_samples_leaf']}/{g['min_samples_split']}", "mean_accuracy", g["mean_accuracy"])
             for g in grid]
    best = trees.best_setting(grid)
    rows += [("best_params", "chosen", k, -1.0 if v is None else v) for k, v in best.items()]
    fitted = trees.fit_table(folded, feats, MISSING, LABEL, best["max_depth"], best["min_samples_leaf"], max_bins=max_bins, grower=grower)
    rows += [("best_params", "chosen", "depth_limit_hit", int(trees.depth_report(fitted, best["max_depth"])["limit_hit"]))]
    nodes = trees.truncated(fitted, best["max_depth"], best["min_samples_split"])
    path = os.path.join(ensure_checkpoint_dir(spark), "speclab-models", f"{prep.spec.name}-{uuid.uuid4().hex}")
    nodes.write.parquet(path)
    release_at_exit(spark, path)
    rows += [("feature_importance", f, "importance", v) for f, v in trees.feature_importance(fitted, feats)]
    nodes = spark.read.parquet(path)
    scored = trees.score_nodes(fit_on, nodes, feats, MISSING, keep=("split",))
    tables = {"report": _long(spark, rows), "evaluation": H.evaluate_model(scored), "rules": trees.node_table(spark, nodes),
              "grid": _long(spark, [r for r in rows if r[0] in ("grid_search", "best_params")]), "scored": scored}
    return Trained(path, feats, tables)


def validation_report(spark: SparkSession, trained: Trained, prep: Prepared) -> DataFrame:
    """The saved tree, loaded, on the held-out split: H6, H7, H8 and the probability ROC (H10), long form."""
    val = prep.df.where(F.col("split") == "val")
    scored = cut_lineage(trees.score_nodes(val, spark.read.parquet(trained.nodes_path), trained.features, MISSING))
    roc = H.roc_curve_from_scores(scored, LABEL, "probability")
    cm = H.confusion_matrix(scored)
    return (_melted(H.accuracy(scored), "accuracy", F.lit("all"))
            .unionByName(_melted(cm, "confusion_matrix", F.concat_ws("/", F.col("actual"), F.col("predicted"))))
            .unionByName(_melted(H.classification_report(scored), "classification_report", F.col("row_label")))
            .unionByName(_melted(roc, "roc_curve", F.col("threshold").cast("string"))))
