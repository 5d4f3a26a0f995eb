"""What a fitted model says about settings, and what history says about its advice.

Partial dependence sums the model over all rows for every grid value in one pass. Scenarios are searched twice: over a
numbered lattice of the data's own quantiles, enumerated by number ranges with a bounded best list a task, and
exactly, over the leaves of a tree, each of which is a box of settings with one score. History is split at such a box.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speclab.operators.ensembles import Scorer, _matrix
from speclab.operators.profile import melt_features
from speclab.operators.quantiles import exact_quantiles

Z = 1.959963984540054        # two-sided 95 % point of the normal distribution


def quantile_grid(df: DataFrame, features: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """The distinct values of the features' exact quantiles, ascending; at most features x probabilities numbers."""
    rows = exact_quantiles(melt_features(df, [], features), ["variable"], "value", probs).collect()
    return {f: sorted({r["quantile"] for r in rows if r["variable"] == f}) for f in features}


def partial_dependence(df: DataFrame, scorer: Scorer, grid: Mapping[str, Sequence[float]], missing: float) -> DataFrame:
    """``(feature, value, n, dependence)``: the model's mean over all rows, had each the grid value of the feature.

    One pass: a batch is scored at every grid value and only the sums leave the task. Missing features are seen as
    ``missing``. No rows: no result.
    """
    cells = [(f, float(v)) for f in grid for v in grid[f]]
    at = {f: i for i, f in enumerate(scorer.features)}

    def run(batches):
        total, n = np.zeros(len(cells)), 0
        for b in batches:
            x = _matrix(b, scorer.features, missing)
            n += len(x)
            for k, (f, v) in enumerate(cells):
                was = x[:, at[f]].copy()
                x[:, at[f]] = v
                total[k] += scorer.probability(x).sum()
                x[:, at[f]] = was
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in cells]), pa.array([v for _, v in cells], pa.float64()), pa.array([n] * len(cells)),
                                              pa.array(total)], names=["feature", "value", "n", "total"])

    parts = df.select(*scorer.features).mapInArrow(run, "feature string, value double, n long, total double")
    return parts.groupBy("feature", "value").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("dependence"))


def scenario_grid_search(spark: SparkSession, scorer: Scorer, levels: Mapping[str, Sequence[float]], k: int = 10,
                         block: int = 1 << 16) -> DataFrame:
    """The ``k`` settings of highest score of the lattice of ``levels``, ties to the smaller lattice number.

    Setting number = mixed-radix digits of the levels, the last feature running fastest. Tasks enumerate ranges of
    numbers in blocks and keep ``k`` each, so neither rows nor memory grow with the lattice. A feature without levels
    leaves no settings.
    """
    feats = scorer.features
    axes = [np.array(levels[f], float) for f in feats]
    total = math.prod(len(a) for a in axes)

    def run(batches):
        best: list[tuple[float, int]] = []
        for b in batches:
            number = b.column(0).to_numpy()
            for at in range(0, len(number), block):
                part = number[at:at + block]
                digits = np.unravel_index(part, [len(a) for a in axes])
                p = scorer.probability(np.stack([a[d] for a, d in zip(axes, digits)], 1))
                top = np.lexsort((part, -p))[:k]
                best = heapq.nsmallest(k, best + list(zip((-p[top]).tolist(), part[top].tolist())))
        yield pa.RecordBatch.from_arrays([pa.array([n for _, n in best], pa.int64()), pa.array([-s for s, _ in best], pa.float64())], names=["setting", "score"])

    found = spark.range(total).mapInArrow(run, "setting long, score double").orderBy(F.desc("score"), "setting").limit(k)
    out, step = [], total
    for f, a in zip(feats, axes):
        step //= max(1, len(a))
        digit = F.pmod(F.floor(F.col("setting") / step), F.lit(len(a))).cast("int")
        out.append(F.element_at(F.array(*[F.lit(float(v)) for v in a]), digit + 1).alias(f) if len(a) else F.lit(None).cast("double").alias(f))
    return found.select("setting", "score", *out)


def leaf_boxes(nodes: list[dict], ranges: Mapping[str, tuple[float, float]], k: int = 10, least_rows: int = 1) -> list[dict]:
    """X10 without a lattice: the ``k`` leaves of a tree's nodes with the highest share of class 1 inside the feasible ranges.

    A leaf is a box (lower, upper] of settings with one score, so the best leaf that meets the ranges holds the best
    setting. Ties: more training rows, then the smaller node number. Leaves of fewer than ``least_rows`` rows do not count.
    """
    by_id, out, todo = {x["id"]: x for x in nodes}, [], [(0, {})]
    while todo:
        at, box = todo.pop()
        x = by_id[at]
        if x["left"] is None:
            cut = {f: (max(ranges[f][0], box.get(f, (-math.inf, math.inf))[0]), min(ranges[f][1], box.get(f, (-math.inf, math.inf))[1])) for f in ranges}
            # a range is closed, a box is open below
            meets = all(lo <= hi and (hi > box.get(f, (-math.inf, math.inf))[0]) for f, (lo, hi) in cut.items())
            if meets and x["n"] >= least_rows:
                out.append({"node": at, "n": x["n"], "score": x["n1"] / max(1.0, x["n0"] + x["n1"]),
                            "box": {f: (box.get(f, (-math.inf, math.inf))[0], box.get(f, (-math.inf, math.inf))[1]) for f in ranges}, "settings": cut})
            continue
        lo, hi = box.get(x["feature"], (-math.inf, math.inf))
        todo.append((x["left"], {**box, x["feature"]: (lo, min(hi, x["threshold"]))}))
        todo.append((x["right"], {**box, x["feature"]: (max(lo, x["threshold"]), hi)}))
    return heapq.nsmallest(k, out, key=lambda x: (-x["score"], -x["n"], x["node"]))


def box_table(spark: SparkSession, boxes: list[dict]) -> DataFrame:
    """``(rank, node, n, score, feature, lower, upper)``: the feasible settings of each box, best first."""
    rows = [(i + 1, x["node"], int(x["n"]), float(x["score"]), f, float(lo), float(hi)) for i, x in enumerate(boxes) for f, (lo, hi) in x["settings"].items()]
    return spark.createDataFrame(rows, "rank int, node int, n long, score double, feature string, lower double, upper double")


def inside(box: Mapping[str, tuple[float, float]], closed: bool = False):
    """Whether a row lies in a box (lower, upper], or [lower, upper] if ``closed``; a missing reading lies in no limited range."""
    cond = F.lit(True)
    for f, (lo, hi) in box.items():
        v = F.col(f).cast("double")
        if lo > -math.inf:
            cond = cond & ((v >= float(lo)) if closed else (v > float(lo)))
        if hi < math.inf:
            cond = cond & (v <= float(hi))
    return F.coalesce(cond, F.lit(False))


def historical_validation(df: DataFrame, within, label: str = "label") -> DataFrame:
    """Rows and in-spec share inside a recommended box against outside, with a 95 % interval of the difference.

    ``(n_inside, good_inside, share_inside, n_outside, good_outside, share_outside, difference, lower, upper)``, one row. The
    interval combines the Wilson intervals of the two shares. Rows without a label take no part; an empty side has a
    null share, and then difference and interval are null.
    """
    rows = df.where(F.col(label).isNotNull()).select(within.alias("_in"), (F.col(label) == 1).cast("int").alias("_good"))
    t = rows.agg(F.count_if("_in").alias("n_inside"), F.count_if(F.col("_in") & (F.col("_good") == 1)).alias("good_inside"),
                 F.count_if(~F.col("_in")).alias("n_outside"), F.count_if(~F.col("_in") & (F.col("_good") == 1)).alias("good_outside"))
    for side in ("inside", "outside"):
        n, p = F.col(f"n_{side}").cast("double"), F.col(f"share_{side}")
        t = t.withColumn(f"share_{side}", F.try_divide(F.col(f"good_{side}").cast("double"), n))
        half = Z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(Z * Z), 4 * n * n))
        t = t.withColumn(f"_lo_{side}", F.when(n > 0, F.try_divide(p + F.try_divide(F.lit(Z * Z), 2 * n) - half, 1 + F.try_divide(F.lit(Z * Z), n))))
        t = t.withColumn(f"_hi_{side}", F.when(n > 0, F.try_divide(p + F.try_divide(F.lit(Z * Z), 2 * n) + half, 1 + F.try_divide(F.lit(Z * Z), n))))
    a, b = F.col("share_inside"), F.col("share_outside")
    return t.select("n_inside", "good_inside", "share_inside", "n_outside", "good_outside", "share_outside", (a - b).alias("difference"),
                    (a - b - F.sqrt((a - F.col("_lo_inside")) ** 2 + (F.col("_hi_outside") - b) ** 2)).alias("lower"),
                    (a - b + F.sqrt((F.col("_hi_inside") - a) ** 2 + (b - F.col("_lo_outside")) ** 2)).alias("upper"))
