"""Second moments of all column pairs in one pass, and what derives from them.

Every task reduces its rows to one row a pair: how many rows hold both values, and their sums, squares and
product around a fixed origin. Those rows add up; nothing else crosses the shuffle, whatever the number of columns.
The k x k result alone reaches the driver.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from speclab.operators.quantiles import ranged
from speclab.session import cut_lineage, ensure_checkpoint_dir, release_at_exit

CONSTANT = 1e-12           # variance below this share of the mean square around the origin is rounding
SUMS = ("n", "sa", "sb", "qa", "qb", "g")


def doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles named by position, NaN as null."""
    out = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        out.append(F.when(~F.isnan(v), v).alias(f"v{i}"))
    return df.select(*out)


def pair_sums(df: DataFrame, columns: Sequence[str], origin: Sequence[float] | None = None) -> tuple[DataFrame, list[float]]:
    """``(pos_a, pos_b, n, sa, sb, qa, qb, g)`` for ``pos_a <= pos_b``, and the origin of each column.

    Sums over the rows that hold both values: of ``a`` and ``b`` less their origins, of their squares and of their
    product. One scan of ``df``. Where no origin is given, a task sums around the means of its first batch, its rows are
    written, and all are moved to the mean of the tasks' origins. Null and NaN are missing; an empty input gives
    counts of 0.
    """
    cols = list(columns)
    x, k = doubles(df, cols), len(cols)
    a, b = np.triu_indices(k)
    fixed = None if origin is None else np.array(origin, float)

    def run(batches):
        total, o = np.zeros((len(SUMS), k, k)), fixed
        for batch in batches:
            raw = np.stack([np.asarray(batch.column(i).to_numpy(zero_copy_only=False), float) for i in range(k)], 1)
            have = ~np.isnan(raw)
            if o is None and len(raw):
                o = np.where(have, raw, 0.0).sum(0) / np.maximum(have.sum(0), 1)
                o = np.where(np.isfinite(o), o, 0.0)
            if len(raw):
                z, one = np.where(have, raw - o, 0.0), have.astype(float)
                s, q = z.T @ one, (z * z).T @ one
                total += np.stack([one.T @ one, s, s.T, q, q.T, z.T @ z])
        o = np.zeros(k) if o is None else o
        yield pa.RecordBatch.from_arrays(
            [pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(o[a]), pa.array(o[b]), *(pa.array(t[a, b]) for t in total)],
            names=["pos_a", "pos_b", "oa", "ob", *SUMS])

    parts = x.mapInArrow(run, "pos_a int, pos_b int, oa double, ob double, " + ", ".join(f"{s} double" for s in SUMS))
    if origin is None:
        parts = cut_lineage(parts)
        near = {r["pos_a"]: r["o"] for r in parts.where("pos_a = pos_b and n > 0").groupBy("pos_a").agg(F.avg("oa").alias("o")).collect()}
        origin = [float(near.get(i, 0.0)) for i in range(k)]
        at = F.array(*[F.lit(v) for v in origin])
        da, db = F.col("oa") - F.element_at(at, F.col("pos_a") + 1), F.col("ob") - F.element_at(at, F.col("pos_b") + 1)
        n, sa, sb = F.col("n"), F.col("sa"), F.col("sb")
        parts = parts.where("n > 0").select(
            "pos_a", "pos_b", "n", (sa + n * da).alias("sa"), (sb + n * db).alias("sb"), (F.col("qa") + 2 * da * sa + n * da * da).alias("qa"),
            (F.col("qb") + 2 * db * sb + n * db * db).alias("qb"), (F.col("g") + db * sa + da * sb + n * da * db).alias("g"))
        every = df.sparkSession.createDataFrame([(int(i), int(j), *[0.0] * len(SUMS)) for i, j in zip(a, b)],
                                                "pos_a int, pos_b int, " + ", ".join(f"{s} double" for s in SUMS))
        parts = parts.unionByName(every)          # pairs that no row holds
    return parts.groupBy("pos_a", "pos_b").agg(*[F.sum(s).alias(s) for s in SUMS]), list(origin)


def correlation_of(sums: DataFrame) -> DataFrame:
    """``sums`` and ``r``: Pearson's correlation, null where a side is constant or fewer than two rows hold both."""
    n = F.col("n")
    va, vb = n * F.col("qa") - F.col("sa") * F.col("sa"), n * F.col("qb") - F.col("sb") * F.col("sb")
    varies = (va > CONSTANT * n * F.col("qa")) & (vb > CONSTANT * n * F.col("qb")) & (n > 1)
    r = (n * F.col("g") - F.col("sa") * F.col("sb")) / (F.sqrt(va) * F.sqrt(vb))
    r = F.when(F.col("pos_a") == F.col("pos_b"), F.lit(1.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return sums.withColumn("r", F.when(varies, r))


def named(cells: DataFrame, columns: Sequence[str], full: bool) -> DataFrame:
    """Pairs ``(col_a, col_b, pos_a, pos_b, r)`` of an upper triangle; with ``full`` mirrored and with the diagonal."""
    cells = cells.select("pos_a", "pos_b", "r")
    upper = cells.where("pos_a < pos_b")
    if full:
        upper = cells.select(F.explode(F.when(F.col("pos_a") == F.col("pos_b"), F.array(F.struct("pos_a", "pos_b", "r"))).otherwise(
            F.array(F.struct("pos_a", "pos_b", "r"), F.struct(F.col("pos_b").alias("pos_a"), F.col("pos_a").alias("pos_b"), "r")))).alias("p")).select("p.*")
    names = F.array(*[F.lit(c) for c in columns])
    return upper.select(F.element_at(names, F.col("pos_a") + 1).alias("col_a"), F.element_at(names, F.col("pos_b") + 1).alias("col_b"),
                        "pos_a", "pos_b", "r")


# ---------------------------------------------------------------- X4

def _ranks_of(x: DataFrame, k: int, gaps: Sequence[int]) -> DataFrame:
    """``(q, v, r-1, r<gap>...)``: of every value of column ``q`` its average rank around the ranks' mean, among all rows of
    the column and among those where the column ``gap`` is there. Written by column, so each is as small as it is."""
    spark, of = x.sparkSession, [-1, *gaps]
    long = x.select(F.posexplode(F.array(*[F.col(f"v{i}") for i in range(k)])).alias("q", "v"), *[F.col(f"v{g}").isNotNull().alias(f"h{g}") for g in gaps])
    counts = long.where(F.col("v").isNotNull()).groupBy("q", (F.col("v") + 0.0).alias("v")).agg(       # one zero
        F.count(F.lit(1)).alias("c-1"), *[F.count_if(F.col(f"h{g}")).alias(f"c{g}") for g in gaps])
    counts = ranged(counts, ["q"], ["v"])
    before = Window.partitionBy("q").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("q", "_b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.groupBy("q", "_b").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in of]).select(
        "q", "_b", *[F.coalesce(F.sum(f"c{j}").over(before), F.lit(0)).alias(f"o{j}") for j in of],
        *[F.sum(f"c{j}").over(Window.partitionBy("q")).alias(f"n{j}") for j in of])
    ranks = counts.join(starts, ["q", "_b"]).select("q", "v", *[
        (F.col(f"o{j}") + F.coalesce(F.sum(f"c{j}").over(below), F.lit(0)) + (F.col(f"c{j}") + 1) / 2 - (F.col(f"n{j}") + 1) / 2).alias(f"r{j}") for j in of])
    path = os.path.join(ensure_checkpoint_dir(spark), "speclab-tables", uuid.uuid4().hex)
    ranks.write.partitionBy("q").parquet(path)
    release_at_exit(spark, path)
    return spark.read.schema(ranks.schema).parquet(path)


def spearman_matrix(df: DataFrame, columns: Sequence[str], full: bool = True) -> DataFrame:
    """Spearman's rank correlation of every pair, ties sharing their average rank, over the rows that hold both values.

    A pair's ranks go by the rows both columns hold, so a column is ranked once among all its rows and once among
    the rows of each partner that has missing values. All rankings of a column come from one table of its values, which
    counts each value once for every ranking (hot values collapse before the shuffle), dealt into value ranges with running
    sums inside a range. Rows meet the ranks of one column in one join: a column of few values is broadcast, and no
    row is taken apart and put together again. Null and NaN are missing. Same columns as M1's result.
    """
    cols = list(columns)
    k = len(cols)
    x = cut_lineage(doubles(df, cols))
    holes = x.agg(F.count(F.lit(1)).alias("all"), *[F.count(f"v{i}").alias(f"v{i}") for i in range(k)]).first()
    gaps = [i for i in range(k) if holes[f"v{i}"] < holes["all"]]
    # a ranking: a column among the rows where a partner with gaps is there too (itself: all its rows)
    rankings = [(i, j) for i in range(k) for j in (-1, *[g for g in gaps if g != i])]
    number = {r: n for n, r in enumerate(rankings)}
    ranks = _ranks_of(x, k, gaps)
    wide = x
    for i in range(k):
        own = ranks.where(F.col("q") == i).select(F.col("v").alias(f"_v{i}"), *[F.col(f"r{j}").alias(f"_r{i}_{j}") for a, j in rankings if a == i])
        wide = wide.join(own, F.col(f"v{i}") == F.col(f"_v{i}"), "left")
    wide = wide.select(*[(F.when(F.col(f"v{j}").isNotNull(), F.col(f"_r{i}_{j}")) if j >= 0 else F.col(f"_r{i}_{j}")).alias(f"k{n}")
                         for (i, j), n in number.items()])
    sums, _ = pair_sums(wide, [f"k{q}" for q in range(len(rankings))], [0.0] * len(rankings))
    # the two rankings of each pair; a column without gaps needs no own ranking for its partner
    wanted = []
    for i in range(k):
        for j in range(i, k):
            p = number[(i, j if j in gaps and j != i else -1)], number[(j, i if i in gaps and j != i else -1)]
            wanted.append((min(p), max(p), i, j))
    keep = df.sparkSession.createDataFrame(wanted, "pos_a int, pos_b int, i int, j int")
    cells = correlation_of(sums).join(F.broadcast(keep), ["pos_a", "pos_b"])      # k (k + 1) / 2 rows
    return named(cells.select(F.col("i").alias("pos_a"), F.col("j").alias("pos_b"), "r"), cols, full)


# ---------------------------------------------------------------- X6, X7: complete rows

class Moments:
    """Count, means and centred products of the rows that hold all columns (on the driver: k x k numbers)."""

    def __init__(self, df: DataFrame, columns: Sequence[str]):
        self.columns = list(columns)
        k = len(self.columns)
        x = doubles(df, self.columns).dropna()
        sums, origin = pair_sums(x, x.columns)
        self.n, total, products = 0, np.zeros(k), np.zeros((k, k))
        for r in sums.collect():
            a, b = r["pos_a"], r["pos_b"]
            self.n = int(r["n"])
            total[a], total[b] = r["sa"], r["sb"]
            products[a, b] = products[b, a] = r["g"]
        mean = total / max(self.n, 1)
        self.mean = np.array(origin) + mean
        self.centred = products - self.n * np.outer(mean, mean)
        varies = np.diag(self.centred) > CONSTANT * np.diag(products)
        self.centred[~varies, :] = 0.0
        self.centred[:, ~varies] = 0.0

    def covariance(self) -> np.ndarray:
        return self.centred / (self.n - 1) if self.n > 1 else np.full_like(self.centred, np.nan)


class Components:
    """Principal components. ``scaled``: of the correlation matrix (columns in units of their deviation)."""

    def __init__(self, df: DataFrame, columns: Sequence[str], scaled: bool = True):
        m = Moments(df, columns)
        self.columns, self.n, self.mean = m.columns, m.n, m.mean
        cov = m.covariance() if m.n > 1 else np.zeros_like(m.centred)
        sd = np.sqrt(np.diag(cov))
        # a constant column has no direction of its own: it weighs nothing
        self.unit = np.where(sd > 0, sd, 1.0) if scaled else np.ones(len(sd))
        value, vector = np.linalg.eigh(cov / np.outer(self.unit, self.unit))
        order = np.argsort(-value, kind="stable")
        self.variance, self.loading = np.maximum(value[order], 0.0), vector[:, order]
        # a component's sign: its loading of greatest size is positive (the first of equals)
        lead = np.argmax(np.round(np.abs(self.loading), 9), axis=0)
        self.loading *= np.where(self.loading[lead, np.arange(len(lead))] < 0, -1.0, 1.0)

    def table(self, spark) -> DataFrame:
        """``(component, column_name, loading, variance, share)``, one row a component and column."""
        total = float(self.variance.sum())
        rows = [(c + 1, name, float(self.loading[i, c]), float(self.variance[c]), float(self.variance[c] / total) if total else None)
                for c in range(len(self.columns)) for i, name in enumerate(self.columns)]
        return spark.createDataFrame(rows, "component int, column_name string, loading double, variance double, share double")

    def scores(self, df: DataFrame, keep: Sequence[str], count: int | None = None) -> DataFrame:
        """``keep`` and ``pc1``, ``pc2``, ...: column expressions; a row with a missing column has null scores."""
        x = [(F.col(c).cast("double") - float(m)) / float(u) for c, m, u in zip(self.columns, self.mean, self.unit)]
        x = [F.when(~F.isnan(v), v) for v in x]
        out = []
        for c in range(count or len(self.columns)):
            out.append(sum((v * float(w) for v, w in zip(x, self.loading[:, c])), F.lit(0.0)).alias(f"pc{c + 1}"))
        return df.select(*keep, *out)


def linear_regression(df: DataFrame, target: str, columns: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Least squares of ``target`` on ``columns`` and an intercept, over the rows that hold all of them.

    ``(term, coefficient, std_error, t_value, n, dof, r2, residual_sd)``, the intercept first. Normal equations of
    centred, scaled columns. A column that the ones before it explain (what they leave of its variance is below
    ``tolerance``) takes no part: its coefficient is null. So are standard errors without degrees of freedom, and all
    coefficients of an empty input.
    """
    m = Moments(df, [*columns, target])
    k, n = len(columns), m.n
    scale = np.sqrt(np.where(np.diag(m.centred) > 0, np.diag(m.centred), 1.0))
    a = m.centred / np.outer(scale, scale)
    used: list[int] = []
    for i in range(k):
        rest = a[i, i] - (a[i, used] @ np.linalg.solve(a[np.ix_(used, used)], a[used, i]) if used else 0.0)
        if a[i, i] > 0 and rest > tolerance and n > len(used) + 1:
            used.append(i)
    inner = np.linalg.inv(a[np.ix_(used, used)]) if used else np.zeros((0, 0))
    beta = inner @ a[used, k]
    left = max(0.0, a[k, k] - float(beta @ a[used, k])) * scale[k] ** 2
    dof = n - len(used) - 1
    s2 = left / dof if dof > 0 else None
    coef = {used[p]: beta[p] * scale[k] / scale[used[p]] for p in range(len(used))}
    spread = inner / np.outer(scale[used], scale[used]) if used else inner
    r2 = float(1.0 - left / m.centred[k, k]) if m.centred[k, k] > 0 else None
    sd = None if s2 is None else float(np.sqrt(s2))

    def row(term, value, variance):
        error = None if s2 is None or variance is None else float(np.sqrt(s2 * variance))
        return (term, None if value is None else float(value), error, None if not error else float(value / error), n, dof, r2, sd)
    at = m.mean[used]
    rows = [row("intercept", m.mean[k] - sum(coef[i] * m.mean[i] for i in used) if n else None, 1.0 / n + float(at @ spread @ at) if n else None)]
    for i, c in enumerate(columns):
        rows.append(row(c, coef.get(i), float(spread[used.index(i), used.index(i)]) if i in coef else None))
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, std_error double, t_value double, n long, dof long, "
                                                 "r2 double, residual_sd double")
