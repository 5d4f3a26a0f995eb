"""Exact top-k inner products by pivot-table elimination.

Vectors become points of a metric space: with M the largest norm, a candidate v gets one more
coordinate sqrt(M^2 - |v|^2) and a query a zero, so |q - v|^2 = |q|^2 + M^2 - 2 q.v and
the highest scores are the nearest points. A pivot table holds every vector's distance to a
bounded number of pivots; max over pivots of |d(q, p) - d(v, p)| is a lower bound of d(q, v).

Candidates lie in blocks of bounded size, dealt by their nearest pivot; queries lie in groups,
dealt alike. A block's range of distances to each pivot rules it out for a whole group, by
the k-th best score each query has in a bounded seed sample. Inside a task a group's candidates
are evaluated in rounds, in the order of their bounds, until those left lie beyond the k-th distance of every query.
Bounds are compared with a slack wider than any rounding error, so ties are never lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speclab.llm.common import bounded_batches, cut_lineage

PIVOTS = 32
SEED_ROWS = 1024             # bound of the sample pivots and first thresholds come from
BLOCK_ROWS = 2048            # candidates of a block at most
GROUP_ROWS = 256             # queries of a group at most
STEP = 512                   # candidates of a round, in bound order
SLACK = 1e-7
EXACT = float(1 << 52)       # sums up to here are exact in double precision


def quantized(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """``(id, v)``: floor(scale * x) as longs; null vectors and those with null or non-finite parts are left out."""
    x = F.transform(df[vec_col], lambda c: c.cast("double"))
    whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (df.select(df[id_col].alias("id"), x.alias("x")).where(F.col("x").isNotNull() & F.col("id").isNotNull()).where(whole)
            .select("id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as an int64 matrix, shorter vectors padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _narrow(v: np.ndarray) -> np.ndarray:
    """The same integers in the least width that holds them all."""
    low, high = int(v.min(initial=0)), int(v.max(initial=0))
    return v.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _wide(data, rows: int, dim: int) -> np.ndarray:
    """Rows of ``_narrow`` as int64; the width follows from the length."""
    return np.frombuffer(data, f"i{memoryview(data).nbytes // (rows * dim)}").reshape(rows, dim).astype(np.int64)


class Space:
    """The metric space: dimension, squared largest norm, pivots, and a seed sample for first thresholds."""

    def __init__(self, dim: int, norm2: float, ids: np.ndarray, seed: np.ndarray, pivots: int, k: int):
        self.dim, self.norm2, self.k = dim, float(norm2), k
        self.ids, self.seed = ids, seed
        # far-apart pivots: each next one is the sample point farthest from those chosen
        order, far = [0], None
        lifted = self._lift(seed)
        while len(order) < min(pivots, len(seed)):
            d = self._distance(seed, lifted, seed[order[-1:]], lifted[order[-1:]])[:, 0]
            far = d if far is None else np.minimum(far, d)
            if far.max() <= 0:
                break
            order.append(int(far.argmax()))
        self.pivots, self.lift = seed[order].astype(float), lifted[order]

    def _lift(self, v: np.ndarray) -> np.ndarray:
        f = v.astype(float)
        return np.sqrt(np.maximum(0.0, self.norm2 - (f * f).sum(1)))

    @staticmethod
    def _distance(a, la, b, lb):
        a, b = a.astype(float), b.astype(float)
        d2 = (a * a).sum(1)[:, None] + (la * la)[:, None] + (b * b).sum(1)[None] + (lb * lb)[None] - 2 * (a @ b.T + np.outer(la, lb))
        return np.sqrt(np.maximum(0.0, d2))

    def table(self, v: np.ndarray, query: bool) -> np.ndarray:
        """Distances to the pivots (rows, pivots)."""
        return self._distance(v, np.zeros(len(v)) if query else self._lift(v), self.pivots, self.lift)

    def slack(self) -> float:
        return SLACK * (1.0 + 2.0 * np.sqrt(self.norm2)) + np.sqrt(1e-13 * (1.0 + self.norm2))

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact integer inner products."""
        top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, self.dim)
        if top <= EXACT:
            return (a.astype(float) @ b.astype(float).T).astype(np.int64)
        return a @ b.T

    def first_thresholds(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """k-th best score of each query in the seed sample (its own row left out); lowest long if there are fewer."""
        s = self.scores(q, self.seed)
        s = np.where(ids[:, None] == self.ids[None], np.iinfo(np.int64).min, s)
        if s.shape[1] < self.k:
            return np.full(len(q), np.iinfo(np.int64).min)
        return np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]

    def reach(self, q: np.ndarray, threshold: np.ndarray) -> np.ndarray:
        """Distance beyond which a candidate scores below the threshold."""
        f = q.astype(float)
        d2 = (f * f).sum(1) + self.norm2 - 2 * threshold.astype(float)
        return np.sqrt(np.maximum(0.0, d2)) + self.slack()


def _best(space: Space, qid, q, tq, cid, c, threshold, k: int):
    """Top-k of each query of a group among one block: candidates are taken in rounds in the order of their bounds, and each
    round scores those that a query's bound still lets through for all such queries together."""
    tc = space.table(c, False)
    bound = np.zeros((len(q), len(c)))
    for p in range(tq.shape[1]):
        np.maximum(bound, np.abs(tq[:, p, None] - tc[None, :, p]), out=bound)
    near = space.reach(q, threshold)
    open_ = (bound <= near[:, None]) & (cid[None] != qid[:, None])
    used = np.flatnonzero(open_.any(0))
    # nearest first: by how far inside its reach the candidate lies for the query that it may serve best
    order = used[np.argsort(np.where(open_[:, used], bound[:, used] - near[:, None], np.inf).min(0, initial=np.inf), kind="stable")]
    least, low = threshold.copy(), np.iinfo(np.int64).min
    best = np.full((len(q), k), low)
    out_q, out_v, out_s = [], [], []
    for at in range(0, len(order), STEP):
        part = order[at:at + STEP]
        some = open_[:, part] & (bound[:, part] <= near[:, None])
        rows, part = np.flatnonzero(some.any(1)), part[some.any(0)]
        if not len(rows):
            continue
        some = open_[np.ix_(rows, part)] & (bound[np.ix_(rows, part)] <= near[rows, None])
        s = space.scores(q[rows], c[part])
        some &= s >= least[rows, None]
        i, j = np.nonzero(some)
        out_q.append(rows[i])
        out_v.append(cid[part[j]])
        out_s.append(s[i, j])
        best[rows] = np.partition(np.concatenate([best[rows], np.where(some, s, low)], axis=1), -k, axis=1)[:, -k:]
        kth = best[rows].min(1)
        up = rows[kth > least[rows]]
        least[up] = best[up].min(1)
        near[up] = space.reach(q[up], least[up])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, v, s = np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)
    keep = np.flatnonzero(s >= least[i])
    keep = keep[np.lexsort((v[keep], -s[keep], i[keep]))]
    i, v, s = i[keep], v[keep], s[keep]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
    rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
    return qid[i[rank < k]], v[rank < k], s[rank < k]


def top_k(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, queries: str = "id % 50 = 0",
          scale: int = 256, pivots: int = PIVOTS, seed_rows: int = SEED_ROWS, block_rows: int = BLOCK_ROWS,
          group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest integer inner products of each query, ties to the smaller id.

    ``queries``: condition on ``id`` that picks the query rows; every other row is a
    candidate (not the query's own id). Null ids, null vectors and vectors holding null
    or non-finite parts take no part; vectors of another length are compared as if the
    shorter one ended in zeros. Rows repeated whole count once each as candidates and once as a
    query. An empty table gives no rows. Scores must fit a long.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    rows = cut_lineage(quantized(df, id_col, vec_col, scale))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    whole = rows.agg(F.max(F.size("v")).alias("dim"), F.max(norm2).alias("norm2"), F.count("*").alias("n")).first()
    if not whole["n"] or not whole["dim"]:
        zeros = rows.where(queries).select(F.col("id").alias("q")).distinct().join(rows.where("false"), F.col("q") != F.col("id"))
        return _ranked(zeros.select(F.col("q").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score")), k)
    seed = rows.orderBy(F.xxhash64("id"), "id").limit(seed_rows).toArrow()
    space = Space(int(whole["dim"]), whole["norm2"], seed.column("id").to_numpy(), _matrix(seed.column("v"), int(whole["dim"])), pivots, k)

    def place(batches):
        """Nearest pivot of every row, as a candidate."""
        for b in batches:
            t = space.table(_matrix(b.column(1), space.dim), False)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(t.argmin(1).astype(np.int32))], names=["id", "v", "cell"])

    placed = cut_lineage(rows.mapInArrow(place, "id long, v array<long>, cell int"))
    # blocks of bounded size inside each cell: as many parts as its row count asks for
    count = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}

    def parts(size: int):
        return F.create_map(*[F.lit(x) for c, n in sorted(count.items()) for x in (c, max(1, -(-n // size)))])[F.col("cell")]

    def packed(d: DataFrame, size: int, query: bool) -> DataFrame:
        d = d.withColumn("part", F.pmod(F.xxhash64("id"), parts(size)).cast("int"))

        def pack(key, group):
            v = _matrix(group.column("v"), space.dim)
            ids = group.column("id").to_numpy()
            t = space.table(v, query)
            first = space.first_thresholds(ids, v) if query else np.zeros(0, np.int64)
            edge = space.reach(v, first).max() if query else 0.0
            return pa.table({"block": pa.array([key[0].as_py() << 32 | key[1].as_py()]), "ids": pa.array([ids.tobytes()], pa.binary()),
                             "v": pa.array([_narrow(v).tobytes()], pa.binary()), "first": pa.array([first.tobytes()], pa.binary()),
                             "low": pa.array([t.min(0).tolist()], pa.list_(pa.float64())),
                             "high": pa.array([t.max(0).tolist()], pa.list_(pa.float64())), "reach": pa.array([float(edge)])})

        return cut_lineage(d.groupBy("cell", "part").applyInArrow(
            pack, "block long, ids binary, v binary, first binary, low array<double>, high array<double>, reach double"))

    blocks = packed(placed, block_rows, False)
    groups = packed(placed.where(queries).dropDuplicates(["id", "v"]), group_rows, True)
    # a block can hold a near candidate only if its distance ranges come within reach of the group's;
    # this compares one summary row a query group with one a candidate block, no vectors
    g, b = groups.select(F.col("block").alias("g"), F.col("low").alias("gl"), F.col("high").alias("gh"), "reach"), \
        blocks.select(F.col("block").alias("b"), F.col("low").alias("bl"), F.col("high").alias("bh"))
    apart = F.array_max(F.zip_with(F.zip_with("bl", "gh", lambda x, y: x - y), F.zip_with("gl", "bh", lambda x, y: x - y),
                                   lambda x, y: F.greatest(x, y)))
    pairs = cut_lineage(g.join(b, apart <= F.col("reach")).select("g", "b"))
    work = (pairs.join(groups.select(F.col("block").alias("g"), F.col("ids").alias("qi"), F.col("v").alias("qv"), F.col("first").alias("qf")), "g")
            .join(blocks.select(F.col("block").alias("b"), F.col("ids").alias("ci"), F.col("v").alias("cv")), "b")
            .select("qi", "qv", "qf", "ci", "cv"))

    def search(batches):
        for batch in batches:
            for j in range(batch.num_rows):
                qi, qv, qf, ci, cv = (batch.column(i)[j].as_buffer() for i in range(5))
                qi, qf, ci = (np.frombuffer(x, np.int64) for x in (qi, qf, ci))
                qv, cv = _wide(qv, len(qi), space.dim), _wide(cv, len(ci), space.dim)
                q, v, s = _best(space, qi, qv, space.table(qv, True), ci, cv, qf, k)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())],
                                                 names=["query_id", "vec_id", "score"])

    found = work.mapInArrow(search, "query_id long, vec_id long, score long")
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
