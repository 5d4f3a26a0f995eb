"""SMOTE over Spark (C2 nearest minority neighbours, G3 oversampling).

Exact k nearest neighbours inside the minority class, without a self cross
join and without a cap on candidates, on DISTINCT positions (feature vectors)
weighted by their multiplicity:

1. Positions: ``groupBy(features)`` (partial aggregation collapses duplicates)
   and the k+1 smallest keys of each position (two-level salted top-k, so a
   position holding a third of the rows is never one task). A position with
   more than k points has all its neighbours among its own copies.
2. Positions are dealt into cells by a tree of median cuts over all features,
   fitted on a bounded sample (``SAMPLE_POSITIONS``): about ``CELL_POSITIONS``
   positions a cell, at most ``MAX_CELLS`` cells. The cells' bounding boxes are a
   table of at most that many rows.
3. Every sparse position looks for its k+1 nearest points in its own cell, which
   bounds their distance, and then visits only the cells whose box comes within that
   bound; the box of a far cell rules it out whole. Exact: a nearer point lies in
   a box at most that far away. Visits per position do not grow with the number of cells.
4. Every point joins its position's list (k+1 rows), drops itself and keeps k. Oversampling
   asks for the points that make samples only.

Oversampling: the minority of each chosen split is raised to the majority
count. The needed number of samples is spread evenly over minority points
(``sequence`` + ``explode``), each sample picks one of its point's k neighbours
and a gap in [0, 1) from a seeded hash, and ``x + gap * (nn - x)`` is computed
column-wise. Synthetic rows get a derived key and are appended with
``unionByName``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from speclab.operators.quantiles import rank_of
from speclab.session import cut_lineage

K_NEIGHBOURS = 5
CELL_POSITIONS = 512         # positions of a cell, on average
MAX_CELLS = 1 << 14
SAMPLE_POSITIONS = 1 << 17
ASK_PARTS = 4                # blocks the askers of a cell are dealt into


SALT = 64   # sub-groups for the two-level top-k inside one position


def _smallest_keys(pts: DataFrame, pos_cols: list[str], key: str, m: int) -> DataFrame:
    """The m smallest keys of every position, as (pos..., q_key, _kr).

    Two levels: rank inside (position, salt) first, so a position that holds a
    third of all points is split over SALT tasks; the second window only sees
    SALT * m rows per position."""
    salted = pts.withColumn("_salt", F.pmod(F.xxhash64(F.col(key)), F.lit(SALT)))
    w1 = Window.partitionBy(*pos_cols, "_salt").orderBy(key)
    lvl1 = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= m)
    w2 = Window.partitionBy(*pos_cols).orderBy(key)
    return (lvl1.withColumn("_kr", F.row_number().over(w2)).where(F.col("_kr") <= m)
                .select(*pos_cols, F.col(key).alias("q_key"), "_kr"))


class _Cells:
    """A tree of median cuts over a sample of positions: cell numbers for any positions."""

    def __init__(self, sample: np.ndarray, n: int):
        self.axis: list[int] = []          # of each inner node; -1 in a leaf
        self.cut: list[float] = []
        self.child: list[tuple[int, int]] = []
        want = max(1, min(MAX_CELLS, -(-n // CELL_POSITIONS)))
        self.leaves = 0
        self._grow(sample, max(1, len(sample) // want))

    def _grow(self, rows: np.ndarray, least: int) -> int:
        at = len(self.axis)
        self.axis.append(-1)
        self.cut.append(0.0)
        self.child.append((0, 0))
        spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(1)
        axis = int(spread.argmax())
        if len(rows) <= least or not spread[axis] > 0:
            self.child[at] = (self.leaves, -1)
            self.leaves += 1
            return at
        x = rows[:, axis]
        cut = float(np.median(x))
        if not (x < cut).any():          # half the rows or more share the least value: they are one side
            cut = float(x[x > cut].min())
        self.axis[at], self.cut[at] = axis, cut
        self.child[at] = (self._grow(rows[x < cut], least), self._grow(rows[x >= cut], least))
        return at

    def of(self, x: np.ndarray) -> np.ndarray:
        axis, cut, child = np.array(self.axis), np.array(self.cut), np.array(self.child)
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(axis[node] >= 0)
            if not len(inner):
                return child[node, 0]
            a = axis[node[inner]]
            node[inner] = child[node[inner], (x[inner, a] >= cut[node[inner]]).astype(int)]


def _columns(batch, names) -> np.ndarray:
    """Feature columns of a batch as a matrix."""
    return np.stack([np.asarray(batch.column(batch.schema.get_field_index(f)).to_numpy(zero_copy_only=False), float)
                     for f in names], axis=1) if batch.num_rows else np.zeros((0, len(names)))


def _nearest_in_cell(px, pid, limit, qx, qid, qkey, qw, m, weighted: bool):
    """For each asking position its nearest other positions of one cell: the first ``m`` by (distance,
    smallest key), not beyond ``limit``. With ``weighted`` also the distance within which ``need`` points lie."""
    rank = np.argsort(np.argsort(qkey, kind="stable"), kind="stable")
    out_p, out_q, out_d = [], [], []
    bound = np.full(len(px), np.inf)
    rows = max(1, (1 << 22) // max(1, len(qx)))
    for at in range(0, len(px), rows):
        part = px[at:at + rows]
        d2 = np.zeros((len(part), len(qx)))
        for f in range(px.shape[1]):                 # summed feature by feature, as the SQL form sums
            d2 += (part[:, f, None] - qx[None, :, f]) * (part[:, f, None] - qx[None, :, f])
        d2[pid[at:at + rows, None] == qid[None, :]] = np.inf
        for i in range(len(part)):
            row = d2[i]
            near = np.flatnonzero(row <= limit[at + i])
            near = near[np.isfinite(row[near])]
            if len(near) > m:
                near = near[row[near] <= np.partition(row[near], m - 1)[m - 1]]
            near = near[np.lexsort((rank[near], row[near]))][:m]
            if weighted:
                enough = np.flatnonzero(np.cumsum(qw[near]) >= m)
                if len(enough):
                    bound[at + i] = row[near[enough[0]]]
            out_p.append(np.full(len(near), pid[at + i]))
            out_q.append(qid[near])
            out_d.append(row[near])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(out_p) if out_p else empty, np.concatenate(out_q) if out_q else empty,
            np.concatenate(out_d) if out_d else np.zeros(0), bound)


def nearest_neighbours(points: DataFrame, features: Sequence[str], key: str = "row_id",
                       k: int = K_NEIGHBOURS, group: str | None = None, ask: DataFrame | None = None) -> DataFrame:
    """(group, row_id, nn_rank 1..k, nn_row_id, distance) - exact, per group,
    ties broken by the neighbour's key. Features must not be null.

    Works on distinct positions (feature vectors) weighted by multiplicity, so
    duplicated points - discrete features, or one vector holding a third of the
    rows - never turn into all pairs: a position with more than k points finds
    all its neighbours among its own copies at distance 0 and needs no search. ``ask``: the keys (its
    first column) of the points whose neighbours are wanted; the neighbours come from all points.
    """
    spark = points.sparkSession
    feats = list(features)
    g = group or "_grp"
    pts = points if group else points.withColumn("_grp", F.lit("all"))
    pts = pts.select(F.col(key), F.col(g).cast("string").alias(g), *[F.col(f).cast("double").alias(f) for f in feats])
    if ask is None:
        pts = pts.withColumn("_ask", F.lit(1))
    else:
        wanted = ask.select(F.col(ask.columns[0]).alias(key)).distinct().withColumn("_ask", F.lit(1))
        pts = cut_lineage(pts.join(wanted, key, "left").withColumn("_ask", F.coalesce("_ask", F.lit(0))))
    pos_cols = [g] + feats
    m = k + 1                                       # enough for any point once itself is removed
    small = cut_lineage(_smallest_keys(pts, pos_cols, key, m))
    positions = cut_lineage(
        pts.groupBy(*pos_cols).agg(F.count(F.lit(1)).alias("_c"), F.min(key).alias("_key"), F.max("_ask").alias("_ask"))
           .withColumn("_w", F.least(F.col("_c"), F.lit(m))).withColumn("_pid", F.monotonically_increasing_id()))
    n = positions.count()
    # a bounded sample, spread over all features alike by scaling nothing: the cuts only steer the work
    sample = positions.orderBy(F.xxhash64(*pos_cols)).limit(SAMPLE_POSITIONS).select(*feats).toArrow()
    cells = _Cells(np.stack([sample.column(f).to_numpy() for f in feats], axis=1), n)

    def place(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.of(_columns(b, feats)))], names=[*b.schema.names, "_cell"])

    schema = positions.schema.simpleString()[len("struct<"):-1]
    placed = cut_lineage(positions.mapInArrow(place, schema + ",_cell:bigint"))
    boxes = placed.groupBy(g, "_cell").agg(*[x for f in feats for x in (F.min(f).alias(f"lo_{f}"), F.max(f).alias(f"hi_{f}"))]).toArrow()

    def own_cell(group_rows):
        x, pid = _columns_of(group_rows, feats), group_rows.column("_pid").to_numpy()
        w, c = group_rows.column("_w").to_numpy(), group_rows.column("_c").to_numpy()
        keys = np.array(group_rows.column("_key").to_pylist())
        asks = np.flatnonzero((c < m) & (group_rows.column("_ask").to_numpy() > 0))
        p, q, d, bound = _nearest_in_cell(x[asks], pid[asks], np.full(len(asks), np.inf), x, pid, keys, w, m, True)
        return asks, p, q, d, bound

    def search_own(rows):
        """The neighbours found in a cell (``_qid`` set), and (cell, position, limit) of the other cells each
        position must look into (``_qid`` null)."""
        asks, p, q, d, bound = own_cell(rows)
        x, pid = _columns_of(rows, feats)[asks], rows.column("_pid").to_numpy()[asks]
        name, home = rows.column(g)[0].as_py(), rows.column("_cell")[0].as_py()
        same = np.array([v == name for v in boxes.column(g).to_pylist()]) & (boxes.column("_cell").to_numpy() != home)
        lo = np.stack([boxes.column(f"lo_{f}").to_numpy()[same] for f in feats], axis=1)
        hi = np.stack([boxes.column(f"hi_{f}").to_numpy()[same] for f in feats], axis=1)
        number = boxes.column("_cell").to_numpy()[same]
        out_c, out_i = [], []
        for i in range(len(asks)):
            gap = np.maximum(0.0, np.maximum(lo - x[i], x[i] - hi))
            hit = np.flatnonzero((gap * gap).sum(1) <= bound[i] * (1 + 1e-9))
            out_c.append(number[hit])
            out_i.append(np.full(len(hit), i))
        c = np.concatenate(out_c) if out_c else np.zeros(0, np.int64)
        i = np.concatenate(out_i) if out_i else np.zeros(0, np.int64)
        none = len(p)
        return pa.table({g: pa.array([name] * (none + len(c)), pa.string()), "_cell": pa.array([home] * none + c.tolist(), pa.int64()),
                         "_pid": pa.array(np.concatenate([p, pid[i]]), pa.int64()), "_qid": pa.array(q.tolist() + [None] * len(c), pa.int64()),
                         "_d2": pa.array(np.concatenate([d, bound[i]]), pa.float64()),
                         **{f: pa.array(np.concatenate([np.zeros(none), x[i, j]]), pa.float64()) for j, f in enumerate(feats)}})

    first = cut_lineage(placed.groupBy(g, "_cell").applyInArrow(
        lambda rows: search_own(rows), f"`{g}` string, _cell long, _pid long, _qid long, _d2 double, " + ", ".join(f"`{f}` double" for f in feats)))
    near = first.where("_qid is not null").select("_pid", "_qid", "_d2")
    ask = first.where("_qid is null").drop("_qid").withColumnRenamed("_d2", "_limit")
    # a cell asked by many positions is looked into by blocks of askers
    ask = ask.withColumn("_part", F.pmod(F.xxhash64("_pid"), F.lit(ASK_PARTS)))
    there = placed.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ASK_PARTS - 1).cast("long"))))

    def search_there(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"_pid": pa.array([], pa.int64()), "_qid": pa.array([], pa.int64()), "_d2": pa.array([], pa.float64())})
        p, q, d, _ = _nearest_in_cell(_columns_of(left, feats), left.column("_pid").to_numpy(), left.column("_limit").to_numpy(),
                                      _columns_of(right, feats), right.column("_pid").to_numpy(),
                                      np.array(right.column("_key").to_pylist()), right.column("_w").to_numpy(), m, False)
        return pa.table({"_pid": pa.array(p, pa.int64()), "_qid": pa.array(q, pa.int64()), "_d2": pa.array(d, pa.float64())})

    far = (ask.groupBy(g, "_cell", "_part").cogroup(there.groupBy(g, "_cell", "_part"))
           .applyInArrow(lambda left, right: search_there(left, right), "_pid long, _qid long, _d2 double"))
    found = cut_lineage(near.unionByName(far))

    # candidate list per position: its own copies at 0 plus the found positions' keys, top m by (distance, key)
    keys = cut_lineage(small.join(positions.select(*pos_cols, "_pid"), pos_cols).select("_pid", "q_key"))
    others = found.join(keys.select(F.col("_pid").alias("_qid"), "q_key"), "_qid").select("_pid", "q_key", "_d2")
    wl = Window.partitionBy("_pid").orderBy("_d2", "q_key")
    lists = (keys.withColumn("_d2", F.lit(0.0)).unionByName(others).withColumn("_lr", F.row_number().over(wl))
                 .where(F.col("_lr") <= m).drop("_lr"))
    # every asking point takes its position's list, minus itself, first k
    me = pts.where("_ask = 1").join(positions.select(*pos_cols, "_pid"), pos_cols).select(g, F.col(key).alias("p_key"), "_pid")
    wp = Window.partitionBy("p_key").orderBy("_d2", "q_key")
    top = (me.join(lists, "_pid").where(F.col("q_key") != F.col("p_key"))
             .withColumn("nn_rank", F.row_number().over(wp)).where(F.col("nn_rank") <= k))
    out = top.select(g, F.col("p_key").alias(key), "nn_rank", F.col("q_key").alias("nn_" + key), F.sqrt("_d2").alias("distance"))
    return out if group else out.drop("_grp")


def _columns_of(table: pa.Table, names) -> np.ndarray:
    return np.stack([table.column(f).to_numpy() for f in names], axis=1) if table.num_rows else np.zeros((0, len(names)))


def _u01(*cols):
    """Seeded uniform in [0, 1) from md5 of the given columns."""
    h = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(16 ** 13)


def smote_oversample(df: DataFrame, features: Sequence[str], label: str = "label", key: str = "row_id",
                     split_col: str = "split", splits: Sequence[str] = ("train",), k: int = K_NEIGHBOURS,
                     seed: int = 42) -> DataFrame:
    """Per chosen split, synthesise minority rows until both classes have the
    majority count; other splits pass through unchanged. The result has one more
    column, ``synthetic``."""
    feats = list(features)
    # the input is usually the end of a long split lineage: store it once (reliable
    # checkpoint) so the neighbour search and the synthesis read stored rows
    df = cut_lineage(df.withColumn("synthetic", F.lit(False)))
    scope = df.where(F.col(split_col).isin(list(splits)))
    counts = {(r[split_col], r[label]): r["n"]
              for r in scope.groupBy(split_col, label).agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = []   # (split, minority label, rows needed)
    for s in splits:
        c = {lab: n for (sp, lab), n in counts.items() if sp == s}
        if len(c) < 2:
            continue
        lo = min(c, key=lambda x: (c[x], x))
        hi = max(c.values())
        if c[lo] < hi:
            plan.append((s, lo, hi - c[lo], c[lo]))
    if not plan:
        return df
    cond = None
    for s, lo, _, _ in plan:
        e = (F.col(split_col) == s) & (F.col(label) == lo)
        cond = e if cond is None else cond | e
    minority = df.where(cond).withColumn("_grp", F.col(split_col))
    need = df.sparkSession.createDataFrame([(s, int(n), int(m)) for s, _, n, m in plan],
                                           "_grp string, _need long, _m long")
    # spread the needed count evenly: every point makes floor(need/m), the first (need mod m) one more
    ranked = rank_of(minority.select(key, "_grp", F.xxhash64(F.col(key), F.lit(seed)).alias("_h")), ["_grp"], "_h", tie=key)
    makers = cut_lineage(ranked.join(need, "_grp")
                         .withColumn("_c", F.floor(F.col("_need") / F.col("_m")).cast("long") +
                                     F.when(F.col("_rank") < F.col("_need") % F.col("_m"), 1).otherwise(0))
                         .where(F.col("_c") > 0).select(key, "_grp", "_c"))
    # only points that make samples look for neighbours
    every = all(n >= m for _, _, n, m in plan)
    nn = cut_lineage(nearest_neighbours(minority, feats, key, k, group="_grp", ask=None if every else makers))
    reps = makers.select(key, "_grp", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c"))).alias("_j"))
    n_nb = nn.groupBy(key).agg(F.count(F.lit(1)).alias("_nk"))
    picks = (reps.join(n_nb, key)
                 .withColumn("nn_rank", (F.floor(_u01(F.col(key), F.col("_j"), F.lit(seed), F.lit("nn")) *
                                                 F.col("_nk")) + 1).cast("int"))
                 .withColumn("_gap", _u01(F.col(key), F.col("_j"), F.lit(seed), F.lit("gap"))))
    pairs = picks.join(nn.select(key, "nn_rank", "nn_" + key), [key, "nn_rank"])
    me = minority.select(key, *[F.col(f).cast("double").alias("x_" + f) for f in feats], label, split_col)
    other = minority.select(F.col(key).alias("nn_" + key), *[F.col(f).cast("double").alias("y_" + f) for f in feats])
    syn = (pairs.join(me, key).join(other, "nn_" + key)
                .select(F.md5(F.concat_ws("|", F.col(key), F.lit("smote"), F.col("_j").cast("string"))).alias(key),
                        *[(F.col("x_" + f) + F.col("_gap") * (F.col("y_" + f) - F.col("x_" + f))).alias(f)
                          for f in feats],
                        label, split_col, F.lit(True).alias("synthetic")))
    cols = df.columns
    syn = syn.select(*[F.col(c) if c in syn.columns else F.lit(None).alias(c) for c in cols])
    casted = syn.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in cols])
    return df.unionByName(casted)
