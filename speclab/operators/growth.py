"""Deep trees in bounded steps: the splits Spark ML chooses, for many trees at once.

Spark ML finds the splits of a level for some thousands of nodes a pass, and every pass reads all rows; a deep tree has
nodes in proportion to its rows, so its work grows with their square, and every node's statistics pass the driver.
Here nodes of more than ``LOCAL_ROWS`` rows are split by one pass a level over the rows, for all trees together: counts
of (tree, node, feature, bin, class) add up, and one best split a node reaches the driver. The rows of the smaller
nodes are dealt by node, and each is grown to its leaves where its rows are: work per row, not per node and row. A whole tree is a
table of nodes (``written``): the driver holds the larger nodes and one row for each subtree below them.

Same rules as Spark's: gini, candidate thresholds by equal counts (``max_bins``), a split needs ``min_leaf`` rows on
both sides and a gain above 0, equal gains go to the first feature and lowest threshold, pure nodes are leaves, and
siblings that predict the same are merged. Labels are 0 and 1. Beyond ``max(max_bins^2, 10000)`` rows the thresholds
come from a seeded sample of about that many, as Spark's do (not the same sample).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speclab.session import cut_lineage

LOCAL_ROWS = 1 << 17       # rows that one task grows to the leaves
OPEN_NODES = 4096           # larger nodes whose counts one pass holds
FIELDS = ("left", "right", "feature", "bin", "gain", "n0", "n1", "depth")
# ``part``: id of the root of the subtree that a node stands in, -1 above them; ``parent_n``: rows of the node's parent
TABLE_SCHEMA = ("id int, depth int, feature string, threshold double, left int, right int, n long, n0 double, n1 double, "
                "prediction int, gain double, parent_n long, part int")


@dataclass
class Plan:
    """A tree to grow: on all rows, or on those of the other folds."""
    fold: int | None = None
    min_leaf: int = 1
    max_depth: int = 30


@dataclass
class _Top:
    """The nodes of a tree that the driver holds: those of more than ``LOCAL_ROWS`` rows, and their children."""
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    feature: list = field(default_factory=list)
    bin: list = field(default_factory=list)
    gain: list = field(default_factory=list)
    n0: list = field(default_factory=list)
    n1: list = field(default_factory=list)
    depth: list = field(default_factory=list)
    parent: list = field(default_factory=list)

    def add(self, n0: int, n1: int, depth: int, parent: int) -> int:
        for name, v in (("left", -1), ("right", -1), ("feature", -1), ("bin", -1), ("gain", 0.0), ("n0", n0), ("n1", n1),
                        ("depth", depth), ("parent", parent)):
            getattr(self, name).append(v)
        return len(self.left) - 1

    def cut(self, depth: int) -> "_Top":
        """The same nodes; those at ``depth`` are leaves (what was below stays, out of reach)."""
        out = _Top(*(list(getattr(self, f)) for f in self.__dataclass_fields__))
        for node in (n for n, d in enumerate(out.depth) if d >= depth):
            out.left[node] = out.right[node] = -1
        return out

    def path(self, node: int) -> list[int]:
        out = []
        while node >= 0:
            out.append(node)
            node = self.parent[node]
        return out[::-1]


def candidates(values: np.ndarray, max_bins: int) -> np.ndarray:
    """Split points of one feature: between all values, or where the counts come nearest to equal shares."""
    v, c = np.unique(values + 0.0, return_counts=True)
    splits = min(max_bins, len(values)) - 1
    middle = (v[:-1] + v[1:]) / 2.0
    if len(v) - 1 <= splits:
        return middle
    stride, out, seen, target = len(values) / (splits + 1), [], float(c[0]), len(values) / (splits + 1)
    for i in range(1, len(v)):
        before, seen = seen, seen + float(c[i])
        if abs(before - target) < abs(seen - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def _gini(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    n = np.maximum(n0 + n1, 1).astype(float)
    a, b = n0 / n, n1 / n
    return 1.0 - a * a - b * b


def _best_of_runs(slot, bins, n0, n1, t0, t1, least: int):
    """Best split of every slot along one feature: (gain, bin, rows left of it of class 0, of class 1).

    ``slot`` and ``bins`` ascend, ``n0`` and ``n1`` count their rows, ``t0`` and ``t1`` the rows of every slot.
    """
    first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    s0, s1 = np.cumsum(n0), np.cumsum(n1)
    l0, l1 = s0 - (s0[first] - n0[first])[slot], s1 - (s1[first] - n1[first])[slot]
    r0, r1 = t0[slot] - l0, t1[slot] - l1
    n, left, right = (t0 + t1)[slot].astype(float), l0 + l1, r0 + r1
    gain = _gini(t0, t1)[slot] - left / n * _gini(l0, l1) - right / n * _gini(r0, r1)
    gain = np.where((left >= least) & (right >= least), gain, -np.inf)
    best = np.maximum.reduceat(gain, first)
    at = np.flatnonzero(gain == best[slot])
    at = at[np.r_[True, slot[at][1:] != slot[at][:-1]]]
    return best, bins[at], l0[at], l1[at]


def grow_rows(codes: np.ndarray, y: np.ndarray, min_leaf: int, levels: int) -> dict[str, np.ndarray]:
    """A whole subtree of the given rows, level by level; depths count from 0, children come after their parent."""
    k, width = codes.shape[1], int(codes.max(initial=0)) + 1
    out = {f: [np.full(1, -1, np.int64)] for f in ("left", "right", "feature", "bin")}
    out |= {"gain": [np.zeros(1)], "n0": [np.array([int((y == 0).sum())])], "n1": [np.array([int((y == 1).sum())])], "depth": [np.zeros(1, np.int64)]}
    base, made, slot = 0, 1, np.zeros(len(y), np.int64)
    number = np.zeros(1, np.int64)          # of each slot: its node among those of its level
    for level in range(levels):
        t0, t1 = out["n0"][level][number], out["n1"][level][number]
        if not len(number) or not len(y):
            break
        m = len(number)
        gain, feat, cut, c0, c1 = np.zeros(m), np.full(m, -1), np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
        for f in range(k):
            key = np.sort((slot * width + codes[:, f]) * 2 + y)
            run = key >> 1
            at = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            n, ones = np.diff(np.r_[at, len(key)]), np.add.reduceat(key & 1, at)
            g, b, l0, l1 = _best_of_runs(run[at] // width, run[at] % width, n - ones, ones, t0, t1, min_leaf)
            better = g > gain
            gain, feat, cut = np.where(better, g, gain), np.where(better, f, feat), np.where(better, b, cut)
            c0, c1 = np.where(better, l0, c0), np.where(better, l1, c1)
        split = np.flatnonzero(feat >= 0)
        if not len(split):
            break
        at = number[split]
        for name, v in (("feature", feat), ("bin", cut), ("gain", gain)):
            out[name][level][at] = v[split]
        child = 2 * np.arange(len(split))
        out["left"][level][at], out["right"][level][at] = made + child, made + child + 1
        n0, n1 = np.zeros(2 * len(split), np.int64), np.zeros(2 * len(split), np.int64)
        n0[0::2], n1[0::2], n0[1::2], n1[1::2] = c0[split], c1[split], (t0 - c0)[split], (t1 - c1)[split]
        for name, v in (("left", -1), ("right", -1), ("feature", -1), ("bin", -1)):
            out[name].append(np.full(len(n0), v, np.int64))
        out["gain"].append(np.zeros(len(n0)))
        out["n0"].append(n0)
        out["n1"].append(n1)
        out["depth"].append(np.full(len(n0), level + 1, np.int64))
        base, made = made, made + len(n0)
        # rows of mixed children go on
        to = np.full(m, -1)
        to[split] = child
        kept = np.flatnonzero(to[slot] >= 0)
        s = slot[kept]
        node = to[s] + (codes[kept, feat[s]] > cut[s])
        mixed = (n0 > 0) & (n1 > 0)
        number = np.flatnonzero(mixed)
        go = mixed[node]
        kept, node = kept[go], node[go]
        slot, codes, y = (np.cumsum(mixed) - 1)[node], codes[kept], y[kept]
    return {f: np.concatenate(v) for f, v in out.items()}


def _pruned(tree: dict[str, np.ndarray], features: Sequence[str], cuts) -> dict[str, np.ndarray]:
    """Siblings that predict the same are one leaf; what is left in pre-order, with thresholds and the parents' rows."""
    left, right, depth, n = tree["left"], tree["right"], tree["depth"], tree["n0"] + tree["n1"]
    says, leaf, size, levels = tree["n1"] > tree["n0"], left < 0, np.ones(len(left), np.int64), []
    for d in range(int(depth.max(initial=0)) + 1):
        at = np.flatnonzero((depth == d) & (left >= 0))
        levels.append((at, left[at], right[at]))
    for at, a, b in reversed(levels):
        leaf[at] = leaf[a] & leaf[b] & (says[a] == says[b])
        size[at] = np.where(leaf[at], 1, 1 + size[a] + size[b])
    place, above = np.full(len(left), -1), np.full(len(left), -1)
    place[0] = 0
    for at, a, b in levels:
        on = (place[at] >= 0) & ~leaf[at]
        at, a, b = at[on], a[on], b[on]
        place[a], place[b] = place[at] + 1, place[at] + 1 + size[a]
        above[a] = above[b] = n[at]
    kept = np.flatnonzero(place >= 0)
    kept = kept[np.argsort(place[kept])]
    inner = ~leaf[kept]
    to = lambda child: np.where(inner, place[np.where(inner, child[kept], 0)], -1)
    feature, threshold = np.where(inner, tree["feature"][kept], -1), np.zeros(len(kept))
    for j in range(len(features)):
        threshold[feature == j] = cuts[j][tree["bin"][kept][feature == j]]
    return {"i": np.arange(len(kept)), "depth": depth[kept], "feature": feature, "threshold": threshold, "left": to(left), "right": to(right),
            "n0": tree["n0"][kept], "n1": tree["n1"][kept], "gain": tree["gain"][kept], "parent_n": above[kept]}


def _stops(tree: dict, codes: np.ndarray, settings, depth: int) -> np.ndarray:
    """Class each row gets per (max_depth, min_split): that of the node at which it stops. ``depth``: of the subtree's root."""
    n, says = tree["n0"] + tree["n1"], (tree["n1"] > tree["n0"]).astype(np.int64)
    node, out = np.zeros(len(codes), np.int64), np.full((len(settings), len(codes)), -1)
    while True:
        inner = tree["left"][node] >= 0
        for s, (deep, least) in enumerate(settings):
            ends = ~inner | (n[node] < least) | (False if deep is None else tree["depth"][node] + depth >= deep)
            out[s] = np.where((out[s] < 0) & ends, says[node], out[s])
        go = np.flatnonzero(inner)
        if not len(go):
            return out
        at = node[go]
        node[go] = np.where(codes[go, tree["feature"][at]] <= tree["bin"][at], tree["left"][at], tree["right"][at])


class Grower:
    """Grows the planned trees of one written table; ``grown`` returns one of them, ``held_out`` counts right answers.

    ``missing``: what stands for a missing feature; None refuses rows with one. Trees on all rows and trees on folds have
    samples of their own for their thresholds. ``settings``: what ``held_out`` will be asked for, judged in one pass.
    """

    def __init__(self, df: DataFrame, features: Sequence[str], missing: float | None, plans: Sequence[Plan], label: str = "label",
                 fold_col: str | None = None, max_bins: int = 256, seed: int = 123,
                 settings: Sequence[tuple[int | None, int]] = ()):
        self.features, self.missing, self.plans, self.label, self.fold_col = list(features), missing, list(plans), label, fold_col
        self.df = df.select(*self.features, F.col(label).cast("int").alias("_y"), (F.col(fold_col) if fold_col else F.lit(-1)).cast("int").alias("_f"))
        self.spark, k = df.sparkSession, len(self.features)
        sizes = [(r["_f"], r["_y"], r["n"]) for r in self.df.groupBy("_f", "_y").agg(F.count(F.lit(1)).alias("n")).collect()]
        if any(y not in (0, 1) for _, y, _ in sizes):
            raise ValueError("labels must be 0 or 1")
        self.folds = list(dict.fromkeys(p.fold for p in self.plans))
        few, self.max_bins, self.cuts, read = max(max_bins * max_bins, 10000), max_bins, {}, {}
        self.settings, self.judged = list(settings), {}
        for alike in ([e for e in self.folds if e is None], [e for e in self.folds if e is not None]):
            least = min((sum(n for f, _, n in sizes if e is None or f != e) for e in alike), default=1)
            if not least:
                raise ValueError("a tree needs rows")
            share = None if least <= few else min(1.0, few / least)
            if alike and share not in read:
                known = self.df if share is None else self.df.sample(fraction=share, seed=seed)
                known = known.select(*self.features, "_f").toArrow()
                read[share] = self._matrix(known), known.column("_f").to_numpy()
            for e in alike:
                x, fold = read[share]
                self.cuts[e] = [candidates(x[fold != e, j] if e is not None else x[:, j], max_bins) for j in range(k)]
        self.width = 1 + max(len(c) for cuts in self.cuts.values() for c in cuts) if k else 1
        self.bits = 8 if self.width <= 256 else 16 if self.width <= 1 << 16 else 32
        self.packs = -(-k * self.bits // 64)
        self.tops = []
        for p in self.plans:
            top = _Top()
            top.add(*(sum(n for f, y, n in sizes if y == c and (p.fold is None or f != p.fold)) for c in (0, 1)), 0, -1)
            self.tops.append(top)
        self._split_large()

    def _matrix(self, batch) -> np.ndarray:
        cols = [np.asarray(batch.column(batch.schema.get_field_index(f)).to_numpy(**({} if isinstance(batch, pa.Table) else {"zero_copy_only": False})), float)
                for f in self.features]
        x = np.stack(cols, axis=1) if cols else np.zeros((batch.num_rows, 0))
        if self.missing is None and np.isnan(x).any():
            raise ValueError("a feature is missing")
        return x if self.missing is None else np.nan_to_num(x, nan=self.missing)

    def number_of(self, fold: int | None, min_leaf: int, depth: int) -> int:
        """The planned tree that gives this one when it is cut at ``depth``: splits do not depend on the depth allowed."""
        return next(t for t, p in enumerate(self.plans) if (p.fold, p.min_leaf) == (fold, min_leaf) and p.max_depth >= depth)

    def _task(self):
        """What a task needs, without the session."""
        part = object.__new__(Grower)
        part.features, part.missing, part.plans, part.folds, part.cuts, part.tops = self.features, self.missing, self.plans, self.folds, self.cuts, self.tops
        part.width, part.bits, part.packs = self.width, self.bits, self.packs
        return part

    def _coded(self, batch):
        """(fold left out, codes of the batch, its labels and folds) for every fold left out."""
        x = self._matrix(batch)
        y = batch.column(batch.schema.get_field_index("_y")).to_numpy(zero_copy_only=False).astype(np.int64)
        fold = batch.column(batch.schema.get_field_index("_f")).to_numpy(zero_copy_only=False)
        for e in self.folds:
            yield e, np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts[e])], axis=1) if x.shape[1] else x.astype(np.int64), y, fold

    def _at(self, t: int, codes: np.ndarray, ways: np.ndarray | None = None) -> np.ndarray:
        """Node of the top at which each row stops: a leaf, or (``ways``: nodes that lead on) one that leads nowhere."""
        top = {f: np.array(getattr(self.tops[t], f)) for f in ("left", "right", "feature", "bin")}
        inner = (top["left"] >= 0) if ways is None else (top["left"] >= 0) & ways
        node, go = np.zeros(len(codes), np.int64), np.arange(len(codes))
        while True:
            go = go[inner[node[go]]]
            if not len(go):
                return node
            at = node[go]
            node[go] = np.where(codes[go, top["feature"][at]] <= top["bin"][at], top["left"][at], top["right"][at])

    def _open(self, t: int, node: int) -> bool:
        top = self.tops[t]
        return top.depth[node] < self.plans[t].max_depth and top.n0[node] > 0 and top.n1[node] > 0

    def _split_large(self) -> None:
        large = {(t, 0) for t, top in enumerate(self.tops) if top.n0[0] + top.n1[0] > LOCAL_ROWS and self._open(t, 0)}
        k = len(self.features)
        self.closed: set[tuple[int, int]] = set()
        while large:
            now = sorted(large)[:OPEN_NODES]
            task, nodes = self._task(), {t: np.array([n for u, n in now if u == t]) for t in {t for t, _ in now}}
            # rows are followed to the open nodes only, not into what is finished
            ways = {t: np.isin(np.arange(len(self.tops[t].left)), [a for n in v for a in self.tops[t].path(n)]) for t, v in nodes.items()}
            task.folds = [e for e in self.folds if any(self.plans[t].fold == e for t in nodes)]

            def count(batches):
                sums = {t: np.zeros((len(v), k, task.width, 2), np.int64) for t, v in nodes.items()}
                for b in batches:
                    for e, codes, y, fold in task._coded(b):
                        if e is not None:
                            codes, y = codes[fold != e], y[fold != e]
                        for t in (t for t in nodes if task.plans[t].fold == e):
                            at = task._at(t, codes, ways[t])
                            slot = np.minimum(np.searchsorted(nodes[t], at), len(nodes[t]) - 1)
                            rows = np.flatnonzero(nodes[t][slot] == at)
                            slot = slot[rows]
                            for j in range(k):
                                flat = (slot * task.width + codes[rows, j]) * 2 + y[rows]
                                sums[t][:, j] += np.bincount(flat, minlength=len(nodes[t]) * task.width * 2).reshape(len(nodes[t]), task.width, 2)
                for t, s in sums.items():
                    n, j, b = np.nonzero(s.sum(3))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(n), t, np.int32)), pa.array(nodes[t][n].astype(np.int32)), pa.array(j.astype(np.int32)),
                         pa.array(b.astype(np.int32)), pa.array(s[n, j, b, 0]), pa.array(s[n, j, b, 1])], names=["t", "node", "j", "b", "n0", "n1"])

            counts = self.df.mapInArrow(count, "t int, node int, j int, b int, n0 long, n1 long").groupBy("t", "node", "j", "b").agg(
                F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
            plans, totals = self.plans, {(t, n): (self.tops[t].n0[n], self.tops[t].n1[n]) for t, n in now}

            def best(rows):
                rows = rows.sort_by([("j", "ascending"), ("b", "ascending")])
                t, node = rows.column("t")[0].as_py(), rows.column("node")[0].as_py()
                j, b, n0, n1 = (rows.column(c).to_numpy() for c in ("j", "b", "n0", "n1"))
                features, slot = np.unique(j, return_inverse=True)
                t0, t1 = (np.full(len(features), v, np.int64) for v in totals[(t, node)])
                gain, cut, l0, l1 = _best_of_runs(slot, b, n0, n1, t0, t1, plans[t].min_leaf)
                i = int(gain.argmax())
                return pa.table({"t": pa.array([t], pa.int32()), "node": pa.array([node], pa.int32()), "j": pa.array([features[i]], pa.int32()),
                                 "b": pa.array([cut[i]], pa.int32()), "gain": pa.array([gain[i]], pa.float64()), "l0": pa.array([l0[i]], pa.int64()),
                                 "l1": pa.array([l1[i]], pa.int64())})

            found = counts.groupBy("t", "node").applyInArrow(lambda rows: best(rows), "t int, node int, j int, b int, gain double, l0 long, l1 long").collect()
            large -= set(now)
            for r in sorted(found, key=lambda r: (r["t"], r["node"])):
                t, node, top = r["t"], r["node"], self.tops[r["t"]]
                if not r["gain"] > 0:
                    self.closed.add((t, node))
                    continue
                top.feature[node], top.bin[node], top.gain[node] = r["j"], r["b"], r["gain"]
                top.left[node] = top.add(r["l0"], r["l1"], top.depth[node] + 1, node)
                top.right[node] = top.add(top.n0[node] - r["l0"], top.n1[node] - r["l1"], top.depth[node] + 1, node)
                large |= {(t, c) for c in (top.left[node], top.right[node]) if top.n0[c] + top.n1[c] > LOCAL_ROWS and self._open(t, c)}

    def _finished(self, t: int, node: int) -> bool:
        return self.tops[t].left[node] < 0 and ((t, node) in self.closed or not self._open(t, node))

    def _dealt(self, held: bool) -> DataFrame:
        """(tree, top leaf, class, kind 0 learned or 1 held out, number, packed codes). Rows of finished leaves are counted only.
        ``held``: trees on folds only, with the rows of the fold left out."""
        task = self._task()
        task.folds = [e for e in self.folds if e is not None or not held]
        done = [np.array([self._finished(t, n) for n in range(len(top.left))]) for t, top in enumerate(self.tops)]
        per = 64 // self.bits

        def deal(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                for e, codes, y, fold in task._coded(b):
                    packed = []
                    for p in range(task.packs):
                        word = np.zeros(len(y), np.uint64)
                        for i, j in enumerate(range(p * per, min((p + 1) * per, codes.shape[1]))):
                            word |= codes[:, j].astype(np.uint64) << np.uint64(i * task.bits)
                        packed.append(word.view(np.int64))
                    for t in (t for t, p in enumerate(task.plans) if p.fold == e):
                        node, out = task._at(t, codes), (np.zeros(len(y), bool) if e is None else fold == e)
                        end = done[t][node]
                        keep = np.flatnonzero(~end & (~out | held))
                        parts = [(node[keep], y[keep], out[keep].astype(np.int64), np.ones(len(keep), np.int64), [w[keep] for w in packed])]
                        over = end & out if held else np.zeros(len(y), bool)
                        if over.any():
                            key, n = np.unique(node[over] * 2 + y[over], return_counts=True)
                            parts.append((key >> 1, key & 1, np.ones(len(key), np.int64), n, [np.zeros(len(key), np.int64)] * len(packed)))
                        for at, yy, kind, n, words in parts:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(at), t, np.int32)), pa.array(at.astype(np.int32)), pa.array(yy.astype(np.int32)),
                                 pa.array(kind.astype(np.int32)), pa.array(n.astype(np.int32)), *(pa.array(w) for w in words)],
                                names=["t", "node", "y", "kind", "n", *(f"w{p}" for p in range(len(packed)))])

        return self.df.mapInArrow(deal, "t int, node int, y int, kind int, n int" + "".join(f", w{p} long" for p in range(self.packs)))

    def _unpacked(self, rows) -> np.ndarray:
        k, per, mask = len(self.features), 64 // self.bits, np.uint64((1 << self.bits) - 1)
        words = [rows.column(f"w{p}").to_numpy().view(np.uint64) for p in range(self.packs)]
        return np.stack([((words[j // per] >> np.uint64(j % per * self.bits)) & mask).astype(np.int64) for j in range(k)], axis=1) \
            if k else np.zeros((rows.num_rows, 0), np.int64)

    def _subtree(self, rows):
        """The subtree of a group of ``_dealt``, its rows' codes, and the tree and top leaf it belongs to."""
        t, node = rows.column("t")[0].as_py(), rows.column("node")[0].as_py()
        codes, learn, y = self._unpacked(rows), rows.column("kind").to_numpy() == 0, rows.column("y").to_numpy().astype(np.int64)
        top = self.tops[t]
        # rows come in any order: counts do not depend on it
        tree = grow_rows(codes[learn], y[learn], self.plans[t].min_leaf, self.plans[t].max_depth - top.depth[node])
        if not learn.any():
            tree["n0"], tree["n1"] = np.array([top.n0[node]]), np.array([top.n1[node]])
        return t, node, tree, codes, learn, y

    def held_out(self, settings: Sequence[tuple[int | None, int]]) -> dict[tuple[int, int], tuple[int, int]]:
        """Of each (tree, setting): right answers and rows of the fold left out. Nothing else reaches the driver."""
        new = [s for s in dict.fromkeys([*self.settings, *settings]) if s not in self.judged]
        if new:
            found = self._judge(new)
            for i, s in enumerate(new):
                self.judged[s] = {t: v for (t, j), v in found.items() if i == j}
        return {(t, i): v for i, s in enumerate(settings) for t, v in self.judged[s].items()}

    def _judge(self, settings) -> dict[tuple[int, int], tuple[int, int]]:
        task = self._task()

        def judge(rows):
            t, node, tree, codes, learn, y = task._subtree(rows)
            top, held, n = task.tops[t], ~learn, rows.column("n").to_numpy()
            says = _stops(tree, codes[held], settings, top.depth[node])
            for s, (deep, least) in enumerate(settings):
                for a in top.path(node)[:-1]:
                    if top.n0[a] + top.n1[a] < least or (deep is not None and top.depth[a] >= deep):
                        says[s] = int(top.n1[a] > top.n0[a])
                        break
            right = ((says == y[held][None, :]) * n[held][None, :]).sum(1)
            return pa.table({"t": pa.array([t] * len(settings), pa.int32()), "s": pa.array(range(len(settings)), pa.int32()),
                             "r": pa.array(right, pa.int64()), "n": pa.array([int(n[held].sum())] * len(settings), pa.int64())})

        parts = self._dealt(True).groupBy("t", "node").applyInArrow(lambda rows: judge(rows), "t int, s int, r long, n long")
        return {(r["t"], r["s"]): (r["r"], r["n"]) for r in parts.groupBy("t", "s").agg(F.sum("r").alias("r"), F.sum("n").alias("n")).collect()}

    def _one(self, t: int, depth: int) -> "Grower":
        """One of the trees alone, cut at ``depth``."""
        part, p = self._task(), self.plans[t]
        part.plans, part.folds, part.tops = [Plan(p.fold, p.min_leaf, min(p.max_depth, depth))], [p.fold], [self.tops[t].cut(depth)]
        part.df, part.spark, part.closed = self.df, self.spark, {(0, n) for u, n in self.closed if u == t}
        return part

    def written(self, t: int = 0, depth: int | None = None) -> DataFrame:
        """Nodes of one tree, cut at ``depth``, as a written table (``TABLE_SCHEMA``); siblings that predict the same are one leaf,
        ids count in pre-order. The driver sees the nodes of ``_Top`` and one row for each subtree below them."""
        one = self._one(t, self.plans[t].max_depth if depth is None else depth)
        task, top, cuts, features = one._task(), one.tops[0], self.cuts[self.plans[t].fold], self.features

        def subtree(rows):
            _, node, tree, *_ = task._subtree(rows)
            out = _pruned(tree, features, cuts)
            types = {"threshold": pa.float64(), "gain": pa.float64(), "n0": pa.int64(), "n1": pa.int64(), "parent_n": pa.int64()}
            return pa.table({"node": pa.array(np.full(len(out["i"]), node), pa.int32()),
                             **{c: pa.array(v, types.get(c, pa.int32())) for c, v in out.items()}})

        below = cut_lineage(one._dealt(False).groupBy("node").applyInArrow(
            lambda rows: subtree(rows), "node int, i int, depth int, feature int, threshold double, left int, right int, n0 long, n1 long, "
                                        "gain double, parent_n long"))
        size = {r["node"]: r["size"] for r in below.groupBy("node").agg(F.count(F.lit(1)).alias("size")).collect()}
        # the top: finished leaves and subtrees of one node are leaves, siblings of the same class one leaf
        order, todo = [], [0]
        while todo:
            a = todo.pop()
            order.append(a)
            if top.left[a] >= 0:
                todo += [top.right[a], top.left[a]]
        says, leaf, whole = [n1 > n0 for n0, n1 in zip(top.n0, top.n1)], {}, {}
        for a in reversed(order):
            if top.left[a] < 0:
                leaf[a], whole[a] = size.get(a, 1) == 1, size.get(a, 1)
            else:
                x, y = top.left[a], top.right[a]
                leaf[a] = leaf[x] and leaf[y] and says[x] == says[y]
                whole[a] = 1 if leaf[a] else 1 + whole[x] + whole[y]
        rows, roots, todo = [], [], [(0, 0, -1)]
        while todo:
            a, at, above = todo.pop()
            n, inner = top.n0[a] + top.n1[a], top.left[a] >= 0 and not leaf[a]
            if top.left[a] < 0 and whole[a] > 1:
                roots.append((a, at, above, top.depth[a]))
                continue
            first, second = at + 1, at + 1 + whole[top.left[a]] if inner else None
            rows.append((at, top.depth[a], features[top.feature[a]] if inner else None, float(cuts[top.feature[a]][top.bin[a]]) if inner else None,
                         first if inner else None, second, n, float(top.n0[a]), float(top.n1[a]), int(says[a]),
                         float(top.gain[a]) if inner else None, above, -1))
            if inner:
                todo += [(top.left[a], first, n), (top.right[a], second, n)]
        upper = self.spark.createDataFrame(rows, TABLE_SCHEMA)
        if not roots:
            return cut_lineage(upper.coalesce(1))
        places = self.spark.createDataFrame(roots, "node int, part int, above long, down int")
        names, inner = F.array(*[F.lit(f) for f in features]), F.col("left") >= 0
        lower = below.join(F.broadcast(places), "node").select(
            (F.col("i") + F.col("part")).alias("id"), (F.col("depth") + F.col("down")).alias("depth"),
            F.when(inner, F.get(names, F.col("feature"))).alias("feature"), F.when(inner, F.col("threshold")).alias("threshold"),
            F.when(inner, F.col("left") + F.col("part")).alias("left"), F.when(inner, F.col("right") + F.col("part")).alias("right"),
            (F.col("n0") + F.col("n1")).alias("n"), F.col("n0").cast("double").alias("n0"), F.col("n1").cast("double").alias("n1"),
            (F.col("n1") > F.col("n0")).cast("int").alias("prediction"), F.when(inner, F.col("gain")).alias("gain"),
            F.when(F.col("i") == 0, F.col("above")).otherwise(F.col("parent_n")).alias("parent_n"), "part")
        return cut_lineage(lower.unionByName(upper))

    def grown(self, t: int = 0) -> list[dict]:
        """Nodes of one tree as ``trees.nodes_of`` gives them, with ``gain``: here the driver holds the whole tree."""
        return self.written(t).drop("part", "parent_n").toArrow().sort_by("id").to_pylist()
