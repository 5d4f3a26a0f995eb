"""X11: trade-offs between several objectives (rows that no other row beats).

A row is beaten by one that is at least as good in every objective and better in one. Rows with equal objectives do
not beat each other, so the work goes by distinct objective vectors. Sorted by the sum of their (turned) objectives, a
vector can only be beaten by one before it: one pass over a sorted partition with the unbeaten vectors so far finds
the partition's skyline. Partitions are reduced in rounds, each to the skyline of a few of the round before.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speclab.session import cut_lineage

MERGE = 8                # partitions that meet in one of the next round
BLOCK = 512              # vectors compared with the unbeaten ones at once
COMPARE = 1 << 22        # comparisons held at once


def _beaten(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which rows of ``x`` some row of ``by`` (none equal to them) is nowhere worse than."""
    out = np.zeros(len(x), bool)
    step = max(1, COMPARE // max(1, x.size))
    for at in range(0, len(by), step):
        open_ = np.flatnonzero(~out)
        if not len(open_):
            break
        out[open_] = (by[None, at:at + step, :] <= x[open_][:, None, :]).all(2).any(1)
    return out


class _Window:
    """Unbeaten vectors so far, of vectors that come sorted by sum and then by value."""

    def __init__(self, width: int):
        self.rows = np.zeros((0, width))

    def add(self, x: np.ndarray) -> None:
        for at in range(0, len(x), BLOCK):
            part = x[at:at + BLOCK]
            part = part[~_beaten(part, self.rows)]
            # within the block, a vector may be beaten by an earlier one
            worse = (part[None, :, :] <= part[:, None, :]).all(2)
            np.fill_diagonal(worse, False)
            self.rows = np.concatenate([self.rows, part[~worse.any(1)]])


def _local(vectors: DataFrame, names: list[str]) -> DataFrame:
    """The skyline of each partition of distinct vectors."""
    def run(batches):
        window = _Window(len(names))
        for b in batches:
            if b.num_rows:
                window.add(np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))], 1))
        for at in range(0, len(window.rows), 1 << 16):
            rows = window.rows[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(names))], names=names)

    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    return vectors.sortWithinPartitions(total, *names).mapInArrow(run, ", ".join(f"{c} double" for c in names))


def skyline_vectors(vectors: DataFrame, names: list[str], partitions: int | None = None) -> DataFrame:
    """The vectors (smaller is better in every column) that none of the others beats; the input is distinct."""
    parts = partitions or max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    now = cut_lineage(_local(vectors.repartition(parts, *names), names))
    while parts > 1:
        parts = -(-parts // MERGE)
        now = cut_lineage(_local(now.repartition(parts, *names), names))
    return now


def multi_objective_tradeoff(df: DataFrame, objectives: Mapping[str, str], partitions: int | None = None) -> DataFrame:
    """X11: the rows of ``df`` that no other row beats, all columns kept.

    ``objectives``: column -> ``"min"`` or ``"max"``. Rows with equal objectives stay together, repeated rows too. A
    row with a missing (null or NaN) objective takes no part and is not returned; an empty input gives no rows.
    The last round runs in one task, which reads the skylines of the round before in order and holds the result's
    distinct vectors, no more.
    """
    names = [f"_o{i}" for i in range(len(objectives))]
    turned = []
    for name, (c, way) in zip(names, objectives.items()):
        if way not in ("min", "max"):
            raise ValueError(f"objective {c}: {way}")
        v = F.col(c).cast("double")
        turned.append(((v if way == "min" else -v) + 0.0).alias(name))          # one zero
    known = df.select("*", *turned).where(" and ".join(f"{c} is not null and not isnan({c})" for c in names))
    best = skyline_vectors(known.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).select(*names), names, partitions)
    return known.join(best, names, "left_semi").drop(*names)
