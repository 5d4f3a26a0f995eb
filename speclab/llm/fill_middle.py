"""Fill-in-middle transformation by displacement scatter.

A batch's texts are one byte array. Line ends give the cuts; every segment moves as a whole, so a difference
array holding, at each segment's start, the change of displacement gives every byte its output shift by one
cumulative sum, and one numpy scatter writes all outputs. Restoring parses the marks of the outputs, builds the
shifts of the original bytes the same way and gathers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from speclab.llm.common import bounded_batches, type_of

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3                        # bytes of a mark
BLOCK = 1 << 20                 # bytes whose shifts are held at once
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ["plain", "psm", "spm"]


def _bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its ``n + 1`` offsets (nulls are empty)."""
    col = col.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    held = col.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _strings(data: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    out = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
    out = out.cast(pa.string())
    return out if valid is None else pa.compute.if_else(pa.array(valid), out, pa.scalar(None, pa.string()))


def _marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position and text number of every mark that lies inside one text."""
    at = np.flatnonzero(data == PREFIX[0])
    at = at[at + MARK <= len(data)]
    kind = data[at + 1]
    at = at[(data[at + 2] == PREFIX[2]) & ((kind == PREFIX[1]) | (kind == SUFFIX[1]) | (kind == MIDDLE[1]))]
    owner = np.searchsorted(offsets, at, "right") - 1
    inside = at + MARK <= offsets[owner + 1]
    return at[inside], owner[inside]


def _shifts(starts: np.ndarray, moves: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Blocks ``(from, to, shift of each byte)`` of ``n`` bytes; ``starts`` ascend, ``moves`` are the segments' shifts."""
    steps = np.diff(moves, prepend=0)
    carry = 0
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        a, b = np.searchsorted(starts, [lo, hi], "left")
        diff = np.zeros(hi - lo, np.int64)
        np.add.at(diff, starts[a:b] - lo, steps[a:b])
        diff[0] += carry
        shift = np.cumsum(diff)
        carry = int(shift[-1])
        yield lo, hi, shift


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of all lines, each text's first line and its number of lines."""
    ends = np.flatnonzero(data == 10) + 1
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    tails = offsets[full + 1]
    ends = np.union1d(ends, tails[data[tails - 1] != 10])
    first = np.searchsorted(ends, offsets[:-1], "right")
    return ends, first, np.searchsorted(ends, offsets[1:], "right") - first


def scatter(data: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the outputs of texts cut at bytes ``a`` and ``b``."""
    start, end = offsets[:-1], offsets[1:]
    p, m, s = a - start, b - a, end - b
    cut = form != PLAIN
    out = np.concatenate(([0], np.cumsum(end - start + 3 * MARK * cut)))
    first, psm = out[:-1] + MARK, form == PSM
    to_p = np.where(psm, first, first + s + MARK)
    to_s = np.where(psm, first + p + MARK, first)
    to_m = first + p + s + 2 * MARK
    own = out[:-1] - start                       # a plain text moves as one
    moves = np.stack([np.where(cut, to_p - start, own), np.where(cut, to_m - a, own), np.where(cut, to_s - b, own)], 1).ravel()
    made = np.empty(out[-1], np.uint8)
    for lo, hi, shift in _shifts(np.stack([start, a, b], 1).ravel(), moves, len(data)):
        made[np.arange(lo, hi) + shift] = data[lo:hi]
    for to, mark in ((to_p, PREFIX), (to_s, SUFFIX), (to_m, MIDDLE)):
        for i, byte in enumerate(mark):
            made[to[cut] - MARK + i] = byte
    return made, out


def gather(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and validity of the texts behind outputs; an output without its three marks is not valid."""
    at, owner = _marks(data, offsets)
    cut = form != PLAIN
    at, owner = at[cut[owner]], owner[cut[owner]]
    valid = ~cut | (np.bincount(owner, minlength=len(form)) == 3)
    good = np.flatnonzero(cut & valid)
    found = at[np.isin(owner, good)].reshape(-1, 3)
    start, end = offsets[:-1], offsets[1:]
    psm = form[good] == PSM
    seg1, seg2, seg3 = found[:, 0] + MARK, found[:, 1] + MARK, found[:, 2] + MARK
    len1, len2, len3 = found[:, 1] - seg1, found[:, 2] - seg2, end[good] - seg3
    size = np.where(valid, end - start - 3 * MARK * cut, 0)
    out = np.concatenate(([0], np.cumsum(size)))
    # source and length of prefix, middle, suffix; a plain text is one segment
    src = np.stack([start, end, end], 1)
    length = np.stack([size, np.zeros_like(size), np.zeros_like(size)], 1)
    src[good] = np.stack([np.where(psm, seg1, seg2), seg3, np.where(psm, seg2, seg1)], 1)
    length[good] = np.stack([np.where(psm, len1, len2), len3, np.where(psm, len2, len1)], 1)
    to = out[:-1, None] + np.cumsum(length, 1) - length
    made = np.empty(out[-1], np.uint8)
    for lo, hi, shift in _shifts(to.ravel(), (src - to).ravel(), len(made)):
        made[lo:hi] = data[np.arange(lo, hi) + shift]
    return made, out, valid


def _draws(ids: list, seed: int) -> np.ndarray:
    """Four unsigned 32-bit draws an id."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100,
              spm_rate: int = 50) -> DataFrame:
    """``(id_col, n, form, prefix_chars, middle_chars, output)`` for every row of ``docs``.

    A text of ``n`` lines is cut after two of its line ends, drawn by a hash of ``seed`` and the id; ``rate`` percent
    of the texts are cut, ``spm_rate`` percent of those put the suffix first. Null texts are empty; empty texts and
    texts that hold a mark stay plain. A null id draws as the empty id; equal ids draw alike. Repeated rows keep
    their multiplicity, other columns are not read, an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"))

    def run(batches):
        for batch in batches:
            data, offsets = _bytes_of(batch.column(1))
            ends, first, n = _units(data, offsets)
            h = _draws(batch.column(0).to_pylist(), seed)
            form = np.where(h[:, 3] % 100 < spm_rate, SPM, PSM)
            form[(n == 0) | (h[:, 2] % 100 >= rate)] = PLAIN
            form[_marks(data, offsets)[1]] = PLAIN
            one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
            ends = np.append(ends, 0)

            def cut(k):
                return np.where(k == 0, offsets[:-1], ends[np.maximum(first + k - 1, 0)])
            a, b = cut(np.minimum(one, two)), cut(np.maximum(one, two))
            made, out = scatter(data, offsets, a, b, form)
            lead = (data & 0xC0) != 0x80
            chars = [(None, None) if f == PLAIN else (int(np.count_nonzero(lead[s:x])), int(np.count_nonzero(lead[x:y])))
                     for f, s, x, y in zip(form.tolist(), offsets[:-1].tolist(), a.tolist(), b.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array([FORMS[f] for f in form.tolist()], pa.string()),
                 pa.array([c[0] for c in chars], pa.int64()), pa.array([c[1] for c in chars], pa.int64()),
                 _strings(made, out)], names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    return slim.mapInArrow(run, f"`{id_col}` {type_of(docs, id_col)}, n long, form string, prefix_chars long, "
                                "middle_chars long, output string")


def restore(outputs: DataFrame, output_col: str = "output", form_col: str = "form", restored_col: str = "restored") -> DataFrame:
    """``outputs`` and one more column: the exact text behind each output, from output and form alone.

    A null output or form and an output without its three marks give null. Columns are passed through
    unread; one named ``restored_col`` is replaced.
    """
    bounded_batches(outputs.sparkSession)
    kept = [c for c in outputs.columns if c != restored_col]
    slim = outputs.select(*[outputs[c].alias(f"k{i}") for i, c in enumerate(kept)])
    at_output, at_form = kept.index(output_col), kept.index(form_col)
    schema = ", ".join([*(f"`{c}` {type_of(outputs, c)}" for c in kept), f"`{restored_col}` string"])

    def run(batches):
        code = {name: k for k, name in enumerate(FORMS)}
        for batch in batches:
            known = np.array([code.get(f, -1) for f in batch.column(at_form).to_pylist()], np.int64)
            data, offsets = _bytes_of(batch.column(at_output))
            made, out, valid = gather(data, offsets, np.maximum(known, PLAIN))
            valid &= (known >= 0) & batch.column(at_output).is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, _strings(made, out, valid)], names=[*kept, restored_col])

    return slim.mapInArrow(run, schema)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, ('0x' || substr(h, 1, 8))::BIGINT AS h1,
    ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (
  SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
    greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
         WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS p, coalesce(array_to_string(units[a + 1:b], ''), '') AS m,
    coalesce(array_to_string(units[b + 1:n], ''), '') AS x FROM c)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form != 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m
         ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM s
"""
