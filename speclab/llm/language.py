"""Language identification by a byte convolutional network trained in numpy.

Bytes enter one-hot, so a filter of width w is a table (w, 256) and a convolution is a
sum of w table rows; filters of several widths are max-pooled over a window of fixed length
and a softmax layer reads the pooled values. A text is cut into windows that cover all of it;
its class probabilities are the windows' mean, weighted by their bytes.

The network is fitted on the driver from a bounded sample (``docs_per_label`` documents of each
language, ``windows_per_doc`` windows of each); prediction covers whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speclab.llm.common import bounded_batches, map_texts, type_of

WINDOW = 256                # bytes pooled together
WIDTHS = (2, 3, 4)
FILTERS = 8                 # of each width
REACH = max(WIDTHS) - 1     # bytes a window looks past its end, so no n-gram is lost between windows
DOCS_PER_LABEL = 1500       # bound of the training sample
WINDOWS_PER_DOC = 4
MAX_LABELS = 512
BLOCK = 256                 # windows convolved at once
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}").search


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text, one row each, zero-padded."""
    n = max(1, -(-len(data) // WINDOW))
    buf = np.zeros(n * WINDOW + REACH, np.uint8)
    buf[:len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(buf, WINDOW + REACH)[::WINDOW]


class ByteNet:
    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        n = FILTERS * len(WIDTHS)
        # table[k] is the filters' weight for the byte k places on; narrower filters end earlier
        self.table = rng.normal(0, 0.1, (max(WIDTHS), 256, n)).astype(np.float32)
        self.live = np.array([[w > k for w in WIDTHS for _ in range(FILTERS)] for k in range(max(WIDTHS))])
        self.table *= self.live[:, None, :]
        self.table[:, 0] = 0                                  # padding says nothing
        self.out = rng.normal(0, 0.1, (n, len(labels))).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def _pool(self, x: np.ndarray, where: bool = False):
        """Max-pooled filter values (rows, filters); with ``where`` also the places of the maxima."""
        acc = self.table[0][x[:, :WINDOW]]
        for k in range(1, max(WIDTHS)):
            first = FILTERS * sum(w <= k for w in WIDTHS)     # widths ascend: the rest is zero
            acc[:, :, first:] += self.table[k, :, first:][x[:, k:k + WINDOW]]
        return (acc.max(1), acc.argmax(1)) if where else acc.max(1)

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.out + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._softmax(self._pool(x[i:i + BLOCK])) for i in range(0, len(x), BLOCK)])

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.02, batch: int = 64, seed: int = 11):
        """Adam on the cross entropy; some windows are cut short so short texts are learned too."""
        rng = np.random.default_rng(seed)
        params = [self.table, self.out, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        cols = np.arange(self.out.shape[0])
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i:i + batch]
                xb = x[rows].copy()
                for r in np.flatnonzero(rng.random(len(rows)) < 0.3):
                    xb[r, rng.integers(8, WINDOW):] = 0
                pooled, at = self._pool(xb, where=True)
                hidden = np.maximum(pooled, 0)
                p = self._softmax(pooled)
                p[np.arange(len(rows)), y[rows]] -= 1
                p /= len(rows)
                g_hidden = (p @ self.out.T) * (pooled > 0)
                g_table = np.zeros_like(self.table)
                for k in range(max(WIDTHS)):
                    byte = np.take_along_axis(xb, at + k, 1)
                    np.add.at(g_table[k], (byte, cols[None, :]), g_hidden)
                g_table *= self.live[:, None, :]
                g_table[:, 0] = 0
                step += 1
                for q, g, a, b in zip(params, [g_table, hidden.T @ p, p.sum(0)], first, second):
                    a *= 0.9
                    a += 0.1 * g
                    b *= 0.999
                    b += 0.001 * g * g
                    q -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
        return self

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Label and score of each whole text; ``und`` and 0 where it has no letter."""
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        todo = [i for i, t in enumerate(texts) if t and LETTER(t)]
        at = 0
        while at < len(todo):
            blocks, rows, size = [], [], 0
            while at < len(todo) and (not blocks or size < 4 * BLOCK):
                data = texts[todo[at]].encode()
                w = windows_of(data)
                blocks.append((w, len(data)))
                rows.append(todo[at])
                size += len(w)
                at += 1
            p = self.probabilities(np.concatenate([w for w, _ in blocks]))
            end = 0
            for i, (w, n) in zip(rows, blocks):
                own = p[end:end + len(w)]
                end += len(w)
                weight = np.full(len(w), WINDOW, float)
                weight[-1] = n - WINDOW * (len(w) - 1)
                mean = weight @ own / weight.sum()
                best = int(mean.argmax())
                labels[i], scores[i] = self.labels[best], float(min(1.0, mean[best]))
        return labels, scores


def train(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
          docs_per_label: int = DOCS_PER_LABEL, max_labels: int = MAX_LABELS) -> ByteNet | None:
    """Fit on a sample of about ``docs_per_label`` different documents a label, picked by a hash of id and text.

    Rows with a null label or without a letter are not used; None where nothing is left. Equal rows are one
    document, rows of one id with different texts are several. Of more than ``max_labels`` labels the commonest
    are learned (ties by name), and no other is ever predicted. The driver receives at most ``docs_per_label``
    (in expectation) times ``WINDOWS_PER_DOC`` windows of ``WINDOW`` bytes for each of them.
    """
    rows = docs.select(docs[label_col].cast("string").alias("label"), docs[id_col].cast("string").alias("id"),
                       docs[text_col].alias("t")).where(F.col("label").isNotNull() & F.col("t").rlike(r"\p{L}"))
    mark = F.xxhash64("id", "t")
    often = (rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(mark).alias("different"))
             .orderBy(F.desc("n"), "label").limit(max_labels))
    counts = {r["label"]: max(1, r["different"]) for r in often.collect()}
    if not counts:
        return None
    labels = sorted(counts)
    parts = 1 << 20
    share = F.create_map(*[F.lit(v) for k in labels for v in (k, min(parts, -(-parts * docs_per_label // counts[k])))])
    drawn = rows.where(F.pmod(mark, F.lit(parts)) < F.try_element_at(share, F.col("label"))).distinct()
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, key, out = [], [], []
            for name, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                w = windows_of(t.encode())
                for j in np.unique(np.linspace(0, len(w) - 1, WINDOWS_PER_DOC).astype(int)):
                    label.append(name)
                    key.append(f"{i} {j}")
                    out.append(w[j].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.string()), pa.array(key, pa.string()),
                                              pa.array(out, pa.binary())], names=["label", "key", "w"])

    sample = sorted((r["label"], r["key"], bytes(r["w"])) for r in
                    drawn.mapInArrow(cut, "label string, key string, w binary").collect())
    x = np.frombuffer(b"".join(w for _, _, w in sample), np.uint8).reshape(len(sample), WINDOW + REACH)
    y = np.searchsorted(np.array(labels), np.array([n for n, _, _ in sample]))
    return ByteNet(labels).fit(x, y)


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, lang_pred, score)`` for every row, from the whole text alone.

    ``und`` with score 0: null or letterless text, or no network. Repeated rows stay,
    null ids are kept, other columns are not read; an empty table gives no rows.
    """
    def make(texts):
        label, score = net.predict(texts) if net else ([UNKNOWN] * len(texts), [0.0] * len(texts))
        return {"lang_pred": pa.array(label, pa.string()), "score": pa.array(score, pa.float64())}
    return map_texts(docs, id_col, text_col, [],
                     f"`{id_col}` {type_of(docs, id_col)}, lang_pred string, score double", make)
