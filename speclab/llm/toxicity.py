"""Toxicity by a linear-chain conditional random field over tokens.

Labels mark documents, so tokens of the training sample are labelled first: in
a toxic document, a word whose document frequency is much higher among toxic than among
clean documents is toxic, and so is a word whose stem (first letters) has that excess;
every token of a clean document is clean. Near copies count
once, so a copied document does not make its words toxic.

The field has two tags, emission weights for words, stems and word endings and one weight for each pair
of neighbouring tags. Chains end at line ends and after ``CHAIN`` tokens. Forward-backward
marginals give each token's probability; a logistic layer over a document's marginals gives
its score, and tokens whose marginal reaches ``SPAN_AT`` are its offending spans.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speclab.llm.common import bounded_batches, map_texts, type_of
from speclab.llm.simhash import fingerprint

CHAIN = 128                  # tokens of a chain at most
DOCS_PER_CLASS = 2000        # bound of the training sample
FIT_BYTES = 1 << 15          # longer documents are not drawn into the sample (they are scored whole)
CHAINS_PER_CLASS = 8000     # chains with and without toxic tokens the field is fitted on
COPY_BITS = 10               # sampled documents this close count once
SPAN_AT = 0.5
STEMS = (4, 5)               # letters of the stems a word is known by, if it is longer
LEAST_SHARE = 0.005          # of the toxic documents, that a toxic word or stem stands in
EXCESS = 8                   # times its share of the clean documents
QUIET = 0.05                 # marginals below this say nothing about the document
MEMORY = 1 << 19             # distinct tokens a worker remembers
THRESHOLD = 0.3
TOKEN = re.compile(r"[^\W\d_]+")


def _line_chains(text: str) -> list[list[str]]:
    return [w[i:i + CHAIN] for line in text.split("\n") for w in [TOKEN.findall(line)]
            for i in range(0, len(w), CHAIN)]


def _features(word: str) -> list[str]:
    """What the field knows of a lower-case word: itself, its stems, its ending."""
    return [f"w {word}", *(f"s {word[:n]}" for n in STEMS if len(word) > n), f"e {word[-3:]}"]


class _Emissions(dict):
    """Emission weight of a token, filled in as tokens are met."""

    def __init__(self, weight: dict, bias: float):
        super().__init__()
        self.weight, self.bias = weight, bias

    def __missing__(self, token):
        value = self.bias + sum(self.weight.get(f, 0.0) for f in _features(token.lower()))
        if len(self) < MEMORY:
            self[token] = value
        return value


def _step(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log-odds of the next tag from the log-odds ``r`` of this one (t[i, j]: weight of tag i before j)."""
    return np.logaddexp(r + t[1, 1], t[0, 1]) - np.logaddexp(r + t[1, 0], t[0, 0])


def marginals(emission: np.ndarray, size: np.ndarray, t: np.ndarray, pairs: bool = False):
    """Probability of the toxic tag for every token of ragged chains, by forward and backward passes.

    With ``pairs`` also the expected number of each pair of neighbouring tags.
    """
    order = np.argsort(-size, kind="stable")
    start = (np.cumsum(size) - size)[order]
    n = size[order]
    fwd, back = np.empty(len(emission)), np.zeros(len(emission))
    longest = int(n[0]) if len(n) else 0
    alive = np.searchsorted(-n, -np.arange(longest), side="left")     # chains longer than i
    for i in range(longest):
        at = start[:alive[i]] + i
        fwd[at] = emission[at] if i == 0 else emission[at] + _step(fwd[at - 1], t)
    for i in range(longest - 2, -1, -1):
        at = start[:alive[i + 1]] + i
        back[at] = _step(emission[at + 1] + back[at + 1], t.T)
    p = 1 / (1 + np.exp(-np.clip(fwd + back, -60, 60)))
    if not pairs:
        return p
    inner = np.ones(len(emission), bool)
    inner[start] = False
    at = np.flatnonzero(inner)
    a, b = fwd[at - 1], emission[at] + back[at]
    joint = np.stack([np.zeros(len(at)) + t[0, 0], b + t[0, 1], a + t[1, 0], a + b + t[1, 1]])
    joint = np.exp(joint - joint.max(0))
    return p, (joint / joint.sum(0)).sum(1).reshape(2, 2)


class ToxicityModel:
    def __init__(self, weight: dict, bias: float, pair: np.ndarray, layer: np.ndarray):
        self.weight, self.bias, self.pair, self.layer = weight, bias, pair, layer
        self.cache = None

    def __getstate__(self):
        return self.__dict__ | {"cache": None}

    def tag(self, texts: list[str | None]) -> list[np.ndarray]:
        """Marginals of each text's tokens, in order."""
        if self.cache is None:
            self.cache = _Emissions(self.weight, self.bias)
        chains = [_line_chains(t or "") for t in texts]
        size = np.array([len(c) for cs in chains for c in cs], np.int64)
        get = self.cache.__getitem__
        e = np.fromiter((get(w) for cs in chains for c in cs for w in c), np.float64, int(size.sum()))
        p = marginals(e, size, self.pair)
        ends = np.cumsum([sum(map(len, cs)) for cs in chains]).astype(int)
        return np.split(p, ends[:-1]) if len(texts) else []

    def score(self, p: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(_document(p) @ self.layer, -60, 60))))

    def spans(self, text: str | None, p: np.ndarray) -> list[dict]:
        """Offsets (code points) of the offending tokens."""
        if not (p >= SPAN_AT).any():
            return []
        places = [m.span() for m in TOKEN.finditer(text)]
        return [{"start": places[i][0], "end": places[i][1]} for i in np.flatnonzero(p >= SPAN_AT)]


def _document(p: np.ndarray) -> np.ndarray:
    loud = p[p >= QUIET]
    return np.array([1.0, loud.max() if len(loud) else 0.0, np.log1p(loud.sum())])


def _distinct(texts: list[str]) -> list[int]:
    """Positions of texts that are no near copy of an earlier one."""
    fp = np.array([fingerprint(t) for t in texts], np.uint64)
    keep: list[int] = []
    for i in range(len(texts)):
        if not keep or np.bitwise_count(fp[keep] ^ fp[i]).min() > COPY_BITS:
            keep.append(i)
    return keep


def fit(texts: list[str], toxic: list[int]) -> ToxicityModel:
    """Fit the field and the document layer on a (bounded) list of labelled texts."""
    keep = _distinct(texts)
    texts, toxic = [texts[i] for i in keep], np.array([toxic[i] for i in keep], int)
    n1, n0 = max(1, int(toxic.sum())), max(1, int((toxic == 0).sum()))
    seen: dict[str, list[int]] = {}
    n_chains = 0
    for text, y in zip(texts, toxic):
        chains = _line_chains(text)
        n_chains += len(chains)
        for f in {f for w in {w.lower() for c in chains for w in c} for f in _features(w)[:-1]}:
            seen.setdefault(f, [0, 0])[y] += 1
    # smoothed ratio of document frequencies; a rare word proves nothing
    bad = {f for f, (b, a) in seen.items()
           if a >= max(3, LEAST_SHARE * n1) and (a + 0.5) / (n1 + 1) > EXCESS * (b + 0.5) / (n0 + 1)}
    del seen
    # chains are cut again rather than held: words are interned, and only the kept chains stay
    rng = np.random.default_rng(5)
    hot, cold = [], []
    for text, y in zip(texts, toxic):
        for c in _line_chains(text):
            low = [sys.intern(w.lower()) for w in c]
            tags = [int(bool(y) and not bad.isdisjoint(_features(w)[:-1])) for w in low] if y else [0] * len(low)
            if any(tags):
                hot.append((low, tags))
            elif rng.random() * n_chains < CHAINS_PER_CLASS:
                cold.append((low, tags))
    rows = [hot[i] for i in sorted(rng.permutation(len(hot))[:CHAINS_PER_CLASS].tolist())] + cold
    model = ToxicityModel(*_fit_field(rows), np.zeros(3))
    x = np.array([_document(p) for at in range(0, len(texts), 128) for p in model.tag(texts[at:at + 128])]).reshape(-1, 3)
    model.cache = None
    model.layer = _fit_layer(x, toxic)
    return model


def _fit_field(rows, rounds: int = 60, rate: float = 0.3, ridge: float = 2e-4):
    """Adam on the mean log-likelihood of the tagged chains: feature weights, bias, pair weights."""
    words = sorted({w for c, _ in rows for w in c})
    known = [_features(w) for w in words]
    names = sorted({f for fs in known for f in fs})
    at_word, at_name = {w: i for i, w in enumerate(words)}, {f: i for i, f in enumerate(names)}
    size = np.array([len(c) for c, _ in rows], np.int64)
    x = np.array([at_word[w] for c, _ in rows for w in c], np.int64)
    y = np.array([t for _, ts in rows for t in ts], np.int64)
    if not len(x):
        return {}, -3.0, np.zeros((2, 2))
    # words by their features, flat: a word's weight is the sum of its features'
    owner = np.repeat(np.arange(len(words)), [len(fs) for fs in known])
    feature = np.array([at_name[f] for fs in known for f in fs], np.int64)
    inner = np.ones(len(x), bool)
    inner[np.cumsum(size) - size] = False
    at = np.flatnonzero(inner)
    seen_pairs = np.bincount(2 * y[at - 1] + y[at], minlength=4)
    params = [np.zeros(len(names)), np.full(1, -3.0), np.zeros(4)]
    first, second = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params]
    for step in range(1, rounds + 1):
        w, b, t = params
        weight = np.bincount(owner, w[feature], len(words))
        p, pairs = marginals(weight[x] + b[0], size, t.reshape(2, 2), pairs=True)
        err = (y - p) / len(rows)
        by_word = np.bincount(x, err, len(words))
        grads = [np.bincount(feature, by_word[owner], len(names)) - ridge * w, np.array([err.sum()]),
                 (seen_pairs - pairs.ravel()) / len(rows)]
        for q, g, m, v in zip(params, grads, first, second):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            q += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    w, b, t = params
    return {f: float(v) for f, v in zip(names, w) if abs(v) > 0.05}, float(b[0]), t.reshape(2, 2)


def _fit_layer(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method for the logistic document layer."""
    beta = np.zeros(x.shape[1])
    if not len(x):
        return beta
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        beta = beta + np.linalg.solve(h, x.T @ (y - p) - ridge * beta)
    return beta


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          docs_per_class: int = DOCS_PER_CLASS) -> ToxicityModel | None:
    """Fit on about ``docs_per_class`` labelled documents a class, picked by a hash of the id.

    The drawn labels (a bounded number of rows) are broadcast to the documents; the
    driver receives at most that many texts of at most ``FIT_BYTES`` bytes: an id on many rows
    gives one of its texts, the one of least hash. A document labelled twice is toxic if any label
    says so; null labels and ids are ignored. None where no label is left.
    """
    own = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
           .groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y")))
    counts = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    if not counts:
        return None
    parts = 1 << 20
    share = F.create_map(*[F.lit(v) for k in sorted(counts)
                           for v in (k, min(parts, -(-parts * docs_per_class // counts[k])))])
    drawn = own.where(F.pmod(F.xxhash64("id"), F.lit(parts)) < share[F.col("y")])
    texts = (docs.select(docs[id_col].alias("id"), docs[text_col].alias("t"))
             .where(F.col("t").isNotNull() & (F.octet_length("t") <= FIT_BYTES)))
    one = (texts.join(F.broadcast(drawn), "id").groupBy("id", "y")
           .agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t"))["t"].alias("t")))
    rows = sorted((str(r["id"]), r["y"], r["t"]) for r in one.collect())
    return fit([t for _, _, t in rows], [y for _, y, _ in rows])


def score(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """``(id_col, score, predicted, spans)`` for every row, from the whole text alone.

    Null, empty and wordless texts have no marginals; the layer's intercept scores
    them. Without a model every score is 0. ``spans``: offsets in code points of
    the offending tokens. Repeated rows stay, null ids are kept, other columns are not read; an
    empty table gives no rows.
    """
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def make(texts):
        if model is None:
            return {"score": pa.array([0.0] * len(texts)), "predicted": pa.array([0] * len(texts), pa.int32()),
                    "spans": pa.array([[]] * len(texts), span)}
        values, spans = [], []
        for at in range(0, len(texts), 256):
            part = texts[at:at + 256]
            tagged = model.tag(part)
            values += [model.score(p) for p in tagged]
            spans += [model.spans(t, p) for t, p in zip(part, tagged)]
        return {"score": pa.array(values, pa.float64()),
                "predicted": pa.array([int(v >= threshold) for v in values], pa.int32()),
                "spans": pa.array(spans, span)}

    return map_texts(docs, id_col, text_col, [], f"`{id_col}` {type_of(docs, id_col)}, score double, predicted int, "
                     "spans array<struct<start:int,end:int>>", make)


def keep_clean(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``, all their columns, without a join back."""
    if model is None:
        return docs
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keep = []
            for i in range(0, len(texts), 256):
                keep += [model.score(p) < threshold for p in model.tag(texts[i:i + 256])]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
