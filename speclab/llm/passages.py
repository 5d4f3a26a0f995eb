"""Substring deduplication by paragraph MinHash banding and winnowed word windows.

Three kinds of passages are compared, the first two of at least ``MIN_WORDS`` words. Paragraphs are the lines of a
text: their five-word shingles are MinHashed, ``BANDS`` bands of ``ROWS`` minima find pairs, and
pairs with a Jaccard similarity of 0.8 or more are linked. At 0.8 a pair is found with
probability 1 - (1 - 0.8^3)^10 = 0.9992. A passage may also stand inside a longer line; for that
every sentence start opens a run of sentences, as short as the word count allows, and runs with the
same words are linked. Links are clustered by components; the document with the smallest
id keeps a passage.

The third kind knows no lines or sentences: every ``SPAN`` words in a row that also stand in another
document are found, wherever they begin and however they are wrapped. Each window of ``SPAN`` words
is named by its least ``GRAM``-gram hash; successive windows with one name are one unit. A
name that one document holds alone is done with; where all units of a name are equal, they are
shared whole; only the rest is dealt window by window, so rows never exceed the words.
Words end at Unicode blanks, and each character of scripts written without blanks is a word.

Equal paragraphs are one row before banding. A band's bucket is verified inside a task
and yields a spanning set of links, not its pairs; a bucket of more than ``BLOCK``
different paragraphs is dealt as all pairs of its blocks, so every pair is still seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speclab.llm.common import bounded_batches, cut_lineage, drop_written, type_of
from speclab.llm.components import connected_components

SHINGLE = 5
SPAN, GRAM = 50, 10                  # words of a shared window; words of the gram that names it
SIMILARITY = 0.8
MIN_WORDS = 20
BANDS, ROWS = 10, 3
BLOCK = 512
CHUNK = 1 << 20                      # bytes of text laid out at once
BASE = np.uint64(0x9E3779B97F4A7C15)             # odd, so it has an inverse modulo 2^64
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
UNICODE_BLANKS = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
# Thai and Lao, Myanmar, Khmer, kana and ideographs, compatibility ideographs, wide forms, further planes
UNSPACED = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3001, 0x9FFF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF), (0x20000, 0x3FFFF))
STOPS = np.array([0x61F, 0x6D4, 0x964, 0x2026, 0x3002, 0xFF01, 0xFF0E, 0xFF1F])
CLOSERS = np.array([0xBB, 0x2019, 0x201D])
BLANK_BYTES = np.isin(np.arange(256), [32, *range(9, 14), *range(28, 32)])
STOP_BYTES = np.isin(np.arange(256), list(b".!?"))
CLOSER_BYTES = np.isin(np.arange(256), list(b"\"')]}*")).astype(np.uint8)
LOWER_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}     # a plain table: it travels with the pickled code


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and ``UNBASE`` up to ``n``; kept up to a few chunks' length."""
    size = 1 << max(16, n.bit_length())
    got = POWERS.get(size) or tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, b)])) for b in (BASE, UNBASE))
    if size <= 4 * CHUNK:
        POWERS[size] = got
    return got


def _ranges(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Order-dependent hashes of the ranges [first, end) of a uint64 array."""
    if not len(first):
        return np.zeros(0, np.uint64)
    power, unpower = _powers(len(values))
    total = np.concatenate([[np.uint64(0)], np.cumsum(values * power[:len(values)], dtype=np.uint64)])
    return _mix((total[end] - total[first]) * unpower[first] + (end - first).astype(np.uint64))


def _wide(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, size in bytes and code point of the characters above ASCII."""
    at = np.flatnonzero(raw >= 0xC2)
    b = [raw[np.minimum(at + k, len(raw) - 1)].astype(np.int64) for k in range(4)]
    size = 2 + (b[0] >= 0xE0) + (b[0] >= 0xF0)
    two = (b[0] & 31) << 6 | b[1] & 63
    three = (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63
    four = (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63
    return at, size, np.where(size == 2, two, np.where(size == 3, three, four))


class Layout:
    """Words of several texts laid out in one buffer: places, hashes, sentence and line ends."""

    def __init__(self, texts: list[str]):
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        buf = b"\n".join(coded) + b"\n"
        raw = np.frombuffer(buf, np.uint8)
        blank = BLANK_BYTES[raw]
        solo, head = np.zeros(len(raw), bool), np.zeros(len(raw), bool)   # characters that are words of their own
        stops, closer = STOP_BYTES[raw], CLOSER_BYTES[raw]        # closer: bytes of a closing mark that ends here
        wide, wide_size, code = _wide(raw)
        alone = np.zeros(len(code), bool)
        for low, high in UNSPACED:
            alone |= (code >= low) & (code <= high)
        for k in range(4):
            blank[wide[np.isin(code, UNICODE_BLANKS) & (k < wide_size)] + k] = True
            solo[wide[alone & (k < wide_size)] + k] = True
        head[wide[alone]] = True
        stop = np.isin(code, STOPS)
        stops[(wide + wide_size - 1)[stop]] = True
        close = np.isin(code, CLOSERS)
        closer[(wide + wide_size - 1)[close]] = wide_size[close]
        after_blank, after_solo = np.append(True, blank[:-1]), np.append(False, solo[:-1])
        begins = ~blank & (after_blank | head | after_solo & ~solo)
        self.first, self.end = np.flatnonzero(begins), np.flatnonzero(~after_blank & (blank | begins))
        low = np.frombuffer(buf.translate(LOWER_TABLE), np.uint8).astype(np.uint64) + np.uint64(1)
        self.hash = _ranges(low, self.first, self.end)
        size = np.array([len(c) for c in coded], np.int64)
        self.text_first = np.cumsum(size + 1) - size - 1          # byte at which each text begins
        self.points = np.cumsum((raw & 0xC0) != 0x80) - 1         # code point of each byte
        n = len(self.first)
        line = np.cumsum(raw == 10)[self.first] if n else np.zeros(0, np.int64)
        last = self.end - 1
        new_line = np.concatenate([line[1:] != line[:-1], [True]]) if n else np.zeros(0, bool)
        for _ in range(2):                                        # a stop may stand before closing marks
            last = np.where(last - closer[last] >= self.first, last - closer[last], last)
        stop = stops[last]
        self.line_ends = np.flatnonzero(new_line) + 1             # word index after each line
        self.sentence_ends = np.flatnonzero(new_line | stop) + 1

    def shingles(self) -> np.ndarray:
        """Hash of the shingle that begins at each word (the last few words of the buffer begin none)."""
        n = max(0, len(self.hash) - SHINGLE + 1)
        at = np.arange(n)
        return _ranges(self.hash, at, at + SHINGLE)

    def lines(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        first = np.concatenate([[0], self.line_ends[:-1]]).astype(np.int64)[:len(self.line_ends)]
        keep = self.line_ends - first >= least
        return first[keep], self.line_ends[keep]

    def runs(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Sentence runs: from every sentence start to the first sentence end at least ``least`` words on, inside the line."""
        ends = self.sentence_ends
        first = np.concatenate([[0], ends[:-1]]).astype(np.int64)[:len(ends)]
        at = np.searchsorted(ends, first + least)
        ok = at < len(ends)
        first, at = first[ok], at[ok]
        end = ends[at]
        line_end = self.line_ends[np.searchsorted(self.line_ends, first, side="right")] if len(first) else first
        ok = end <= line_end
        return first[ok], end[ok]

    def units(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(first, end, gram, print)`` of the units: successive windows of ``SPAN`` words, inside one
        text, that have the same least gram. Equal prints: the same words at the same distances."""
        n = len(self.hash) - SPAN + 1
        if n < 1:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
        at = np.arange(n + SPAN - GRAM)
        gram = _ranges(self.hash, at, at + GRAM)
        width, least = 1, at
        while width < SPAN - GRAM + 1:                # the first least gram of ever wider windows
            step = min(width, SPAN - GRAM + 1 - width)
            a, b = least[:-step], least[step:]
            least = np.where(gram[b] < gram[a], b, a)
            width += step
        text = np.searchsorted(self.text_first, self.first, side="right")
        whole = text[:n] == text[SPAN - 1:]
        begin = np.flatnonzero(whole & np.append(True, (least[1:] != least[:-1]) | ~whole[:-1]))
        stop = np.flatnonzero(whole & np.append((least[1:] != least[:-1]) | ~whole[1:], True)) + SPAN
        place = self.points[self.first]
        gap = np.diff(place, append=place[-1:]).astype(np.uint64)
        prints = _mix(_ranges(_mix(self.hash ^ gap * BASE), begin, stop - 1) ^ self.hash[stop - 1])
        return begin, stop, gram[least[begin]], prints

    def places(self, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text index and code point offsets of word ranges."""
        a, b = self.first[first], self.end[end - 1]
        text = np.searchsorted(self.text_first, a, side="right") - 1
        zero = self.points[self.text_first[text]]
        return text, self.points[a] - zero, self.points[b] - zero


def _bands(shingles: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Band keys (ranges, BANDS) of the word ranges' shingle sets."""
    if not len(first):
        return np.zeros((0, BANDS), np.uint64)
    at = np.empty(2 * len(first), np.int64)
    at[0::2], at[1::2] = first, end - SHINGLE + 1
    padded = np.append(shingles, np.uint64(0))        # an end may lie one past the last shingle
    keys = np.empty((len(first), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(first), np.uint64(b + 1))
        for r in range(ROWS):
            seed = _mix(np.array([b * ROWS + r + 1], np.uint64) * BASE)[0]
            key = _mix(key * BASE + np.minimum.reduceat(_mix(padded ^ seed), at)[0::2])
        keys[:, b] = key
    return keys


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[int], list[str], list[int]]]:
    """Texts in chunks of about ``CHUNK`` characters; a longer text is cut at line ends.

    A piece begins ``SPAN - 1`` words before its cut, so no window is lost; last comes where the cut is.
    """
    own, shift, part, cut, size = [], [], [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while t and at < len(t):
            to = len(t) if len(t) - at <= CHUNK else t.find("\n", at + CHUNK)
            to = len(t) if to < 0 else to
            back = max(0, at - CHUNK)
            if at:
                before = t[back:at].rsplit(None, SPAN - 1)
                back += len(before[0]) if len(before) == SPAN else 0
            own.append(i)
            shift.append(back)
            part.append(t[back:to])
            cut.append(at)
            size += to - at
            at = to + 1
            if size >= CHUNK:
                yield own, shift, part, cut
                own, shift, part, cut, size = [], [], [], [], 0
    if part:
        yield own, shift, part, cut


def passages(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """``(id, text_hash, start, end, words, bands, gram)``: every paragraph (with bands), sentence run (neither
    bands nor gram) and unit of windows (with its gram; ``words`` is its print)."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("t"))

    def run(batches):
        for batch in batches:
            yield from _emit(batch, least)

    return slim.mapInArrow(run, f"id {type_of(docs, id_col)}, text_hash long, start int, end int, words long, bands array<long>, gram long")


def _emit(batch, least):
    for own, shift, part, cut in _pieces(batch.column(2).to_pylist()):
        lay = Layout(part)
        own, shift, cut = np.array(own), np.array(shift), np.array(cut)
        shingles = lay.shingles()
        for kind in ("line", "run", "unit"):
            if kind == "unit":
                first, end, gram, words = lay.units()
            else:
                first, end = lay.lines(least) if kind == "line" else lay.runs(least)
                if len(first) and cut.any():              # what lies before the cut was read with the last piece
                    text, start, _ = lay.places(first, end)
                    new = start + shift[text] >= cut[text]
                    first, end = first[new], end[new]
                words = _ranges(lay.hash, first, end)
            if not len(first):
                continue
            text, start, stop = lay.places(first, end)
            rows = pa.array(own[text])
            if kind == "line":
                flat = pa.array(_bands(shingles, first, end).view(np.int64).ravel())
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * BANDS), flat)
            else:
                bands = pa.nulls(len(first), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows),
                 pa.array((start + shift[text]).astype(np.int32)), pa.array((stop + shift[text]).astype(np.int32)),
                 pa.array(words.view(np.int64)), bands,
                 pa.array(gram.view(np.int64)) if kind == "unit" else pa.nulls(len(first), pa.int64())],
                names=["id", "text_hash", "start", "end", "words", "bands", "gram"])


def _windows(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(words, first_id, last_id, window, start, end)``: every window of the wanted units
    ``(words, id, text_hash, start, end, last_id)``, its place counted from the unit's first character."""
    places = wanted.groupBy("id", "text_hash").agg(F.collect_list(F.struct("start", "end", "words", "last_id")).alias("at"))
    d = docs.select(docs[id_col].alias("d_id"), F.xxhash64(docs[text_col]).alias("d_hash"), docs[text_col].alias("t"))
    found = d.join(places, (F.col("d_hash") == F.col("text_hash")) & F.col("d_id").eqNullSafe(F.col("id")))
    # the places travel as arrays of their fields, so Python meets no struct with an id of any type
    found = found.select("t", *[F.col("at")[c].alias(c) for c in ("start", "end", "words")], "id", F.col("at")["last_id"].alias("last_id"))
    kind = type_of(docs, id_col)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                t = batch.column(0)[row].as_py()
                start, end, words = (batch.column(c)[row].values.to_numpy() for c in (1, 2, 3))
                for some in range(0, len(start), 1 << 10):      # units of a long text are laid out some at a time
                    part = slice(some, some + (1 << 10))
                    lay = Layout([t[a:b] for a, b in zip(start[part].tolist(), end[part].tolist())])
                    text = np.searchsorted(lay.text_first, lay.first, side="right") - 1
                    first = np.arange(max(0, len(lay.hash) - SPAN + 1))
                    first = first[text[first] == text[first + SPAN - 1]]
                    unit, a, b = lay.places(first, first + SPAN)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(words[part][unit]), batch.column(4).take(pa.array(np.full(len(first), row))),
                         batch.column(5)[row].values.take(pa.array(unit + some)), pa.array(_ranges(lay.hash, first, first + SPAN).view(np.int64)),
                         pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))],
                        names=["words", "first_id", "last_id", "window", "start", "end"])

    return found.mapInArrow(run, f"words long, first_id {kind}, last_id {kind}, window long, start int, end int")


def _merged(spans):
    """Sorted ranges, overlapping or touching ones merged."""
    return F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] + 1 >= x["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(x))))


def shared_windows(docs: DataFrame, units: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text_hash, first_id, start, end)``: ranges that cover exactly the ``SPAN``-word windows shared with another document."""
    grams = cut_lineage(units.groupBy("gram").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"),
                                                  (F.min("words") != F.max("words")).alias("mixed"))
                        .where("first_id != last_id").select("gram", "first_id", "mixed"))
    near = cut_lineage(units.join(grams, "gram").select("words", "id", "text_hash", "start", "end", "first_id", "mixed"))
    wanted = (near.where("mixed").groupBy("words").agg(F.min(F.struct("id", "text_hash", "start", "end")).alias("at"), F.max("id").alias("last_id"))
              .select("words", "at.*", "last_id"))
    windows = cut_lineage(_windows(docs, wanted, id_col, text_col))
    met = (windows.groupBy("window").agg(F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))
           .where("first_id != last_id").select("window", "first_id"))
    marks = (windows.select("words", "window", "start", "end").join(met, "window").groupBy("words", "first_id")
             .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("at"))
             .select("words", F.col("first_id").alias("f"), _merged("at").alias("at")))
    some = (near.where("mixed").select("words", "id", "text_hash", F.col("start").alias("zero")).join(cut_lineage(marks), "words")
            .select("id", "text_hash", F.col("f").alias("first_id"), "zero", F.explode("at").alias("x"))
            .select("id", "text_hash", "first_id", (F.col("zero") + F.col("x.start")).alias("start"), (F.col("zero") + F.col("x.end")).alias("end")))
    return near.where("not mixed").select("id", "text_hash", "first_id", "start", "end").unionByName(some)


def _similar(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Spanning links among shingle sets (sorted, distinct) with enough Jaccard similarity."""
    size = np.array([len(x) for x in sets])
    flat, names = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, names = flat[order], names[order]
    parent = np.arange(len(sets))
    links = []
    for i in range(len(sets)):
        if (parent == parent[0]).all():
            break                                     # all linked: no pair can add anything
        hit = np.isin(flat, sets[i], assume_unique=False)
        common = np.bincount(names[hit], minlength=len(sets))
        near = np.flatnonzero((common >= similarity * (size + size[i] - common)) & (parent != parent[i]))
        for j in near.tolist():
            if parent[i] != parent[j]:
                links.append((i, j))
                parent[parent == max(parent[i], parent[j])] = min(parent[i], parent[j])
    return links


def _verify(similarity: float):
    """Links of every bucket block; rows arrive sorted by block, a block may span batches."""
    def block(words, sets):
        words = np.array(words)
        keep = np.unique(words, return_index=True)[1]     # a block paired with itself holds rows once
        return [(int(words[keep[i]]), int(words[keep[j]])) for i, j in _similar([sets[k] for k in keep], similarity)] \
            if len(keep) > 1 else []

    def run(batches):
        key, words, sets = None, [], []
        for batch in batches:
            links = []
            for k, w, s in zip(zip(*(batch.column(i).to_pylist() for i in range(3))), batch.column(3).to_pylist(), batch.column(4)):
                if k != key:
                    links += block(words, sets)
                    key, words, sets = k, [], []
                words.append(w)
                sets.append(s.values.to_numpy())
            yield _links(links)
        yield _links(block(words, sets))

    return run


def _links(links):
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())],
                                      names=["a", "b"])


def _shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(words, sh)``: sorted shingle hashes of wanted paragraphs ``(id, text_hash, start, end, words)``."""
    places = wanted.groupBy("id", "text_hash").agg(F.collect_list(F.struct("start", "end", "words")).alias("at"))
    d = docs.select(docs[id_col].alias("d_id"), F.xxhash64(docs[text_col]).alias("d_hash"), docs[text_col].alias("t"))
    found = d.join(places, (F.col("d_hash") == F.col("text_hash")) & F.col("d_id").eqNullSafe(F.col("id"))).select("t", "at")

    def run(batches):
        for batch in batches:
            words, sets = [], []
            for t, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for x in at:
                    words.append(x["words"])
                    sets.append(np.unique(Layout([t[x["start"]:x["end"]]]).shingles()).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["words", "sh"])

    return found.mapInArrow(run, "words long, sh array<long>").dropDuplicates(["words"])


def _colliding(batches):
    """Rows (bucket, words), sorted by bucket, of buckets with two different paragraphs or more."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        bucket = t.column("bucket").to_numpy()
        cut = np.flatnonzero(bucket != bucket[-1])
        cut = int(cut[-1]) + 1 if len(cut) else 0       # the last bucket may go on in the next batch
        if cut:
            yield from _several(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None:
        yield from _several(held)


def _several(t: pa.Table):
    bucket = t.column("bucket").to_numpy()
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.append(first, len(bucket)))
    yield from t.filter(pa.array(np.repeat(size > 1, size))).to_batches()


def paragraph_links(docs: DataFrame, lines: DataFrame, id_col: str, text_col: str, similarity: float, block: int) -> DataFrame:
    """Links ``(a, b)`` between different paragraphs, written; ``lines``: one row a paragraph, with its place and bands."""
    rows = (lines.select("words", F.explode("bands").alias("bucket")).select("bucket", "words")
            .repartition("bucket").sortWithinPartitions("bucket"))
    met = cut_lineage(rows.mapInArrow(_colliding, "bucket long, words long"))
    wanted = lines.join(met.select("words").distinct(), "words", "left_semi").select("id", "text_hash", "start", "end", "words")
    sets = cut_lineage(_shingle_sets(docs, wanted, id_col, text_col))
    large = cut_lineage(met.groupBy("bucket").count().where(F.col("count") > block))
    parts = F.coalesce(F.ceil(F.col("count") / block).cast("int"), F.lit(1))
    dealt = (met.join(large, "bucket", "left").withColumn("parts", parts)
             .withColumn("own", F.pmod(F.xxhash64("words"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("bucket", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "words"))
    ready = dealt.join(sets, "words").select("bucket", "p", "q", "words", "sh")
    ready = ready.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
    links = cut_lineage(ready.mapInArrow(_verify(similarity), "a long, b long").distinct())
    drop_written(met, sets, large)
    return links


def duplicate_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS,
                       similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """``(id_col, text_hash, first_id, removed, n_passages, n_chars, spans)``: documents that share passages with others.

    One row for each text of a document and each document ``first_id`` that holds its passages first (the
    smallest id of the passage's class). Where one id stands on several texts, each has rows of its own, told apart
    by ``text_hash`` (16 hex digits of the text's xxhash64), as offsets belong to one text. ``spans``: merged code point ranges, ``n_chars`` their length;
    ``removed`` is false where the document itself is the first. Windows of ``SPAN`` words are marked where
    they reach beyond the document's shared paragraphs and runs. Shorter wrapped passages, passages under
    ``least`` words, and passages that repeat only inside one document, are left alone, so documents without
    shared passages have no row. Null and empty texts have no passages; null ids are left
    out; rows repeated whole are one document; an empty table gives no rows.
    """
    every = cut_lineage(passages(docs.where(docs[id_col].isNotNull()), id_col, text_col, least))
    lines = cut_lineage(every.where("bands is not null").groupBy("words").agg(
        F.min(F.struct("id", "text_hash", "start", "end")).alias("at"), F.first("bands").alias("bands"),
        F.max("id").alias("last")).select("words", "at.*", "bands", "last"))
    roots = connected_components(paragraph_links(docs, lines, id_col, text_col, similarity, block))
    classes = cut_lineage(lines.select("words", "id", "last").join(roots, F.col("words") == F.col("node"), "left")
                          .select("words", F.coalesce("root", "words").alias("root"), "id", "last"))
    drop_written(lines)          # its places and bands have served
    shared = cut_lineage(classes.groupBy("root").agg(F.min("id").alias("first_id"), F.max("last").alias("last_id"))
                         .where("first_id != last_id"))
    line_of = cut_lineage(classes.join(shared, "root").select("words", "first_id"))
    runs = every.where("bands is null and gram is null")
    run_of = cut_lineage(runs.groupBy("words").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
                         .where("first_id != last_id").select("words", "first_id"))
    hits = cut_lineage(every.where("bands is not null").select("words", "id", "text_hash", "start", "end").join(line_of, "words")
                       .unionByName(runs.select("words", "id", "text_hash", "start", "end").join(run_of, "words")).drop("words"))
    spans = F.array_sort(F.collect_set(F.struct("start", "end")))
    found = cut_lineage(shared_windows(docs, every.where("gram is not null"), id_col, text_col)
                        .groupBy("id", "text_hash", "first_id").agg(spans.alias("at")).select("id", "text_hash", "first_id", _merged("at").alias("at")))
    marked = hits.groupBy("id", "text_hash").agg(spans.alias("marked")).withColumn("marked", _merged("marked"))
    beyond = found.join(marked, ["id", "text_hash"], "left").select("id", "text_hash", "first_id", F.explode(F.when(F.col("marked").isNull(), F.col("at")).otherwise(
        F.filter("at", lambda x: ~F.exists("marked", lambda m: (m["start"] <= x["start"]) & (x["end"] <= m["end"]))))).alias("x"))
    hits = hits.unionByName(beyond.select("id", "text_hash", "first_id", "x.start", "x.end"))
    out = hits.groupBy("id", "text_hash", "first_id").agg(spans.alias("spans")).withColumn("spans", _merged("spans"))
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("text_hash")), 16, "0").alias("text_hash"), "first_id", (F.col("id") != F.col("first_id")).alias("removed"),
                      F.size("spans").alias("n_passages"),
                      F.aggregate("spans", F.lit(0), lambda a, x: a + x["end"] - x["start"]).alias("n_chars"), "spans")
