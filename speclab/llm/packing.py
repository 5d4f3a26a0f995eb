"""Cost-balanced packing of documents into token sequences.

Each document's ids are cut into blocks of a whole sequence and a rest. Whole blocks are sequences of their own and
never move. The rests are dealt into groups of about a thousand sequences; in each, the rests are assigned in descending
order of cost (tokens plus attention over their square) to the lowest-cost sequence with room for them.

A group has just as many sequences as its tokens fill: whole ones, and for what is left over one for each
power of two in it, which needs no padding. Where no sequence has room for a rest, the rest is cut: the
sequence with the most room takes its first part, the other part is assigned anew by its own cost.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speclab.llm.common import bounded_batches, cut_lineage, type_of
from speclab.llm.token_count import byte_alphabet

CAPACITY = 2048
END_ID = 1
ATTENTION = 1.0 / CAPACITY      # cost of one pair of tokens of a piece, in tokens
GROUP_TOKENS = 1 << 21          # tokens a group holds on average
GROUP_ROWS = 1 << 16            # and rests, where they are short
CACHE_WORDS = 1 << 19           # words a worker remembers
LONG_WORD = 64                  # characters; longer words are encoded anew each time
END = "\x00"                    # stands for a word's end; no plain text holds it
BLOCK_CHARS = 1 << 20           # text encoded at once
WIDE = "<u4"


class Encoder:
    """A text's ids, as little-endian unsigned 32-bit integers, as the library gives them.

    In a text of plain Latin letters, digits and ASCII signs the library's steps before the model come to lower-casing
    and one pattern. Each distinct word is merged once, by the file's ranks: a word's end is one more byte whose
    merge with the byte before comes first. Any other text goes through the library itself, block by block: its steps
    never reach across ASCII white space.
    """

    BLANKS = " \t\n\r\x0b\x0c"
    # letters whose lower case is one letter and which normalization leaves alone
    LETTERS = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
    PLAIN = re.compile(f"[!-~{BLANKS}{LETTERS}]*").fullmatch
    WORDS = re.compile(f"[{LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^0-9{BLANKS}{LETTERS}]+").findall
    BLANK = re.compile(f"[{BLANKS}]").search

    def __init__(self, vocabulary: dict):
        self.vocabulary = vocabulary
        self.words = WordIds(vocabulary["ranks"])
        self.library = None

    def _by_library(self, text: str) -> bytes:
        if self.library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer      # reads the switch above
            self.library = Tokenizer.from_str(self.vocabulary["spec"])
            self.library.no_truncation()
            self.library.no_padding()
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str | None) -> bytes:
        text, at, out = text or "", 0, []
        while at < len(text):
            to = at + BLOCK_CHARS
            if to < len(text):
                end = self.BLANK(text, to)
                to = end.start() if end else len(text)
            part = text[at:to]
            if self.PLAIN(part) and not any(s in part for s in self.vocabulary["special"]):
                out += map(self.words.__getitem__, self.WORDS(part.lower()))
            else:
                out.append(self._by_library(part))
            at = to
        return b"".join(out)


class WordIds(dict):
    """Ids of words, made when first asked for; long words are made anew, all are forgotten once there are too many."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merges = tiktoken.Encoding("words", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.merges(word + END)).tobytes()
        if len(word) <= LONG_WORD:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


def read_vocabulary(path: str) -> dict:
    """The file's text, its special strings, its number of ids, and its merges as ranks of byte strings.

    Raises where a step may reach across white space or an id is not its merge's rank.
    """
    with open(path, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    steps = [s["type"] for part in ("normalizer", "pre_tokenizer") for s in
             (spec[part].get("normalizers") or spec[part].get("pretokenizers"))]
    if steps != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] or any(t["lstrip"] or t["rstrip"] or t["single_word"]
                                                                             for t in spec["added_tokens"]):
        raise ValueError(f"a word-splitting vocabulary is expected, not {steps}")
    suffix = spec["model"]["end_of_word_suffix"]
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    ids, special = spec["model"]["vocab"], [t["content"] for t in spec["added_tokens"]]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    made = [ids[a + b] for a, b in pairs]
    if made != sorted(made) or made[0] <= max(ids[c + e] for c in byte_of for e in ("", suffix)):
        raise ValueError("ids in order of their merges, after the single bytes, are expected")

    def raw(token):
        body = token.removesuffix(suffix)
        return bytes(byte_of[c] for c in body) + (END.encode() if body != token else b"")
    ranks = {raw(t): i for t, i in ids.items() if t not in special}
    size = max(max(ids.values()), *(t["id"] for t in spec["added_tokens"])) + 1
    ranks[END.encode()] = size       # never left over: a word's end merges first
    return {"spec": text, "special": special, "size": size, "ranks": ranks}


def assign(lengths: list[int], capacity: int = CAPACITY, attention: float = ATTENTION) -> Iterator[tuple[int, int, int, int, int]]:
    """``(piece, start in it, length, sequence, offset there)`` for pieces of at most ``capacity`` tokens.

    Every sequence is full: ``capacity`` tokens, or a power of two for the tokens left over. A short sequence starts
    at the mean cost of the tokens it lacks, so that it is not taken for an idle one.
    """
    total = sum(lengths)
    left = total % capacity
    size = np.array([capacity] * (total // capacity) + [1 << b for b in range(left.bit_length()) if left >> b & 1], np.int64)
    cost_of = [n + attention * n * n for n in range(capacity + 1)]
    mean = sum(cost_of[n] for n in lengths) / max(total, 1)
    cost = (capacity - size) * mean
    room = size.copy()
    queue = [(-cost_of[n], k, 0, n) for k, n in enumerate(lengths) if n]
    heapq.heapify(queue)
    while queue:
        _, k, start, n = heapq.heappop(queue)
        to = int(np.argmin(np.where(room >= n, cost, np.inf)))
        put = n
        if room[to] < n:
            to = int(np.argmax(room))
            put = int(room[to])
            heapq.heappush(queue, (-cost_of[n - put], k, start + put, n - put))
        yield k, start, put, to, int(size[to] - room[to])
        room[to] -= put
        cost[to] += cost_of[put]


def _blocks(docs: DataFrame, id_col: str, text_col: str, vocab: dict, narrow: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """One row a block: ``(i, start, length, doc_tokens, crc, ids)``; whole blocks carry ids only if asked."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    end = np.array([end_id], WIDE).tobytes()

    def run(batches):
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(shared.value)
            cols = [[] for _ in range(6)]
            for own, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder(text) + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start:4 * (start + capacity)]
                    size = len(part) // 4
                    held = np.frombuffer(part, WIDE).astype(narrow).tobytes() if keep_ids or size < capacity else None
                    for col, v in zip(cols, (own, start, size, n, zlib.crc32(part), held)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:5]),
                 pa.array(cols[5], pa.binary())], names=["i", "start", "length", "doc_tokens", "ids_crc32", "ids"])

    return docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).mapInArrow(
        run, f"i {type_of(docs, id_col)}, start long, length long, doc_tokens long, ids_crc32 long, ids binary")


def _pack_group(narrow: str, capacity: int, attention: float, keep_ids: bool):
    width = np.dtype(narrow).itemsize

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at").combine_chunks()
        ids = rows.column("ids").to_pylist()
        placed = list(assign(rows.column("length").to_pylist(), capacity, attention))
        piece = np.array([p[0] for p in placed], np.int64)
        first = rows.column("start").to_numpy()
        parts = [ids[k][width * s:width * (s + n)] for k, s, n, _, _ in placed]
        crc = [zlib.crc32(np.frombuffer(p, narrow).astype(WIDE).tobytes()) for p in parts]
        return pa.table({
            "i": rows.column("i").take(pa.array(piece)),
            "start": pa.array(first[piece] + np.array([p[1] for p in placed], np.int64)),
            "length": pa.array([p[2] for p in placed], pa.int64()),
            "ids_crc32": pa.array(crc, pa.int64()),
            "doc_tokens": rows.column("doc_tokens").take(pa.array(piece)),
            "sequence_id": pa.array([key[0].as_py() << 32 | p[3] for p in placed], pa.int64()),
            "offset": pa.array([p[4] for p in placed], pa.int64()),
            "ids": pa.array(parts if keep_ids else [None] * len(parts), pa.binary())})

    return run


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, attention: float = ATTENTION, group_tokens: int = GROUP_TOKENS, keep_ids: bool = False) -> DataFrame:
    """``(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, one row a piece; every id of every
    document (its text's ids and ``end_id``) lies in one piece.

    ``keep_ids``: a column ``ids`` follows, the piece's ids as little-endian integers of 16 bits, or 32 where the vocabulary
    needs them. All sequences are full, or of a power of two. Null texts are empty: one ``end_id``. Repeated
    rows and null ids are documents of their own; other columns are not read; an empty table gives no rows.
    ``vocabulary``: path of a word-splitting BPE file, read by the driver and sent once (its size is the vocabulary's).
    """
    vocab = read_vocabulary(vocabulary)
    narrow = "<u2" if vocab["size"] <= 1 << 16 else WIDE
    # the row number in the written table deals the rests evenly whatever they hold, repeated rows too
    blocks = cut_lineage(_blocks(docs, id_col, text_col, vocab, narrow, capacity, end_id, keep_ids)
                         .withColumn("at", F.monotonically_increasing_id()))
    rests = blocks.where(F.col("length") < capacity)
    have = rests.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.count("*").alias("rows")).first()
    groups = 1 + max(have["tokens"] // group_tokens, have["rows"] // GROUP_ROWS)
    names = ["i", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = f"i {type_of(docs, id_col)}, " + ", ".join(f"{c} long" for c in names[1:-1]) + ", ids binary"
    packed = (rests.select(F.pmod(F.xxhash64("at"), F.lit(groups)).alias("pk_group"), "at", "i", "start", "length", "doc_tokens", "ids")
              .groupBy("pk_group").applyInArrow(_pack_group(narrow, capacity, attention, keep_ids), schema))
    whole = blocks.where(F.col("length") == capacity).select(
        "i", "start", "length", "ids_crc32", "doc_tokens", (F.lit(1 << 62) + F.col("at")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), "ids")
    out = whole.unionByName(packed).withColumnRenamed("i", id_col)
    return out if keep_ids else out.drop("ids")
