"""Byte-level BPE token counts by rank-synchronous array merging.

A batch's distinct pre-tokens are one ragged symbol array. In each round every
unfinished sequence applies its lowest-rank pair, at all its places at once (left to
right where places overlap); ranks are looked up anew only beside a merge. A
sequence without a ranked pair is done: its surviving symbols are its tokens.

A merge's parts are made by lower ranks than its own, so applying all places of the
lowest rank before looking again gives the same symbols as merging one by one.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

from speclab.llm.common import map_texts, type_of

NONE = np.int64(1) << 40         # rank of a pair without a merge
CHUNK_CHARS = 1 << 20            # text looked at once inside a batch
CACHE_WORDS = 1 << 19            # pre-token counts a worker remembers


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 is itself, the rest follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in printable]
    chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [chars[b] for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """Arrays of a byte-level BPE file: sorted pair keys, their ranks and results; size fixed by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = spec["model"]["vocab"]
    if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("a byte-level vocabulary without normalizer or prefix space is expected")
    special = []
    for t in spec["added_tokens"]:
        if t["single_word"] or t["lstrip"] or t["rstrip"]:
            raise ValueError(f"added token with strip flags: {t['content']}")
        special.append(t["content"])
    size = max(ids.values()) + 1
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    left = np.array([ids[a] for a, _ in pairs], np.int64)
    right = np.array([ids[b] for _, b in pairs], np.int64)
    made = np.array([ids[a + b] for a, b in pairs], np.int64)
    key = left * size + right
    order = np.argsort(key)
    return {"size": size, "key": key[order], "rank": order.astype(np.int64), "made": made[order],
            "byte": np.array([ids[c] for c in byte_alphabet()], np.int64),
            "special": sorted(special, key=len, reverse=True)}


def odd_characters(pattern: str) -> frozenset[str]:
    """Characters that the file's library and ``regex`` put into different classes (letter, number, blank, other).

    The two know different Unicode versions. Characters of one class are tried together: the library
    splits them unless it agrees, and only such a block is tried one by one.
    """
    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    classes = {lead: regex.findall(kind, every) for lead, kind in (("a", r"\p{L}"), ("1", r"\p{N}"), ("!", r"[^\s\p{L}\p{N}]"))}
    odd = {c for c in regex.findall(r"\s", every) if any(len(split(lead + c + lead)) != 3 for lead in classes)}
    for lead, chars in classes.items():
        for i in range(0, len(chars), 1024):
            block = chars[i:i + 1024]
            if len(split(lead + "".join(block))) > 1:
                odd.update(c for c in block if len(split(lead + c)) > 1)
    return frozenset(odd)


def _ranks(vocab: dict, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and merged symbol of each pair (rank NONE where the pair has no merge)."""
    key = left * vocab["size"] + right
    at = np.minimum(np.searchsorted(vocab["key"], key), len(vocab["key"]) - 1)
    found = vocab["key"][at] == key
    return np.where(found, vocab["rank"][at], NONE), vocab["made"][at]


def count_symbols(words: list[bytes], vocab: dict) -> np.ndarray:
    """Surviving symbols of each byte string after all merges."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    live = np.flatnonzero(counts > 1)
    if not len(live):
        return counts
    size = counts[live]
    sym = vocab["byte"][np.frombuffer(b"".join(words[i] for i in live.tolist()), np.uint8)]
    last = np.cumsum(size) - 1                    # each sequence's last symbol has no pair
    rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
    rank[:-1], made[:-1] = _ranks(vocab, sym[:-1], sym[1:])
    rank[last] = NONE
    while len(live):
        first = last - size + 1
        lowest = np.minimum.reduceat(rank, first)
        going = lowest < NONE
        if not going.all():
            counts[live[~going]] = size[~going]
            keep = np.repeat(going, size)
            sym, rank, made = sym[keep], rank[keep], made[keep]
            live, size, lowest = live[going], size[going], lowest[going]
            if not len(live):
                break
            last = np.cumsum(size) - 1
        at = np.flatnonzero(rank == np.repeat(lowest, size))
        # overlapping places (a a a): take every second of a run, from its left end
        run = np.concatenate(([True], np.diff(at) != 1))
        start = at[run][np.cumsum(run) - 1]
        at = at[(at - start) % 2 == 0]
        sym[at] = made[at]
        gone = np.zeros(len(sym), bool)
        gone[at + 1] = True
        owner = np.searchsorted(last, at)
        np.subtract.at(size, owner, 1)
        ends = np.zeros(len(sym), bool)
        ends[last] = True
        ends[at] |= ends[at + 1]
        # the symbol before a merge pairs with the new one; the new one with its successor
        dirty = np.zeros(len(sym), bool)
        dirty[at] = True
        keep = ~gone
        sym, rank, made, ends, dirty = sym[keep], rank[keep], made[keep], ends[keep], dirty[keep]
        dirty[:-1] |= dirty[1:]
        again = np.flatnonzero(dirty)
        inner = again[~ends[again]]
        rank[again] = NONE
        rank[inner], made[inner] = _ranks(vocab, sym[inner], sym[inner + 1])
        last = np.cumsum(size) - 1
    return counts


class TokenCounter:
    """Counts tokens of texts; remembers a bounded number of pre-tokens and space-led chunks.

    No pre-token crosses a single space between two non-blanks (a space only leads
    a pre-token), so a text is cut there first and each distinct chunk is split
    by the pattern once; chunks with a character of ``odd`` are split by the library's own rule.
    """

    BLANKS = re.compile(r" \s|\s ").search
    CUT = re.compile(r"(?<=\S) (?=\S)").split

    def __init__(self, vocab: dict, pattern: str, odd: frozenset[str] = frozenset()):
        self.vocab, self.words, self.chunks, self.odd = vocab, {}, {}, odd
        self.pattern = regex.compile(pattern).findall
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        self.special = regex.compile("|".join(map(regex.escape, vocab["special"]))) if vocab["special"] else None

    def __call__(self, texts: list[str | None]) -> list[int]:
        out, at = [], 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to] or "") <= CHUNK_CHARS):
                chars += len(texts[to] or "")
                to += 1
            out += self._count([t or "" for t in texts[at:to]])
            at = to
        return out

    def pre_tokens(self, text: str) -> list[str]:
        if text.isascii() or self.odd.isdisjoint(text):
            return self.pattern(text)
        return [text[a:b] for _, (a, b) in self.library(text)]

    def _cut(self, text: str) -> list[str]:
        return self.CUT(text) if self.BLANKS(text) else text.split(" ")

    def _count(self, texts: list[str]) -> list[int]:
        heads, tails, extra = [], [], []      # chunks before and after a text's first cut; special strings
        for t in texts:
            parts = self.special.split(t) if self.special and self.special.search(t) else [t]
            extra.append(len(parts) - 1)
            cut = [self._cut(p) for p in parts]
            heads.append([c[0] for c in cut])
            tails.append(cut[0][1:] if len(cut) == 1 else [w for c in cut for w in c[1:]])
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        if len(self.chunks) > CACHE_WORDS:
            self.chunks = {}
        new = list(set().union(*tails).difference(self.chunks))
        split = [self.pre_tokens(" " + c) for c in new]
        first = [[w for h in hs for w in self.pre_tokens(h)] for hs in heads]
        missing = list(set().union(*split, *first).difference(self.words))
        self.words.update(zip(missing, count_symbols([w.encode() for w in missing], self.vocab).tolist()))
        word, chunk = self.words.__getitem__, self.chunks.__getitem__
        self.chunks.update((c, sum(map(word, ws))) for c, ws in zip(new, split))
        return [sum(map(word, f)) + sum(map(chunk, t)) + n for f, t, n in zip(first, tails, extra)]


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 1024) -> DataFrame:
    """``(id_col, n_bytes, n_tokens, over_limit)`` for every row.

    ``vocabulary``: path of a byte-level BPE JSON file, read by the driver and sent
    once (its size is the vocabulary's). Null counts as the empty text (0, 0,
    false). Special strings inside a text are one token each, as the file's library
    has it. Whole texts, no truncation; repeated rows, null ids and extra
    columns are fine; an empty table gives no rows.
    """
    arrays = docs.sparkSession.sparkContext.broadcast((load_vocabulary(vocabulary), odd_characters(pattern)))

    counter: list[TokenCounter] = []

    def make(texts):
        if not counter:
            vocab, odd = arrays.value
            counter.append(TokenCounter(vocab, pattern, odd))
        tokens = pa.array(counter[0](texts), pa.int64())
        return {"n_bytes": pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                "n_tokens": tokens,
                "over_limit": pa.array([n > limit for n in tokens.to_pylist()], pa.bool_())}

    return map_texts(docs, id_col, text_col, [],
                     f"`{id_col}` {type_of(docs, id_col)}, n_bytes long, n_tokens long, over_limit boolean", make)
