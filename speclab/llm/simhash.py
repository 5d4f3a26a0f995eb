"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance at most 2r share a point within r of both. Every
distinct fingerprint therefore emits all variants within ``r`` bits, variants are
shuffled, and fingerprints meeting in one variant are linked.

Variants travel compressed: all variants of one fingerprint that share their
leading ``b`` bits are one row (prefix, fingerprint), expanded after the shuffle on
the prefix. That moves 1 + b + b(b-1)/2 short rows per fingerprint instead of 2,081.
A prefix holding too many rows is dealt again on four more bits until it fits,
up to whole variants, so no group is unbounded.

Two members of one variant are at most 2r bits apart by the triangle inequality;
the task still verifies the distance of the links it keeps when the radius is odd
(then a middle point may join a pair one bit too far apart). Inside a task only a
spanning set of links leaves: one row (fingerprint, local root) per member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speclab.llm.common import cut_lineage, map_texts, type_of
from speclab.llm.components import connected_components

BITS = 64
SEED = 42
LOWER_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BLOCK_SHINGLES = 1 << 16      # shingles voted at once: bounds memory on very long texts
GROUP_VARIANTS = 1 << 20      # variants a prefix group holds on average
BLOCK_VARIANTS = 1 << 21      # variants a task holds at once
GROUP_ROWS = 1 << 18          # rows of a prefix group before it is dealt on more bits
DEAL_BITS = 4
SLOTS = 1 << 21               # bits that tell rows that may go from rows that stay


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of one text (null and wordless texts: zero)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split()
    if not words:
        return 0
    k = min(shingle, len(words))
    n = len(words) - k + 1
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:n].tolist()
    ends = ends[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK_SHINGLES):
        h = np.array([digest(joined[s:e], SEED) for s, e in
                      zip(starts[at:at + BLOCK_SHINGLES], ends[at:at + BLOCK_SHINGLES])], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * votes > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                 more: list[str] | None = None) -> DataFrame:
    """``(id_col, *more, fp)`` per document; ``fp`` holds the 64 bits as a long."""
    def make(texts):
        fp = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
        return {"fp": pa.array(fp.view(np.int64))}
    schema = ", ".join(f"`{c}` {type_of(docs, c)}" for c in (id_col, *(more or [])))
    return map_texts(docs, id_col, text_col, more or [], f"{schema}, fp long", make)


def _masks(width: int, flips: int) -> np.ndarray:
    """All words of ``width`` low bits with at most ``flips`` bits set."""
    return np.array([sum(1 << i for i in c) for f in range(min(flips, width) + 1)
                     for c in combinations(range(width), f)], np.uint64)


def _expand(fps: np.ndarray, own: np.ndarray, prefix: int, bits: int, half: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (variant, owner) of all variants within ``half`` bits that start with ``prefix``."""
    low = BITS - bits
    top = (fps >> np.uint64(low)) if low else fps
    used = np.bitwise_count(top ^ np.uint64(prefix)).astype(int)
    near = used <= half
    fps, own, used = fps[near], own[near], used[near]
    if len(fps) < 2:
        return
    total = sum(math.comb(low, f) * int((used + f <= half).sum()) for f in range(half + 1) if f <= low)
    if total > BLOCK_VARIANTS and low:
        step = min(DEAL_BITS, low)
        for child in range(1 << step):
            yield from _expand(fps, own, (prefix << step) | child, bits + step, half)
        return
    base = np.uint64(prefix << low) | (fps & np.uint64((1 << low) - 1)) if bits else fps
    variants, owners = [], []
    for spent in range(half + 1):
        sel = used == spent
        if sel.any():
            m = _masks(low, half - spent)
            variants.append((base[sel][:, None] ^ m[None, :]).ravel())
            owners.append(np.repeat(own[sel], len(m)))
    yield np.concatenate(variants), np.concatenate(owners)


def _link(parent: np.ndarray, variants: np.ndarray, owners: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Join the owners of equal variants; ``parent`` points every member at its root."""
    s = np.sort(variants)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return parent
    flag = np.zeros(1 << 20, bool)       # cheap screen before the exact lookup
    flag[twice & np.uint64((1 << 20) - 1)] = True
    maybe = flag[variants & np.uint64((1 << 20) - 1)]
    variants, owners = variants[maybe], owners[maybe]
    at = np.minimum(np.searchsorted(twice, variants), len(twice) - 1)
    hit = twice[at] == variants
    bucket, owners = at[hit], owners[hit]
    if radius % 2:
        # an odd radius: members of one variant may be radius + 1 apart; keep verified links only
        order = np.lexsort((owners, bucket))
        bucket, owners = bucket[order], owners[order]
        left, right = [], []
        step = 1
        while step < len(bucket):
            same = bucket[step:] == bucket[:-step]
            if not same.any():
                break
            i, j = owners[:-step][same], owners[step:][same]
            ok = np.bitwise_count(fps[i] ^ fps[j]) <= radius
            left.append(i[ok])
            right.append(j[ok])
            step += 1
        i, j = np.concatenate(left), np.concatenate(right)
        bucket = np.tile(np.arange(len(i)), 2)
        owners = np.concatenate([i, j])
        n_buckets = len(i)
    else:
        n_buckets = len(twice)
    while True:
        roots = parent[owners]
        least = np.full(n_buckets, len(parent), np.int64)
        np.minimum.at(least, bucket, roots)
        to = np.arange(len(parent))
        np.minimum.at(to, roots, least[bucket])
        if (to[parent] == parent).all():
            return parent
        while True:
            jump = to[to]
            if (jump == to).all():
                break
            to = jump
        parent = to[parent]


def local_links(fps: np.ndarray, prefix: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (member, root) among the distinct ``fps`` that share variants under ``prefix``."""
    parent = np.arange(len(fps))
    for variants, owners in _expand(fps, np.arange(len(fps)), prefix, bits, (radius + 1) // 2):
        parent = _link(parent, variants, owners, fps, radius)
    moved = parent != np.arange(len(fps))
    return fps[moved], fps[parent[moved]]


def _deal(rows: DataFrame, fp, prefix, bits: int, step: int, half: int) -> DataFrame:
    """Rows (prefix, fp) for the prefixes of ``bits + step`` bits under each row's prefix."""
    masks = F.array(*[F.lit(int(m)) for m in _masks(step, half)])
    own = F.shiftrightunsigned(fp, BITS - bits - step)
    low = F.lit((1 << step) - 1).cast("long")
    child = F.shiftleft(prefix, step).bitwiseOR(own.bitwiseAND(low)) if bits else own
    out = rows.select(F.explode(masks).alias("mask"), child.alias("child"), own.alias("own"), fp.alias("fp"))
    out = out.select(F.col("child").bitwiseXOR(F.col("mask")).alias("prefix"), "own", "fp")
    return out.where(F.bit_count(F.col("prefix").bitwiseXOR(F.col("own"))) <= half).select("prefix", "fp")


def fingerprint_links(fps: DataFrame, n: int, radius: int = 4, group_rows: int = GROUP_ROWS,
                      first_bits: int | None = None) -> DataFrame:
    """Spanning links ``(a, b)`` among distinct fingerprints ``fp``: same components as all
    pairs at distance at most ``radius``. ``n``: number of fingerprints, picks the prefix length."""
    half = (radius + 1) // 2
    ball = sum(math.comb(BITS, f) for f in range(half + 1))
    bits = first_bits or min(40, max(8, math.ceil(math.log2(max(1, n) * ball / GROUP_VARIANTS + 1))))
    rows = _deal(fps, F.col("fp"), F.lit(0), 0, bits, half)
    links = None
    while True:
        size = cut_lineage(rows.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > group_rows))
        last = bits >= BITS or size.isEmpty()
        now = rows if last and bits < BITS else rows.join(size, "prefix", "left_anti")
        links_now = now.groupBy("prefix").applyInArrow(_group(bits, radius), "a long, b long")
        links = links_now if links is None else links.unionByName(links_now)
        if last:
            break
        big = cut_lineage(rows.join(size.select("prefix"), "prefix", "left_semi"))
        step = min(DEAL_BITS, BITS - bits)
        rows = _deal(big, F.col("fp"), F.col("prefix"), bits, step, half)
        bits += step
    if bits >= BITS and radius % 2 == 0:
        # whole variants with more members than a task takes: a star on the smallest member
        star = rows.join(size.select("prefix"), "prefix", "left_semi")
        root = star.groupBy("prefix").agg(F.min("fp").alias("b"))
        links = links.unionByName(star.join(root, "prefix").select(F.col("fp").alias("a"), "b"))
    return links.where("a != b").distinct()


def _group(bits: int, radius: int):
    def run(key, group):
        fps = np.unique(group.column("fp").to_numpy()).view(np.uint64)
        a, b = local_links(fps, int(np.int64(key[0].as_py()).view(np.uint64)), bits, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    radius: int = 4, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` for every row of ``docs``.

    ``fingerprint``: 16 lowercase hex digits. ``component_id``: smallest id reachable over
    links of at most ``radius`` differing bits, the row's own included. Null, empty
    and wordless texts have fingerprint zero and are linked like any other; a text with
    fewer words than ``shingle`` is one shingle. Repeated rows keep their multiplicity;
    null ids never become a component id unless every member's id is null. An
    empty input gives an empty result; other columns are not read.
    """
    own = cut_lineage(fingerprints(docs, id_col, text_col, shingle).withColumnRenamed(id_col, "id"))
    fps = cut_lineage(own.groupBy("fp").agg(F.min("id").alias("first")))
    links = fingerprint_links(fps, fps.count(), radius, group_rows)
    roots = connected_components(links)
    member = cut_lineage(fps.join(roots, fps.fp == roots.node, "left")
                         .select("fp", F.coalesce("root", "fp").alias("root"), "first"))
    least = cut_lineage(member.groupBy("root").agg(F.min("first").alias("component_id")))
    by_fp = cut_lineage(member.join(least, "root").select("fp", "component_id"))
    return own.join(by_fp, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """The first row of each near-duplicate group of ``docs``, all its columns.

    First is the smallest id, null ids last, then the smallest text hash; so an id that stands on several
    texts keeps each one that is first in its group. Rows with equal id and text are reduced to one.
    """
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t"), F.xxhash64(docs[text_col]).alias("text_hash"))
    own = cut_lineage(fingerprints(slim, "id", "t", shingle, ["text_hash"]))
    fps = cut_lineage(own.select("fp").distinct())
    roots = connected_components(fingerprint_links(fps, fps.count(), radius))
    rows = cut_lineage(own.join(roots, own.fp == roots.node, "left").groupBy("id", "text_hash")
                       .agg(F.first(F.coalesce("root", "fp")).alias("root"), F.count("*").alias("n")))
    first = cut_lineage(rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("at"))
                        .select("at.id", "at.text_hash"))
    gone = cut_lineage(_beside(rows, first, rows["id"], rows["text_hash"], "left_anti").select("id", "text_hash"))
    # only rows whose key may go, or stands more than once, are shuffled with their texts; the others stay where they are
    marked = _slots(gone.unionByName(rows.where("n > 1").select("id", "text_hash")))
    own_id, own_hash = docs[id_col], F.xxhash64(docs[text_col])
    hit = _in_slots(marked, own_id, own_hash)
    maybe = docs.where(hit)
    rest = _beside(maybe, gone.hint("merge"), maybe[id_col], F.xxhash64(maybe[text_col]), "left_anti").dropDuplicates([id_col, text_col])
    return docs.where(~hit).unionByName(rest)


def _slot(own_id, own_hash):
    return F.pmod(F.xxhash64(own_id, own_hash), F.lit(SLOTS))


def _bit(slot):
    return F.call_function("shiftleft", F.lit(1), slot % 8)


def _slots(keys: DataFrame) -> bytes:
    """A bit for each slot that a key ``(id, text_hash)`` falls into; at most ``SLOTS / 8`` rows reach the driver."""
    slot = _slot(F.col("id"), F.col("text_hash"))
    found = keys.select(slot.alias("s")).groupBy(F.shiftright("s", 3).alias("byte")).agg(
        F.bit_or(_bit(F.col("s").cast("int"))).alias("bits")).toPandas()
    out = np.zeros(SLOTS // 8, np.uint8)
    out[found["byte"].to_numpy(np.int64)] = found["bits"].to_numpy(np.uint8)
    return out.tobytes()


def _in_slots(marked: bytes, own_id, own_hash):
    """Whether a row's slot is marked: true for every key that went into ``marked``, and for few others while it is sparse."""
    slot = _slot(own_id, own_hash).cast("int")
    byte = F.conv(F.hex(F.substring(F.lit(marked), F.shiftright(slot, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(_bit(slot)) != 0


def _beside(rows: DataFrame, keys: DataFrame, own_id, own_hash, how: str) -> DataFrame:
    """Rows with (``left_semi``) or without (``left_anti``) a key ``(id, text_hash)``; null ids are equal."""
    keys = keys.select(F.col("id").alias("sh_id"), F.col("text_hash").alias("sh_hash"))
    return rows.join(keys, own_id.eqNullSafe(F.col("sh_id")) & (own_hash == F.col("sh_hash")), how)
