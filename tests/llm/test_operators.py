"""Edge cases and brute-force checks of the training-data operators on small frames."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from speclab.llm import (components, decontaminate, html_text, language, mixing, passages, sharding, simhash, token_count,
                         topk, toxicity)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(3)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.12 else "") for _ in range(n))


def frame(spark, texts, **cols):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " \n\t ", "x", "x", "héllo wörld ☃ <|endoftext|> tail", prose(4000, 1), prose(4000, 1), "  a  \n b", "1234 %% 'll"]


def messy(spark):
    """Odd texts, a null id, a repeated row and columns named like the operators' own."""
    d = frame(spark, ODD)
    d = d.unionByName(spark.createDataFrame([(None, "null id", None, None, None), (3, "x", "en", "s", 1)], SCHEMA))
    for c in ("id", "t", "k0", "size", "score", "shard", "words", "rank", "mix_note", "a", "b"):
        d = d.withColumn(c, F.lit("clash"))
    return d


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- token counts

def test_tokens_match_the_library(spark):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    r = random.Random(7)
    texts = ODD + ["".join(r.choice(["é", "ß", " ", "  ", "\n", "a", "the", " The", "'ll", "9", "漢字", "🥕", "\t", "aaaa", "<|endoftext|>",
                                      " ", "!?", "x" * 50]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    got = {r["doc_id"]: r for r in token_count.count_tokens(frame(spark, texts), path, public_tokenizers.PATTERN).collect()}
    want = lib.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for i, t in enumerate(texts):
        assert got[i]["n_tokens"] == len(want[i].ids), t
        assert got[i]["n_bytes"] == len((t or "").encode())
        assert got[i]["over_limit"] == (len(want[i].ids) > 1024)


def test_tokens_of_characters_the_pattern_engines_class_differently():
    """Unassigned or newer code points: the library's own rule splits them."""
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = token_count.odd_characters(public_tokenizers.PATTERN)
    r, chars = random.Random(5), sorted(odd)
    texts = ["".join(r.choice([r.choice(chars), chr(r.choice([r.randrange(32, 0xD800), r.randrange(0xE000, 0x110000)])), " ", "\n", "a", "'s", "1",
                               "\x1c", "\x85", "\u180e", "\u3000", "<|endoftext|>"]) for _ in range(r.randrange(1, 40))) for _ in range(2000)]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    vocab = token_count.load_vocabulary(path)
    assert token_count.TokenCounter(vocab, public_tokenizers.PATTERN, odd)(texts) == want
    if odd:
        assert token_count.TokenCounter(vocab, public_tokenizers.PATTERN)(texts) != want


def test_tokens_edges(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_count.count_tokens(messy(spark), path, public_tokenizers.PATTERN).count() == len(ODD) + 2
    assert token_count.count_tokens(empty(spark), path, public_tokenizers.PATTERN).count() == 0


# ---- top-k

def brute_topk(rows, k=5):
    v = [(i, [int(np.floor(256 * float(x))) for x in e]) for i, e in rows
         if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, a in v:
        if i % 50 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in v if j != i)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("case", ["clusters", "copies", "odd", "few", "large"])
def test_topk(spark, case):
    g = np.random.default_rng(1)
    if case == "clusters":
        c = g.normal(0, 1, (6, 8))
        rows = [(i, (c[i % 6] + g.normal(0, 0.1, 8)).tolist()) for i in range(400)]
    elif case == "copies":
        rows = [(i, [0.5, -0.25, 1.0] if i % 3 else g.normal(0, 1, 3).tolist()) for i in range(300)]
    elif case == "odd":
        rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (50, [0.1, 0.2, 0.3]),
                (51, []), (52, [0.0, 0.0]), (None, [1.0, 1.0]), (53, [-1.0, -2.0])]
    elif case == "few":
        rows = [(0, [1.0]), (1, [2.0])]
    else:
        rows = [(i, (g.normal(0, 1, 4) * 3e5).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("id", F.lit(2))
    got = topk.top_k(df, block_rows=64, group_rows=2, seed_rows=32, pivots=5).collect()
    assert sorted(map(tuple, got)) == brute_topk(rows)


def test_topk_scores_a_group_together(monkeypatch):
    """Each query of a group scored its own small steps of a block: time per query and step, not per number."""
    rng = np.random.default_rng(4)
    v, k = rng.integers(-9, 10, (1200, 6)), 5
    v[700:760] = v[0]
    ids, q = rng.permutation(1200), rng.permutation(1200)[:40]
    space = topk.Space(6, float((v * v).sum(1).max()), ids[:64], v[:64], 8, k)
    calls, score = [], topk.Space.scores
    first = space.first_thresholds(ids[q], v[q])
    monkeypatch.setattr(topk.Space, "scores", lambda self, a, b: calls.append(a.shape[0] * b.shape[0]) or score(self, a, b))
    got = sorted(zip(*(x.tolist() for x in topk._best(space, ids[q], v[q], space.table(v[q], True), ids, v, first, k))))
    want = []
    for i in q:
        s = v @ v[i]
        want += [(ids[i], ids[j], s[j]) for j in np.lexsort((ids, -s)) if j != i][:k]
    assert got == sorted(want)
    assert len(calls) <= -(-1200 // topk.STEP) and sum(calls) <= 40 * 1200


def test_topk_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---- simhash

def brute_fingerprint(text, k=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    comp = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius and comp[i] != comp[j]:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return comp


def test_simhash_documents(spark):
    texts = ODD + [prose(60, s) for s in range(40)] + [prose(400, s // 4) + " " + prose(3 * (s % 4), 99 + s) for s in range(60)]
    fps = [brute_fingerprint(t) for t in texts]
    comp = brute_components(fps, 4)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i]["component_id"] for i in range(len(texts))] == comp
    assert len(set(comp)) < len(set(fps))          # near copies were linked, not only equal ones


@pytest.mark.parametrize("radius,first_bits,group_rows", [(4, None, 1 << 18), (4, 8, 12), (4, 60, 3), (3, 8, 40), (2, 8, 40), (0, 8, 40)])
def test_links_match_all_pairs(spark, radius, first_bits, group_rows):
    """Chains of close fingerprints, ends of the word, and groups forced onto more bits."""
    r = random.Random(radius)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(9):
            fps.add(x)
            for b in r.sample(range(64), r.randint(1, 6)):
                x ^= 1 << b
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    links = simhash.fingerprint_links(df, len(fps), radius, group_rows, first_bits).collect()
    at = {int(np.uint64(f).view(np.int64)): i for i, f in enumerate(fps)}
    comp = list(range(len(fps)))
    for link in links:
        a, b = comp[at[link["a"]]], comp[at[link["b"]]]
        comp = [min(a, b) if c in (a, b) else c for c in comp]
    assert comp == brute_components(fps, radius)


def test_simhash_edges(spark):
    got = simhash.near_duplicates(messy(spark)).collect()
    assert len(got) == len(ODD) + 2
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_first(messy(spark))
    assert kept.columns == messy(spark).columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id in (0, 1, 2, 3, 4)").collect()) == [0, 3]
    twice = spark.createDataFrame([(1, prose(50, 1), "en", "s", 1), (2, prose(50, 1), "en", "s", 1), (2, prose(50, 2), "en", "s", 1)], SCHEMA)
    assert sorted(r["doc_id"] for r in simhash.keep_first(twice).collect()) == [1, 2]     # an id that is first once stays, once


def test_keep_first_goes_by_rows(spark):
    """Every group keeps one row, its least by id (null last) and text hash, whatever the order of the rows."""
    a, b, c, d, e, f = (prose(50, 8000 + s) for s in range(6))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (None, a), (None, e), (None, e), (None, f), (4, f), (3, d), (5, None), (None, "")]
    rows = [(i, t, "en", "s", 1) for i, t in rows]
    want = {(1, a), (2, b), (3, c), (3, d), (None, e), (4, f), (5, None)}
    for order in (rows, rows[::-1]):
        got = simhash.keep_first(spark.createDataFrame(order, SCHEMA).repartition(3, "text")).collect()
        assert {(r["doc_id"], r["text"]) for r in got} == want and len(got) == len(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 130)} == {100} and got[201] == 200
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- sharding

@pytest.mark.parametrize("limit", [200, 5000, 1 << 30])
def test_shards_fit(spark, limit):
    docs = messy(spark).drop("shard").unionByName(frame(spark, [prose(n % 90, n) for n in range(300)]), allowMissingColumns=True)
    docs = docs.unionByName(spark.createDataFrame([(9999, "copy " * 20, "en", "s", 1)] * 30, SCHEMA), allowMissingColumns=True)
    out = sharding.shard(docs, limit=limit)
    assert out.columns[:5] == docs.columns[:5] and out.count() == docs.count()
    by = out.groupBy("shard", "shard_bytes", "shard_rows").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).collect()
    assert len(by) == len({r["shard"] for r in by})
    for r in by:
        assert r["n"] == r["shard_rows"] and r["b"] == r["shard_bytes"]
        assert r["b"] <= limit or r["n"] == 1
    if limit == 1 << 30:
        assert [r["shard"] for r in by] == ["s"]
    names = {r["shard"].split("+")[0] for r in by}
    assert not any(a != b and b.startswith(a) for a in names for b in names)      # no shard inside another


def test_sharding_empty(spark):
    assert sharding.shard(empty(spark)).count() == 0


# ---- language

def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    crc = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    net = language.train(docs.where(~crc))
    got = language.identify(docs.where(crc), net).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) >= 0.9
    odd = {r["doc_id"]: r for r in language.identify(messy(spark), net).collect()}
    assert len(odd) == len(ODD) + 1 and odd[0]["lang_pred"] == odd[1]["lang_pred"] == odd[2]["lang_pred"] == "und"
    assert odd[0]["score"] == 0 and 0 < odd[6]["score"] <= 1
    assert zlib.crc32(b"0") % 4 == (2 if docs.where(crc & (F.col("doc_id") == 0)).count() else zlib.crc32(b"0") % 4)


def test_language_without_labels(spark):
    assert language.train(empty(spark)) is None
    assert language.train(frame(spark, ["abc", None]).withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r["lang_pred"] for r in language.identify(messy(spark), None).collect()} == {"und"}
    assert language.identify(empty(spark), None).count() == 0


def test_language_windows_cover_the_text():
    data = bytes(range(1, 256)) * 5
    w = language.windows_of(data)
    assert b"".join(x[:language.WINDOW].tobytes() for x in w).rstrip(b"\0") == data
    assert len(language.windows_of(b"")) == 1


# ---- mixing

def brute_targets(sizes, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        w = sum(weight[s] for s in rest)
        if not w:
            return full
        level = (total - sum(full.values())) / w
        over = [s for s in rest if cap * sizes[s] <= level * weight[s]]
        if not over:
            return full | {s: level * weight[s] for s in rest}
        full |= {s: cap * sizes[s] for s in over}


def test_mixing(spark):
    r = random.Random(2)
    rows = [(i, prose(r.randint(0, 60), i) if i % 9 else None, None, r.choice(["big"] * 12 + ["a", "b", "é", "Z", None, "tiny"]), 0)
            for i in range(900)] + [(5000, "word", None, "one", 0), (5001, "", None, "none", 0)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    again = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    source = {i: s for i, _, _, s, _ in rows}
    taken = {}
    for x in got:
        s = source[x["doc_id"]]
        assert x["source_size"] == sizes[s] and x["target"] == pytest.approx(want[s])
        assert x["taken"] <= 3 * x["size"] and (not x["size"] or x["taken"] % x["size"] == 0)
        taken[s] = taken.get(s, 0) + x["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 61          # within one document


def test_mixing_edges(spark):
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(messy(spark)).count() == len(ODD) + 2
    d = messy(spark)
    mixed = mixing.mixed_documents(d)
    assert mixed.columns == d.columns
    copies = mixed.groupBy("doc_id").count().collect()
    assert all(r["count"] <= 6 for r in copies)


# ---- passages

def brute_shingles(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def test_passages_against_all_pairs(spark):
    """Near copies of lines are found exactly where the Jaccard similarity reaches 0.8."""
    r = random.Random(4)
    texts = []
    for base in range(12):
        words = prose(60, 500 + base).replace(".", "").split()
        for _ in range(5):
            w = list(words)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            texts.append(prose(5, r.random()) + "\n" + " ".join(w))
    got = passages.duplicate_passages(frame(spark, texts), block=2).collect()
    near = {(i, j) for i in range(len(texts)) for j in range(len(texts)) if i != j and
            (lambda a, b: len(a & b) >= 0.8 * len(a | b))(brute_shingles(texts[i].split("\n")[1]), brute_shingles(texts[j].split("\n")[1]))}
    comp = list(range(len(texts)))
    for i, j in near:
        a, b = comp[i], comp[j]
        comp = [min(a, b) if c in (a, b) else c for c in comp]
    want = {(i, comp[i]) for i in range(len(texts)) if comp.count(comp[i]) > 1}
    assert {(x["doc_id"], x["first_id"]) for x in got} == want
    assert near


def test_passages_inside_lines(spark):
    shared = prose(25, 1000).replace(".", "") + ". " + prose(30, 1001).replace(".", "") + "."
    texts = [prose(40, 2000 + i) for i in range(8)] + [None, ""]
    texts[2] = prose(30, 3000) + ". " + shared
    texts[5] = shared + " " + prose(45, 3001)
    texts[7] = shared.upper()
    got = passages.duplicate_passages(frame(spark, texts)).collect()
    assert {(x["doc_id"], x["first_id"], x["removed"]) for x in got} == {(2, 2, False), (5, 2, True), (7, 2, True)}
    for x in got:
        assert any(shared.lower()[:100] in texts[x["doc_id"]][s["start"]:s["end"]].lower() for s in x["spans"])


def brute_windows(texts, n=50):
    """Words (document, place) of windows of ``n`` words that another document holds too."""
    words = [(t or "").lower().split() for t in texts]
    at = {}
    for d, w in enumerate(words):
        for i in range(len(w) - n + 1):
            at.setdefault(tuple(w[i:i + n]), set()).add((d, i))
    return {(d, i + k) for places in at.values() if len({d for d, _ in places}) > 1 for d, i in places for k in range(n)}


def marked_words(texts, got):
    out = set()
    for x in got:
        for i, m in enumerate(re.finditer(r"\S+", texts[x["doc_id"]] or "")):
            if any(s["start"] <= m.start() and m.end() <= s["end"] for s in x["spans"]):
                out.add((x["doc_id"], i))
    return out


def test_passages_across_lines_and_mid_sentence(spark, monkeypatch):
    """Wrapped, re-wrapped and mid-sentence copies are marked exactly as far as windows are shared."""
    def wrap(words, n, by=" "):
        return "\n".join(by.join(words[i:i + n]) for i in range(0, len(words), n))

    plain = [prose(400, 7000 + s).replace(".", "").split() for s in range(24)]
    texts = [wrap(w, 9) for w in plain]                        # lines too short for paragraphs
    texts[3] = wrap(plain[3][:150] + plain[1][100:160] + plain[3][150:], 7)
    texts[4] = " ".join(plain[4][:80] + plain[1][120:170] + plain[4][80:])          # 50 words, mid-sentence
    texts[5] = wrap(plain[5][:80] + plain[2][0:49] + plain[5][80:], 9)              # 49 words: too few
    texts[6] = wrap(plain[6][:20] + plain[2][30:330] + plain[6][20:], 11, "  ")
    texts[8] = wrap(plain[2][200:270] + plain[8], 13, " \t").upper()
    texts[9] = texts[10] = wrap(plain[9] + plain[3][40:149], 6)
    texts += [None, "", wrap(plain[12][:50], 10), wrap(plain[12][:51], 10)]
    want = brute_windows(texts)
    got = passages.duplicate_passages(frame(spark, texts)).collect()
    assert marked_words(texts, got) == want and len({d for d, _ in want}) == 11
    assert {(x["doc_id"], x["first_id"]) for x in got if x["doc_id"] in (4, 8, 10)} == {(4, 1), (8, 2), (10, 3), (10, 9)}
    long = [" ".join(plain[13] + plain[14]) + "\n" + wrap(plain[15], 9), wrap(plain[16], 9) + "\n" + wrap(plain[14][300:] + plain[15][:100], 8)]
    for chunk in (1 << 20, 700):                               # a text read in pieces loses no window
        monkeypatch.setattr(passages, "CHUNK", chunk)
        batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([0, 1]), pa.array(long)], names=["id", "text_hash", "t"])
        covered = set()
        for b in passages._emit(batch, 20):
            for x in b.to_pylist():
                if x["gram"] is not None:
                    w = [m.start() for m in re.finditer(r"\S+", long[x["id"]]) if x["start"] <= m.start() < x["end"]]
                    covered |= {(x["id"], s) for s in w[:len(w) - 49]}
        starts = [[m.start() for m in re.finditer(r"\S+", t)] for t in long]
        assert covered == {(i, s) for i, w in enumerate(starts) for s in w[:len(w) - 49]}


def test_passages_without_ascii_blanks(spark):
    r = random.Random(5)
    han = ["".join(chr(0x4E00 + r.randrange(3000)) for _ in range(90)) for _ in range(4)]
    wide = "\u3000".join(prose(60, 7100).replace(".", "").split())
    texts = [han[0], han[1][:40] + han[0][10:80] + han[1][40:], han[2], wide, prose(30, 7101) + "\u00a0" + wide.replace("\u3000", "\u00a0")]
    got = {(x["doc_id"], x["first_id"]): x for x in passages.duplicate_passages(frame(spark, texts)).collect()}
    assert set(got) == {(0, 0), (1, 0), (3, 3), (4, 3)}
    assert [texts[1][s["start"]:s["end"]] for s in got[1, 0]["spans"]] == [han[0][10:80]]
    quoted = prose(24, 7102).replace(".", "") + '."'
    stop = [prose(30, 7103).replace(".", "") + '." ' + quoted + " " + prose(20, 7104), prose(9, 7105) + "! " + quoted + " " + prose(40, 7106)]
    assert {(x["doc_id"], x["first_id"]) for x in passages.duplicate_passages(frame(spark, stop)).collect()} == {(0, 0), (1, 0)}


def test_passages_of_one_id_on_several_texts(spark):
    """Offsets belong to one text: two texts of an id have rows of their own."""
    shared = " ".join(f"alpha{i}" for i in range(30)) + "."
    other = " ".join(f"beta{i}" for i in range(60)) + "."
    texts = {1: [f"{shared}\n{other}"], 2: [f"Own words go first.\n{shared}", f"A third text of that id starts otherwise.\n{other}"]}
    docs = spark.createDataFrame([(i, t) for i, ts in texts.items() for t in ts + ts[:1]], "doc_id long, text string")
    got = [r for r in passages.duplicate_passages(docs).collect() if r["doc_id"] == 2]
    assert len(got) == 2 and len({r["text_hash"] for r in got}) == 2 and all(r["removed"] and r["first_id"] == 1 for r in got)
    hit = {t[s["start"]:s["end"]] for r, t in zip(sorted(got, key=lambda r: r["n_chars"]), texts[2]) for s in r["spans"]}
    assert hit == {shared, other}


def test_passages_edges(spark):
    got = passages.duplicate_passages(messy(spark)).collect()
    assert {(x["doc_id"], x["first_id"]) for x in got} == {(6, 6), (7, 6)}
    assert passages.duplicate_passages(empty(spark)).count() == 0
    one = frame(spark, [prose(50, 1) + "\n" + prose(50, 1)])      # repeats inside one document only
    assert passages.duplicate_passages(one).count() == 0


# ---- page text

def test_page_text():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><script>var a = "<p>no</p>";</script></head><body>
    <header><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a></ul></nav><div class="cookie-notice">We use cookies.</div>
    <article><h1>A  headline &amp; more</h1><p>First&nbsp;paragraph of the article,
    with <a href=x>a link</a> and enough words to count as content.<br>After a break.<p>Short.
    <form><input name=q><button>Go</button></form><div class="ad banner">Buy this now</div>
    <p>Last paragraph of the article, again with a good number of words in it.</p></article>
    <aside><p>A sidebar that is also quite long, with a number of words in it, as teasers are.</p></aside>
    <section id="comments"><p>A reader comment that is as long as a paragraph of the article, or longer.</p></section>
    <footer>&copy; someone</footer>"""
    assert html_text.main_text(page) == "\n\n".join([
        "A headline & more",
        "First paragraph of the article, with a link and enough words to count as content. After a break.",
        "Short.", "Last paragraph of the article, again with a good number of words in it."])
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("plain &lt;text&gt;") == "plain <text>"


def test_page_text_in_hinted_wrappers():
    """A wrapper whose class, id or tag only sounds like boilerplate does not take the article with it."""
    body = "".join(f"<p>Paragraph {i} of the article, with a good number of words to count as content.</p>" for i in range(4))
    want = "\n\n".join(f"Paragraph {i} of the article, with a good number of words to count as content." for i in range(4))
    side = '<div class="sidebar"><p>A sidebar teaser that has some words as well.</p></div>'
    talk = '<section id="comments">' + "<article class=comment><p>A reader comment with some words in it.</p></article>" * 2 + "</section>"
    for wrap in ('div class="layout with-sidebar"', 'div id="content-sidebar-wrap"', 'div class="post has-comments"',
                 'div class="search-results"', "form action=/", 'x-page class="layout with-sidebar"', "main><div class='with-sidebar'"):
        end = wrap.split()[0].split(">")[0]
        for inner in (f"<article>{body}</article>", f"<main>{body}</main>", f"<div>{body}</div>", f'<div class="related-wrap">{body}</div>'):
            page = f"<body><nav><a href=/>Home</a></nav><{wrap}>{inner}{side}{talk}</{end}><footer>f</footer>"
            assert html_text.main_text(page) == want, (wrap, inner)
    short = "<article><p>One short paragraph of an article.</p></article>"
    assert html_text.main_text(f'<div class="with-sidebar">{short}{talk}</div>') == "One short paragraph of an article."
    posts = "".join(f'<div class="post has-comments">{p}</p></div>' for p in body.split("</p>")[:-1])
    assert html_text.main_text(f"<body>{posts}{side}") == want
    for head in ('<article><div class="entry-header"><h1>The headline</h1></div>', '<article><div id="header"><h1>The headline</h1></div>',
                 '<div class="post"><div class="entry-header"><h1>The headline of it</h1></div>'):
        assert html_text.main_text(f"<body>{head}{body}").endswith(want) and "The headline" in html_text.main_text(f"<body>{head}{body}")
    assert html_text.main_text('<div class="ad">' + body + "</div><article><p>Tiny.</article>") == "Tiny."
    assert html_text.main_text(f'<article><h1>T</h1><div class="entry share-wrap">{body}</div></article>') == "T\n\n" + want
    assert html_text.main_text(f"<article>{body}<form><p>Your mail address</p></form>{talk}</article>{side}") == want


def test_pages_edges(spark):
    rows = [(1, "u", None), (2, None, "<p>a"), (None, "u", "<article><p>b</article>"), (4, "u", "<div>" * 3000 + "deep"), (4, "u", "<p>a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted(html_text.extract_text(pages).collect(), key=str)
    assert sorted((r["text"], r["n_chars"]) for r in got) == [("", 0), ("a", 1), ("a", 1), ("b", 1), ("deep", 4)]
    assert html_text.extract_text(pages.limit(0)).count() == 0


# ---- decontamination

def ascii_words(text):
    out, word = [], ""
    for c in (text or ""):
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c.isascii() and not (c.isdigit() or "a" <= c <= "z"):
            out, word = (out + [word] if word else out), ""
        else:
            word += c
    return out + [word] if word else out


def brute_hits(text, items):
    w, hit, ids = ascii_words(text), set(), set()
    for i, t in items:
        v = ascii_words(t)
        m = min(10, len(v))
        wins = {tuple(v[p:p + m]) for p in range(len(v) - m + 1)} if m else set()
        for p in range(len(w) - m + 1):
            if tuple(w[p:p + m]) in wins:
                hit.update(range(p, p + m))
                ids.add(str(i))
    return len(w), len(hit), sorted(ids)


def test_decontamination_against_brute_force(spark):
    items = [(1, prose(40, 70)), (2, prose(12, 71)), (3, "Héllo wörld"), (4, None), (5, "..."), (6, "one"), (7, prose(10, 72)),
             (8, prose(40, 70)), (9, prose(9, 73)), (None, "two")]
    texts = ODD + [prose(50, s) for s in range(10)]
    texts += [prose(20, 80 + s) + " - " + prose(40, 70)[s * 7:s * 7 + 90].upper() + "! " + prose(5, s) for s in range(12)]
    texts += ["say ONE and Héllo, wörld", "a" + prose(12, 71), prose(12, 71) + prose(10, 72), prose(9, 73), "a a a a a a a a a a a a a one one", "two"]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1)).withColumn("print", F.lit(2))
    got = decontaminate.decontaminate(frame(spark, texts).withColumn("mark", F.lit("clash")), bench).collect()
    assert len(got) == len(texts)
    for r in got:
        n, hit, ids = brute_hits(texts[r["doc_id"]], items[:-1])
        if "two" in ascii_words(texts[r["doc_id"]]):
            continue                                    # the item without an id marks words, but has no name
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) == (n, hit, len(ids), ids, hit > 0), texts[r["doc_id"]]
    clean = decontaminate.clean_documents(frame(spark, texts), bench)
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == {r["doc_id"] for r in got if not r["contaminated"]}


def test_decontamination_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.decontaminate(messy(spark), none).collect()
    assert len(got) == len(ODD) + 2 and not any(r["contaminated"] for r in got)
    some = spark.createDataFrame([(1, "x")], "item_id long, text string")
    got = decontaminate.decontaminate(messy(spark), some).collect()
    assert sorted(r["doc_id"] for r in got if r["contaminated"]) == [3, 3, 4]
    assert decontaminate.decontaminate(empty(spark), some).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


# ---- toxicity

def test_field_marginals_match_enumeration():
    g = np.random.default_rng(0)
    t = g.normal(0, 1, (2, 2))
    size = np.array([1, 5, 3])
    e = g.normal(0, 1, 9)
    p, pairs = toxicity.marginals(e, size, t, pairs=True)
    want, want_pairs, at = [], np.zeros((2, 2)), 0
    for n in size:
        total, by, by_pair = 0.0, np.zeros(n), np.zeros((2, 2))
        for tags in range(1 << n):
            y = [tags >> i & 1 for i in range(n)]
            w = np.exp(sum(e[at + i] * y[i] for i in range(n)) + sum(t[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            by += w * np.array(y)
            for i in range(n - 1):
                by_pair[y[i], y[i + 1]] += w
        want += (by / total).tolist()
        want_pairs += by_pair / total
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


ENDS = ["olo", "ina!", "o", "a,", "ebbo", "emmo.", "igge", "uffo", "addi", "occe", "unna", "isso"]


@pytest.fixture(scope="module")
def toxic_model():
    texts, toxic = [], []
    for s in range(240):
        words = prose(80, 9000 + s).split()
        bad = s % 4 == 0
        if bad:
            for k in range(3):
                words[(s * 7 + 11 * k) % 80] = ["Zork", "zork", "vilest"][(s + k) % 3] + ENDS[(s // 4 + 5 * k) % len(ENDS)]
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return toxicity.fit(texts, toxic)


def test_toxicity_scores_and_spans(spark, toxic_model):
    clean, bad = prose(120, 1), prose(60, 2) + " ZORKOLO, " + prose(60, 3) + "\nvilesta end"
    unseen = prose(40, 5) + " zorkanda zorkemu " + prose(40, 6)
    got = {r["doc_id"]: r for r in toxicity.score(frame(spark, [clean, bad, unseen, None, "", bad * 40]), toxic_model).collect()}
    assert [got[i]["predicted"] for i in range(6)] == [0, 1, 1, 0, 0, 1]
    assert [bad[s["start"]:s["end"]] for s in got[1]["spans"]] == ["ZORKOLO", "vilesta"]
    assert len(got[5]["spans"]) == 80 and got[0]["spans"] == []
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_edges(spark, toxic_model):
    assert toxicity.score(messy(spark), toxic_model).count() == len(ODD) + 2
    assert toxicity.score(empty(spark), toxic_model).count() == 0
    assert {r["predicted"] for r in toxicity.score(messy(spark), None).collect()} == {0}
    kept = toxicity.keep_clean(messy(spark), toxic_model)
    assert kept.columns == messy(spark).columns and kept.count() == len(ODD) + 2
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    assert toxicity.train(frame(spark, ["a b", "c d"]), labels) is None


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"
    model = toxicity.train(docs, labels.where(f"not {held}"))
    got = toxicity.score(docs.where(held), model).join(labels.where(held), "doc_id").collect()
    tp = sum(r["predicted"] and r["toxic"] for r in got)
    assert tp / sum(r["toxic"] for r in got) >= 0.8
    assert tp / max(1, sum(r["predicted"] for r in got)) >= 0.85
    json.dumps([r["score"] for r in got])
