"""Packing, fill-in-middle and spelling variants: edge cases and brute-force checks on small frames."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from speclab.llm import fill_middle, packing, spelling
from test_operators import ODD, empty, frame, messy, prose

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(VOCABULARY)


# ---- packing

MIXED = ["a", "B", "̈", "́", " ", "\n", "\t", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "'s", "'S", "'ll", "'re", "1", "²",
         "漢", "🥕", "<|endoftext|>", "<|startoftext|>", "ß", "İ", "Σ", "ς", "ﬁ", "!?", "</w>", "\x00", "é", "Ž", "ŉ", "word", "Tests", "00"]


def test_packing_ids_match_the_library(library):
    encode = packing.Encoder(packing.read_vocabulary(VOCABULARY))
    r = random.Random(5)
    texts = [t or "" for t in ODD] + ["".join(r.choice(MIXED) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_packing_long_texts_are_encoded_in_blocks(library, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_CHARS", 50)
    encode = packing.Encoder(packing.read_vocabulary(VOCABULARY))
    for t in (prose(400, 9), prose(100, 2) + "̈漢 " + prose(100, 3), "x" * 500):
        assert np.frombuffer(encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def merged(symbols, rank):
    while len(symbols) > 1:
        best = min(zip(symbols, symbols[1:]), key=lambda pair: rank.get(pair, 1 << 30))
        if best not in rank:
            return symbols
        out, k = [], 0
        while k < len(symbols):
            if tuple(symbols[k:k + 2]) == best:
                out.append(best[0] + best[1])
                k += 2
            else:
                out.append(symbols[k])
                k += 1
        symbols = out
    return symbols


def test_ranks_by_result_equal_the_merge_list(library):
    """If the merge list makes every token's own text into that token, two neighbours that join to a token are always
    that token's listed merge, so looking at the joined bytes alone gives the same merges."""
    spec = json.load(open(VOCABULARY, encoding="utf-8"))["model"]
    pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in spec["merges"]]
    rank = {pair: k for k, pair in enumerate(pairs)}
    for a, b in pairs:
        token = a + b
        body = token.removesuffix("</w>")
        symbols = list(body)
        if body != token:
            symbols[-1] += "</w>"
        assert merged(symbols, rank) == [token]


def test_assign_fills_every_sequence():
    r = random.Random(1)
    for lengths in ([], [1], [7], [8], [8, 8, 3], [r.randint(1, 63) for _ in range(500)], [1] * 200, [63] * 9):
        cap = 64
        placed = list(packing.assign(lengths, cap, 1 / cap))
        per, pieces = defaultdict(list), defaultdict(list)
        for k, s, n, q, o in placed:
            per[q].append((o, n))
            pieces[k].append((s, n))
        for got in (*per.values(), *pieces.values()):
            at = 0
            for start, n in sorted(got):
                assert start == at and n > 0
                at += n
        assert {k: sum(n for _, n in v) for k, v in pieces.items()} == {k: n for k, n in enumerate(lengths)}
        sizes = sorted((sum(n for _, n in v) for v in per.values()), reverse=True)
        assert all(s == cap or s & (s - 1) == 0 for s in sizes) and sum(s < cap for s in sizes) <= 6


def test_assign_balances_cost():
    r = random.Random(2)
    lengths = [r.choice([40, 300, 900, 1500]) for _ in range(400)]
    cost = defaultdict(float)
    for _, _, n, q, _ in packing.assign(lengths):
        cost[q] += n + n * n / 2048
    whole = [c for q, c in cost.items() if q < sum(lengths) // 2048]
    first_fit = sorted((n + n * n / 2048 for n in lengths), reverse=True)[0]
    assert max(whole) - min(whole) < first_fit


def check_packing(rows, texts_by_id, library, capacity):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at == capacity or at & (at - 1) == 0
        assert at <= capacity
    assert set(docs) == set(texts_by_id)
    for i, text in texts_by_id.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(docs[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            part = np.array(ids[at:at + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)
            if "ids" in r.asDict():
                assert np.frombuffer(r["ids"], "<u2").tolist() == ids[at:at + r["length"]]
            at += r["length"]
        assert at == len(ids)


def test_packing_by_brute_force(spark, library):
    texts = [t for t in ODD] + [prose(random.Random(i).randint(0, 900), i) for i in range(120)] + ["x"] * 40
    rows = packing.pack(frame(spark, texts), VOCABULARY, group_tokens=30000, keep_ids=True).collect()
    check_packing(rows, dict(enumerate(texts)), library, 2048)
    rows = packing.pack(frame(spark, texts), VOCABULARY, capacity=256).collect()
    check_packing(rows, dict(enumerate(texts)), library, 256)


def test_packing_edges(spark):
    got = packing.pack(messy(spark), VOCABULARY)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    by_id = {r["doc_id"]: r for r in got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.sum(F.when(F.col("start") == 0, F.col("doc_tokens"))).alias("t")).collect()}
    assert all(r["n"] == r["t"] for r in by_id.values())       # the repeated row and the null id are documents too
    assert by_id[0]["n"] == by_id[1]["n"] == 1 and None in by_id
    assert packing.pack(empty(spark), VOCABULARY).count() == 0
    same = packing.pack(frame(spark, ["same words here"] * 3000), VOCABULARY, group_tokens=2048)
    sizes = [r["n"] for r in same.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert sum(sizes) == 12000 and all(s == 2048 or s & (s - 1) == 0 for s in sizes)


# ---- fill-in-middle

def brute_fill(i, text, seed=7):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    n = len(units)
    x = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(k in t for k in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, t
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def lines(seed):
    r = random.Random(seed)
    return "".join(r.choice(["\n", "a", "é", "漢字", "🥕", "<", "P>", "<S", ">", " word", "\r", "\n\n"]) for _ in range(r.randint(0, 60)))


def test_fill_middle_by_brute_force(spark, monkeypatch):
    texts = ODD + [lines(i) for i in range(400)] + ["a <P> b\nc", "<M>", "\n", "\n\n", "<\nP>", prose(9000, 4).replace(". ", ".\n")]
    got = fill_middle.restore(fill_middle.transform(frame(spark, texts))).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute_fill(r["doc_id"], t)
        assert r["restored"] == (t or "")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_shifts_carry_over_blocks(monkeypatch):
    monkeypatch.setattr(fill_middle, "BLOCK", 7)
    texts = [lines(i) for i in range(200)]
    data, offsets = fill_middle._bytes_of(pa.array(texts))
    form = np.array([random.Random(i).randint(0, 2) if t and "<P>" not in t and "<S>" not in t else 0 for i, t in enumerate(texts)])
    start, end = offsets[:-1], offsets[1:]
    made, out = fill_middle.scatter(data, offsets, start + (end - start) // 3, start + (end - start) // 2, form)
    back, at, valid = fill_middle.gather(made, out, form)
    assert valid.all() and bytes(back) == "".join(texts).encode() and (at == offsets).all()


def test_fill_middle_edges(spark):
    got = fill_middle.restore(fill_middle.transform(messy(spark)).withColumn("restored", F.lit(1)))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    rows = got.collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        t = "null id" if r["doc_id"] is None else ODD[r["doc_id"]]
        assert (r["output"], r["restored"]) == (brute_fill(r["doc_id"], t)[4], t or "")
    assert fill_middle.transform(empty(spark)).count() == 0
    odd = spark.createDataFrame([("psm", "no marks"), ("psm", None), (None, "x"), ("plain", "x"), ("spm", "<S>c<P>a<M>b"), ("psm", "<P>1<P>2<P>3<M>")],
                                "form string, output string")
    assert [r["restored"] for r in fill_middle.restore(odd.coalesce(1)).collect()] == [None, None, None, "x", "abc", None]
    none = fill_middle.transform(frame(spark, ["a\nb"]), rate=0).first()
    assert none["form"] == "plain" and none["output"] == "a\nb"


# ---- spelling variants

def brute_pairs(words):
    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) < len(b):
            a, b = b, a
        return len(a) == len(b) + 1 and any(a[:k] + a[k + 1:] == b for k in range(len(a)))
    return {(a, b) for a in words for b in words if a != b and one_edit(a, b)}


def test_near_pairs_by_brute_force(spark):
    r = random.Random(4)
    words = {"".join(r.choice("abcé") for _ in range(r.randint(1, 7))) for _ in range(500)}
    words |= {"aaaaaaa", "aaaaaa", "aaaaaaaa", "abcabcabc", "bcabcabc", "abcabcab", "abcabcabcd", "zabcabcabc", "", "x"}
    long = "".join(r.choice("ab") for _ in range(70))
    words |= {long, long[:30] + long[31:], long[:69], long + "c", "c" + long, long[:20] + "c" + long[21:], long[:64], long[:63], long[:65], long[:62] + "cc"}
    v = spark.createDataFrame([(w,) for w in words] + [(None,), ("abcabcabc",)], "word string").withColumn("w", F.lit("clash")).withColumn("n", F.lit(1))
    got = {(x["word"], x["near"]) for x in spelling.near_pairs(v).collect()}
    assert got == brute_pairs(words)
    assert {(x["word"], x["near"]) for x in spelling.near_pairs(v, levels=5).collect()} == got
    assert spelling.near_pairs(v.where("word is null")).count() == 0


def brute_variants(docs, least_chars=6, least_count=5, more=5):
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    c = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(up)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= least_chars:
                c[w] += 1
    c = {w: n for w, n in c.items() if n >= least_count}
    near = defaultdict(set)
    for a, b in brute_pairs(c):
        near[a].add(b)
    form = {}
    for w in c:
        if near[w]:
            b = min(near[w], key=lambda v: (-c[v], v))
            if c[b] >= more * c[w]:
                form[w] = b

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {w: (form.get(w), root(w), n, len(near[w]), c.get(form.get(w))) for w, n in c.items()}


def test_variants_by_brute_force(spark):
    r = random.Random(8)
    base = ["colour", "parameter", "ÀÉîöü×abc", "wonderful", "Strasse", "elephant", "banana"]
    texts = []
    for _ in range(400):
        out = []
        for _ in range(40):
            w = r.choice(base)
            if r.random() < 0.1:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1:], w[:k] + "z" + w[k:], w[:k] + "q" + w[k + 1:]])
            out.append(w.upper() if r.random() < 0.1 else w)
        texts.append(r.choice([" ", ", ", "\n", "1"]).join(out))
    # a chain of forms: each five times as frequent as the one before
    texts += ["chainaa " * 1 * 5, "chainab " * 5 * 5, "chainbb " * 25 * 5, "tiedaaa " * 5 + "tiedaab " * 25 + "tiedaac " * 25]
    docs = frame(spark, texts)
    got = {x["word"]: (x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in spelling.variants(docs).collect()}
    want = brute_variants(list(enumerate(texts)))
    assert got == want
    assert got["chainaa"][:2] == ("chainab", "chainbb") and got["tiedaaa"][0] == "tiedaab"
    assert any(n and f is None for f, _, _, n, _ in got.values())


def test_variants_edges(spark):
    docs = messy(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {x["word"]: (x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in spelling.variants(docs).collect()}
    assert got == brute_variants(rows)
    assert spelling.variants(empty(spark)).count() == 0
    assert spelling.variants(frame(spark, [None, "", "a b c", "x" * 200000])).count() == 0
    repeated = frame(spark, ["longword"] * 7)
    assert sum(r["n"] for r in spelling.variants(repeated).collect()) == sum(v[2] for v in brute_variants([(i, "longword") for i in range(7)]).values())


# ---- mixing: rows that share a key

def test_mixing_takes_parts_of_repeated_rows(spark):
    from speclab.llm import mixing
    for equal in (200, 1000, 3000):
        rows = [(1, "a b", None, "same", 0)] * equal + [(10 + i, "c d", None, "other", 0) for i in range(equal)]
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5))
        by = {r["one"]: r for r in got.groupBy((F.col("doc_id") == 1).alias("one")).agg(F.sum("taken").alias("t"), F.max("target").alias("w"),
                                                                                       F.max("taken").alias("most")).collect()}
        for r in by.values():
            assert abs(r["t"] - r["w"]) <= 2 and r["most"] <= 6
    # two groups of equal rows whose keys share a bin for long, and a source of empty rows
    rows = [(i % 3, "w " * (i % 3 + 1), None, None, 0) for i in range(3000)] + [(7, "", None, "void", 0)] * 400
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert got.count() == 3400
    t = got.where("doc_id < 3").agg(F.sum("taken").alias("t"), F.max("target").alias("w")).first()
    assert abs(t["t"] - t["w"]) <= 3


def test_keep_first_leaves_kept_texts_where_they_are(spark):
    """Without broadcast joins too, only rows that may go are shuffled with their texts."""
    from speclab.llm import simhash
    docs = frame(spark, [prose(60, i % 900) for i in range(1000)])
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.keep_first(docs)
        assert kept.count() == 900
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert plan.lstrip().startswith("AdaptiveSparkPlan") and "Union" in plan
        moved = docs.where(simhash._in_slots(b"\xff" * (simhash.SLOTS // 8), F.col("doc_id"), F.xxhash64("text")))
        assert moved.count() == 1000
        gone = spark.createDataFrame([(i, 0) for i in range(50)], "id long, text_hash long")
        marked = simhash._slots(gone)
        hit = spark.range(100000).where(simhash._in_slots(marked, F.col("id"), F.lit(0).cast("long")))
        assert {r["id"] for r in hit.collect()} >= set(range(50)) and hit.count() <= 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
