"""The corpus pipeline's stages against brute force, each on what its predecessor kept."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from speclab.llm import mixing, toxicity
from speclab.llm.common import cut_lineage
from speclab.llm.queries import LEARNABLE
from tests.llm.test_operators import brute_components, brute_fingerprint, brute_hits

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, sf))
        out.append(docs)
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination",
                                                      "source_mixing", "sharding"]
    assert all(df.columns == COLUMNS for df in stages[:-1])
    assert stages[-1].columns == COLUMNS + ["shard", "shard_depth", "shard_bytes", "shard_rows"]


def test_toxicity_stage(spark, sf, stages):
    before, after = stages[0], stages[1]
    model = toxicity.train(before, spark.read.parquet(f"{sf}/labels.parquet").where(LEARNABLE))
    scored = toxicity.score(before, model)
    assert {i for i, _ in rows(after)} == {r["doc_id"] for r in scored.where("predicted = 0").collect()}
    assert 0 < after.count() < before.count()
    assert not any(w in (t or "").lower() for _, t in rows(after) for w in ("idiot", "moron", "worthless"))


def test_near_duplicate_stage(stages):
    before, after = sorted(rows(stages[1])), rows(stages[2])
    comp = brute_components([brute_fingerprint(t) for _, t in before], 4)
    assert sorted(after) == [before[c] for c in sorted(set(comp))]


def test_decontamination_stage(spark, sf, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = [r for r in rows(stages[2]) if brute_hits(r[1], items)[1] == 0]
    assert sorted(rows(stages[3])) == sorted(want)


def test_mixing_stage(stages):
    taken = {r["doc_id"]: r for r in mixing.mix(stages[3]).collect()}
    got = Counter(i for i, _ in rows(stages[4]))
    for i, r in taken.items():
        if r["size"]:
            assert got.get(i, 0) == r["taken"] // r["size"]
    assert set(got) <= set(taken)


def test_sharding_stage(stages):
    assert Counter(rows(stages[5])) == Counter(rows(stages[4]))
    sizes = stages[5].groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert all(r["b"] <= 1 << 20 or r["n"] == 1 for r in sizes)


def test_run_gives_the_last_stage(spark, sf, stages):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == stages[-1].columns
    assert Counter(rows(out)) == Counter(rows(stages[-1]))


def test_stages_take_empty_documents(spark, sf):
    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf)
        assert none.count() == 0
