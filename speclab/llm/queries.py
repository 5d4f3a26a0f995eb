"""One query per training-data operator, with production parameters, over the whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speclab.llm import (decontaminate, fill_middle, html_text, language, mixing, packing, passages, sharding, simhash, spelling,
                         token_count, topk, toxicity)
from speclab.llm.common import table

QUERIES = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)


@_query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                    public_tokenizers.PATTERN, limit=1024)


@_query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, false)"
LEARNABLE = "crc32(cast(cast(doc_id as string) as binary)) % 4 != 2"


@_query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language.train(docs.where(LEARNABLE))
    return language.identify(docs, net).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score")


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(LEARNABLE))
    return toxicity.score(docs, model).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", "predicted", "spans")


@_query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return sharding.shard(docs.select("doc_id", "text", n_bytes)).drop("text")


ORACLE["op4_sharding"] = sharding.ORACLE


@_query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


ORACLE["op6_mixing"] = mixing.ORACLE


@_query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE["op9_decontamination"] = decontaminate.ORACLE


@_query
def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, queries="id % 50 = 0")


ORACLE["op2_exact_topk"] = topk.ORACLE


@_query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.duplicate_passages(table(spark, sf_dir, "documents"))


@_query
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.restore(fill_middle.transform(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


ORACLE["op12_fill_middle"] = fill_middle.ORACLE


@_query
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


ORACLE["op11_spelling_variants"] = spelling.ORACLE
