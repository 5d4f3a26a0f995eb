"""Sharding by extendible hashing, in DataFrame operations only.

Rows are placed by the leading bits of a hash of id and text. A bucket over the byte
limit splits on its next bit, others stay; a bucket within the limit whose parent is over it is a
shard. Bytes are pre-aggregated to cells of a few more bits than the shards should
need, all shallower buckets are sums of cells, and only cells still over the limit are looked
at again with more bits. Buckets that no bit can split (rows equal in id and text) go on
overflow pages.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speclab.llm.common import cut_lineage

HASH_BITS = 60
SHARD_BYTES = 1 << 20
SPARE_BITS = 3            # cells are this much finer than shards of average size
STEP_BITS = 8             # more bits for cells still over the limit


def _cell(bits: int):
    return F.shiftright("sh_hash", HASH_BITS - bits)


def _settle(cells: DataFrame, bits: int, from_bits: int, limit: int) -> DataFrame:
    """``(cell, depth, sh_bytes, sh_rows)``: the shard of every cell, null depth where none fits.

    ``from_bits``: depth of the buckets these cells come from (known to be over the limit)."""
    path = cells.select("cell", "bytes", "rows", F.explode(F.sequence(F.lit(from_bits), F.lit(bits))).alias("depth"))
    path = path.withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    fits = cut_lineage(path.groupBy("depth", "prefix").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r"))
                       .where((F.col("b") <= limit) | (F.col("r") == 1)))
    # the shallowest bucket that fits on a cell's path is its shard
    return cut_lineage(path.join(fits, ["depth", "prefix"], "left").groupBy("cell").agg(
        F.min(F.when(F.col("b").isNotNull(), F.struct("depth", F.col("b").alias("b"), F.col("r").alias("r")))).alias("leaf"))
        .select("cell", F.col("leaf.depth").cast("int").alias("depth"), F.col("leaf.b").alias("sh_bytes"),
                F.col("leaf.r").alias("sh_rows")))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """The columns of ``docs`` and four more: ``shard``, ``shard_depth``, ``shard_bytes``, ``shard_rows``.

    ``shard``: ``s`` and the bucket's hash bits (``s`` alone is the undivided table).
    A shard's texts have at most ``limit`` UTF-8 bytes in all, unless it is a single
    longer text. Null texts count 0 bytes, null ids hash as empty. Rows equal in id and
    text that exceed the limit together get pages: ``+`` and a number follow the
    bits. An empty table gives no rows. Columns of ``docs`` with the new names are replaced.
    """
    new = ["shard", "shard_depth", "shard_bytes", "shard_rows"]
    kept = [c for c in docs.columns if c not in new]
    mark = F.md5(F.concat(F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit("|"), F.coalesce(docs[text_col], F.lit(""))))
    rows = docs.select(*[docs[c] for c in kept],
                       F.conv(F.substring(mark, 1, HASH_BITS // 4), 16, 10).cast("long").alias("sh_hash"),
                       F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long").alias("sh_own"))
    slim = cut_lineage(rows.select("sh_hash", "sh_own"))
    total = slim.agg(F.coalesce(F.sum("sh_own"), F.lit(0)).alias("b")).first()["b"]
    bits = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total) / limit))) + SPARE_BITS)
    done, from_bits, open_rows = [], 0, slim
    while True:
        cells = cut_lineage(open_rows.groupBy(_cell(bits).alias("cell")).agg(
            F.sum("sh_own").alias("bytes"), F.count("*").alias("rows")))
        found = _settle(cells, bits, from_bits, limit)
        done.append((bits, found.where("depth is not null")))
        still = cut_lineage(found.where("depth is null").select("cell"))
        if still.isEmpty() or bits == HASH_BITS:
            break
        open_rows = open_rows.withColumn("cell", _cell(bits)).join(still, "cell", "left_semi").drop("cell")
        from_bits, bits = bits + 1, min(HASH_BITS, bits + STEP_BITS)

    out = None
    for at, found in done:
        part = rows.withColumn("cell", _cell(at)).join(found, "cell").drop("cell")
        out = part if out is None else out.unionByName(part)
    prefix = F.expr(f"shiftright(sh_hash, {HASH_BITS} - depth)")
    name = F.concat(F.lit("s"), F.when(F.col("depth") == 0, "").otherwise(
        F.lpad(F.bin(prefix), F.col("depth"), F.lit("0"))))
    out = out.withColumn("shard", name)
    if bits == HASH_BITS and not still.isEmpty():
        out = out.unionByName(_pages(rows, still, limit))
    return out.select(*kept, "shard", F.col("depth").alias("shard_depth"), F.col("sh_bytes").alias("shard_bytes"),
                      F.col("sh_rows").alias("shard_rows"))


def _pages(rows: DataFrame, still: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of buckets whose rows share all hash bits, numbered inside each input partition."""
    own = cut_lineage(rows.join(still.withColumnRenamed("cell", "sh_hash"), "sh_hash", "left_semi")
                      .withColumn("sh_at", F.monotonically_increasing_id()))
    own = own.withColumn("sh_part", F.shiftright("sh_at", 33))
    order = Window.partitionBy("sh_hash", "sh_part").orderBy("sh_at")
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("sh_own", F.lit(1))))
    own = own.withColumn("sh_page", F.floor((F.row_number().over(order) - 1) / per_page))
    page = Window.partitionBy("sh_hash", "sh_part", "sh_page")
    return (own.withColumn("sh_bytes", F.sum("sh_own").over(page)).withColumn("sh_rows", F.count("*").over(page))
            .withColumn("depth", F.lit(HASH_BITS))
            .withColumn("shard", F.concat(F.lit("s"), F.lpad(F.bin("sh_hash"), HASH_BITS, "0"), F.lit("+"),
                                          F.col("sh_part").cast("string"), F.lit("."), F.col("sh_page").cast("string")))
            .drop("sh_at", "sh_part", "sh_page"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, {HASH_BITS // 4}))::BIGINT AS h
  FROM documents),
p AS (SELECT doc_id, n_bytes, h, g.depth, h >> ({HASH_BITS} - g.depth) AS prefix FROM d, (SELECT unnest(range(0, 31)) AS depth) g),
b AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM p GROUP BY ALL),
f AS (
  SELECT p.doc_id, p.n_bytes, p.depth, p.prefix, b.shard_bytes, b.shard_rows
  FROM p JOIN b ON p.depth = b.depth AND p.prefix = b.prefix
  WHERE b.shard_bytes <= {SHARD_BYTES} OR b.shard_rows = 1
  QUALIFY row_number() OVER (PARTITION BY p.h ORDER BY p.depth) = 1)
SELECT doc_id, n_bytes, 's' || CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INT, '0') END AS shard,
  depth::INT AS shard_depth, shard_bytes, shard_rows
FROM f
"""
