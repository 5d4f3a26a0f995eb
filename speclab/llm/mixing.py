"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document draws an exponential key: -ln(u) over its quality weight, ``u`` a hash of its
id and text, so reruns agree. A source's target is met by complete epochs over all its
documents and a fractional one: documents in key order whose prefix sum of
words fits the remaining budget.

No source is sorted whole. A source's key range is cut into bins, bin sums are
pre-aggregated, and only the bin where the budget ends is cut again, until it holds few
rows or a single key; only those rows are ordered. Rows equal in id and text share a key: the equal
rows of one partition are ordered as one weighted row, of which so many are taken as fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speclab.llm.common import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS = 3
JUNK = "%*&$#|<>{}[]=_~^"     # symbols that lower a document's quality weight
LEAST_QUALITY = 0.25
BINS = 128
ORDERED_ROWS = 256            # rows a source's last bin may hold to be ordered
ROUNDS = 12
U_BITS = 52


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """All columns of ``docs`` and four more: source, words, key on [0, 1], tie-break."""
    text = F.coalesce(docs[text_col], F.lit(""))
    junk = F.length(text) - F.length(F.translate(text, JUNK, ""))
    quality = F.greatest(F.lit(LEAST_QUALITY), 1 - F.try_divide(junk.cast("double"), F.length(text).cast("double")))
    mark = F.md5(F.concat(F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit("|"), text))
    u = (F.conv(F.substring(mark, 1, U_BITS // 4), 16, 10).cast("double") + 0.5) / float(1 << U_BITS)
    return docs.select("*", docs[source_col].alias("mix_source"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("mix_size"),
                       mark.alias("mix_mark"), (-F.log(u) / F.coalesce(quality, F.lit(1.0))).alias("mix_key"))


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Target words of each source from its size: rows ``(mix_source, source_size, target)``.

    Sources in code point order, null last, weigh 1, 2, 3, 1, ... and share the whole; a
    target stops at ``max_epochs`` times its source, and the excess is shared by weight
    again. The input is one row a source; it alone passes through unpartitioned windows.
    """
    every = Window.partitionBy()
    named = Window.orderBy(F.col("mix_source").asc_nulls_last())
    filled = Window.orderBy("ratio", F.col("mix_source").asc_nulls_last())
    s = (sizes.withColumn("w", (F.row_number().over(named) - 1) % 3 + 1)
         .withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
         .withColumn("ratio", F.col("cap") / F.col("w"))
         .withColumn("total", F.sum("source_size").over(every)))
    # sources fill up in the order of cap per weight; the level is what is left per weight left
    before = F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", (F.col("total") - before) / left)
    s = s.withColumn("full", F.col("ratio") <= F.col("level"))
    last = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return s.select("mix_source", "source_size",
                    F.when(F.col("full"), F.col("cap").cast("double")).otherwise(last * F.col("w")).alias("target"))


def _plan(slim: DataFrame, max_epochs: int) -> DataFrame:
    """One row a source: target, epochs, and the key range [lo, hi] in which ``budget`` words end."""
    sizes = slim.groupBy("mix_source").agg(F.sum("mix_size").alias("source_size"))
    plan = (targets(cut_lineage(sizes), max_epochs)
            .withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
            .withColumn("epochs", F.least("epochs", F.lit(max_epochs)))
            .withColumn("budget", F.when(F.col("epochs") < max_epochs,
                                         F.col("target") - F.col("epochs") * F.col("source_size")).otherwise(0.0))
            .withColumn("lo", F.lit(0.0))
            .withColumn("hi", F.when(F.col("budget") > 0, 1.0).otherwise(-1.0))
            .withColumn("rows_in", F.lit(1 << 62)))
    plan = cut_lineage(plan)
    open_ = (F.col("rows_in") > ORDERED_ROWS) & (F.col("budget") > 0) & (F.col("lo") < F.col("hi"))
    for _ in range(ROUNDS):
        if plan.where(open_).isEmpty():
            break
        width = (F.col("hi") - F.col("lo")) / BINS
        inside = _with_plan(slim, plan.where(open_)).where("mix_at >= lo and mix_at <= hi")
        at = F.least(F.coalesce(F.floor(F.try_divide(F.col("mix_at") - F.col("lo"), width)), F.lit(0)), F.lit(BINS - 1))
        bins = inside.withColumn("bin", at).groupBy("mix_source", "bin").agg(
            F.sum("mix_size").alias("words"), F.count("*").alias("n"), F.min("mix_at").alias("least"), F.max("mix_at").alias("most"))
        run = Window.partitionBy("mix_source").orderBy("bin")
        bins = bins.withColumn("upto", F.sum("words").over(run)).withColumnRenamed("mix_source", "b_source")
        found = (plan.join(bins, (F.col("mix_source").eqNullSafe(F.col("b_source"))) & (F.col("upto") >= F.col("budget")),
                           "left")
                 .groupBy("mix_source").agg(F.min_by(F.struct("bin", "words", "n", "upto", "least", "most"), "bin").alias("at"))
                 .withColumnRenamed("mix_source", "b_source"))
        # the bins are disjoint and the ends of the range fall into different ones, so it shrinks to one key at last
        plan = cut_lineage(
            plan.join(found, F.col("mix_source").eqNullSafe(F.col("b_source")))
            .withColumn("go", F.col("at.bin").isNotNull() & open_)
            .select("mix_source", "source_size", "target", "epochs",
                    F.when(F.col("go"), F.col("budget") - (F.col("at.upto") - F.col("at.words")))
                    .otherwise(F.col("budget")).alias("budget"),
                    F.when(F.col("go"), F.col("at.least")).otherwise(F.col("lo")).alias("lo"),
                    F.when(F.col("go"), F.col("at.most")).otherwise(F.col("hi")).alias("hi"),
                    F.when(F.col("go"), F.col("at.n")).otherwise(F.col("rows_in")).alias("rows_in")))
    return plan


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their source's plan; ``mix_at`` places the key on [0, 1]. The plan has one row
    a source and is joined by the optimizer's choice (broadcast only if it measures small)."""
    p = plan.withColumnRenamed("mix_source", "p_source")
    return (rows.withColumn("mix_at", 1 - F.exp(-F.col("mix_key")))
            .join(p, F.col("mix_source").eqNullSafe(F.col("p_source"))).drop("p_source"))


def _copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with ``mix_copies``: complete epochs, and one more for those the fractional epoch selects."""
    known = _with_plan(rows, plan)
    plain = known.where("not (mix_at >= lo and mix_at <= hi)").withColumn(
        "mix_copies", F.col("epochs") + F.when((F.col("hi") >= 0) & (F.col("mix_at") < F.col("lo")), 1).otherwise(0))
    # the rows at the budget's end, with a number inside the partition they come from
    edge = cut_lineage(known.where("mix_at >= lo and mix_at <= hi").withColumn("mix_row", F.monotonically_increasing_id()))
    edge = edge.withColumn("mix_part", F.shiftright("mix_row", 33))
    key = ["mix_source", "mix_key", "mix_mark", "mix_part"]
    order = Window.partitionBy("mix_source").orderBy("mix_key", "mix_mark", "mix_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (edge.groupBy(*key, "mix_size", "budget").agg(F.count("*").alias("n"))
              .withColumn("before", F.coalesce(F.sum(F.col("mix_size") * F.col("n")).over(order), F.lit(0))))
    first = F.col("before") + F.col("mix_size") / 2 <= F.col("budget")
    more = F.floor(F.try_divide(F.col("budget") - F.col("before") - F.col("mix_size") / 2, "mix_size"))
    quota = F.when(first, F.least(F.col("n"), F.coalesce(more, F.col("n")) + 1)).otherwise(0)
    blocks = blocks.select(*[F.col(c).alias(f"b_{c}") for c in key], quota.alias("mix_quota"))
    own = Window.partitionBy(*key).orderBy("mix_row")
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    edge = (edge.withColumn("mix_nr", F.row_number().over(own)).join(blocks, same)
            .withColumn("mix_copies", F.col("epochs") + F.when(F.col("mix_nr") <= F.col("mix_quota"), 1).otherwise(0)))
    return plain.unionByName(edge.select(*plain.columns))


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, max_epochs: int) -> tuple[DataFrame, DataFrame]:
    slim = cut_lineage(_measured(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"),
                                             docs[source_col].alias("source")), "id", "text", "source").drop("text", "source"))
    return slim, _plan(slim, max_epochs)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(id_col, size, source_size, target, taken)`` for every row.

    ``size``: words of the text (null: 0). ``target``: words wanted from the row's
    source; null is a source of its own. ``taken``: words the mix takes of the row, repeats
    counted: its size times complete epochs, plus one size if the fractional
    epoch selects it; the last selected row is the one that ends nearest the
    target. Rows equal in id and text are interchangeable. An empty table gives no rows, a
    source without words a target of 0. Other columns are not read.
    """
    slim, plan = _mix(docs, id_col, text_col, source_col, max_epochs)
    out = _copies(slim, plan)
    return out.select(F.col("id").alias(id_col), F.col("mix_size").alias("size"), "source_size", "target",
                      (F.col("mix_copies") * F.col("mix_size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: the columns of ``docs``, every row as often as the mix takes it."""
    _, plan = _mix(docs, id_col, text_col, source_col, max_epochs)
    out = _copies(_measured(docs, id_col, text_col, source_col), plan)
    return (out.withColumn("mix_copy", F.explode(F.array_repeat(F.lit(0), F.col("mix_copies").cast("int"))))
            .select(*docs.columns))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS mark,
    greatest({LEAST_QUALITY}, 1 - (length(text) - length(translate(text, '{JUNK}', '')))::DOUBLE / nullif(length(text), 0)) AS q
  FROM documents),
k AS (SELECT *, -ln((('0x' || substr(mark, 1, {U_BITS // 4}))::BIGINT::DOUBLE + 0.5) / {1 << U_BITS}) / coalesce(q, 1.0) AS key FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
r AS (SELECT *, {MAX_EPOCHS} * source_size AS cap, {MAX_EPOCHS} * source_size / w AS ratio, sum(source_size) OVER () AS total FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
t AS (
  SELECT source, source_size, CASE WHEN ratio <= level THEN cap::DOUBLE
      ELSE max(CASE WHEN ratio > level THEN level END) OVER () * w END AS target
  FROM l),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least({MAX_EPOCHS}, floor(target / source_size)) END AS epochs FROM t),
b AS (SELECT *, CASE WHEN epochs < {MAX_EPOCHS} THEN target - epochs * source_size ELSE 0 END AS budget FROM e),
o AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs, b.budget,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN budget > 0 AND before + size / 2 <= budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""
