"""Benchmark decontamination by winnowing, in DataFrame operations only.

Every window of ``K + W - 1`` words keeps its least K-gram hash, so a span of that many
words shared with a benchmark item shares a fingerprint. Fingerprints of documents and items are
joined; only documents with a common fingerprint are looked at again, and only around the
places where one stands: each hit is extended to all windows that contain it, whose words are
compared whole. Items shorter than a window are one window of their own length; for
these lengths every gram of a document is a fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speclab.llm.common import LOWER, UPPER, ascii_lower, cut_lineage

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
K = 4
W = WINDOW - K + 1


def _words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPLIT), "")


def _from(array: Column, places: int) -> Column:
    return F.slice(array, places + 1, 1 << 30)


def _with_grams(df: DataFrame, m: int) -> DataFrame:
    """Add ``g<m>``: hashes of the m-grams of ``words`` (longer than the grams by a tail that is cut by use).

    One column a step: each array is made once and read twice."""
    if f"g{m}" in df.columns:
        return df
    if m == 1:
        return df.withColumn("g1", F.transform("words", lambda w: F.xxhash64(w)))
    half = m // 2 if m % 2 == 0 else m - 1
    df = _with_grams(df, half) if half > 1 or m == 3 else df
    if m == 2:
        return df.withColumn("g2", F.zip_with("words", _from(F.col("words"), 1), lambda a, b: F.xxhash64(a, b)))
    if m % 2 == 0:
        return df.withColumn(f"g{m}", F.zip_with(f"g{half}", _from(F.col(f"g{half}"), half), lambda a, b: F.xxhash64(a, b)))
    return df.withColumn(f"g{m}", F.zip_with(f"g{half}", _from(F.col("words"), half), lambda a, b: F.xxhash64(a, b)))


def _with_minima(df: DataFrame) -> DataFrame:
    """Add ``least``: the least K-gram hash of each window of words (W = 7 grams: 4 + 4 overlapping by one)."""
    df = _with_grams(df, K)
    df = df.withColumn("m2", F.zip_with(f"g{K}", _from(F.col(f"g{K}"), 1), lambda a, b: F.least(a, b)))
    df = df.withColumn("m4", F.zip_with("m2", _from(F.col("m2"), 2), lambda a, b: F.least(a, b)))
    df = df.withColumn("m7", F.zip_with("m4", _from(F.col("m4"), W - 4), lambda a, b: F.least(a, b)))
    return df.withColumn("least", F.slice("m7", 1, F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))))


def _with_prints(df: DataFrame, short: list[int]) -> DataFrame:
    """Add ``prints``: distinct fingerprints of ``words``, those of short windows included."""
    df = _with_minima(df)
    for m in short:
        df = _with_grams(df, m)
    grams = [F.slice(f"g{m}", 1, F.greatest(F.size("words") - (m - 1), F.lit(0))) for m in short]
    return df.withColumn("prints", F.array_distinct(F.concat("least", *grams)))


def _item_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(window, item)``: distinct windows of every item as space-joined words."""
    w = items.select(items[id_col].alias("item"), _words(items[text_col]).alias("words")).where(F.size("words") > 0)
    size = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(size - WINDOW, F.lit(0)))
    w = w.select("item", "words", F.explode(starts).alias("at"))
    return w.select(F.array_join(F.slice("words", F.col("at") + 1, WINDOW), " ").alias("window"), "item").distinct()


def _starts() -> Column:
    """Starts of the ``m``-word windows that contain a met gram of ``g`` words at one of the places ``ats``, each once."""
    last = F.size("words") - F.col("m")

    def around(i):
        first = F.greatest(i - (F.col("m") - F.col("g")), F.lit(0))
        return F.sequence(first, F.greatest(first, F.least(i, last)))        # a start past the last window is cut below

    return F.filter(F.array_distinct(F.flatten(F.transform("ats", around))), lambda i: i <= last)


def contaminated_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                       item_text: str = "text") -> DataFrame:
    """``(mark, n_hit, n_items, items)`` for every distinct text with a hit; ``mark``: MD5 of the text.

    ``n_hit``: words inside any occurrence of an item window; ``items``: sorted ids as strings.
    """
    windows = cut_lineage(_item_windows(items, item_id, item_text))
    length = F.size(F.split("window", " "))
    short = sorted(r["m"] for r in windows.select(length.alias("m")).where(f"m < {WINDOW}").distinct().collect())
    # fingerprints of the items: of whole windows their least gram, of short ones all their words
    own = windows.select("window").distinct().withColumn("words", F.split("window", " "))
    prints = None
    for m in [WINDOW, *short]:
        part = own.where(F.size("words") == m)
        part = _with_minima(part).select(F.explode_outer("least").alias("print")) if m == WINDOW else \
            _with_grams(part, m).select(F.element_at(f"g{m}", 1).alias("print"))
        prints = part if prints is None else prints.unionByName(part)
    prints = cut_lineage(prints.distinct())

    # explode_outer, not explode: for the latter the optimizer adds a filter on the array's size and pushes
    # it below the projections, where each array's definition is written out twice in the next
    text = F.coalesce(docs[text_col], F.lit(""))
    slim = docs.select(text.alias("t"))
    every = _with_prints(slim.select(F.xxhash64("t").alias("text_hash"), _words(F.col("t")).alias("words")), short)
    met = cut_lineage(every.select("text_hash", F.explode_outer("prints").alias("print")).join(prints, "print", "left_semi")
                      .select("text_hash").distinct())

    # extension: texts once each, windows around the places whose gram is a fingerprint of the items
    found = (slim.withColumn("text_hash", F.xxhash64("t")).join(met, "text_hash", "left_semi")
             .groupBy(F.md5("t").alias("mark")).agg(F.first("t").alias("t")))
    found = cut_lineage(found).withColumn("words", _words(F.col("t")))
    grams = found
    for m in sorted({K, *short}):
        grams = _with_grams(grams, m)
    places = None
    for m in [WINDOW, *short]:
        g = K if m == WINDOW else m
        whole = F.slice(f"g{g}", 1, F.greatest(F.size("words") - (g - 1), F.lit(0)))
        part = grams.select("mark", F.posexplode_outer(whole).alias("at", "print")).withColumn("m", F.lit(m)).withColumn("g", F.lit(g))
        places = part if places is None else places.unionByName(part)
    places = places.join(prints, "print", "left_semi").groupBy("mark", "m", "g").agg(F.collect_list("at").alias("ats"))
    # the starts are a column of their own, so that the explode above them copies no word array a row
    hits = (found.join(places, "mark").select("mark", "m", "words", _starts().alias("starts"))
            .select("mark", "m", "words", F.explode_outer("starts").alias("at"))
            .select("mark", "at", "m", F.array_join(F.slice("words", F.col("at") + 1, F.col("m")), " ").alias("window")))
    # a window that many items share is one hit; its items are joined to distinct (text, window) rows
    hits = cut_lineage(hits.where("window is not null").join(windows.select("window").distinct(), "window", "left_semi"))
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("at", "m")), lambda x: F.sequence(
        x["at"], x["at"] + x["m"] - 1))))
    n_hit = hits.groupBy("mark").agg(F.size(covered).cast("long").alias("n_hit"))
    ids = (hits.select("mark", "window").distinct().join(windows, "window")
           .groupBy("mark").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items")))
    return cut_lineage(n_hit.join(ids, "mark").select("mark", "n_hit", F.size("items").cast("long").alias("n_items"), "items"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(id_col, n_words, n_hit, n_items, items, contaminated)`` for every row of ``docs``.

    Null, empty and wordless texts have no words and no hits; null or wordless items have no
    window, a null item id is left out of ``items``. Repeated rows keep their multiplicity
    (texts are compared once), an item given twice counts once, other columns are not read; empty
    tables give no rows or no hits.
    """
    spans = contaminated_spans(docs, items, text_col, item_id, item_text)
    text = F.coalesce(docs[text_col], F.lit(""))
    words = F.split(text, _any_case())               # an empty string stands before or after a break at an end
    n_words = F.size(F.array_remove(words, "")).cast("long")
    own = docs.select(docs[id_col].alias("id"), F.md5(text).alias("mark"), n_words.alias("n_words"))
    zero = F.lit(0).cast("long")
    return own.join(spans, "mark", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                    item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any hit, all their columns."""
    spans = contaminated_spans(docs, items, text_col, item_id, item_text).select(F.col("mark").alias("dc_mark"))
    marked = docs.withColumn("dc_own", F.md5(F.coalesce(docs[text_col], F.lit(""))))
    return marked.join(spans, F.col("dc_own") == F.col("dc_mark"), "left_anti").select(*docs.columns)


def _any_case() -> str:
    """The pattern between words on texts that are not lower-cased yet: A-Z are letters too."""
    return SPLIT.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")


ORACLE = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS m, array_to_string(w[p + 1 : p + least(len(w), {WINDOW})], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - {WINDOW}, 0) + 1)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT rid, m, p, array_to_string(w[p + 1 : p + m], ' ') AS win
  FROM (SELECT rid, w, m, unnest(range(0, len(w) - m + 1)) AS p FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
h AS (SELECT rid, m, p, item_id FROM dw JOIN iw USING (win, m)),
c AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + m)) AS q FROM h) GROUP BY rid),
n AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN n USING (rid)
"""
