"""Spelling variants by a relational trie frontier.

Two words one edit apart agree either in the first half of the longer one or in its second half. Words therefore
stand in two tries, forwards and reversed, and each trie is asked for edits in a word's second half alone, where it
is sparse. A trie is an edge table (depth, node, next characters), a node being its prefix.

The frontier holds states (word, position, node, edits). A state without an edit lies on its word's own path. At each
level the states join the edge table on their node: one edit is spent on a greater character in place of the word's, or on
leaving the word's character out; after it only the word's own next character is followed. A state that has
used up its word on a node where a word ends is a neighbour. So every pair is found from its longer word, or from the smaller
of two equally long ones, and mirrored at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speclab.llm.common import ascii_lower, cut_lineage

LETTERS = r"[A-Za-zÀ-ÿ]+"
LEAST_CHARS = 6
LEAST_COUNT = 5
MORE = 5                # a form occurs at least so many times as often as its variants
DROP_EVERY = 199
LEVELS = 64             # trie levels walked one by one


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS,
          least_count: int = LEAST_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """``(word, n)``: distinct lower-cased letter runs of whole texts, with their occurrences.

    A run loses one character, picked by the hash, where ``drop_every`` divides the crc32 of id and run. A null
    text has no runs, a null id hashes as the empty one.
    """
    run = docs.select(docs[id_col].alias("i"), F.explode(F.regexp_extract_all(docs[text_col], F.lit(LETTERS), F.lit(0))).alias("r"))
    run = run.where(F.char_length("r") >= least_chars)
    # no upper case at all in most runs: they need not be translated character by character
    run = run.withColumn("r", F.when(F.lower("r") == F.col("r"), F.col("r")).otherwise(ascii_lower(F.col("r"))))
    h = F.crc32(F.concat(F.coalesce(F.col("i").cast("string"), F.lit("")), F.lit(":"), F.col("r")).cast("binary"))
    gone = (F.col("h") % F.char_length("r")).cast("int")
    cut = F.concat(F.substring("r", F.lit(1), gone), F.substring("r", gone + 2, F.char_length("r")))
    word = F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("r"))
    return (run.withColumn("h", h).select(word.alias("word")).where(F.char_length("word") >= least_chars)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count))


def _char(text: str, at: str):
    """Character ``at`` (from 0), empty beyond the end."""
    return F.expr(f"substring({text}, {at} + 1, 1)")


def _walk(tries: DataFrame, longest: int) -> DataFrame:
    """Pairs ``(way, a, b)`` of words of both tries one edit apart, by levels."""
    found, frontier = [], None
    depth = tries.agg(F.min("half").alias("d")).first()["d"]
    while depth <= longest:
        at = tries.where(F.col("size") >= depth)
        node = F.substring("w", 1, depth).alias("node")
        edges = at.select("way", node, _char("w", str(depth)).alias("c")).groupBy("way", "node").agg(F.collect_set("c").alias("next"))
        own = at.where((F.col("half") <= depth) & (F.col("size") > depth)).select("way", "w", F.lit(depth).alias("pos"), node)
        states = own.select("*", F.lit(0).alias("edits")).unionByName(
            own.select("way", "w", (F.col("pos") + 1).alias("pos"), "node", F.lit(1).alias("edits")))
        if frontier is not None:
            states = states.unionByName(frontier)
        step = states.join(edges, ["way", "node"]).withColumn("c", _char("w", "pos"))
        step = step.select("way", "w", "pos", "node", F.explode(
            F.when(F.col("edits") == 0, F.filter("next", lambda x: x > F.col("c")))
             .when(F.array_contains("next", F.col("c")), F.array("c"))).alias("c"))
        # beyond its end a word is followed by the empty character, which is on the nodes where words end
        step = cut_lineage(step.select("way", "w", (F.col("pos") + 1).alias("pos"), F.concat("node", "c").alias("node"),
                                       F.lit(1).alias("edits"), (F.col("c") == "").alias("ended")))
        found.append(step.where("ended").select("way", F.col("w").alias("a"), F.col("node").alias("b")))
        frontier = step.where("not ended").drop("ended")
        depth += 1
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _long_pairs(long: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` among words longer than ``LEVELS`` and one character less, all their positions at once, by digests.

    At most as many words share all characters but one as there are letters, so a group of equal rests is bounded.
    """
    rest = long.select("w", F.explode(F.sequence(F.lit(0), F.char_length("w") - 1)).alias("p"))
    before, after = F.expr("substring(w, 1, p)"), F.expr("substring(w, p + 2, length(w))")
    key = F.md5(F.concat(before, after))
    shorter = (rest.select("w", key.alias("k")).join(long.select(F.col("w").alias("b"), F.md5("w").alias("k")), "k").select(F.col("w").alias("a"), "b"))
    slot = rest.select("w", "p", key.alias("k"), _char("w", "p").alias("c"), F.char_length("w").alias("size"))
    other = slot.select("p", "k", "size", F.col("c").alias("d"), F.col("w").alias("b"))
    same = slot.join(other, ["p", "k", "size"]).where("c < d").select(F.col("w").alias("a"), "b")
    return shorter.unionByName(same)


def near_pairs(vocabulary: DataFrame, word_col: str = "word", levels: int = LEVELS) -> DataFrame:
    """``(word, near)`` for all ordered pairs of distinct words exactly one inserted, deleted or replaced character apart.

    Words of more than ``levels`` characters are compared by digests of their rests, which costs the square of
    a word's length. Null words take no part; repeated words count once.
    """
    own = cut_lineage(vocabulary.select(vocabulary[word_col].alias("w")).where("w is not null").distinct())
    longest = own.agg(F.max(F.char_length("w")).alias("n")).first()["n"]
    if longest is None:
        return own.select(F.col("w").alias("word"), F.col("w").alias("near"))
    size = F.char_length("w")
    short = own.where(size <= levels)
    # an edit at or after the half is met forwards, one before it backwards
    tries = cut_lineage(short.select(F.lit(1).alias("way"), "w", size.alias("size"), F.floor(size / 2).cast("int").alias("half"))
                        .unionByName(short.select(F.lit(-1).alias("way"), F.reverse("w").alias("w"), size.alias("size"),
                                                  (size - F.floor(size / 2)).cast("int").alias("half"))))
    pairs = None
    if not tries.isEmpty():
        pairs = _walk(tries, min(longest, levels))
        back = F.col("way") < 0
        pairs = pairs.select(F.when(back, F.reverse("a")).otherwise(F.col("a")).alias("a"),
                             F.when(back, F.reverse("b")).otherwise(F.col("b")).alias("b"))
    if longest > levels:
        more = _long_pairs(own.where(size >= levels))
        pairs = more if pairs is None else pairs.unionByName(more)
    return (pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")),
                                           F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("x"))
            .select("x.*").distinct())


def follow(forms: DataFrame) -> DataFrame:
    """``(word, root)``: the last word reached from each by its forms; ``forms`` holds ``(word, form)`` without circles.

    Each round doubles the way every word has gone.
    """
    at = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("later"))
        step = cut_lineage(at.join(ahead, "root", "left").select("word", F.coalesce("later", "root").alias("root"),
                                                                 F.col("later").isNotNull().alias("moved")))
        at = step.drop("moved")
        if step.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS,
             least_count: int = LEAST_COUNT, more: int = MORE, drop_every: int = DROP_EVERY) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``, one row a word of the texts.

    ``form``: the most frequent near word (ties: the smallest) where it occurs at least ``more`` times as often, else
    null. ``root``: where following the forms ends, the word itself without one. Nulls and repeated rows: see
    ``words``. Texts without such words and empty tables give no rows; other columns are not read.
    """
    count = cut_lineage(words(docs, id_col, text_col, least_chars, least_count, drop_every))
    near = near_pairs(count)
    other = count.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = cut_lineage(near.join(other, "near").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("o"), "near")).alias("first")))
    linked = cut_lineage(count.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("first.near").alias("near"), (-F.col("first.o")).alias("near_n")))
    good = F.col("near_n") >= more * F.col("n")
    formed = linked.select("word", "n", "n_near", F.when(good, F.col("near")).alias("form"), F.when(good, F.col("near_n")).alias("form_n"))
    root = follow(formed.where("form is not null"))
    return formed.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# crc32 by its byte table, made here bit by bit; a pair one character apart shares the rest beside one position
ORACLE = f"""
WITH tab AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS r FROM documents),
own AS (SELECT doc_id, r, count(*) AS n FROM runs WHERE length(r) >= {LEAST_CHARS} GROUP BY ALL),
hexed AS (SELECT r, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x FROM own),
hashed AS (
  SELECT r, n, xor(list_reduce(list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM hexed, tab),
w AS (
  SELECT CASE WHEN h % {DROP_EVERY} = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, n FROM hashed),
c AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
rest AS (
  SELECT word, p, substr(word, 1, p) || substr(word, p + 2) AS k, length(word) AS size
  FROM (SELECT word, unnest(range(length(word)))::INT AS p FROM c)),
near AS (
  SELECT a.word, b.word AS near FROM rest a JOIN rest b ON a.p = b.p AND a.k = b.k AND a.size = b.size AND a.word != b.word
  UNION SELECT word, k FROM rest WHERE k IN (SELECT word FROM c)
  UNION SELECT k, word FROM rest WHERE k IN (SELECT word FROM c)),
best AS (
  SELECT a.word, count(*) AS n_near, min(struct_pack(o := -b.n, w := near)) AS first
  FROM near a JOIN c b ON b.word = a.near GROUP BY a.word),
linked AS (
  SELECT c.word, c.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -first.o >= {MORE} * c.n THEN first.w END AS form,
    CASE WHEN -first.o >= {MORE} * c.n THEN -first.o END AS form_n
  FROM c LEFT JOIN best ON best.word = c.word),
path AS (
  WITH RECURSIVE p(word, last) AS (
    SELECT word, word FROM c
    UNION ALL SELECT p.word, l.form FROM p JOIN linked l ON l.word = p.last WHERE l.form IS NOT NULL)
  SELECT p.word, p.last AS root FROM p JOIN linked l ON l.word = p.last WHERE l.form IS NULL)
SELECT l.word, form, root, n, n_near, form_n::BIGINT AS form_n FROM linked l JOIN path ON path.word = l.word
"""
