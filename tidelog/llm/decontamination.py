"""Benchmark decontamination by a prefix-filtered set join (operator 3), with DataFrame functions only.

Every benchmark item is cut into windows of `WINDOW` consecutive words (an item of fewer words is one window), and a window into
its shingles of `SHINGLE` words.  A document holds a window only if it holds all its shingles, so one shingle, the necessary prefix
under full containment, finds every candidate.  A first pass over the corpus counts how often each benchmark shingle stands in it;
the counts order the shingles, and a window's prefix is its rarest.  A window with a shingle that no document holds is dropped
unseen.  A second pass joins the places of the corpus with the prefixes alone.  Candidates must pass the positional bound (the
window, laid around the prefix shingle, starts inside the document) and the length bound (it ends there), and then equal the window
word by word.

Benchmark shingles and prefixes are broadcast if the benchmark's windows have at most `BROADCAST_BYTES` of text, a size that is
measured first: then no word of the corpus is shuffled.  Beyond, the first pass sums all shingles by hash, the second one joins places
(id, text hash, position, shingle hash; no texts) by a shuffle, and the candidates, which are few, meet the words of their documents
in another.  The tables of the benchmark are made by jobs while the result is being described.

Defined cases: null or wordless texts have no words and no hits.  Rows are told apart by id and text: repeated rows give repeated
results, and one id with two texts gives a result for each.  Benchmark rows without an id or words are ignored; one item id on
several rows is one item with the windows of all.  Only the id and text columns are read, so other columns cannot clash.  Texts of
any length are searched whole.  An empty benchmark leaves every document clean; empty documents give an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import ascii_lower, materialize, table

WINDOW = 10
SHINGLE = 5
BROADCAST_BYTES = 16 << 20
#: Fixed value: the characters that part words, after A-Z are lower-cased.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text; split() leaves an empty string before a leading and behind a trailing separator."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD)
    return F.transform(
        F.array(parts),
        lambda w: F.slice(w, F.when(F.get(w, F.lit(0)) == "", 2).otherwise(1), F.greatest(F.lit(0), F.size(w) - (F.get(w, F.lit(0)) == "").cast("int") - ((F.size(w) > 1) & (F.element_at(w, -1) == "")).cast("int"))),
    )[0]


def shingle_hash(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *[F.get(words, at + F.lit(k)) for k in range(length)])


def positions(n: Column, length: int) -> Column:
    """0 .. n - length, or nothing."""
    return F.when(n >= length, F.sequence(F.lit(0), n - F.lit(length))).otherwise(F.array().cast("array<int>"))


def marked(places: Column, k: int) -> Column:
    return F.transform(places, lambda i: F.struct(F.lit(k).alias("k"), i.alias("at")))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item_id, length, words) of every distinct window of every item."""
    given = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    return given.select("item_id", length.alias("length"), "w", F.explode(F.sequence(F.lit(0), F.size("w") - length)).alias("at")).select("item_id", "length", F.slice("w", F.col("at") + 1, F.col("length")).alias("words")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(id, text_key, n_words, n_hit, items) for every row of docs; items is the sorted array of item ids, as strings."""
    windows = materialize(item_windows(items, item_id, item_text, window), "windows")
    size = windows.agg(F.sum(F.length(F.array_join("words", " "))).alias("b")).first()["b"] or 0
    small = size <= BROADCAST_BYTES
    lengths = sorted(r["k"] for r in windows.select(F.least("length", F.lit(shingle)).alias("k")).distinct().collect())  # at most `shingle` values
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_key"), words_of(F.col(text_col)).alias("w"))
    rows = base.select("id", "text_key", F.size("w").alias("n_words"))
    if not lengths:
        return rows.select(F.col("id").alias(id_col), "text_key", F.col("n_words").cast("long"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))

    def shingled(df: DataFrame, words: str, keep: list[str], of: list[int], itself: bool = False) -> DataFrame:
        """df with a row for each place and shingle length in `of` (at), and the shingle's hash (key); itself: also a row at -1."""
        every = F.concat(*[marked(positions(F.size(words), k), k) for k in of]) if len(of) > 1 else positions(F.size(words), of[0])
        if itself:
            none = F.struct(F.lit(0).alias("k"), F.lit(-1).alias("at")) if len(of) > 1 else F.lit(-1)
            every = F.concat(F.array(none), every)
        exploded = df.select(*keep, words, F.explode(every).alias("place"))
        at = F.col("place.at") if len(of) > 1 else F.col("place")
        key = shingle_hash(F.col(words), at, of[0])
        for k in of[1:]:
            key = F.when(F.col("place.k") == k, shingle_hash(F.col(words), at, k)).otherwise(key)
        return exploded.select(*keep, words, at.alias("at"), F.when(at >= 0, key).alias("key") if itself else key.alias("key"))

    own = windows.withColumn("k", F.least("length", F.lit(shingle)))
    parts = [shingled(own.filter(F.col("k") == k), "words", ["item_id", "length"], [k]) for k in lengths]
    shingles = materialize(reduce(DataFrame.unionByName, parts).withColumnRenamed("at", "offset"), "shingles")

    # The prefix: each window's rarest shingle over all documents.
    known = shingles.select("key").distinct()
    seen = shingled(base, "w", [], lengths).select("key")
    if small:
        counts = seen.join(F.broadcast(known), "key", "left_semi").groupBy("key").agg(F.count("*").alias("times"))
    else:
        counts = seen.groupBy("key").agg(F.count("*").alias("times")).join(known, "key")
    counts = materialize(counts, "counts")
    ranked = shingles.join(counts, "key", "left").groupBy("item_id", "length", "words").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "key", "offset")).alias("rarest"))
    prefixes = materialize(ranked.filter("rarest.times > 0").select("item_id", "length", "words", "rarest.key", "rarest.offset"), "prefixes")

    start = F.col("at") - F.col("offset")
    inside = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    end = F.col("start") + F.col("length")
    equal = F.slice("w", F.col("start") + 1, F.col("length")) == F.col("words")
    if small:  # one pass writes the documents themselves (at = -1) and the hits
        places = shingled(base, "w", ["id", "text_key"], lengths, itself=True).withColumn("n_words", F.size("w"))
        found = places.join(F.broadcast(prefixes), "key", "left").filter((F.col("at") < 0) | inside).withColumn("start", start).filter((F.col("at") < 0) | equal)
        found = materialize(found.select("id", "text_key", "n_words", "at", "start", end.alias("end"), F.col("item_id").cast("string").alias("item")), "found")
        rows = found.filter("at < 0").select("id", "text_key", "n_words")
        hits = found.filter("at >= 0")
    else:
        places = shingled(base, "w", ["id", "text_key"], lengths).select("id", "text_key", F.size("w").alias("n_words"), "at", "key")
        found = places.join(prefixes, "key").filter(inside).select(F.col("id").alias("own"), F.col("text_key").alias("own_key"), start.alias("start"), "length", "item_id", "words").distinct()
        candidates = base.join(found, base["id"].eqNullSafe(found["own"]) & (base["text_key"] == found["own_key"]))
        hits = candidates.filter(equal).select("id", "text_key", "start", end.alias("end"), F.col("item_id").cast("string").alias("item"))
    per_doc = hits.groupBy("id", "text_key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["to"]))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")),
    )["n"]
    per_doc = per_doc.select(F.col("id").alias("hit_id"), F.col("text_key").alias("hit_key"), covered.cast("long").alias("n_hit"), "items")
    return rows.join(per_doc, rows["id"].eqNullSafe(per_doc["hit_id"]) & (rows["text_key"] == per_doc["hit_key"]), "left").select(
        F.col("id").alias(id_col), "text_key", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_share: float = 0.0) -> DataFrame:
    """The rows of docs of which at most `max_share` of the words lie in benchmark windows; all columns stay."""
    judged = decontaminate(docs, items, id_col, text_col).filter(F.col("n_hit") > F.col("n_words") * F.lit(max_share)).select(F.col(id_col).alias("_id"), F.col("text_key").alias("_key")).distinct()
    key = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(judged, docs[id_col].eqNullSafe(judged["_id"]) & (key == judged["_key"]), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP3_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT n FROM win
), places AS (
  SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, item_id, p, win.n FROM places JOIN win USING (words)
), word AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id
), item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
"""
