"""Document fingerprints by winnowing (operator 4), with DataFrame functions only.

Tokens, A-Z in lower case, are runs of up to `TOKEN` letters, digits and marks of scripts that part words; anything else that is no
white space is a token by itself: signs, the characters of unspaced scripts (Chinese, Japanese, Thai and the like), and those of
longer runs.  What a token is thus never depends on where a run began to be cut.  A cyclic-polynomial hash covers every `K` tokens
in a row: the value that rolling gives, rot^(K-1)(h1) xor ... xor hK, made from the K shifted token hashes, which for so small a K
is as cheap as rolling and keeps to built-in functions.  Each window of `W` hashes keeps its minimum, the rightmost of equal ones,
and the kept (hash, position) pairs are the fingerprint.  Any run of at least K + W - 1 tokens that two texts share leaves a common
hash.

A kept pair is one number, hash * 2^31 + (2^31 - 1 - position): the least number of a window is its least hash, at the rightmost
place.  The likeness of two fingerprints is the Jaccard index of their hash sets, whatever the positions.

Next documents: (id, text hash) pairs are written once; a sample of them gives bounds of up to `BUCKETS` ranges of about even counts,
whatever the ids are, and documents meet in the range of their pair.  The one that ends a range is sent also to the range that needs
it as a successor.  Rows that repeat more often than a range should hold (`ROWS`, or more if there are more rows than `BUCKETS` such
ranges) are counted first and go as one row with its count, which is unfolded at the end.  The texts are shuffled once.  Bounds, range
ends and such repeated pairs, at most `BUCKETS` each, are all that is broadcast.  These small tables are made by jobs while the result is being described.

Defined cases: null text counts as empty; empty texts have an empty fingerprint, and two empty fingerprints are alike to degree 1,
an empty and another to degree 0.  A text of fewer than K tokens has one hash, of fewer than W hashes one window.  Documents are
ordered by descending id (any whole number), then by descending 64-bit hash of the text; null ids come last.  Repeated rows follow
one another, each with a row of its own.  A lone
document is its own successor.  Only the id and text columns are read; texts of any length (below 2^31 tokens) are read whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import ascii_lower, materialize, table

TOKEN, K, W = 32, 3, 6
ROWS, BUCKETS, DRAWN = 256, 1 << 16, 4
#: ASCII letters and digits, and from Latin-1 letters to U+1FFF all but Thai, Lao, Tibetan, Myanmar and Khmer.
_OF_WORD = r"[0-9A-Za-z\u00C0-\u0DFF\u10A0-\u177F\u1800-\u1FFF]"
TOKENS = rf"(?<!{_OF_WORD}){_OF_WORD}{{1,{TOKEN}}}+(?!{_OF_WORD})|\S"
PLACES = (1 << 31) - 1


def let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def rotate(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x


def gram_hashes(tokens: Column, k: int) -> Column:
    """The packed (hash, position) of every k tokens in a row."""
    hashes = F.transform(tokens, lambda t: F.xxhash64(t))

    def one(h: Column, i: Column) -> Column:
        rolled = None
        for j in range(k):
            part = rotate(F.coalesce(F.get(h, i + j), F.lit(0).cast("long")), k - 1 - j)
            rolled = part if rolled is None else rolled.bitwiseXOR(part)
        return F.shiftleft(F.shiftrightunsigned(rolled, 32), 31) + (F.lit(PLACES) - i)

    return let(hashes, lambda h: F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(h) - k)), lambda i: one(h, i))).otherwise(F.array().cast("array<bigint>")))


def fingerprint(text: Column, k: int = K, w: int = W) -> Column:
    """The kept pairs of a text, as packed numbers in order of position."""
    tokens = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TOKENS), F.lit(0))

    def kept(p: Column) -> Column:
        ends = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(p) - w))
        return F.when(F.size(p) > 0, F.array_distinct(F.transform(ends, lambda i: F.least(*[F.get(p, i + j) for j in range(w)])))).otherwise(F.array().cast("array<bigint>"))

    return let(gram_hashes(tokens, k), kept)


def shown(pairs: Column) -> Column:
    """hash:position, comma-joined."""
    return F.array_join(F.transform(pairs, lambda x: F.concat(F.hex(F.shiftright(x, 31)), F.lit(":"), (F.lit(PLACES) - x.bitwiseAND(F.lit(PLACES))).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    hashes = lambda p: F.transform(p, lambda x: F.shiftright(x, 31))
    return let(F.struct(hashes(a).alias("a"), hashes(b).alias("b")), lambda s: F.coalesce(F.try_divide(F.size(F.array_intersect(s["a"], s["b"])), F.size(F.array_union(s["a"], s["b"]))), F.lit(1.0)))


def place_of(bounds: Column, n: int, key: Column) -> Column:
    """How many of the n sorted bounds are not above the key, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= key, at + step).otherwise(at))


def even_ranges(keys: DataFrame, names: list[str], rows: int) -> tuple[Column, Column]:
    """(the range of a row, its key) as columns over the named columns of any frame: ranges of about `rows` rows of keys."""
    n = keys.count()
    buckets = max(1, min(BUCKETS, -(-n // rows)))
    key = F.struct(*names)
    kind = f"array<struct<{','.join(f'{c}:{t}' for c, t in keys.select(*names).dtypes)}>>"
    drawn = keys.sample(fraction=min(1.0, DRAWN * buckets / max(1, n)), seed=4).agg(F.sort_array(F.collect_list(key)).alias("drawn"))
    picked = drawn.select(F.to_json(F.array_distinct(F.filter("drawn", lambda x, i: i % DRAWN == DRAWN - 1)), {"ignoreNullFields": "false"}).alias("bounds")).first()["bounds"]
    bounds = F.from_json(F.lit(picked), kind)  # a constant of at most BUCKETS bounds
    return place_of(bounds, buckets + DRAWN, key), key


def with_next(df: DataFrame, keys: DataFrame, names: list[str], columns: list[str], rows: int = ROWS) -> DataFrame:
    """df with next_<column> of the following row in descending order of the named columns, nulls last; after the last row comes the
    first.  keys: the written named columns of df."""
    place, key = even_ranges(keys, names, rows)
    ends = keys.select(place.alias("at"), key.alias("key")).groupBy("at").agg(F.max("key").alias("end"))
    every = Window.orderBy("at")
    route = ends.select("at", F.coalesce(F.lead("at").over(every), F.min("at").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"), "end")
    route = materialize(route, "route")
    # explode() keeps the optimizer from putting the search for the range in place of "own" on the other side of the join
    routed = df.withColumn("own", F.explode(F.array(place))).join(F.broadcast(route), (F.col("own") == F.col("at")) & reduce(lambda x, y: x & y, [df[c].eqNullSafe(F.col(f"end.{c}")) for c in names]), "left")
    here = F.struct(F.col("own").alias("b"), F.lit(0).alias("extra"))
    sent = routed.select(*df.columns, F.explode(F.when(F.col("to").isNull(), F.array(here)).otherwise(F.array(here, F.struct(F.col("to").alias("b"), F.lit(1).alias("extra"))))).alias("sent"))
    follow = Window.partitionBy("sent.b").orderBy(F.col("sent.extra"), *[F.col(c).desc_nulls_last() for c in names])
    return sent.select(*df.columns, "sent", *[F.lead(c).over(follow).alias(f"next_{c}") for c in columns]).filter("sent.extra = 0").drop("sent")


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS) -> DataFrame:
    """(id, n_chars, edited, fingerprints as arrays, likenesses): each document against its edited text and the next document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("t"))
    keys = materialize(given.select("id", "h"), "keys")
    many = max(rows, -(-keys.count() // BUCKETS))
    often = materialize(keys.groupBy("id", "h").agg(F.count("*").alias("copies")).filter(F.col("copies") > many), "often")  # fewer than BUCKETS
    if often.limit(1).count():
        is_often = given["id"].eqNullSafe(often["id"]) & (given["h"] == often["h"])
        folded = given.join(F.broadcast(often), is_often, "left_semi").groupBy("id", "h", "t").agg(F.count("*").alias("copies"))
        given = given.join(F.broadcast(often), is_often, "left_anti").withColumn("copies", F.lit(1).cast("long")).unionByName(folded)
        keys = materialize(keys.join(F.broadcast(often), keys["id"].eqNullSafe(often["id"]) & (keys["h"] == often["h"]), "left_anti").unionByName(often.select("id", "h")), "keys")
    else:
        given = given.withColumn("copies", F.lit(1).cast("long"))
    both = with_next(given.withColumn("f", fingerprint(F.col("t"))), keys, ["id", "h"], ["t", "f"], rows)
    # The last of repeated rows is followed by the next text, the others by their own.
    turn = lambda t, f, n: F.struct(F.col(t).alias("next_t"), F.col(f).alias("next_f"), n.alias("times"))
    both = both.select("id", "t", "f", F.explode(F.when(F.col("copies") > 1, F.array(turn("next_t", "next_f", F.lit(1).cast("long")), turn("t", "f", F.col("copies") - 1))).otherwise(F.array(turn("next_t", "next_f", F.lit(1).cast("long"))))).alias("x")).select("id", "t", "f", "x.*")
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), n - half), F.substring(F.col("next_t"), F.lit(1), half))
    out = both.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "f", "next_f", "times")
    out = out.withColumn("e", fingerprint(F.col("edited")))
    out = out.select(F.col("id").alias(id_col), "n_chars", "edited", F.col("f").alias("pairs"), F.col("e").alias("edited_pairs"), likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("next_f")).alias("near_next"), "times")
    return out.withColumn("times", F.explode(F.when(F.col("times") > 1, F.sequence(F.lit(1), F.col("times").cast("int"))).otherwise(F.array(F.lit(1))))).drop("times")


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare_with_edited(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("pairs")).alias("fingerprint"), shown(F.col("edited_pairs")).alias("edited_fingerprint"), "near_edited", "near_next")
