"""N-gram Jaccard self-join with signature trees (operator 9).

Documents are sets of word shingles; two link when their Jaccard index reaches num / den, which is above 0.  The result is exact (up
to equal 64-bit hashes of different shingles, or of different sets that share a shingle).

1. One pass counts how often each word occurs, in `SLOTS` hashed counters over the whole corpus, and makes each
   document's set size, set digest and bitmap.  Equal sets are one class from here on.
2. A second pass emits each class's necessary prefix: of n tokens the n - ceil(n num / den) + 1 that come first when the shingles
   are ordered by their rarest word.  Any linked pair shares a prefix token, and shared passages, whose words are frequent,
   stand at the end.  Members of a token group without another of fitting size leave it; groups with the same least member
   are one block, and a block that stands almost whole in a larger one joins it.  Token groups are only aggregated and joined,
   never sorted whole in a task.
3. Signature trees work inside the blocks: nodes hold OR-combined bitmaps and size ranges, and a dual traversal drops node pairs
   whose greatest possible overlap is too small.
4. Members with a candidate partner fetch their full sets, and the traversal is done again on these: a candidate pair is passed
   over if verified links connect it already, else its Jaccard index is computed.  No link between components is lost, and a
   group of near copies never emits all its pairs, only links that connect it.  Components of the links come last.
5. A block of more than `BLOCK` members is cut in parts, each of which is connected inside first.  Then one member stands for each
   component in a block (a block of near copies is down to about one for each part by now), and these are compared by pairs of
   parts.  What is still apart is compared in full, except within the largest component of the block, so that a block which is
   one component costs as many rows as it has members, and only one whose members do not link costs pairs of parts.

What is broadcast: the counters, `SLOTS` numbers, whatever the input.  Sets are fetched for candidate classes only.  Every step
is written to the shared folder by a job while the result is being made; what later steps do not read is deleted.

Defined cases: documents without words, or null text, have an empty set and link with nothing.  Repeated rows and rows sharing an
id each give a row.  A null id takes part; a component's id is its least non-null id.  Only the id and text columns are read, so
other columns cannot clash.  Texts of any length are shingled whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import discard, give_back, materialize, small_batches, table
from tidelog.llm.components import components
from tidelog.llm.shingles import Shingler, bitmap, digest
from tidelog.llm.signature_tree import group_candidates

SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
BLOCK = 2048
SEEN = 1 << 18


def _slots(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def describe(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, text_hash, n, key, bits) for every row, and rows with a null n that hold a task's word counters in bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(k), np.zeros(SLOTS, np.int64)
        names, id_type = ["id", "text_hash", "n", "key", "bits"], None
        for batch in batches:
            id_type, sizes, keys, maps, every = batch.column(0).type, [], [], [], []
            held = 0
            for text in batch.column(2):
                words = shingler.words(text.as_py())
                every.append(_slots(words))
                held += len(words)
                if held >= SLOTS:
                    counts += np.bincount(np.concatenate(every), minlength=SLOTS)
                    every, held = [], 0
                tokens = np.unique(shingler.grams(words))
                sizes.append(len(tokens))
                keys.append(digest(tokens) if len(tokens) else None)
                maps.append(bitmap(tokens).tobytes() if len(tokens) else None)
            if every:
                counts += np.bincount(np.concatenate(every), minlength=SLOTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(maps, pa.binary())], names=names)
        if id_type is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=names)
        del shingler, counts
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("t")).mapInArrow(run, f"id {kind}, text_hash bigint, n bigint, key binary, bits binary")


def word_counters(described: DataFrame) -> np.ndarray:
    """The counters of all tasks added up, in 16 partial sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(zlib.decompress(x.as_py()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["bits"])

    parts = described.filter("n IS NULL").select("bits").repartition(16).mapInArrow(add, "bits binary")
    total = np.zeros(SLOTS, np.int64)
    for row in parts.collect():  # at most 16 rows of SLOTS counters
        total += np.frombuffer(zlib.decompress(row[0]), np.int64)
    return total


def prefixes(df: DataFrame, text_col: str, k: int, num: int, den: int, counts: np.ndarray) -> DataFrame:
    """(token, key, own, step): the prefix tokens of each class, once for each task that holds it.  own: the first eight bytes of the
    key, as a number that sums cheaply; step: the class's size on a scale on which linked sizes differ by 1 at most."""
    scale = math.log(den / num) * (1 + 1e-9) if num < den else 0  # a little more, so that rounding parts no linked sizes
    levels = zlib.compress(np.floor(2 * np.log2(np.maximum(1, counts))).astype(np.int16).tobytes(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, level, seen = Shingler(k), np.frombuffer(zlib.decompress(levels), np.int16), set()
        for batch in batches:
            tokens_out, keys, steps = [], [], []
            for text in batch.column(0):
                words = shingler.words(text.as_py())
                grams = shingler.grams(words)
                if not len(grams):
                    continue
                tokens, first = np.unique(grams, return_index=True)
                key = digest(tokens)
                if key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                of_word = level[_slots(words)]
                rarest = of_word[: len(grams)]
                for j in range(1, len(words) - len(grams) + 1):
                    rarest = np.minimum(rarest, of_word[j : j + len(grams)])
                rank = np.lexsort((tokens, rarest[first]))
                n = len(tokens)
                own = tokens[rank[: n + (-num * n // den) + 1]]
                tokens_out.append(own.view(np.int64))
                keys += [key] * len(own)
                steps += [int(math.log(n) / scale) if scale else n] * len(own)
            if keys:
                own = np.frombuffer(b"".join(k[:8] for k in keys), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens_out)), pa.array(keys, pa.binary()), pa.array(own), pa.array(steps, pa.int32())], names=["token", "key", "own", "step"])
        del shingler, seen
        give_back()

    return df.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "token bigint, key binary, own bigint, step int")


def blocks_of(postings: DataFrame) -> DataFrame:
    """(block, key): the members of the token groups, those without another class of fitting size left out.  Groups with the same
    least member make one block, so that near copies, which share most of their prefix, meet once and not once a token.  A token's
    rows only meet in partial sums and in joins whose large partitions can be split; the windows run over a row for each size."""
    shared = postings.groupBy("token").agg(F.min("own").alias("low"), F.max("own").alias("high")).filter("low <> high").select("token")
    near = materialize(postings.join(shared, "token", "left_semi"), "near")
    sizes = near.groupBy("token", "step").agg(F.min("own").alias("low"), F.max("own").alias("high"))
    order = Window.partitionBy("token").orderBy("step")
    fitting = sizes.withColumn("below", F.lag("step").over(order)).withColumn("above", F.lead("step").over(order))
    fitting = fitting.filter("low <> high OR below >= step - 1 OR above <= step + 1")
    fitting = fitting.select("token", "step", F.min("low").over(Window.partitionBy("token")).alias("block"))
    return near.join(fitting, ["token", "step"]).select("block", "key").distinct()


def merged(members: DataFrame) -> DataFrame:
    """members (block, key) with fewer blocks: one of which at least three quarters have the same largest block joins that block.  The
    members of a block stay together, so no pair is lost; a family of near copies whose least member lacks some of the tokens
    would else stand in two or more blocks that are nearly equal."""
    sizes = members.groupBy("block").agg(F.count("*").alias("size"))
    main = members.join(sizes, "block").groupBy("key").agg(F.max(F.struct("size", "block")).alias("main")).select("key", "main.block").withColumnRenamed("block", "main")
    votes = members.join(main, "key").groupBy("block", "main").agg(F.count("*").alias("votes"))
    into = votes.groupBy("block").agg(F.max(F.struct("votes", "main")).alias("most"), F.sum("votes").alias("size"))
    into = into.filter("4 * most.votes >= 3 * size AND most.main <> block").select("block", F.col("most.main").alias("into"))
    return members.join(into, "block", "left").select(F.coalesce("into", "block").alias("block"), "key").distinct()


def parts_of(members: DataFrame) -> DataFrame:
    """members with part and parts: blocks over BLOCK members are cut by a hash of the key."""
    large = members.groupBy("block").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts")).filter("parts > 1").withColumnRenamed("block", "big")
    own = members.join(large, members["block"] == large["big"], "left").drop("big").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return own.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))


def dealt(members: DataFrame) -> DataFrame:
    """(block, i, j, side, key, label): each member goes to every pair of parts of its block with its own."""
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(F.least("part", other).alias("i"), F.greatest("part", other).alias("j"), F.when(F.col("part") <= other, 0).otherwise(1).alias("side")))
    return parts_of(members).select("block", "key", "label", F.explode(pairs).alias("p")).select("block", "p.i", "p.j", "p.side", "key", "label")


def dealt_across(left: DataFrame, right: DataFrame, turn: int) -> DataFrame:
    """dealt() for the pairs of a left and a right member of a block; turn keeps several calls apart."""
    sides = []
    for side, (own, other) in enumerate(((left, right), (right, left))):
        counts = other.groupBy("block").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("others"))
        each = parts_of(own).join(counts, "block").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        i, j = ("part", "other") if side == 0 else ("other", "part")
        sides.append(each.select("block", (F.lit(-1 - turn) - 2 * F.col(i)).cast("int").alias("i"), F.col(j).alias("j"), F.lit(side).alias("side"), "key", "label"))
    return sides[0].unionByName(sides[1])


def by_group(rows: DataFrame, columns: list[str], work: Callable[[list[list]], list[tuple]], names: list[str], schema: str) -> DataFrame:
    """work() on the columns of each (block, i, j), whose rows come together; a task holds one group and one Arrow batch."""
    ordered = rows.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j").select("block", "i", "j", *columns)
    kinds = [pa.binary() if n in ("key", "label", "u", "v") else pa.int64() if n == "block" else pa.int32() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] | None = None

        def packed(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            given = [c.to_pylist() for c in batch.columns]
            if not given[0]:
                continue
            if held is not None:
                given = [h + c for h, c in zip(held, given, strict=True)]
            marks, start, out = list(zip(*given[:3], strict=True)), 0, []
            for k in range(1, len(marks)):
                if marks[k] != marks[k - 1]:
                    if k - start > 1:
                        out += work([c[start:k] for c in given])
                    start = k
            held = [c[start:] for c in given]  # the last group may go on in the next batch
            if out:
                yield packed(out)
        if held is not None and len(held[0]) > 1 and (out := work(held)):
            yield packed(out)
        give_back()

    return ordered.mapInArrow(run, schema)


def with_partners(members: DataFrame, num: int, den: int) -> DataFrame:
    """The members (block, i, j, side, key, label) that have a candidate partner of another label by the bitmaps in their signature
    trees."""

    def work(group: list[list]) -> list[tuple]:
        blocks, i, j, sides, keys, labels, sizes, maps = group
        found, (_, label) = np.zeros(len(keys), bool), np.unique(np.array(labels, object), return_inverse=True)
        for a, b in group_candidates(maps, np.array(sizes, np.int64), np.array(sides), num, den):
            apart = label[a] != label[b]
            found[a[apart]] = found[b[apart]] = True
        return [(blocks[0], i[0], j[0], sides[x], keys[x], labels[x]) for x in np.nonzero(found)[0].tolist()]

    return by_group(members, ["side", "key", "label", "n", "bits"], work, ["block", "i", "j", "side", "key", "label"], "block bigint, i int, j int, side int, key binary, label binary")


def links_of(members: DataFrame, num: int, den: int) -> DataFrame:
    """Links (u, v) that connect what links in each group: candidate pairs are verified on the full sets, those already connected
    by verified links (equal labels) are passed over, and every verified link joins two parts, so a group gives fewer links than
    members."""

    def work(group: list[list]) -> list[tuple]:
        _, _, _, sides, keys, labels, sets = group
        sets = [np.frombuffer(s, np.uint64) for s in sets]
        sizes = np.array([len(s) for s in sets], np.int64)
        (_, part), out = np.unique(np.array(labels, object), return_inverse=True), []
        for a, b in group_candidates([bitmap(s).tobytes() for s in sets], sizes, np.array(sides), num, den):
            for x in np.unique(a).tolist():
                others = b[a == x]
                others = others[part[others] != part[x]]
                if not len(others):
                    continue
                every = np.concatenate([sets[y] for y in others])
                at = np.minimum(np.searchsorted(sets[x], every), len(sets[x]) - 1)
                both = np.add.reduceat((sets[x][at] == every).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[others])[:-1]]))
                for y in others[den * both >= num * (sizes[x] + sizes[others] - both)].tolist():
                    if part[x] != part[y]:
                        part[part == part[y]] = part[x]
                        out.append((keys[x], keys[y]))
        return out

    return by_group(members, ["side", "key", "label", "tokens"], work, ["u", "v"], "u binary, v binary")


def sets_of(df: DataFrame, id_col: str, text_col: str, k: int, wanted: DataFrame) -> DataFrame:
    """(key, tokens) of the wanted classes (key, first, first_hash), from the documents with those ids and text hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in batches:
            found = [(k.as_py(), np.unique(shingler.grams(shingler.words(t.as_py())))) for k, t in zip(*batch.columns, strict=True)]
            found = [(k, s.tobytes()) for k, s in found if digest(s) == k]  # texts under one id may share a hash
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([s for _, s in found], pa.binary())], names=["key", "tokens"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    chosen = rows.join(wanted, rows["id"].eqNullSafe(wanted["first"]) & (F.xxhash64(rows["t"]) == wanted["first_hash"])).select("key", "t")
    return chosen.mapInArrow(run, "key binary, tokens binary")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id) for every row of df."""
    if not 0 < num <= den:
        raise ValueError("the threshold num / den must lie above 0 and not above 1")
    small_batches(df.sparkSession)
    described = materialize(describe(df, id_col, text_col, k), "described")
    docs = described.filter("n IS NOT NULL")
    counts = word_counters(described)
    postings = materialize(prefixes(df, text_col, k, num, den, counts), "postings")  # read twice, and costly to make
    blocks = materialize(blocks_of(postings), "blocks")
    discard(postings)
    members = materialize(merged(blocks), "members")
    discard(blocks)
    heads = materialize(docs.filter("key IS NOT NULL").groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first"), F.first("n").alias("n"), F.first("bits").alias("bits")).select("key", "first.id", "first.text_hash", "n", "bits"), "heads")

    def linked(groups: DataFrame) -> DataFrame:
        """The links (u, v) inside groups (block, i, j, side, key, label)."""
        grouped = materialize(groups.join(heads.select("key", "n", "bits"), "key"), "grouped")
        partners = materialize(with_partners(grouped, num, den), "partners")
        wanted = partners.select("key").distinct().join(heads.select("key", F.col("id").alias("first"), F.col("text_hash").alias("first_hash")), "key")
        sets = sets_of(df, id_col, text_col, k, wanted).dropDuplicates(["key"])
        links = materialize(links_of(partners.join(sets, "key"), num, den), "links")
        discard(grouped, partners)
        return links

    def labelled(big: DataFrame, labels: DataFrame) -> DataFrame:
        named = big.join(labels.withColumnRenamed("node", "key"), "key", "left")
        return materialize(named.select("block", "key", F.coalesce("label", "key").alias("label")), "labelled")

    cut = parts_of(members)
    links = linked(cut.select("block", F.col("part").alias("i"), F.col("part").alias("j"), F.lit(0).alias("side"), "key", F.col("key").alias("label")))
    big = cut.filter("parts > 1").select("block", "key")
    if big.limit(1).count():
        # One member of each component stands for it.
        own = labelled(big, components(links))
        stand_in = own.groupBy("block", "label").agg(F.min("key").alias("key"))
        links = links.unionByName(linked(dealt(stand_in.select("block", "key", "label"))))
        # Pairs of different components of which one stood in for nothing.  The largest component of a block is spared against itself.
        now = labelled(big, components(links))
        largest = now.groupBy("block", "label").agg(F.count("*").alias("size")).groupBy("block").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.count("*").alias("labels")).filter("labels > 1")
        apart = now.join(largest, "block").join(stand_in.select("block", "key", F.lit(True).alias("stood")), ["block", "key"], "left")
        apart = materialize(apart.select("block", "key", "label", (F.col("label") == F.col("main")).alias("main"), F.coalesce("stood", F.lit(False)).alias("stood")), "apart")
        if apart.limit(1).count():
            columns = ("block", "key", "label")
            rest = dealt_across(apart.filter("NOT main AND NOT stood").select(*columns), apart.select(*columns), 0)
            links = links.unionByName(linked(rest.unionByName(dealt_across(apart.filter("NOT main").select(*columns), apart.filter("main AND NOT stood").select(*columns), 1))))
    labels = components(links)

    named = heads.select("key", "id").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = named.groupBy("label").agg(F.min("id").alias("component"))
    named = named.join(least, "label").select("key", "component")
    discard(members)
    return docs.select("id", "n", "key").join(named, "key", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id")
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """df with one row of each component: the one with the least id, a null id last, then by its text's hash and its place.  Rows are
    told apart by number, so repeated rows are reduced to one, and a text stays whatever other texts stand under its id.  Rows
    without words are components of their own.  All columns stay."""
    row = "row"
    while row in df.columns:
        row += "_"
    numbered = materialize(df.withColumn(row, F.monotonically_increasing_id()), "numbered")  # written, so that numbers hold
    found = jaccard_components(numbered, row, text_col, k, num, den).select(F.col(row).alias("own"), F.col("component_id").alias("component"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "own").alias("place")
    places = numbered.select(F.col(row).alias("own"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    first = found.join(places, "own").groupBy("component").agg(F.min(order).alias("place")).select(F.col("place.own").alias("first"))
    return numbered.join(first, numbered[row] == first["first"], "left_semi").drop(row)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)
