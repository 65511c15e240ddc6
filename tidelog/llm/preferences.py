"""Preference formatting (operator 5), with DataFrame functions only.

Two alternative conversations become one training record: their longest common turn prefix is rendered once as the prompt, and the
rest of either one as its completion, with the spans that carry loss (assistant texts with their end marks) beside it.

For a plain table of conversations, those that open with the same turn are alternatives: in order of their ids the first is
chosen over the second, the third over the fourth, and so on; the last of an odd number stays single, with an empty other side.
Ranks come from counts of id ranges (`RANGE` ids each) and ranks within a range, so no opening turn lands in one task however
common it is; texts are moved once by conversation and once by pair.

Defined cases: rows without a conversation id are ignored; equal rows of a conversation count once; turns are ordered by turn,
role and text, null turns first; null roles and texts count as empty.  Conversations that are equal turn by turn have empty
completions.  Only the four named columns are read.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import table

#: The marks of the rendered turns.
OPEN, CLOSE, LEARNT = "<|im_start|>", "<|im_end|>", "assistant"
RANGE = 4096


def conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): each conversation's turns in order, as structs of role and text."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    grouped = df.filter(F.col(conv).isNotNull()).groupBy(F.col(conv).alias("conv")).agg(F.sort_array(F.collect_set(one)).alias("t"))
    return grouped.select("conv", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def ranked(ids: DataFrame) -> DataFrame:
    """(conv, opening, rank) of (conv, opening): the place, from 0, of each whole-number id among those of its opening."""
    ranged = ids.withColumn("range", F.floor(F.col("conv") / RANGE))
    before = Window.partitionBy("opening").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("opening", "range").agg(F.count("*").alias("n")).select("opening", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("opening", "range").orderBy("conv")
    return ranged.withColumn("place", F.row_number().over(within) - 1).join(starts, ["opening", "range"]).select("conv", "opening", (F.col("start") + F.col("place")).alias("rank"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))), "")


def loss_spans(turns: Column) -> Column:
    """start:end, comma-joined, of every assistant text with its end mark in the rendered turns; code points, end exclusive."""
    head, tail = len(OPEN) + 1, len(CLOSE) + 1

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + head + F.length(t["role"])
        end = start + F.length(t["text"]) + (tail - 1)
        span = F.concat(start.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == LEARNT, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.array_join(F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step)["out"], ",")


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs, whose two columns hold arrays of turns, with n_common, prompt and both completions and masks in their place.
    A null side counts as no turns."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    rest = [c for c in pairs.columns if c not in (chosen, rejected)]
    both = pairs.select(*rest, F.coalesce(chosen, none).alias("_c"), F.coalesce(rejected, none).alias("_r"))
    shorter = F.least(F.size("_c"), F.size("_r"))
    same = F.when(shorter > 0, F.transform(F.sequence(F.lit(0), shorter - 1), lambda i: F.get("_c", i) == F.get("_r", i)))
    first = F.coalesce(F.array_position(same, False), F.lit(0))
    cut = both.withColumn("_n", F.when(first > 0, first - 1).otherwise(shorter).cast("int"))
    ends = {side: F.slice(col, F.col("_n") + 1, F.greatest(F.lit(0), F.size(col) - F.col("_n"))) for side, col in (("chosen", "_c"), ("rejected", "_r"))}
    return cut.select(
        *rest, F.col("_n").cast("long").alias("n_common"), rendered(F.slice("_c", F.lit(1), F.col("_n"))).alias("prompt"),
        rendered(ends["chosen"]).alias("chosen"), loss_spans(ends["chosen"]).alias("chosen_mask"), rendered(ends["rejected"]).alias("rejected"), loss_spans(ends["rejected"]).alias("rejected_mask"),
    )


def preference_records(df: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask) of a table of conversations."""
    convs = conversations(df)
    heads = df.filter("conv_id IS NOT NULL").select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    heads = heads.groupBy("conv").agg(F.min(F.struct("turn", "role", "text")).alias("h")).select("conv", F.md5(F.concat("h.role", F.lit("\x00"), "h.text")).alias("opening"))
    places = ranked(heads).withColumn("pair", F.floor(F.col("rank") / 2)).withColumn("second", F.col("rank") % 2)
    sided = convs.join(places, "conv").groupBy("opening", "pair").agg(*[
        F.max(F.when(F.col("second") == k, F.struct("conv", "turns"))).alias(side) for k, side in enumerate(("c", "r"))
    ])
    return format_pairs(sided.select(F.col("c.conv").alias("chosen_id"), F.col("r.conv").alias("rejected_id"), F.col("c.turns").alias("chosen"), F.col("r.turns").alias("rejected")))


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_records(table(spark, sf_dir, "conversations"))


OP5_SQL = """
WITH one AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS t FROM one GROUP BY conv_id
), ranks AS (
  SELECT conv_id, t, t[1] AS opening, row_number() OVER (PARTITION BY t[1] ORDER BY conv_id) - 1 AS rank FROM conv
), pairs AS (
  SELECT max(conv_id) FILTER (rank % 2 = 0) AS chosen_id, max(conv_id) FILTER (rank % 2 = 1) AS rejected_id,
         any_value(t) FILTER (rank % 2 = 0) AS c, coalesce(any_value(t) FILTER (rank % 2 = 1), []) AS r
  FROM ranks GROUP BY opening, rank // 2
), cut AS (
  SELECT *, CASE WHEN least(len(c), len(r)) = 0 THEN 0 ELSE
    coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] <> r[i])) - 1, least(len(c), len(r))) END AS n FROM pairs
), text AS (
  SELECT *, list_transform(c[1:n], lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)) AS p,
         list_transform(c[n + 1:], lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)) AS a,
         list_transform(r[n + 1:], lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)) AS b FROM cut
)
SELECT chosen_id, rejected_id, n::BIGINT AS n_common, array_to_string(p, '') AS prompt,
       array_to_string(a, '') AS chosen, array_to_string(b, '') AS rejected,
       coalesce(array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda k: c[n + k].role = 'assistant'), lambda k:
         (length(array_to_string(a[1:k - 1], '')) + 22)::VARCHAR || ':' || (length(array_to_string(a[1:k], '')) - 1)::VARCHAR), ','), '') AS chosen_mask,
       coalesce(array_to_string(list_transform(list_filter(range(1, len(b) + 1), lambda k: r[n + k].role = 'assistant'), lambda k:
         (length(array_to_string(b[1:k - 1], '')) + 22)::VARCHAR || ':' || (length(array_to_string(b[1:k], '')) - 1)::VARCHAR), ','), '') AS rejected_mask
FROM text
"""
