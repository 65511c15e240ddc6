"""Weighted URL vocabulary with host and path rules (operator 2).

An Aho-Corasick automaton finds every vocabulary term of a URL in one pass.  A hit counts only between boundaries (the
neighbouring characters are no ASCII letters or digits).  One strict term rejects the URL, and so do several (`min_soft`) distinct
soft terms whose weights add up to `least`.  The terms are a parameter, a mapping or a table; the few that stand here are its default.
Rules (action, host, path) come before the vocabulary: a rule fits its host and all subdomains if the URL's path starts with
the rule's path; the longest host+path string wins (ties: block before allow).

Defined cases: a null URL, or one without `://`, has empty host and path, fits no rule that names a host, and is judged by its
text (null: no hits, allow).  Repeated rows are judged each for itself; extra input columns are ignored and never clash, as only
the id and URL columns are read.  URLs of any length are read whole.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import ascii_lower, table

#: The vocabulary (a parameter): strict terms reject alone, soft ones only together.
STRICT = ("adult", "porn", "porno", "xxx", "sexcam", "escort", "hentai", "nudes", "warez", "malware", "phishing")
SOFT = ("ads", "bet", "bets", "bonus", "casino", "cheap", "dating", "farm", "free", "hot", "loan", "lottery", "pills", "poker", "sexy", "slots", "spam", "torrent", "track", "viagra", "win")
MIN_SOFT, LEAST = 2, 2.0
#: Soft terms that weigh less than 1: common in clean URLs too, so that two of them alone reject nothing.
WEAK = {"farm": 0.5, "free": 0.75, "hot": 0.75, "track": 0.5, "win": 0.75}
#: The rules of the query's contract.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@dataclass(frozen=True)
class Vocabulary:
    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT
    min_soft: int = MIN_SOFT
    weights: tuple[tuple[str, float], ...] = tuple(WEAK.items())  # of soft terms; others weigh 1
    least: float = LEAST

    @classmethod
    def from_table(cls, terms: DataFrame, min_soft: int = MIN_SOFT, least: float = LEAST) -> Vocabulary:
        """Of a table (term, strict, weight), a null weight counting as 1.  It must fit a Python worker, as the automaton does; rows
        without a term are ignored, a repeated term is strict if any of its rows is and weighs its greatest weight."""
        rows = terms.filter("term IS NOT NULL AND term <> ''").groupBy(ascii_lower(F.col("term")).alias("term")).agg(F.max(F.coalesce("strict", F.lit(False))).alias("strict"), F.max(F.coalesce("weight", F.lit(1.0))).alias("weight")).collect()
        soft = sorted((r["term"], float(r["weight"])) for r in rows if not r["strict"])
        return cls(tuple(sorted(r["term"] for r in rows if r["strict"])), tuple(t for t, _ in soft), min_soft, tuple(soft), least)

    def rejects(self, hard: list[str], soft: list[str]) -> bool:
        weights = dict(self.weights)
        return bool(hard) or len(soft) >= self.min_soft and sum(weights.get(t, 1.0) for t in soft) >= self.least

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term in dict.fromkeys(x.lower() for x in (*self.soft, *self.strict) if x):
            found.add_word(term, (len(term), term))
        if len(found):
            found.make_automaton()
        return found

    def hits(self, automaton, url: str) -> set[str]:
        """The distinct terms of a lower-cased URL that stand between boundaries."""
        if not len(automaton):
            return set()
        return {term for end, (n, term) in automaton.iter(url) if (end - n < 0 or url[end - n] not in WORD) and (end + 1 >= len(url) or url[end + 1] not in WORD)}


def by_host(rules) -> dict[str, list[tuple[str, str]]]:
    """host -> [(path, action)], the longest path first."""
    out: dict[str, list[tuple[str, str]]] = {}
    for action, host, path in rules:
        out.setdefault(host.lower(), []).append((path, action))
    for own in out.values():
        own.sort(key=lambda x: (-len(x[0]), x[1] != "block"))
    return out


def rule_for(rules: dict[str, list[tuple[str, str]]], host: str, path: str) -> tuple[str | None, str | None]:
    """The longest rule that fits, and its action."""
    best: tuple[str | None, str | None] = (None, None)
    labels = host.split(".") if host else []
    for k in range(len(labels)):
        suffix = ".".join(labels[k:])
        for start, action in rules.get(suffix, ()):
            if path.startswith(start):
                if best[0] is None or len(suffix + start) > len(best[0]):
                    best = (suffix + start, action)
                break
    return best


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", vocabulary: Vocabulary | None = None, rules=()) -> DataFrame:
    """(id, host, path, rule, verdict, strict_terms, soft_terms) for every row of df, without a shuffle."""
    vocabulary, rules = vocabulary or Vocabulary(), by_host(rules)
    parts = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    url = F.col(url_col).cast("string")
    some = F.coalesce(url, F.lit(""))
    given = df.select(F.col(id_col), ascii_lower(some).alias("lowered"), ascii_lower(F.regexp_extract(some, parts, 1)).alias("host"), F.regexp_extract(some, parts, 2).alias("path"))
    schema = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType), T.StructField("host", T.StringType()), T.StructField("path", T.StringType()),
        T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("strict_terms", T.StringType()), T.StructField("soft_terms", T.StringType()),
    ])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, strict = vocabulary.automaton(), frozenset(x.lower() for x in vocabulary.strict)
        for batch in batches:
            ids, lowered, hosts, paths = batch.columns
            out: list[list] = [[], [], [], []]
            for text, host, path in zip(lowered.to_pylist(), hosts.to_pylist(), paths.to_pylist(), strict=True):
                terms = vocabulary.hits(automaton, text)
                hard, soft = sorted(terms & strict), sorted(terms - strict)
                rule, action = rule_for(rules, host, path)
                own = "block" if vocabulary.rejects(hard, soft) else "allow"
                for column, value in zip(out, (rule, action or own, ",".join(hard), ",".join(soft)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([ids, hosts, paths, *(pa.array(x, pa.string()) for x in out)], names=schema.names)

    return given.mapInArrow(judge, schema)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rules=RULES)


#: DuckDB SQL for the query's rows; the vocabulary stands as one pattern for each kind.
_BOUNDED = r"(^|[^a-z0-9]){}($|[^a-z0-9])"
OP2_SQL = """
WITH given AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages
), cut AS (
  SELECT page_id, translate(url, '{U}', '{L}') AS lowered,
         translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{U}', '{L}') AS host,
         regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM given
), rules(action, rhost, rpath) AS (VALUES {RULES}
), fits AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM cut JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
), terms AS (
  SELECT page_id, host, path, lowered,
         list_sort(list_filter([{STRICT}], lambda t: regexp_matches(lowered, '(^|[^a-z0-9])' || t || '($|[^a-z0-9])'))) AS hard,
         list_sort(list_filter([{SOFT}], lambda t: regexp_matches(lowered, '(^|[^a-z0-9])' || t || '($|[^a-z0-9])'))) AS soft FROM cut
)
SELECT t.page_id, t.host, t.path, f.rule,
       coalesce(f.action, CASE WHEN len(hard) > 0 OR (len(soft) >= {MIN} AND list_sum(list_transform(soft, lambda t: CASE t {WEAK} ELSE 1.0 END)) >= {LEAST}) THEN 'block' ELSE 'allow' END) AS verdict,
       array_to_string(hard, ',') AS strict_terms, array_to_string(soft, ',') AS soft_terms
FROM terms t LEFT JOIN fits f USING (page_id)
""".format(
    U="ABCDEFGHIJKLMNOPQRSTUVWXYZ", L="abcdefghijklmnopqrstuvwxyz", MIN=MIN_SOFT, LEAST=LEAST, WEAK=" ".join(f"WHEN '{t}' THEN {w}" for t, w in WEAK.items()),
    RULES=", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES), STRICT=", ".join(f"'{x}'" for x in STRICT), SOFT=", ".join(f"'{x}'" for x in SOFT),
)
