"""Personal data with offset-preserving deobfuscation (operator 8).

Plain identifiers are found in the source text itself.  A second pass runs over a normalised text that a chain of transducers
makes, each of which keeps for every output character the source span it stands for:

1. characters: homoglyphs, full-width forms and foreign digits become ASCII, invisible characters vanish;
2. spelled digits: in every run of number words ("four nine double one", also German, French, Spanish), "plus", "dot", "point",
   "dash" and digits, words become what they stand for and close up; whether that is an identifier is for the patterns to say.
   A lone "one" or "un" (`ARTICLES`) right behind a plain identifier stays prose;
3. disguises: "[at]", "(dot)", "_at_" and their like become "@" and "."; bare " at " and " dot " only inside one whole
   `name at host dot domain`, each part of which may be plain, bracketed or bare.  A bare "at" needs a disguised dot beside it,
   or capitals (AT) before a whole host, so that prose with the word "at" stays prose.

Identifiers of the normalised text are mapped back to source characters; those that overlap no plain span, or hold one of
their kind and more, are added.
The transducers are skipped for texts that show none of their triggers: there the normalised text equals the source.

Defined cases: null text counts as empty (no spans).  Whole texts of any length are read; every scan is linear.  Each row is
judged for itself, so repeated rows give repeated results; only the id and text columns are read.  Offsets are code points, the
end exclusive.  Spans are ordered by start, then by kind in the order of `KINDS`.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import small_batches, table

KINDS = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate(KINDS)}
Span = tuple[int, int, str]

# The contract's patterns.  Look-behinds and possessive repeats only spare searches that cannot succeed.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def find_plain(text: str) -> list[Span]:
    """The plain identifiers, leftmost and non-overlapping for each kind."""
    out: list[Span] = []
    if "@" in text:
        last = 0
        for m in DOMAIN.finditer(text):
            start = at = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end(), "email"))
                last = m.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(digits_of(m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


# --- transducers -----------------------------------------------------------------------------------------------------------

#: Look-alikes outside the compatibility forms (source: the Unicode confusables idea, the usual Cyrillic and Greek letters).
LOOKALIKE = dict(zip("аеорсухіјѕԁһкмтвнАВЕКМНОРСТХІЈЅ", "aeopcyxijsdhkmtbhABEKMHOPCTXIJS", strict=True)) | dict(zip("αορνικτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aopviktABEZHIKMNOPTYX", strict=True))
SIGNS = dict.fromkeys("‐‑‒–—−﹣", "-") | {"․": ".", "。": ".", "｡": ".", "﹒": ".", "﹫": "@", "⁺": "+", "﹢": "+", " ": " ", " ": " ", " ": " ", " ": " "}
INVISIBLE = frozenset("​‌‍⁠﻿­᠎")
NUMBERS = {
    "0": "zero null zéro cero", "1": "one eins eine un une uno", "2": "two zwei zwo deux dos", "3": "three drei trois tres", "4": "four vier quatre cuatro",
    "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete", "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
SPELLED = {w: d for d, words in NUMBERS.items() for w in words.split()} | {"oh": "0"}
REPEATS = {"double": 2, "triple": 3}
MARKS = {"plus": "+", "dot": ".", "point": ".", "dash": "-"}
#: Number words that are articles or pronouns too.
ARTICLES = frozenset("one un une uno".split())
_WORDS = "|".join(sorted((*SPELLED, *MARKS, *REPEATS), key=len, reverse=True))
_TOKEN = rf"(?:(?:{_WORDS})(?!\w)|[0-9]++(?![\w]|\.[0-9]))"
SPELLED_RUN = re.compile(rf"(?<!\w)(?:(?:{_WORDS})(?!\w)|(?<![0-9]\.)[0-9]++(?![\w]|\.[0-9]))(?:[ ,-]{{1,2}}{_TOKEN})++", re.I)
RUN_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+", re.I)
#: A word without which no run has anything to undo.
TRIGGER = re.compile(rf"(?<!\w)(?:{_WORDS})(?!\w)", re.I)
BRACKETED = re.compile(r"(?:(?<!\s)\s++)?[\[({<]\s*(at|dot|point|punkt)\s*[\])}>]\s*|(?<=[^\W_])[_*~]+(at|dot)[_*~]+(?=[^\W_])", re.I)
#: Stand for bracketed signs until the bare ones are judged; no text holds them, as `one_char` replaces these non-characters.
AT, DOT = "\ufdd0", "\ufdd1"
ANY_AT = re.compile(rf"(?<! ) ++at(?= )|{AT}|@", re.I)
#: Host names never begin with these words; prose does ("at the dot com").  Labels and names beside a bare dot are none of `ARTICLE`.
ARTICLE = "the|a|an|this|that|each|every"
HOST = re.compile(rf" *+(?!(?:{ARTICLE}|my|our|your|his|her|their|its) )([A-Za-z0-9-]++(?:(?: +dot +(?!(?:{ARTICLE})\b)|[.{DOT}])[A-Za-z0-9-]+)*(?: +dot +(?!(?:{ARTICLE})\b)|[.{DOT}])[A-Za-z]{{2,}})(?!\w)", re.I)
BARE_DOT = re.compile(r" +dot +", re.I)


def one_char(c: str) -> str:
    """What a character stands for: itself, an ASCII character, or nothing."""
    if c in INVISIBLE:
        return ""
    if c in (AT, DOT):
        return "\ufffd"
    if c in LOOKALIKE:
        return LOOKALIKE[c]
    if c in SIGNS:
        return SIGNS[c]
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    plain = unicodedata.normalize("NFKC", c) if "\U0001d400" <= c <= "\U0001d7ff" else c
    return plain if len(plain) == 1 and plain.isascii() else c


class Mapped:
    """A text whose every character knows the source span it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, None, None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Applies edits (start, end, replacement), which are ordered and do not overlap."""
        if not edits:
            return
        if self.starts is None:
            self.starts, self.ends = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        parts, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            parts += (self.text[at:a], new)
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            if len(new) == b - a:
                starts += self.starts[a:b]
                ends += self.ends[a:b]
            else:
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
            at = b
        parts.append(self.text[at:])
        self.text, self.starts, self.ends = "".join(parts), starts + self.starts[at:], ends + self.ends[at:]

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])


def odd_characters(text: str) -> list[tuple[int, int, str]]:
    stands = {c: new for c in set(text) if c > "\x7f" and (new := one_char(c)) != c}
    if not stands:
        return []
    found = re.compile("[" + re.escape("".join(stands)) + "]")
    return [(m.start(), m.end(), stands[m[0]]) for m in found.finditer(text)]


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    edits, plain = [], None
    for m in SPELLED_RUN.finditer(text):
        found = [(m.start() + t.start(), m.start() + t.end(), t[0].lower()) for t in RUN_TOKEN.finditer(m[0])]
        if all(w.isdecimal() for _, _, w in found):
            continue
        parts, k = [], 0  # (start, end, what it stands for or None where the source stays)
        while k < len(found):
            a, b, word = found[k]
            if word in REPEATS and k + 1 < len(found) and len(digit := SPELLED.get(found[k + 1][2], found[k + 1][2])) == 1 and digit.isdecimal():
                parts.append((a, found[k + 1][1], digit * REPEATS[word]))
                k += 1
            elif word.isdecimal():
                parts.append((a, b, None))
            else:
                parts.append((a, b, SPELLED.get(word, MARKS.get(word, ""))))
            k += 1
        while parts and parts[-1][2] in ("+", ".", "-", ""):  # a mark ends no identifier
            parts.pop()
        while parts and parts[0][2] in (".", "-", ""):
            parts.pop(0)
        if len(parts) > 1 and parts[-2][2] is None and text[parts[-1][0] : parts[-1][1]].lower() in ARTICLES:
            plain = {b for _, b, _ in find_plain(text)} if plain is None else plain
            if parts[-2][1] in plain:
                parts.pop()
        if len(parts) < 2:
            continue
        for x, y in zip([None, *parts], parts, strict=False):
            if x is not None and "" not in (x[2], y[2]):
                # numbers in digits keep what stands between them, unless they are single digits
                if not (x[2] is None and y[2] is None and max(x[1] - x[0], y[1] - y[0]) > 1):
                    edits.append((x[1], y[0], ""))
            if y[2]:
                edits.append(y)
    return edits


def bracketed(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), AT if (m[1] or m[2]).lower() == "at" else DOT) for m in BRACKETED.finditer(text)]


def local_part(text: str, least: int, at: int) -> tuple[int, list[tuple[int, int]]]:
    """Where the name before `at` begins, not before `least`, and the bare dots in it."""
    dots, start = [], at
    while True:
        while start > least and (text[start - 1] in LOCAL or text[start - 1] == DOT):
            start -= 1
        end = start
        while end > least and text[end - 1] == " ":
            end -= 1
        first = end - 3
        while first > least and text[first - 1] == " ":
            first -= 1
        if not (start < at and end < start and first >= least and first < end - 3 and text[end - 3 : end].lower() == "dot"):
            break
        before = first
        while before > least and (text[before - 1] in LOCAL or text[before - 1] == DOT):
            before -= 1
        if before == first or re.fullmatch(ARTICLE, text[before:first], re.I):
            break
        dots.append((first, start))
        start = before
    return start, dots[::-1]


def disguises(text: str) -> list[tuple[int, int, str]]:
    """The signs of bracketed ones, and of bare ones inside a whole address."""
    edits, last = [(m.start(), m.end(), "@" if m[0] == AT else ".") for m in re.finditer(f"[{AT}{DOT}]", text)], 0
    for m in ANY_AT.finditer(text):
        at, host = m.start(), HOST.match(text, m.end())
        if at < last or not host:
            continue
        start, dots = local_part(text, last, at)
        name, bare = text[start:at], m[0][0] == " "
        if start == at:
            continue
        if bare:
            capital = m[0].endswith("AT") and re.match("[A-Z]*[a-z0-9]", name)
            if start and (text[start - 1].isalnum() or text[start - 1] == "_") or not (capital or dots or DOT in name or DOT in host[1] or BARE_DOT.search(host[1])):
                continue
            edits.append((at, host.start(1), "@"))
        elif host.start(1) > m.end():
            continue
        edits += [(a, b, ".") for a, b in dots] + [(host.start(1) + d.start(), host.start(1) + d.end(), ".") for d in BARE_DOT.finditer(host[1])]
        last = host.end()
    return sorted(edits)


def normalise(text: str) -> Mapped | None:
    """The normalised text, or None if it would equal the source."""
    out = Mapped(text)
    if not text.isascii():
        out.rewrite(odd_characters(text))
    if TRIGGER.search(out.text):
        out.rewrite(spelled_digits(out.text))
    out.rewrite(bracketed(out.text))
    lowered = out.text.lower()
    if "dot" in lowered or " AT " in out.text or AT in lowered or DOT in lowered:
        out.rewrite(disguises(out.text))
    return out if out.starts is not None else None


def find_all(text: str) -> tuple[list[Span], list[Span]]:
    """(plain spans, added spans); an added span overlaps plain spans only where it holds them and more."""
    plain = find_plain(text)
    mapped = normalise(text)
    if mapped is None:
        return plain, []
    by_kind = [[s for s in plain if s[2] == k] for k in KINDS]  # those of a kind do not overlap, so their ends ascend too
    ends = [[s[1] for s in own] for own in by_kind]
    added, last = [], 0
    for start, end, kind in find_plain(mapped.text):
        a, b = mapped.source(start, end)  # found from left to right, so the last added one reaches farthest
        if a >= last and all(wider((a, b, kind), s) for own, e in zip(by_kind, ends, strict=True) for s in overlapping(own, e, a, b)):
            added.append((a, b, kind))
            last = b
    return plain, added


def overlapping(own: list[Span], ends: list[int], a: int, b: int) -> Iterator[Span]:
    """The spans, which do not overlap each other and whose ends are given, that meet [a, b)."""
    for k in range(bisect_right(ends, a), len(own)):
        if own[k][0] >= b:
            return
        yield own[k]


def wider(new: Span, old: Span) -> bool:
    """Whether a disguised identifier holds a plain one of its kind and more, as when one of its letters is a homoglyph."""
    return new[2] == old[2] and new[0] <= old[0] and old[1] <= new[1] and new[:2] != old[:2]


def digest(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], ORDER[s[2]])))


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones together, replaced by its kind in brackets."""
    parts, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            parts += (text[at:a], f"[{kind.upper()}]")
        at = max(at, b)
    return "".join((*parts, text[at:]))


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_<kind> of plain spans, base_sha256, spans, n_added) for every row of df, without a shuffle."""
    small_batches(df.sparkSession)
    schema = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
        T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            out: list[list] = [[] for _ in range(len(KINDS) + 3)]
            for x in texts:
                plain, added = find_all(x.as_py() or "")
                row = [sum(s[2] == k for s in plain) for k in KINDS]
                for column, value in zip(out, (*row, hashlib.sha256(digest(plain).encode()).hexdigest(), digest(plain + added), len(added)), strict=True):
                    column.append(value)
            kinds = [pa.int64()] * len(KINDS) + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=schema.names)

    return df.select(id_col, F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def mask_pii(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """df with every identifier of the text replaced by its kind, and the length column, if there is one, counted again.
    Null texts stay null."""
    small_batches(df.sparkSession)

    @F.pandas_udf(T.StringType())
    def masked(texts):
        return texts.map(lambda t: None if t is None else mask(t, sum(find_all(t), [])))

    out = df.withColumn(text_col, masked(F.col(text_col)))
    return out.withColumn(length_col, F.length(text_col).cast(df.schema[length_col].dataType)) if length_col in df.columns else out


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
