"""Token counts with a whole-token shortcut (operator 6).

The offline step proves for every vocabulary string whether the model alone turns it into one token (its own id).  A pre-token in
that table costs one look-up; only the others are merged, and their counts are kept in a bounded cache.  Counts equal the
tokenizers library's: added special tokens are cut out first (one token each), then the byte-level pre-token pattern applies.

Defined cases: null text counts as empty (0 bytes, 0 tokens).  Whole texts of any length are read.  Each row is counted for
itself, so repeated rows give repeated results; only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import small_batches, table

#: Unicode White_Space, as the library's pattern engine has it.  Python's own \s also takes U+001C to U+001F.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the public byte-level pre-token pattern, with the white space spelled out.
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
LIMIT = 512
CACHE = 1 << 18


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WholeTokenCounter:
    """Counts for one tokenizer file; built once in each Python worker."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        config = json.loads(tokenizer.to_str())
        pre = config["pre_tokenizer"] or {}
        if config["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or config["normalizer"]:
            raise ValueError("the shortcut is proved for plain byte-level BPE files only")
        added = config["added_tokens"]
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added):
            raise ValueError("added tokens that strip, normalise or need word ends are not supported")
        self.model = tokenizer.model
        self.letters = byte_letters()
        self.pattern = regex.compile(PRE_TOKEN)
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in sorted(added, key=lambda x: -len(x["content"])))) if added else None
        self.whole = self.proved(config["model"]["vocab"])
        self.cache: dict[str, int] = {}

    def proved(self, vocabulary: dict[str, int]) -> frozenset[str]:
        """The texts of the vocabulary strings that the merges alone turn into one token."""
        back, out = {c: b for b, c in self.letters.items()}, []
        for string, own in vocabulary.items():
            try:
                text = bytes(back[c] for c in string).decode()
            except (KeyError, UnicodeDecodeError):
                continue  # part of a character, or no byte-level string: never a pre-token
            tokens = self.model.tokenize(string)
            if len(tokens) == 1 and tokens[0].id == own:
                out.append(text)
        return frozenset(out)

    def merged(self, piece: str) -> int:
        n = self.cache.get(piece)
        if n is None:
            letters = self.letters
            n = len(self.model.tokenize("".join([letters[b] for b in piece.encode()])))
            if len(self.cache) >= CACHE:
                self.cache.clear()
            if len(piece) <= 64:
                self.cache[piece] = n
        return n

    def plain(self, text: str) -> int:
        whole, merged, n = self.whole, self.merged, 0
        for piece, times in Counter(self.pattern.findall(text)).items():
            n += times if piece in whole else times * merged(piece)
        return n

    def count(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        n, at = 0, 0
        for m in self.special.finditer(text):
            n += 1 + (self.plain(text[at : m.start()]) if m.start() > at else 0)
            at = m.end()
        return n + (self.plain(text[at:] if at else text) if at < len(text) else 0)


@lru_cache(maxsize=4)
def counter(path: str) -> WholeTokenCounter:
    return WholeTokenCounter(path)


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of df, without a shuffle."""
    small_batches(df.sparkSession)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            ids, sizes, texts = batch.columns
            yield pa.RecordBatch.from_arrays([ids, sizes, pa.array([own.count(x.as_py()) for x in texts], pa.int64())], names=schema.names)
        own.cache.clear()  # the worker is used again for other stages

    text = F.coalesce(F.col(text_col), F.lit(""))
    given = df.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("t"))
    return given.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
