"""Sequence packing by Karmarkar-Karp multiway differencing (operator 10).

A document's tokens, with the end id behind them, are cut at multiples of the capacity.  Full pieces are sequences of their own
without padding.  The tails of a batch of documents go into k windows: every tail starts as a partial partition of its own; the
two partial partitions with the largest imbalances are merged again and again, the fullest windows of one with the emptiest of the
other, until one partition with near-equal windows is left.  k starts at the least count that can hold the tokens and rises
whenever the fullest window exceeds the capacity.

Packing needs lengths only, so it happens where the documents are read: one pass, no shuffle, and a task holds the lengths of one
batch (`BATCH` tails) besides one Arrow batch.  The slack of a batch is less than a few windows in some hundreds.

Token ids come from the tokenizers library.  It drops white space and never looks across it, so the ids of a text are those of its
white-space-free chunks in a row; the ids of a chunk are kept in a bounded cache, as packed little-endian unsigned 32-bit numbers.

Defined cases: null text counts as empty (the end id alone).  Every row is packed, repeated ones each for itself, and rows with
a null id too; only the id and text columns are read.  Texts of any length are packed whole.  An empty table gives no pieces.
Sequence ids are unique: partition number, then a number within the partition; they are gapless within a partition.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import give_back, small_batches, table
from tidelog.llm.token_counts import byte_letters

CAPACITY = 4096
END_ID = 2
BATCH = 1024
CACHE = 1 << 19
SIGNS = frozenset(".,!?;:")
PACK = [struct.Struct(f"<{n}I").pack for n in range(33)]
#: Characters at which Python's split() parts a text although the library keeps them as symbols.
SEPARATORS = re.compile("[\x1c-\x1f]")
WHITE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


class ChunkEncoder:
    """Packed ids of whole texts, chunk by chunk."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        config = json.loads(self.tokenizer.to_str())
        pre = (config["pre_tokenizer"] or {}).get("pretokenizers") or []
        rule = pre[0].get("pattern", {}).get("Regex") if pre else None
        if not rule or [x["type"] for x in pre] != ["Split", "ByteLevel"] or not pre[0]["invert"] or pre[1]["use_regex"]:
            raise ValueError("chunks are independent only under a splitter that drops white space")
        self.letters = byte_letters()
        self.pattern = regex.compile(rule)
        if any(not x["content"].startswith("<") for x in config["added_tokens"]):
            raise ValueError("added tokens are looked for behind a < only")
        self.special = re.compile("|".join(re.escape(x["content"]) for x in config["added_tokens"]) or r"(?!)")

    def chunks(self, text: str) -> list[str]:
        return [x for x in WHITE.split(text) if x] if SEPARATORS.search(text) else text.split()

    def learn(self, missing: list[str]) -> dict[str, bytes]:
        """The ids of the chunks; the cache takes as many of them as it may hold."""
        simple, whole, special = self.simple, self.whole, self.special.search
        new = {x: simple(x) if (x.isascii() or max(x) < "\u0100") and ("<" not in x or not special(x)) else whole(x) for x in missing}
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
        self.cache.update(islice(new.items(), CACHE))
        return new

    def forget(self) -> None:
        """Empties the caches at the end of a task: Python workers are used again, and their memory adds up with later stages'."""
        self.cache.clear()
        self.words.clear()

    def whole(self, chunk: str) -> bytes:
        ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def simple(self, chunk: str) -> bytes:
        """A Latin-1 chunk: composed already, lower case character by character; its words go to the model alone.  Letters alone are
        one word, and so is a sign behind them; other chunks are split by the pattern."""
        low = chunk.lower()
        if low.isalpha():
            return self.words.get(low) or self.word(low)
        head, last = low[:-1], low[-1]
        if last in SIGNS and head.isalpha():
            return (self.words.get(head) or self.word(head)) + (self.words.get(last) or self.word(last))
        return b"".join([self.words.get(x) or self.word(x) for x in self.pattern.findall(low)])

    def word(self, word: str) -> bytes:
        letters = word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()])
        ids = [t.id for t in self.tokenizer.model.tokenize(letters)]
        packed = PACK[len(ids)](*ids) if len(ids) < len(PACK) else struct.pack(f"<{len(ids)}I", *ids)
        if len(self.words) >= CACHE:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        chunks = self.chunks(text)
        try:
            return b"".join([self.cache[x] for x in chunks])
        except KeyError:
            own = {x: self.cache.get(x) for x in chunks}  # a text may hold more chunks than the cache
            own |= self.learn([x for x, packed in own.items() if packed is None])
            return b"".join([own[x] for x in chunks])


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: the indices of sizes in k windows with near-equal sums.

    A partial partition lists its filled windows as (sum, tree), by sum; the others are empty.  While two partitions fill at most k
    windows together, their opposing ends meet only empty ones."""
    if k == 1:
        return [list(range(len(sizes)))]
    heap = [(-n, i, [(n, (i, None, None))]) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    at, by_sum = len(sizes), itemgetter(0)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        meet = max(0, len(a) + len(b) - k)
        both = [(x[0] + y[0], (None, x[1], y[1])) for x, y in zip(a[:meet], reversed(b[:meet]), strict=True)]
        merged = sorted(both + a[meet:] + b[meet:], key=by_sum)
        heapq.heappush(heap, (-(merged[-1][0] - (merged[0][0] if len(merged) == k else 0)), at, merged))
        at += 1
    return [leaves(tree) for _, tree in heap[0][2]]


def leaves(tree) -> list[int]:
    out, todo = [], [tree]
    while todo:
        if node := todo.pop():
            index, left, right = node
            if index is not None:
                out.append(index)
            todo += (left, right)
    return sorted(out)


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most `capacity`, as lists of indices of sizes, each of which is at most `capacity`."""
    if not sizes:
        return []
    k = -(-sum(sizes) // capacity)
    while True:
        windows = [w for w in differencing(sizes, k) if w]
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return windows
        k += 1


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, batch: int = BATCH, with_ids: bool = False) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, its ids."""
    small_batches(df.sparkSession)
    fields = [T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(path), struct.pack("<I", end_id)
        base, done, tails = TaskContext.get().partitionId() << 32, 0, []
        id_type, out = None, []

        def flush() -> None:
            nonlocal done
            for window in pack([t[2] for t in tails], capacity):
                offset = 0
                for i in window:
                    key, start, length, crc, total, ids = tails[i]
                    out.append((key, start, length, crc, total, base + done, offset, ids))
                    offset += length
                done += 1
            tails.clear()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))[: len(schema)]
            kinds = [id_type] + [pa.int64()] * 6 + [pa.list_(pa.int32())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

        for rows in batches:
            id_type = rows.column(0).type
            for key, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                packed = own.encode(text.as_py() or "") + end
                total = len(packed) // 4
                for start in range(0, total, capacity):
                    part = packed[4 * start : 4 * (start + capacity)]
                    length = len(part) // 4
                    ids = np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None
                    piece = (key, start, length, zlib.crc32(part), total, ids)
                    if length == capacity:
                        out.append((*piece[:5], base + done, 0, ids))
                        done += 1
                    else:
                        tails.append(piece)
                if len(tails) >= batch:
                    flush()
                if len(out) >= 4096:
                    yield batch_of(out)
                    out.clear()
        flush()
        own.forget()
        if out:
            yield batch_of(out)
        give_back()

    return df.select(id_col, F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
