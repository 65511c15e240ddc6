"""Quality classifier by co-training (operator 1).

Two views of a document are judged apart, and no character tells both the same thing.  The content view reads words alone: the runs
of letters, in lower case, their stems and how often they repeat, of which it weighs those that bad documents hold more often than chance (a text
without any is no worse for being short).  The metadata view reads what is left when words are blanked out: source, language, length,
lines, and the shares of capitals, digits, white space and signs.  Each view is a logistic classifier, fitted on a sample of labels.

Co-training goes in rounds over the whole corpus.  A pass judges every document outside the sample with both views, as calibrated on
held-out labels, and of the documents that one view is sure of (`SURE`) it counts the other view's features: words by documents sure
to be bad against all documents, metadata by sure bad ones against sure good ones.  From these counts each view gets new features
(words) and, for the features' weights, log-odds around which the next fit on the labels is drawn; a fit that judges the held-out
labels worse than the one before is not taken.  Rounds end after `ROUNDS`, or when neither view's loss on the held-out labels falls by
`LEAST_GAIN` any more.
At last a small logistic model combines the calibrated views into one score, with which every document is judged in one more pass.

A document is good if its label says quality 1 and toxic 0.  Words are counted in `SLOTS` hashed slots, whatever the vocabulary; all
slots that pass the tests are weighed, and all categories of the sample.  The fits run on the driver, on `SAMPLE` labelled documents
at most (a parameter), taken in order of a hash of their ids, of which it gets slot numbers and facts, no texts.  Counts of the rounds
cover all documents and arrive as 16 arrays of slots.  The model is made by jobs while the result is being described.

Defined cases: null or empty text holds no word; null metadata is a category of its own.  Labels with a null in both columns are
ignored, several labels of one id count as the worst of them.  Without labels of both kinds, or with fewer than 20, every document
gets the share of good labels (1 without any label) as its score.  Every row is judged for itself; other columns stay untouched and cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import give_back, small_batches, table

SAMPLE = 6000
ROUNDS, LEAST_GAIN, SURE, LEAST_DF, LEAST_Z, LEAST_LIFT = 2, 0.02, 0.98, 4, 4.0, 3.0
KEEP_FROM = 0.5
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
WORD = re.compile(r"[^\W\d_]+")
STEMS, GRID = (4, 5), 24
CACHE = 1 << 17
#: Byte classes of the layout facts: capitals and small letters as such, then what is no letter.
CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n", ".", ",", "!", "?", "|", "%#$&*", "<>{}[]", "@/\\_=+", ":;", "\"'()-"]
BINS = 12
SCORES = "text_score double, meta_score double, score double"


class SlotOf(dict):
    """The slot of a string behind a mark, or -1 if only others are asked for; kept for strings seen before."""

    def __init__(self, mark: str, only: frozenset[int] | None):
        super().__init__()
        self.mark, self.only = mark, only

    def __missing__(self, text: str) -> int:
        slot = xxhash.xxh3_64_intdigest(self.mark + text) >> (64 - SLOT_BITS)
        if self.only is not None and slot not in self.only:
            slot = -1
        if len(self) >= CACHE:
            self.clear()
        self[text] = slot
        return slot


class Slots:
    """The distinct slots of a text's words and of their stems (`STEMS` first letters, marked), and of how little its words vary: the
    fewer distinct ones, the more slots of a fixed row of `GRID`.  only: the slots that are asked for, if not all."""

    def __init__(self, only: np.ndarray | None = None):
        asked = None if only is None else frozenset(only.tolist())
        self.word, self.stem, varied = SlotOf("", asked), SlotOf("^", asked), SlotOf("<", asked)
        self.varied = [varied[str(k)] for k in range(GRID)]

    def of(self, text: str | None) -> np.ndarray:
        every = WORD.findall(text.lower()) if text else []
        if not every:
            return np.zeros(0, np.int64)
        words = set(every)
        repeats = len(words) / len(every) ** 0.9  # longer texts repeat more
        found = set(self.varied[: max(0, GRID - int(GRID * repeats))])
        word, stem = self.word, self.stem
        found.update([word[w] for w in words])
        for n in STEMS:
            found.update([stem[x] for x in {w[:n] for w in words}])
        found.discard(-1)
        return np.fromiter(found, np.int64, len(found))


#: Which of the 256 bytes are in which class; the last one: all bytes of no ASCII character.
MEMBERS = np.stack([np.isin(np.arange(256), [ord(c) for c in own]) for own in CLASSES] + [np.arange(256) > 127], axis=1).astype(float)


def layouts(texts: list[str | None]) -> np.ndarray:
    """The layout facts of each text (rows)."""
    raw = np.zeros((len(texts), 256))
    for i, text in enumerate(texts):
        if text:
            raw[i] = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    total, lines = np.maximum(1, raw.sum(axis=1)), raw[:, 10] + 1
    return np.column_stack([raw @ MEMBERS / total[:, None], np.log1p(total), np.log1p(lines), np.log1p(total / lines)])


def edges_of(x: np.ndarray) -> np.ndarray:
    """BINS edges: zero has a bin of its own, what is above it is cut in bins of even counts."""
    some = x[x > 0]
    return np.append(1e-12, np.quantile(some, np.linspace(0, 1, BINS + 1)[1:-1]) if len(some) else np.ones(BINS - 1))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def newton(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Logistic weights, the last one the bias, of a few dense features."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.diag([l2] * (x.shape[1] - 1) + [1e-3])
    for _ in range(12):
        p = sigmoid(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-3:
            break
    return w


def sparse_fit(rows: list[np.ndarray], y: np.ndarray, prior: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Logistic weights, the last one the bias, of 0/1 features; rows: the numbers of each document's features.  Weights are drawn to
    `prior`.  Newton steps, each solved by conjugate gradients on the sparse rows."""
    at, n = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), len(prior)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    dot = lambda v: np.bincount(doc, v[at], len(rows)) + v[-1]
    back = lambda r: np.append(np.bincount(at, r[doc], n), r.sum())
    ridge, center = np.append(np.full(n, l2), 1e-3), np.append(prior, 0.0)
    w = center.copy()
    for _ in range(12):
        p = sigmoid(dot(w))
        curve, target = np.maximum(p * (1 - p), 1e-9), -(back(p - y) + ridge * (w - center))
        step, rest = np.zeros(n + 1), target.copy()
        diagonal = back(curve) + ridge
        z = rest / diagonal
        along, size = z.copy(), rest @ z
        for _ in range(60):
            bent = back(curve * dot(along)) + ridge * along
            pace = size / max(along @ bent, 1e-30)
            step += pace * along
            rest -= pace * bent
            z = rest / diagonal
            size, before = rest @ z, size
            if size < 1e-8:
                break
            along = z + size / before * along
        w += step
        if np.abs(step).max() < 1e-3:
            break
    return w


def views(t: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What the combination weighs: either calibrated view, and the worse of the two, as one good view does not excuse a bad one."""
    return np.column_stack([t, m, np.minimum(t, m)])


def loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0.5, -z, z)).mean())


@dataclass
class Model:
    constant: float | None = None
    slots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # weighed slots, ascending
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))  # their weights, the bias last
    edges: np.ndarray | None = None
    categories: dict[tuple[int, str], int] = field(default_factory=dict)
    meta: np.ndarray | None = None
    calibration: np.ndarray | None = None  # a and b of either view
    combination: np.ndarray | None = None

    def text_columns(self, slots: np.ndarray) -> np.ndarray:
        if not len(self.slots):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.slots, slots), len(self.slots) - 1)
        return at[self.slots[at] == slots]

    def meta_columns(self, facts: np.ndarray, labels: list[tuple]) -> np.ndarray:
        """The binary metadata features of each document, as one row of column numbers."""
        bins = np.stack([np.searchsorted(e, facts[:, i], side="right") + i * (BINS + 1) for i, e in enumerate(self.edges)], axis=1)
        base = len(self.edges) * (BINS + 1)
        own = [[base + self.categories.get((i, str(v)), len(self.categories)) for i, v in enumerate(row)] for row in labels]
        return np.column_stack([bins, np.array(own, np.int64).reshape(len(bins), -1)])

    @property
    def meta_dim(self) -> int:
        return len(self.edges) * (BINS + 1) + len(self.categories) + 1

    def logits(self, slots: list[np.ndarray], columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The calibrated log-odds of either view."""
        t = np.array([self.weights[self.text_columns(s)].sum() for s in slots]) + self.weights[-1]
        m = self.meta[columns].sum(axis=1) + self.meta[-1]
        a, b, c, d = self.calibration
        return a * t + b, c * m + d

    def scores(self, texts, labels, slots: Slots) -> np.ndarray:
        """(text score, metadata score, combined score) for each document."""
        if self.constant is not None:
            return np.full((len(texts), 3), self.constant)
        if not len(texts):
            return np.zeros((0, 3))
        t, m = self.logits([slots.of(x) for x in texts], self.meta_columns(layouts(texts), labels))
        return np.column_stack([sigmoid(t), sigmoid(m), sigmoid(views(t, m) @ self.combination[:-1] + self.combination[-1])])


@dataclass
class Evidence:
    """What a pass over the unlabelled documents counts: documents that hold a slot, all and sure to be bad by the metadata; metadata
    features of documents sure to be good and bad by the content; and, in `sums`, documents, sure bad by metadata, sure good and
    sure bad by content."""

    every: np.ndarray
    bad: np.ndarray
    meta_good: np.ndarray
    meta_bad: np.ndarray
    sums: np.ndarray

    @classmethod
    def none(cls, dim: int) -> Evidence:
        return cls(*(np.zeros(n, np.int64) for n in (SLOTS, SLOTS, dim, dim, 4)))

    def packed(self) -> bytes:
        return zlib.compress(np.concatenate([self.every, self.bad, self.meta_good, self.meta_bad, self.sums]).tobytes(), 1)

    def add(self, packed: bytes) -> None:
        own, at = np.frombuffer(zlib.decompress(packed), np.int64), 0
        for mine in (self.every, self.bad, self.meta_good, self.meta_bad, self.sums):
            mine += own[at : at + len(mine)]
            at += len(mine)

    def telling(self) -> tuple[np.ndarray, np.ndarray]:
        """(slots that sure bad documents hold more often, by test and by lift; weights that this speaks for)."""
        n, n_bad = self.sums[0], self.sums[1]
        if not 0 < n_bad < n:
            return np.zeros(0, np.int64), np.zeros(0)
        share = n_bad / n
        with np.errstate(divide="ignore", invalid="ignore"):
            z = (self.bad - self.every * share) / np.sqrt(self.every * share * (1 - share))
            lift = self.bad / (self.every * share)
        best = np.nonzero((self.every >= LEAST_DF) & (z >= LEAST_Z) & (lift >= LEAST_LIFT))[0]
        return best, -np.minimum(3.0, np.log(lift[best]))

    def meta_prior(self, fields: int) -> np.ndarray:
        """Log-odds of each metadata feature among sure documents, shared out over the fields, as these tell much the same."""
        good, bad = self.sums[2], self.sums[3]
        if not good or not bad:
            return np.zeros(len(self.meta_good))
        odds = np.log((self.meta_good + 1) / (self.meta_bad + 1)) - np.log((good + 1) / (bad + 1))
        return np.where(self.meta_good + self.meta_bad > 0, np.clip(odds / fields, -1, 1), 0)


def co_train(slots: list[np.ndarray], facts: np.ndarray, labels: list[tuple], y: np.ndarray, look: Callable[[Model], Evidence], rounds: int = ROUNDS) -> Model:
    """y: 1 good, 0 bad.  look: a pass over the unlabelled documents with a model."""
    if len(set(y.tolist())) < 2 or len(y) < 20:
        return Model(constant=float(y.mean()) if len(y) else 1.0)
    held = np.arange(0, len(y), 5)  # the sample stands in hash order, so every fifth is a fair held-out fold
    train = np.setdiff1d(np.arange(len(y)), held)
    known, counts = np.unique(np.concatenate([slots[i] for i in train]), return_counts=True)
    bad = np.zeros(len(known), np.int64)
    for i in train[y[train] == 0]:
        bad[np.searchsorted(known, slots[i])] += 1
    share = 1 - y[train].mean()
    labelled = known[(counts >= LEAST_DF) & (bad - counts * share >= LEAST_Z * np.sqrt(counts * share * (1 - share)))]
    model = Model()
    model.edges = np.stack([edges_of(x) for x in facts[train].T])
    model.categories = {c: i for i, c in enumerate(sorted({(i, str(v)) for k in train for i, v in enumerate(labels[k])}))}
    columns = model.meta_columns(facts, labels)

    def text_fit(chosen: np.ndarray, prior: np.ndarray) -> tuple:
        model.slots = chosen
        rows = [model.text_columns(s) for s in slots]
        w = sparse_fit([rows[i] for i in train], y[train], prior)
        return chosen, w, np.array([w[r].sum() for r in rows]) + w[-1]

    def meta_fit(prior: np.ndarray) -> tuple:
        w = sparse_fit([columns[i] for i in train], y[train], prior)
        return w, w[columns].sum(axis=1) + w[-1]

    def calibrated(z: np.ndarray) -> tuple[np.ndarray, float]:
        a = newton(z[held][:, None], y[held])
        return a, loss(a[0] * z[held] + a[1], y[held])

    text, meta = text_fit(labelled, np.zeros(len(labelled))), meta_fit(np.zeros(model.meta_dim))
    (ta, text_loss), (ma, meta_loss) = calibrated(text[-1]), calibrated(meta[-1])
    for turn in range(rounds + 1):
        model.slots, model.weights, model.meta, model.calibration = text[0], text[1], meta[0], np.array([*ta, *ma])
        if turn == rounds:
            break
        seen = look(model)
        new, prior = seen.telling()
        chosen = np.union1d(labelled, new)
        drawn = np.zeros(len(chosen))
        drawn[np.searchsorted(chosen, new)] = prior
        learnt = False
        if len(new) and (better := text_fit(chosen, drawn)) and (own := calibrated(better[-1]))[1] <= text_loss:
            learnt, text, (ta, text_loss) = own[1] < (1 - LEAST_GAIN) * text_loss, better, own
        prior = seen.meta_prior(columns.shape[1])
        if prior.any() and (better := meta_fit(prior)) and (own := calibrated(better[-1]))[1] <= meta_loss:
            learnt, meta, (ma, meta_loss) = learnt or own[1] < (1 - LEAST_GAIN) * meta_loss, better, own
        if not learnt:
            rounds = turn + 1
            model.slots, model.weights, model.meta, model.calibration = text[0], text[1], meta[0], np.array([*ta, *ma])
            break
    t, m = ta[0] * text[-1] + ta[1], ma[0] * meta[-1] + ma[1]
    model.combination = newton(views(t[held], m[held]), y[held], 0.1)
    return model


def given(docs: DataFrame, id_col: str, text_col: str, meta_cols: list[str]) -> DataFrame:
    return docs.select(F.col(id_col).alias("own"), F.col(text_col).cast("string").alias("t"), F.array(*[F.col(c).cast("string") for c in meta_cols]).alias("m"))


def sampled(rows: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(own, good) of the bounded sample of labelled ids, in order of a hash of the ids."""
    marked = labels.filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id").agg(
        F.min(((F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good")
    )
    ids = rows.select("own").distinct()
    return ids.join(marked, ids["own"] == marked["doc_id"]).select("own", "good").orderBy(F.xxhash64("own"), "own").limit(sample)


def featured(rows: DataFrame, chosen: DataFrame, sample: int) -> tuple[list[np.ndarray], np.ndarray, list[tuple], np.ndarray]:
    """Slots, layout facts, metadata and labels of the sample's documents, one row for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            own, good, texts, meta = batch.columns
            texts = texts.to_pylist()
            packed = [zlib.compress(np.sort(slots.of(x)).astype(np.int32).tobytes(), 1) for x in texts]
            yield pa.RecordBatch.from_arrays([own, good, meta, pa.array(packed, pa.binary()), pa.array(layouts(texts).tolist(), pa.list_(pa.float64()))], names=["own", "good", "m", "slots", "facts"])

    kind = rows.schema["own"].dataType.simpleString()
    first = rows.join(F.broadcast(chosen), "own").groupBy("own", "good").agg(F.min(F.struct(F.coalesce("t", F.lit("")).alias("t"), "m")).alias("x")).select("own", "good", "x.t", "x.m")
    found = first.mapInArrow(run, f"own {kind}, good int, m array<string>, slots binary, facts array<double>").collect()  # at most `sample` rows
    found.sort(key=lambda r: (xxhash.xxh64_intdigest(repr(r["own"])), repr(r["own"])))
    slots = [np.frombuffer(zlib.decompress(r["slots"]), np.int32).astype(np.int64) for r in found]
    return slots, np.array([r["facts"] for r in found]), [tuple(r["m"]) for r in found], np.array([r["good"] for r in found], np.float64)


def evidence(rows: DataFrame, chosen: DataFrame, model: Model, sure: float = SURE) -> Evidence:
    """One pass over all documents whose ids are not in the sample."""
    dim, names = model.meta_dim, ["counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, seen, limit = Slots(), Evidence.none(dim), np.log(sure / (1 - sure))
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), [tuple(x) for x in batch.column(1).to_pylist()]
            if not texts:
                continue
            own, columns = [slots.of(x) for x in texts], model.meta_columns(layouts(texts), labels)
            t, m = model.logits(own, columns)
            every = np.concatenate(own)
            if len(every):
                seen.every += np.bincount(every, minlength=SLOTS)
            for i in np.nonzero(m <= -limit)[0]:
                seen.bad[own[i]] += 1
            seen.meta_good += np.bincount(columns[t >= limit].ravel(), minlength=dim)
            seen.meta_bad += np.bincount(columns[t <= -limit].ravel(), minlength=dim)
            seen.sums += np.array([len(texts), (m <= -limit).sum(), (t >= limit).sum(), (t <= -limit).sum()])
        yield pa.RecordBatch.from_arrays([pa.array([seen.packed()], pa.binary())], names=names)
        del slots, seen
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Evidence.none(dim)
        for batch in batches:
            for x in batch.column(0):
                total.add(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.packed()], pa.binary())], names=names)

    rest = rows.join(F.broadcast(chosen.select("own")), "own", "left_anti").select("t", "m").mapInArrow(run, "counts binary")
    total = Evidence.none(dim)
    for row in rest.repartition(16).mapInArrow(add, "counts binary").toLocalIterator():  # 16 rows of SLOTS counters
        total.add(row[0])
    return total


def quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("lang", "source"), sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    small_batches(docs.sparkSession)
    rows = given(docs, id_col, text_col, list(meta_cols))
    kind = rows.schema["own"].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame([(r["own"], r["good"]) for r in sampled(rows, labels, sample).collect()], f"own {kind}, good int")  # at most `sample` ids
    return co_train(*featured(rows, chosen, sample), lambda model: evidence(rows, chosen, model), rounds)


def quality_scores(model: Model, text: Column, meta: list[Column]) -> Column:
    """A struct of text_score, meta_score and score, between 0 (bad) and 1 (good)."""

    @F.pandas_udf(SCORES)
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        slots = Slots(model.slots)
        for texts, metas in batches:
            own = model.scores([x if isinstance(x, str) else None for x in texts], [tuple(x) for x in metas], slots)
            yield pd.DataFrame(own, columns=["text_score", "meta_score", "score"])

    return scores(text, F.array(*[c.cast("string") for c in meta]))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("lang", "source"), least: float = KEEP_FROM) -> DataFrame:
    """The rows of docs with a score of at least `least`; all columns stay."""
    model = quality_model(docs, labels, id_col, text_col, meta_cols)
    return docs.filter(quality_scores(model, docs[text_col], [docs[c] for c in meta_cols])["score"] >= least)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", quality_scores(model, F.col("text"), [F.col("lang"), F.col("source")]).alias("s"))
    return scored.select("doc_id", "s.text_score", "s.meta_score", "s.score", (F.col("s.score") >= KEEP_FROM).alias("keep"))
