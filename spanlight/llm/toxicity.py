"""Toxicity: a character n-gram linear classifier with naive Bayes scaled features.

Every log-count ratio is shrunk by its own standard error: little where it is many of these, and
smoothly towards zero where it is few, so that rare n-grams do not drown the rest and yet no
count, however small, is cut off.

A document's features are the character n-grams of its distinct lower-cased words, with marks
at the words' ends, present or not, hashed into a fixed number of buckets. Each feature is
scaled by its naive Bayes log-count ratio between toxic and other texts, and a logistic
regression with an L2 penalty is fitted on the scaled features (Adagrad, fixed order, so reruns
agree). Scoring looks up one weight per bucket, scale times coefficient; the table has a fixed
size and is broadcast. Weights are multiples of STEP, so sums are exact in any order.

The model is fitted on a bounded sample: of each class the max_per_class labelled training
rows with the lowest hash of their id, one row an id. Their bucket lists, not their texts, come to the driver.
Every document is scored by its whole text.

Null and empty texts have no feature and get the score of the intercept. If the training rows
lack a class, the score is the class share for all. Labels that are null are no labels;
repeated rows are scored one by one. Texts may have any length; columns beside id and text are
not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, column, same


#: Weights are rounded to it.
STEP = 2.0**-20


@dataclass(frozen=True)
class ToxicityOptions:
    shortest: int = 3
    longest: int = 6
    buckets: int = 1 << 18
    max_per_class: int = 4000
    smoothing: float = 1.0
    #: Standard errors at which a log-count ratio is halved.
    half_at: float = 6.0
    l2: float = 1e-5
    rate: float = 0.15
    epochs: int = 8
    batch: int = 64
    #: Words that a worker remembers.
    cache: int = 300_000


class Grams:
    """The buckets of words, for many words at a time."""

    def __init__(self, options: ToxicityOptions):
        self.options = options

    def _matrix(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(place of the word, bucket) of every n-gram."""
        o = self.options
        marked = np.array([f"<{w}>" for w in words])
        codes = marked.view(np.uint32).reshape(len(words), -1).astype(np.uint64)
        size = np.char.str_len(marked)
        h, of, out = np.zeros_like(codes), [], []
        for n in range(1, min(o.longest, codes.shape[1]) + 1):
            wide = codes.shape[1] - n + 1
            h = h[:, :wide] * np.uint64(0x100000001B3) + codes[:, n - 1 : n - 1 + wide] + np.uint64(1)
            if n >= o.shortest:
                i, j = np.nonzero(np.arange(wide) + n <= size[:, None])
                x = h[i, j] * np.uint64(0x9E3779B97F4A7C15)
                of.append(i)
                out.append(((x ^ (x >> np.uint64(32))) % np.uint64(o.buckets)).astype(np.int32))
        return np.concatenate(of), np.concatenate(out)

    def words(self, words: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Parts of the words with (place, bucket) of their n-grams; very long words come alone."""
        short = [w for w in words if len(w) <= 48]
        for at in range(0, len(short), 8192):
            part = short[at : at + 8192]
            yield part, *self._matrix(part)
        for w in words:
            if len(w) > 48:
                yield [w], *self._matrix([w])

    def texts(self, texts: list[bytes]) -> list[np.ndarray]:
        """The distinct buckets of every text."""
        split = [distinct(t) for t in texts]
        known: dict[str, np.ndarray] = {}
        for part, of, buckets in self.words(list(set().union(*split))):
            order = np.argsort(of, kind="stable")
            known |= zip(part, np.split(buckets[order], np.cumsum(np.bincount(of, minlength=len(part)))[:-1]))
        return [np.unique(np.concatenate([known[w] for w in ws])) if ws else np.zeros(0, np.int32) for ws in split]


def distinct(text: bytes) -> set[str]:
    # A null character would pad the word's code points.
    return set(text.decode().replace("\0", "\x01").lower().split())


@dataclass
class Model:
    weights: np.ndarray
    intercept: float


class Scorer:
    """Remembers the buckets of words that have a weight; most words have none."""

    def __init__(self, model: Model, options: ToxicityOptions):
        self.model, self.options, self.grams = model, options, Grams(options)
        self.heavy: dict[str, np.ndarray] = {}
        self.light: set[str] = set()
        self.seen = np.zeros(options.buckets, np.int64)

    def _learn(self, words: list[str]) -> None:
        if len(self.heavy) + len(self.light) > self.options.cache:
            self.heavy.clear()
            self.light.clear()
        for part, of, buckets in self.grams.words(words):
            at = np.flatnonzero(self.model.weights[buckets])
            at = at[np.argsort(of[at], kind="stable")]
            own, start = np.unique(of[at], return_index=True)
            found = dict(zip((part[i] for i in own), np.split(buckets[at], start[1:])))
            self.heavy |= found
            self.light.update(w for w in part if w not in found)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = np.full(len(texts), self.model.intercept)
        split = [distinct(t) for t in texts]
        for at in range(0, len(texts), 1024):
            part = split[at : at + 1024]
            self._learn(list(set().union(*part) - self.light - self.heavy.keys()))
            heavy = self.heavy
            for row, words in enumerate(part, at):
                if own := [heavy[w] for w in words if w in heavy]:
                    self._add(z, row, np.concatenate(own))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def _add(self, z: np.ndarray, row: int, buckets: np.ndarray) -> None:
        """Adds the weights of the distinct buckets: of equal ones the last that is written counts."""
        place = np.arange(len(buckets))
        self.seen[buckets] = place
        z[row] += self.model.weights[buckets[self.seen[buckets] == place]].sum()


def fit(lists: list[np.ndarray], y: np.ndarray, options: ToxicityOptions, share: float | None = None) -> Model:
    """share: the share of label 1 among all training rows."""
    n, y = options.buckets, np.asarray(y, float)
    if not 0 < y.sum() < len(y):
        one = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return Model(np.zeros(n), float(np.log(one / (1 - one))))
    count = np.full((2, n), options.smoothing)
    for x, label in zip(lists, y):
        count[int(label)][x] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    fourth = (ratio * ratio / (1 / count).sum(0)) ** 2
    ratio *= fourth / (fourth + options.half_at**4)
    v, seen = np.zeros(n), np.full(n, 1e-6)
    b, b_seen = float(np.log(y.mean() / (1 - y.mean()))), 1e-6
    rng = np.random.default_rng(0)
    for _ in range(options.epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), options.batch):
            rows = order[at : at + options.batch]
            sizes = np.array([len(lists[i]) for i in rows])
            flat = np.concatenate([lists[i] for i in rows])
            of = np.repeat(np.arange(len(rows)), sizes)
            z = np.bincount(of, v[flat] * ratio[flat], len(rows)) + b
            error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[rows]
            where = np.flatnonzero(np.bincount(flat, minlength=n))
            grad = np.bincount(flat, error[of] * ratio[flat], n)[where] / len(rows) + options.l2 * v[where]
            seen[where] += grad * grad
            v[where] -= options.rate * grad / np.sqrt(seen[where])
            g = error.mean()
            b_seen += g * g
            b -= options.rate * g / np.sqrt(b_seen)
    if share is not None and 0 < share < 1:  # the sample may hold the classes at other shares
        b += float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
    return Model(np.round(v * ratio / STEP) * STEP, b)


def _sample(labelled: DataFrame, label: str, doc_id: str, most: int) -> DataFrame:
    """Of each class the rows with the lowest hash of their id, so many at most."""
    order = (F.xxhash64(F.col(doc_id).cast("string")), F.col(doc_id))
    parts = [labelled.filter(F.col(label) == k).orderBy(*order).limit(most) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", options: ToxicityOptions = ToxicityOptions()) -> Model:
    """A model of the labelled rows of labels; the caller leaves held-out rows out of them."""
    kept = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__y")).filter("__y in (0, 1)").distinct()
    chosen = _sample(kept, "__y", "__id", options.max_per_class)
    rows = docs.select(F.col(doc_id), F.col(text)).join(F.broadcast(chosen), same(F.col(doc_id), F.col("__id")))
    rows = rows.groupBy("__id", "__y").agg(F.min_by(text, F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("__text")).select("__text", "__y", "__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(options)
        for b in batches:
            lists = grams.texts(as_bytes(b, "__text"))
            yield pa.RecordBatch.from_arrays([b.column(2).cast(pa.string()), b.column(1), pa.array([x.tobytes() for x in lists], pa.binary())], names=["id", "y", "x"])

    share = kept.agg(F.avg("__y")).first()[0]
    # The sample comes in a few parts, so the driver's JVM never holds it whole.
    parts = rows.mapInArrow(run, "id string, y int, x binary").repartition(16).toLocalIterator(prefetchPartitions=True)
    found = sorted(((r["id"] or "", r["y"], bytes(r["x"])) for r in parts))
    return fit([np.frombuffer(x, np.int32) for _, _, x in found], np.array([y for _, y, _ in found]), options, share)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", options: ToxicityOptions = ToxicityOptions()) -> DataFrame:
    """A row per input row: doc_id, score and predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value, options)
        for b in batches:
            s = scorer.scores(as_bytes(b, text))
            yield pa.RecordBatch.from_arrays([b.column(0), column(s, pa.float64()), column((s >= 0.5).astype(np.int32), pa.int32())], names=[doc_id, "score", "predicted"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, score double, predicted int")
