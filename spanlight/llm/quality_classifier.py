"""Quality classifier by positive-unlabelled learning.

Trusted good texts and unlabelled web text are enough: with the class prior, the risk of a
classifier on the missing bad texts follows from both, and its estimate is kept from going
below zero, which is what an overfit would exploit (non-negative unbiased risk, logistic loss).

Features are measures of a text's form (lengths, shares of character kinds, repetition,
compression), each cut into bins at the quantiles of the training rows; the model is additive
over bins, so a score can bend in each measure. The class prior is estimated from a first
classifier of good against unlabelled rows, half of them held back: among the highest scores,
where hardly any bad text is left, unlabelled rows are as frequent as prior times good rows.

The model is fitted on a bounded sample: the max_positive good rows and max_unlabelled rows
with the lowest hash of their id. Their measures, not their texts, come to the driver. Every
document is scored by its whole text; no label, language, source or id is a measure.

Null texts are empty texts; an empty text has its own measures and a score like any other.
Without good training rows all scores are 0.5; without unlabelled rows all training rows count
as unlabelled. Labels that are null are no labels. Repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, column, same


@dataclass(frozen=True)
class QualityModelOptions:
    max_positive: int = 5000
    max_unlabelled: int = 10000
    bins: int = 16
    steps: int = 300
    rate: float = 0.02
    l2: float = 2e-4
    #: Bytes that are compressed at a time; a measure is the mean over the parts of a text.
    part: int = 1 << 16


def measures(text: bytes, press: zstandard.ZstdCompressor, part: int = 1 << 16) -> np.ndarray:
    words, chars = text.split(), text.decode()
    n, size = len(words), max(1, len(chars))
    lower = [w.lower() for w in words]
    sizes = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    lines = [x.strip() for x in chars.split("\n")]
    full = [x for x in lines if x]
    kinds = set(lower)
    _, counts = np.unique(np.fromiter(map(hash, lower), np.int64, n), return_counts=True) if n else (None, np.zeros(1))
    pairs, triples = len(set(zip(lower, lower[1:]))), len(set(zip(lower, lower[1:], lower[2:])))
    squeezed = sum(len(press.compress(text[i : i + part])) for i in range(0, len(text), part))
    upper = sum(1 for w in words if w.isupper() and len(w) > 1)
    b = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256)
    letters = b[65:91].sum() + b[97:123].sum() + b[128:].sum()
    common = b[32] + b[10] + b[44] + b[46] + b[39]
    ends = sum(1 for x in full if x[-1] in ".!?\"')")
    return np.array(
        [
            np.log1p(n),
            np.log1p(len(full)),
            n / max(1, len(full)),
            sizes.mean(),
            sizes.std(),
            sizes.max(),
            len(kinds) / max(1, n),
            len(kinds) / max(1, n) ** 0.5,
            counts.max() / max(1, n),
            pairs / max(1, n - 1),
            triples / max(1, n - 2),
            sum(map(bytes.__eq__, lower, lower[1:])) / max(1, n),
            (len(full) - len(set(full))) / max(1, len(full)),
            len(text) / max(1, squeezed),
            len(text) / max(1, squeezed) - 0.25 * np.log1p(len(text)),
            1 - (letters + common) / max(1, len(text)),
            b[48:58].sum() / max(1, len(text)),
            b[65:91].sum() / max(1, letters),
            upper / max(1, n),
            (b[44] + b[46]) / max(1, n),
            (b[33] + b[63]) / max(1, n),
            sum(1 for w in words if not any(map(_is_letter, w))) / max(1, n),
            ends / max(1, len(full)),
            b[58:65].sum() / size + b[91:97].sum() / size + b[123:128].sum() / size + b[35:39].sum() / size + b[42:44].sum() / size,
        ]
    )


def _is_letter(byte: int) -> bool:
    return 65 <= byte <= 90 or 97 <= byte <= 122 or byte >= 128


N_MEASURES = 24


@dataclass
class Model:
    edges: list[np.ndarray]
    weights: np.ndarray
    intercept: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        # Row by row: a matrix product rounds differently for batches of other sizes.
        z = self.intercept + (_binned(x, self.edges) * self.weights).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    q = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(x[:, k], np.concatenate((q, [0.005, 0.01, 0.02, 0.98, 0.99, 0.995])))) for k in range(x.shape[1])]


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """A column per bin, 1 from the bin's lower edge on, so neighbours share their weights."""
    return np.concatenate([(x[:, k : k + 1] > e[None, :]).astype(np.float32) for k, e in enumerate(edges)], axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _descend(p: np.ndarray, u: np.ndarray, prior: float | None, o: QualityModelOptions) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk, or without a prior on the plain risk of good against unlabelled."""
    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, o.steps + 1):
        zp, zu = p @ w + b, u @ w + b
        sp, su = _sigmoid(zp), _sigmoid(zu)
        # Logistic loss: its slope is sigmoid(z) - 1 for label 1 and sigmoid(z) for label 0.
        if prior is None:
            gp, gu = (sp - 1) / len(p), su / len(u)
        elif np.logaddexp(0, zu).mean() >= prior * np.logaddexp(0, zp).mean():
            gp, gu = np.full(len(p), -prior / len(p)), su / len(u)
        else:  # the risk of bad texts would go below zero and stands at zero
            gp, gu = prior * (sp - 1) / len(p), np.zeros(len(u))
        g = np.concatenate((p.T @ gp + u.T @ gu + o.l2 * w, [gp.sum() + gu.sum()]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = o.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def estimate_prior(good: np.ndarray, mixed: np.ndarray) -> float:
    """From held-back scores: the least ratio of unlabelled to good rows above a threshold, with a margin for chance."""
    best, best_bound = 1.0, np.inf
    for t in np.quantile(good, np.linspace(0.02, 0.9, 89)):
        g, u = (good >= t).mean(), (mixed >= t).mean()
        margin = 1.0 * (np.sqrt(0.25 / len(good)) + np.sqrt(0.25 / len(mixed))) * (1 + u / g)
        if (bound := (u + margin) / g) < best_bound:
            best, best_bound = u / g, bound
    return float(min(max(best, 0.02), 0.98))


def fit(good: np.ndarray, mixed: np.ndarray, options: QualityModelOptions = QualityModelOptions(), prior: float | None = None) -> Model:
    edges = _edges(np.concatenate((good, mixed)), options.bins)
    p, u = _binned(good, edges), _binned(mixed, edges)
    if prior is None:
        w, b = _descend(p[::2], u[::2], None, options)
        prior = estimate_prior(p[1::2] @ w + b, u[1::2] @ w + b) if len(p) > 1 and len(u) > 1 else 0.5
    w, b = _descend(p, u, prior, options)
    return Model(edges, w, b, prior)


def _measured(docs: DataFrame, keep: list[str], text: str, options: QualityModelOptions) -> DataFrame:
    """The columns keep and x, the measures as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            x = pa.array([measures(t, press, options.part).tobytes() for t in as_bytes(b, text)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), x], names=[*keep, "x"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, text).mapInArrow(run, f"{kinds}, x binary")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", options: QualityModelOptions = QualityModelOptions(), prior: float | None = None) -> Model | None:
    """A model of good rows (label 1) and rows without label; the caller leaves held-out rows out of both tables."""
    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__y")).filter("__y is not null").distinct()
    order = (F.xxhash64(F.col("__id").cast("string")), F.col("__id"))
    good = known.filter("__y = 1").select("__id").orderBy(*order).limit(options.max_positive)
    ids = docs.select(F.col(doc_id).alias("__id"))
    mixed = ids.join(known, "__id", "left_anti").orderBy(*order).limit(options.max_unlabelled)

    def collected(chosen: DataFrame) -> np.ndarray:
        rows = docs.select(F.col(doc_id), F.col(text)).join(F.broadcast(chosen.distinct()), same(F.col(doc_id), F.col("__id")))
        rows = rows.groupBy("__id").agg(F.min_by(text, F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("__text"))  # one row an id
        found = sorted(bytes(r["x"]) for r in _measured(rows, ["__id"], "__text", options).collect())
        x = np.array([np.frombuffer(r, np.float64) for r in found]).reshape(len(found), N_MEASURES)
        return x[np.random.default_rng(0).permutation(len(x))]

    p, u = collected(good), collected(mixed)
    if not len(p):
        return None
    if not len(u):
        u = collected(ids.orderBy(*order).limit(options.max_unlabelled))
    return fit(p, u, options, prior)


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text", options: QualityModelOptions = QualityModelOptions()) -> DataFrame:
    """A row per input row: doc_id, score and predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            texts, own = as_bytes(b, text), held.value
            x = np.array([measures(t, press, options.part) for t in texts]).reshape(len(texts), N_MEASURES)
            s = own.scores(x) if own else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), column(s, pa.float64()), column((s >= 0.5).astype(np.int32), pa.int32())], names=[doc_id, "score", "predicted"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, score double, predicted int")
