"""Mixing sources to target weights by cube-method balanced sampling.

Every source has a target number of words. A document is taken floor(r) times whole, r being
target over size of its source, and once more with the fractional rest of r as its inclusion
probability. Which documents get the extra turn is drawn by the cube method: probabilities
move along the null space of the balancing constraints (words and documents of the source)
until each is 0 or 1. Three probabilities always leave such a direction free, so the flight
ends with two undecided documents at most.

The flight runs in blocks of a bounded number of documents, dealt by a hash, so that a source
with a third of all rows is many tasks. What the blocks leave undecided, two documents each,
flies again as one block level up, and so on until one block is left of a source; each source
goes by its own size, whatever the others are. About LANDING documents of every source, drawn by
their hash, wait for that last block. There the two open documents and LANDING others of all
lengths make the landing problem, which takes the outcome nearest to the word total. If a
document of a small source is a large part of it, single decisions are then turned round until
the total is near.

Directions are drawn from hashes of id, size, source and number among equal rows, so reruns
agree. Only sizes per source, a row each, come to the driver: sources are a list that somebody
gave weights to, at most MAX_SOURCES. Texts are read once and not moved.

A null text has size 0; a null source is a source of its own and the last. Repeated rows and
repeated or null ids are drawn row by row. A source of size 0 has target 0. Texts of any length
are one number here. Columns beside id, text and source are not looked at. An empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, n_words, same

WEIGHTS = (5.0, 2.0, 1.0)
#: The share of all sizes that the mix holds, and how often a document is taken at most.
TOTAL = 1.5
MOST = 2.0
BLOCK = 8192
#: Documents of a source's last block, long and short ones, that land with what the flight leaves open.
LANDING = 12
MAX_SOURCES = 1_000_000
#: Equal rows that one array numbers.
RUN = 1 << 16
EPS = 1e-9


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """Shares of total by weight, capped at most times the size; the excess is shared again until none is above."""
    out, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(total)
    while free:
        weight = sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] / weight > most * sizes[i]]
        if not above:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in above:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in above)
        free = [i for i in free if i not in set(above)]
    return out


def _draw(seed: int, k: int) -> float:
    return xxhash.xxh64_intdigest(k.to_bytes(8, "little"), seed & (2**64 - 1)) / 2.0**64


def fly(sizes: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities after the flight: all 0 or 1 but for two at most; sums of p and of p * size are kept."""
    p = p.astype(float).copy()
    held: list[int] = []
    for i in range(len(p)):
        if EPS < p[i] < 1 - EPS:
            held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = np.array([sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b]], float)
        if not u.any():
            u = np.array([1.0, -1.0, 0.0])
        u /= np.abs(u).max()
        x = p[held]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - x) / u, np.where(u < 0, -x / u, np.inf)).min()
            down = np.where(u > 0, x / u, np.where(u < 0, (x - 1) / u, np.inf)).min()
        x = x + up * u if _draw(seed, i) * (up + down) < down else x - down * u
        x = np.where(x < EPS, 0.0, np.where(x > 1 - EPS, 1.0, x))
        p[held] = x
        held = [j for j in held if 0 < p[j] < 1]
    return np.where(p < EPS, 0.0, np.where(p > 1 - EPS, 1.0, p))


def land(sizes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Decides what a flight left open: of all outcomes the one nearest to the word total.

    A document more or less than one off the document total counts as a mean size of words.
    """
    at = np.flatnonzero((p > 0) & (p < 1))
    if not len(at):
        return p
    outcomes = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
    words = np.abs(outcomes @ sizes[at] - p[at] @ sizes[at])
    docs = np.abs(outcomes.sum(1) - p[at].sum())
    p = p.copy()
    p[at] = outcomes[np.argmin(words + sizes[at].mean() * np.maximum(0, docs - 1))]
    return p


def repair(sizes: np.ndarray, p: np.ndarray, words: float, tolerance: float = 0.001) -> np.ndarray:
    """Turns single decisions round while the word total is off by more than the tolerance and one turn brings it nearer.

    This matters only where one document is a large part of a small source.
    """
    p = p.copy()
    for _ in range(len(p)):
        off = p @ sizes - words
        after = np.abs(off + np.where(p > 0, -sizes, sizes))
        if abs(off) <= tolerance * words or after.min() >= abs(off):
            break
        k = int(np.argmin(after))
        p[k] = 1 - p[k]
    return p


def _flight(block: int):
    """For applyInPandas over a block of one source: its flight, and its landing where it is the source's only one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "draw", "doc_id"], ascending=[False, True, True], ignore_index=True)
        sizes, p = pdf["size"].to_numpy(float), pdf["p"].to_numpy(float).copy()
        last = pdf["docs"].iloc[0] <= block
        flies = np.ones(len(p), bool)
        if last:
            flies[np.linspace(0, len(p) - 1, min(LANDING, len(p))).astype(int)] = False
        p[flies] = fly(sizes[flies], p[flies], int(pdf["draw"].iloc[0]) ^ len(pdf))
        p = np.where(p < EPS, 0.0, np.where(p > 1 - EPS, 1.0, p))
        if last:
            p = repair(sizes, land(sizes, p), pdf["p"].to_numpy(float) @ sizes)
        return pdf.assign(p=p)

    return run


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, docs, target): sources by code point take the weights in turn; null is the last."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "")))
    sizes = [r["size"] for r in rows]
    found = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], total * sum(sizes), most)
    data = [(r["source"], r["size"], r["docs"], t) for r, t in zip(rows, found)]
    return sized.sparkSession.createDataFrame(data, "source string, source_size long, docs long, target double")


def _numbered(sized: DataFrame) -> DataFrame:
    """(doc_id, source, size, draw): every row with a hash of its own; rows that are equal are counted, then numbered."""
    runs = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1).cast("long"), F.lit(RUN).cast("long"))).alias("low")
    parts = runs.select("doc_id", "source", "size", "n", part)
    number = F.explode(F.sequence("low", F.least(F.col("low") + RUN, F.col("n")) - 1)).alias("number")
    rows = parts.select("doc_id", "source", "size", number)
    return rows.select("doc_id", "source", "size", F.xxhash64("doc_id", "size", "source", F.nullif("number", F.lit(0).cast("long"))).alias("draw"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """A row per input row: doc_id, size, source, source_size, target and taken (words, repeats counted)."""
    if block < 4 * LANDING:
        raise ValueError(f"a block holds {4 * LANDING} documents at least")
    staged = Staged(docs.sparkSession, "mixing")
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    sized = staged.put(_numbered(sized), "sized")
    plan = source_targets(sized, weights, total, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    found = (
        sized.withColumnRenamed("source", "__s")
        .join(plan, same(F.col("__s"), plan.source))
        .withColumn("whole", F.floor(rate + EPS))
        .withColumn("p", F.greatest(F.lit(0.0), rate - F.col("whole")))
        .withColumn("waits", (F.col("docs") > block) & (F.pmod(F.xxhash64("draw"), F.col("docs")) < LANDING))
        .select("doc_id", "source", "size", "source_size", "docs", "target", "whole", "p", "draw", "waits")
    )
    schema, parts, level = found.schema, [], 0
    most_docs = plan.agg(F.max("docs")).first()[0] or 0
    while True:
        n = F.ceil(F.col("docs") / block)
        up = found.filter("not waits") if most_docs > block else found
        flown = staged.put(up.groupBy("source", F.pmod("draw", n).alias("b")).applyInPandas(_flight(block), schema), f"flight{level}")
        if most_docs <= block:
            parts.append(flown)
            break
        # A block leaves two documents at most, which bounds the next level without a count.
        parts.append(flown.filter(f"docs <= {block} or p = 0 or p = 1"))
        left = flown.filter(f"docs > {block} and p > 0 and p < 1").unionByName(found.filter("waits"))
        most_docs, level = _above(most_docs, block), level + 1
        docs_left = (2 * n + 2 * LANDING).cast("long")
        found = left.withColumn("docs", docs_left).withColumn("waits", F.col("waits") & (F.col("docs") > block))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    taken = (F.col("size") * (F.col("whole") + F.col("p"))).cast("long")
    return out.select(F.col("doc_id").alias(doc_id), "size", F.col("source").alias(source), "source_size", "target", taken.alias("taken"))


def _above(docs: int, block: int) -> int:
    """How many documents of a source a level hands on at most, but for the chance number of those that wait."""
    return 2 * -(-docs // block) + 2 * LANDING
