"""Substring deduplication by level-wise doubling.

A window of 20 words can repeat only if the 10-word windows inside it repeat, so windows are
looked at level by level: those that repeat at one length alone are extended to twice that
length (one word less where the removal window is odd), until none survives or the length of a
removal window is reached. Longer levels could not change what is removed, since a longer
repeat is covered by its 20-word windows.

At the levels below the last, one window stands for many: each removal window names its
smallest sub-window hash at the level, so equal removal windows name equal sub-windows and
about one position in six is counted rather than all. A removal window whose named sub-window
is unique in the corpus is unique itself and is dropped there; nothing is lost.

Below the last level a hash of 64 bits decides, where a collision only lets a window live on. At
the last one a second hash, of other bits of the words, stands beside it, so that windows are
equal by 128 bits. A document whose whole text an earlier one has (by SHA-256) repeats as a
whole and takes no part in the levels after the first.

Counts and first places are partial aggregates, kept as tables, and come back by joins that
Spark may split, so a passage or a text that a third of all documents share fills no task.
Windows are judged on the input.

Null texts have no words. Texts shorter than a window lose nothing. Rows that repeat an id are
one document: what starts in one of them does not start earlier than in another, and all get
the marks of all; but a row is a copy only by its own text. A null id sorts before all others.
Texts are taken whole, whatever their length. Columns beside id and text are not looked at. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, as_bytes, column, free_names, same

WINDOW = 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def level_lengths(window: int, least: int = 10) -> list[int]:
    """The lengths of the levels, each at most twice the one before: 10 and 20 for 20, 12, 24 and 48 for 48, 11 and 21 for 21."""
    out = [window]
    while (half := (out[0] + 1) // 2) >= least:
        out.insert(0, half)
    return out


class Words:
    """Hashes of words under a seed, remembered while there is room."""

    def __init__(self, seed: int, most: int = 300_000):
        self.known: dict[bytes, int] = {}
        self.seed, self.most = seed, most

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known, digest, seed = self.known, xxhash.xxh3_64_intdigest, self.seed
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = digest(w, seed)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def grown(x: np.ndarray, length: int, to: int) -> np.ndarray:
    """Hashes of all windows of `to` words from those of `length`, at least half as long; none if there are too few words."""
    n = max(0, len(x) - (to - length))
    return _mixed(x[:n] * ODD + x[len(x) - n :]) if n else np.zeros(0, np.uint64)


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of so many words, grown from shorter ones."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    x, have = h, 1
    while have < length:
        to = min(2 * have, length)
        x, have = grown(x, have, to), to
    return x


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each so many neighbours."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def named(x: np.ndarray, width: int, living: np.ndarray | None = None) -> np.ndarray:
    """Which windows are the smallest of some living removal window that has so many of them."""
    out = np.zeros(len(x), bool)
    least = _least(x, width)
    for d in range(width):
        met = x[d : d + len(least)] == least
        out[d : d + len(least)] |= met if living is None else met & living
    return out


def candidates(x: np.ndarray, width: int, survives: np.ndarray) -> np.ndarray:
    """Which removal windows name a window that survives."""
    least = _least(x, width)
    out = np.zeros(len(least), bool)
    for d in range(width):
        out |= survives[d : d + len(least)] & (x[d : d + len(least)] == least)
    return out


def _later_here(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Which windows stand earlier in the document too."""
    out = np.ones(len(h), bool)
    first = np.unique(h, return_index=True)[1]
    if len(first) == len(h):
        return ~out
    if (g[first][np.searchsorted(h[first], h)] != g).any():  # windows that only one of the hashes takes for equal
        first = np.unique(np.stack([h, g], axis=1), axis=0, return_index=True)[1]
    out[first] = False
    return out


COLUMNS = "h long, g long, at int, again boolean"


def _level(docs: DataFrame, doc_id: str, text: str, lengths: list[int], k: int) -> DataFrame:
    """(doc_id, h, g, at, again): the windows of the length at level k that living removal windows name; at the last level these themselves.

    docs: (doc_id, text), and after the first level marks (places of the surviving windows of
    the level before) and copies (prints of rows that leave). again: the document has the window
    earlier too. g is the second hash, and 0 below the last level.
    """
    length, window = lengths[k], lengths[-1]
    last, width = length == window, window - length + 1

    def windows(t: bytes, first: Words, second: Words, marks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = t.split()
        h = first.hashes(words)
        if len(h) < window:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        x, living = window_hashes(h, lengths[0]), None
        for a, b in zip(lengths[:k], lengths[1:]):
            if b == length:
                survives = np.zeros(len(x), bool)
                survives[marks[marks < len(x)]] = True
                living = candidates(x, window - a + 1, survives)
            x = grown(x, a, b)
        if not last:
            at = np.flatnonzero(named(x, width, living))
            return at, x[at], np.zeros(len(at), np.uint64)
        at = np.arange(len(x)) if living is None else np.flatnonzero(living)
        return at, x[at], window_hashes(second.hashes(words), window)[at] if len(at) else np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Words(0), Words(1)
        for b in batches:
            texts = as_bytes(b, text)
            marks = [m.values.to_numpy() for m in b.column("marks")] if k else [None] * len(texts)
            copies = b.column("copies").to_pylist() if k else [None] * len(texts)
            for at in range(0, len(texts), 256):  # a part of a batch at a time, so that long texts do not add up
                part = range(at, min(at + 256, len(texts)))
                found = [windows(b"" if copies[i] and _print(texts[i]) in copies[i] else texts[i], *hashes, marks[i]) for i in part]
                ids = b.column(0).take(pa.array(np.repeat(part, [len(f[0]) for f in found])))
                place, h, g = (np.concatenate([f[i] for f in found]) for i in range(3))
                again = np.concatenate([_later_here(h_, g_) for _, h_, g_ in found])
                columns = [column(h.astype(np.uint64).view(np.int64), pa.int64()), column(g.astype(np.uint64).view(np.int64), pa.int64()), column(place.astype(np.int32), pa.int32()), column(again, pa.bool_())]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "h", "g", "at", "again"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, {COLUMNS}")


def _print(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def _copies(docs: DataFrame, doc_id: str, text: str, staged: Staged) -> DataFrame:
    """(doc_id, prints, whole): prints of the texts of an id that an earlier id has; whole if these are all its rows.

    All windows of such a row start earlier. The first ids of repeated texts are a table, so
    that a text that is everywhere is joined by plain exchanges, which Spark may split.
    """
    print_ = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    prints = staged.put(docs.select(F.col(doc_id).alias("doc_id"), print_.alias("print")), "prints")
    lowest = prints.groupBy("print").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"), F.count("doc_id").alias("ids")).filter("n > 1")
    lowest = staged.put(lowest, "originals")
    found = staged.put(prints.join(lowest, "print").filter("doc_id > low or (doc_id is not null and ids < n)").select("doc_id", "print"), "copied")
    rows = prints.join(found.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("rows"))
    mine = found.groupBy("doc_id").agg(F.collect_set("print").alias("prints"), F.count("*").alias("gone"))
    return mine.join(rows, "doc_id").select("doc_id", "prints", (F.col("gone") == F.col("rows")).alias("whole"))


def _repeated(windows: DataFrame, staged: Staged, level: int) -> DataFrame:
    """The windows whose hash is there twice or more, by document: (doc_id, marks).

    The repeated hashes are a table of their own, so that both sides of the join are plain
    exchanges, which Spark may split; a window that its document has earlier needs no join.
    """
    twice = staged.put(windows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), f"twice{level}")
    found = windows.filter("not again").join(twice, "h").select("doc_id", "at")
    found = found.unionByName(windows.filter("again").select("doc_id", "at"))
    return found.groupBy("doc_id").agg(F.collect_list("at").alias("marks"))


def repeats(docs: DataFrame, staged: Staged, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(doc_id, marks): starts of the windows whose words also start earlier; (doc_id, prints): copies, which repeat as a whole.

    Copies leave the levels after the first: each of their windows starts earlier in their
    original, so they are no window's first place.
    """
    copies = staged.put(_copies(docs, doc_id, text, staged), "copies")
    lengths = level_lengths(window)
    only = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    level = staged.put(_level(only, "__id", "__text", lengths, 0), "level0")
    for k in range(1, len(lengths)):
        marks = _repeated(level, staged, k).join(copies.filter("not whole").select("doc_id", "prints"), "doc_id", "left").join(copies.filter("whole"), "doc_id", "left_anti")
        living = only.join(marks, same(F.col("__id"), F.col("doc_id"))).select("__id", "__text", "marks", F.coalesce("prints", F.array().cast("array<binary>")).alias("copies"))
        level = staged.put(_level(living, "__id", "__text", lengths, k), f"level{k}")
        staged.drop(f"level{k - 1}")
        if level.isEmpty():  # none survives
            break
    # A document's first place of a window is compared with other documents, its later ones need not be.
    ahead = level.filter("not again").select("h", "g", "doc_id", "at")
    lowest = ahead.groupBy("h", "g").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"), F.count("doc_id").alias("ids")).filter("n > 1")
    lowest = staged.put(lowest, "lowest")
    later = ahead.join(lowest, ["h", "g"]).filter("doc_id > low or (doc_id is not null and ids < n)").select("doc_id", "at")
    later = staged.put(later.unionByName(level.filter("again").select("doc_id", "at")), "later")
    staged.drop(f"level{len(lengths) - 1}")
    return later.groupBy("doc_id").agg(F.collect_list("at").alias("marks")), copies


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window of these starts."""
    edge = np.zeros(n + 1, np.int64)
    starts = np.unique(starts)
    starts = starts[starts + window <= n]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:n]) > 0


def _kept(text: bytes, marks, copies: list[bytes] | None, window: int) -> tuple[list[bytes], list[bytes]]:
    words = text.split()
    if copies and len(words) >= window and _print(text) in copies:
        return words, []
    if marks is None or not len(words):
        return words, words
    gone = covered(len(words), marks.to_numpy().astype(np.int64), window)
    return words, [w for w, x in zip(words, gone) if not x]


def _marked(docs: DataFrame, doc_id: str, text: str, window: int) -> tuple[DataFrame, str, str]:
    """The rows with the marks and copies of their ids, a row of both an id, and the names of these columns."""
    key, marked, copied = free_names(docs, "own_key", "own_marks", "own_copies")
    marks, copies = repeats(docs, Staged(docs.sparkSession, "substring"), doc_id, text, window)
    none = lambda kind: F.lit(None).cast(kind)
    both = marks.select("doc_id", "marks", none("array<binary>").alias("prints")).unionByName(copies.select("doc_id", none("array<int>").alias("marks"), "prints"))
    both = both.groupBy(F.col("doc_id").alias(key)).agg(F.first("marks", ignorenulls=True).alias(marked), F.first("prints", ignorenulls=True).alias(copied))
    return docs.join(both, same(docs[doc_id], both[key]), "left").drop(key), marked, copied


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """A row per input row: doc_id, n_words, n_removed and kept_text, the kept words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, kept = [], [], []
            for t, m, c in zip(as_bytes(b, text), b.column(marked), b.column(copied).to_pylist()):
                words, rest = _kept(t, m.values, c, window)
                n.append(len(words))
                removed.append(len(words) - len(rest))
                kept.append(b" ".join(rest).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), column(n, pa.int64()), column(removed, pa.int64()), column(kept, pa.string())], names=[doc_id, "n_words", "n_removed", "kept_text"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows, marked, copied = _marked(docs.select(doc_id, text), doc_id, text, window)
    return rows.mapInArrow(run, f"`{doc_id}` {kind}, n_words long, n_removed long, kept_text string")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = None, window: int = WINDOW) -> DataFrame:
    """All rows and columns, with texts that lost repeated words cut to the kept ones.

    A text that loses nothing stays as it is; one that loses every word becomes empty. The
    column named by length, if any, is set to the new text's code points where the text changed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sizes = b.column(text).to_pylist(), b.column(length).to_pylist() if length else None
            for i, (t, m, c) in enumerate(zip(as_bytes(b, text), b.column(marked), b.column(copied).to_pylist())):
                if c or m.values is not None:
                    words, rest = _kept(t, m.values, c, window)
                    if len(rest) < len(words):
                        texts[i] = b" ".join(rest).decode()
                        if length:
                            sizes[i] = len(texts[i])
            out = b.drop_columns([marked, copied])
            out = out.set_column(out.schema.get_field_index(text), text, column(texts, out.schema.field(text).type))
            if length:
                out = out.set_column(out.schema.get_field_index(length), length, column(sizes, out.schema.field(length).type))
            yield out

    rows, marked, copied = _marked(docs, doc_id, text, window)
    return rows.mapInArrow(run, docs.schema)
