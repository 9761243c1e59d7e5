"""Spelling variants of words, grouped by a symmetric-delete join.

Words are counted over all texts. Every frequent word emits itself and its distinct single
deletions as keys; words that share a key meet in an equi-join, and a pair counts if its edit
distance is exactly one. Two words at distance one share exactly one key: the shorter word
itself, or what is left of both without the place in which they differ. So no pair repeats. A
key is met by its own word and by words with one letter more, so the length of words and the
alphabet bound its rows, however large the corpus is. The keys of words of LONG letters and
more are 64-bit hashes, all computed in one pass over the word, and travel with a hash of the
word; the words join those that meet. So very long words take linear space, and are verified
as exactly, in linear time.

A word's form is its near word with the most occurrences, if that has at least `ratio` times as
many as the word. Occurrences grow along the forms, so they have no circle; words that have a
form are joined with the forms of their forms, twice as far in each round, until nothing moves.

Words are runs of `letters`; only A-Z are lower-cased. Counts are summed in each task before
they are shuffled, in parts of bounded size, so a word that fills a third of the corpus is a
row a task.

With typo_every = k, words get typos on purpose: h is the unsigned crc32 of `<doc_id>:<word>`,
and where k divides it, the word's code point h % length is deleted. The typo depends on the
document and the word alone, so reruns agree.

Null and empty texts have no words; a null id is the empty text in `<doc_id>`. Repeated rows
count as often as they occur. Texts are taken whole, whatever their length; a run of letters of any
length is one word. Ties of occurrences go to the word that is first by code points. Columns
beside id and text are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import Staged, as_bytes, column

#: Letters from which on keys are hashes.
LONG = 64


@dataclass(frozen=True)
class SpellingOptions:
    letters: str = "A-Za-zÀ-ÿ"
    shortest: int = 5
    least: int = 3
    ratio: int = 2
    typo_every: int = 0
    #: Words whose counts a task holds before it hands them on.
    held: int = 300_000


def count_words(docs: DataFrame, options: SpellingOptions = SpellingOptions(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough."""
    run = re.compile(f"[{options.letters}]+")

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            ids = b.column(0).to_pylist()
            for own, raw in zip(ids, as_bytes(b, text)):
                words = Counter(run.findall(raw.lower().decode()))  # bytes lower-case A-Z only
                if options.typo_every:
                    words = spoilt(words, own or "", options.typo_every)
                for w, n in words.items():
                    if len(w) >= options.shortest:
                        counts[w] += n
                if len(counts) > options.held:
                    yield batch_of(counts)
                    counts.clear()
        yield batch_of(counts)

    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias(text))
    parts = rows.mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= options.least)


def spoilt(words: Counter, doc_id: str, every: int) -> Counter:
    """The words of a document, some with a letter deleted."""
    first, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for w, n in words.items():
        h = zlib.crc32(w.encode(), first)
        if h % every == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
        out[w] += n
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): the pairs of words at edit distance one, in both directions."""
    left_out = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring(F.col("word"), 1, i - 1), F.substring(F.col("word"), i + 1, F.length("word"))))
    short = words.filter(F.length("word") <= LONG)
    keys = short.select("word", "n", F.explode(F.array_distinct(F.concat(F.array("word"), left_out))).alias("key"))
    a, b = keys.toDF("a", "a_n", "key"), keys.toDF("b", "b_n", "key")
    met = a.join(b.hint("merge"), "key").select("a", "a_n", "b", "b_n")
    one = met.filter((F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1)).unionByName(_long_pairs(words))
    both = F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    return one.select(F.inline(both))


def _mixed(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    x = codes * np.uint64(0x9E3779B97F4A7C15) + at * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def word_hashes(word: str) -> tuple[int, np.ndarray]:
    """The word's hash, a sum over its letters and their places, and those of the word and its distinct deletions."""
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    at = np.arange(len(codes), dtype=np.uint64)
    here, moved = np.cumsum(_mixed(codes, at)), np.cumsum(_mixed(codes, at - np.uint64(1)))
    whole = here[-1:].view(np.int64)
    left_out = np.r_[np.zeros(1, np.uint64), here[:-1]] + (moved[-1] - moved)
    return int(whole[0]), np.unique(np.r_[whole, left_out.view(np.int64)])


def _long_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): pairs that share a key and of which one is longer than LONG."""
    long = words.filter(F.length("word") >= LONG)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in b.column(0).to_pylist():
                own, found = word_hashes(w)
                yield pa.RecordBatch.from_arrays([column(np.full(len(found), own), pa.int64()), column(found, pa.int64())], names=["id", "key"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([word_hashes(w)[0] for w in b.column(0).to_pylist()], pa.int64()), *b.columns], names=["id", "word", "n"])

    found = long.select("word").mapInArrow(keys, "id long, key long")
    x, y = found.toDF("x", "key"), found.toDF("y", "key")
    met = x.join(y.hint("merge"), "key").filter("x <> y").select("x", "y").distinct()
    names = long.select("word", "n").mapInArrow(named, "id long, word string, n long")
    pairs = met.join(names.toDF("x", "a", "a_n").hint("merge"), "x").join(names.toDF("y", "b", "b_n").hint("merge"), "y")
    longer = pairs.filter((F.greatest(F.length("a"), F.length("b")) > LONG) & (F.col("a") < F.col("b")))
    return longer.filter(_one_apart("a", "b")).select("a", "a_n", "b", "b_n")


def one_apart(a: str, b: str) -> bool:
    """Whether the edit distance is exactly one, in linear time: behind the common beginning one letter is all that differs."""
    a, b = sorted((a, b), key=len)
    at = len(commonprefix((a, b)))
    return a != b and (a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[at:] == b[at + 1 :])


@F.pandas_udf(BooleanType())
def _one_apart(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([one_apart(x, y) for x, y in zip(a, b)], dtype=bool)


def forms(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word; form and form_n are null where no near word has enough occurrences."""
    alone = words.select("word", "n", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("other_n"))
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("minus"), "other")))
    found = near_pairs(words).unionByName(alone).groupBy("word", "n").agg(F.count("other").alias("n_near"), best.alias("b"))
    enough = -F.col("b.minus") >= ratio * F.col("n")
    return found.select("word", "n", "n_near", F.when(enough, F.col("b.other")).alias("form"), F.when(enough, -F.col("b.minus")).alias("form_n"))


def roots(formed: DataFrame, staged: Staged) -> DataFrame:
    """(word, root) of the words that have a form, from a table (word, form)."""
    now = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    for k in range(60):  # each round doubles the steps, and each step the occurrences
        now = staged.put(now, f"roots{k}", tidy=False)
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(ahead, "root", "left_semi").isEmpty():
            break
        now = now.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return now


def group_spellings(docs: DataFrame, options: SpellingOptions = SpellingOptions(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): every frequent word with its form and the end of its forms."""
    staged = Staged(docs.sparkSession, "spelling")
    words = staged.put(count_words(docs, options, doc_id, text), "words", tidy=False)
    formed = staged.put(forms(words, options.ratio), "forms")
    ends = roots(formed, staged)
    moved = formed.filter("form is not null").join(ends, "word")
    stays = formed.filter("form is null").withColumn("root", F.col("word"))
    return moved.unionByName(stays).select("word", "form", "root", "n", "n_near", "form_n")
