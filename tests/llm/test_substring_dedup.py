import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from spanlight.llm import queries
from spanlight.llm.substring_dedup import level_lengths, remove_repeats, window_hashes, without_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_force(rows: list[tuple[int, str | None]], window: int = 20) -> dict[int, tuple[int, int, str]]:
    seen: set[tuple] = set()
    out = {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        rest = [w for w, g in zip(words, gone) if not g]
        out[doc_id] = (len(words), len(words) - len(rest), hashlib.sha256(b" ".join(rest)).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.withColumn("kept_sha256", F.sha2("kept_text", 256)).collect()}


def test_random_texts_equal_brute_force(spark):
    rng = random.Random(3)
    passages = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.randrange(15, 90))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice("xyz") + str(rng.randrange(99)) for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(5))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(200, None), (201, ""), (202, "a " * 300), (203, "a " * 300), (204, "a b " * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for window in (20, 21, 7, 48):
        assert result(remove_repeats(df, window=window)) == brute_force(rows, window)


def test_levels():
    assert [level_lengths(n) for n in (20, 21, 48, 7, 50)] == [[10, 20], [11, 21], [12, 24, 48], [7], [13, 25, 50]]
    rng = np.random.default_rng(1)
    h = rng.integers(0, 50, 300).astype(np.uint64)
    for n in (1, 2, 7, 20, 21, 48):
        x = window_hashes(h, n)
        assert len(x) == 300 - n + 1 and window_hashes(h[:n], n)[0] == x[0] and (window_hashes(h[9:], n) == x[9:]).all()


def test_a_copy_is_known_by_its_own_text(spark):
    """Two rows with one id, of which one is a copy: the other keeps its words and stays the first place of its windows."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in remove_repeats(df).collect())
    assert got == [(1, 0), (2, 0), (2, 40), (3, 40)]


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op6_substring_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute_force(rows)
    assert sum(x[1] for x in got.values()) > 0


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert remove_repeats(empty).collect() == []
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text, "en", "s", 1), (1, text, None, None, None), (1, text, None, None, None), (2, text + "\u00a0x y", "en", "s", 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("at", F.lit(1)).withColumn("h", F.lit("x")).withColumn("marks", F.lit(0))
    got = {(r.doc_id, r.n_words, r.n_removed) for r in remove_repeats(df).collect()}
    assert got == {(None, 30, 0), (1, 30, 30), (2, 31, 29)}
    kept = without_repeats(df, length="n_chars")
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text, r.n_chars) for r in kept.collect()) == [(0, text, 1), (1, "", 0), (1, "", 0), (2, "w29\u00a0x y", 7)]
