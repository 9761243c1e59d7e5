import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanlight.llm import queries, simhash
from spanlight.llm.common import Staged

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def plain_components(prints):
    """prints: list of (doc_id, fingerprint); every pair is looked at."""
    parent = list(range(len(prints)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    f = np.array([p for _, p in prints], np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 3):
            a, b = top(i), top(int(j))
            parent[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            low[top(i)] = min(d, low.get(top(i), d))
    return sorted(((d, f"{p:016x}", low.get(top(i))) for i, (d, p) in enumerate(prints)), key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in docs])
    found = got(queries.op10_simhash(spark, "/root/testdata/sf0.001"))
    assert found == want
    assert len({c for _, _, c in found}) < len(found)


@pytest.mark.parametrize("block", [2048, 40])
def test_links_equal_all_pairs(spark, monkeypatch, block):
    """Random fingerprints, rings of near ones, and a ball dense enough to overflow small blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = set(base) | {0, 2**64 - 1, 7}
    for b in base:
        for _ in range(rng.randrange(4)):
            b ^= sum(1 << k for k in rng.sample(range(64), rng.randrange(1, 6)))
            prints.add(b)
    prints |= {base[0] ^ (1 << i) ^ (1 << j) for i in range(0, 64, 5) for j in range(40, 64, 3)}
    prints = sorted(prints)
    rows = [(simhash._long(p),) for p in prints]
    staged = Staged(spark, "test")
    edges = simhash.links(spark.createDataFrame(rows, "fp long").repartition(3), staged)
    parent = {p[0]: p[0] for p in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in edges.collect():
        assert bin((r.u ^ r.v) & (2**64 - 1)).count("1") <= 64
        a, b = top(r.u), top(r.v)
        parent[a] = b
    mine = {}
    for (x,) in rows:
        mine.setdefault(top(x), set()).add(x % 2**64)
    want = {}
    for d, (_, _, c) in zip(prints, sorted(plain_components(list(enumerate(prints))), key=lambda r: r[0])):
        want.setdefault(c, set()).add(d)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_longer_keys_lose_no_pair_and_hold_few():
    masks = simhash.chain_masks()
    assert len(set(masks)) == 20 and all(m.bit_count() == 32 for m in masks)
    rng = random.Random(3)
    for level in range(1, 4):
        masks = [y for m in rng.sample(masks, 12) for y in simhash.longer_masks(m)]
        for m in rng.sample(masks, 10):
            free = [k for k in range(64) if not m >> k & 1]
            for _ in range(50):  # three differing bits leave one of the four longer masks equal
                d = sum(1 << k for k in rng.sample(free, 3))
                assert any(d & y == 0 for y in simhash.longer_masks(m))
    assert max(64 - y.bit_count() for m in masks for y in simhash.longer_masks(m)) <= 11


def test_chains_lose_no_pair():
    rng = random.Random(9)
    for _ in range(3000):
        a = rng.getrandbits(64)
        n = rng.randrange(0, 6)
        b = a ^ sum(1 << k for k in rng.sample(range(64), n))
        x, y = np.array([a], np.uint64), np.array([b], np.uint64)
        assert bool(simhash.linked(x, y)[0]) == (n <= 3)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.keep_one(empty).collect() == []
    rows = [(5, None, "x", "s", 1), (4, "", None, None, None), (3, "One two", "x", "s", 1), (9, "one TWO", "x", "s", 1), (9, "one TWO", "x", "s", 1), (None, " one\ttwo ", "x", "s", 1), (1, "z " * 50, "x", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("c"))
    found = got(simhash.near_duplicates(df))
    assert found == plain_components([(r[0], plain_fingerprint(r[1])) for r in rows])
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    twice = spark.createDataFrame([rows[3], rows[4]], SCHEMA)
    assert [tuple(r) for r in simhash.keep_one(twice).collect()] == [rows[3]]
