import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlight.llm import similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_distance():
    assert similar.most_bits(0.8) == 26 and similar.most_bits(1.0) == 0


def test_chains_lose_no_pair():
    rng = random.Random(2)
    for _ in range(1500):
        n = rng.randrange(15, 40)
        flips = sum(1 << k for k in rng.sample(range(128), n))
        a = np.array([[5, 9]], np.uint64)
        b = a ^ np.array([[flips & (2**64 - 1), flips >> 64]], np.uint64)
        assert bool(similar.linked(a, b, 26)[0]) == (n <= 26)


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("block", [2048, 8])
def test_near_copies_are_one_group_and_others_stay(spark, block):
    rng = random.Random(4)
    word = lambda: rng.choice("bcdfgh") + str(rng.randrange(400))
    rows, families = [], []
    for f in range(25):
        base = [word() for _ in range(rng.randrange(150, 400))]
        family = [base]
        for _ in range(rng.randrange(4) if f else 30):
            copy = list(base)
            for _ in range(max(1, len(copy) // 90)):
                copy[rng.randrange(len(copy))] = word()
            family.append(copy)
        families.append([len(rows) + k for k in range(len(family))])
        rows += [(len(rows) + k, " ".join(w)) for k, w in enumerate(family)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in similar.groups(df, block=block).collect()}
    for members in families:
        near = [m for m in members if jaccard(rows[m][1], rows[members[0]][1]) >= 0.85]
        assert {found[m] for m in near} == {members[0]}
    assert len(set(found.values())) == len(families)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert similar.groups(empty).collect() == [] and similar.keep_one(empty).collect() == []
    rows = [(5, None, "x", "s", 1), (4, "", None, None, None), (3, "One two", "x", "s", 1), (9, "one TWO", "x", "s", 1), (9, "one TWO", "x", "s", 1), (None, " one\ttwo ", "x", "s", 1), (1, "z " * 50, "x", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("u", F.lit(1)).withColumn("component_id", F.lit("c"))
    kept = similar.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    twice = spark.createDataFrame([rows[3], rows[4]], SCHEMA)
    assert [tuple(r) for r in similar.keep_one(twice).collect()] == [rows[3]]


def test_links_are_those_of_the_exact_jaccard(spark):
    """Copies with more and more edits, and of different lengths: groups are the components of the exact links."""
    rng = random.Random(6)
    word = lambda: rng.choice("bcdfgh") + str(rng.randrange(400))
    texts = []
    for f in range(60):
        base = [word() for _ in range(rng.randrange(60, 300))]
        texts.append(base)
        for k in range(4):
            copy = list(base)
            for _ in range(max(1, round(len(copy) * rng.choice([0.01, 0.02, 0.022, 0.03, 0.04])))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy if k else copy[: round(len(copy) * rng.choice([0.85, 0.78]))])
    texts = [" ".join(t) for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if a // 5 == b // 5 and root[a] != root[b] and jaccard(texts[a], texts[b]) >= 0.8:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for most_sets in (1024, 2):
        assert {r.doc_id: r.component_id for r in similar.groups(df, most_sets=most_sets).collect()} == dict(enumerate(root))
    assert 60 < len(set(root)) < len(texts)


def test_common_passages_make_no_candidates_of_their_own_and_lose_none(spark):
    """A passage that all texts share, in texts of which it is a part: its keys come last, and links stay exact."""
    rng = random.Random(8)
    word = lambda: rng.choice("bcdfgh") + str(rng.randrange(4000))
    passage, texts = [word() for _ in range(60)], []
    for f in range(40):
        base = [word() for _ in range(rng.randrange(20, 160))]
        texts += [base + passage, [*base[:-1], word()] + passage, passage + base[: len(base) // 2]]
    texts = [" ".join(t) for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if root[a] != root[b] and jaccard(texts[a], texts[b]) >= 0.8:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for block in (2048, 12):
        assert {r.doc_id: r.component_id for r in similar.groups(df, block=block).collect()} == dict(enumerate(root))


def test_sketches_share_what_they_are_said_to():
    assert similar.common_keys(0.8) >= 10
    rng, least = np.random.default_rng(5), 99
    for _ in range(3000):
        h = np.unique(rng.integers(0, 2**63, 900))
        x = rng.permutation(h)  # 720 of 900 are in both
        a, b = np.sort(x[:810]), np.sort(np.concatenate((x[:720], x[810:])))
        least = min(least, len(np.intersect1d(a[: similar.SKETCH], b[: similar.SKETCH])))
    assert least >= similar.common_keys(0.8)


def test_every_row_gets_one_and_maps_pass(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "x")], "doc_id long, text string")
    df = df.withColumn("m", F.create_map(F.lit("k"), F.lit(1))).withColumn("held", F.lit(2)).withColumn("n", F.lit("z"))
    kept = similar.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "x"), (1, "a b c d e f")]
    long = "w " * 10 + " ".join(f"v{i}" for i in range(120_000))
    big = spark.createDataFrame([(1, long), (2, long + " end")], "doc_id long, text string")
    assert [r.doc_id for r in similar.keep_one(big).collect()] == [1]


def test_cosine_links_equal_all_pairs(spark):
    """Texts that share from half to all of their shingles, of equal and of unequal lengths."""
    rng = random.Random(12)
    rows = []
    for f in range(30):
        base = [f"f{f}w{k}" for k in range(200)]
        for _ in range(4):
            copy = [w if rng.random() >= rng.choice([0.01, 0.03, 0.045, 0.06]) else "other" for w in base]
            rows.append((len(rows), " ".join(copy[: rng.choice([200, 200, 150, 120])])))
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in rows for w in [t.split()]}
    root = {d: d for d in sets}
    for _ in range(8):
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * (len(sets[a]) * len(sets[b])) ** 0.5 - 1e-6:
                    root[a] = root[b] = min(root[a], root[b])
    found = similar.groups(spark.createDataFrame(rows, "doc_id long, text string"), measure="cosine")
    assert {r.doc_id: r.component_id for r in found.collect()} == root and 30 < len(set(root.values())) < 115
