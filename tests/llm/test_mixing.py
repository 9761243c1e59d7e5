import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlight.llm import queries
from spanlight.llm.mixing import fly, land, mix, targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_targets():
    assert targets([100, 100, 100], [5.0, 2.0, 1.0], 450) == [200, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert targets([10, 0, 10], [5, 2, 1], 40) == [20, 0, 20]
    assert targets([], [], 0) == []


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 50, 400):
        sizes, p = rng.integers(0, 900, n).astype(float), rng.random(n)
        flown = fly(sizes, p, 7)
        assert ((flown > 0) & (flown < 1)).sum() <= 2
        assert abs(flown.sum() - p.sum()) < 1e-6 and abs(flown @ sizes - p @ sizes) < 1e-5 * max(1, sizes.sum())
        done = land(sizes, flown)
        assert set(done) <= {0.0, 1.0} and abs(done @ sizes - p @ sizes) <= sizes.max()


def test_inclusion_probabilities_hold():
    sizes, p = np.array([5.0, 9, 9, 30, 2, 7, 11, 4]), np.array([0.2, 0.7, 0.5, 0.4, 0.9, 0.1, 0.6, 0.6])
    mean = np.mean([fly(sizes, p, seed * 7919) for seed in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.04


@pytest.mark.parametrize("block", [8192, 64])
def test_whole_table_meets_its_targets(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mix(docs, block=block).collect()
    plain = {r.doc_id: (len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source) for r in docs.collect()}
    assert {r.doc_id: (r.size, r.source) for r in rows} == plain
    by, total = {}, sum(n for n, _ in plain.values())
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        by.setdefault((r.source, r.source_size, r.target), []).append(r)
    assert sum(t for _, _, t in by) == pytest.approx(min(1.5 * total, sum(2 * n for _, n, _ in by)))
    for (_, size, target), own in by.items():
        assert sum(r.size for r in own) == size
        assert abs(sum(r.taken for r in own) - target) <= (0.015 * target if block > 100 else max(r.size for r in own) / 2)
    again = mix(docs.repartition(7), block=block).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_edges(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, None, "x", None, 1), (1, "", "x", "b", 1), (2, "a b c", "x", "b", 1), (2, "a b c", "x", "b", 1), (3, "d", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("x")).withColumn("p", F.lit(1)).withColumn("target", F.lit(1))
    found = sorted((r.doc_id or 0, r.source, r.size, r.source_size, r.target, r.taken) for r in mix(df).collect())
    assert [x[:4] for x in found] == [(0, None, 0, 1), (1, "b", 0, 6), (2, "b", 3, 6), (2, "b", 3, 6), (3, None, 1, 1)]
    assert [x[4] for x in found] == [2.0, 8.5, 8.5, 8.5, 2.0] and sum(x[5] for x in found) in (8, 11)


def test_query_columns(spark):
    assert queries.op8_mixing(spark, "/root/testdata/sf0.001").columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]


def totals(found):
    by = {}
    for r in found:
        taken, target, n = by.get(r.source, (0, r.target, 0))
        by[r.source] = taken + r.taken, target, n + 1
    return by


def test_sources_land_near_their_targets_beside_a_large_one(spark):
    """A source's accuracy does not depend on how large the others are, and a large one lands as well."""
    rng, rows = np.random.default_rng(4), []
    for source, n in (("a", 50), ("b", 400), ("c", 2600), ("d", 60), ("e", 20000)):
        rows += [(len(rows) + k, "w " * int(rng.integers(20, 900)), source) for k in range(n)]
    big = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    small = big.filter("source <> 'e'")
    for df, block in ((big, 8192), (small, 8192), (big, 512)):
        for source, (taken, target, n) in totals(mix(df, block=block).collect()).items():
            assert abs(taken - target) <= 0.001 * target, (source, n, taken, target, block)


def test_equal_rows_have_draws_of_their_own(spark):
    """Copies of one row, ids null: they fill many blocks, and half of them is taken where half is due."""
    df = spark.createDataFrame([(None, "a b c", "s")], "doc_id long, text string, source string").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(70000))))
    found = mix(df.drop("k"), block=1024)
    counts = {r.taken: r.n for r in found.groupBy("taken").agg(F.count("*").alias("n")).collect()}
    assert sum(counts.values()) == 70000 and abs(counts[6] - 35000) <= 2 and abs(counts[3] - 35000) <= 2
    long = spark.createDataFrame([(1, "x " * 300000, "s"), (2, "y", "s")], "doc_id long, text string, source string")
    assert sorted(r.size for r in mix(long).collect()) == [1, 300000]
