"""Chunks by pointer doubling, running values in blocks, and the interval index, against plain loops."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanlight.operators import chunks as C
from spanlight.operators import intervals as I
from spanlight.operators.scans import running


def loop_chunks(lines, start, limit, most, overlap):
    """The greedy chunks of captions start to limit as a plain loop over (start, end, size)."""
    out, at = [], start
    while at < limit:
        stop, chars = at, 0
        while stop < limit and (stop == at or chars + lines[stop][2] + 1 <= most):
            chars += lines[stop][2] + 1
            stop += 1
        if stop < limit:
            least = at + max(1, int((stop - at) * 0.75))
            stop = next((k for k in range(stop, least, -1) if lines[k][0] - lines[k - 1][1] >= 1200), stop)
        out.append((at, stop))
        if stop >= limit:
            break
        cut, back = lines[stop - 1][1] - overlap, stop
        while back > at + 1 and lines[back - 1][1] > cut:
            back -= 1
        at = max(at + 1, back)
    return out


@pytest.mark.parametrize("block, most, overlap", [(7, 200, 20_000.0), (64, 900, 0.0), (4096, 90, 5_000.0)])
def test_chunks_of_ranges_equal_a_loop(spark, monkeypatch, block, most, overlap):
    """Long captions that end late, pauses, lines longer than a chunk, ranges that start and end anywhere or are empty."""
    monkeypatch.setattr(C, "BLOCK", block)
    rng, rows, ranges, want = random.Random(block), [], [], set()
    for v, n in enumerate([1, 5, 90, 150]):
        t, lines = 0, []
        for i in range(n):
            t += rng.choice([0, 500, 2000, 5000, 9000])
            lines.append((float(t), float(t + rng.choice([10, 1500, 4000, 9000, 200_000 * (rng.random() < 0.1)])), rng.choice([3, 10, 40, 300])))
            rows.append((v, i, lines[-1][0], lines[-1][1], "x" * lines[-1][2]))
        for r in range(4):
            a = rng.randrange(n)
            b = rng.randint(a, n)
            a, b = (0, n) if r == 0 else (a, b)
            ranges.append((v, r, a, b))
            want |= {(v, r, k, *edges) for k, edges in enumerate(loop_chunks(lines, a, b, most, overlap))}
    df = spark.createDataFrame(rows, "video_id int, event_idx int, start_ms double, end_ms double, line string").repartition(3)
    found = C.chunk_ranges(C.chunk_pointers(df, most, overlap), spark.createDataFrame(ranges, "video_id int, job_id int, start_idx int, end_idx int"), ["job_id"])
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_last_early_equals_a_scan():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 8, 13, 64):
        ends = rng.integers(0, 20, n).astype(float)
        most, below = rng.integers(-2, 22, 200).astype(float), rng.integers(0, n + 1, 200)
        want = [max((j for j in range(b) if ends[j] <= t), default=-1) for t, b in zip(most, below)]
        assert C.last_early(ends, most, below).tolist() == want


def test_short_videos_reach_python_together(spark, monkeypatch):
    """Many short videos beside one of several blocks, blocks cut by Arrow's batches, ends that are missing; pointers past the last range are not doubled."""
    kept, plans, real = {}, {}, C.settled

    def settled(df, name):
        plans[name], kept[name] = df._jdf.queryExecution().analyzed().toString(), real(df, name)
        return kept[name]

    monkeypatch.setattr(C, "settled", settled)
    monkeypatch.setattr(C, "BLOCK", 16)
    rng, rows, want = random.Random(3), [], set()
    for v, n in enumerate([70] + [9] * 40):
        lines = [(i * 1000.0, i * 1000.0 + rng.choice([100, 4000, 30_000]), 30) for i in range(n)]
        rows += [(f"v{v}", i, a, None if v == 40 and i == 2 else b, "x" * size) for i, (a, b, size) in enumerate(lines)]
        want |= {(f"v{v}", k, *edges) for k, edges in enumerate(loop_chunks(lines, 0, n, 160, 2500.0))} if v < 40 else set()
    df = spark.createDataFrame(rows, "video_id string, event_idx int, start_ms double, end_ms double, line string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = {tuple(r) for r in C.chunk_video(df, 160, 2500.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r for r in got if r[0] != "v40"} == want
    assert {i for v, _, a, b in got if v == "v40" for i in range(a, b)} == set(range(9))
    assert "FlatMapGroupsInPandas" not in plans["starts"] and "MapInPandas" in plans["starts"]
    assert kept["jumps0"].count() < len(rows) * 0.7


def test_blocks_looked_through_together_equal_a_scan():
    """Blocks of three videos in one call, of which some have rows for the blocks before; missing ends are never early."""
    rng = np.random.default_rng(5)
    rows, want = [], []
    for v, n in (("a", 23), ("b", 4), ("c", 11)):
        ends = [float(x) if rng.random() < 0.9 else math.nan for x in rng.integers(0, 40, n)]
        for i, end in enumerate(ends):
            early = [j for j in range(i + 1) if ends[j] <= end - 7]
            least = {b: np.nanmin(ends[b * 5 : b * 5 + 5] + [math.inf]) for b in range(i // 5)}
            own = early and early[-1] // 5 == i // 5
            before = [b for b in least if least[b] <= end - 7]
            want.append((v, i + 1, early[-1] + 1 if own else 0, -1 if own or not before else before[-1]))
            if i % 5 == 0:
                rows += [(v, i // 5, -1, j, ends[j]) for j in range(i, min(n, i + 5))] + [(v, i // 5, b, -1, x) for b, x in least.items()]
    found = C.early_starts(pd.DataFrame(rows, columns=["video_id", "block", "earlier", "event_idx", "end_ms"]), 7.0)
    assert list(found[["video_id", "stop", "back", "block"]].itertuples(index=False, name=None)) == want


def test_plan_reads_its_tables_once(spark):
    """Local segments and community segments may cost much, so a plan that is read whole works each of them out once."""
    from spanlight.operators.routing import llm_plan, numbered_jobs

    read = {name: spark.sparkContext.accumulator(0) for name in ("videos", "local", "community")}

    def counted(df, name):
        def each(parts):
            for pdf in parts:
                read[name].add(len(pdf))
                yield pdf

        return df.mapInPandas(each, df.schema)

    videos = spark.createDataFrame([(v, "local-only" if v % 4 == 0 else "local-fallback") for v in range(20)], "video_id int, mode string")
    local = spark.createDataFrame([(v, 1000.0 * k, 1000.0 * k + 9000.0 * (k + 1), "high" if (v + k) % 3 else "low") for v in range(15) for k in range(3)], "video_id int, start_ms double, end_ms double, confidence string")
    community = spark.createDataFrame([(3,), (8,)], "video_id int")
    found = numbered_jobs(llm_plan(counted(videos, "videos"), counted(local, "local"), counted(community, "community"))).collect()
    kinds = {r.video_id: r.kind for r in found}
    assert 3 not in kinds and all(kinds[v] == "fallback" for v in range(15, 20)) and all(kinds[v] == "candidate-verification" for v in range(15) if v != 3)
    assert {name: n.value for name, n in read.items()} == {"videos": 20, "local": 45, "community": 2}


def test_running_values_across_blocks_equal_a_loop(spark):
    rng = random.Random(4)
    rows = [(k % 2, k, rng.choice([None, rng.randint(-9, 9)])) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, i int, x int").repartition(4)
    x = F.col("x")
    names = [(kind, itself) for kind in ("sum", "min", "max", "last") for itself in (True, False)]
    found = running(df, ["k"], F.floor(F.col("i") / 13), ["i"], {f"{kind}{itself}": (kind, x, itself) for kind, itself in names})
    plain = {"sum": sum, "min": lambda v: min(v, default=None), "max": lambda v: max(v, default=None), "last": lambda v: v[-1] if v else None}
    for r in found.collect():
        for kind, itself in names:
            before = [v for k, i, v in rows if k == r.k and (i < r.i or itself and i == r.i) and v is not None]
            assert r[f"{kind}{itself}"] == plain[kind](before), (kind, itself, r)


def test_times_of_any_length_meet_as_all_pairs(spark):
    """Instants beside intervals of 1e15 and 1e300 ms, powers of two, negative times; rows without proper times meet none."""
    rng = random.Random(1)

    def some(n):
        out = []
        for k in range(n):
            a = rng.choice([0, 1, -5e5, 1e14, 3.5e6]) + rng.random() * rng.choice([1, 1e3, 1e6, 1e9])
            out.append((k % 3, a, a + rng.choice([0, 1, 1000, 65536, 65537, 1e6, 1e9, 1e15, 1e300]) * rng.choice([1, rng.random()]), k))
        odd = [(math.nan, 1.0), (1.0, math.nan), (5.0, math.inf), (-math.inf, 9.0), (9.0, 2.0), (None, 1.0)]
        return out + [(0, a, b, -1 - k) for k, (a, b) in enumerate(odd)]

    left, right = some(120), some(120)
    proper = lambda x: x[1] is not None and all(map(math.isfinite, x[1:3])) and x[2] >= x[1]
    want = sorted((x[3], y[3]) for x in left for y in right if proper(x) and proper(y) and x[0] == y[0] and y[1] <= x[2] and y[2] >= x[1])
    a = spark.createDataFrame(left, "video_id int, start_ms double, end_ms double, i int")
    b = spark.createDataFrame(right, "video_id int, r_start double, r_end double, j int")
    assert sorted((r.i, r.j) for r in I.meeting(a, b).collect()) == want
    assert I.meeting(a, b.limit(0)).collect() == I.meeting(a.limit(0), b).collect() == []


def test_positions_beside_very_long_segments(spark):
    segments = [(1, 0.0, 1e12), (1, 50.0, 60.0), (1, 70.0, 71.0), (2, 1e11, 1e12)]
    positions = [(1, 0, 55.0), (1, 1, 1e9), (2, 2, 1e11 - 10), (2, 3, 5.0), (3, 4, 5.0), (1, 5, -3.0)]
    s = spark.createDataFrame(segments, "video_id int, start_s double, end_s double")
    p = spark.createDataFrame(positions, "video_id int, event_id int, pos_s double")
    got = {r.event_id: (r.skip_to, r.next_start) for r in I.label_positions(p, s).collect()}
    assert got == {0: (1e12, None), 1: (1e12, None), 2: (None, 1e11), 3: (None, None), 4: (None, None), 5: (None, 0.0)}
    none = I.label_positions(p, s.limit(0)).collect()
    assert len(none) == 6 and all(r.skip_to is None and r.next_start is None for r in none)


def test_medians_equal_percentile(spark):
    from spanlight.operators.selection import medians

    rng = random.Random(6)
    for n in (0, 1, 2, 301):
        a = [rng.choice([0.0, -0.0, rng.uniform(-1e6, 1e6), rng.uniform(0, 1e-300), float(rng.randrange(5)), -1e300, 1e300]) for _ in range(n)]
        b = [abs(x) if rng.random() < 0.8 else None for x in a]
        df = spark.createDataFrame(list(zip(a, b)), "a double, b double")
        assert tuple(medians(df, ["a", "b"]).first()) == tuple(df.agg(F.percentile("a", 0.5), F.percentile("b", 0.5)).first())
