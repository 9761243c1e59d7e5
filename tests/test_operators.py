from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanlight.functions import structure as ST
from spanlight.operators import intervals as I
from spanlight.operators import windows as WN
from spanlight.operators.requests import answer_items, chunk_events, format_lines

SEG = "video_id string, start_ms double, end_ms double"


def test_non_inflated_evidence(spark):
    rows = [("a", i, i * 1000.0, i * 1000.0 + 900, 5, ["code"]) for i in range(8)]
    df = spark.createDataFrame(rows, "video_id string, event_idx int, start_ms double, end_ms double, commercial int, groups array<string>")
    assert WN.evidence_windows(df).collect() == []


def loop_windows(rows, width=50_000):
    """Two pointers over one video's captions, as a plain loop."""
    from spanlight.patterns import PRECISE, WEIGHTS

    out, left, counts, best = [], 0, Counter(), None
    for right, (_, end, commercial, groups) in enumerate(rows):
        if commercial > 0:
            counts.update(groups)
        while left < right and end - rows[left][0] > width:
            if rows[left][2] > 0:
                counts.subtract(rows[left][3])
            left += 1
        active = [g for g, n in counts.items() if n > 0]
        score = sum(WEIGHTS[g] for g in active)
        if score >= 12 and len(active) >= 2 and set(active) & set(PRECISE):
            if best is None or (score, left) > (best[2], best[0]):
                best = (left, right, score)
        else:
            out += [best] if best else []
            best = None
    return out + ([best] if best else [])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 40), st.sampled_from([0, 3]), st.sets(st.sampled_from(["code", "url", "cta", "pitch", "offer"]), max_size=3)), min_size=1, max_size=25), min_size=1, max_size=8))
def test_evidence_windows_equal_a_loop(spark, videos):
    rows, want = [], set()
    for v, steps in enumerate(videos):
        t, own = 0, []
        for gap, length, commercial, groups in steps:
            t += gap * 1000
            own.append((float(t), float(t + length * 1000), commercial, sorted(groups)))
        rows += [(v, i, *r) for i, r in enumerate(own)]
        want |= {(v, *w) for w in loop_windows(own)}
    df = spark.createDataFrame(rows, "video_id int, event_idx int, start_ms double, end_ms double, commercial int, groups array<string>")
    assert {tuple(r) for r in WN.evidence_windows(df).collect()} == want


def test_running_totals(spark):
    rows = [("u", 1, 1, "REVERT", 5.0), ("u", 2, 2, "RECORD", 12.5), ("u", 3, 3, "RECORD", -1.0), ("u", 4, 4, "RECORD", 45.0), ("u", 5, 5, "REVERT", 12.5)]
    df = spark.createDataFrame(rows, "user_id string, ts int, seq int, action string, duration_s double")
    assert [tuple(r) for r in WN.skip_totals(df).collect()] == [("u", 1, 45.0)]


def test_trims(spark):
    df = spark.createDataFrame([("a", 20000.0, 40000.0, "local")], SEG + ", source string")
    assert [(r.start_ms, r.end_ms) for r in I.trim_segments(df, F.lit(1.5), F.lit(2.25)).collect()] == [(21500.0, 37750.0)]
    assert [(r.start_ms, r.end_ms) for r in I.trim_segments(df).collect()] == [(23000.0, 37000.0)]
    assert I.trim_segments(df, F.lit(99.0)).collect() == []


def test_candidate_matches(spark):
    df = spark.createDataFrame([(1, 100000.0, 140000.0), (2, 118000.0, 121000.0), (3, 140000.0, 150000.0), (4, 136000.0, 150000.0), (5, 130000.0, 150000.0)], "k int, a double, b double")
    ok = I.matches_candidate(F.lit(100000.0), F.lit(140000.0), F.col("a"), F.col("b"))
    assert {r.k for r in df.filter(ok).collect()} == {1, 2, 5}


def test_merges(spark):
    rows = [("a", 0.0, 10000.0, "high", "paid-sponsor", "x"), ("a", 10500.0, 12000.0, "medium", "affiliate", "y"), ("a", 30000.0, 31000.0, "medium", "affiliate", "z")]
    df = spark.createDataFrame(rows, SEG + ", confidence string, category string, reason string")
    assert sorted(tuple(r)[1:] for r in I.merge_answers(df).collect()) == [(0.0, 12000.0, "high", "paid-sponsor", "x; y"), (30000.0, 31000.0, "medium", "affiliate", "z")]
    again = I.merge_answers(I.merge_answers(df))
    assert again.count() == 2
    local = df.withColumns({"score": F.lit(3), "groups": F.array(F.lit("b"), F.lit("a")), "brands": F.array(F.col("reason"))})
    got = sorted((r.start_ms, r.end_ms, r.confidence, r.category, r.reason, r.brands) for r in I.merge_local(local).collect())
    assert got == [(0.0, 12000.0, "high", "paid-sponsor", "x+y+merged", ["x", "y"]), (30000.0, 31000.0, "medium", "affiliate", "z", ["z"])]


def test_chunks_overlap(spark):
    rows = [("a", i, i * 5000.0, i * 5000.0 + 4000, "caption number %d with some words" % i) for i in range(200)]
    df = spark.createDataFrame(rows, "video_id string, event_idx int, start_ms double, end_ms double, text string")
    found = sorted(chunk_events(format_lines(df), 2000, 90_000.0).collect(), key=lambda r: r.chunk_id)
    assert len(found) > 1 and found[0].start_idx == 0 and found[-1].end_idx == 200
    for a, b in zip(found, found[1:]):
        assert a.start_idx < b.start_idx < a.end_idx and rows[a.end_idx - 1][3] - rows[b.start_idx][2] >= 85_000
        assert len(a.text) <= 2000


def test_answer_errors(spark):
    ok = '{"choices":[{"message":{"content":"```{\\"segments\\":[]}```"}}]}'
    rows = [(1, ok), (2, "{}"), (3, '{"choices":[{"message":{"content":"no"}}]}'), (4, '{"choices":[{"message":{"content":"{\\"x\\":1}"}}]}'), (5, "<html>"), (6, None)]
    df = spark.createDataFrame(rows, "chunk_id int, payload string").withColumn("video_id", F.lit("a"))
    got = {r.chunk_id: r.error for r in answer_items(df).collect()}
    assert got == {1: None, 2: "no message content", 3: "no JSON object", 4: "no segments array", 5: "no message content", 6: "no message content"}


@pytest.mark.parametrize("text, start, role", [("they are for this video the sponsor", True, False), ("sponsors appear throughout this video", False, False), ("i like our sponsor program at the university", False, False), ("our sponsors like acme", False, True), ("our sponsor saily can help you", False, True), ("this video is about the sponsor", False, False)])
def test_word_order_rules(text, start, role):
    assert (ST.structural_start(text.split()), ST.structural_role(text.split())) == (start, role)


def test_fuzzy_rules():
    assert ST.has_sponsor_word("a sponsorr video") and not ST.has_sponsor_word("a response sponge")
    assert ST.has_phrase("ths video is sponsored by acme", ["this video is sponsored by"], 0.82)
    assert not ST.has_phrase("x" * 501, ["x"], 0.1)


def test_totals_across_days_equal_a_loop(spark):
    import random

    rng, rows, want = random.Random(3), [], {}
    for u in range(4):
        n, t = 0, 0.0
        for k in range(150):
            action, d = rng.choice(["RECORD", "REVERT"]), float(rng.randrange(1, 50))
            rows.append((u, k * 30_000, k, action, d))
            sign = 1 if action == "RECORD" else -1
            n, t = max(0, n + sign), max(0.0, t + sign * d)
            want[u, k] = (n, t)
    df = spark.createDataFrame(rows, "user_id int, ts int, seq int, action string, duration_s double")
    assert {(r.user_id, r.seq): (r.skipped, r.time_s) for r in WN.running_skip_stats(df).collect()} == want


def test_times_that_meet_equal_all_pairs(spark):
    import random

    rng = random.Random(4)
    cut = lambda: (rng.randrange(2), float(a := rng.randrange(-90, 400) * 1000), float(a + rng.randrange(200) * 1000))
    a, b = [(*cut(), i) for i in range(120)], [(*cut(), i) for i in range(120)]
    left = spark.createDataFrame(a, SEG.replace("string", "int") + ", i int")
    right = spark.createDataFrame(b, "video_id int, r_start double, r_end double, j int")
    got = sorted((r.i, r.j) for r in I.meeting(left, right).collect())
    assert got == sorted((i, j) for v, s, e, i in a for w, x, y, j in b if v == w and x <= e and y >= s)


def test_plan_asks_the_model_only_where_it_is_needed(spark):
    from spanlight.operators.routing import combine_verified, deliver, llm_plan, route_sources

    modes = [(1, "local-fallback"), (2, "local-fallback"), (3, "local-fallback"), (4, "sponsorblock-only"), (5, "local-only"), (6, "local-fallback"), (7, "sponsorblock-only")]
    videos = spark.createDataFrame(modes, "video_id int, mode string")
    local = [(1, 0.0, 60000.0, "high"), (2, 0.0, 20000.0, "high"), (2, 90000.0, 190000.0, "high"), (3, 0.0, 60000.0, "low"), (3, 90000.0, 190000.0, "high"), (4, 0.0, 60000.0, "low"), (5, 0.0, 60000.0, "high"), (6, 0.0, 60000.0, "low")]
    local = spark.createDataFrame(local, "video_id int, start_ms double, end_ms double, confidence string")
    hits = spark.createDataFrame([(5, 0.0, 9000.0), (6, 0.0, 9000.0)], "video_id int, start_ms double, end_ms double")
    answers = spark.createDataFrame([(4, 5000.0, 20000.0, "high", "said"), (3, 1000.0, 70000.0, "high", "said"), (3, 300000.0, 310000.0, "high", "other")], "video_id int, start_ms double, end_ms double, confidence string, reason string")
    plan = llm_plan(videos, local, hits)
    assert sorted((r.video_id, r.kind, r.start_ms) for r in plan.collect()) == [(2, "short-verification", 0.0), (3, "candidate-verification", 0.0), (4, "fallback", None), (7, "fallback", None)]
    routes = {r.video_id: r.route for r in route_sources(videos, hits, local, answers).collect()}
    assert routes == {1: "local-fallback", 2: "local-fallback", 3: "local-fallback", 4: "llm-fallback", 5: "local-only", 6: "community", 7: "none"}
    kept = sorted((r.video_id, r.start_ms, r.origin) for r in combine_verified(local, answers, plan).collect())
    assert (3, 90000.0, "local") in kept and (3, 0.0, "local") not in kept and (2, 90000.0, "local") in kept
    out = sorted((r.video_id, r.start_ms, r.end_ms, r.source) for r in deliver(videos, hits, local, answers, videos.filter("video_id = 2").select("video_id")).collect())
    assert out == [
        (1, 0.0, 60000.0, "local-fallback"),
        (2, 0.0, 20000.0, "local-fallback"),
        (2, 90000.0, 190000.0, "local-fallback"),
        (3, 1000.0, 70000.0, "llm-fallback"),
        (3, 90000.0, 190000.0, "llm-fallback"),
        (4, 5000.0, 20000.0, "llm-fallback"),
        (5, 0.0, 60000.0, "local-only"),
        (6, 0.0, 9000.0, "sponsorblock"),
    ]
