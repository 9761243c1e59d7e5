"""Verification in two rounds with failures, and tables that grow by whole batches."""

import os

import pytest
from pyspark.sql import functions as F

from spanlight import queries as Q
from spanlight.jobs.verify import KEYS, ledger, verify
from spanlight.operators.requests import candidate_hints, chunk_lines, chunk_times, format_lines, job_chunks, job_ranges, parse_answers
from spanlight.sources import tables
from spanlight.sources.committed import CommittedTable

SPAN = "video_id string, job_id int, start_ms double, end_ms double, context_ms double, confidence string"


def captions(spark):
    """Two videos of 60 captions; in both a read starts at caption 9 and at 30."""
    said = {9: "This video is sponsored by Acme.", 30: "I want to thank Acme.", 45: "Merch alert."}
    rows = [(v, i, i * 8000.0, i * 8000.0 + 7900, said.get(i, f"line {i} of {v}")) for v in "ab" for i in range(60)]
    return spark.createDataFrame(rows, "video_id string, event_idx int, start_ms double, end_ms double, text string")


def jobs(spark):
    return spark.createDataFrame([("a", 0, None, None, None, None), ("b", 0, 72_000.0, 104_000.0, 90_000.0, "low"), ("b", 1, 240_000.0, 250_000.0, 60_000.0, "medium"), ("c", 0, 0.0, 9.0, 9.0, "low")], SPAN)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_second_run_sends_only_what_is_unanswered(spark, tmp_path):
    sent = []

    def scorer(fails):
        def run(requests):
            sent.append({r.request_key for r in requests.collect()})
            return Q.model_stub(requests, fails)

        return run

    events, asked = captions(spark), jobs(spark)
    at_once = verify(asked, events, scorer("false"), ledger(spark, str(tmp_path / "one")), "m", 900, 30_000.0)
    want, whole = rows_of(at_once.answers), sent[:]
    assert {(r[0], r[1]) for r in want} == {("a", 0), ("b", 0), ("b", 1)} and at_once.errors.count() == at_once.failed.count() == 0
    sent.clear()
    kept = ledger(spark, str(tmp_path / "two"))
    first = verify(asked, events, scorer("request_key < '6'"), kept, "m", 900, 30_000.0)
    lost = {r.video_id for r in first.failed.collect()}
    assert lost and {r.error for r in first.errors.collect()} == {"busy"}
    assert rows_of(first.answers) == [r for r in want if r[0] not in lost]
    answered = set().union(*sent) - {k for k in set().union(*sent) if k < "6"}
    sent.clear()
    assert rows_of(verify(asked, events, scorer("false"), kept, "m", 900, 30_000.0).answers) == want
    assert not answered & set().union(*sent) and set().union(*whole) == answered | set().union(*sent)
    sent.clear()
    assert rows_of(verify(asked, events, scorer("true"), kept, "m", 900, 30_000.0).answers) == want and sent == []


def test_broken_and_missing_answers_are_errors(spark, tmp_path):
    def broken(requests):
        payload = F.when(F.col("request_key") < "8", '{"choices":[{"message":{"content":"no idea {"}}]}')
        return requests.filter("request_key < 'c'").select("request_key", payload.alias("payload"))

    found = verify(jobs(spark), captions(spark), broken, ledger(spark, str(tmp_path / "l")), "m", 900, 30_000.0)
    assert found.answers.count() == 0 and {r.video_id for r in found.failed.collect()} == {"a", "b"}
    assert {r.error for r in found.errors.collect()} <= {"no JSON object", "no answer"} and found.errors.count() > 3


def test_requests_of_the_second_round_say_so_and_hint_at_their_job(spark, tmp_path):
    told = []

    def scorer(requests):
        told.extend(r.request for r in requests.collect())
        return Q.model_stub(requests)

    verify(jobs(spark), captions(spark), scorer, ledger(spark, str(tmp_path / "l")), "m", 900, 30_000.0)
    again = [t for t in told if "looked at again" in t]
    assert again and len(again) < len(told)
    hints = {t.split("Candidates:")[1].split("Captions:")[0] for t in told if "Candidates:" in t and "user" in t.split("Candidates:")[0]}
    assert any("72.000-104.000 seconds (low" in h for h in hints) and not any("72.000" in h and "240.000" in h for h in hints)


def test_batches_count_once(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"), "x int")
    assert table.read().collect() == [] and table.sweep() == 0
    df = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x int")
    assert table.add(df(1, 2), "b1") and not table.add(df(3), "b1") and table.add(df(4), "b2")
    assert rows_of(table.read()) == [(1,), (2,), (4,)]


def test_a_failure_between_files_and_commit(spark, tmp_path, monkeypatch):
    table = CommittedTable(spark, str(tmp_path / "t"), "x int")
    df = spark.createDataFrame([(1,)], "x int")

    def dies(self, attempt, batch):
        raise RuntimeError("the driver dies here")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(CommittedTable, "commit", dies)
        table.add(df, "b1")
    assert table.read().collect() == [] and len(os.listdir(tmp_path / "t" / "data")) == 1
    assert table.add(df, "b1") and rows_of(table.read()) == [(1,)]
    # Another writer whose files are there, but whose commit comes second, changes nothing.
    df.write.parquet(str(tmp_path / "t" / "data" / "b1-late"))
    assert not table.commit("data/b1-late", "b1") and rows_of(table.read()) == [(1,)]
    assert table.sweep() == 1 and rows_of(table.read()) == [(1,)]


def test_no_table_of_captions_chunks_or_answers_is_gathered_in_the_driver(spark, monkeypatch):
    monkeypatch.setattr(tables, "FEW", 2)
    asked, events = tables.settled(jobs(spark), "jobs"), tables.settled(captions(spark), "events")
    lines = tables.settled(format_lines(events), "lines")
    chunks = tables.settled(job_chunks(lines, job_ranges(asked, events), 900, 30_000.0), "chunks")
    responses = tables.settled(chunks.select("video_id", *KEYS, F.lit("{}").alias("payload")), "responses")
    hints = candidate_hints(chunks, events, asked.filter("start_ms is not null").select("video_id", "job_id", "start_ms", "end_ms", "confidence"), KEYS)
    for df in (chunk_lines(chunks, lines), chunk_times(chunks, events), hints, parse_answers(responses, chunks, events, KEYS)):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
