"""Steps that must not grow faster than their input: what Spark is asked to do for them."""

import pytest
from pyspark.sql import functions as F

from spanlight.functions import text as T
from spanlight.jobs.detect import caption_words, span_features
from spanlight.operators import signals as S
from spanlight.operators.topics import topic_vectors
from spanlight.options import DetectorOptions
from spanlight.sources import tables

TEXTS = ["This video is sponsored by Acme.", "Use promo code ACME for 20 percent off.", "Head over to acme.com/alex today.", "Nothing here.", None, "Acme again."]


@pytest.fixture
def said(spark):
    rows = [(v, k, k * 8000.0, k * 8000.0 + 8000, TEXTS[k % len(TEXTS)]) for v in (1, 2) for k in range(12)]
    return spark.createDataFrame(rows, "video_id long, event_idx int, start_ms double, end_ms double, text string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dice_works_out_n_grams_once(spark):
    words = spark.createDataFrame([("sponsr", "sponsor"), ("aaaa", "aaa"), ("", "a"), ("x", "x")], "a string, b string")
    dice = words.select(T.dice(F.col("a"), F.col("b")).alias("d"))
    assert plan(dice).lower().count("sequence(") == 2
    got = [round(r.d, 6) for r in dice.collect()]
    assert got == [round(2 * 4 / 13, 6), round(2 * 3 / 7, 6), 0.0, 1.0]


def test_a_filter_on_a_feature_brings_no_pattern_back(spark, said):
    found = S.text_features(said).filter("commercial > 0")
    assert "rlike" not in plan(found).lower()
    columns = ["video_id", "event_idx", "normalized", *S.FOUND]
    key = lambda r: (r.video_id, r.event_idx)
    want = sorted(S.features(said).filter("commercial > 0").select(columns).collect(), key=key)
    assert sorted(found.select(columns).collect(), key=key) == want and want
    assert S.text_features(said).count() == said.count()


def test_no_table_of_captions_is_gathered_in_the_driver(said):
    folded = span_features(said, DetectorOptions(max_span=24_000))
    assert folded.count() == said.count()
    worded = said.withColumn("normalized", T.normalize_text(F.col("text")))
    words = caption_words(worded, worded.filter("event_idx < 6"))
    for df in (folded, words):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
    got = {(r.video_id, r.event_idx): sorted(w.token for w in r.words) for r in words.collect()}
    assert got[(1, 5)] == ["acme"] and all(k < 6 for _, k in got)


def test_a_table_of_many_rows_is_not_gathered_in_the_driver(spark, said, monkeypatch):
    monkeypatch.setattr(tables, "FEW", 10)
    joins = lambda df: said.join(tables.settled(df, "rows").filter("id >= 0").groupBy("id").count(), F.col("id") == F.col("event_idx"))._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in joins(spark.range(11)) and "Broadcast" in joins(spark.range(10)) and "Broadcast" in joins(spark.range(10).filter("id < 0"))


def test_no_table_of_topic_tokens_is_gathered_in_the_driver(said, monkeypatch):
    windows = said.filter("event_idx % 6 = 0").select("video_id", F.col("event_idx").alias("window_id"), F.col("start_ms").alias("from_ms"), (F.col("start_ms") + 30_000).alias("to_ms"))
    rows = lambda df: sorted((r.video_id, r.window_id, r.token, round(r.weight, 6)) for r in df.collect())
    want = rows(topic_vectors(windows, said))
    monkeypatch.setattr(tables, "FEW", 4)
    found = topic_vectors(windows, said)
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    assert rows(found) == want and want
