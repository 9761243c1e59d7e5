"""Reading captions and community segments into tables, and writing segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse
from .committed import CommittedTable

PAYLOAD = "struct<events:array<struct<tStartMs:double,dDurationMs:double,segs:array<struct<utf8:string>>>>>"


def parse_captions(raw: DataFrame) -> DataFrame:
    """(video_id, start_ms, end_ms, text) from payloads (video_id, body): captions with text, times finite."""
    events = raw.select("video_id", F.explode(F.from_json("body", PAYLOAD).events).alias("e")).filter("e.segs is not null")
    length = F.when(F.coalesce(F.col("e.dDurationMs"), F.lit(0.0)) == 0, 3000.0).otherwise(F.greatest(F.col("e.dDurationMs"), F.lit(0.0)))
    text = collapse(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s.utf8, F.lit(""))), ""))
    out = events.select("video_id", F.col("e.tStartMs").alias("start_ms"), (F.col("e.tStartMs") + length).alias("end_ms"), text.alias("text"))
    return out.filter("start_ms is not null and not isnan(start_ms) and not isnan(end_ms) and length(text) > 1")


def status_of(body: Column) -> Column:
    parsed = F.from_json(body, PAYLOAD)
    json_ok = F.try_parse_json(body).isNotNull()
    return F.when(~json_ok | body.isNull(), "fetch-error").when(F.coalesce(F.size(parsed.events), F.lit(0)) <= 0, "unavailable").otherwise("ok")


def payload_status(raw: DataFrame) -> DataFrame:
    """(video_id, status): ok, unavailable (no events) or fetch-error (no JSON)."""
    return raw.select("video_id", status_of(F.col("body")).alias("status"))


def community_segments(submitted: DataFrame) -> DataFrame:
    """(video_id, start_ms, end_ms): submitted sponsor ranges that are to be skipped, from seconds; valid ranges only."""
    chosen = submitted.filter("category = 'sponsor' and coalesce(action_type, 'skip') = 'skip'")
    out = chosen.select("video_id", (F.try_element_at("segment", F.lit(1)) * 1000).alias("start_ms"), (F.try_element_at("segment", F.lit(2)) * 1000).alias("end_ms"))
    return out.filter("start_ms >= 0 and end_ms > start_ms and not isnan(end_ms) and end_ms < double('infinity')")


SEGMENTS = "video_id {}, start_ms double, end_ms double, confidence string, category string, reason string, score int, groups array<string>, brands array<string>"


def segments_table(spark: SparkSession, path: str, video_id: str = "string") -> CommittedTable:
    """Segments that grow by batches, each of which counts once."""
    return CommittedTable(spark, path, SEGMENTS.format(video_id))


def write_segments(segments: DataFrame, path: str) -> None:
    """Segments as Parquet, all of a video in one file."""
    segments.repartition("video_id").write.mode("overwrite").parquet(path)
