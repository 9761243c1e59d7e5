"""Caption events in order, and runs of consecutive ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..options import DetectorOptions


def clean_events(df: DataFrame) -> DataFrame:
    """(video_id, event_idx, start_ms, end_ms, text): valid captions, exact repeats once, in order of start, end, text."""
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)").alias(c)
    kept = df.select("video_id", number("start_ms"), number("end_ms"), F.col("text").cast("string").alias("text"))
    finite = "start_ms > double('-infinity') and end_ms < double('infinity') and end_ms >= start_ms and not isnan(start_ms) and not isnan(end_ms)"
    kept = kept.filter(finite).filter(r"text rlike '[^\\s\\u00A0\\uFEFF]'").dropDuplicates(["video_id", "start_ms", "end_ms", "text"])
    order = W.partitionBy("video_id").orderBy("start_ms", "end_ms", F.expr("text COLLATE UNICODE"), "text")
    return kept.select("video_id", (F.row_number().over(order) - 1).alias("event_idx"), "start_ms", "end_ms", "text")


def caption_spans(events: DataFrame, options: DetectorOptions = DetectorOptions()) -> DataFrame:
    """(video_id, start_idx, end_idx, text): runs of one to max_span_events captions; one that is too long stops its growth.

    A column normalized is joined like the text.
    """
    order = W.partitionBy("video_id").orderBy("event_idx")
    n, texts = options.max_span_events, [c for c in ("text", "normalized") if c in events.columns]
    ahead = F.array(*(F.struct(*(F.lead(c, k).over(order).alias(c) for c in ("end_ms", *texts))) for k in range(n)))
    rows = events.select("video_id", "event_idx", "start_ms", ahead.alias("ahead"))
    stop = F.array_min(F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda k: F.when(F.coalesce(F.get("ahead", k).end_ms - F.col("start_ms") <= options.max_span, F.lit(False)), n).otherwise(k))) if n > 1 else F.lit(1)
    rows = rows.withColumn("size", F.explode(F.sequence(F.lit(1), stop)))
    held = F.slice("ahead", 1, F.col("size"))
    joined = [F.array_join(F.filter(held[c], lambda t: t != ""), " ").alias(c) for c in texts]
    return rows.select("video_id", F.col("event_idx").alias("start_idx"), (F.col("event_idx") + F.col("size") - 1).alias("end_idx"), *joined)
