"""Predictions against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import best_match, coverage, overlap_pairs
from ..operators.selection import medians
from ..options import DetectorOptions
from ..sources.tables import settled


def boundary_errors(matches: DataFrame) -> DataFrame:
    """One row: exact medians of the start and end errors and the mean overlap of matched truth segments; null if none."""
    middle = medians(matches, ["start_error", "end_error"]).toDF("median_start_error", "median_end_error")
    return middle.crossJoin(F.broadcast(matches.agg(F.avg("iou").alias("mean_iou"))))  # a row each


def evaluate(predicted: DataFrame, truth: DataFrame, videos: DataFrame, options: DetectorOptions = DetectorOptions()) -> DataFrame:
    """One row: precision and recall by time, false seconds per hour, segment recall, confusion with own promotion, counts.

    truth: (video_id, truth_id, start_ms, end_ms, category or null); videos: (video_id, duration_ms).
    Sums are taken per video first; only these meet in the last aggregate. What several measures
    read is a table.
    """
    predicted = settled(predicted.select("video_id", "start_ms", "end_ms", "category"), "predicted")
    truth = settled(truth.select("video_id", "truth_id", "start_ms", "end_ms", F.coalesce("category", F.lit("paid-sponsor")).alias("category")), "truth")
    wanted, own = truth.filter(F.col("category").isin(*options.categories)), truth.filter("category = 'self-promotion'")
    matches = settled(best_match(wanted, predicted), "matches")
    named = lambda df, name: df.withColumnRenamed("covered_ms", name)
    parts = [
        named(coverage(predicted), "predicted"),
        named(coverage(wanted), "truth"),
        named(coverage(overlap_pairs(predicted, wanted)), "overlap"),
        named(coverage(own), "own"),
        named(coverage(overlap_pairs(predicted.filter("category <> 'self-promotion'"), own)), "mistaken"),
        matches.groupBy("video_id").agg(F.count("*").alias("segments"), F.count("iou").alias("found")),
    ]
    rows = videos.select("video_id", "duration_ms")
    for p in parts:
        rows = rows.join(p, "video_id", "left")
    total = rows.agg(F.count("*").alias("videos"), *(F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in ("duration_ms", "predicted", "truth", "overlap", "own", "mistaken", "segments", "found")))
    ratio = lambda a, b, other: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(float(other)))
    false_s = F.greatest(F.lit(0.0), F.col("predicted") - F.col("overlap")) / 1000
    return total.crossJoin(F.broadcast(boundary_errors(matches))).select(
        ratio("overlap", "predicted", 1).alias("precision"),
        ratio("overlap", "truth", 1).alias("recall"),
        F.when(F.col("duration_ms") > 0, false_s / (F.col("duration_ms") / 3_600_000)).otherwise(0.0).alias("false_seconds_per_hour"),
        "median_start_error", "median_end_error", "mean_iou",
        ratio("found", "segments", 1).alias("segment_recall"),
        ratio("mistaken", "own", 0).alias("self_promotion_confusion"),
        "videos", F.col("segments").cast("long").alias("truth_segments"), F.col("found").cast("long").alias("detected_segments"),
    )
