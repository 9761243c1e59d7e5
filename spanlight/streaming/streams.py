"""The same work on streams in the order of arrival: skip statistics, tab sessions, arriving captions, detection.

State is kept per user or per tab and is a few values each. Messages of one micro-batch are
put in order before they meet the state; order across micro-batches is that of arrival. Streams that
may arrive out of order, and state that expires, are in ordered.py.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..jobs.detect import detect_segments
from ..options import DetectorOptions
from ..sources.captions import parse_captions, status_of
from ..sources.committed import CommittedTable


def _ordered(pdfs: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(pdfs)).sort_values(by)


def _skips(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    skipped, time_s = state.get if state.exists else (0, 0.0)
    for r in _ordered(pdfs, ["ts", "seq"]).itertuples():
        if r.duration_s is not None and math.isfinite(r.duration_s) and r.duration_s > 0:
            sign = 1 if r.action == "RECORD" else -1
            skipped, time_s = max(0, skipped + sign), max(0.0, time_s + sign * r.duration_s)
    state.update((skipped, time_s))
    yield pd.DataFrame({"user_id": [key[0]], "skipped": [skipped], "time_s": [time_s]})


def skip_stats_stream(skips: DataFrame) -> DataFrame:
    """(user_id, skipped, time_s) in update mode: totals after each micro-batch, never below zero.

    skips: a stream of (user_id, ts, seq, action, duration_s).
    """
    rows = skips.select("user_id", "ts", "seq", "action", "duration_s")
    kind = skips.schema["user_id"].dataType.simpleString()
    return rows.groupBy("user_id").applyInPandasWithState(_skips, f"user_id {kind}, skipped long, time_s double", "skipped long, time_s double", "update", GroupStateTimeout.NoTimeout)


def _session(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    video, generation, transcript, status = state.get if state.exists else (None, 0, None, None)
    kept = []
    for r in _ordered(pdfs, ["seq"]).itertuples():
        if r.action in ("VIDEO_CHANGED", "CHANNEL_BLOCKED"):
            video, generation, transcript, status = (r.video_id if r.action == "VIDEO_CHANGED" else None), generation + 1, None, None
            continue
        if video is None or r.video_id is None or r.video_id != video:
            continue  # about a video that the tab has left
        body = hashlib.sha256(str(r.body).encode()).hexdigest()
        if r.action == "PROCESS_TRANSCRIPT":
            if body == transcript:
                continue
            transcript = body
        else:
            if body == status:
                continue
            status = body
        kept.append((key[0], r.seq, r.action, r.video_id, r.body, generation))
    state.update((video, generation, transcript, status))
    yield pd.DataFrame(kept, columns=["tab_id", "seq", "action", "video_id", "body", "generation"])


def session_stream(messages: DataFrame) -> DataFrame:
    """Messages (tab_id, seq, action, video_id, body) of the tab's current video, unchanged ones once, with the generation.

    VIDEO_CHANGED starts a generation, CHANNEL_BLOCKED leaves the tab without a video. Ids and
    bodies keep the types they come in.
    """
    rows = messages.select("tab_id", "seq", "action", "video_id", "body")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = ", ".join(f"{c} {kinds[c]}" for c in rows.columns) + ", generation long"
    return rows.groupBy("tab_id").applyInPandasWithState(_session, out, f"video {kinds['video_id']}, generation long, transcript string, status string", "append", GroupStateTimeout.NoTimeout)


def caption_stream(raw: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Captions of arriving payloads (video_id, body, ts); a payload that comes again within the delay counts once."""
    once = raw.withWatermark("ts", delay).withColumn("body_hash", F.sha2("body", 256)).dropDuplicatesWithinWatermark(["video_id", "body_hash"])
    return parse_captions(once)


def detect_stream(raw: DataFrame, write: Callable[[DataFrame, int], None], options: DetectorOptions = DetectorOptions()):
    """A stream writer that detects segments in whole transcripts (video_id, body) and hands them to write(segments, batch)."""

    def batch(df: DataFrame, number: int) -> None:
        write(detect_segments(parse_captions(df.filter(status_of(F.col("body")) == "ok")), options), number)

    return raw.writeStream.foreachBatch(batch)


def detect_into(captions: DataFrame, table: CommittedTable, options: DetectorOptions = DetectorOptions()):
    """A stream writer that detects segments in captions of whole transcripts and adds each batch to the table exactly once.

    A batch that runs again after a failure finds itself in the table, or files of an attempt that was never committed and is never read.
    """

    def batch(df: DataFrame, number: int) -> None:
        table.add(detect_segments(df.select("video_id", "start_ms", "end_ms", "text"), options), f"{number:012d}")

    return captions.writeStream.foreachBatch(batch)
