"""Streams whose rows may arrive out of order: they wait until the watermark has passed them.

Rows of a key wait in its state; a timer releases them, in order of time and number, once no
earlier row can come any more. What comes later than the delay is dropped by the watermark. Of a key
that has been silent for `ttl`, everything is forgotten. State is kept in RocksDB, which Spark asks for
here: set spark.sql.streaming.stateStore.providerClass to
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider.

All rows of a key that a timer releases are in one batch; a later batch goes on from the state.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class Waiting(StatefulProcessor):
    """Holds the rows of a key back and hands them to `released` in order."""

    def __init__(self, columns: list[str], kinds: str, ttl_ms: int | None):
        self.columns, self.kinds, self.ttl_ms = columns, kinds, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", f"at long, {self.kinds}")
        self.last = handle.getValueState("last", "at long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest, soonest = None, None
        for pdf in rows:
            at = pdf["ts"].astype("datetime64[ms]").astype("int64").tolist()
            self.rows.appendList([(t, *map(plain, r)) for t, r in zip(at, pdf[self.columns].itertuples(index=False))])
            latest, soonest = max(at + [latest or at[0]]), min(at + [soonest if soonest is not None else at[0]])
        if latest is not None:
            old, timer = self.last.get() if self.last.exists() else (latest, None)
            if timer is None or self.ahead(soonest) < timer:
                self._wake(timer, self.ahead(soonest))
                timer = self.ahead(soonest)
            self.last.update((max(old, latest), timer))
        return iter(())

    def ahead(self, at: int) -> int:
        """When to look at a row of this time."""
        return at

    def _wake(self, old: int | None, new: int) -> None:
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.rows.get(), key=self.order)
        ready = self.ready(rows, watermark)
        rest = rows[len(ready) :]
        if rest:
            self.rows.put(rest)
        else:
            self.rows.clear()
        out = self.released(key, ready) if ready else None
        latest, _ = self.last.get()
        timer = self.ahead(rest[0][0]) if rest else None
        if not rest and self.ttl_ms is not None:
            timer = latest + self.ttl_ms
            if not ready and timer <= watermark:
                self.forget()
                self.last.clear()
                return iter(())
        if timer is not None:
            self.handle.registerTimer(max(timer, watermark + 1))
        self.last.update((latest, max(timer, watermark + 1) if timer is not None else None))
        if out is not None and len(out):
            yield out

    def order(self, row: tuple) -> tuple:
        return (row[0], row[1])

    def ready(self, rows: list[tuple], watermark: int) -> list[tuple]:
        return [r for r in rows if r[0] <= watermark]

    def released(self, key, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def forget(self) -> None:
        """Clears what the key has besides its rows."""


def plain(x):
    """A pandas value as Python has it; missing ones as None."""
    if x is None or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return None
    return x.item() if hasattr(x, "item") else x


class Totals(Waiting):
    """Skip totals that never fall below zero."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.totals = handle.getValueState("totals", "skipped long, time_s double")

    def released(self, key, rows: list[tuple]) -> pd.DataFrame:
        skipped, time_s = self.totals.get() if self.totals.exists() else (0, 0.0)
        for _, _, action, duration in rows:
            if duration is not None and math.isfinite(duration) and duration > 0:
                sign = 1 if action == "RECORD" else -1
                skipped, time_s = max(0, skipped + sign), max(0.0, time_s + sign * duration)
        self.totals.update((skipped, time_s))
        return pd.DataFrame({"user_id": [key[0]], "skipped": [skipped], "time_s": [time_s]})

    def forget(self) -> None:
        self.totals.clear()


class Sessions(Waiting):
    """A tab's messages about its current video; of transcripts and statuses only a hash is kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        kind = dict(x.strip().split(" ", 1) for x in self.kinds.split(", "))["video_id"]
        self.session = handle.getValueState("session", f"video {kind}, generation long")
        self.hashes = handle.getMapState("hashes", "action string", "hash string")

    def order(self, row: tuple) -> tuple:
        return (row[1], row[0])  # messages are numbered

    def ready(self, rows: list[tuple], watermark: int) -> list[tuple]:
        """All before the first that is still open, so that numbers come in order."""
        return rows[: next((k for k, r in enumerate(rows) if r[0] > watermark), len(rows))]

    def released(self, key, rows: list[tuple]) -> pd.DataFrame:
        video, generation = self.session.get() if self.session.exists() else (None, 0)
        known = {k[0]: v[0] for k, v in self.hashes.iterator()}
        kept = []
        for _, seq, action, video_id, body in rows:
            if action in ("VIDEO_CHANGED", "CHANNEL_BLOCKED"):
                video, generation = (video_id if action == "VIDEO_CHANGED" else None), generation + 1
                known.clear()
                continue
            if video is None or video_id is None or video_id != video:
                continue
            digest = None if body is None else hashlib.sha256(str(body).encode()).hexdigest()
            if digest is not None and known.get(action) == digest:
                continue
            known[action] = digest
            kept.append((key[0], seq, action, video_id, body, generation))
        self.session.update((video, generation))
        self.hashes.clear()
        for action, digest in known.items():
            if digest is not None:
                self.hashes.updateValue((action,), (digest,))
        return pd.DataFrame(kept, columns=["tab_id", "seq", "action", "video_id", "body", "generation"])

    def forget(self) -> None:
        self.session.clear()
        self.hashes.clear()


class Transcripts(Waiting):
    """The captions of a video, held until no more have come for a while, then released once, all together."""

    def __init__(self, columns: list[str], kinds: str, quiet_ms: int):
        super().__init__(columns, kinds, 0)
        self.quiet_ms = quiet_ms

    def ahead(self, at: int) -> int:
        return at + self.quiet_ms

    def ready(self, rows: list[tuple], watermark: int) -> list[tuple]:
        return rows if rows and max(r[0] for r in rows) + self.quiet_ms <= watermark else []

    def released(self, key, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([r[1:] for r in rows], columns=self.columns).drop_duplicates()
        out.insert(0, "video_id", key[0])
        return out


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def _run(rows: DataFrame, key: str, processor: StatefulProcessor, out: str, mode: str) -> DataFrame:
    return rows.groupBy(key).transformWithStateInPandas(processor, out, mode, "EventTime")


def ordered_skip_stats(skips: DataFrame, delay: str = "10 minutes", ttl_ms: int | None = None) -> DataFrame:
    """(user_id, skipped, time_s) in update mode: totals in the order of (ts, seq), whatever the order of arrival.

    skips: a stream of (user_id, ts, seq, action, duration_s). Users who have been silent for ttl_ms
    start from zero again; by default totals stay.
    """
    columns = ["seq", "action", "duration_s"]
    rows = skips.select("user_id", "ts", *columns).withWatermark("ts", delay)
    return _run(rows, "user_id", Totals(columns, _kinds(skips, columns), ttl_ms), f"{_kinds(skips, ['user_id'])}, skipped long, time_s double", "update")


def ordered_sessions(messages: DataFrame, delay: str = "10 minutes", ttl_ms: int | None = 30 * 24 * 3600 * 1000) -> DataFrame:
    """Messages (tab_id, ts, seq, action, video_id, body) of the tab's current video in the order of seq, unchanged ones once, with the generation."""
    columns = ["seq", "action", "video_id", "body"]
    rows = messages.select("tab_id", "ts", *columns).withWatermark("ts", delay)
    return _run(rows, "tab_id", Sessions(columns, _kinds(messages, columns), ttl_ms), f"{_kinds(messages, ['tab_id', *columns])}, generation long", "append")


def gathered_captions(captions: DataFrame, quiet_ms: int, delay: str = "10 minutes") -> DataFrame:
    """The captions (video_id, ts, start_ms, end_ms, text) of every video, once, in one batch, when none has come for quiet_ms.

    Captions that come again count once. What comes after its video was released is a transcript of its own.
    """
    columns = ["start_ms", "end_ms", "text"]
    rows = captions.select("video_id", "ts", *columns).withWatermark("ts", delay)
    return _run(rows, "video_id", Transcripts(columns, _kinds(captions, columns), quiet_ms), _kinds(captions, ["video_id", *columns]), "append")
