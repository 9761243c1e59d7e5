"""Overlapping chunks of caption lines for a language model, in whole videos or in ranges of them.

A chunk takes as many lines as its size allows, prefers to end before a pause in its last
quarter, and the next one starts back by an overlap. Where a chunk that starts at a caption ends, and where the next one
starts, depends on the captions alone, not on the range, but for the range's last chunk. So both are found for
every caption at once, and the chunks of a range are the path from its first caption along these pointers.
Paths are walked by pointer doubling: a table of pointers that reach one step is joined with itself to one that reaches two, four,
eight steps, and in each round all chunks known so far find as many again. No video passes
through one task: everything is cut by numbers of captions or of characters.

Captions of a video are numbered without gaps. An empty table gives no chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import settled, spread
from .scans import BLOCK, running

CHUNK_CHARS, OVERLAP_MS, GAP_MS, FILL = 28_000, 90_000.0, 1_200.0, 0.75


def _measured(lines: DataFrame) -> DataFrame:
    """(video_id, event_idx, end_ms, upto, gap, block): characters up to and with each line, and the last caption up to here that a pause precedes."""
    rows = settled(lines.select("video_id", "event_idx", "start_ms", "end_ms", (F.length("line") + 1).cast("long").alias("size")), "sizes")
    block = F.floor(F.col("event_idx") / BLOCK)
    rows = running(rows, ["video_id"], block, ["event_idx"], {"upto": ("sum", F.col("size"), True), "before": ("last", F.col("end_ms"), False)})
    paused = F.when(F.col("start_ms") - F.col("before") >= GAP_MS, F.col("event_idx"))
    rows = running(rows, ["video_id"], block, ["event_idx"], {"gap": ("max", paused, True)})
    return rows.select("video_id", "event_idx", "end_ms", "size", "upto", "gap", block.alias("block"))


def _ends(rows: DataFrame, most: int) -> DataFrame:
    """(video_id, event_idx, reach, stop): where a chunk from each caption ends by its size, and where before a pause.

    Characters are cut into stretches of a chunk's size. The last line that fits begins in the
    stretch in which the size is used up, or is the last of the one before.
    """
    at = F.floor(F.col("upto") / most)
    lines = rows.select("video_id", "event_idx", at.alias("part"), F.col("upto").alias("t"), F.lit(None).cast("int").alias("probe"))
    used = F.col("upto") - F.col("size") + most
    probes = rows.select("video_id", F.lit(None).cast("int").alias("event_idx"), F.floor(used / most).alias("part"), used.alias("t"), F.col("event_idx").alias("probe"))
    order = W.partitionBy("video_id", "part").orderBy("t", F.col("probe").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    met = lines.unionByName(probes).withColumn("fits", F.max("event_idx").over(order)).filter("probe is not null")
    last = lines.groupBy("video_id", (F.col("part") + 1).alias("part")).agg(F.max("event_idx").alias("last"))
    reach = F.greatest(F.col("probe"), F.coalesce("fits", "last", "probe")) + 1
    ends = met.join(last, ["video_id", "part"], "left").select("video_id", F.col("probe").alias("event_idx"), reach.alias("reach"))
    gaps = rows.select("video_id", F.col("event_idx").alias("reach"), "gap")
    least = F.col("event_idx") + F.greatest(F.lit(1), F.floor((F.col("reach") - F.col("event_idx")) * FILL))
    stop = F.when(F.col("gap") > least, F.col("gap")).otherwise(F.col("reach"))
    return ends.join(gaps, ["video_id", "reach"], "left").select("video_id", "event_idx", "reach", stop.cast("int").alias("stop"))


def last_early(ends: np.ndarray, most: np.ndarray, below: np.ndarray) -> np.ndarray:
    """For every query the last place under `below` whose end is at most `most`; -1 if none.

    Halves of halves keep their least end; a query climbs until a neighbour on the left holds
    an end early enough, then goes down to its last one.
    """
    size = 1 << int(max(1, len(ends)) - 1).bit_length()
    least = np.full(2 * size + 1, np.inf)
    least[size : size + len(ends)] = ends
    level = size
    while level > 1:
        level >>= 1
        least[level : 2 * level] = least[2 * level : 4 * level].reshape(-1, 2).min(1)
    i = size + below.astype(np.int64)
    while (climbs := (i > 1) & ~((i & 1 == 1) & (least[i - 1] <= most))).any():
        i[climbs] >>= 1
    found = i > 1
    i[found] -= 1
    whole = ~found & (below >= size) & (least[1] <= most)
    i, found = np.where(whole, 1, i), found | whole
    while (falls := found & (i < size)).any():
        i[falls] = 2 * i[falls] + (least[2 * i[falls] + 1] <= most[falls])
    return np.where(found, i - size, -1)


def early_starts(pdf: pd.DataFrame, overlap: float) -> pd.DataFrame:
    """`_starts` for whole blocks: captions in order (earlier is -1), and a row for each earlier block with its least end.

    All blocks are looked through at once; what lies before a caption's own block is no answer.
    """
    captions = pdf["earlier"].to_numpy() < 0
    rows, told = pdf[captions], pdf[~captions]
    video, block, idx, ends = rows["video_id"].to_numpy(), rows["block"].to_numpy(), rows["event_idx"].to_numpy(), rows["end_ms"].to_numpy(float)
    edges = np.append(np.flatnonzero(np.append(True, (video[1:] != video[:-1]) | (block[1:] != block[:-1]))), len(rows))
    cutoff = ends - overlap
    found = last_early(np.where(np.isnan(ends), np.inf, ends), cutoff, np.arange(len(ends)) + 1)
    found = np.where(found >= np.repeat(edges[:-1], np.diff(edges)), found, -1)
    asked, at = np.full(len(ends), -1), {(video[i], block[i]): k for k, i in enumerate(edges[:-1])} if len(told) else {}
    for key, blocks in told.groupby(["video_id", "block"], sort=False):
        k, least = at[key], blocks["end_ms"].to_numpy(float)
        own = edges[k] + np.flatnonzero(found[edges[k] : edges[k + 1]] < 0)
        last = last_early(np.where(np.isnan(least), np.inf, least), cutoff[own], np.full(len(own), len(least)))
        asked[own] = np.where(last >= 0, blocks["earlier"].to_numpy()[last], -1)
    return pd.DataFrame({"video_id": video, "stop": idx + 1, "cutoff": cutoff, "block": asked, "back": np.where(found >= 0, idx[found] + 1, 0)})


def _starts(rows: DataFrame, overlap: float) -> DataFrame:
    """(video_id, stop, back): for a chunk that ends before `stop`, the caption after the last one that ends an overlap before the chunk's end.

    Each block of captions answers for its own; what it cannot, the last earlier block that holds an
    early enough end does, as a whole. Which that is, the blocks' least ends tell. Short videos are blocks of
    few captions, so Python gets many blocks at a time.
    """
    kind = rows.schema["video_id"].dataType.simpleString()
    blocks = rows.groupBy("video_id", "block").agg(F.min("end_ms").alias("least"))
    before = W.partitionBy("video_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    told = blocks.select("video_id", "block", F.collect_list(F.struct("block", "least")).over(before).alias("b")).select("video_id", "block", F.explode("b").alias("b"))
    number = F.lit(-1).cast(rows.schema["event_idx"].dataType).alias("event_idx")
    told = told.select("video_id", "block", F.col("b.block").alias("earlier"), number, F.col("b.least").alias("end_ms"))
    both = rows.select("video_id", "block", F.lit(-1).cast("long").alias("earlier"), "event_idx", "end_ms").unionByName(told)

    def own(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in parts:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            # The last block may go on in the next part.
            others = np.flatnonzero((pdf["video_id"] != pdf["video_id"].iloc[-1]) | (pdf["block"] != pdf["block"].iloc[-1]))
            whole = others[-1] + 1 if len(others) else 0
            rest = pdf.iloc[whole:]
            if whole:
                yield early_starts(pdf.iloc[:whole], overlap)
        if rest is not None:
            yield early_starts(rest, overlap)

    dealt = spread(both, "video_id", "block").sortWithinPartitions("video_id", "block", "earlier", "event_idx")
    first = dealt.mapInPandas(own, f"video_id {kind}, stop int, cutoff double, block long, back int")
    first = settled(first, "starts")
    # The last caption of a block whose end is early enough: among the block's ends in order, the latest so far.
    asked = first.filter("block >= 0").select("video_id", "block", F.col("cutoff").alias("t"), "stop", F.lit(None).cast("int").alias("event_idx"))
    if asked.isEmpty():
        return first.select("video_id", "stop", "back")
    lines = rows.join(asked.select("video_id", "block").distinct(), ["video_id", "block"], "left_semi").select("video_id", "block", F.col("end_ms").alias("t"), F.lit(None).cast("int").alias("stop"), "event_idx")
    order = W.partitionBy("video_id", "block").orderBy("t", F.col("stop").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    answered = lines.unionByName(asked).withColumn("found", F.max("event_idx").over(order)).filter("stop is not null")
    return first.filter("block < 0").select("video_id", "stop", "back").unionByName(answered.select("video_id", "stop", (F.col("found") + 1).alias("back")))


def chunk_pointers(lines: DataFrame, most_chars: int = CHUNK_CHARS, overlap_ms: float = OVERLAP_MS) -> DataFrame:
    """(video_id, event_idx, reach, stop, next) of every caption: if a chunk starts at it, where its size ends it, where it ends, and where the next one starts."""
    rows = settled(_measured(lines), "measured")
    ends = _ends(rows, most_chars).join(_starts(rows, overlap_ms), ["video_id", "stop"])
    return settled(ends.select("video_id", "event_idx", "reach", "stop", F.greatest(F.col("event_idx") + 1, "back").alias("next")), "pointers")


def chunk_ranges(pointers: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(video_id, keys, chunk_id, start_idx, end_idx) of ranges (video_id, keys, start_idx, end_idx) of captions; ends are exclusive.

    A range's path goes on as long as the last step's chunk did not reach the range's end. How far a chunk
    reaches never falls along a path, so pointers that reach all ends of a video's ranges are left out from the start.
    """
    keys = ["video_id", *keys]
    limits = ranges.filter("start_idx < end_idx").select(*keys, F.col("end_idx").alias("limit"), F.col("start_idx").alias("event_idx"), F.lit(0).alias("chunk_id"))
    found = settled(limits, "chunks")
    asked = found.groupBy("video_id").agg(F.min("event_idx").alias("first"), F.max("limit").alias("furthest"))
    # reached: how far the chunk of the last step's own start comes
    jumps = pointers.join(asked, "video_id").filter("event_idx >= first and reach < furthest").select("video_id", "event_idx", F.col("reach").alias("reached"), "next")
    step = 0
    while True:
        jumps = settled(jumps, f"jumps{step}")
        ahead = found.join(jumps, ["video_id", "event_idx"]).filter("reached < limit")
        ahead = ahead.select(*keys, "limit", F.col("next").alias("event_idx"), (F.col("chunk_id") + (1 << step)).alias("chunk_id"))
        ahead = settled(ahead, f"ahead{step}")
        if ahead.isEmpty():
            break
        found = found.unionByName(ahead)
        further = jumps.select("video_id", F.col("event_idx").alias("next"), "reached", F.col("next").alias("over"))
        jumps = jumps.select("video_id", "event_idx", "next").join(further, ["video_id", "next"]).select("video_id", "event_idx", "reached", F.col("over").alias("next"))
        step += 1
    ends = pointers.select("video_id", "event_idx", "reach", "stop")
    end = F.when(F.col("reach") >= F.col("limit"), F.col("limit")).otherwise(F.col("stop"))
    return found.join(ends, ["video_id", "event_idx"]).select(*keys, "chunk_id", F.col("event_idx").cast("int").alias("start_idx"), end.cast("int").alias("end_idx"))


def chunk_video(lines: DataFrame, most_chars: int = CHUNK_CHARS, overlap_ms: float = OVERLAP_MS) -> DataFrame:
    """(video_id, chunk_id, start_idx, end_idx): the chunks of whole videos."""
    pointers = chunk_pointers(lines, most_chars, overlap_ms)
    whole = pointers.groupBy("video_id").agg(F.min("event_idx").alias("start_idx"), (F.max("event_idx") + 1).alias("end_idx"))
    return chunk_ranges(pointers, whole, [])
