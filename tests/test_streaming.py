from pyspark.sql import Window
from pyspark.sql import functions as F

from spanlight import queries as Q
from spanlight.jobs.detect import detect_segments
from spanlight.operators import windows as WN
from spanlight.sources.captions import parse_captions, payload_status
from spanlight.sources import samples as D
from spanlight.sources.samples import sample
from spanlight.streaming.streams import caption_stream, detect_stream, session_stream, skip_stats_stream

PATH = "/root/testdata/sf0.001"


def replayed(spark, df, folder, order, parts=3):
    """The rows as a stream of files, in order."""
    rows = df.withColumn("__p", F.ntile(parts).over(Window.orderBy(*order)))
    for k in range(1, parts + 1):
        rows.filter(f"__p = {k}").drop("__p").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(stream, name, mode, tmp_path):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return q


def test_skip_stats_equal_batch(spark, tmp_path):
    skips = sample(spark, PATH, D.SKIPS)
    run(skip_stats_stream(replayed(spark, skips, str(tmp_path / "in"), ["ts", "seq"])), "skip_stats", "update", tmp_path)
    last = {}
    for r in spark.sql("select * from skip_stats").collect():
        last[r.user_id] = (r.skipped, round(r.time_s, 4))
    batch = {r.user_id: (r.skipped, round(r.time_s, 4)) for r in Q.a8_skip_totals(spark, PATH).collect()}
    assert last == batch and len(batch) > 5


def test_sessions_equal_batch(spark, tmp_path):
    messages = sample(spark, PATH, D.MESSAGES).drop("n")
    run(session_stream(replayed(spark, messages, str(tmp_path / "in"), ["seq"])), "sessions", "append", tmp_path)
    got = {(r.tab_id, r.seq) for r in spark.sql("select * from sessions").collect()}
    want = {(r.tab_id, r.seq) for r in Q.w7_drop_repeats(spark, PATH).collect()}
    assert got == want and len(want) > 100


def test_sessions_keep_the_types_of_their_ids(spark, tmp_path):
    rows = [
        ("t", 1, "VIDEO_CHANGED", "dQ-w4", None), ("t", 2, "PROCESS_TRANSCRIPT", "dQ-w4", "x"), ("t", 3, "PROCESS_TRANSCRIPT", "dQ-w4", "x"), ("t", 4, "PROCESS_TRANSCRIPT", "old", "y"),
        ("t", 5, "CHANNEL_BLOCKED", "dQ-w4", None), ("t", 6, "PROCESS_TRANSCRIPT", "dQ-w4", "z"), ("t", 7, "VIDEO_CHANGED", "dQ-w4", None), ("t", 8, "PROCESS_TRANSCRIPT", "dQ-w4", "x"),
    ]
    messages = spark.createDataFrame(rows, "tab_id string, seq long, action string, video_id string, body string")
    run(session_stream(replayed(spark, messages, str(tmp_path / "in"), ["seq"])), "named", "append", tmp_path)
    got = {(r.seq, r.video_id, r.body, r.generation) for r in spark.sql("select * from named").collect()}
    batch = WN.drop_repeats(WN.messages_for_current_video(messages)).collect()
    assert got == {(r.seq, r.video_id, r.body, r.generation) for r in batch} == {(2, "dQ-w4", "x", 1), (8, "dQ-w4", "x", 3)}


def test_captions_and_detection(spark, tmp_path):
    raw = Q.payloads(spark, PATH).withColumn("ts", F.timestamp_seconds(F.col("video_id") + 1_000_000_000))
    twice = raw.unionByName(raw)
    run(caption_stream(replayed(spark, twice, str(tmp_path / "in"), ["ts"])), "captions", "append", tmp_path)
    rows = lambda df: sorted(tuple(r) for r in df.select("video_id", "start_ms", "end_ms", "text").collect())
    assert rows(spark.table("captions")) == rows(Q.s1_parse_captions(spark, PATH))
    found, few = [], raw.filter("video_id < 3")
    q = detect_stream(replayed(spark, few, str(tmp_path / "in2"), ["ts"], 1), lambda df, n: found.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    batch = detect_segments(parse_captions(few.join(payload_status(few).filter("status = 'ok'"), "video_id", "left_semi")))
    assert found and sorted(map(tuple, found)) == sorted(map(tuple, batch.collect()))
