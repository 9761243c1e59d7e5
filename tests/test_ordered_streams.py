"""Streams out of order equal batch, state goes, transcripts in parts are detected once."""

import random

import pytest
from pyspark.sql import functions as F

from spanlight import queries as Q
from spanlight.jobs.detect import detect_segments
from spanlight.operators import windows as WN
from spanlight.sources import samples as D
from spanlight.sources.captions import segments_table
from spanlight.sources.committed import CommittedTable
from spanlight.sources.samples import sample
from spanlight.streaming.ordered import gathered_captions, ordered_sessions, ordered_skip_stats
from spanlight.streaming.streams import detect_into

PATH = "/root/testdata/sf0.001"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def fed(spark, rows, schema, folder, parts):
    """A stream of files, a part each; rows are dealt by parts, a list of lists of indexes."""
    for k, own in enumerate(parts):
        spark.createDataFrame([rows[i] for i in own], schema).coalesce(1).write.parquet(f"{folder}/{k:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def shuffled(n, parts, seed, last):
    """Indexes dealt out of order, near their places, and the last ones at the end."""
    rng = random.Random(seed)
    order = sorted(range(n), key=lambda i: i + rng.uniform(-30, 30))
    step = -(-n // parts)
    return [order[k : k + step] for k in range(0, n, step)] + [[n + i] for i in range(last)]


def run(stream, name, mode, folder):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return q


def kept_rows(q):
    return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def test_totals_of_shuffled_arrivals_equal_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k % 3, k, 1_000_000 + 10 * k, rng.choice(["RECORD", "REVERT"]), float(rng.randrange(-1, 40))) for k in range(300)]
    timed = lambda r: (r[0], r[1], r[2], r[3], r[4])
    batch = {r.user_id: (r.skipped, r.time_s) for r in WN.skip_totals(spark.createDataFrame(rows, "user_id long, seq long, ts long, action string, duration_s double")).collect()}
    rows = [timed(r) for r in rows] + [(99, 1000 + i, 2_000_000 + 100_000 * i, "RECORD", 1.0) for i in range(2)]
    stream = fed(spark, rows, "user_id long, seq long, ts long, action string, duration_s double", str(tmp_path / "in"), shuffled(300, 4, 2, 2))
    q = run(ordered_skip_stats(stream.withColumn("ts", F.timestamp_seconds("ts")), "20 minutes"), "totals", "update", tmp_path)
    last = {}
    for r in spark.sql("select * from totals").collect():
        last[r.user_id] = (r.skipped, round(r.time_s, 6))
    assert {u: x for u, x in last.items() if u != 99} == {u: (n, round(t, 6)) for u, (n, t) in batch.items()}
    assert max(kept_rows(q)) > kept_rows(q)[-1]


def test_sessions_of_shuffled_arrivals_equal_batch_and_go(spark, tmp_path):
    messages = sample(spark, PATH, D.MESSAGES).drop("n").orderBy("seq").limit(400).collect()
    batch = WN.drop_repeats(WN.messages_for_current_video(spark.createDataFrame(messages))).collect()
    rows = [(r.tab_id, r.seq, 1_000_000 + 10 * k, r.action, r.video_id, r.body) for k, r in enumerate(messages)]
    rows += [(99_999 + i, 10**9 + i, 2_000_000 + 1_000_000 * i, "VIDEO_CHANGED", 1, None) for i in range(3)]
    stream = fed(spark, rows, "tab_id long, seq long, ts long, action string, video_id long, body long", str(tmp_path / "in"), shuffled(len(messages), 3, 4, 3))
    q = run(ordered_sessions(stream.withColumn("ts", F.timestamp_seconds("ts")), "20 minutes", ttl_ms=500_000_000), "ordered", "append", tmp_path)
    got = sorted((r.tab_id, r.seq, r.generation) for r in spark.sql("select * from ordered").collect())
    assert got == sorted((r.tab_id, r.seq, r.generation) for r in batch) and len(got) > 50
    assert kept_rows(q)[-1] < max(kept_rows(q)) / 4


def captions_in_parts(spark):
    rows = [tuple(r) for r in Q.captions(spark, PATH).filter("video_id < 3").select("video_id", "start_ms", "end_ms", "text").orderBy("start_ms", "video_id").collect()]
    timed = [(v, 1_000_000 + int(s / 1000), s, e, t) for v, s, e, t in rows]
    far = [(10_000 + i, 3_000_000 + 1_000_000 * i, 0.0, 1.0, "the end of it") for i in range(2)]
    return rows, timed + far, "video_id long, ts long, start_ms double, end_ms double, text string"


def test_transcripts_in_parts_are_detected_once(spark, tmp_path, monkeypatch):
    rows, timed, schema = captions_in_parts(spark)
    n = len(rows)
    parts = [list(range(0, n // 3)), list(range(n // 4, n // 2)), list(range(n // 2, n)), [n], [n + 1]]  # some arrive twice
    stream = fed(spark, timed, schema, str(tmp_path / "in"), parts).withColumn("ts", F.timestamp_seconds("ts"))
    table = segments_table(spark, str(tmp_path / "out"), "long")
    whole, died = CommittedTable.commit, []

    def dies_once(self, attempt, batch):
        if not died and spark.read.parquet(f"{self.path}/{attempt}").count():
            died.append(batch)
            raise RuntimeError("the driver dies between files and commit")
        return whole(self, attempt, batch)

    monkeypatch.setattr(CommittedTable, "commit", dies_once)
    for _ in range(2):
        q = detect_into(gathered_captions(stream, 600_000, "1 minute"), table).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        try:
            q.awaitTermination(600)
        except Exception as e:
            assert "dies between" in str(e)
    assert died
    want = detect_segments(spark.createDataFrame(rows, "video_id long, start_ms double, end_ms double, text string"))
    got = table.read().select("video_id", "start_ms", "end_ms", "confidence", "category")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("video_id", "start_ms", "end_ms", "confidence", "category").collect())) != []
    assert table.sweep() == 1
