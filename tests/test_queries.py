"""Every query with SQL gives DuckDB's rows, and none is empty."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from spanlight import queries as Q

PATH = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6) if math.isfinite(x) else str(x)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, db, name):
    df = Q.QUERIES[name](spark, PATH)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = db.execute(Q.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want and got


def test_queries_without_sql(spark):
    for name in sorted(Q.QUERIES.keys() - Q.SQL.keys()):
        assert Q.QUERIES[name](spark, PATH).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["video_id", "start_ms", "end_ms"]
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_chunks_cover_videos_of_any_length(spark, tmp_path):
    counts = {1: 1, 2: 5, 3: 20, 4: 21, 5: 35, 6: 36, 7: 605, 8: 606, 9: 1700}
    rows = ", ".join(f"({u}, {n})" for u, n in counts.items())
    events = spark.sql(f"SELECT user_id, user_id * 10000 + k AS event_id, timestamp_seconds(k) AS ts FROM (VALUES {rows}) AS t(user_id, n) LATERAL VIEW explode(sequence(1, n)) AS k")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = sorted((r.video_id, r.chunk_id, r.start_idx, r.end_idx) for r in Q.chunks(spark, str(tmp_path)).collect())
    assert got == [(u, k, 15 * k, min(15 * k + 20, n)) for u, n in counts.items() for k in range(n) if k == 0 or 15 * k + 5 < n]
    requests = Q.l5_llm_requests(spark, str(tmp_path)).collect()
    lines = {(r.video_id, x) for r in requests for x in r.lines.split("\n")}
    assert len(requests) == len(got) and len(lines) == sum(counts.values())
