"""The cache as a table: as one plain dictionary, few buckets opened, each of two writers' entries kept."""

from pyspark.sql import functions as F

from spanlight.operators.requests import CACHE_MS
from spanlight.sources.cache_table import SCHEMA, CacheTable

DAY = 24 * 3600 * 1000
NOW = 100 * DAY


def entries(spark, rows):
    """Rows (key, age in days, end): an entry with one segment that ends at `end`, or none if that is null."""
    return spark.createDataFrame([(k, NOW - age * DAY, [] if end is None else [(0.0, float(end))]) for k, age, end in rows], SCHEMA)


def held(table):
    return {r.cache_key: (NOW - r.created_at_ms) // DAY for r in table.read().collect()}


def test_upserts_equal_a_dictionary(spark, tmp_path):
    table, want = CacheTable(spark, str(tmp_path), 16), {}
    steps = [
        [(f"k{i}", i % 40, 5) for i in range(60)],
        [(f"k{i}", 1, -1 if i % 3 else None) for i in range(0, 80, 2)],
        [("k1", 35, 5), ("k3", 2, 5), ("k3", 0, 5), (None, 0, 5)],
    ]
    for k, step in enumerate(steps):
        new = {}
        for key, age, end in step:
            if key is not None and (end is None or end > 0):
                new[key] = min(age, new.get(key, age))
        want |= new
        want = {key: age for key, age in want.items() if age * DAY <= CACHE_MS}
        assert table.upsert(entries(spark, step), NOW) == k + 1
        assert held(table) == want
    assert "k1" not in held(table)
    jobs = spark.createDataFrame([("k3", 1), ("k1", 2), ("none", 3), (None, 4), ("k3", 5)], "cache_key string, bucket int")
    assert {r.bucket: r.hit for r in table.lookup(jobs, NOW).collect()} == {1: True, 2: False, 3: False, 4: False, 5: True}
    assert table.vacuum() > 0 and held(table) == want
    assert table.vacuum() == 0 and table.upsert(entries(spark, [("new", 0, 5)]), NOW) == 4 and held(table) == want | {"new": 0}


def test_an_emptied_bucket_stays_empty(spark, tmp_path):
    table = CacheTable(spark, str(tmp_path), 4)
    table.upsert(entries(spark, [("a", 0, 5)]), NOW)
    table.upsert(entries(spark, [("a", 40, 5)]), NOW)
    assert held(table) == {}


def test_empty_tables(spark, tmp_path):
    table = CacheTable(spark, str(tmp_path), 4)
    assert table.upsert(entries(spark, []), NOW) == 0 and table.read().count() == 0 and table.vacuum() == 0
    assert not table.lookup(entries(spark, [("a", 0, 5)]), NOW).first().hit


def test_a_lookup_opens_few_files(spark, tmp_path):
    table = CacheTable(spark, str(tmp_path), 400)
    many = spark.range(40000).select(F.sha2(F.col("id").cast("string"), 256).alias("cache_key"), F.lit(NOW).alias("created_at_ms"), F.expr("array(named_struct('start_ms', 0D, 'end_ms', 9D))").alias("segments"))
    table.upsert(many, NOW)
    jobs = many.limit(20).unionByName(entries(spark, [("absent", 0, 5)])).select("cache_key")
    opened = table.read(table._numbers(jobs)).inputFiles()
    assert 0 < len(opened) <= 21 and len(table.read().inputFiles()) == 400
    assert table.lookup(jobs, NOW).filter("hit").count() == 20


def test_two_writers_lose_nothing(spark, tmp_path):
    one, other = CacheTable(spark, str(tmp_path), 4), CacheTable(spark, str(tmp_path), 4)
    one.upsert(entries(spark, [("a", 3, 5)]), NOW)
    plain, first = one._commit, [True]

    def late(*args):
        if first.pop() if first else False:
            other.upsert(entries(spark, [("b", 2, 5), ("a", 1, 5)]), NOW)
        return plain(*args)

    one._commit = late
    assert one.upsert(entries(spark, [("c", 0, 5)]), NOW) == 3
    assert held(one) == {"a": 1, "b": 2, "c": 0}


def test_a_death_before_the_rename_is_not_seen(spark, tmp_path, monkeypatch):
    table = CacheTable(spark, str(tmp_path), 4)
    table.upsert(entries(spark, [("a", 3, 5)]), NOW)
    monkeypatch.setattr(table._table, "commit", lambda *a: 1 / 0)
    try:
        table.upsert(entries(spark, [("b", 0, 5)]), NOW)
    except ZeroDivisionError:
        pass
    monkeypatch.undo()
    assert held(table) == {"a": 3}
    assert table.upsert(entries(spark, [("b", 0, 5)]), NOW) == 2 and held(table) == {"a": 3, "b": 0}
