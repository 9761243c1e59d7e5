"""The answers' cache as a table in buckets of keys: a lookup opens only the buckets of its keys."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.requests import cache_lookup, cache_upsert
from .committed import CommittedTable
from .tables import settled

SCHEMA = "cache_key string, created_at_ms bigint, segments array<struct<start_ms: double, end_ms: double>>"
#: Written beside the files of a version: the folder that holds each bucket as of that version.
MAP = "_buckets.json"


class CacheTable:
    """Entries (cache_key, created_at_ms, segments) in `buckets` parts by a hash of the key.

    An upsert reads and writes only the buckets that its keys fall in; the others stay where they
    are. It ends with a rename that fails if another writer was first, and then starts again from what that one
    left, so no entry of either is lost, and a reader sees a version whole or not at all. A bucket is sorted and written by one task, so `buckets` should
    grow with the table: at 4096, a billion entries are 250000 to a bucket. What comes to the driver is bucket
    numbers and the map from buckets to folders, never keys. Null keys are no entries; of a key's
    new entries the latest counts. Columns other than the three are left out.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 4096, schema: str = SCHEMA):
        self.spark, self.buckets, self.schema = spark, buckets, schema
        self._table = CommittedTable(spark, path, schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("cache_key"), F.lit(self.buckets)).cast("int")

    def current(self) -> tuple[int, dict[str, str]]:
        """The newest version, zero if there is none, and the folder of each of its buckets."""
        batches = self._table.batches()
        if not batches:
            return 0, {}
        newest = max(batches)
        return int(newest), json.loads(self._table.text(f"{batches[newest]}/{MAP}"))

    def _numbers(self, keys: DataFrame) -> list[int]:
        return [r[0] for r in keys.filter("cache_key IS NOT NULL").select(self._bucket()).distinct().collect()]

    def read(self, numbers: list[int] | None = None) -> DataFrame:
        """The entries of the given buckets, or all."""
        return self._of(self.current()[1], numbers)

    def _of(self, folders: dict[str, str], numbers: list[int] | None) -> DataFrame:
        wanted = folders if numbers is None else {str(b) for b in numbers} & folders.keys()
        paths = [f"{self._table.path}/{folders[b]}/bucket={b}" for b in sorted(wanted, key=int)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def lookup(self, jobs: DataFrame, now_ms: int) -> DataFrame:
        """`cache_lookup` on the buckets of the jobs' keys alone."""
        return cache_lookup(jobs, self.read(self._numbers(jobs)), now_ms)

    def upsert(self, new: DataFrame, now_ms: int, tries: int = 10) -> int:
        """`cache_upsert` without a bound on entries, on the buckets that the new keys fall in; returns the version."""
        new = settled(new.select("cache_key", "created_at_ms", "segments").filter("cache_key IS NOT NULL"), "cache")
        numbers = self._numbers(new)
        for _ in range(tries):
            version, folders = self.current()
            if not numbers:
                return version
            rows = cache_upsert(self._of(folders, numbers), new, now_ms, None).withColumn("bucket", self._bucket())
            if self._commit(rows, version + 1, folders, numbers):
                return version + 1
        raise RuntimeError(f"{tries} other writers were first")

    def _commit(self, rows: DataFrame, version: int, folders: dict[str, str], numbers: list[int]) -> bool:
        attempt = self._table.attempt(f"{version:010d}")
        at = f"{self._table.path}/{attempt}"
        rows.repartition("bucket").sortWithinPartitions("bucket", "cache_key").write.partitionBy("bucket").parquet(at)
        left = {n.partition("=")[2] for n in self._table.names(attempt) if n.startswith("bucket=")}
        kept = {b: f for b, f in folders.items() if int(b) not in set(numbers)} | {b: attempt for b in left}
        self._table.write_text(f"{attempt}/{MAP}", json.dumps(kept))
        return self._table.commit(attempt, f"{version:010d}")

    def vacuum(self) -> int:
        """Deletes what only older versions or lost attempts hold; nothing else may be reading or writing. Returns how many buckets' folders went."""
        version, folders = self.current()
        gone = 0
        for batch in self._table.batches():
            if int(batch) < version:
                self._table.delete(f"commits/{batch}")
        for attempt in self._table.names("data") if version else []:
            for name in self._table.names(f"data/{attempt}"):
                if name.startswith("bucket=") and folders.get(name.partition("=")[2]) != f"data/{attempt}":
                    self._table.delete(f"data/{attempt}/{name}")
                    gone += 1
        return gone
