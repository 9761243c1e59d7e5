"""What the operators share: words of texts in Arrow batches, and tables in the shared folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words are space and tab to carriage return, which bytes.split() splits on.
SEPARATORS = " \t\n\x0b\x0c\r"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts in UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def column(values, kind: pa.DataType) -> pa.Array:
    return pa.array(values, type=kind)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; a temporary one only where it is unset and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not (held := getattr(shared_folder, "own", None)):
        held = shared_folder.own = tempfile.mkdtemp(prefix="spanlight-")
    return f"file://{os.path.abspath(held)}"


#: A table from which on the shuffle files behind it are worth freeing at once.
TIDY_BYTES = 8 << 20


class Staged:
    """Tables written to the shared folder to cut lineage, so that a lost executor costs no more than one phase."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{operator}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str, tidy: bool = True) -> DataFrame:
        """The rows as a table; tidy also frees what earlier phases left on disk, once the table itself is large."""
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        del df
        found = self.spark.read.parquet(path)
        # Shuffle files go once their plans are garbage; the next phase needs the disk. The first
        # round frees what the second finds.
        for _ in range(2 if tidy and self._bytes(path) > TIDY_BYTES else 0):
            gc.collect()
            self.spark._jvm.System.gc()
        return found

    def _bytes(self, path: str) -> int:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()

    def drop(self, name: str) -> None:
        """Deletes a table that later phases no longer read."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The names, made longer until no column of the table has them in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def same(left, right):
    """Equality under which two nulls are equal."""
    return left.eqNullSafe(right)


def n_words(text) -> F.Column:
    """Number of words of a text column; null: 0."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    spaces = F.length(squeezed) - F.length(F.translate(squeezed, " ", ""))
    return F.when(squeezed == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def one_row_each(docs: DataFrame, first: DataFrame, doc_id: str) -> DataFrame:
    """Of every id in first (doc_id, n: how many rows have it) one row of docs, with all columns.

    Of rows that repeat an id, the one with the least hash over all columns stays; equal rows
    are one and the same. Columns that cannot be hashed or compared, like maps, pass through;
    columns may have any names.
    """
    own, n, row = free_names(docs, "one_id", "one_n", "one_row")
    names = first.select(F.col(doc_id).alias(own), F.col("n").alias(n))
    kept = docs.join(names, same(docs[doc_id], names[own]))
    once = kept.filter(F.col(n) == 1).select(docs.columns)
    mark = F.sha2(F.to_json(F.struct(*docs.columns)), 256)
    again = kept.filter(F.col(n) > 1).groupBy(own).agg(F.min_by(F.struct(*docs.columns), mark).alias(row))
    return once.unionByName(again.select(f"{row}.*"))
