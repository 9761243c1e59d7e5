"""Tables that cut the lineage of long jobs."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Up to so many rows of a table are sent to every executor; more are joined by shuffles.
FEW = 20_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(folder or 'file://' + tempfile.mkdtemp(prefix='spanlight-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder of spark.checkpoint.dir, computed once however often they are read.

    A lost executor then costs no more than the step at hand. Without that setting the rows are
    persisted instead, which recomputes what is lost. A few columns of a packed file look small to Spark whatever their
    rows, so it would gather them in the driver to send them around; the rows are counted as they are written, and more than FEW are
    joined by shuffles.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        return df.persist()
    path, size = shared_path(spark, name), Observation()
    df.observe(size, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    rows = spark.read.parquet(path)
    return rows if size.get["rows"] <= FEW else rows.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by keys into spark.sql.shuffle.partitions parts, before work that costs far more than its bytes tell.

    Adaptive execution joins small parts by bytes, and would leave such work to few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def once_each(df: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The rows with the columns that `work` adds to keys, worked out once for each distinct value of them.

    Texts recur, above all short ones. What is known of the distinct ones is a table, so no filter on a new column
    makes Spark put the work into it again, and steps that read the result twice do not work twice.
    """
    known = settled(work(spread(df.select(*keys).distinct(), keys[0])), name)
    known = known.withColumnsRenamed({c: f"__{c}" for c in keys})
    known = F.broadcast(known) if known.count() <= FEW else known.hint("merge")
    return df.join(known, [df[c].eqNullSafe(known[f"__{c}"]) for c in keys]).drop(*(f"__{c}" for c in keys))
