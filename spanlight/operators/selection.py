"""Exact medians of columns of any length, found digit by digit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import settled

BITS, DIGITS = 16, 4


def _key(value):
    """A double's bits as a whole number in the order of the doubles."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), value + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def _value(key):
    bits = F.when(key >= 0, key).otherwise(key.bitwiseXOR(F.lit((1 << 63) - 1)))
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the median of every column, nulls aside; null if there is none. The mean of the two middle values where they are two.

    Values are numbers of 64 bits in order. In four passes the digits of 16 bits of the middle
    ones are found: each pass counts by digit the values that begin as is known by then. Counts are partial
    aggregates, and what one task sees whole is a row per digit.
    """
    named = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns)))
    keys = settled(df.select(named.alias("x")).select("x.*").filter("value is not null").select("name", _key(F.col("value")).alias("key")), "keys")
    sizes = keys.groupBy("name").agg(F.count("*").alias("n"))
    middle = F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))
    found = sizes.select("name", F.posexplode(middle).alias("side", "rank")).withColumn("prefix", F.lit(None).cast("long"))
    for k in range(DIGITS):
        shift = BITS * (DIGITS - 1 - k)
        rest = F.shiftright("key", shift)
        digit = rest if k == 0 else rest.bitwiseAND(F.lit((1 << BITS) - 1))
        begins = F.lit(True) if k == 0 else F.shiftright("key", shift + BITS) == F.col("prefix")
        met = keys.join(F.broadcast(found), "name").filter(begins)  # two rows a column
        counts = met.groupBy("name", "side", "rank", "prefix", digit.alias("digit")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(W.partitionBy("name", "side").orderBy("digit").rowsBetween(W.unboundedPreceding, 0))
        at = counts.withColumn("upto", upto).filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        prefix = F.col("digit") if k == 0 else F.shiftleft("prefix", BITS).bitwiseOR(F.col("digit"))
        found = at.select("name", "side", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), prefix.cast("long").alias("prefix"))
    ends = found.select("name", "side", _value(F.col("prefix")).alias("value"))
    value = lambda c, side: F.max(F.when((F.col("name") == c) & (F.col("side") == side), F.col("value")))
    return ends.agg(*((value(c, 0) + (value(c, 1) - value(c, 0)) * 0.5).alias(c) for c in columns))
