"""Running values over long sequences, in two levels.

A sequence, such as the captions of a video, is cut into blocks by its order. Each block is gone
through by itself, and a row per block carries what the blocks before it add up to. So a
sequence of any length is many tasks, and what is gone through whole is a row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a block, where blocks are cut by a row's number.
BLOCK = 4096


def running(df: DataFrame, keys: list[str], block: Column, order: list[str], values: dict[str, tuple[str, Column, bool]]) -> DataFrame:
    """Adds a running value per name: (kind, expression, whether the row itself counts), by keys in the order.

    Kinds are sum, min, max and last, the last that is not null; nulls add nothing, and a value of
    nothing is null, or zero for a sum. block: which block a row lies in; it never falls along the order. Rows
    that tie in the order count in any order among themselves, so only sums over whole ties and min or max differ not.
    """
    inside = W.partitionBy(*keys, "__block").orderBy(*order)
    spans = {True: inside.rowsBetween(W.unboundedPreceding, 0), False: inside.rowsBetween(W.unboundedPreceding, -1)}
    rows = df.withColumn("__block", block)
    rows = rows.withColumns({f"__own_{k}": e for k, (_, e, _) in values.items()})
    within = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    whole = within | {"last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order)))}
    here = rows.withColumns({k: within[kind](f"__own_{k}").over(spans[itself]) for k, (kind, _, itself) in values.items()})
    blocks = rows.groupBy(*keys, "__block").agg(*(whole[kind](f"__own_{k}").alias(f"__all_{k}") for k, (kind, _, _) in values.items()))
    before = W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select(*keys, "__block", *(within[kind](f"__all_{k}").over(before).alias(f"__before_{k}") for k, (kind, _, _) in values.items()))
    both = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest, "last": lambda a, b: F.coalesce(b, a)}
    put = {k: both[kind](F.col(f"__before_{k}"), F.col(k)) for k, (kind, _, _) in values.items()}
    return here.join(carried, [*keys, "__block"]).withColumns(put).select(*df.columns, *values)
