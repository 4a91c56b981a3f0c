"""Places and running sums over a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions.storage import kept

#: Bits of monotonically_increasing_id that count the rows of a partition.
_INSIDE = 33


def placed(df: DataFrame, order: list[Column], place: str, total: str | None = None, of: Column | None = None) -> DataFrame:
    """``df`` plus ``place``, from 1, in the order of ``order``, and ``total``, the sum of ``of`` up to each row.

    Rows are sorted by ranges and written; a range begins after the counts and
    sums of those before it, of which there is a row for each range.
    """
    value = F.lit(0) if of is None else of
    laid = df.withColumn("of__", value.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order)
    laid = kept(laid.withColumn("laid__", F.monotonically_increasing_id())).withColumn("part__", F.shiftrightunsigned("laid__", _INSIDE))
    sums = laid.groupBy("part__").agg(F.count(F.lit(1)).alias("n__"), F.sum("of__").alias("s__"))
    before = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part__", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"base_{c}") for c in ("n__", "s__")])
    inside = F.sum("of__").over(Window.partitionBy("part__").orderBy("laid__").rowsBetween(Window.unboundedPreceding, 0))
    at = F.col("laid__").bitwiseAND(F.lit((1 << _INSIDE) - 1)) + 1
    out = laid.withColumn("sum__", inside).join(F.broadcast(bases), "part__")  # a row for each range
    more = [] if total is None else [(F.col("base_s__") + F.col("sum__")).alias(total)]
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("base_n__") + at).alias(place), *more)
