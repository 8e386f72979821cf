"""Row order as data: gapless numbers, and ties that go to what was seen first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import shared_path

#: A row's number within its partition is in so many low bits of ``monotonically_increasing_id``.
PARTITION_BITS = 33


def numbered(df: DataFrame, *order: Column | str, name: str = "_ord") -> DataFrame:
    """``df`` with gapless numbers from 0 by ``order``, or in the order that it has.

    Rows are dealt into ranges of ``order`` and written sorted with their
    partition and their place in it; the sizes of the partitions, a number
    each, sum up to where each begins. No task sees more than its range, and
    what a lost executor recomputes is written once only. Rows of one value of
    ``order`` are in one range: end it with a column that tells rows apart.
    """
    part, place = f"{name}_part", f"{name}_place"
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    path = shared_path(df.sparkSession)
    dealt.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PARTITION_BITS) - 1))}).write.parquet(path)
    held = df.sparkSession.read.parquet(path)
    sizes = sorted((r[part], r["n"]) for r in held.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    begins, total = [], 0
    for p, n in sizes:
        begins.append((p, total))
        total += n
    starts = F.broadcast(df.sparkSession.createDataFrame(begins, f"{part} int, {name}_start long"))
    return held.join(starts, part).withColumn(name, F.col(place) + F.col(f"{name}_start")).drop(part, place, f"{name}_start")


def first_seen(order: Column | str, position: Column | str | None = None) -> Column:
    """An aggregate: the least order, and place within the row, at which a group's value occurs."""
    keys = [order] if position is None else [order, position]
    return F.min(F.struct(*[F.col(k).alias(f"k{i}") if isinstance(k, str) else k.alias(f"k{i}") for i, k in enumerate(keys)]))
