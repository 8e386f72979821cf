"""The audit of a run of stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """Rows left after each of several row-wise stages, counted in one pass, with rows before and removed.

    ``stages`` are (name, condition); a stage sees what all before it kept.
    """
    kept = F.lit(True)
    counts = [F.count(F.lit(1)).alias("s0")]
    for n, (_, condition) in enumerate(stages, 1):
        kept = kept & F.coalesce(condition, F.lit(False))
        counts.append(F.sum(kept.cast("long")).alias(f"s{n}"))
    one = df.agg(*counts)
    rows = F.array(*[F.struct(F.lit(n).alias("stage_no"), F.lit(name).alias("stage"), F.coalesce(f"s{n}", F.lit(0)).cast("long").alias("records")) for n, name in enumerate(["loaded", *[s for s, _ in stages]])])
    return with_removed(one.select(F.explode(rows).alias("r")).select("r.*"))


def with_removed(stages: DataFrame) -> DataFrame:
    """``before`` and ``removed`` from the records of consecutive stages; a handful of rows."""
    before = F.coalesce(F.lag("records").over(Window.partitionBy(F.lit(0)).orderBy("stage_no")), F.col("records"))
    return stages.withColumn("before", before).withColumn("removed", F.col("before") - F.col("records"))
