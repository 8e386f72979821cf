"""Connected components of a large graph by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of any orderable id type -> ``(a, root)``: one row per id that has an edge; ids of a component share ``root``.

    Each round maps every id to the best of itself and its neighbours, by
    degree, then by a hash that changes with the round, and contracts the
    edges: stars fall together at once, chains lose a constant share of their
    ids each time. Rounds are written to the shared folder and deleted once
    read. Every join has a stored table on either side, so adaptive execution
    can split the rows of an id with very many edges. Self loops and repeated
    edges are harmless; no edges give an empty table.
    """
    edges = stored(edges.select("a", "b").filter("a <> b").distinct())
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        level = F.lit(len(maps))
        rank = lambda c, n, level=level: F.struct((-F.col(n)).alias("n"), F.xxhash64(c, level).alias("h"), F.col(c).alias("id"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = stored(both.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
        nearest = both.join(degree.select(F.col("a").alias("b"), F.col("n").alias("m")), "b").groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min(rank("b", "m")).alias("best"))
        maps.append(stored(nearest.select("a", F.least(rank("a", "n"), F.col("best"))["id"].alias("root"))))
        to = maps[-1]
        moved = (
            edges.join(to.withColumnRenamed("root", "ra"), "a")
            .join(to.select(F.col("a").alias("b"), F.col("root").alias("rb")), "b")
            .filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        )
        before, edges = edges, stored(moved.distinct())
        discard(before, degree)
    if not maps:
        return edges.select("a", F.col("b").alias("root"))
    labels = maps[0]
    for to in maps[1:]:
        before, up = labels, to.select(F.col("a").alias("root"), F.col("root").alias("up"))
        labels = stored(labels.join(up, "root", "left").select("a", F.coalesce("up", "root").alias("root")))
        discard(before, to)
    discard(edges)
    return labels
