"""Deduplication with survivorship. Order is data: every tie ends at a row number, never at a partition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import present
from quillspark.operators import graph


def completeness(fields: list[str]) -> Column:
    """How many of the fields are neither null nor blank."""
    return reduce(lambda a, b: a + b, [present(f).cast("int") for f in fields], F.lit(0))


def _digest(columns: list[str]) -> Column:
    """SHA-256 of the columns, each with its length, null apart from empty."""
    told = lambda c: F.coalesce(F.concat(F.length(F.col(f"`{c}`").cast("string")), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("-"))
    return F.sha2(F.concat_ws("|", *map(told, columns)), 256)


def exact(df: DataFrame, row: str = "_row_id") -> DataFrame:
    """One row of each set equal in all other columns (nulls equal): the least ``row``, one of rows that share it; a null number comes last.

    One shuffle, by digest, of rows that the window's group limit has thinned
    to one of each digest and task before: copies, however many, do not meet in
    a task, and repeated or null numbers lose nothing.
    """
    hashed = df.withColumn("_digest", _digest([c for c in df.columns if c != row]))
    return survivors(hashed, ["_digest"], [F.asc_nulls_last(row)]).drop("_digest")


def survivors(df: DataFrame, keys: list[str], best: list[Column]) -> DataFrame:
    """The first row by ``best`` of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).filter("_n = 1").drop("_n")


def keyed(df: DataFrame, key: str, quality: Column, row: str = "_row_id") -> DataFrame:
    """Of rows with one key the richest, ties by ``row``; rows with a blank key all stay, each a partition of its own."""
    whole = df.withColumn("_quality", quality).withColumn("_alone", F.when(~present(key), F.col(row)))
    whole = whole.withColumn("_key", F.when(F.col("_alone").isNull(), F.col(key)))
    return survivors(whole, ["_key", "_alone"], [F.desc("_quality"), F.asc(row)]).drop("_quality", "_alone", "_key")


def order_after_key(key: str, quality: Column, row: str = "_row_id") -> Column:
    """The order that deduplication by key leaves: keyed rows by quality, then the others; as one sortable value."""
    has = present(key)
    return F.struct((~has).alias("bare"), F.when(has, -quality).otherwise(F.lit(0)).alias("quality"), F.col(row).alias("row"))


def guarded(df: DataFrame, keys: list[str], doi: str, quality: Column, order: str = "_row_id", salts: int = 32) -> DataFrame:
    """Of rows equal in all ``keys`` the best one; where they name several DOIs, the best of each and of those without.

    Rows with a blank key stay. ``doi`` is a normalised column, empty if absent.
    Two levels keep a key with a large share of all rows out of one task: the
    best row of each key, DOI and salt goes on to the best of each key and DOI;
    whether a key names several DOIs follows from the least and the greatest
    one, which the second level carries along. Its rows are written to the
    shared folder, since they are read for that and again to be chosen from.
    """
    complete = reduce(lambda a, b: a & b, [present(F.col(k).cast("string")) for k in keys])
    best = [F.desc("_quality"), F.asc(order)]
    whole = df.withColumn("_quality", quality).withColumn("_alone", F.when(~complete, F.col(order)))
    named = F.when(F.col(doi) != "", F.col(doi))
    salted = whole.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)))
    # one of each key, DOI and salt; then one of each key and DOI: at most as many rows a key as it names DOIs
    each = graph.checkpointed(survivors(survivors(salted, [*keys, "_alone", doi, "_salt"], best).drop("_salt"), [*keys, "_alone", doi], best))
    # a key's DOIs are counted by least and greatest; the group is now one row a DOI, so the range is a mergeable aggregate
    span = each.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_alone").alias("_a")).agg((F.min(named) < F.max(named)).alias("_several"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_alone").eqNullSafe(F.col("_a")))
    tried = each.join(span, same).drop(*[f"_k{i}" for i in range(len(keys))], "_a")
    tried = tried.withColumn("_sub", F.when(F.coalesce("_several", F.lit(False)), F.col(doi)).otherwise(F.lit("")))
    return survivors(tried, [*keys, "_alone", "_sub"], best).drop("_several", "_sub", "_quality", "_alone")
