"""Counts, citations, indices, concentration, shares and intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FULL = "Full Corpus"


def with_full(df: DataFrame, group: str, full: str = FULL) -> DataFrame:
    """Every row once in its group and once in the full corpus; a null group counts in the latter only."""
    return df.withColumn(group, F.explode(F.array_compact(F.array(F.lit(full), F.col(group)))))


def spine(df: DataFrame, group: str, first: int, last: int) -> DataFrame:
    """Every group with every year."""
    return df.select(group).distinct().withColumn("year", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))


def yearly(df: DataFrame, group: str, year: str, cites: str, first: int, last: int, groups: list[str] | None = None) -> DataFrame:
    """Documents, citations and citations a document of each group (those of a fixed list, if given) and year, zero where there are none."""
    stats = df.groupBy(group, F.col(year).cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum(cites).alias("tc"))
    n, tc = F.coalesce("n", F.lit(0)), F.coalesce(F.col("tc").cast("double"), F.lit(0.0))
    every = df if groups is None else df.sparkSession.createDataFrame([(g,) for g in groups], f"`{group}` string")
    return spine(every, group, first, last).join(stats, [group, "year"], "left").select(group, "year", n.alias("n"), tc.alias("tc"), F.when(n > 0, tc / n).otherwise(0.0).alias("impact"))


def cumulative(df: DataFrame, group: str, year: str, value: str, name: str = "cumulative") -> DataFrame:
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(group).orderBy(year).rowsBetween(Window.unboundedPreceding, 0)))


def h_index(df: DataFrame, groups: list[str], cites: str, weight: Column | None = None) -> DataFrame:
    """The most h such that h documents have h citations each; a row stands for ``weight`` documents, one unless given.

    Documents are first counted by citations, so the window sees one row for
    each distinct count and not the documents of a group: h is the greatest
    min(count, documents with at least that count).
    """
    counted = df.withColumn("_c", F.floor(F.coalesce(F.col(cites).cast("double"), F.lit(0.0))).cast("long")).groupBy(*groups, "_c").agg(F.sum(F.lit(1) if weight is None else weight).alias("_n"))
    window = Window.partitionBy(*groups).orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, 0)
    reached = counted.withColumn("_docs", F.sum("_n").over(window))
    return reached.groupBy(*groups).agg(F.max(F.greatest(F.least("_c", "_docs"), F.lit(0))).cast("long").alias("h_index"))


def main_metrics(df: DataFrame, group: str, year: str, cites: str) -> DataFrame:
    """The main table for the full corpus and each group.

    Growth is that of the first to the last year with documents, a year; 0
    within one year. The peak year is the earliest of the fullest ones. Rows
    are counted once by group, year and citations; all else comes from those
    counts, which alone are doubled for the full corpus.
    """
    cells = df.groupBy(group, F.col(year).cast("long").alias("_y"), F.coalesce(F.col(cites).cast("double"), F.lit(0.0)).alias("_cites")).agg(F.count(F.lit(1)).alias("_k"))
    rows = with_full(cells, group)
    years = rows.groupBy(group, "_y").agg(F.sum("_k").alias("n"), F.sum(F.col("_cites") * F.col("_k")).alias("tc"), F.sum(F.when(F.col("_cites") > 0, F.col("_k")).otherwise(0)).alias("ncp"))
    out = years.groupBy(group).agg(
        F.sum("n").alias("documents"),
        F.sum("tc").alias("tc"),
        F.sum("ncp").alias("ncp"),
        F.min("_y").alias("first_year"),
        F.max("_y").alias("last_year"),
        F.min_by("n", "_y").alias("first_n"),
        F.max_by("n", "_y").alias("last_n"),
        F.max_by("_y", F.struct("n", -F.col("_y"))).alias("peak_year"),
    )
    span = F.col("last_year") - F.col("first_year")
    growth = F.when(span > 0, (F.pow(F.col("last_n") / F.col("first_n"), 1.0 / span) - 1) * 100).otherwise(0.0)
    return out.join(h_index(rows, [group], "_cites", F.col("_k")), group).select(
        group, "documents", "tc", "h_index", growth.alias("growth"), (F.col("tc") / F.col("documents")).alias("ac"), "ncp",
        (100.0 * F.col("ncp") / F.col("documents")).alias("pct_cited"), F.when(F.col("ncp") > 0, F.col("tc") / F.col("ncp")).otherwise(0.0).alias("ccp"), "first_year", "peak_year",
    )


def top_k(df: DataFrame, k: int, order: list[Column], groups: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """The first k rows by ``order``, of each group if there are groups, with their rank."""
    if not groups:
        few = df.orderBy(*order).limit(k)  # the window below sees k rows
        return few.withColumn(rank, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window).cast("long")).filter(F.col(rank) <= k)


def majority(df: DataFrame, groups: list[str], value: str, order: str | Column) -> DataFrame:
    """The most frequent value of each group, the first seen of equally frequent ones; two aggregates, no sort."""
    order = F.col(order) if isinstance(order, str) else order
    counted = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counted.groupBy(*groups).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), "first")).alias("m")).select(*groups, f"m.{value}", "m.n")


def source_table(df: DataFrame, source: str, cites: str, k: int = 20, order: str | None = None) -> DataFrame:
    """Articles, citations, citations an article and h-index of the k largest sources; ties by the first row in ``order``, or by name without one."""
    first = F.min(order) if order else F.first(F.lit(None).cast("long"))
    stats = df.groupBy(source).agg(F.count(F.lit(1)).alias("articles"), F.sum(F.coalesce(F.col(cites).cast("double"), F.lit(0.0))).alias("tc"), first.alias("_first"))
    top = top_k(stats, k, [F.desc("articles"), F.asc("_first"), F.asc(source)]).drop("_first")
    return top.join(h_index(df.join(top.select(source), source, "left_semi"), [source], cites), source).select("rank", source, "articles", "tc", (F.col("tc") / F.col("articles")).alias("cpp"), "h_index")


def bradford(df: DataFrame, group: str, source: str) -> DataFrame:
    """Journals and articles of Bradford's three zones for the full corpus and each group.

    Sources are counted by size first: a run of equally large sources is one
    row, and how many of it fall into a zone follows by arithmetic. The window
    therefore sees distinct sizes, not sources.
    """
    sizes = with_full(df.filter(F.col(source).isNotNull()).select(group, source), group).groupBy(group, source).agg(F.count(F.lit(1)).alias("size"))
    runs = sizes.groupBy(group, "size").agg(F.count(F.lit(1)).alias("sources"))
    articles = F.col("size") * F.col("sources")
    order = Window.partitionBy(group).orderBy(F.desc("size"))
    runs = runs.withColumn("total", F.sum(articles).over(Window.partitionBy(group))).withColumn("before", F.sum(articles).over(order.rowsBetween(Window.unboundedPreceding, 0)) - articles)
    # a source belongs to zones 1..z while the articles before it stay under z thirds of the total
    begun = lambda z: F.least(F.col("sources"), F.greatest(F.lit(0), F.ceil((F.lit(z) * F.col("total") - 3 * F.col("before")) / (3 * F.col("size"))))).cast("long")
    cut = runs.withColumn("z1", begun(1)).withColumn("z2", begun(2) - F.col("z1")).withColumn("z3", F.col("sources") - F.col("z1") - F.col("z2"))
    zones = [c for z in (1, 2, 3) for c in (F.sum(f"z{z}").alias(f"zone{z}_journals"), F.sum(F.col(f"z{z}") * F.col("size")).alias(f"zone{z}_articles"))]
    return cut.groupBy(group).agg(F.max("total").alias("total_articles"), *zones)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The bounds of Wilson's interval, within 0 and 1."""
    p = k / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def rca(df: DataFrame, row: str, column: str, least: int = 10) -> DataFrame:
    """Comparative advantage of every row and column value: the share in the row over the share in all; 0 where absent.

    ``least`` hides rows with fewer documents, after all shares are taken.
    """
    cells = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    of_row = cells.groupBy(row).agg(F.sum("n").alias("row_n"))
    of_column = cells.groupBy(column).agg(F.sum("n").alias("column_n"))
    total = of_row.agg(F.sum("row_n").alias("total"))
    grid = of_row.filter(F.col("row_n") >= least).crossJoin(of_column).crossJoin(F.broadcast(total))  # the whole grid is the result; the total is one row
    share = (F.coalesce("n", F.lit(0)) / F.col("row_n")) / (F.col("column_n") / F.col("total"))
    return grid.join(cells, [row, column], "left").select(row, column, "row_n", F.coalesce("n", F.lit(0)).alias("n"), share.alias("rca"))


def poisson_steps(mean: int) -> list[float]:
    """The distribution function of a Poisson count at 0, 1, 2 and so on, as far as it grows in double precision."""
    term = total = math.exp(-mean)
    steps = [total]
    while term > 0 and total + term * mean / len(steps) > total:
        term *= mean / len(steps)
        total += term
        steps.append(total)
    return steps


#: Cells up to this count are resampled by the exact inverse distribution, larger ones by its normal approximation with the term for skewness.
SMALL_CELL = 30
#: Hexadecimal digits of a digest that make a uniform number.
UNIFORM_DIGITS = 12


def uniform(key: Column, begin: int) -> Column:
    """A number in (0, 1) from the digits of the key's MD5 from ``begin`` on."""
    digits = F.conv(F.substring(F.md5(key.cast("binary")), begin, UNIFORM_DIGITS), 16, 10).cast("double")
    return (digits + 0.5) / float(16**UNIFORM_DIGITS)


def poisson_draw(n: Column, key: Column, steps: Column) -> Column:
    """A count with mean ``n`` from a hash of ``key``; ``steps`` is the distribution function where ``n`` is small."""
    u, v = uniform(key, 1), uniform(key, 1 + UNIFORM_DIGITS)
    normal = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
    large = F.greatest(F.lit(0.0), F.floor(n + F.sqrt(n) * normal + (normal * normal - 1) / 6 + 0.5))
    return F.when(n <= SMALL_CELL, F.size(F.filter(steps, lambda c: c < u)).cast("double")).otherwise(large.cast("double"))


def rca_bootstrap(df: DataFrame, row: str, column: str, replicates: int = 1000, least: int = 10, seed: int = 20260929) -> DataFrame:
    """95 % bounds of ``rca`` from resampled documents.

    Drawing each document a Poisson number of times makes the counts of the
    cells independent Poisson numbers with the counts as means, so replicates
    are drawn by cell: the work grows with the cells, not with the documents,
    and stays on the executors. A draw is a hash of seed, replicate and cell,
    so a rerun, or another engine, gives the same bounds.
    """
    estimate = rca(df, row, column, least)
    counted = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count(F.lit(1)).alias("_n"))
    small = F.broadcast(df.sparkSession.createDataFrame([(n, poisson_steps(n)) for n in range(1, SMALL_CELL + 1)], "_n long, _steps array<double>"))  # SMALL_CELL rows
    each = counted.join(small, "_n", "left").select(row, column, "_n", "_steps", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_rep"))
    key = F.concat_ws("|", F.lit(str(seed)), F.col("_rep").cast("string"), F.col(row).cast("string"), F.col(column).cast("string"))
    drawn = each.select("_rep", row, column, poisson_draw(F.col("_n"), key, F.col("_steps")).alias("_k"))
    of_row = drawn.groupBy("_rep", row).agg(F.sum("_k").alias("_r"))
    of_column = drawn.groupBy("_rep", column).agg(F.sum("_k").alias("_c"))
    total = of_row.groupBy("_rep").agg(F.sum("_r").alias("_t"))
    whole = drawn.join(of_row, ["_rep", row]).join(of_column, ["_rep", column]).join(total, "_rep").filter("_r > 0 and _c > 0")
    share = (F.col("_k") / F.col("_r")) / (F.col("_c") / F.col("_t"))
    bounds = whole.groupBy(row, column).agg(F.percentile(share, 0.025).alias("low"), F.percentile(share, 0.975).alias("high"), F.count(F.lit(1)).alias("replicates"))
    return estimate.join(bounds, [row, column], "left")


def stratified(df: DataFrame, stratum: str, rank: Column, k: int) -> DataFrame:
    """k rows of each stratum at most, those with the least rank."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy(rank))).filter(F.col("_n") <= k).drop("_n")


def percent_of_total(counts: DataFrame, n: str, name: str = "percent") -> DataFrame:
    """Each count's share of all, in percent; the total is one row, joined."""
    return counts.crossJoin(F.broadcast(counts.agg(F.sum(n).alias("_total")))).withColumn(name, 100.0 * F.col(n) / F.greatest("_total", F.lit(1))).drop("_total")
