"""National collaboration: single- and multi-country publications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import top_k, wilson


def status(n_countries: Column) -> Column:
    return F.when(n_countries > 1, "MCP").when(n_countries == 1, "SCP").otherwise("Unresolved")


def contributions(df: DataFrame, countries: str, leader: str) -> DataFrame:
    """Per country: documents with any address there, documents led, percent of all documents.

    One aggregate: every document gives a row for each of its countries, one
    for its leader and one without country, which counts the documents; the
    counts are joined with that one row of their own.
    """
    row = lambda c, there, led: F.struct(c.alias("country"), F.lit(there).alias("there"), F.lit(led).alias("led"))
    none = F.lit(None).cast("string")
    kind = "array<struct<country:string,there:int,led:int>>"
    there = F.transform(F.coalesce(F.col(countries), F.array().cast("array<string>")), lambda c: row(c, 1, 0))
    led = F.when(F.col(leader).isNotNull(), F.array(row(F.col(leader), 0, 1))).otherwise(F.array().cast(kind))
    rows = df.select(F.explode(F.concat(there, led, F.array(row(none, 0, 0)))).alias("r")).select("r.*")
    counts = rows.groupBy("country").agg(F.sum("there").alias("documents"), F.sum("led").alias("led"), F.count(F.lit(1)).alias("rows"))
    total = counts.filter("country is null").select(F.col("rows").alias("total"))
    joined = counts.filter("country is not null and documents > 0").crossJoin(F.broadcast(total))  # one row
    return joined.select("country", "documents", "led", (100.0 * F.col("documents") / F.greatest("total", F.lit(1))).alias("percent"))


def pivot(df: DataFrame, leader: str, group: str, collab: str, values: list[str], only: list[str] | None = None, k: int | None = None) -> DataFrame:
    """Documents by leader, group and status, one column each, with totals; a fixed list of leaders or the k largest."""
    known = df.filter(F.col(leader).isNotNull() & F.col(collab).isin("SCP", "MCP"))
    if only:
        known = known.filter(F.col(leader).isin(only))
    columns = [F.sum(((F.col(group) == g) & (F.col(collab) == c)).cast("long")).alias(f"{g}_{c}") for g in values for c in ("SCP", "MCP")]
    totals = [F.sum((F.col(collab) == c).cast("long")).alias(f"total_{c.lower()}") for c in ("SCP", "MCP")]
    table = known.groupBy(F.col(leader).alias("country")).agg(*columns, *totals, F.count(F.lit(1)).alias("total"))
    return table if k is None else top_k(table, k, [F.desc("total"), F.asc("country")]).drop("rank")


def summary(df: DataFrame, leader: str, collab: str, k: int = 12) -> DataFrame:
    """One row: totals by status, documents with a leader, those of the k largest leaders, coverage, rest."""
    count = lambda s: F.sum((F.col(collab) == s).cast("long"))
    total = df.agg(count("SCP").alias("scp"), count("MCP").alias("mcp"), F.count(F.lit(1)).alias("total"), F.count(leader).alias("identifiable"), count("Unresolved").alias("unresolved"))
    counts = df.filter(F.col(leader).isNotNull()).groupBy(leader).agg(F.count(F.lit(1)).alias("n"))
    shown = counts.orderBy(F.desc("n"), F.asc(leader)).limit(k).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("shown"))
    both = total.crossJoin(shown)  # one row each
    return both.select("*", F.round(F.col("shown") / F.greatest("identifiable", F.lit(1)), 6).alias("coverage"), (F.col("total") - F.col("shown")).alias("not_shown"))


def mcp_rates(df: DataFrame, groups: list[str], collab: str, least: int = 10) -> DataFrame:
    """MCP share of every group with enough documents, with Wilson's interval."""
    counts = df.filter(F.col(collab).isin("SCP", "MCP")).groupBy(*groups).agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col(collab) == "MCP").cast("long")).alias("mcp")).filter(F.col("documents") >= least)
    low, high = wilson(F.col("mcp"), F.col("documents"))
    return counts.select(*groups, "documents", "mcp", (F.col("mcp") / F.col("documents")).alias("proportion"), low.alias("low"), high.alias("high"))


def residual(df: DataFrame, leader: str, collab: str, k: int = 10, rest: str = "Others / unresolved") -> DataFrame:
    """Per status the k largest leaders, and all other documents as one row."""
    counts = df.groupBy(F.col(collab).alias("collab"), F.col(leader).alias("country")).agg(F.count(F.lit(1)).alias("n"))
    top = top_k(counts.filter("country is not null"), k, [F.desc("n"), F.asc("country")], ["collab"]).drop("rank")
    others = counts.join(top.select("collab", "country", F.lit(True).alias("_shown")), ["collab", "country"], "left").filter("_shown is null")
    return top.unionByName(others.groupBy("collab").agg(F.lit(rest).alias("country"), F.sum("n").alias("n")))
