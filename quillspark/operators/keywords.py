"""Keyword counts and the merging of near-equal spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import top_k
from .order import first_seen

CANDIDATES = 200
LEAST_RATIO = 90


def exploded(df: DataFrame, words: Column, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.posexplode(words).alias("pos", "keyword"))


def top_keywords(df: DataFrame, words: Column, k: int = 10, groups: list[str] | None = None, order: str | Column | None = None) -> DataFrame:
    """The k most frequent keywords, of each group if there are groups; ties by first occurrence in ``order`` and in the list, or by keyword without one."""
    groups = groups or []
    if order is None:
        counts = df.select(*groups, F.explode(words).alias("keyword")).groupBy(*groups, "keyword").agg(F.count(F.lit(1)).alias("n"))
        return top_k(counts, k, [F.desc("n"), F.asc("keyword")], groups)
    each = df.select(*groups, (F.col(order) if isinstance(order, str) else order).alias("_o"), F.posexplode(words).alias("_at", "keyword"))
    counts = each.groupBy(*groups, "keyword").agg(F.count(F.lit(1)).alias("n"), first_seen("_o", "_at").alias("_first"))
    return top_k(counts, k, [F.desc("n"), F.asc("_first")], groups).drop("_first")


def rank_aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two ranked lists side by side; where one is shorter, empty words and zeros."""
    a = left.select("rank", F.col("keyword").alias("left_keyword"), F.col("n").alias("left_n"))
    b = right.select("rank", F.col("keyword").alias("right_keyword"), F.col("n").alias("right_n"))
    return a.join(b, "rank", "full").select("rank", *[F.coalesce(c, F.lit(0 if c.endswith("_n") else "")).alias(c) for c in ("left_keyword", "left_n", "right_keyword", "right_n")])


def indel_ratio(a: str, b: str) -> int:
    """Similarity from 0 to 100: twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 100
    row = [0] * (len(b) + 1)
    for x in a:
        above = 0
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], above + 1 if x == y else max(row[j], row[j - 1])
    return round(200 * row[-1] / (len(a) + len(b)))


def spelling_map(candidates: list[str], least: int = LEAST_RATIO) -> dict[str, str]:
    """Spellings, most frequent first -> the one of their group to use: each unplaced spelling gathers its ten nearest."""
    plain = lambda s: "".join(c if c.isalnum() else " " for c in s.lower()).strip()
    out: dict[str, str] = {}
    for term in candidates:
        if term in out:
            continue
        scored = [(indel_ratio(plain(term), plain(other)), -n, other) for n, other in enumerate(candidates)]
        near = [other for score, _, other in sorted(scored, reverse=True)[:10] if score >= least]
        chosen = term
        for other in near:
            if len(other) > len(chosen) or "-" in other:
                chosen = other
        out |= dict.fromkeys(near, chosen)
    return out


def merged_spellings(df: DataFrame, words: Column, k: int = CANDIDATES) -> dict[str, str]:
    """The map for the k most frequent keywords of a table; only these k reach the driver."""
    rows = top_keywords(df, words, k).orderBy("rank").collect()
    return spelling_map([r["keyword"] for r in rows])
