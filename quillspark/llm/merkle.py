"""Document fingerprints: a Merkle tree over paragraphs and sections."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_prefix, table, without

#: Code points of a leaf below a paragraph, where no sentence ends before.
LEAF_CHARS = 24
LEAF = rf"[^\n.!?]{{1,{LEAF_CHARS}}}[.!?]*|[.!?]+"
#: The key's ranges are the square of this at most: bounds the tables of cuts and of first rows.
MAX_SIDE = 200
#: Sampled keys for each range.
SAMPLED = 8
SECTION_BREAK = r"\n[ \t]*\n"


def tree(text: Column) -> Column:
    """The digests of every paragraph, by section: array<array<string>> of SHA-256."""
    return F.transform(F.split(text, SECTION_BREAK), lambda s: F.transform(F.split(s, "\n"), lambda p: F.sha2(p, 256)))


def section_digests(paragraphs: Column) -> Column:
    return F.transform(paragraphs, lambda s: F.sha2(F.array_join(s, ""), 256))


def root(text: Column) -> Column:
    """The root digest: of the section digests, which are of the paragraph digests."""
    return F.sha2(F.array_join(section_digests(tree(text)), ""), 256)


def leaves(text: Column) -> Column:
    """Hashes of the pieces below the paragraphs: sentences, cut after ``LEAF_CHARS`` code points."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(LEAF), F.lit(0)), lambda x: F.xxhash64(x)))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two leaf sets; two empty ones are alike."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Paths (section, paragraph) at which two trees differ: only sections whose digests differ are opened."""
    da, db, none = section_digests(a), section_digests(b), F.array().cast("array<string>")

    def opened(i: Column) -> Column:
        left, right = F.coalesce(F.get(a, i), none), F.coalesce(F.get(b, i), none)
        paths = F.transform(F.sequence(F.lit(0), F.greatest(F.size(left), F.size(right)) - 1), lambda j: F.when(~F.get(left, j).eqNullSafe(F.get(right, j)), F.struct(i.alias("section"), j.alias("paragraph"))))
        return F.filter(paths, lambda x: x.isNotNull())

    sections = F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1)
    return F.flatten(F.transform(F.filter(sections, lambda i: ~F.get(da, i).eqNullSafe(F.get(db, i))), opened))


def _cuts(docs: DataFrame, key: str, side: int, n: int) -> list[list[str]]:
    """Range limits as text, in ``side`` groups, from the keys of least hash: about ``SAMPLED`` of them for each range."""
    share = min(1.0, SAMPLED * side * side / max(1, n))
    sampled = docs.filter(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key, F.lit(29)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)).select(F.col(key).alias("k"))
    keys = [r["t"] for r in sampled.distinct().orderBy("k").select(F.col("k").cast("string").alias("t")).collect()]
    cuts = [keys[i] for i in sorted({len(keys) * j // (side * side) for j in range(1, side * side)} - {len(keys)})] if keys else []
    return [cuts[i : i + side] for i in range(0, len(cuts), side)]


def with_next(docs: DataFrame, key: str, rows_a_bucket: int = 2000) -> DataFrame:
    """``docs`` and ``next_text``: the text of the next row by ``key``, of any type with an order (ties by text); after the last, of the first.

    Rows are dealt into ranges of the key and ordered there; the first row of
    a range also visits the range before, so no range waits for another.
    """
    spark, p = docs.sparkSession, free_prefix(docs)
    kind = docs.schema[key].dataType.simpleString()
    n = docs.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    side = min(MAX_SIDE, max(1, math.ceil(math.sqrt(max(n / rows_a_bucket, 8 * parts)))))
    groups = _cuts(docs, key, side, n)
    bucket = F.lit(0)
    if groups:
        fine = F.from_json(F.lit(json.dumps(groups)), "array<array<string>>").cast(f"array<array<{kind}>>")  # one folded literal
        coarse = F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<string>").cast(f"array<{kind}>")
        at = F.size(F.filter(coarse, lambda c: c <= F.col(key)))
        bucket = F.when(at == 0, F.lit(0)).otherwise((at - 1) * side + F.size(F.filter(F.element_at(fine, F.greatest(at, F.lit(1))), lambda c: c <= F.col(key))))
    docs = docs.withColumn(f"{p}bucket", F.when(F.col(key).isNull(), F.lit(-1)).otherwise(bucket))
    firsts = sorted((tuple(r) for r in docs.groupBy(f"{p}bucket").agg(F.min(key)).collect()), key=lambda r: r[0])  # a row for each range
    before = {b: firsts[i - 1][0] for i, (b, _) in enumerate(firsts)}
    if not firsts:
        return docs.withColumn("next_text", F.lit(None).cast("string")).drop(f"{p}bucket")
    table_ = spark.createDataFrame([(b, k, before[b]) for b, k in firsts], f"{p}at int, {p}first {kind}, {p}before int")
    visit = lambda at, guest: F.struct(F.col(at).alias("b"), F.lit(guest).alias("guest"))
    home = F.array(visit(f"{p}bucket", False))
    visits = F.when(F.col(key).eqNullSafe(F.col(f"{p}first")), F.array(visit(f"{p}bucket", False), visit(f"{p}before", True)))
    dealt = docs.join(F.broadcast(table_), F.col(f"{p}bucket") == F.col(f"{p}at")).withColumn(f"{p}v", F.explode(F.coalesce(visits, home)))
    order = Window.partitionBy(f"{p}v.b").orderBy(f"{p}v.guest", key, "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).filter(~F.col(f"{p}v.guest")).drop(*[f"{p}{c}" for c in ("v", "at", "first", "before", "bucket")])


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs``, the tree, and the likeness to the next document and to an edit by it.

    Adds ``n_chars``, ``fingerprint``, ``sections`` (paragraph digests),
    ``edited_text``, ``edited_fingerprint``, ``near_edited`` and ``near_next``,
    replacing columns of those names. A null text counts as empty; null ids
    come first in the order; rows with one id are ordered by text, which
    leaves only equal rows in any order; the only row of a table is its own
    next; texts of any length are read whole; an empty table gives none.
    """
    docs = without(docs, "n_chars", "fingerprint", "sections", "edited_text", "edited_fingerprint", "near_edited", "near_next", "next_text")
    p = free_prefix(docs)
    own, edit, next_ = f"{p}own", f"{p}edit", f"{p}next"
    docs = docs.withColumn(text, F.coalesce(text, F.lit("")))
    paired = with_next(docs, key).withColumn("n_chars", F.length(text).cast("long"))
    tail = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col(text), F.lit(1), (F.col("n_chars") - tail).cast("int")), F.substring(F.col("next_text"), F.lit(1), tail))
    paired = paired.withColumn("edited_text", edited)
    measured = paired.withColumns({own: leaves(F.col(text)), edit: leaves(F.col("edited_text")), next_: leaves(F.col("next_text"))})
    return measured.withColumns(
        {
            "fingerprint": root(F.col(text)),
            "sections": tree(F.col(text)),
            "edited_fingerprint": root(F.col("edited_text")),
            "near_edited": likeness(F.col(own), F.col(edit)),
            "near_next": likeness(F.col(own), F.col(next_)),
        }
    ).drop(own, edit, next_)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
e AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (ORDER BY doc_id, text)) AS next_text, length(text) AS n_chars FROM d),
f AS (SELECT *, substring(text, 1, CAST(n_chars - n_chars // 4 AS BIGINT)) || substring(next_text, 1, CAST(n_chars // 4 AS BIGINT)) AS edited FROM e),
g AS (SELECT *, list_distinct(regexp_extract_all(text, '{LEAF}')) AS a, list_distinct(regexp_extract_all(edited, '{LEAF}')) AS b, list_distinct(regexp_extract_all(next_text, '{LEAF}')) AS c FROM f)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256,
  sha256(array_to_string(list_transform(string_split_regex(text, '\n[ \t]*\n'), lambda s: sha256(array_to_string(list_transform(string_split(s, chr(10)), lambda p: sha256(p)), ''))), '')) AS fingerprint,
  sha256(array_to_string(list_transform(string_split_regex(edited, '\n[ \t]*\n'), lambda s: sha256(array_to_string(list_transform(string_split(s, chr(10)), lambda p: sha256(p)), ''))), '')) AS edited_fingerprint,
  CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END AS near_edited,
  CASE WHEN len(a) + len(c) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(a, c)) / (len(a) + len(c)) END AS near_next
FROM g"""
