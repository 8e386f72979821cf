"""URL filters: a blocked Bloom filter of the listed URLs before an exact hash join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from .common import free_prefix, map_batches, table

#: One cache line: eight 64-bit words, one bit set in each.
BLOCK_WORDS = 8
BITS_PER_KEY = 16
#: Bytes of filter that may be broadcast; a longer list gets fewer bits a key, and the exact join more false hits to remove.
MAX_FILTER_BYTES = 64 << 20
#: Slices of the filter that are built apart.
SLICES = 64
MAX_RULES_BROADCAST = 100_000
#: (host, path, verdict): the registered query's list.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DEFAULT_VERDICT = "allow"


class BlockedBloom:
    """Membership of 64-bit hashes; no false negatives."""

    def __init__(self, hashes: np.ndarray, bits_per_key: int = BITS_PER_KEY, blocks: int = 0):
        self.blocks = blocks or blocks_for(len(hashes), bits_per_key)
        self.words = np.zeros((self.blocks, BLOCK_WORDS), dtype=np.uint64)
        block, masks = self._place(hashes)
        for w in range(BLOCK_WORDS):
            np.bitwise_or.at(self.words[:, w], block, masks[:, w])

    def _place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = hashes.astype(np.uint64)
        salts = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], dtype=np.uint64)
        bits = (((h & np.uint64(0xFFFFFFFF))[:, None] * salts[None, :]) & np.uint64(0xFFFFFFFF)) >> np.uint64(26)
        return block_of(h, self.blocks), np.uint64(1) << bits

    def __contains__(self, value: int) -> bool:
        return bool(self.might_hold(np.array([value], dtype=np.uint64))[0])

    def might_hold(self, hashes: np.ndarray) -> np.ndarray:
        block, masks = self._place(hashes)
        return ((self.words[block] & masks) == masks).all(axis=1)


def blocks_for(keys: int, bits_per_key: int = BITS_PER_KEY) -> int:
    return max(1, min(-(-keys * bits_per_key // (64 * BLOCK_WORDS)), MAX_FILTER_BYTES // (8 * BLOCK_WORDS)))


def block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)


def built_bloom(hashes: DataFrame, n: int) -> BlockedBloom:
    """The filter of ``hashes(h)``, ``n`` rows: executors build slices of the blocks, the driver puts them together."""
    blocks = blocks_for(n)
    slice_rows = -(-blocks // SLICES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            found = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            part = BlockedBloom.__new__(BlockedBloom)
            part.blocks = blocks
            block, masks = part._place(found)
            for s in np.unique(block // slice_rows):
                at = block // slice_rows == s
                words = held.setdefault(int(s), np.zeros((slice_rows, BLOCK_WORDS), dtype=np.uint64))
                for w in range(BLOCK_WORDS):
                    np.bitwise_or.at(words[:, w], block[at] - s * slice_rows, masks[at, w])
        for s, words in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([words.tobytes()], pa.binary())], ["s", "words"])

    top = F.shiftrightunsigned("h", 32)
    dealt = hashes.repartition(SLICES, F.floor(F.floor(top * blocks / float(1 << 32)) / slice_rows))  # a slice is mostly built in one task; parts are joined by or
    out = BlockedBloom(np.zeros(0, dtype=np.uint64), blocks=blocks)
    for r in map_batches(dealt, work, "s int, words binary").toLocalIterator():  # MAX_FILTER_BYTES and a little in all
        at = r["s"] * slice_rows
        words = np.frombuffer(r["words"], dtype=np.uint64).reshape(-1, BLOCK_WORDS)
        out.words[at : at + slice_rows] |= words[: blocks - at]
    return out


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` in lower case, and path without query and fragment; both empty for null or no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    after = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    empty = F.lit("")
    return F.coalesce(ascii_lower(host), empty), F.coalesce(after, empty)


def judge(urls: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """``urls(url, ...)`` and ``rules(host, path, verdict)`` -> all columns of ``urls``, ``host``, ``path``, ``rule``, ``verdict``.

    A rule fits its host and subdomains where the path starts with the rule's;
    the longest rule wins (host and path together, then host). Listed hosts are
    put in the form of a url's, without case, scheme and a leading dot. Every
    pair of a host suffix of a listed number of labels and a path prefix of a
    listed length is a candidate key, so that a host of very many labels costs
    no more; those the Bloom filter may hold go on to the exact join. Urls that
    no rule fits get ``default`` and a null rule, null and empty urls too, as
    their host and path are empty. Of rules with one host and path the blocking
    one holds; repeated urls are judged once and get equal rows; empty tables
    give no rows, or the default throughout. Existing columns of the four names
    are replaced.
    """
    spark = urls.sparkSession
    listed_host = F.regexp_replace(ascii_lower(F.coalesce("host", F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*://)?\.?", "")
    rules = rules.select(listed_host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    n = rules.count()
    labels = lambda host: F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    of = rules.agg(F.sort_array(F.collect_set(F.length("path"))).alias("lengths"), F.sort_array(F.collect_set(labels(F.col("host")))).alias("labels")).first()  # a few small numbers
    urls = urls.drop(*[c for c in urls.columns if c.lower() in ("host", "path", "rule", "verdict")])
    p = free_prefix(urls)
    host, path = host_and_path(F.col("url"))
    urls = urls.withColumn(f"{p}host", host).withColumn(f"{p}path", path)
    distinct = urls.select(F.col(f"{p}host").alias("host"), F.col(f"{p}path").alias("path")).distinct()  # copies of a url meet here, partly before the shuffle
    some = lambda columns: F.filter(F.array(*columns or [F.lit(None).cast("string")]), lambda c: c.isNotNull())
    suffixes = some([F.when(F.col("labels") >= k, F.substring_index("host", ".", -k)) for k in of["labels"]])
    prefixes = some([F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in of["lengths"]])
    keys = distinct.withColumn("labels", labels(F.col("host"))).withColumn("rule_host", F.explode(suffixes)).withColumn("rule_path", F.explode(prefixes)).drop("labels")
    keyed = keys.withColumn("h", F.xxhash64("rule_host", "rule_path"))
    bloom = spark.sparkContext.broadcast(built_bloom(rules.select(F.xxhash64("host", "path").alias("h")), n))  # at most MAX_FILTER_BYTES
    schema = StructType([*keyed.schema.fields]).add("maybe", BooleanType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = bloom.value.might_hold(batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], [*batch.schema.names, "maybe"])

    keyed = map_batches(keyed, work, schema).filter("maybe")
    listed = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    listed = F.broadcast(listed) if n <= MAX_RULES_BROADCAST else listed
    hits = keyed.join(listed, ["rule_host", "rule_path"])
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), "rule_host", "rule_path", "verdict")
    best = hits.groupBy(F.col("host").alias(f"{p}h"), F.col("path").alias(f"{p}p")).agg(F.max(rank).alias(f"{p}best"))
    judged = urls.join(best, (F.col(f"{p}host") == F.col(f"{p}h")) & (F.col(f"{p}path") == F.col(f"{p}p")), "left")
    rule = F.concat(F.col(f"{p}best.rule_host"), F.col(f"{p}best.rule_path"))
    own = [c for c in urls.columns if c not in (f"{p}host", f"{p}path")]
    return judged.select(*[F.col(f"`{c}`") for c in own], F.col(f"{p}host").alias("host"), F.col(f"{p}path").alias("path"), rule.alias("rule"), F.coalesce(f"{p}best.verdict", F.lit(default)).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = """
WITH r(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM a),
c AS (SELECT b.*, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) AS n
  FROM b LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM c WHERE n = 1"""
