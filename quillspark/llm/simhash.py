"""SimHash near-duplicates through pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_prefix, map_batches, stored, table
from .components import connected_components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Blocks that a fingerprint is cut into; a pair within four bits agrees on all but four whole ones.
BLOCKS = 6
#: Fingerprints up to which so many blocks do: keys of 20 bits, then 27, then 32, so that buckets stay small as the table grows.
MORE_BLOCKS = ((1 << 28, 6), (1 << 35, 7), (1 << 62, 8))
#: Reference fingerprints whose distances make up a table row.
PIVOTS = np.array([xxhash.xxh64_intdigest(f"pivot-{i}", SEED) for i in range(24)], dtype=np.uint64)
#: Buckets up to this size are compared in one vectorised sweep, larger ones by search.
SMALL = 32
#: Buckets over this size are dealt to several tasks as pairs of blocks.
BLOCK_ROWS = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash; null and wordless texts give zero."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    buffer = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    n = max(1, len(words) - shingle + 1)
    stops = (starts + lengths)[-n:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(buffer[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops.tolist(), strict=True)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, th, fp)`` of every row: id, hash of the text and SimHash as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(found.view(np.int64))], ["doc_id", "th", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), work, f"doc_id {kind}, th long, fp long")


def block_widths(blocks: int) -> list[int]:
    return [64 // blocks + (i < 64 % blocks) for i in range(blocks)]


def _block_keys(blocks: int = BLOCKS) -> F.Column:
    """An array with one bucket key for each choice of all but ``RADIUS`` blocks."""
    widths = block_widths(blocks)
    at = np.concatenate(([0], np.cumsum(widths)))
    part = [F.shiftrightunsigned("fp", int(at[i])).bitwiseAND(F.lit((1 << b) - 1)) for i, b in enumerate(widths)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - RADIUS)):
        key = F.lit(n).cast("long")
        for i in chosen:
            key = F.shiftleft(key, widths[i]).bitwiseOR(part[i])
        keys.append(key)
    return F.array(*keys)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each pivot."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def search_links(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one bucket, each from a member to the least member of its component.

    Breadth-first; a fingerprint once reached is no candidate any more. The
    candidates of a fingerprint are a window of the first pivot's sorted
    distances, thinned by the other coordinates and verified.
    """
    fps = np.unique(fps)
    distances = pivot_table(fps)
    order = np.argsort(distances[:, 0], kind="stable")
    fps, distances = fps[order], distances[order]
    left = np.arange(len(fps))
    low, high = [], []
    while len(left):
        group, queue, left = [left[0]], [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            first = distances[left, 0]
            a, b = np.searchsorted(first, distances[at, 0] - radius), np.searchsorted(first, distances[at, 0] + radius, "right")
            near = np.arange(a, b)
            for p in range(1, distances.shape[1]):
                if not len(near):
                    break
                near = near[np.abs(distances[left[near], p] - distances[at, p]) <= radius]
            near = near[np.bitwise_count(fps[left[near]] ^ fps[at]) <= radius]
            if len(near):
                group.extend(left[near])
                queue.extend(left[near])
                left = np.delete(left, near)
        if len(group) > 1:
            members = fps[group]
            low.append(np.full(len(group) - 1, members.min()))
            high.append(members[members != members.min()])
    empty = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(low), np.concatenate(high)) if low else (empty, empty)


def sweep_links(bucket: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All links inside small buckets: ``bucket`` is sorted; row i is held against row i+1, i+2, ... of its bucket."""
    distances = pivot_table(fps)
    low, high = [], []
    for step in range(1, len(fps)):
        at = np.nonzero(bucket[step:] == bucket[:-step])[0]
        if not len(at):
            break
        for p in range(distances.shape[1]):
            at = at[np.abs(distances[at + step, p] - distances[at, p]) <= radius]
        at = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= radius]
        low.append(fps[at])
        high.append(fps[at + step])
    empty = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(low), np.concatenate(high)) if low else (empty, empty)


def _links_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, cell); whole buckets are compared as they complete."""
    held = np.zeros((0, 3), dtype=np.int64)

    def links(rows: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        bucket = np.cumsum(new) - 1
        sizes = np.bincount(bucket)
        fps = rows[:, 2].copy().view(np.uint64)
        small = (sizes[bucket] > 1) & (sizes[bucket] <= SMALL)
        a, b = sweep_links(bucket[small], fps[small])
        low, high = [a], [b]
        for large in np.nonzero(sizes > SMALL)[0]:
            s = np.searchsorted(bucket, large)
            a, b = search_links(fps[s : s + sizes[large]])
            low.append(a)
            high.append(b)
        pairs = np.unique(np.stack([np.concatenate(low).view(np.int64), np.concatenate(high).view(np.int64)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    waiting: list[np.ndarray] = []
    size = 0
    for batch in batches:
        waiting.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1))
        size += len(waiting[-1])
        if size < 50_000:
            continue
        rows = np.concatenate([held, *waiting])
        last = np.nonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))[0]
        cut = last[-1] + 1 if len(last) else 0
        held, waiting, size = rows[cut:], [], 0
        if cut:
            yield links(rows[:cut])
    rows = np.concatenate([held, *waiting])
    if len(rows):
        yield links(rows)


def fingerprint_links(distinct: DataFrame, blocks: int | None = None) -> DataFrame:
    """``distinct(fp)`` -> ``(a, b)``: links whose components are those of all pairs within ``RADIUS`` bits."""
    if blocks is None:
        n = distinct.count()
        blocks = next(b for most, b in MORE_BLOCKS if n <= most)
    keyed = distinct.select("fp", F.explode(_block_keys(blocks)).alias("key"))
    large = stored(keyed.groupBy("key").count().filter(F.col("count") > BLOCK_ROWS).select("key", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("parts")))
    whole = keyed.withColumn("cell", F.lit(0).cast("long"))
    if not large.isEmpty():
        own = F.pmod(F.xxhash64("fp", "key"), F.col("parts")).cast("int")
        cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(F.col("own"), j).cast("long") * 1_000_003 + F.greatest(F.col("own"), j))
        spread = keyed.join(large, "key").withColumn("own", own).select("fp", "key", F.explode(cells).alias("cell"))
        whole = keyed.join(large, "key", "left_anti").withColumn("cell", F.lit(0).cast("long")).unionByName(spread)
    dealt = whole.select("key", "cell", "fp").repartition("key", "cell").sortWithinPartitions("key", "cell")
    return map_batches(dealt, _links_of_partition, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: ``(doc_id, th, fp, component_id, root)``.

    Equal fingerprints are merged first, so copies never meet in a bucket; the
    distinct ones are bucketed by pairs of whole blocks (no link within four
    bits is lost), pairs are discarded by the largest difference of their pivot
    distances and the rest verified. ``component_id`` is the least doc_id that
    links reach. Null, empty and wordless texts have fingerprint zero; rows
    with a null id take part, and a group of such rows only has a null
    ``component_id``; repeated rows stay repeated; very long texts are summed
    in blocks; an empty table gives none. Other columns of ``docs`` are not
    read.
    """
    rows = stored(fingerprints(docs, shingle))
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(fingerprint_links(distinct)).select(F.col("a").alias("fp"), "root")
    return labelled(rows, distinct, roots, "fp").select("doc_id", "th", "fp", "component_id", "root")


def labelled(rows: DataFrame, distinct: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """``rows``, each with ``root`` and ``component_id``, the least ``first_id`` of its component in ``distinct(key, first_id)``.

    Both sides of every join are stored tables, so adaptive execution can split
    a component or a group of copies that holds a large share of all rows.
    """
    placed = stored(distinct.select(key, "first_id").join(roots, key, "left").withColumn("root", F.coalesce("root", key)))
    least = stored(placed.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = stored(placed.join(least, "root").select(key, "root", "component_id"))
    discard(placed, least)
    return rows.join(named, key)


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The documents that stay: one row of each component, as ``keep_one`` chooses it."""
    return keep_one(docs, near_duplicates(docs, shingle))


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of each component ``root`` of ``found(doc_id, th, root)``, the least doc_id, with all columns of ``docs``.

    Of rows that share the least id the least text hash stays, of fully
    repeated rows one; a row with a null id stays only where its component has
    no numbered row. Null and empty texts are texts like others; an empty table
    gives none.
    """
    p = free_prefix(docs)
    counted = found.groupBy("root", "doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnumbered"), "doc_id", "th", "n")).alias("m"))
    once = stored(best.select(F.col("m.doc_id").alias(f"{p}id"), F.col("m.th").alias(f"{p}th"), F.col("m.n").alias(f"{p}n")))
    hashed = docs.withColumn(f"{p}hash", F.xxhash64("text"))
    kept = hashed.join(once, F.col("doc_id").eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}hash") == F.col(f"{p}th")), "left_semi")
    if not once.filter(F.col(f"{p}n") > 1).isEmpty():
        kept = kept.dropDuplicates(["doc_id", f"{p}hash"])
    return kept.drop(f"{p}hash")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
