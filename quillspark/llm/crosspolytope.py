"""Embedding near-duplicates: cross-polytope hashing with multiprobe buckets, candidates verified by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_prefix, map_batches, stored, table, without
from .components import connected_components
from .simhash import labelled

LEAST = 0.93
SEED = 42
PAIRS_AT_ONCE = 1 << 16


@dataclass(frozen=True)
class Hashing:
    """``tables`` tables of ``functions`` cross-polytope hashes each; a vector lies in its ``probes`` likeliest buckets of each table.

    With these, a pair of cosine 0.93 in 64 dimensions shares a bucket with
    probability 0.997, one of 0.95 or more with over 0.999; each table has
    (twice the dimensions)^``functions`` buckets.

    Buckets up to ``small`` are compared by one sweep over many of them, larger
    ones by a matrix product each, those over ``block_rows`` as pairs of blocks
    dealt to several tasks; about ``chunk_bytes`` of rows are looked at together.
    """

    tables: int = 6
    functions: int = 3
    probes: int = 4
    seed: int = SEED
    small: int = 32
    block_rows: int = 1024
    chunk_bytes: int = 16 << 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Hadamard transform of each row, in n log n steps; the width is a power of two."""
    rows, width = x.shape
    step = 1
    while step < width:
        pairs = x.reshape(rows, width // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, width)
        step *= 2
    return x / np.sqrt(width)


def bucket_codes(x: np.ndarray, hashing: Hashing) -> np.ndarray:
    """``(rows, tables, probes)``: codes of the buckets of each vector; a code names its table too.

    A hash is the signed axis nearest to the vector after three rounds of sign
    flips and Hadamard transforms. A bucket's loss is how much shorter the
    squared gaps to the chosen axes could be; the least losses are probed.
    """
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    signs = np.random.default_rng([hashing.seed, width]).integers(0, 2, (hashing.tables, hashing.functions, 3, width)) * 2.0 - 1.0
    ranks = min(3, width)
    choices = np.array(list(product(range(ranks), repeat=hashing.functions)))
    probes = min(hashing.probes, len(choices))
    out = np.empty((len(x), hashing.tables, probes), dtype=np.int64)
    for t in range(hashing.tables):
        code = np.full((len(x), len(choices)), t, dtype=np.int64)
        loss = np.zeros((len(x), len(choices)))
        for f in range(hashing.functions):
            turned = padded
            for s in signs[t, f]:
                turned = hadamard(turned * s)
            size = np.abs(turned)
            near = np.argsort(-size, axis=1, kind="stable")[:, :ranks]
            best = np.take_along_axis(size, near, 1)
            axis = near * 2 + (np.take_along_axis(turned, near, 1) < 0)
            code = code * (2 * width) + axis[:, choices[:, f]]
            loss += ((best[:, :1] - best) ** 2)[:, choices[:, f]]
        out[:, t] = np.take_along_axis(code, np.argsort(loss, axis=1, kind="stable")[:, :probes], 1)
    return out


def unit_rows(vectors: pa.ListArray) -> np.ndarray:
    """Equally long vectors as rows of length one, in double precision."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of huge or tiny entries stay in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _signed(batches: Iterator[pa.RecordBatch], hashing: Hashing) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column("dims").to_numpy()
        for d in np.unique(dims):
            part = batch.filter(pa.array(dims == d))
            codes = bucket_codes(unit_rows(part.column("v")), hashing).reshape(part.num_rows, -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("cid", "copies", "label", "dims", "v")), lists], ["cid", "copies", "label", "dims", "v", "codes"])


def _first_common(codes: np.ndarray, a: np.ndarray, b: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Whether ``here`` is the least code that two vectors share, so that a pair that meets in several buckets counts in one."""
    out = np.empty(len(a), dtype=bool)
    for at in range(0, len(a), PAIRS_AT_ONCE):
        s = slice(at, at + PAIRS_AT_ONCE)
        left, right = codes[a[s]], codes[b[s]]
        shared = (left[:, :, :, None] == right[:, :, None, :]).any(axis=3)
        out[s] = np.where(shared, left, np.iinfo(np.int64).max).min(axis=(1, 2)) == here[s]
    return out


def _stars(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a symmetric table of links: each member with the first one of its component, those aside that are first themselves."""
    root = np.full(len(linked), -1)
    for first in range(len(linked)):
        if root[first] >= 0:
            continue
        reached = np.zeros(len(linked), dtype=bool)
        reached[first] = True
        edge = reached
        while edge.any():
            edge = linked[edge].any(axis=0) & ~reached
            reached |= edge
        root[reached] = first
    member = np.nonzero(root != np.arange(len(root)))[0]
    return root[member], member


def _linked(rows: pa.Table, least: float, limit: int) -> pa.RecordBatch:
    """``(a, b, n)`` of whole sorted groups: with ``b`` what a group adds to the links of ``a`` is null and ``n`` zero, without it ``n`` is that number."""
    take = lambda c: rows.column(c).combine_chunks().to_numpy(zero_copy_only=False)
    key, code, lo, hi, own, parts, cid, copies = (take(c) for c in ("key", "code", "lo", "hi", "own", "parts", "cid", "copies"))
    label = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    x = unit_rows(rows.column("v").combine_chunks())
    flat = rows.column("codes").combine_chunks().flatten().to_numpy()
    codes = flat.reshape(len(key), -1)
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (code[1:] != code[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    group = np.cumsum(new) - 1
    sizes = np.bincount(group)
    small = (sizes[group] <= limit) & (parts == 1)
    left, right, star_a, star_b = [], [], [], []
    rest = np.nonzero(small)[0]
    for step in range(1, len(rest)):
        at = np.nonzero(group[rest[step:]] == group[rest[:-step]])[0]
        if not len(at):
            break
        a, b = rest[at], rest[at + step]
        ok = (label[a] == label[b]) & (np.einsum("ij,ij->i", x[a], x[b]) >= least)
        left.append(a[ok])
        right.append(b[ok])
        star_a.append(a[ok])
        star_b.append(b[ok])
    for g in np.unique(group[~small]):
        begin = np.searchsorted(group, g)
        mine = np.arange(begin, begin + sizes[g])
        if lo[begin] == hi[begin]:
            table_of = (x[mine] @ x[mine].T >= least) & (label[mine][:, None] == label[mine][None, :])
            np.fill_diagonal(table_of, False)
            table_of |= table_of.T
            a, b = np.nonzero(np.triu(table_of))
            left.append(mine[a])
            right.append(mine[b])
            a, b = _stars(table_of)
        else:  # two blocks of a large bucket: only pairs across them
            one, two = mine[own[mine] == lo[begin]], mine[own[mine] == hi[begin]]
            across = (x[one] @ x[two].T >= least) & (label[one][:, None] == label[two][None, :])
            a, b = np.nonzero(across)
            left.append(one[a])
            right.append(two[b])
            both = np.zeros((len(mine), len(mine)), dtype=bool)
            both[: len(one), len(one) :] = across
            both |= both.T
            mine = np.concatenate([one, two])
            a, b = _stars(both)
        star_a.append(mine[a])
        star_b.append(mine[b])
    none = np.zeros(0, dtype=np.int64)
    a, b = np.concatenate([none, *left]), np.concatenate([none, *right])
    counted = _first_common(codes.reshape(len(key), -1, codes_per_table(rows)), a, b, code[a])
    a, b = a[counted], b[counted]
    ids, at = np.unique(cid, return_inverse=True)
    links = np.zeros(len(ids), dtype=np.int64)
    np.add.at(links, at[a], copies[b])
    np.add.at(links, at[b], copies[a])
    some = links > 0
    stars = np.unique(np.stack([cid[np.concatenate([none, *star_a])], cid[np.concatenate([none, *star_b])]], axis=1), axis=0)
    total = len(stars) + int(some.sum())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([stars[:, 0], ids[some]])), pa.array(np.concatenate([stars[:, 1], none, np.zeros(int(some.sum()), dtype=np.int64)]), mask=np.arange(total) >= len(stars)), pa.array(np.concatenate([np.zeros(len(stars), dtype=np.int64), links[some]]))],
        ["a", "b", "n"],
    )


def codes_per_table(rows: pa.Table) -> int:
    return int(rows.column("probes")[0].as_py())


def _links_of_partition(batches: Iterator[pa.RecordBatch], least: float, hashing: Hashing) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by dimensions and group; whole groups are compared as they complete, each length of vectors apart."""
    waiting: list[pa.RecordBatch] = []
    size = 0

    def whole(rows: pa.Table, last: bool) -> tuple[list[pa.Table], list[pa.RecordBatch]]:
        names = ("dims", "key", "code", "lo", "hi")
        parts = [rows.column(c).combine_chunks().to_numpy() for c in names]
        new = np.zeros(len(rows), dtype=bool)
        new[1:] = np.any([p[1:] != p[:-1] for p in parts], axis=0)
        cut = len(rows) if last else int(max(np.nonzero(new)[0], default=0))
        done, dims = rows.slice(0, cut), parts[0][:cut]
        at = [0, *(np.nonzero(dims[1:] != dims[:-1])[0] + 1).tolist(), cut]
        return [done.slice(i, j - i) for i, j in zip(at, at[1:], strict=False) if j > i], rows.slice(cut).to_batches()

    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size >= hashing.chunk_bytes:
            done, waiting = whole(pa.Table.from_batches(waiting), False)
            # a group that has not ended is looked at again only after as many bytes once more
            size = sum(b.nbytes for b in waiting) // 2
            for rows in done:
                yield _linked(rows, least, hashing.small)
    if waiting:
        for rows in whole(pa.Table.from_batches(waiting), True)[0]:
            yield _linked(rows, least, hashing.small)


def bucket_links(signed: DataFrame, least: float, hashing: Hashing) -> DataFrame:
    """``signed(cid, copies, label, dims, v, codes, probes)``, stored -> ``(a, b, n)`` as ``_linked`` gives them.

    Buckets with one vector are dropped by counts before any vector is
    shuffled; buckets over ``block_rows`` are dealt as pairs of blocks.
    """
    placed = signed.select("cid", "dims", F.xxhash64("label").alias("key"), F.explode("codes").alias("code"))
    shared = stored(placed.groupBy("dims", "key", "code").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    parts = F.ceil(F.col("size") / hashing.block_rows).cast("int")
    met = placed.join(shared.select("dims", "key", "code", parts.alias("parts")), ["dims", "key", "code"])
    own = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("cid", F.lit(SEED)), F.col("parts")).cast("int")).otherwise(0)
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("lo"), F.greatest(F.col("own"), j).alias("hi")))
    asked = stored(met.withColumn("own", own).select("cid", "key", "code", "parts", "own", F.explode(cells).alias("cell")).select("cid", "key", "code", "parts", "own", "cell.lo", "cell.hi"))
    held = asked.join(signed, "cid")
    order = ["dims", "key", "code", "lo", "hi"]
    dealt = held.select(*order, "own", "parts", "cid", "copies", "label", "v", "codes", "probes").repartition(*order).sortWithinPartitions(*order)
    out = stored(map_batches(dealt, lambda b: _links_of_partition(b, least, hashing), "a long, b long, n long"))
    discard(shared, asked)
    return out


def usable(column: Column) -> Column:
    """Neither null, empty or zero, nor with null or non-finite entries."""
    fine = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return column.isNotNull() & (F.size(column) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(column, lambda c: c != 0)


def near_duplicates(vectors: DataFrame, id: str = "vec_id", column: str = "embedding", label: str = "label", least: float = LEAST, hashing: Hashing = Hashing()) -> DataFrame:  # noqa: A002
    """All rows and columns of ``vectors`` with ``n_links``, ``component_id`` and ``kept``.

    Vectors of one label and length with cosine ``least`` or more that share a
    bucket are linked; ``n_links`` counts the other rows linked directly,
    ``component_id`` is the least id that links reach. Equal vectors of a label
    are one member with its number of copies, so copies never meet in a bucket.
    Rows with a null label, or a vector that is null, empty, zero or holds null
    or non-finite entries, link with nothing and are their own component. A row
    with a null id takes part; where only such rows are reached the component
    is null. ``kept`` tells whether id and component are the same. Repeated rows
    are rows like others, linked with each other; an empty table gives none.
    Columns with the three names are replaced.
    """
    p = free_prefix(vectors)
    v, name = F.col(f"`{column}`"), F.col(f"`{label}`").cast("string")
    rows = without(vectors, "n_links", "component_id", "kept").withColumns({f"{p}l": F.when(usable(v), name), f"{p}v": v})
    rows = stored(rows.withColumns({f"{p}v": F.when(F.col(f"{p}l").isNotNull(), F.col(f"{p}v")), f"{p}i": F.col(f"`{id}`")}))
    linkable = rows.filter(F.col(f"{p}l").isNotNull())
    classes = linkable.groupBy(F.col(f"{p}l").alias("label"), F.col(f"{p}v").alias("v")).agg(F.min(f"{p}i").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.withColumns({"cid": F.monotonically_increasing_id(), "dims": F.size("v")}))
    kind = classes.schema["v"].dataType.simpleString()
    signed = map_batches(classes.select("cid", "copies", "label", "dims", "v"), lambda b: _signed(b, hashing), f"cid long, copies long, label string, dims int, v {kind}, codes array<long>")
    signed = stored(signed.withColumn("probes", (F.size("codes") / hashing.tables).cast("int")))
    found = bucket_links(signed, least, hashing)
    roots = connected_components(found.filter("b IS NOT NULL").select("a", "b")).select(F.col("a").alias("cid"), "root")
    links = stored(found.filter("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n")))
    named = labelled(classes.select("cid", "label", "v", "copies"), classes.select("cid", "first_id"), roots, "cid")
    named = stored(named.join(links, "cid", "left").select(F.col("label").alias(f"{p}l"), F.col("v").alias(f"{p}v"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias(f"{p}n"), F.col("component_id").alias(f"{p}c")))
    discard(signed, found, links)
    inside = linkable.join(named, [f"{p}l", f"{p}v"])
    alone = rows.filter(F.col(f"{p}l").isNull()).withColumns({f"{p}n": F.lit(0).cast("long"), f"{p}c": F.col(f"{p}i")})
    whole = inside.select(*rows.columns, f"{p}n", f"{p}c").unionByName(alone)
    result = {"n_links": F.col(f"{p}n"), "component_id": F.col(f"{p}c"), "kept": F.col(f"{p}i").eqNullSafe(F.col(f"{p}c"))}
    return whole.withColumns(result).drop(f"{p}l", f"{p}v", f"{p}i", f"{p}n", f"{p}c")


def op13_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return found.select("vec_id", "n_links", "component_id", "kept")


#: Every pair of a label by cosine.
OP13_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: c::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.93
), reached AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
), placed AS (
  SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, least(e.vec_id, coalesce((SELECT min(b) FROM reached r WHERE r.a = e.vec_id), e.vec_id)) AS component_id FROM embeddings e
)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM placed
"""
