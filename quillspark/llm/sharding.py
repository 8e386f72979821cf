"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .common import free_prefix, table, without

SHARDS = 40
VNODES = 64
#: Ring positions; a shard's virtual nodes sit on some of them and keys fall on any.
POSITIONS = 1 << 14
#: A position with more rows than this, and than one in HOT_SHARE of all, is ranked in PARTS parts by text, each a task of its own.
HOT_ROWS = 1 << 14
HOT_SHARE = 512
PARTS = 256


def ring(shards: int, vnodes: int = VNODES, positions: int = POSITIONS) -> list[int]:
    """The shard that owns each position: that of the first virtual node clockwise; the least shard where nodes collide."""
    nodes: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big") % positions
            nodes[at] = min(shard, nodes.get(at, shard))
    missing = sorted(set(range(shards)) - set(nodes.values()))
    for shard in missing:  # all its nodes collided
        at = next(p for p in range(positions) if p not in nodes)
        nodes[at] = shard
    owners, owner = [0] * positions, nodes[min(nodes)]
    for at in range(positions - 1, -1, -1):
        owner = nodes.get(at, owner)
        owners[at] = owner
    return owners


def assign(counts: dict[int, int], owners: list[int], shards: int, epsilon: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(position, first, last, shard, slot)``: rows ranked first..last-1 of a position go to a shard from a slot on.

    Every shard first takes the rows of its own arcs up to its capacity, by
    clockwise position; the rest continue clockwise past full shards to the
    next that has room. Capacity is the mean load times ``1 + epsilon``; with
    0, loads are the mean rounded down or up, so counts differ by one at most.
    """
    total = sum(counts.values())
    wanted = [0] * shards
    for at, n in counts.items():
        wanted[owners[at]] += n
    if epsilon > 0:
        room = [int(total / shards * (1 + epsilon)) + 1] * shards
    else:
        low, more = divmod(total, shards)
        extra = set(sorted(range(shards), key=lambda s: (-wanted[s], s))[:more])  # the fullest keep one more: fewer rows move
        room = [low + (s in extra) for s in range(shards)]
    runs, fill = [], [0] * shards
    over: dict[int, tuple[int, int]] = {}

    def place(at: int, first: int, n: int, shard: int) -> None:
        runs.append((at, first, first + n, shard, fill[shard]))
        fill[shard] += n

    for at in sorted(counts):
        shard = owners[at]
        n = min(counts[at], room[shard] - fill[shard])
        if n:
            place(at, 0, n, shard)
        if n < counts[at]:
            over[at] = (n, counts[at])
    waiting: list[list[int]] = []
    for lap in range(2):
        for at in range(len(owners)):
            if lap == 0 and at in over:
                waiting.append([at, *over[at]])
            shard = owners[at]
            while waiting and fill[shard] < room[shard]:
                run = waiting[0]
                n = min(run[2] - run[1], room[shard] - fill[shard])
                place(run[0], run[1], n, shard)
                run[1] += n
                if run[1] == run[2]:
                    waiting.pop(0)
    return runs


def ring_position(key: str, text: str = "text", positions: int = POSITIONS) -> Column:
    """Where a row falls: by its key, or by its text where the key is null."""
    return F.pmod(F.when(F.col(key).isNull(), F.xxhash64(F.lit("no key"), text)).otherwise(F.xxhash64(key)), F.lit(positions)).cast("int")


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", vnodes: int = VNODES, epsilon: float = 0.0, positions: int = POSITIONS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All columns of ``docs`` and ``shard``, ``slot`` (gapless from 0 in each shard).

    Only the counts of the ring's positions (a fixed number) reach the driver;
    a row's rank within its position picks its run. Ties of the key are ranked
    by text, fully repeated rows in any order, which changes no result row;
    rows with a null key are spread by their text, a null or empty text being
    one like others; of long texts only hashes are sorted. A position with
    over ``hot_rows`` rows, such as that of a key which very many rows have, is
    ranked in parts by the hash of the text, so that rows of one key but
    different texts do not meet in one task. Columns named ``shard`` or
    ``slot`` are replaced; an empty table gives none. ``docs`` must be a stored
    table: it is read twice, or three times.
    """
    docs = without(docs, "shard", "slot")
    p = free_prefix(docs)
    docs = docs.withColumn(f"{p}position", ring_position(key, positions=positions))
    counts = {r["at"]: r["n"] for r in docs.groupBy(F.col(f"{p}position").alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = assign(counts, ring(shards, vnodes, positions), shards, epsilon)
    names = [f"{p}{n}" for n in ("at", "first", "last", "shard", "slot")]
    places = docs.sparkSession.createDataFrame(runs or [(-1, 0, 0, 0, 0)], ", ".join(f"{n} {k}" for n, k in zip(names, ("int", "long", "long", "int", "long"), strict=True)))  # positions + shards rows at most
    at, first, last, shard_, slot = map(F.col, names)
    rank = F.col(f"{p}rank")
    within = Window.orderBy(F.xxhash64(key, F.lit(1)), key, F.xxhash64("text"))
    hot = [at for at, n in counts.items() if n > max(hot_rows, sum(counts.values()) // HOT_SHARE)]  # HOT_SHARE at most
    if hot:
        ranked = _ranked_in_parts(docs, p, hot, within)
    else:
        ranked = docs.withColumn(f"{p}rank", F.row_number().over(within.partitionBy(f"{p}position")) - 1)
    placed = ranked.join(F.broadcast(places), (F.col(f"{p}position") == at) & (rank >= first) & (rank < last))
    return placed.withColumns({"shard": shard_, "slot": slot + rank - first}).drop(f"{p}position", f"{p}rank", *names)


def _ranked_in_parts(docs: DataFrame, p: str, hot: list[int], within: WindowSpec) -> DataFrame:
    """``docs`` and the rank of each row in its position; those of ``hot`` are ranked part by part, after the rows of the parts before."""
    position, part = f"{p}position", f"{p}part"
    parted = docs.withColumn(part, F.when(F.col(position).isin(hot), F.pmod(F.xxhash64("text", F.lit(2)), F.lit(PARTS))).otherwise(F.lit(0)).cast("int"))
    sizes = parted.filter(F.col(position).isin(hot)).groupBy(F.col(position).alias("at"), F.col(part).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # HOT_SHARE * PARTS rows at most
    before, offsets = dict.fromkeys(hot, 0), []
    for r in sorted(sizes):
        offsets.append((r["at"], r["part"], before[r["at"]]))
        before[r["at"]] += r["n"]
    starts = docs.sparkSession.createDataFrame(offsets, f"{position} int, {part} int, {p}before long")
    ranked = parted.withColumn(f"{p}rank", F.row_number().over(within.partitionBy(position, part)) - 1).join(F.broadcast(starts), [position, part], "left")
    return ranked.withColumn(f"{p}rank", F.col(f"{p}rank") + F.coalesce(f"{p}before", F.lit(0))).drop(part, f"{p}before")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("text").cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.lit("").cast("binary"))).alias("text_crc32"),
    )
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
