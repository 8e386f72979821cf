"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch may hold: bounds the memory of a Python worker when texts are long.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; under a local master, as in tests, a local one where it is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage and survives lost executors. ``discard`` frees it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = _folder(spark, path)
    folder[0].deleteOnExit(folder[1])
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _folder(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def discard(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    for df in tables:
        files, at = _folder(df.sparkSession, df._stored_at)
        files.delete(at, True)


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose ``work`` sees slices of at most ``ARROW_ROWS`` rows; Spark bounds the bytes of the batches that it sends."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(batch.slice(at, ARROW_ROWS) for batch in batches for at in range(0, batch.num_rows, ARROW_ROWS))

    return df.mapInArrow(sliced, schema)


def free_prefix(*tables: DataFrame) -> str:
    """Underscores that begin no column name of the tables: temporary columns named by it clash with none."""
    prefix = "_"
    while any(c.startswith(prefix) for df in tables for c in df.columns):
        prefix += "_"
    return prefix


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id as text leaves no remainder by 5; a null id counts as the empty text, whose crc32 is 0."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns whose names (in any case) the operator is about to give."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def hashed_sample(df: DataFrame, key: str, size: int, salt: int = 17) -> DataFrame:
    """``size`` rows at most, those with the least hash of ``key``.

    A threshold on the hash, from the row count, leaves about 1.3 times as
    many rows before the exact limit, so that no task hands on ``size`` rows.
    """
    n = df.count()
    rank = F.xxhash64(key, F.lit(salt))
    if n > 1.3 * size:
        df = df.filter(F.pmod(rank, F.lit(1 << 30)) < int(1.3 * size / n * (1 << 30)) + 1)
    return df.orderBy(F.pmod(rank, F.lit(1 << 30)), key).limit(size)


def most_frequent(counts: DataFrame, size: int, key: str = "word", count: str = "n") -> DataFrame:
    """The rows with the highest counts, ``size`` at most: all counts from an eighth of a power of two on that leaves no more.

    The histogram of those steps, a few hundred rows, sets the least step, so
    no task hands on more rows than are wanted; where the top step alone is
    too large, those of it with the least hash are taken.
    """
    step = F.floor(F.log2(count) * 8).cast("int")
    histogram = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("step")).collect()
    least, total = None, 0
    for r in histogram:
        if total + r["rows"] > size:
            break
        least, total = r["step"], total + r["rows"]
    if least is None:
        return hashed_sample(counts.filter(step == histogram[0]["step"]), key, size) if histogram else counts.limit(0)
    return counts.filter(step >= least)
