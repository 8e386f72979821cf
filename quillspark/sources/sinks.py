"""Writing results: Parquet for corpora, one CSV or Markdown file for small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows that a Markdown table may have.
MAX_MARKDOWN_ROWS = 10_000


def write_corpus(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """A small result as one CSV part with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def markdown(df: DataFrame) -> str:
    rows = df.limit(MAX_MARKDOWN_ROWS + 1).collect()
    if len(rows) > MAX_MARKDOWN_ROWS:
        raise ValueError(f"more than {MAX_MARKDOWN_ROWS} rows: not a report table")
    text = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(text(v) for v in r) + " |" for r in rows]) + "\n"


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file, on whatever file system the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
