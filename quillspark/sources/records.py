"""Reading delimited record exports into all-string tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lx
from quillspark.functions.text import strip

#: Other headers under which exports give the same column, first the most usual.
# The column that fills a field depends on each entry and on the order given.
COLUMN_ALIASES = {
    "Title": ["document title", "article title", "paper title", "ti"],
    "Abstract": ["summary", "description", "ab"],
    "Author Keywords": ["author keyword", "keywords", "keywords (author)", "de"],
    "Index Keywords": ["index keyword", "keywords plus", "id"],
    "Year": ["publication year", "pub year", "py", "date"],
    "DOI": ["digital object identifier"],
    "Affiliations": ["affiliation", "author affiliations", "c1"],
    "Authors": ["author", "creator", "au"],
    "Source title": ["journal", "journal title", "publication name", "so"],
    "Cited by": ["citations", "times cited", "tc"],
}


def clean_header(df: DataFrame) -> DataFrame:
    """Column names without white space and byte order mark."""
    return df.toDF(*[c.replace("\ufeff", "").strip() for c in df.columns])


def missing_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.col(f"`{c}`").isin(lx.MISSING), F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_records(spark: SparkSession, path: str, row: str | None = "_row_id") -> DataFrame:
    """An all-string table from CSV with a header, quoted line breaks and doubled quotes; ``row`` numbers rows in file order."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False, encoding="UTF-8")
    df = missing_to_null(clean_header(raw))
    return df if row is None else df.withColumn(row, F.monotonically_increasing_id())


def canonical_columns(df: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Canonical columns filled, where blank or absent, from columns of other names in any case."""
    aliases = COLUMN_ALIASES if aliases is None else aliases
    by_lower = {c.lower(): c for c in df.columns}
    for name, others in aliases.items():
        found = [by_lower[o.lower()] for o in (name, *others) if o.lower() in by_lower]
        if found:
            value = F.coalesce(*[F.when(strip(F.col(f"`{c}`").cast("string")) != "", F.col(f"`{c}`").cast("string")) for c in dict.fromkeys(found)])
            own = by_lower.get(name.lower())
            if own is not None and own != name:
                df = df.withColumnRenamed(own, name)
                value = F.coalesce(*[F.when(strip(F.col(f"`{name if c == own else c}`").cast("string")) != "", F.col(f"`{name if c == own else c}`").cast("string")) for c in dict.fromkeys(found)])
            df = df.withColumn(name, value)
    return df
