"""A record export derived from the given tables: one record for each document, with authors, addresses and keywords from the others.

The columns below are written once for Spark and the SQL oracle, so both see
the same export; picking, splitting and upper case are each dialect's own. What
a record says follows from its text's length, so copies of a text are copies of
a record but for the spelling of their DOI.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lx
from quillspark.operators import graph
from quillspark.plans.fixture import COLUMNS
from quillspark.session import table

#: Phrases that records are given, so that every list, pattern and safeguard has matches and near misses.
PHRASES = [
    *dict.fromkeys(t.strip() for t in [*lx.THEMATIC_TERMS, *lx.VR_TERMS, *lx.AR_TERMS, *lx.MR_TERMS, *lx.XR_TERMS]),
    "multi-agent systems", "auction mechanism", "quest 3", "haptic tracking", "point cloud", "students", "teachers in schools", "medical education", "classroom feedback", "skills acquisition", "training",
    "training data", "deep learning", "machine learning", "train the model", "rehabilitation", "surgical planning", "patient outcomes", "coeducation", "re-education", "a questionnaire", "an effect size", "a neural network",
]
KEYWORDS = [*lx.KEYWORD_MAP, "students", "Human", "VR", "e-Learning", "ab", "Head-Mounted  Display"]
PLACES = [
    "MIT, Cambridge", "Dept Computing, UCLA, Los Angeles", "Harvard Medical School, Boston", "Univ Leeds, Leeds", "University of Toronto Faculty of Medicine, Toronto", "Charité, Berlin", "Copenhagen, Rigshospitalet",
    "College of Nursing, Lyon", "Department of Surgery, University Hospital, Heidelberg", "The University of Hong Kong Faculty of Medicine", "Institute of Optics", "Saint Mary College, Bath", "Nowhere", "", "nan", "Stanford Univ, Palo Alto",
    "University College London School of Art, London", "Nanyang Polytechnic, Unit 7", "TUM, Munich", "National, School",
]
COUNTRIES = [
    "United States", "Viet Nam", "Korea", "republic of korea", "Spain", "FRANCE", "Germany.", "nan", "UK", "Great Britain", "Russian Federation", "italy", "Hong Kong", "n/a", "Australia",
    "Brazil", "P.R. China", "Taiwan", "Macao", "Canada 2", "Denmark", "", "Japan", "us", "New Zealand",
]


@dataclass(frozen=True)
class Dialect:
    """What Spark and the SQL oracle write differently: the value at a number's remainder, a word of the text, upper case of one character, a pattern that replaces all its matches."""

    pick: Callable[[str, list[str]], str]
    part: Callable[[int], str]
    upper: Callable[[str], str]
    every: str


SQL = Dialect(
    pick=lambda number, values: f"CASE ({number}) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END",
    part=lambda n: f"split_part(coalesce(text, ''), ' ', {n})",
    upper=lambda c: f"upper({c})",
    every=", 'g'",
)
#: A constant array for each list and one split of a text's beginning; ``upper`` would make two letters of these two.
SPARK = Dialect(
    pick=lambda number, values: f"get(array({', '.join(f"'{v}'" for v in values)}), cast(({number}) % {len(values)} AS int))",
    part=lambda n: f"coalesce(get(words, {n - 1}), '')",
    upper=lambda c: f"CASE {c} WHEN 'ß' THEN 'ẞ' WHEN 'ŉ' THEN 'ŉ' ELSE upper({c}) END",
    every="",
)
#: Words of a text that records are made of.
WORDS = 8
#: Files that the export has for each core.
PARTS_A_CORE = 3


def _columns(dialect: Dialect) -> list[str]:
    _pick = dialect.pick
    w = {n: f"regexp_replace({dialect.part(n)}, '[^A-Za-zÀ-ÖØ-öø-ž]', ''{dialect.every})" for n in range(1, WORDS + 1)}
    initial = lambda n: dialect.upper(f"substring({w[n]}, 1, 1)")
    place = lambda n: f"concat({_pick(f'q * {n} + {n}', PLACES)}, ', ', {_pick(f'nation{1 + n % 2}', COUNTRIES)})"
    return [
        "d AS row_id",
        f"CASE WHEN q % 53 = 0 THEN NULL WHEN q % 59 = 0 THEN '   ' ELSE concat(substring(coalesce(text, ''), 1, 40), ' ', {_pick('q * 31 + 7', PHRASES)}, CASE WHEN d % 3 = 0 THEN '.' ELSE '' END) END AS title",
        "CASE q % 11 WHEN 0 THEN 'in press' WHEN 1 THEN concat(cast(1980 + q % 20 AS string), '.0') WHEN 2 THEN NULL ELSE cast(1984 + q % 45 AS string) END AS year",
        "CASE WHEN q % 31 = 0 THEN NULL WHEN q % 37 = 0 THEN ' ' ELSE concat(p_brand, ' ', p_type) END AS source_title",
        "CASE WHEN q % 4 = 0 THEN NULL WHEN d % 4 = 0 THEN concat('https://doi.org/10.1/', cast(q AS string), 'A') WHEN d % 4 = 1 THEN concat('doi: 10.1/', cast(q AS string), 'a') WHEN d % 4 = 2 THEN concat('10.1/', cast(q AS string), 'a') ELSE concat('10.2/', cast(d AS string)) END AS doi",
        f"CASE WHEN q % 17 = 0 THEN NULL ELSE concat(text, ' ', {_pick('q * 17 + 3', PHRASES)}, ' ', {_pick('q * 5 + 1', PHRASES)}) END AS abstract",
        f"CASE WHEN q % 13 = 0 THEN NULL ELSE concat({_pick('q', KEYWORDS)}, '; ', p_name, ';;', {_pick('q * 3 + 1', KEYWORDS)}, CASE WHEN q % 2 = 0 THEN '; training' ELSE '' END) END AS author_keywords",
        f"CASE WHEN q % 3 = 0 THEN NULL ELSE concat(p_type, '; ', {_pick('q + 2', KEYWORDS)}, '; ', {_pick('q * 7 + 2', PHRASES)}) END AS index_keywords",
        f"CASE WHEN q % 41 = 0 THEN NULL WHEN q % 43 = 0 THEN ' ; ' ELSE concat({w[1]}, '  ', {w[2]}, ',', {initial(3)}, '.', {initial(4)}, '.; ', {w[5]}, ', ', {initial(6)}, '. (', c_name, ');') END AS authors",
        "CASE WHEN q % 5 > 1 THEN NULL ELSE concat(' ', cast(c_custkey AS string), '; 7') END AS author_id",
        f"CASE WHEN q % 19 = 0 THEN NULL ELSE concat({place(3)}, CASE WHEN q % 2 = 0 THEN concat('; ', {place(8)}) ELSE '' END, CASE WHEN q % 6 = 0 THEN concat(';;', {place(5)}) ELSE '' END) END AS affiliations",
        "CASE q % 7 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' ELSE cast(q % 50 AS string) END AS cited_by",
        f"CASE WHEN q % 9 = 0 THEN NULL ELSE concat({w[2]}, ', ', {initial(1)}, '.', {initial(7)}, '., A study, 1999; ; Journal of X, 2, 3; ', {w[8]}, ', ', {w[4]}, ', Work, 2001; ', {w[8]}, ', ', {w[4]}, ', Other, 2002') END AS cited_works",
    ]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``_row_id`` and the export's twelve columns, all strings but the number of the row; written to the shared folder, as exports are files."""
    docs, customer, part, supplier = (table(spark, sf_dir, name) for name in ("documents", "customer", "part", "supplier"))
    orgs = supplier.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    sizes = customer.agg(F.count(F.lit(1)).alias("customers")).crossJoin(part.agg(F.count(F.lit(1)).alias("parts"))).crossJoin(supplier.agg(F.count(F.lit(1)).alias("suppliers")))
    # all but the text follows from its length: texts are joined with one small row for each length that there is
    lengths = docs.select(F.col("n_chars").alias("q")).distinct().crossJoin(F.broadcast(sizes))  # one row
    joined = (
        lengths.join(customer.select("c_custkey", "c_name"), F.col("c_custkey") == F.col("q") % F.col("customers"), "left")
        .join(part.select("p_partkey", "p_name", "p_brand", "p_type"), F.col("p_partkey") == F.col("q") % F.col("parts"), "left")
        .join(orgs.select(F.col("s_suppkey").alias("s1"), F.col("n_nationkey").alias("nation1")), F.col("s1") == F.col("q") % F.col("suppliers"), "left")
        .join(orgs.select(F.col("s_suppkey").alias("s2"), F.col("n_nationkey").alias("nation2")), F.col("s2") == F.col("q") * 7 % F.col("suppliers"), "left")
    )
    path = graph.shared_path(spark)
    known = graph.checkpointed(joined.drop("customers", "parts", "suppliers", "p_partkey", "s1", "s2").filter("q is not null").withColumnRenamed("q", "q_"))
    # a row group is read by one task, whatever its size: rows are dealt out, so that all cores make and read the export
    dealt = docs.select("doc_id", "n_chars", "text").repartition(PARTS_A_CORE * spark.sparkContext.defaultParallelism, "doc_id", "n_chars")
    keyed = dealt.select(F.col("doc_id").alias("d"), F.col("n_chars").alias("q"), "text", F.split("text", " ", WORDS + 1).alias("words"))
    keyed.join(known, F.col("q") == F.col("q_"), "left").selectExpr(*_columns(SPARK)).toDF("_row_id", *COLUMNS).write.parquet(path)
    return spark.read.parquet(path)


EXPORT_SQL = f"""SELECT {', '.join(_columns(SQL))} FROM (SELECT doc_id AS d, n_chars AS q, text FROM documents) k
LEFT JOIN customer ON c_custkey = q % (SELECT count(*) FROM customer) LEFT JOIN part ON p_partkey = q % (SELECT count(*) FROM part)
LEFT JOIN (SELECT s_suppkey AS s1, n_nationkey AS nation1 FROM supplier JOIN nation ON s_nationkey = n_nationkey) x ON s1 = q % (SELECT count(*) FROM supplier)
LEFT JOIN (SELECT s_suppkey AS s2, n_nationkey AS nation2 FROM supplier JOIN nation ON s_nationkey = n_nationkey) y ON s2 = q * 7 % (SELECT count(*) FROM supplier)"""
