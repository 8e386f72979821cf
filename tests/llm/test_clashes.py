"""Columns of a table whose names are also an operator's own ones."""

import pytest
from data import empty, frame, internal_names_kept, prose, with_internal_names

from quillspark.llm import common, decontaminate, langid, licenses, merkle, mixing, neardup, pii, sharding, simhash, toxicity, urlfilter

ROWS = [(i, prose("en", 20 + i, i), "en", f"s{i % 3}", 0) for i in range(12)] + [(3, prose("en", 23, 3), "en", "s0", 0), (None, None, None, None, None), (20, "", "en", "s1", 0)]


def one_key(spark):
    return spark.createDataFrame([(1, prose("en", 30, 777))], "item_id long, text string")


KEEPING = {
    "sharding": lambda df: sharding.shard(df, 5),
    "fingerprints": merkle.fingerprint,
    "near-dedup": neardup.drop_near_duplicates,
    "simhash": simhash.drop_near_duplicates,
    "pii": pii.redact,
    "mix": mixing.mix,
    "sample": mixing.sample,
    "licenses": licenses.scan,
    "language": lambda df: langid.identify(df, langid.train(df)),
    "identified": langid.keep_identified,
    "decontamination": lambda df: decontaminate.drop_contaminated(df, one_key(df.sparkSession)),
}


@pytest.mark.parametrize("name", sorted(KEEPING))
def test_internal_names_of_a_table_are_kept(spark, name):
    df = with_internal_names(frame(spark, ROWS))
    rows = KEEPING[name](df).collect()
    assert rows and internal_names_kept(rows, "doc_id")
    if name not in ("near-dedup", "simhash", "sample", "identified"):
        assert len(rows) == len(ROWS)


def test_urls(spark):
    df = with_internal_names(spark.createDataFrame([(1, "http://a.example.com/en/x"), (2, None), (2, None)], "page_id long, url string"))
    rows = urlfilter.judge(df, spark.createDataFrame(list(urlfilter.RULES), "host string, path string, verdict string")).collect()
    assert len(rows) == 3 and internal_names_kept(rows, "page_id") and sorted(r["verdict"] for r in rows) == ["allow", "allow", "block"]


def test_scores(spark):
    df = with_internal_names(frame(spark, ROWS))
    assert toxicity.score_documents(df, empty(spark, "doc_id long, toxic int"), ~common.held_out()).count() == len(ROWS)
