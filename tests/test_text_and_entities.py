import unicodedata

import duckdb
from helpers import SF
from pyspark.sql import functions as F

from quillspark.functions import entities, lexicon as lx, text as tx
from quillspark.operators import classify
from quillspark.plans import export


def values(spark, builder, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r["o"] for r in df.select("i", builder("v").alias("o")).orderBy("i").collect()]


def test_strip_knows_all_white_space(spark):
    assert values(spark, tx.strip, ["  a b\t\n", "", None]) == ["a b", "", None]


def test_accents_by_character_database(spark):
    samples = ["éÅøñß", "é", "Ǖ Ệ", "plain"]
    want = ["".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn") for s in samples]
    assert values(spark, tx.strip_accents, samples) == want


def test_title_and_doi_keys(spark):
    assert values(spark, tx.title_key, ["Virtual Réality in  Education.", None]) == ["virtual reality in education", None]
    assert values(spark, tx.doi_key, ["https://dx.doi.org/10.1/A", "doi: 10.1/a", None]) == ["10.1/a", "10.1/a", ""]


def test_numbers(spark):
    assert values(spark, tx.number, ["2019.0", " 7 ", "in press", None]) == [2019.0, 7.0, None, None]


def test_padded_terms_need_blanks(spark):
    df = spark.createDataFrame([("a VR, headset",), ("a vr headset",), (None,)], "t string").select(tx.joined_lower(["t"], padded=True).alias("t"))
    assert [r[0] for r in df.select(tx.any_term("t", [" vr "])).collect()] == [False, True, False]


def test_technology_priority(spark):
    cases = {" mixed reality extended reality ": "MR", " extended reality virtual reality ": "XR", " virtual reality augmented reality ": "Hybrid/Multi-technology", " google glass ": "AR", " oculus ": "VR", " multi-agent ": None}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert [r[0] for r in df.select(classify.technology(F.col("t"))).collect()] == list(cases.values())


def test_screen_safeguard(spark):
    df = spark.createDataFrame([("machine learning training",), ("machine learning training of a student",), ("training",), ("coeducation",), ("re-education",)], "Title string")
    got = [r["Has_Education_Cue"] for r in classify.screened(df, ["Title"]).collect()]
    assert got == [False, True, True, False, True]


def test_countries(spark):
    assert values(spark, entities.countries, ["A, United States; B, Spain; C, us", "; ,; D, deaf/hh", None, "nan"]) == [["Spain", "USA"], ["Deaf/hh"], [], []]
    assert values(spark, entities.leading_country, ["; D, France", "A, republic of korea"]) == [None, "South Korea"]


def test_institutions(spark):
    got = values(spark, entities.institutions, ["Dept, MIT, Cambridge", "Smith Lab, København", "School of X, Uni of Y, Universidad de Lima School of Arts", "College of Nursing, Lyon", "Trinity College, Dublin", "University, Hospital Z", "nan"])
    assert got == [["Massachusetts Institute of Technology (MIT)"], [], ["Universidad de Lima"], [], ["Trinity College"], ["Hospital Z"], []]


def test_affiliation_chain(spark):
    assert values(spark, entities.standard_affiliations, ["MIT, USA", "Smithsonian", "ETH Zurich"]) == ["Massachusetts Institute of Technology, USA", "Smithsonian", "ETH Zürich"]


def test_authors(spark):
    assert values(spark, entities.standard_authors, ["García López,M.J.;  Smith, J.", None]) == ["Garcia Lopez, M. J.; Smith, J.", None]
    assert values(spark, entities.author_names, ["Smith, John (57); Lee, S"]) == [["Smith, John", "Lee, S"]]


def test_cited_authors(spark):
    assert values(spark, entities.cited_author, ["Azuma, R.T., A survey, 1997", "Journal of X, 2", "journal, a, b", "Ng, A B C D E F, x", "O'Neil, P., y"]) == ["Azuma, R.T.", None, None, None, "O'Neil, P."]


def test_keyword_length_cut_and_map(spark):
    assert values(spark, entities.keywords, ["VR; Simulation ;a b"]) == [["simulation", "a b"]]
    df = spark.createDataFrame([(["student", "students", "x"],)], "k array<string>")
    assert df.select(entities.mapped_keywords("k")).first()[0] == ["students", "x"]


def test_fixed_lists_have_their_sizes():
    assert [len(x) for x in (lx.VR_TERMS, lx.AR_TERMS, lx.MR_TERMS, lx.XR_TERMS, lx.TECHNICAL_TERMS, lx.PEDAGOGICAL_TERMS, lx.THEMATIC_TERMS)] == [19, 12, 6, 2, 25, 29, 16]
    assert (len(lx.EDUCATION_PATTERNS), len(lx.CLINICAL_PATTERNS), len(lx.NOT_AUTHORS)) == (28, 11, 23)


def test_a_capital_is_one_letter(spark):
    df = spark.createDataFrame([(c,) for c in ("ßa", "ŉ", "ᾀ", "éa", "x", "", None)], "s string")
    assert [r["c"] for r in df.select(tx.capital("s").alias("c")).collect()] == ["ẞ", "ŉ", "ᾈ", "É", "X", "", None]
    work = spark.createDataFrame([("Groß, ßa, T, 1999",)], "r string")
    assert work.select(entities.cited_authors("r").alias("a")).first()["a"] == ["Groß, ẞ."]


def test_export_of_a_sharp_s_matches_sql(spark, tmp_path):
    """Names and cited works whose initials are letters of which Java's upper case makes two."""
    rows = [(1, "der ßig ßa ŉun ße ßo die ßu", 27), (2, "a b ßc", 6), (3, None, 0), (5, "x  ßy", 5)]
    copy = str(tmp_path)
    for name in ("customer", "part", "supplier", "nation"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{copy}/{name}.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{copy}/documents.parquet")
    con = duckdb.connect()
    for name in ("customer", "part", "supplier", "nation", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{copy}/{name}.parquet/*.parquet'")
    want = sorted(map(repr, con.execute(export.EXPORT_SQL).fetchall()))
    assert sorted(repr(tuple(r)) for r in export.records(spark, copy).collect()) == want
