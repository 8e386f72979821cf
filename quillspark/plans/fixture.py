"""A small records table with every edge case, as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COLUMNS = ["Title", "Year", "Source title", "DOI", "Abstract", "Author Keywords", "Index Keywords", "Authors", "Author(s) ID", "Affiliations", "Cited by", "References"]
_A = "Dept X, MIT, Cambridge, United States; Univ Y, Spain"
ROWS = [
    ("Virtual Réality in  Education.", "2019", "Computers and Education", "https://doi.org/10.1/A", "A virtual reality classroom for students.", "VR; Virtual reality (VR); simulation", "Human; Humans", "García López,M.; Smith, J.A.", "57; 58", _A, "12", "Azuma, R.T., A survey, 1997; Journal of X, 2, 3"),
    ("Virtual Reality in Education", "2019", "Computers and Education", "doi: 10.1/a", None, "VR", None, "García López,M.", "57", _A, None, None),
    ("Virtual reality in education", "2019", " Computers and Education ", None, "vr", "VR", None, "García López,M.", "57", None, "3", None),
    ("Augmented reality surgery training", "2020.0", "Surgery", "10.2/b", "augmented reality for surgical planning and machine learning training data", "AR", "Female", "Müller, K.", None, "University Hospital, Heidelberg, Germany", "n/a", "Milgram, P., Kishino, F., A taxonomy, 1994"),
    ("Mixed reality and extended reality", "2021", "XR Journal", "10.3/c", "HoloLens hardware tracking latency", "mixed reality", None, "Lee, S.", None, "KAIST, Daejeon, Republic of Korea; ,; The University of Hong Kong Faculty of Medicine, Hong Kong", "5", None),
    ("Extended reality with virtual reality", "2021", "XR Journal", None, "an xr course for learners", "xr; learning system", None, "Lee, S.", None, "; Univ Z, France", "0", None),
    ("Virtual reality and augmented reality together", "2018", "Surgery", "10.4/d", "rehabilitation therapy in schools", "virtual reality; augmented reality; student", "Humans", "O'Neil, P.J.", "60", "UCLA, Los Angeles, USA; Charité, Berlin, Germany", "40", "Slater, M., Presence, 1999; Slater, M., Place illusion, 2009"),
    ("Multi-agent negotiation protocol", "2017", "Agents", "10.5/e", "auction mechanism", None, None, "Doe, J.", None, "Nowhere", "1", None),
    ("A VR, headset", "in press", "Computers and Education", None, "oculus", "head-mounted display", None, "Roe, R.", None, "Copenhagen, Denmark", "2", None),
    ("An immersive environment", "1985", "Old", "10.6/f", "stereoscopic cave teaching", None, None, "Old, O.", None, "Harvard Medical School, Boston, United States", "9", None),
    (None, "2010", "Untitled", None, "virtual reality", None, None, None, None, "nan", None, None),
    ("   ", "2011", "Blank", None, "virtual reality", None, None, "", "", ", ,", "", None),
    ("Coeducation and re-education", "2012", "Words", None, "virtual world", None, None, "Wu, X.", None, "College of Nursing, Lyon, France", "7", "Wu, X., Y., Z"),
    ("Coeducation and re-education", "2012", "Words", None, "virtual world", None, None, "Wu, X.", None, "College of Nursing, Lyon, France", "7", "Wu, X., Y., Z"),
    ("Deep learning with training sets", "2022", "ML", "10.7/g", "virtual environment; machine learning training", "training", None, "Kim, D.-H.", None, "Seoul National University, Seoul, korea, republic of; Institute of Y, viet nam", "4", "Ng, A., Machine learning, 2010"),
]


def records(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "_row_id long, " + ", ".join(f"`{c}` string" for c in COLUMNS))


def _literal(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


RECORD_NAMES = [c.lower().replace("(s)", "").replace(" ", "_").replace("references", "cited_works") for c in COLUMNS]
RECORDS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), {', '.join(map(_literal, r))})" for i, r in enumerate(ROWS)) + f") v(row_id, {', '.join(RECORD_NAMES)})"
