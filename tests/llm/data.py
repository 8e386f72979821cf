"""Documents with every awkward case, shared by the operators' tests."""

import random

from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the and of to was river house morning paper stone walk green table".split(), "fr": "le la de et une rivière maison matin papier pierre vert livre".split()}


def prose(lang, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)) + "."


def awkward():
    rows = [(i, prose("en" if i % 3 else "fr", 30 + i % 17, i), "en" if i % 3 else "fr", f"src{i % 4}", 0) for i in range(60)]
    rows += [
        (100, None, "en", "src0", None),
        (101, "", "en", None, 0),
        (102, " \n\t ", None, "src1", 3),
        (103, "12 34 !!", "en", "src1", 8),
        (104, "mot " * 60_000, "fr", "src2", 240_000),
        (105, "x" * 200_000, "en", "src2", 200_000),
        (None, "a row without an id", "en", "src3", 19),
        (None, None, None, None, None),
        (106, "A stone.\n\nÜber 😀 den Fluss\n\x01\x02", "en", "src3", 30),
    ]
    return rows + [rows[5], rows[5], (107, rows[6][1], "fr", "src0", 0), (108, rows[6][1].upper(), "fr", "src0", 0)]


def frame(spark, rows=None, schema=DOCS):
    return spark.createDataFrame(awkward() if rows is None else rows, schema)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], T._parse_datatype_string(schema))


def with_clashes(df, *names):
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("clash") for n in (*names, "id", "key", "value", "h", "n", "word", "a", "b", "rank")})


#: Names that the operators use, or have used, for columns of their own.
INTERNAL = (
    "_id", "_th", "_n", "_hash", "_bucket", "_before", "_first", "_last", "_v", "_own", "_edit", "_next", "_clean", "_wide", "_best", "_verdict", "_h", "_maybe", "_hits", "_position", "_rank", "_at", "_shard", "_slot",
    "_source", "_lang", "_topic", "_draw", "_host", "_path", "_p", "__draw", "_0", "_1", "hits", "rule_host", "rule_path", "labels", "maybe", "draw", "kept_", "fp", "sid", "bits", "bands", "root", "votes", "x",
)


def with_internal_names(df):
    """``df`` with a column of each internal name, which must come back as it is."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.concat(F.lit(f"{n}:"), F.coalesce(F.col(df.columns[0]).cast("string"), F.lit("none"))) for n in INTERNAL})


def internal_names_kept(rows, key):
    return all(r[n] == f"{n}:{'none' if r[key] is None else r[key]}" for r in rows for n in INTERNAL)
