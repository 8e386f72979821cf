import hashlib
import random

from data import empty, frame, with_clashes
from pyspark.sql import functions as F

from quillspark.llm import merkle


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_root(text):
    import re

    return sha("".join(sha("".join(sha(p) for p in s.split("\n"))) for s in re.split(r"\n[ \t]*\n", text)))


def test_awkward_documents(spark):
    df = with_clashes(frame(spark), "fingerprint", "n_chars", "near_next", "sections")
    rows = merkle.fingerprint(df).collect()
    order = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, (r["text"] or "").encode(), r["text"] or "") for r in df.collect()))
    want = []
    for i, (_, d, _, text) in enumerate(order):
        nxt = order[(i + 1) % len(order)][3]
        tail = len(text) // 4
        edited = text[: len(text) - tail] + nxt[:tail]
        want.append((len(text), plain_root(text), edited, plain_root(edited)))
    got = [(r["n_chars"], r["fingerprint"], r["edited_text"], r["edited_fingerprint"]) for r in rows]
    assert sorted(got) == sorted(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)


def test_next_over_many_ranges(spark):
    ids = random.Random(2).sample(range(10**12), 500)
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r["next_text"] for r in merkle.with_next(df, "doc_id", rows_a_bucket=5).collect()}
    ordered = sorted(ids)
    assert got == {a: str(b) for a, b in zip(ordered, ordered[1:] + ordered[:1], strict=True)}


def test_likeness_tells_edits_from_strangers(spark):
    rng = random.Random(8)
    sentence = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(8)) + ". "
    df = spark.createDataFrame([(i, "\n".join(sentence() * 2 for _ in range(6))) for i in range(40)], "doc_id long, text string")
    rows = merkle.fingerprint(df).collect()
    assert min(r["near_edited"] for r in rows) > 0.6 and max(r["near_next"] for r in rows) < 0.2


def test_differing_branches_locate_edits(spark):
    a, b = "one\ntwo\n\nthree\nfour\n\nfive", "one\ntwo\n\nthree\nFOUR\n\nfive\nsix"
    df = spark.createDataFrame([(a, b), (a, a), (a, "")], "a string, b string").select(merkle.tree(F.col("a")).alias("a"), merkle.tree(F.col("b")).alias("b"))
    got = [[tuple(x) for x in r[0]] for r in df.select(merkle.differing_paragraphs(F.col("a"), F.col("b"))).collect()]
    assert got[0] == [(1, 1), (2, 1)] and got[1] == [] and (0, 1) in got[2] and (2, 0) in got[2]


def test_empty_and_single(spark):
    assert merkle.fingerprint(empty(spark)).count() == 0
    row = merkle.fingerprint(frame(spark, [(1, None, None, None, None)])).first()
    assert row["fingerprint"] == plain_root("") and row["near_next"] == 1.0 and row["n_chars"] == 0


def test_next_by_keys_of_any_ordered_type(spark):
    rng = random.Random(6)
    ids = ["".join(rng.choice('abc\\"é,[]') for _ in range(6)) + str(i) for i in range(300)]
    df = spark.createDataFrame([(i, f"text of {i}") for i in ids], "doc_id string, text string").repartition(5)
    ordered = sorted(ids, key=lambda s: s.encode())
    for rows_a_bucket in (5, 2000):
        got = {r["doc_id"]: r["next_text"] for r in merkle.with_next(df, "doc_id", rows_a_bucket).collect()}
        assert got == {a: f"text of {b}" for a, b in zip(ordered, ordered[1:] + ordered[:1], strict=True)}
    assert merkle.fingerprint(df).count() == 300
    dated = df.select(F.expr("date_add(DATE '2020-01-01', cast(xxhash64(doc_id) % 5000 as int))").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    rows = sorted((r["doc_id"], r["text"]) for r in dated.collect())
    got = {r["doc_id"]: r["next_text"] for r in merkle.with_next(dated, "doc_id", 5).collect()}
    assert got == {a[0]: b[1] for a, b in zip(rows, rows[1:] + rows[:1], strict=True)}
