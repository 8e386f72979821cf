import re

import pytest
from data import empty, frame, with_clashes
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum((x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain(text):
    out = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), n, m.end(), kind))
    return sorted(out)


def base_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [[(s["start"], s["kind_no"], s["end"], s["kind"]) for s in r["base_spans"]] for r in pii.detect(df).orderBy("i").collect()]


CASES = [
    "mail a.b+c@x-y.example.com, a@b.c%d@e.f a@b..c @x.y", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.004 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111 11111111",
    "+1 (974) 555-3436 +12 34 +1...........................2 call +49 30 1234567890123456", "é😀 x@y.zz 😀 9915762804490", "5 - 6 12 4845168114407329.", "\x01\x02a@b.cc\x03", "", None, "4" * 16 + "0" * 5,
]


def test_base_spans(spark):
    assert base_of(spark, CASES) == [plain(t) for t in CASES]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="0123456789 -.+@()ab%\n", max_size=80), min_size=20, max_size=40))
def test_base_spans_of_random_texts(spark, texts):
    assert base_of(spark, texts) == [plain(t) for t in texts]


def test_long_runs_are_linear(spark):
    assert base_of(spark, ["a" * 300_000, "1" * 300_000, "1 " * 150_000, "+1" * 50_000]) == [[], [], [], []]


def test_method_adds_spans_and_keeps_base_ones(spark):
    texts = ["write to john [at] example [dot] com please", "call (415) 555-2671 now", "tel: 030 123 4567 now", "on 2024-01-15 10 20 30", "version 12 34 56 78", "order 1234 5678 9012 3456", "x@y.zz and (415) 555-2671", CASES[2]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = pii.detect(df).orderBy("i").collect()
    kinds = [[s["kind"] for s in r["pii_spans"]] for r in rows]
    assert kinds[:2] == [["email"], ["phone"]] and kinds[3:6] == [[], [], []] and kinds[6] == ["email", "phone"]
    assert all({tuple(s) for s in r["base_spans"]} <= {tuple(s) for s in r["pii_spans"]} for r in rows)
    assert pii.redact(df).orderBy("i").collect()[6]["redacted"] == "[email] and [phone]"


def test_trees_on_rows_made_with_another_seed(spark):
    trees, thresholds = pii.train(spark)
    df = spark.createDataFrame(pii.training_rows(300, seed=99), "kind string, match string, before string, after string, label int")
    from pyspark.sql import functions as F

    cols = [F.coalesce(f, F.lit(False)) for f in pii.features(*[F.col(c) for c in ("kind", "match", "before", "after")])]
    got = df.select("kind", "label", trees.column(cols).alias("m"), *[c.cast("int").alias(f"f{i}") for i, c in enumerate(cols)]).collect()
    assert all(r["m"] == pytest.approx(trees.margin(tuple(r[3:]))) for r in got)
    chosen = [r["label"] for r in got if r["m"] >= thresholds[r["kind"]]]
    assert sum(chosen) / len(chosen) > 0.95 and sum(chosen) > 0.6 * sum(r["label"] for r in got)


def test_awkward_documents(spark):
    df = with_clashes(frame(spark), "base_spans", "pii_spans")
    assert pii.detect(df).count() == df.count()
    assert pii.detect(empty(spark)).count() == 0


def test_many_spans_in_one_text(spark):
    n = 3000
    text = " ".join(f"é user{i}@mail{i}.com tel: (0{i % 90 + 10}) 555-{i % 9000 + 1000}" for i in range(n))
    row = pii.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    emails = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert [(s["start"], s["end"]) for s in row["base_spans"] if s["kind"] == "email"] == emails and len(emails) == n
    phones = [text[s["start"] : s["end"]] for s in row["pii_spans"] if s["kind"] == "phone"]
    assert len(phones) == n and all(p.startswith("(0") for p in phones)
