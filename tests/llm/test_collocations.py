import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from data import DOCS, awkward, empty, frame, with_clashes, with_internal_names
from pyspark.sql import functions as F

from quillspark.llm import collocations as co


def plain(rows, most=5, least=100, top=2000, cover=100):
    """Rows of ``(lang, rank, phrase, a, l, r, n, score)`` from ``(text, lang)`` by whole counts in integers."""
    count, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, most + 1):
                count[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in count.items():
        kept = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in kept.items():
            longer = [q for q in kept if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * kept[q] >= cover * a for q in longer):
                continue
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], score))
        out += [(lang, i, s[2].decode(), s[3], s[4], s[5], n[lang], s[6]) for i, s in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def texts(seed=5, n=150):
    rng = random.Random(seed)
    words = ["sea", "Salt", "ÉTÉ", "of", "the", "a", "b c", "x"]
    made = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", "\n", ", "]) for _ in range(rng.randrange(60))) for _ in range(n)]
    return [(i, t, rng.choice(["en", "fr", None, "und"]), None, 0) for i, t in enumerate(made + made[:20])]


def mined(df, **options):
    return sorted(tuple(r) for r in co.collocations(df, **options).collect())


def test_phrases_against_whole_counts(spark):
    rows = texts()
    both = [(t, lang) for _, t, lang, _, _ in rows]
    found = mined(frame(spark, rows), least=4)
    assert found == plain(both, least=4) and len(found) > 100
    assert {r[0] for r in found} == {"en", "fr", "und"}


def test_blocks_filters_and_memory_change_nothing(spark, monkeypatch):
    rows = texts(6)
    wanted = mined(frame(spark, rows), least=5)
    assert mined(frame(spark, rows), least=5, block_words=7, memory="40MB") == wanted
    monkeypatch.setattr(co, "phrase_filter", lambda frequent, n: np.full(1 << 10, np.uint64(2**64 - 1)))  # lets all through
    assert mined(frame(spark, rows), least=5) == wanted


def test_top_cover_and_length_are_options(spark):
    rows = texts(7)
    both = [(t, lang) for _, t, lang, _, _ in rows]
    assert mined(frame(spark, rows), least=4, top=7, cover_percent=60, most_words=3) == plain(both, most=3, least=4, top=7, cover=60)


def test_awkward_documents_and_clashes(spark):
    rows = awkward()
    wanted = plain([(r[1], r[2]) for r in rows], least=9)
    assert mined(with_clashes(with_internal_names(frame(spark, rows)), "phrase", "piece", "m", "words", "f"), least=9) == wanted
    assert ("fr", "mot mot mot mot mot") in {(r[0], r[2]) for r in wanted}
    assert mined(empty(spark, DOCS)) == []
    assert mined(frame(spark, [(1, None, None, None, 0), (2, "", "en", None, 0), (3, " \t.\n", "en", None, 0)]), least=1) == []


def test_products_beyond_64_bits(spark, monkeypatch):
    """Multiplicities of ten digits: 1000 a n has over 64 bits."""
    many = 9_000_000_007
    real = co.pieces
    monkeypatch.setattr(co, "pieces", lambda df: real(df).withColumn("m", F.col("m") * many))
    rows = [(1, "red kite. red kite. red fox. blue kite", "en", None, 0)]
    by_phrase = {r[2]: r for r in mined(frame(spark, rows), least=1)}
    a, l, r, n = 2 * many, 3 * many, 3 * many, 8 * many
    assert by_phrase["red kite"][3:] == (a, l, r, n, 1000 * a * n // (l * r)) and 1000 * a * n > 2**64


def test_a_bucket_larger_than_its_memory_spills():
    rng = np.random.default_rng(3)
    phrase = [f"some phrase of words {i}" for i in rng.integers(0, 300_000, 900_000)]

    def batches():
        for at in range(0, len(phrase), 10_000):
            part = phrase[at : at + 10_000]
            yield pa.RecordBatch.from_pydict({"lang": ["en"] * len(part), "phrase": part, "h": pa.array([1] * len(part), pa.int64()), "n": pa.array([2] * len(part), pa.int64())})

    found = {p: n for b in co._count_bucket(batches(), 8, "40MB") for p, n in zip(b.column("phrase").to_pylist(), b.column("f").to_pylist(), strict=True)}
    assert found == {p: 2 * n for p, n in Counter(phrase).items() if 2 * n >= 8}
