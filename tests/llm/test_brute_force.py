"""Queries that SQL can't express, each against a plain version over its whole table."""

import math
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from data import prose
from pyspark.sql import functions as F

from quillspark.llm import common, langid, pii, registry, sharding, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\W\d_]+")  # of the given tables, which have no numbers that are word characters


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


# op1: the ring by hand, a document at a time


def plain_shards(positions, owners, shards):
    """``positions``: of each row, in order of rank. Every shard fills from its own arcs; the rest walk on clockwise."""
    total = len(positions)
    wanted = Counter(owners[p] for p, _ in positions)
    full = sorted(range(shards), key=lambda s: (-wanted[s], s))[: total % shards]
    room = {s: total // shards + (s in full) for s in range(shards)}
    load, placed, left = Counter(), {}, []
    for row in sorted(positions):
        s = owners[row[0]]
        if load[s] < room[s]:
            load[s] += 1
            placed[row] = s
        else:
            left.append(row)
    by_position = {}
    for row in left:
        by_position.setdefault(row[0], []).append(row)
    waiting = []
    for lap in range(2):
        for at in range(len(owners)):
            if lap == 0:
                waiting += by_position.get(at, [])
            s = owners[at]
            while waiting and load[s] < room[s]:
                load[s] += 1
                placed[waiting.pop(0)] = s
    return placed


def test_sharding_against_a_walk_along_the_ring(spark):
    rows = sharding.op1_sharding(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    keyed = docs.select("doc_id", sharding.ring_position("doc_id").alias("p"), F.xxhash64("doc_id", F.lit(1)).alias("h")).collect()
    rank = {}
    for r in sorted(keyed, key=lambda r: (r["p"], r["h"], r["doc_id"])):
        rank[r["doc_id"]] = (r["p"], sum(1 for p, _ in rank.values() if p == r["p"]))
    placed = plain_shards(list(rank.values()), sharding.ring(sharding.SHARDS), sharding.SHARDS)
    assert {r["doc_id"]: r["shard"] for r in rows} == {d: placed[row] for d, row in rank.items()}
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    import zlib

    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark)}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["law"] == "rows" for r in rows)


# op2: votes, label model and classifier over plain lists


def test_toxicity_against_plain_votes(spark, monkeypatch):
    seen = {}
    real = toxicity.learn_words
    monkeypatch.setattr(toxicity, "learn_words", lambda *a: seen.setdefault("learned", real(*a)))
    got = {r["doc_id"]: r["score"] for r in toxicity.op2_toxicity(spark, SF).collect()}
    learned, harmless = seen["learned"]
    lists = [set(w) - harmless for w in toxicity.LEXICONS.values()]
    half = toxicity.LEARNED_VOTERS // 2
    words = [w for w in learned if "*" not in w]
    stems = [w.rstrip("*") for w in learned if "*" in w]
    known = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = {r["doc_id"]: r["h"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", common.held_out().alias("h")).collect()}

    def row(text):
        lower = (text or "").lower()
        own = WORD.findall(lower)
        n = len(own)
        hits = [sum(w in words_ for w in own) for words_ in lists]
        hits += [len(list(p.finditer(lower))) for p in toxicity.PATTERNS.values()]
        hits += [sum(w in words[v::half] for w in own) for v in range(half)]
        for v in range(half):
            times = [sum(w.startswith(s) and len(w) > len(s) for w in own) for s in stems[v::half]]
            hits.append(sum(t for t in times if t >= max(2, toxicity.DENSE * n)))
        hits.append(int(not any(hits)))
        x = [math.log1p(100 * h / max(n, 20)) for h in hits] + [float(h > 0) for h in hits] + [math.log1p(n) / 10, len(set(own)) / max(n, 1)]
        return sum(1 << v for v, h in enumerate(hits) if h), np.array(x, dtype=np.float32).astype(float)

    rows = {r["doc_id"]: row(r["text"]) for r in documents(spark)}
    counts = {}
    for d, (votes, _) in rows.items():
        y = None if held[d] else known.get(d)
        cell = counts.setdefault(votes, [0, 0, 0])
        cell[0 if y is None else 1 + y] += 1
    model = toxicity.fit_label_model([(v, *c) for v, c in sorted(counts.items())])
    bits = lambda vs: np.array([[v >> i & 1 for i in range(len(toxicity.VOTERS))] for v in vs])
    train = [d for d in rows if not held[d]]
    w, mean, scale = toxicity.fit_linear(np.array([rows[d][1] for d in train]), model.posterior(bits([rows[d][0] for d in train])))
    for d, (_, x) in rows.items():
        assert got[d] == pytest.approx(1 / (1 + math.exp(-(w[0] + ((x - mean) / scale) @ w[1:]))), abs=1e-6)


# op7: all spans, base and added


def luhn(number):
    return sum((d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)) for i, d in enumerate(map(int, reversed(number)))) % 10 == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": all(int(p) <= 255 for p in match.split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and luhn(digits or "0"), "phone": 10 <= len(digits) <= 15}[kind]


def java_regex(pattern):
    return re.compile(pattern)


def plain_spans(text, trees, thresholds):
    base = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if plain_valid(k, m.group())]
    wide = []
    for i, k in enumerate(pii.KINDS):
        if not math.isfinite(thresholds[k]):
            continue
        need = {"email": "at", "ip": ":"}.get(k)
        if need and need not in text:
            continue
        for m in java_regex(pii.WIDE[k]).finditer(text):
            before, after, match = text[max(0, m.start() - pii.CONTEXT) : m.start()], text[m.end() : m.end() + 2], m.group()
            digits = re.sub("[^0-9]", "", match)
            n = len(digits)
            separators = set(re.findall(r"[^0-9A-Za-z()]+", match))
            x = [k == j for j in pii.KINDS] + [bool(re.search(p, before)) for p in pii._WORDS.values()]
            x += [13 <= n <= 19 and luhn(digits), 7 <= n <= 9, 10 <= n <= 11, n >= 12, "(" in match, len(separators) == 1, "." in match]
            x.append(bool(re.search(r"^(?:19|20)[0-9]{2}[-./ ][01]?[0-9][-./ ][0-3]?[0-9]|^[0-3]?[0-9][-./][01]?[0-9][-./](?:19|20)?[0-9]{2}$", match)))
            x.append(bool(re.search(r"^(?:$|[\s,;.!?)])", after)))
            score = trees.margin(tuple(map(int, x)))
            if score >= thresholds[k]:
                wide.append((score, -m.start(), m.end(), i, m.start(), k))
    overlap = lambda a, b, c, d: a < d and c < b
    wide = [c for c in wide if not any(overlap(c[4], c[2], s, e) for s, _, e, _ in base)]
    wide = [c for c in wide if not any(o > c and overlap(c[4], c[2], o[4], o[2]) for o in wide)]
    return sorted([*base, *[(c[4], c[3], c[2], c[5]) for c in wide]])


def test_all_personal_spans_against_plain_expressions(spark):
    trees, thresholds = pii.train(spark)
    made = [
        "write to jane [at] mail [dot] example.com or call (555) 123-4567, tel: 0171 555 1234.", "card 4111.1111.1111.1111 and visa: 4111 1111 1111 1111", "ip 2001:0db8:0000:0000:0000:ff00:0042:8329 up", "date 2021-03-04, order 123 456 789", "+49 (30) 123456-78 x@y.org",
    ]
    rows = [(i, t) for i, t in enumerate(made)] + [(100 + r["doc_id"], r["text"]) for r in documents(spark)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in pii.detect(df).select("doc_id", pii.joined("pii_spans").alias("s")).collect()}
    want = {d: ",".join(f"{k}:{s}:{e}" for s, _, e, k in plain_spans(t, trees, thresholds)) for d, t in rows}
    assert got == want and sum("email" in got[i] for i in range(5)) >= 2


# op10: model and predictions by plain counts


def test_language_against_plain_counts(spark):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.op10_language_id(spark, SF).collect()}
    held = {r["doc_id"]: r["h"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", common.held_out().alias("h")).collect()}
    docs = documents(spark)
    counts, grams = {}, {}
    for r in docs:
        if not held[r["doc_id"]] and r["lang"] is not None:
            counts.setdefault(r["lang"], Counter()).update(WORD.findall(r["text"].lower()))
    languages = sorted(counts)
    for lang, c in counts.items():
        grams[lang] = Counter()
        for w, n in c.items():
            for k in range(1, 5):
                for i in range(len(w) + 3 - k):
                    grams[lang][f"_{w}_"[i : i + k]] += n
    totals = np.array([sum(counts[x].values()) for x in languages], dtype=float)
    every = {w for c in counts.values() for w in c}
    every_gram = {g for c in grams.values() for g in c}
    assert len(every) <= langid.MAX_WORDS and len(every_gram) <= langid.MAX_GRAMS  # so no bound of the model cuts here

    def scores(table, key, sums):
        logs = np.log([table[x][key] + 0.5 for x in languages]) - np.log(sums + 1)
        return logs - logs.mean()

    for r in docs:
        words = Counter(WORD.findall(r["text"].lower()))
        total = np.zeros(len(languages))
        for w, n in words.items():
            if w in every:
                total += n * scores(counts, w, totals)
                continue
            for k in range(4, 0, -1):
                known = [g for g in langid.grams(w, k) if g in every_gram]
                if known:
                    total += langid.BACKOFF * n * np.mean([scores(grams, g, totals * 5) for g in known], axis=0)
                    break
        lang, score = got[r["doc_id"]]
        if not words:
            assert (lang, score) == ("und", 0.0)
        else:
            odds = np.exp(total - total.max())
            assert lang == languages[int(np.argmax(total))] and score == pytest.approx(odds.max() / odds.sum(), abs=1e-9)


# Pipeline: near-duplicates of five words and 0.8


def test_pipeline_keeps_one_document_of_each_group_of_likeness_0_8(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = common.stored(dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, sf))
    assert kept.columns == docs.columns

    def shingles(text):
        words = text.encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    holders = {}
    for d, s in sets.items():
        for x in s or {()}:
            holders.setdefault(x, []).append(d)
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    pairs = {(a, b) for ds in holders.values() if len(ds) > 1 for a in ds for b in ds if a < b}
    for a, b in pairs:
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            low, high = sorted((root(a), root(b)))
            up[high] = low
    assert {r["doc_id"] for r in kept.collect()} == {root(d) for d in sets}


def test_registered_queries_have_sql_or_a_plain_version():
    plain = {"op1_sharding", "op2_toxicity", "op4_simhash", "op5_decontamination", "op7_pii", "op8_mixing", "op9_licenses", "op10_language_id", "op12_whitening", "pipeline"}
    assert set(registry.queries()) == plain | set(registry.oracle_sql()) and prose("en", 3, 1)
