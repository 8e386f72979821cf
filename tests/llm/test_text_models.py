"""Toxicity, language identification, decontamination, licenses and the pipeline."""

import itertools
import random

import corpus_pipeline
import numpy as np
import pytest
from data import awkward, empty, frame, prose, with_clashes
from pyspark.sql import functions as F

from quillspark.llm import common, decontaminate, langid, licenses, registry, sharding, simhash, toxicity

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, toxic int"


# Language


def test_backoff_goes_to_shorter_grams():
    model = langid.LanguageModel(["a", "b"], {"known": 0}, np.array([[1.0, -1.0]]), {"_xyz": 0, "q": 1}, np.array([[-1.0, 1.0], [1.0, -1.0]]))
    assert model.predict("known", {})[0] == "a"
    assert model.unseen("xyzzy") == [0] and model.unseen("qqqqq") == [1] * 5 and model.unseen("www") == []
    assert model.predict("xyzzy", {})[0] == "b" and model.predict("www", {}) == ("a", 0.5)


def test_counts_equal_plain_counts(spark):
    docs = spark.createDataFrame([("en", "The the cat"), ("fr", "Le CHAT, le"), ("en", None), (None, "lost"), ("en", "cat2cat")], "lang string, text string")
    model = langid.train(docs)
    assert model.languages == ["en", "fr"] and set(model.words) == {"the", "cat", "le", "chat"}
    raw = {w: [0.5, 0.5] for w in model.words}
    for lang, w, n in (("en", "the", 2), ("en", "cat", 3), ("fr", "le", 2), ("fr", "chat", 1)):
        raw[w][lang == "fr"] += n
    logs = {w: np.log(v) - np.log([6, 4]) for w, v in raw.items()}
    assert all(model.word_scores[model.words[w]] == pytest.approx(v - v.mean()) for w, v in logs.items())


def test_bounds_of_the_model(spark):
    counts = spark.createDataFrame([(f"w{i}", i + 1) for i in range(400)], "word string, n long")
    few = common.most_frequent(counts, 50).collect()
    assert 0 < len(few) <= 50 and {r["n"] for r in few} == set(range(401 - len(few), 401))
    assert common.most_frequent(counts.withColumn("n", F.lit(1)), 30).count() == 30
    assert common.hashed_sample(spark.range(5000), "id", 100).count() == 100


def test_identify_awkward(spark):
    df = with_clashes(frame(spark), "lang_pred", "score")
    rows = langid.identify(df, langid.train(df)).collect()
    assert len(rows) == df.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (100, 101, 102, 103)} == {"und"}
    assert all(r["lang_pred"] == r["lang"] for r in rows if r["doc_id"] is not None and r["doc_id"] < 60)
    nothing = langid.train(empty(spark))
    assert {r["lang_pred"] for r in langid.identify(frame(spark), nothing).collect()} == {"und"}
    assert langid.identify(empty(spark), nothing).count() == 0
    kept = langid.keep_identified(frame(spark))
    assert kept.columns == frame(spark).columns and kept.count() == sum(any(c.isalpha() for c in r[1] or "") for r in awkward())


def test_held_out_accuracy(spark):
    found = langid.op10_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert found.filter("lang = lang_pred").count() >= 0.98 * found.count()


def test_labels_of_held_out_rows_do_not_count(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    changed = docs.withColumn("lang", F.when(common.held_out(), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    get = lambda d: sorted(map(tuple, langid.identify(d.select("doc_id", "text"), langid.train(d.filter(~common.held_out()))).select("doc_id", "lang_pred", "score").collect()))
    assert get(docs) == get(changed)


# Toxicity


def test_held_out_labels(spark):
    found = toxicity.op2_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in found)
    assert right >= 0.93 * len(found)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in found)


def test_scores_of_awkward_documents(spark):
    df = with_clashes(frame(spark), "score", "votes", "x", "toxic", "posterior")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(60)] + [(None, 1), (5, None), (5, 1)], LABELS)
    rows = toxicity.score_documents(df, labels, ~common.held_out()).collect()
    assert len(rows) == df.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len(toxicity.score_documents(df, empty(spark, LABELS), ~common.held_out()).collect()) == df.count()
    assert toxicity.score_documents(empty(spark), labels, ~common.held_out()).count() == 0


def test_insults_score_higher_without_any_label(spark):
    clean = [(i, prose("en", 60, i), "en", "s", 0) for i in range(150)]
    rude = [(i, prose("en", 30, i) + " you idiot, pathetic worthless scum, moron! " + prose("en", 20, i + 1), "en", "s", 0) for i in range(150, 180)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(frame(spark, clean + rude), empty(spark, LABELS), ~common.held_out()).collect()}
    assert min(got[i] for i in range(150, 180)) > max(got[i] for i in range(150))


def test_label_model_finds_accuracies_and_correlation():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.3
    votes = np.zeros((6000, len(toxicity.VOTERS)), dtype=int)
    votes[:, 0] = np.where(y, rng.random(6000) < 0.9, rng.random(6000) < 0.05)
    votes[:, 1] = np.where(rng.random(6000) < 0.95, votes[:, 0], 1 - votes[:, 0])  # a copy of voter 0
    votes[:, 2] = np.where(y, rng.random(6000) < 0.7, rng.random(6000) < 0.1)
    bits = (votes << np.arange(len(toxicity.VOTERS))).sum(axis=1)
    seen = {}
    for b, label, known in zip(bits, y, rng.random(6000) < 0.2, strict=True):
        row = seen.setdefault(int(b), [0, 0, 0])
        row[1 + int(label) if known else 0] += 1
    model = toxicity.fit_label_model([(b, *n) for b, n in sorted(seen.items())])
    assert 0 in (model.parents[1],) or model.parents[0] == 1
    post = model.posterior(votes)
    assert ((post > 0.5) == y).mean() > 0.9 and abs(model.prior - 0.3) < 0.05


# Decontamination


def edit_distance_in(pattern, text):
    """Least edits of the pattern against any stretch of the text, and the first end."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != t))
    best = min(row)
    return best, row.index(best)


def test_myers_against_the_table():
    rng = random.Random(5)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 70)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        edits, end = edit_distance_in(p, t)
        assert decontaminate.myers(p, t, len(p)) == (edits, end)
        assert (decontaminate.myers(p, t, edits - 1) is None) if edits else True


def test_no_match_within_the_budget_is_lost():
    rng = random.Random(6)
    items = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(8, 40)))) for i in range(25)]
    matcher = decontaminate.Matcher(items, 0.08)
    for _ in range(60):
        i, item = rng.choice(items)
        k, text = int(len(item) * 0.08), list(item.upper().replace(" ", "\n"))
        for _ in range(rng.randint(0, k)):
            at = rng.randrange(len(text))
            rng.choice([lambda: text.__setitem__(at, "z"), lambda: text.pop(at), lambda: text.insert(at, "z")])()
        doc = prose("en", 40, i) + " " + "".join(text) + " " + prose("en", 30, i + 1)
        want = edit_distance_in(decontaminate.folded(item), decontaminate.folded(doc))
        got = [h for h in matcher.search(doc) if h[0] == i]
        assert got and got[0][1] == want[0]
        _, edits, start, end = got[0]
        assert edit_distance_in(decontaminate.folded(item), decontaminate.folded(doc[start:end]))[0] == edits


def test_contaminations_in_blocks_and_awkward(spark):
    rows = [*awkward(), (200, "intro " + prose("en", 30, 777) + " outro", "en", "s", 0)]
    bench = spark.createDataFrame([(1, prose("en", 30, 777)), (2, prose("fr", 25, 778)), (3, None), (4, "  "), (5, prose("fr", 25, 778))], "item_id long, text string")
    df = with_clashes(frame(spark, rows), "item_id", "edits", "_hits", "start", "end")
    for size in (10, 4_000_000):
        found = decontaminate.contaminations(df, bench, block_chars=size).collect()
        assert [(r["doc_id"], r["item_id"], r["edits"], r["start"]) for r in found] == [(200, 1, 0, 6)]
        clean = decontaminate.drop_contaminated(frame(spark, rows), bench, block_chars=size)
        assert clean.count() == len(rows) - 1 and clean.columns == frame(spark).columns
    none = empty(spark, "item_id long, text string")
    assert decontaminate.contaminations(df, none).count() == 0 and decontaminate.drop_contaminated(frame(spark), none).count() == frame(spark).count()
    assert decontaminate.contaminations(empty(spark), bench).count() == 0


def test_exact_passages_equal_a_plain_search(spark):
    docs = [(r["doc_id"], decontaminate.folded(r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], decontaminate.folded(r["text"]).strip()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in docs for i, x in items if x in t}
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.op5_decontamination(spark, SF).collect()}
    assert want == {k for k, e in got.items() if e == 0} and want


# Licenses


def test_windows_share_fingerprints():
    rng = random.Random(3)
    for _ in range(100):
        words = [rng.choice("abcdefgh") * 3 for _ in range(40)]
        a, n = rng.randrange(20), licenses.GRAM + licenses.WINDOW - 1
        part = words[a : a + n]
        whole, own = licenses.gram_hashes(words), licenses.gram_hashes(part)
        assert set(own[licenses.winnow(own)].tolist()) & set(whole[licenses.winnow(whole)].tolist())


def test_alignment_with_edits():
    template = "a b c d e f g h i j".split()
    assert licenses.align(template, "x x a b c d e f g h i j y".split(), 2) == (10, 2, 12)
    assert licenses.align(template, "x a b c X d e g h i j".split(), 1) == (9, 1, 11)


def test_scan(spark):
    rows = [(1, "Intro text.\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "released  UNDER the mit LICENSE"), (3, None), (4, ""), (5, "a license to print money"), (6, "mot " * 50_000 + "Licensed under CC BY-NC 4.0."), (7, licenses.TEMPLATES["mit-grant"].replace("any person", "any natural person")), (1, "Intro")]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"), "licenses", "template")
    got = {r["text"]: [tuple(x) for x in r["licenses"]] for r in licenses.scan(df).collect()}
    assert [x[0] for x in got[rows[0][1]]] == ["apache-2-notice"] and rows[0][1][got[rows[0][1]][0][4] : got[rows[0][1]][0][5]].startswith("Licensed")
    assert [x[0] for x in got[rows[1][1]]] == ["mit-notice"] and got[None] == [] and got[""] == [] and got[rows[4][1]] == []
    assert [x[0] for x in got[rows[5][1]]] == ["cc-by-nc-4-notice"]
    assert [x[0] for x in got[rows[6][1]]] == ["mit-grant"] and got[rows[6][1]][0][3] == 1.0
    assert licenses.scan(empty(spark)).count() == 0
    assert licenses.scan(df, {"blank": " "}).filter("size(licenses) > 0").count() == 0


def test_all_planted_lines_are_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    lines = {"GNU General Public License, version 3": "gpl-3-notice", "CC BY-NC 4.0": "cc-by-nc-4-notice", "Released under the MIT License": "mit-notice", "Apache License, Version 2.0": "apache-2-notice"}
    want = {(d["doc_id"], n) for d in docs for x, n in lines.items() if x in d["text"]}
    assert {(r["doc_id"], r["template"]) for r in licenses.op9_licenses(spark, SF).collect()} == want


# Pipeline and registry


def five_word_shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_the_predicted_language_decides_not_the_given_one(spark):
    """Wrong and missing languages of the held-out part are put right; what no language explains goes, and mixing rakes by the prediction."""
    rows = [(i, prose("en" if i % 2 else "fr", 40, i), "en" if i % 2 else "fr", "s", 0) for i in range(200)]
    held = {r["doc_id"] for r in frame(spark, rows).filter(common.held_out()).collect()}
    wrong = [(i, t, ("xx" if i % 4 < 2 else None) if i in held else lang, s, n) for i, t, lang, s, n in rows] + [(900, "zzz", "fr", "s", 0), (901, "12", "en", "s", 0), (902, None, "en", "s", 0)]
    found = {r["doc_id"]: r["lang"] for r in langid.keep_identified(frame(spark, wrong)).collect()}
    assert {i: found.get(i) for i, *_ in rows} == {i: lang for i, _, lang, _, _ in rows} and 901 not in found and 902 not in found
    assert len(held) > 20 and 900 not in {r["doc_id"] for r in langid.keep_identified(frame(spark, wrong), 0.999999).collect()}


def test_numbers_that_look_like_letters_are_no_letters(spark):
    df = frame(spark, [(1, "the house", "en", None, 0), (2, "la maison", "fr", None, 0), (3, "²", "en", None, 0), (4, "½ 3", "en", None, 0), (5, "Ⅷ①", "en", None, 0), (6, "x²", "en", None, 0)])
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, langid.train(df)).collect()}
    assert [got[i] for i in (3, 4, 5)] == ["und"] * 3 and got[6] != "und"


def test_pipeline_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [decontaminate.folded(r["text"]).strip() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = common.stored(stage(spark, docs, SF))
        seen.append((docs.collect(), after.collect()))
        assert n == 4 or after.columns == docs.columns
        docs = after
    identified, deduped, cleaned, mixed, placed = seen
    # the corpus has no document without a likely language, so all with a letter stay
    assert {r["doc_id"] for r in identified[1]} == {r["doc_id"] for r in identified[0] if any(c.isalpha() for c in r["text"])}
    sets = {r["doc_id"]: five_word_shingles(r["text"]) for r in deduped[0]}
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root(a) != root(b):
            low, high = sorted((root(a), root(b)))
            up[high] = low
    assert {r["doc_id"] for r in deduped[1]} == {root(d) for d in sets}
    gone = {r["doc_id"] for r in cleaned[0]} - {r["doc_id"] for r in cleaned[1]}
    exact = {r["doc_id"] for r in cleaned[0] if any(x in decontaminate.folded(r["text"]) for x in items)}
    assert exact <= gone and len(gone) <= len(exact) + 2
    assert {r["doc_id"] for r in mixed[1]} <= {r["doc_id"] for r in mixed[0]} and len(mixed[1]) > 0.8 * len(mixed[0])
    assert {r["doc_id"] for r in placed[1]} == {r["doc_id"] for r in mixed[1]} and {r["shard"] for r in placed[1]} == set(range(sharding.SHARDS))


def test_pipeline_of_awkward_documents(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose("en", 30, 777))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    empty(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    empty(spark, "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    from helpers import oracle_rows, spark_rows

    assert spark_rows(registry.queries()[name](spark, SF)) == oracle_rows(registry.oracle_sql()[name], SF)


def test_all_operators_are_registered():
    assert {n.split("_")[0] for n in registry.queries()} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}


def test_folding_keeps_offsets_and_accented_capitals_match():
    import sys

    from quillspark.llm import decontaminate

    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    assert len(decontaminate.folded(every)) == len(every)
    item = "él ñandú corrió ágil por la última sierra \u00e9pica de los \u00f3leos"
    assert decontaminate.Matcher([(7, item)]).search("xx " + item.upper() + " yy") == [(7, 0, 3, 3 + len(item))]
