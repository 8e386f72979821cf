"""Row order, term scans, audits by observation, dedup with odd row numbers, spanning forests."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lx, scan
from quillspark.functions.text import matched_labels, present
from quillspark.operators import classify, dedup, dialect, graph, keywords, order
from quillspark.plans import corpus, export, fixture

TERMS = ["he", "she", "hers", "a b", " b ", "sh", "x.y", "°", "here", "learning", "e-learning", "(a)"]


def test_every_term_is_found_wherever_it_lies(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["he", "sh", "s", "rs", " ", "a", "b", "x", ".", "y", "°", "e-", "learning", "(a)", "é", "\n"]) for _ in range(rng.randrange(14))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in [*texts, "", None]], "t string")
    for r in df.select("t", scan.found_terms("t", TERMS).alias("found"), scan.any_of("t", TERMS).alias("some"), scan.found_terms("t", []).alias("none")).collect():
        assert r["found"] == (None if r["t"] is None else [x for x in TERMS if x in r["t"]])
        assert r["some"] == (None if r["t"] is None else any(x in r["t"] for x in TERMS)) and r["none"] == (None if r["t"] is None else [])


def test_a_pattern_reads_shared_beginnings_once():
    assert scan.trie_pattern(("ab", "abc", "abd", "x")) == "(?:ab(?:c|d)?|x)"
    with pytest.raises(ValueError, match="empty"):
        scan.found_terms("t", ["a", ""])


def test_cue_windows_decide_as_the_text_does(spark):
    rng = random.Random(5)
    words = ["training", "trainingé", "été", "education", "medical", "learning", "gains", "resident", "residents", "train", "the", "model", "deep", "x_training", "surgical", "planning", "health", "professions"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "-", ". ", "\n", "  "]) for _ in range(rng.randrange(12))) for _ in range(400)]
    every = [*lx.EDUCATION_PATTERNS.values(), *lx.CLINICAL_PATTERNS.values(), *lx.MACHINE_LEARNING_PATTERNS]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", scan.cue_windows("t", every, scan.pattern_words(every)))
    labels = lx.EDUCATION_PATTERNS | lx.CLINICAL_PATTERNS | {p: p for p in lx.MACHINE_LEARNING_PATTERNS}
    rows = df.select("t", matched_labels("t", labels).alias("whole"), matched_labels("w", labels).alias("windows")).collect()
    assert all(r["whole"] == r["windows"] for r in rows) and sum(r["whole"] != "" for r in rows) > 100


def test_exact_dedup_with_repeated_and_null_numbers(spark):
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "c"), (3, "c"), (None, "d"), (None, "d"), (None, "a"), (4, None), (5, None)]
    df = spark.createDataFrame(rows, "_row_id long, t string")
    assert sorted(map(tuple, dedup.exact(df).collect()), key=str) == sorted([(1, "a"), (2, "b"), (3, "c"), (None, "d"), (4, None)], key=str)


@pytest.mark.parametrize("salts", [1, 7])
def test_guarded_dedup_of_a_hot_key(spark, salts):
    """A tenth and more of all rows share a key, with no, one or many DOIs."""
    rng = random.Random(salts)
    rows = [(i, rng.choice(["hot", "hot", "one", "none", ""]), rng.choice(["", "d1", "d2", f"d{i}"]), rng.randrange(5)) for i in range(600)]
    rows = [(i, t, "" if t == "none" else "d1" if t == "one" else d, q) for i, t, d, q in rows]
    best = {}
    several = {t for t in ("hot", "one", "none") if len({d for _, x, d, _ in rows if x == t and d}) > 1}
    for i, t, d, q in rows:
        key = (i,) if t == "" else (t, d if t in several else "")
        best[key] = min(best.get(key, (1, 0)), (-q, i))
    df = spark.createDataFrame(rows, "_row_id long, t string, d string, q int")
    found = dedup.guarded(df, ["t"], "d", F.col("q"), salts=salts)
    assert found.columns == df.columns and {r["_row_id"] for r in found.collect()} == {i for _, i in best.values()}


def test_audit_by_observation_is_the_audit_by_counts(spark, monkeypatch):
    rows = fixture.records(spark)
    plain = [tuple(r) for r in corpus.counted(rows).orderBy("stage_no").collect()]
    monkeypatch.setattr(corpus, "counted", lambda df: pytest.fail("stages were counted anew"))
    assert [tuple(r) for r in corpus.audit(rows).orderBy("stage_no").collect()] == plain


def test_audit_counts_anew_where_tasks_ran_again(spark, monkeypatch):
    rows = fixture.records(spark)
    monkeypatch.setattr(corpus, "_ran_once", lambda *_: False)
    monkeypatch.setattr(corpus, "counted", lambda df: "anew")
    assert corpus.audit(rows) == "anew"


def test_a_failed_task_is_noticed(spark):
    context = spark.sparkContext
    context.setJobGroup("clean", "")
    spark.range(10).repartition(3).count()
    context.setJobGroup("broken", "")
    with pytest.raises(Exception):  # noqa: B017
        spark.range(10).select(F.raise_error(F.lit("no"))).collect()
    context.setLocalProperty("spark.jobGroup.id", None)
    assert corpus._ran_once(spark, "clean") and not corpus._ran_once(spark, "broken") and not corpus._ran_once(spark, "never")


def test_numbers_are_gapless_and_by_order(spark):
    values = [random.Random(i).randrange(50) for i in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v int")
    found = order.numbered(df, F.desc("v"), "i", name="n").orderBy("n").collect()
    assert [r["n"] for r in found] == list(range(500)) and [(r["v"], r["i"]) for r in found] == sorted(((v, i) for i, v in enumerate(values)), key=lambda x: (-x[0], x[1]))
    assert sorted(r["_ord"] for r in order.numbered(df.repartition(5)).collect()) == list(range(500))
    assert order.numbered(df.limit(0), "i").count() == 0


def test_ties_go_to_the_keyword_seen_first(spark):
    df = spark.createDataFrame([(2, ["zoo", "ant"]), (1, ["yak", "zoo"]), (3, ["ant", "yak", "bee"])], "o long, w array<string>")
    assert [(r["keyword"], r["n"]) for r in keywords.top_keywords(df, F.col("w"), 4, order="o").orderBy("rank").collect()] == [("yak", 2), ("zoo", 2), ("ant", 2), ("bee", 1)]
    items = df.select("o", F.posexplode("w").alias("p", "i")).withColumn("s", F.struct("o", "p"))
    assert {r["row"] for r in graph.matrix(items, "o", "i", 2, "s").collect()} == {"yak", "zoo"}


def plain_components(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in list(up)}


def test_forest_cuts_are_components_of_every_threshold(spark):
    rng = random.Random(6)
    edges = {(g, *sorted(rng.sample([f"n{i:02}" for i in range(25)], 2))): rng.randrange(1, 8) for g in (1, 2) for _ in range(45)}
    df = spark.createDataFrame([(*k, w) for k, w in edges.items()] + [(1, "n01", "n01", 9)], "graph long, src string, dst string, weight long")
    forest = graph.spanning_forest(df)
    kept = [tuple(r) for r in forest.collect()]
    for g in (1, 2):
        mine = [(a, b) for x, a, b, _ in kept if x == g]
        assert len(mine) == len(plain_components(mine)) - len(set(plain_components(mine).values()))  # no ring
    configs = [(f"{g}/{w}", g, w) for g in (1, 2) for w in (1, 3, 5, 7, 9)]
    found = {}
    for r in graph.forest_components(forest, spark.createDataFrame(configs, "config string, graph long, least long")).collect():
        found.setdefault(r["config"], {})[r["id"]] = r["component"]
    assert found == {c: p for c, g, w in configs if (p := plain_components([(a, b) for (x, a, b), n in edges.items() if x == g and n >= w]))}
    assert graph.spanning_forest(df.limit(0)).count() == 0


def test_communities_on_executors_are_as_good_as_one_after_another(spark):
    from quillspark.plans import catalog

    cliques = [(f"{c}{i}", f"{c}{j}", 5) for c in "abc" for i in range(5) for j in range(i)]
    edges = spark.createDataFrame([*cliques, ("a0", "b0", 1), ("b1", "c1", 1), ("a0", "a0", 2)], "src string, dst string, weight long")
    assert {(r["id"], r["cluster"]) for r in graph.communities(edges).collect()} == {(f"{c}{i}", f"{c}0") for c in "abc" for i in range(5)}
    assert graph.communities(edges.limit(0)).count() == 0
    cited = catalog.cocitation_edges(spark, "/root/testdata/sf0.001").select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "weight")
    cited = graph.checkpointed(cited)
    quality = [graph.modularity(cited, labels).first()[0] for labels in (graph.communities(cited), graph.louvain(cited))]
    assert quality[0] > quality[1] - 0.02


def test_short_lists_and_cues_are_searched_for_without_a_pass_of_patterns(spark):
    """Long texts at positions without a match cost no pattern: the plans hold none but behind a plain search."""
    every = [*lx.EDUCATION_PATTERNS.values(), *lx.CLINICAL_PATTERNS.values(), *lx.MACHINE_LEARNING_PATTERNS]
    assert all(scan.certain_part(p) for p in every) and scan.certain_part(r"a|b") == "" and scan.certain_part(r"\btrain(?:ing)? the model\b") == " the model"
    texts = ["students", "coeducation", "re-education for a trainee", "skill acquisition", "training the model", "train the model", "curricula", "", "the ſtudents", "school\nschooling", None]
    want = [None if t is None else [p for p in every if re.search(p, t, re.ASCII)] for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r["f"] for r in df.select("i", scan.found_patterns("t", every).alias("f")).orderBy("i").collect()] == [[] if w is None else w for w in want]
    plan = df.select(scan.found_terms("t", lx.VR_TERMS))._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan


def test_dashboard_counts_compute_no_step_for_each_count(spark):
    rows = fixture.records(spark)
    counts = dialect.stage_counts(rows)
    assert [r["records"] for r in counts.orderBy("stage_no").collect()] == [t.count() for _, t in dialect.stages(rows)]
    assert counts._jdf.queryExecution().analyzed().toString().count("regexp_replace(Abstract") <= 1


def test_long_texts_are_read_by_searches_that_skip(spark):
    """The plans hold no byte-by-byte ``contains`` for each term."""
    df = spark.createDataFrame([("students learn",), (None,)], "t string")
    searched = df.select(scan.found_terms("t", lx.VR_TERMS), scan.found_patterns("t", [r"\bstudents?\b"]))
    assert "contains(t" not in searched._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [[list(x or []) for x in r] for r in searched.collect()] == [[[], [r"\bstudents?\b"]], [[], []]]


def test_filters_on_found_terms_search_once(spark):
    rows = spark.createDataFrame([("students of virtual reality",), ("x",)], "Title string")
    kept = classify.classified(rows).filter("Tech_Category is not null")
    assert [r["Tech_Category"] for r in kept.collect()] == ["VR"]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython [held(concat") == 1


def test_a_text_is_read_up_to_its_first_sign_to_see_whether_it_is_blank(spark):
    df = spark.createDataFrame([("students learn", None), (" \u2003\n", ""), ("\u00a0x ", " ")], "t string, u string")
    blank = df.select(present("t").alias("t"), present("u").alias("u"))
    assert [tuple(r) for r in blank.collect()] == [(True, False), (False, False), (True, False)]
    assert "regexp_replace" not in blank._jdf.queryExecution().analyzed().toString()


def test_guarded_dedup_reads_its_rows_once(spark):
    df = spark.createDataFrame([(1, "a", "x", 1), (2, "a", "y", 2), (3, "a", "", 3), (4, "b", "", 1), (5, "b", "", 2)], "_row_id long, t string, d string, q int")
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    found = dedup.guarded(df.mapInArrow(passed, df.schema), ["t"], "d", F.col("q"))
    assert {r["_row_id"] for r in found.collect()} == {1, 2, 3, 5} and seen.value == 5


def test_an_export_of_one_row_group_is_made_and_read_by_several_tasks(spark):
    rows = export.records(spark, "/root/testdata/sf0.001")
    assert len({r[0].rsplit("/", 1)[1] for r in rows.select(F.input_file_name()).distinct().collect()}) >= spark.sparkContext.defaultParallelism
