import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import audit, collab, dedup, graph, keywords, metrics
from quillspark.plans import corpus
from quillspark.plans.fixture import records
from quillspark.sources import records as reader
from quillspark.sources import sinks


def brute_h(values):
    values = sorted(map(int, values), reverse=True)
    return sum(v >= i for i, v in enumerate(values, 1))


def test_h_index(spark):
    rng = random.Random(1)
    groups = {g: [rng.randint(0, 12) for _ in range(rng.randint(1, 40))] for g in "abcde"} | {"zero": [0, 0], "one": [9]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, c double")
    assert {r["g"]: r["h_index"] for r in metrics.h_index(df, ["g"], "c").collect()} == {g: brute_h(v) for g, v in groups.items()}


def brute_zones(counts):
    total, run, zones = sum(counts), 0, [[0, 0], [0, 0], [0, 0]]
    for n in sorted(counts, reverse=True):
        z = 0 if 3 * run < total else 1 if 3 * run < 2 * total else 2
        zones[z][0] += 1
        zones[z][1] += n
        run += n
    return [x for z in zones for x in z]


@pytest.mark.parametrize("counts", [[1], [5, 5], [30, 1, 1, 1], [3, 3, 3, 2, 2, 1, 1, 1, 1], [7] * 9])
def test_bradford_zones(spark, counts):
    df = spark.createDataFrame([("g", f"s{i}") for i, n in enumerate(counts) for _ in range(n)], "g string, s string")
    got = metrics.bradford(df, "g", "s").filter("g = 'g'").first()
    assert list(got)[2:] == brute_zones(counts)


def test_growth_of_one_year_is_zero_and_peak_is_earliest(spark):
    df = spark.createDataFrame([("a", 2000, 1.0), ("b", 2001, 0.0), ("b", 2003, 2.0)], "g string, y int, c double")
    got = {r["g"]: r for r in metrics.main_metrics(df, "g", "y", "c").collect()}
    assert got["a"]["growth"] == 0 and got["b"]["peak_year"] == 2001 and got[metrics.FULL]["documents"] == 3


def test_wilson_bounds(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (3, 12)], "k int, n int")
    low, high = metrics.wilson(F.col("k"), F.col("n"))
    rows = df.select(low.alias("l"), high.alias("h")).collect()
    assert rows[0]["l"] == 0 and rows[1]["h"] == pytest.approx(1) and 0.08 < rows[2]["l"] < 0.25 < rows[2]["h"] < 0.6


def test_bootstrap_holds_the_estimate(spark):
    df = spark.createDataFrame([(i, "x" if i % 3 else "y", "p" if i % 2 else "q") for i in range(300)], "id long, r string, c string")
    for row in metrics.rca_bootstrap(df, "r", "c", 200).collect():
        assert row["low"] < row["rca"] < row["high"]


def test_keyed_survivor_prefers_rich_then_first(spark):
    df = spark.createDataFrame([(0, "k", None), (1, "k", "x"), (2, "k", "y"), (3, "", "z"), (4, None, "z")], "_row_id long, k string, v string")
    assert sorted(r["_row_id"] for r in dedup.keyed(df, "k", dedup.completeness(["v"])).collect()) == [1, 3, 4]


def test_guarded_dedup(spark):
    rows = [(0, "t", "a", ""), (1, "t", "a", "d1"), (2, "u", "a", "d1"), (3, "u", "a", "d2"), (4, "u", "a", ""), (5, "t", "", "d"), (6, "t", "", "d")]
    df = spark.createDataFrame(rows, "_row_id long, t string, a string, doi string").withColumn("q", F.when(F.col("doi") != "", 1).otherwise(0))
    assert sorted(r["_row_id"] for r in dedup.guarded(df, ["t", "a"], "doi", F.col("q")).collect()) == [1, 2, 3, 4, 5, 6]


def test_dedup_does_not_depend_on_order(spark):
    df = records(spark)
    first = sorted(r["_row_id"] for r in corpus.stages(df)[4][1].collect())
    again = sorted(r["_row_id"] for r in corpus.stages(df.repartition(7).orderBy(F.rand(3)))[4][1].collect())
    assert first == again


def test_audit_closes(spark):
    rows = corpus.audit(records(spark)).orderBy("stage_no").collect()
    assert all(r["before"] - r["removed"] == r["records"] for r in rows)
    assert all(a["records"] == b["before"] for a, b in zip(rows, rows[1:], strict=False))
    assert rows[-1]["records"] > 0


def test_funnel_counts_null_conditions_as_false(spark):
    df = spark.createDataFrame([(1,), (None,), (5,)], "x int")
    assert [r["records"] for r in audit.funnel(df, [("big", F.col("x") > 2)]).orderBy("stage_no").collect()] == [3, 1]


def test_majority_tie_goes_to_first_seen(spark):
    df = spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", "a", 3), ("g", "b", 4)], "g string, v string, o int")
    assert metrics.majority(df, ["g"], "v", "o").first()["v"] == "b"


def test_status_and_residual(spark):
    df = spark.createDataFrame([("A", "SCP")] * 3 + [("B", "SCP"), (None, "Unresolved")], "l string, c string")
    got = {(r["collab"], r["country"]): r["n"] for r in collab.residual(df, "l", "c", 1).collect()}
    assert got == {("SCP", "A"): 3, ("SCP", "Others / unresolved"): 1, ("Unresolved", "Others / unresolved"): 1}


def test_repeats_make_self_pairs_only_when_asked(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "d int, i string")
    nodes = graph.frequencies(df, "d", "i", distinct=False)
    pairs = lambda distinct: {(r["src"], r["dst"]): r["weight"] for r in graph.pair_counts(df, "d", "i", nodes, distinct).collect()}
    assert pairs(True) == {("a", "b"): 1} and pairs(False) == {("a", "a"): 1, ("a", "b"): 2}


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}", 1) for i in range(60) if i % 20 != 19], "src string, dst string, weight int")
    got = {r["id"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {f"{i:03d}": f"{i - i % 20:03d}" for i in range(60)}


def test_louvain_and_its_modularity(spark):
    cliques = [(f"{c}{i}", f"{c}{j}", 5) for c in "ab" for i in range(5) for j in range(i)]
    edges = spark.createDataFrame([*cliques, ("a0", "b0", 1)], "src string, dst string, weight long")
    labels = graph.louvain(edges)
    assert sorted({(r["id"][0], r["cluster"]) for r in labels.collect()}) == [("a", 0), ("b", 1)]
    assert 0.4 < graph.modularity(edges, labels).first()[0] < 0.5
    assert graph.adjusted_rand(labels, labels).first()[0] == 1.0


def test_spellings():
    assert keywords.indel_ratio("abc", "abc") == 100 and keywords.indel_ratio("abcd", "abed") == 75
    assert keywords.spelling_map(["simulation", "simulations", "robot"])["simulation"] == "simulations"


def test_csv_dialect(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('﻿Title , Year,Keywords\n"a ""b""\nc",2019,k\nNA,,x\n', encoding="utf-8")
    df = reader.read_records(spark, str(path))
    rows = df.orderBy("_row_id").collect()
    assert df.columns[:2] == ["Title", "Year"] and rows[0]["Title"] == 'a "b"\nc' and rows[1]["Title"] is None
    assert reader.canonical_columns(df).orderBy("_row_id").first()["Author Keywords"] == "k"


def test_markdown(spark):
    assert sinks.markdown(spark.createDataFrame([(1, "a|b")], "x int, y string")) == "| x | y |\n| --- | --- |\n| 1 | a\\|b |\n"


def test_community_grid_agrees_with_its_baseline(spark):
    rng = random.Random(11)
    docs = [(d, f"{'ab'[d % 2]}{rng.randrange(6)}") for d in range(300) for _ in range(3)]
    items = spark.createDataFrame(docs, "d int, i string")
    rows = {(r["min_freq"], r["min_edge"]): r for r in graph.community_grid(items, "d", "i", [(1, 1), (1, 10_000)], (1, 1)).collect()}
    assert rows[1, 1]["ari"] == 1.0 and rows[1, 1]["communities"] == 2 and rows[1, 1]["modularity"] == pytest.approx(0.5, abs=0.02)
    assert rows[1, 10_000]["communities"] == 0 and rows[1, 10_000]["ari"] is None


def test_command_line_writes_every_table(spark, tmp_path):
    import csv

    from quillspark import cli
    from quillspark.plans.fixture import COLUMNS, ROWS

    with (tmp_path / "in.csv").open("w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(COLUMNS)
        out.writerows(["" if v is None else v for v in r] for r in ROWS)
    cli.main(["--input", str(tmp_path / "in.csv"), "--results-dir", str(tmp_path / "out"), "--skip", "a8, A3"])
    written = {p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")}
    assert {"classified_corpus", "pipeline_report.csv", "table_A0_pipeline_audit.md", "education_screen_methods.md", "table_A9_rca.csv", "table_A11_algorithm_specification.csv"} <= written
    assert not any(".parts-" in n for n in written) and all((tmp_path / "out" / n).is_file() for n in written if n.endswith(".csv"))
    with (tmp_path / "out/table_A1_yearly_stats.csv").open(encoding="utf-8") as f:
        table = list(csv.reader(f))
    assert table[0] == ["Category", "Year", "N", "TC", "Impact"] and [r[:2] for r in table[1:3]] == [["VR", "1991"], ["VR", "1992"]] and len(table) == 1 + 5 * 35
    assert not any(n.startswith(("table_A8", "table_A3")) for n in written)
    assert spark.read.parquet(str(tmp_path / "out/classified_corpus")).count() == corpus.corpus(records(spark)).count()
    with pytest.raises(SystemExit):
        cli.parse(["--input", "x", "--results-dir", "y", "--skip", "nothing"])
