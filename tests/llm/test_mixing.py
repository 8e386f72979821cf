import pytest
from data import empty, frame, with_clashes

from quillspark.llm import mixing


def test_rake_meets_all_margins():
    cells = {(s, lang, t): 10.0 + 7 * s + 3 * lang + t for s in range(4) for lang in range(3) for t in range(2)}
    goals = [{0: 0.4, 1: 0.3, 2: 0.2, 3: 0.1}, {0: 0.5, 1: 0.25, 2: 0.25}, {0: 0.6, 1: 0.4}]
    weight = mixing.rake(cells, goals)
    total = sum(cells.values())
    for m, goal in enumerate(goals):
        for v, share in goal.items():
            assert sum(n * weight[c] for c, n in cells.items() if c[m] == v) / total == pytest.approx(share, abs=1e-7)


def test_calibration_meets_the_budget():
    cells, weight = {("a",): 100.0, ("b",): 50.0, ("c",): 0.0}, {("a",): 0.5, ("b",): 4.0, ("c",): 1.0}
    for budget in (0.1, 0.5, 0.9, 1.0):
        scale = mixing.calibrate(cells, weight, budget)
        assert sum(n * min(1, scale * weight[c]) for c, n in cells.items()) == pytest.approx(budget * 150, rel=1e-6)
    assert mixing.calibrate({}, {}, 0.5) == 1.0


def test_sample_follows_probabilities(spark):
    df = spark.range(30_000).selectExpr("id as doc_id", "concat('word ', id) as text", "if(id % 3 = 0, 'fr', 'en') as lang", "if(id % 5 = 0, 'a', 'b') as source")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.5, "fr": 0.5}}
    rows = mixing.mix(df, targets, budget=0.3).collect()
    want = sum(r["keep_prob"] * r["tokens"] for r in rows)
    kept = [r for r in rows if r["kept"]]
    assert sum(r["tokens"] for r in kept) == pytest.approx(want, rel=0.05) and want == pytest.approx(0.3 * 60_000, rel=1e-3)
    assert sum(r["tokens"] for r in kept if r["source"] == "a") == pytest.approx(0.5 * want, rel=0.1)
    assert sum(r["tokens"] for r in kept if r["lang"] == "fr") == pytest.approx(0.5 * want, rel=0.1)


def test_awkward_documents(spark):
    df = with_clashes(frame(spark), "topic", "tokens", "weight", "keep_prob", "kept")
    rows = mixing.mix(df).collect()
    assert len(rows) == df.count() and all(0 <= r["keep_prob"] <= 1 for r in rows)
    again = mixing.mix(df.repartition(5)).collect()
    key = lambda rs: sorted(str((r["doc_id"], r["text"], r["kept"])) for r in rs)
    assert key(rows) == key(again)
    assert {r["tokens"] for r in rows if r["text"] in (None, "")} == {0}
    assert mixing.mix(empty(spark)).count() == 0 and mixing.sample(frame(spark)).columns == frame(spark).columns


def test_unlisted_values_have_share_zero(spark):
    df = spark.createDataFrame([(i, "a b", "en" if i % 2 else "fr", "s", 3) for i in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["lang"] for r in mixing.sample(df, {"lang": {"en": 1.0}}).collect()} == {"en"}


def test_too_many_cells_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_CELLS", 2)
    with pytest.raises(ValueError, match="combinations"):
        mixing.mix(frame(spark))


def reachable_shares(tokens, share, total):
    """By hand: the values with least tokens for their share are kept whole first; the others share what is left."""
    goal, left = {}, total
    values = sorted(share, key=lambda v: tokens.get(v, 0) / share[v])
    for i, v in enumerate(values):
        part = left * share[v] / sum(share[w] for w in values[i:])
        goal[v] = min(tokens.get(v, 0), part)
        left -= goal[v]
    return {v: g / total for v, g in goal.items()}


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_default_targets_are_reached_as_far_as_the_corpus_allows(spark, sf):
    rows = mixing.op8_mixing(spark, f"/root/testdata/sf{sf}").collect()
    total = sum(r["tokens"] for r in rows)
    kept = sum(r["tokens"] * r["keep_prob"] for r in rows)
    assert kept == pytest.approx(mixing.BUDGET * total, rel=1e-3)
    for m in mixing.MARGINS:
        own, got = {}, {}
        for r in rows:
            own[r[m]] = own.get(r[m], 0) + r["tokens"]
            got[r[m]] = got.get(r[m], 0) + r["tokens"] * r["keep_prob"]
        scaled = {v: n**0.7 for v, n in own.items() if n}
        target = {v: s / sum(scaled.values()) for v, s in scaled.items()}
        want = reachable_shares(own, target, kept)
        assert all(abs(got[v] / kept - want[v]) < 0.005 for v in want), (m, {v: (got[v] / kept, want[v], target[v]) for v in want})
        gap = {r[m]: r[f"{m}_gap"] for r in rows}
        assert all(gap[v] == pytest.approx(got[v] / kept - target.get(v, 0), abs=1e-9) for v in got)
        off = lambda share: sum(abs(share.get(v, 0) - t) for v, t in target.items())
        assert off({v: n / kept for v, n in got.items()}) <= off({v: n / total for v, n in own.items()}) + 1e-9


def test_bounded_raking_against_feasible_targets():
    cells = {(s, lang, t): 10.0 + 7 * s + 3 * lang + t for s in range(4) for lang in range(3) for t in range(2)}
    total = sum(cells.values())
    for budget in (0.3, 0.6, 0.8):
        goals = [{v: budget * sum(n for c, n in cells.items() if c[m] == v) * (1.1 if v else 0.9) for v in range(k)} for m, k in enumerate((4, 3, 2))]
        goals = [{v: g * budget * total / sum(goal.values()) for v, g in goal.items()} for goal in goals]
        weight = mixing.bounded(cells, dict.fromkeys(cells, budget), goals)
        for m, goal in enumerate(goals):
            for v, g in goal.items():
                assert sum(n * min(1, weight[c]) for c, n in cells.items() if c[m] == v) == pytest.approx(g, rel=1e-3)


def test_the_fit_by_dataframe_equals_the_drivers(spark, monkeypatch):
    df = spark.range(600).selectExpr("id as doc_id", "repeat('word ', cast(id % 7 as int)) as text", "if(id % 3 = 0, null, if(id % 4 = 0, 'fr', 'en')) as lang", "concat('s', id % 5) as source")
    for targets in (None, {"lang": {"en": 0.7, "fr": 0.3}}):
        near = {r["doc_id"]: r for r in mixing.mix(df, targets, 0.6).collect()}
        with monkeypatch.context() as m:
            m.setattr(mixing, "MAX_CELLS", 2)
            far = {r["doc_id"]: r for r in mixing.mix(df, targets, 0.6, spread=True).collect()}
            m.setattr(mixing, "SPREAD_SWEEPS", 1)
            assert mixing.mix(empty(spark), spread=True).count() == 0 and mixing.sample(frame(spark)).count() > 0
        assert near.keys() == far.keys()
        for d, r in near.items():
            if r["tokens"]:
                assert far[d]["keep_prob"] == pytest.approx(r["keep_prob"], abs=0.01), (targets, r, far[d])
                assert all(far[d][f"{m}_gap"] == pytest.approx(r[f"{m}_gap"], abs=0.005) for m in mixing.MARGINS)
