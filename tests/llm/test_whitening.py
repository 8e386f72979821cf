import math
import random

import numpy as np
from data import empty, with_internal_names

from quillspark.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=120, d=6, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ np.diag(np.arange(d, 0, -1) ** 1.5) * 0.1
    rows = [(i, [float(np.float32(c)) for c in v], i % 3) for i, v in enumerate(x)]
    return rows + [(500 + i, rows[i][1], 0) for i in range(30)] + [(600 + i, rows[7][1], 0) for i in range(40)]


def plain(rows, components=4):
    """Eigenvectors of the covariance of distinct integer vectors, deviations in Python's integers."""
    x = {i: tuple(math.floor(256 * c) for c in v) for i, v, _ in rows if v and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted(set(x.values()))
    n, d = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(d)]
    z = np.array([[n * v[j] - s[j] for j in range(d)] for v in fit], dtype=float) / n
    values, vecs = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-values)[:components]
    trace = sum(sum((n * v[j] - s[j]) ** 2 for j in range(d)) for v in fit) / n**3
    white = {i: [float(((np.array(v) - np.array(s) / n) @ vecs[:, o]) / math.sqrt(values[o])) for o in order] for i, v in x.items()}
    return n, {i: sum((n * v[j] - s[j]) ** 2 for j in range(d)) for i, v in x.items()}, white, [values[o] / trace for o in order]


def query(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(wh, "table", lambda *_: df)
    return wh.op12_whitening(spark, "").collect()


def test_components_against_a_dense_decomposition(spark, monkeypatch):
    rows = vectors() + [(1000, None, 1), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1002, [math.nan] * 6, 1), (1003, [math.inf] * 6, 1), (1004, [], 1), (1005, [1.0], 1), (None, [0.5] * 6, None)]
    n, deviations, white, explained = plain([r for r in rows if r[0] != 1005])
    found = query(spark, rows, monkeypatch)
    assert {r["vec_id"] for r in found} == set(deviations) and len(found) == 4 * len(deviations)
    sign = {c: math.copysign(1, next(r["whitened"] for r in found if r["vec_id"] == 3 and r["component"] == c) * white[3][c - 1]) for c in (1, 2, 3, 4)}
    for r in found:
        assert r["n"] == n and r["deviation"] == deviations[r["vec_id"]]
        assert abs(sign[r["component"]] * r["whitened"] - white[r["vec_id"]][r["component"] - 1]) < 1e-8
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-10 and r["identity_error"] < 1e-9


def test_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    n, deviations, white, explained = plain(rows)
    found = {(r["vec_id"], r["component"]): r for r in wh.op12_whitening(spark, sf).collect()}
    assert len(found) == 4 * len(rows)
    for c in (1, 2, 3, 4):
        sign = math.copysign(1, found[rows[0][0], c]["whitened"] * white[rows[0][0]][c - 1])
        assert all(abs(sign * found[i, c]["whitened"] - w[c - 1]) < 1e-7 and found[i, c]["deviation"] == deviations[i] for i, w in white.items())
        assert abs(found[rows[0][0], c]["explained"] / explained[c - 1] - 1) < 1e-9


def test_few_dimensions_and_no_variance(spark, monkeypatch):
    one_way = [(i, [0.1 * i, 0.2 * i, 0.0], 0) for i in range(9)]
    lines = query(spark, [(i, [float(i), 2.0 * i, 0.0], 0) for i in range(9)], monkeypatch)
    assert {r["component"] for r in lines} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in lines) and len(one_way) == len(lines)
    assert query(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], monkeypatch) == []
    assert query(spark, [(1, None, 0)], monkeypatch) == []
    assert {r["component"] for r in query(spark, [(i, [random.Random(i).random()], 0) for i in range(5)], monkeypatch)} == {1}
    huge = query(spark, [(1, [3e38, 1.0], 0), (2, [-3e38, 2.0], 0), (3, [0.0, 3.0], 0)], monkeypatch)
    assert {r["vec_id"] for r in huge} == {1, 2, 3} and all(r["deviation"] is None for r in huge if r["vec_id"] < 3)


def test_all_columns_and_rows_come_back(spark):
    rows = vectors(40) + [(1000, None, 1)]
    df = with_internal_names(spark.createDataFrame(rows, SCHEMA)).withColumnRenamed("_v", "whitened")
    found, model = wh.whiten(df, components=2)
    got = found.collect()
    assert len(got) == len(rows) and model.n == 40 and [r["whitened"] is None for r in got if r["vec_id"] == 1000] == [True]
    assert set(found.columns) == set(df.columns) | {"deviation"} and all(len(r["whitened"]) == 2 for r in got if r["vec_id"] != 1000)
    assert wh.whiten(empty(spark, SCHEMA))[0].count() == 0 and wh.whiten(empty(spark, SCHEMA))[1] is None
