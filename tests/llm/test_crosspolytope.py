import math

import numpy as np
import pytest
from data import INTERNAL, empty, with_internal_names

from quillspark.llm import crosspolytope as cp

SCHEMA = "vec_id long, embedding array<float>, label int"


def near_groups(seed=3, groups=25, d=24, label=3):
    """Chains and clouds around centres, some pairs just above and just below the limit."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=d)
        for _ in range(rng.integers(1, 9)):
            rows.append([float(np.float32(c)) for c in centre + rng.normal(size=d) * rng.choice([0.0, 0.1, 0.2, 0.3])])
    return [(i, v, i % label) for i, v in enumerate(rows)]


def plain(rows, least=0.93):
    """``{row number: (links, component)}`` from every pair."""
    n = len(rows)
    good = [v is not None and label is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v, label in rows]
    unit = [np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) if ok else None for ok, (_, v, _) in zip(good, rows, strict=True)]
    near = [[j for j in range(n) if j != i and good[i] and good[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= least] for i in range(n)]
    out = []
    for i in range(n):
        seen, queue = {i}, [i]
        while queue:
            new = set(near[queue.pop()]) - seen
            seen |= new
            queue += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(near[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def found(df, **options):
    rows = cp.near_duplicates(df, **options).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in rows), key=str)


AWKWARD = [
    (900, None, 1), (901, [], 1), (902, [0.0] * 24, 1), (903, [0.0] * 24, 1), (904, [math.nan] * 24, 1), (905, [1.0, None] * 12, 1), (906, [math.inf] * 24, 1), (907, [1.0] * 24, None), (908, [1.0] * 24, None),
    (909, [1.0] * 5, 1), (910, [1.0] * 5, 1), (911, [1.0] * 24, 1), (912, [3e38] * 24, 1), (913, [1e-38] * 24, 1), (914, [2.0], 2), (915, [0.5], 2), (916, [-0.5], 2), (None, [1.0] * 24, 1), (None, [-1.0] * 24, 1), (None, None, 1), (911, [1.0] * 24, 1),
]


def test_links_against_every_pair(spark):
    rows = near_groups() + AWKWARD
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_recall_at_the_limit(spark):
    """Pairs of cosine 0.93 to 0.94 in 64 dimensions, the hardest ones: nine of ten at least, by far."""
    rng = np.random.default_rng(8)
    a = rng.normal(size=(800, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(800, 64))
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.uniform(0.9302, 0.94, size=(800, 1))
    rows = [(2 * i + s, [float(x) for x in v], 1) for i, pair in enumerate(zip(a, c * a + np.sqrt(1 - c * c) * b, strict=True)) for s, v in enumerate(pair)]
    links = sum(n for _, n, _ in found(spark.createDataFrame(rows, SCHEMA)))
    assert sum(n for _, n, _ in plain(rows)) == 1600 and links >= 0.985 * 1600


@pytest.mark.parametrize(("block", "small", "chunk"), [(8, 32, 1 << 24), (1024, 2, 1 << 24), (5, 1, 1)])
def test_blocks_of_large_buckets_change_nothing(spark, block, small, chunk):
    """A hot group of near copies and one of exact copies, dealt as pairs of blocks."""
    rng = np.random.default_rng(9)
    centre = rng.normal(size=16)
    rows = [(i, [float(np.float32(c)) for c in centre + 0.02 * rng.normal(size=16)], 1) for i in range(60)]
    rows += [(100 + i, rows[0][1], 1) for i in range(50)] + [(200 + i, rows[1][1], 2) for i in range(50)] + near_groups(10, 8, 16)
    rows = [(i, v, label) for i, (_, v, label) in enumerate(rows)]
    assert found(spark.createDataFrame(rows, SCHEMA), hashing=cp.Hashing(block_rows=block, small=small, chunk_bytes=chunk)) == plain(rows)


def test_names_options_and_empty_tables(spark):
    rows = near_groups(11, 10)
    df = spark.createDataFrame(rows, SCHEMA)
    odd = with_internal_names(df.withColumnsRenamed({"vec_id": "id", "embedding": "v", "label": "label"})).withColumnRenamed("x", "kept")
    got = cp.near_duplicates(odd, id="id", column="v", least=0.8, hashing=cp.Hashing(tables=12, probes=6)).collect()
    assert sorted(((r["id"], r["n_links"], r["component_id"]) for r in got), key=str) == plain(rows, 0.8)
    assert all(r[n] == f"{n}:{r['id']}" for r in got for n in INTERNAL if n != "x")
    assert found(empty(spark, SCHEMA)) == []
    assert found(spark.createDataFrame([(1, None, None)], SCHEMA)) == [(1, 0, 1)]


def test_stars_reach_what_links_reach():
    path = np.zeros((5, 5), dtype=bool)
    for a, b in ((0, 2), (1, 3), (2, 3)):
        path[a, b] = path[b, a] = True
    a, b = cp._stars(path)
    assert a.tolist() == [0, 0, 0] and b.tolist() == [1, 2, 3]
