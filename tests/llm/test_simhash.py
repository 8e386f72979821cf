import random

import numpy as np
import xxhash
from data import empty, frame, with_clashes
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import simhash
from quillspark.llm.components import connected_components


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (doc_id, fp); least id reachable over links of at most four bits."""
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                up[root(a)] = root(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return {(d, f): least.get(root(f)) for d, f in rows}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbB é \t\n\u00a0", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_awkward_documents(spark):
    df = with_clashes(frame(spark), "fingerprint", "component_id", "fp", "th")
    rows = [(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(df).collect()]
    texts = [(r["doc_id"], plain_fingerprint(r["text"])) for r in df.collect()]
    assert sorted(map(str, [(d, f) for d, f, _ in rows])) == sorted(map(str, texts))
    want = plain_components(texts)
    assert all(c == want[d, f] for d, f, c in rows)


def test_near_fingerprints_in_chains_and_clusters(spark):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(900):  # chains: each within four bits of an earlier one
        f = rng.choice(fps)
        for _ in range(rng.randint(1, 4)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in set(fps)], "fp long")
    roots = {r["a"] % 2**64: r["root"] for r in connected_components(simhash.fingerprint_links(df)).collect()}
    want = plain_components([(i, f) for i, f in enumerate(sorted(set(fps)))])
    groups, got = {}, {}
    for (_, f), c in want.items():
        groups.setdefault(c, set()).add(f)
    for f in set(fps):
        got.setdefault(roots.get(f, ("alone", f)), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 40)
    base = random.Random(9).getrandbits(63)
    fps = sorted({base ^ (1 << i) ^ (1 << j) for i in range(30) for j in range(i)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    assert connected_components(simhash.fingerprint_links(df)).select("root").distinct().count() == 1


def test_search_and_sweep_agree():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = np.unique(np.array([c ^ (np.uint64(1) << np.uint64(b)) ^ (np.uint64(1) << np.uint64(d)) for c in centres for b in range(5) for d in range(9)], dtype=np.uint64))
    sets = []
    for a, b in (simhash.search_links(fps), simhash.sweep_links(np.zeros(len(fps), dtype=int), fps)):
        want = plain_components([(i, int(f)) for i, f in enumerate(fps)])
        up = {int(f): int(f) for f in fps}

        def root(f, up=up):
            while up[f] != f:
                f = up[f]
            return f

        for x, y in zip(a, b, strict=True):
            up[root(int(x))] = root(int(y))
        sets.append(len({root(int(f)) for f in fps}))
    assert sets == [len(set(want.values()))] * 2


def test_one_of_each_group_stays(spark):
    df = frame(spark)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    found = simhash.near_duplicates(df)
    assert kept.count() == found.select("root").distinct().count()
    ids = {r["doc_id"] for r in kept.collect()}
    assert {r["component_id"] for r in found.filter(F.col("component_id").isNotNull()).collect()} <= ids


def test_empty(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.drop_near_duplicates(empty(spark)).count() == 0


def test_more_blocks_lose_no_link(spark):
    rng = random.Random(12)
    fps = [rng.getrandbits(64) for _ in range(120)]
    for _ in range(240):
        f = rng.choice(fps)
        for _ in range(4):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    want = plain_components([(i, f) for i, f in enumerate(sorted(set(fps)))])
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in set(fps)], "fp long")
    for blocks in (7, 8):
        assert sum(simhash.block_widths(blocks)) == 64
        roots = {r["a"] % 2**64: r["root"] for r in connected_components(simhash.fingerprint_links(df, blocks)).collect()}
        assert len({roots.get(f, ("alone", f)) for f in set(fps)}) == len(set(want.values()))
