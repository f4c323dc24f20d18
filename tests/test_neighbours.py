"""Nearest vectors by pivots against brute force."""

import numpy as np
import pytest

from sparkbooks.operators import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, query string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "x") for i, v in vectors], SCHEMA)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    found = [(i, (centres[i % 12] + rng.normal(size=8) * 0.05).astype(np.float32)) for i in range(600)]
    found += [(1000 + i, found[7][1]) for i in range(300)]  # one large group of copies
    found += [(2000, -found[3][1]), (2001, found[3][1] * np.float32(2)), (7, found[7][1])]
    return found


def brute(queries, listings, k):
    unit = lambda x: np.asarray(x, float) / np.linalg.norm(np.asarray(x, float))
    out = []
    for q, v in queries:
        s = sorted((-round(float(unit(v) @ unit(x)), 12), i) for i, x in listings)[:k]
        out += [(q, i, round(-a, 9), n) for n, (a, i) in enumerate(s, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 16])
def test_search(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(nb, "BLOCK", block)
    odd = [(3000, None), (3001, [0] * 8), (3002, [1.0, None] + [0] * 6), (3003, [float("nan")] + [1] * 7), (3004, [float("inf")] + [1] * 7)]
    index = nb.Index(frame(spark, vectors + odd), pivots=30)
    asked = [v for v in vectors if v[0] % 50 == 0 or v[0] > 1295][:30]
    got = index.search(frame(spark, asked + odd), 7)
    assert sorted((r.query, r.id, round(r.similarity, 9), r.place) for r in got.collect()) == brute(asked, vectors, 7)
    one = nb.cosine_top_k(frame(spark, asked + odd), frame(spark, vectors + odd), 7)
    assert sorted((r.query, r.id, round(r.similarity, 9), r.place) for r in one.collect()) == brute(asked, vectors, 7)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    shares = [(r.compared, r.listings) for r in index.visited(frame(spark, asked), 7).collect()]
    assert len(shares) == len(asked) and all(n == len(vectors) for _, n in shares)
    assert sum(c for c, _ in shares) < 0.6 * sum(n for _, n in shares)  # clusters lie apart, so most are skipped


def test_few(spark, vectors):
    few = vectors[:3]
    got = nb.cosine_top_k(frame(spark, few), frame(spark, few), 5).collect()
    assert sorted((r.query, r.id, round(r.similarity, 9), r.place) for r in got) == brute(few, few, 5)
    assert nb.cosine_top_k(frame(spark, []), frame(spark, few), 5).collect() == []
    assert nb.cosine_top_k(frame(spark, few), frame(spark, []), 5).collect() == []


def test_voice_search(spark, vectors):
    voices = frame(spark, vectors[:40]).selectExpr("vec_id AS voice_id", "embedding", "concat('v', vec_id) AS voice_name")
    rows = nb.voice_search(frame(spark, vectors[:2]), voices, 2, query_col="vec_id").collect()
    assert sorted((r["query"], r.place, r.voice_name) for r in rows if r.place == 1) == [(0, 1, "v0"), (1, 1, "v1")] and len(rows) == 4
