"""The exact joins and searches of vectors against all pairs: clusters, copies, ties, blocks, empty tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.operators import cells, similarity

SCHEMA = "news_id long, vector array<float>, u string, cell string, id int"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(c) for c in v], "u", "c", 1) for i, v in vectors], SCHEMA)


def units(spark, vectors):
    return table(spark, vectors).select(F.col("news_id").alias("id"), similarity.unit(F.col("vector")).alias("u")).where("u is not null")


def clustered(n, dims, clusters, spread, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dims))
    v = centres[rng.integers(clusters, size=n)] + spread * rng.standard_normal((n, dims))
    return list(enumerate(v.astype(np.float32)))


def plain(vectors, threshold):
    """(a, b) of all pairs by a loop over dimensions in order."""
    u = np.array([np.asarray(v, np.float32).astype(float) for _, v in vectors])
    norms = np.sqrt(np.cumsum(u * u, axis=1)[:, -1])
    u /= norms[:, None]
    total = np.zeros((len(u), len(u)))
    for d in range(u.shape[1]):
        total += u[:, d][:, None] * u[:, d][None]
    return total, {(i, j) for i, j in zip(*np.nonzero(total >= threshold), strict=True) if i < j}


@pytest.mark.parametrize("block", [8192, 40])
@pytest.mark.parametrize("spread", [0.15, 0.4, 3.0])
def test_join_is_all_pairs(spark, monkeypatch, block, spread):
    monkeypatch.setattr(cells, "BLOCK", block)
    vectors = clustered(600, 8, 12, spread)
    _, want = plain(vectors, 0.82)
    u = units(spark, vectors)
    got = [(r.a, r.b) for r in cells.join(u, 0.82).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    counts = np.bincount(np.array(sorted(want)).ravel(), minlength=600)
    assert {r.id: r.links for r in cells.join(u, 0.82, "counts").collect()} == {i: n for i, n in enumerate(counts.tolist()) if n}
    forest = [(r.a, r.b) for r in cells.join(u, 0.82, "forest").collect()]
    assert {tuple(sorted(e)) for e in forest} <= want

    def groups(edges):
        top = list(range(600))
        for _ in range(600):
            before = list(top)
            for a, b in edges:
                top[a] = top[b] = min(top[a], top[b])
            if before == top:
                return top

    assert groups(forest) == groups(want)


def test_pairs_at_the_threshold_itself(spark):
    """Angles just inside and outside, in all directions from a pivot."""
    t = np.arccos(0.82)
    vectors = [(k, (np.cos(a), np.sin(a))) for k, a in enumerate(np.concatenate([np.arange(12) * t, np.arange(12) * t * (1 + 1e-6), np.arange(12) * t * (1 - 1e-6)]))]
    _, want = plain(vectors, 0.82)
    assert {(r.a, r.b) for r in cells.join(units(spark, vectors), 0.82).collect()} == want


@pytest.mark.parametrize("block", [8192, 30])
def test_nearest_is_a_sort_of_all_rows(spark, monkeypatch, block):
    monkeypatch.setattr(cells, "BLOCK", block)
    vectors = clustered(400, 6, 7, 0.3) + [(400 + i, (1, 2, 3, 4, 5, 6)) for i in range(50)] + [(450, (-1, -2, -3, -4, -5, -6))]  # 50 equal vectors
    cosine, _ = plain(vectors, 2.0)
    t = table(spark, [*vectors, (900, None), (901, [0.0] * 6)])
    got: dict = {}
    for r in similarity.similar_topk(t, t.where("news_id % 50 = 0"), 7).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.news_id)
    want = {q: sorted((i for i in range(451) if i != q), key=lambda i: (-round(cosine[q, i], 9), i))[:7] for q in range(0, 451, 50)}
    assert got == want


def test_few_rows_and_none(spark):
    none = table(spark, [(1, None), (2, [0.0, 0.0])])
    assert similarity.similar_pairs(none).count() == similarity.similar_counts(none).count() == similarity.similar_topk(none, none).count() == similarity.similar_links(none).count() == 0
    two = table(spark, [(5, (1, 0)), (6, (2, 0)), (7, (1, 0.1))])
    assert {(r.a, r.b) for r in similarity.similar_pairs(two).collect()} == {(5, 6), (5, 7), (6, 7)}
    assert {r.news_id: (r.class_id, r.links) for r in similarity.similar_counts(two).collect()} == {5: (5, 1), 6: (5, 1), 7: (7, 1)}
    assert {(r.query_id, r.place, r.news_id) for r in similarity.similar_topk(two, two.where("news_id = 6"), 5).collect()} == {(6, 1, 5), (6, 2, 7)}


def test_bounds_leave_few_pairs_of_clusters_and_a_hot_group_is_no_pair_for_each(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 200)
    vectors = clustered(4000, 32, 60, 0.05)
    assert cells.candidates(units(spark, vectors), 0.82) < 4000 * 3999 / 2 / 8
    rng = np.random.default_rng(5)
    near = [(i, np.ones(16) + 0.001 * rng.standard_normal(16)) for i in range(1500)]  # all related to each other
    u = units(spark, near)
    assert {r.links for r in cells.join(u, 0.82, "counts").collect()} == {1499}
    assert cells.join(u, 0.82, "forest").count() < 1500 * 1499 / 2 / 10
