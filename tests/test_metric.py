"""The metric index: the same rows as comparing all, with far fewer blocks on clustered vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.operators import vectors
from quillframe.operators.metric import Index


def clustered(n=600, clusters=12, dim=24, noise=0.03, stretch=0.0, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    out = []
    for i in range(n):
        v = centres[0 if i % 3 == 0 else i % clusters] + rng.normal(size=dim) * noise
        v = v / np.linalg.norm(v) * (1 + stretch * rng.random())
        out.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 5))))
    return out + [(n, out[0][1], 9), (n + 1, out[0][1], 9), (n + 2, [0.0] * dim, 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, vec array<float>, grp long").repartition(4)


def cosines(rows):
    m = np.array([v for _, v, _ in rows])
    return np.round(m @ m.T, 6)


@pytest.mark.parametrize(("block", "pivots", "stretch", "threshold"), [(50, 16, 0.0, 0.9), (7, 5, 0.8, 1.1), (2_000, None, 0.0, 0.5)])
def test_similar_pairs(spark, block, pivots, stretch, threshold):
    rows = clustered(stretch=stretch)
    cos = cosines(rows)
    want = {(a, b, float(cos[a, b])) for a in range(len(rows)) for b in range(a + 1, len(rows)) if rows[a][2] != rows[b][2] and cos[a, b] >= threshold}
    found = [tuple(r) for r in vectors.similar_pairs(frame(spark, rows), threshold, block, pivots).collect()]
    assert len(found) == len(set(found)) and set(found) == want and want


@pytest.mark.parametrize(("same_group", "positive", "block", "pivots"), [("any", True, 40, 16), ("other", True, 40, 16), ("other", False, 9, 4), ("any", False, 2_000, None)])
def test_top_k(spark, same_group, positive, block, pivots):
    rows = clustered(n=300, stretch=0.3)
    cos = cosines(rows)
    queries = [r for r in rows if r[0] % 7 == 0] + [rows[-1]]
    want = set()
    for q, _, g in queries:
        able = [r[0] for r in rows if r[0] != q and (same_group == "any" or r[2] != g) and (not positive or cos[q, r[0]] > 0)]
        for rank, i in enumerate(sorted(able, key=lambda i: (-cos[q, i], i))[:6]):
            want.add((q, i, rows[i][2], float(cos[q, i]), rank + 1))
    found = vectors.top_k(frame(spark, queries), frame(spark, rows), 6, same_group, positive, block, pivots)
    assert {tuple(r) for r in found.select("qid", "id", "grp", "cos", "rank").collect()} == want


def test_blocks_are_ruled_out_on_clustered_vectors(spark):
    rows = clustered(n=2_000, clusters=40, dim=64, noise=0.005)
    index = Index(frame(spark, rows), 50, 41)
    n = index.blocks.count()
    compared = index.block_pairs(0.9).count()
    assert n >= 40 and compared < 0.2 * n * (n + 1) / 2
    visits = index.visits(frame(spark, rows[:100]).withColumnRenamed("id", "qid"), lambda f: np.full(len(f), 0.3))
    assert visits.count() < 0.5 * 100 * n
    every = index.rows.select("id", "block").collect()
    assert len(every) == len(rows) and max(np.unique([r.block for r in every], return_counts=True)[1]) < 120


def test_empty_sides(spark):
    none, some = frame(spark, []), frame(spark, clustered(n=5))
    assert vectors.similar_pairs(none, 0.5).count() == 0
    assert vectors.top_k(none, some, 3).count() == 0 and vectors.top_k(some, none, 3).count() == 0
    assert vectors.top_k(some.withColumn("id", F.col("id") + 1000), some.limit(1), 3).count() == vectors.top_k(some, some.limit(1).withColumn("id", F.lit(-1).cast("long")), 3).count()


def test_top_k_rows_travel_by_group(spark, monkeypatch):
    """A vector goes to each group of queries once, not to every block or query; the result is that of comparing all."""
    monkeypatch.setattr(vectors, "GROUP_BLOCKS", 3)
    rows = clustered(n=400, clusters=7, noise=0.4)
    cos = cosines(rows)
    found = vectors.top_k(frame(spark, rows), frame(spark, rows), 4, "any", False, 20, 9)
    want = {(q, i, rows[i][2], float(cos[q, i]), rank + 1) for q in range(len(rows)) for rank, i in enumerate(sorted((x for x in range(len(rows)) if x != q), key=lambda i: (-cos[q, i], i))[:4])}
    assert {tuple(r) for r in found.select("qid", "id", "grp", "cos", "rank").collect()} == want
    assert "beside" in found._jdf.queryExecution().toString()


def test_similar_pairs_meet_by_group(spark, monkeypatch):
    """Rows travel once a group of blocks; pairs of all groups are found once each."""
    monkeypatch.setattr(vectors, "GROUP_BLOCKS", 2)
    rows = clustered(n=300, clusters=5, noise=0.3)
    cos = cosines(rows)
    want = {(a, b, float(cos[a, b])) for a in range(len(rows)) for b in range(a + 1, len(rows)) if rows[a][2] != rows[b][2] and cos[a, b] >= 0.2}
    pairs = vectors.similar_pairs(frame(spark, rows), 0.2, 15, 9)
    found = [tuple(r) for r in pairs.collect()]
    assert len(found) == len(set(found)) and set(found) == want and "lg" in pairs._jdf.queryExecution().toString()


def test_pairs_learn_of_groups_and_links_where_they_are_compared(spark, monkeypatch):
    monkeypatch.setattr(vectors, "GROUP_BLOCKS", 2)
    rng = np.random.default_rng(5)
    own = rng.normal(size=(60, 8))
    own /= np.linalg.norm(own, axis=1)[:, None]
    v = spark.createDataFrame([(i * 7 - 100, own[i].tolist(), i % 3) for i in range(60)], "id long, vec array<double>, grp long")
    ends = {(i * 7 - 100, int(j) * 7 - 100) for i in range(0, 60, 2) for j in rng.choice([x for x in range(60) if x != i], 3, replace=False)}
    links = spark.createDataFrame(sorted(ends), "src long, tgt long")
    pairs = vectors.similar_pairs(v, 0.2, block_rows=7, pivots=5, links=links)
    got = {(r.a, r.b): (r.cos, r.same, r.linked) for r in pairs.collect()}
    cos = np.round(own @ own.T, 6)
    near = [(i, j) for i in range(60) for j in range(i + 1, 60) if cos[i, j] >= 0.2]
    key = lambda i: i * 7 - 100
    assert got == {(key(i), key(j)): (cos[i, j], i % 3 == j % 3, bool({(key(i), key(j)), (key(j), key(i))} & ends)) for i, j in near}
    assert any(x[2] for x in got.values()) and pairs.count() == len(near)


def test_near_pairs_are_not_shuffled_for_their_signals(spark):
    from quillframe.plans import text_graph

    plan = text_graph._signals(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 1
    assert "Exchange" not in plan.split("FlatMapCoGroupsInPandas")[0]
