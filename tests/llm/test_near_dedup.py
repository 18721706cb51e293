import random
import re

import numpy as np
import pytest

from quillframe.llm import near_dedup as N

SCHEMA = "doc_id long, text string, lang string"


def brute(docs, words, percent):
    """Component of each id: all pairs of full sets."""
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^ \t-\r]+", (text or "").encode().lower().decode())
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    above = {i: i for i in sets}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = top(a), top(b)
                above[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i)) for i in ids}


def made(seed, copies, changes):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(250)]
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(*changes)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w))
    return out


def test_matches_brute_force(spark):
    texts = made(1, 60, (0, 12)) + made(2, 40, (4, 30)) + made(3, 1, (0, 0)) * 5 + ["", None, "one", "one two", "ONE  two", "ä ö ü", "Ä ö ü", "x " * 4000, "x " * 300]
    docs = [(i * 7 % 1000, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "en") for i, t in docs], SCHEMA)
    for words, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, words=words, percent=percent).collect()}
        assert got == brute(docs, words, percent)


def test_cluster_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAST_BLOCK", 2_000)
    monkeypatch.setattr(N, "MOST_BLOCK", 3_000)
    docs = list(enumerate(made(5, 80, (2, 14))))
    df = spark.createDataFrame([(i, t, "en") for i, t in docs], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, words=3, percent=85).collect()}
    want = brute(docs, 3, 85)
    assert got == want
    assert len({c for _, c in want.values()}) > 1


def test_empty_repeated_and_null_ids(spark):
    assert N.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    text = made(9, 1, (0, 0))[0]
    df = spark.createDataFrame([(None, text, "a"), (4, text, "b"), (4, text, "b"), (2, text, None), (None, None, None)], SCHEMA)
    got = [(r.doc_id, r.component_id, r.kept) for r in N.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(None, None, True), (4, 2, False), (4, 2, False), (2, 2, True), (None, None, True)], key=str)
    assert N.drop_near_duplicates(df).count() == 3


def test_one_id_with_different_texts(spark):
    a, b = made(9, 1, (0, 0)) + made(10, 1, (0, 0))
    df = spark.createDataFrame([(3, a), (5, b), (5, a), (9, None), (7, b), (2, "alone")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df).collect())
    assert got == [(2, 1, 2, True), (3, 246, 3, True), (5, 246, 3, False), (5, 246, 5, True), (7, 246, 5, False), (9, 0, 9, True)]
    assert sorted((r.doc_id, r.text) for r in N.drop_near_duplicates(df.where("text is not null")).collect()) == sorted([(2, "alone"), (3, a), (5, b)])


def test_repeated_rows_in_clusters(spark):
    docs = list(enumerate(made(5, 30, (2, 14))))
    df = spark.createDataFrame(docs * 3, "doc_id long, text string")
    want = brute(docs, 3, 85)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(df, words=3, percent=85).collect()} == {(i, *v) for i, v in want.items()}


def test_extra_columns_survive(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 5)], "doc_id long, text string, id string, n int")
    assert N.drop_near_duplicates(df).columns == df.columns


def test_sketch_estimates_jaccard():
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2))
    for shared in (500, 1500, 2500):
        a, b = np.sort(pool[:shared + (3000 - shared) // 2]), np.sort(np.concatenate([pool[:shared], pool[shared + (len(pool) - shared) // 2 :]]))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = N.estimate(np.array([(N.sketch(a) == N.sketch(b)).mean()]), np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(got - j) < 0.15


@pytest.mark.parametrize("n", [1, 2, 7, 100, 5000])
def test_registers_are_full(n):
    hashes = np.sort(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    assert (N.sketch(hashes) > 0).all()
