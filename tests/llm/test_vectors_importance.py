"""Hard negatives, embedding near-duplicates and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillframe.llm import embedding_dedup, hard_negatives, importance, registry

VECS = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def vectors(seed=3, n=400, dim=12, labels=4, noise=0.25):
    """Clusters of unlike size and spread, a third of all rows one vector, and odd rows."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        c = int(rng.integers(0, 12))
        v = centres[c] + rng.normal(size=dim) * noise * rng.random()
        v = v / np.linalg.norm(v)
        if i % 3 == 0:
            v = centres[0] / np.linalg.norm(centres[0])
        rows.append((i * 5, [float(np.float32(x)) for x in v], int(rng.integers(0, labels)) if i % 3 else 1))
    odd = [(None, [1.0] * dim, 1), (3001, None, 1), (3002, [1.0] * dim, None), (3003, [0.0] * dim, 1), (3004, [NAN] * dim, 1), (3005, [INF] * dim, 1), (3006, [None] * dim, 1), (3050, [], 1), (3100, [0.5] * 3, 2)]
    return rows + odd + [rows[1]]


def frame(spark, rows, schema=VECS, parts=5):
    return spark.createDataFrame(rows, schema).repartition(parts)


# ---- 11 hard negatives


def mined(rows, anchor, positives=5, negatives=3, scale=256):
    able = {}
    for i, v, label in sorted((r for r in rows if None not in r and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[2])):
        able.setdefault(i, (label, [math.floor(scale * x) for x in v]))
    out = set()
    for a, (label, v) in able.items():
        if anchor(a):
            score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in able.items()}
            alike = sorted((i for i in able if i != a and able[i][0] == label), key=lambda i: (-score[i], i))[:positives]
            for p in alike:
                fits = sorted((i for i in able if able[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]), key=lambda i: (-score[i], i))
                out |= {(a, p, k + 1, n, score[p], score[n]) for k, n in enumerate(fits[:negatives])}
    return out


@pytest.mark.parametrize("sizes", [(4_096, 4_096, 64), (7, 16, 9)])
def test_hard_negatives_equal_brute_force(spark, sizes):
    rows = vectors()
    group, block, pivots = sizes
    found = hard_negatives.hard_negatives(frame(spark, rows), F.col("id") % 25 == 0, group_rows=group, block_rows=block, pivots=pivots)
    told = [tuple(r) for r in found.collect()]
    assert len(told) == len(set(told))
    assert set(told) == mined(rows, lambda i: i % 25 == 0)
    assert told


def test_hard_negatives_of_large_components_stay_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-9e5, 9e5) for _ in range(4)], i % 3) for i in range(60)]
    found = hard_negatives.hard_negatives(frame(spark, rows, "vec_id long, embedding array<double>, label int"), F.col("id") % 10 == 0)
    assert {tuple(r) for r in found.collect()} == mined(rows, lambda i: i % 10 == 0)


def test_bounds_rule_out_far_clusters(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(16, 32))
    rows = []
    for i in range(800):
        v = centres[i % 16] / np.linalg.norm(centres[i % 16]) + rng.normal(size=32) * 0.005
        rows.append((i, [float(x) for x in v], i % 16))
    space = hard_negatives._Space(hard_negatives.quantised(frame(spark, rows, "id long, vec array<double>, label int"), 256).orderBy("id").limit(400).toPandas(), 32, 300.0**2, 16)
    assert len(space.pivots) == 16
    own = hard_negatives.quantised(frame(spark, rows, "id long, vec array<double>, label int"), 256).toPandas()
    d = space.anchors(own[:20])
    low, high = space.ranges(d, d.argmin(axis=1), np.zeros(20), np.sort(d, axis=1)[:, 0] + 10)
    assert (low <= high).mean() < 0.3


def test_hard_negatives_without_rows_or_with_clashing_columns(spark):
    columns = "id string, label2 int, v int, cell int, grp int, d int"
    none = spark.createDataFrame([], f"{VECS}, {columns}")
    assert hard_negatives.hard_negatives(none, F.col("id") % 50 == 0).collect() == []
    rows = vectors(n=60)
    wide = frame(spark, rows).withColumns({c: F.lit(1) for c in ("id", "vec", "v", "cell", "r", "grp", "block", "d", "rank", "score")})
    assert {tuple(r) for r in hard_negatives.hard_negatives(wide, F.col("id") % 50 == 0).collect()} == mined(rows, lambda i: i % 50 == 0)


# ---- 12 embedding near-duplicates


def linked(rows, threshold=0.93):
    """(links of each row, its component), by comparing all."""
    able = [k for k, (i, v, label) in enumerate(rows) if i is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {k: set() for k in range(len(rows))}
    unit = {k: np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k in able}
    for a in able:
        for b in able:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                near[a].add(b), near[b].add(a)
    root = {}
    for k in sorted(near, key=lambda k: (rows[k][0] is None, rows[k][0])):
        todo = [k]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = rows[k][0]
                todo += near[x]
    return near, root


@pytest.mark.parametrize("block", [2_048, 16])
def test_near_vectors_equal_brute_force(spark, block):
    rows = vectors(noise=0.3)
    near, root = linked(rows)
    found = embedding_dedup.near_vectors(frame(spark, rows), pivots=6, near=8, block_rows=block).collect()
    assert Counter(map(tuple, found)) == Counter((rows[k][0], len(near[k]), root[k], rows[k][0] == root[k]) for k in near)


@pytest.mark.parametrize("cosine", [0.935, 0.95, 0.98])
def test_recall_of_links(spark, cosine):
    """Pairs at a given cosine, 64 components: at least 0.9 of links, and none below the threshold."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(0, 3_000, 2):
        a, b = rng.normal(size=64), rng.normal(size=64)
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b = cosine * a + math.sqrt(1 - cosine**2) * b / np.linalg.norm(b)
        rows += [(i, a.tolist(), 0), (i + 1, b.tolist(), 0)]
    near, _ = linked(rows)
    found = embedding_dedup.near_vectors(frame(spark, rows, "vec_id long, embedding array<double>, label int")).collect()
    links = {r["vec_id"]: r["n_links"] for r in found}
    assert all(links[rows[k][0]] <= len(near[k]) for k in near)
    assert sum(links.values()) >= 0.95 * sum(map(len, near.values()))


def test_near_vectors_without_rows_or_with_clashing_columns(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], VECS)).collect() == []
    rows = vectors(n=60)
    near, root = linked(rows)
    wide = frame(spark, rows).withColumns({c: F.lit(1) for c in ("id", "vec", "node", "n", "h1", "u", "order", "pivot", "root")})
    found = embedding_dedup.near_vectors(wide).collect()
    assert Counter(map(tuple, found)) == Counter((rows[k][0], len(near[k]), root[k], rows[k][0] == root[k]) for k in near)


# ---- 13 importance resampling


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def grams(text, most):
    own = words_of(text)
    return [" ".join(own[i : i + n]) for n in range(1, most + 1) for i in range(len(own) - n + 1)]


TEXTS = ["Hello wörld, foo_bar 12a", None, "", "a", "A b", "x" * 1000 + " y " + "z" * 70, "-- é \U0001f600 ß", "one\ntwo\tthree", "\x00a\x7fb", "KK ſ"]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_combined_crcs_equal_those_of_the_strings(most):
    row, bucket, words = importance.features(pa.array(TEXTS), 10_000, most)
    want = sorted((i, zlib.crc32(g.encode()) % 10_000) for i, t in enumerate(TEXTS) for g in grams(t, most))
    assert sorted(zip(row.tolist(), bucket.tolist())) == want
    assert words.tolist() == [len(words_of(t)) for t in TEXTS]
    part = pa.array(["left out", *TEXTS]).slice(1)
    assert importance.features(part, 10_000, most)[1].tolist() == bucket.tolist()


def test_shift_matrices():
    rng = random.Random(2)
    for n in (1, 2, 3, 17, 256, 70_001):
        a, b = rng.randbytes(9), rng.randbytes(n)
        moved = importance.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([n]))
        assert int(moved[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def drawn(docs, target, buckets=10_000, most=2, least=20, percent=25, seed=7):
    """Every document's row by hand; documents with a null id share the empty one."""
    raw, want = Counter(), Counter()
    for _, text in docs:
        raw.update(zlib.crc32(g.encode()) % buckets for g in grams(text, most))
    for text in target:
        want.update(zlib.crc32(g.encode()) % buckets for g in grams(text, most))
    s, t = sum(raw.values()), sum(want.values())
    rows = []
    for i, text in docs:
        own = [zlib.crc32(g.encode()) % buckets for g in grams(text, most)]
        gain = [math.floor(1000 * math.log((want[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in own]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(words_of(text)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    ranks = {}
    for k, r in enumerate(able[: percent * len(able) // 100]):
        ranks.setdefault(r, []).append(k + 1)
    return Counter((*r, (ranks.get(r) or [None]).pop(0) if ranks.get(r) else None) for r in rows)


def test_importance_draw_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(vocabulary[: 40 if i % 4 else 300]) for _ in range(rng.choice((0, 5, 19, 20, 60, 200))))) for i in range(300)]
    docs += [(1000 + i, t) for i, t in enumerate(TEXTS)] + [docs[5]] * 3 + [(None, "same words all over " * 9)] * 40 + [(2000, "long " * 50_000)]
    target = [" ".join(rng.choice(vocabulary[:40]) for _ in range(30)) for _ in range(20)] + [None, ""]
    rows = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score int, rank int").repartition(4)
    found = importance.importance_draw(rows, spark.createDataFrame([(t,) for t in target], "text string"))
    assert Counter(map(tuple, found.collect())) == drawn(docs, target)


def test_importance_draw_of_empty_tables(spark):
    none, docs = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b " * 30), (2, None)], "doc_id long, text string")
    assert importance.importance_draw(none, docs).collect() == []
    assert Counter(map(tuple, importance.importance_draw(docs, none).collect())) == drawn([(1, "a b " * 30), (2, None)], [])


# ---- registered queries


def test_registered_queries_equal_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    moved = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    assert {tuple(r) for r in registry.QUERIES["op11_hard_negatives"](spark, folder).collect()} == mined(moved, lambda i: i % 50 == 0)
    near, root = linked(rows)
    found = registry.QUERIES["op12_embedding_dedup"](spark, folder).collect()
    assert Counter(map(tuple, found)) == Counter((rows[k][0], len(near[k]), root[k], rows[k][0] == root[k]) for k in near)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("text").collect()]
    want = Counter((i, n, w, s, r) for (i, _, n, w, s, r), k in drawn(docs, target).items() for _ in range(k))
    assert Counter(map(tuple, registry.QUERIES["op13_importance"](spark, folder).collect())) == want
