"""The pipeline against its stages done by brute force, on a small corpus."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from quillframe.llm import quality
from tests.llm.test_near_dedup import brute
from tests.llm.test_operators import prose, water

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, norm int"


def corpus():
    rng = random.Random(21)
    texts = [prose(rng, rng.choice((60, 120, 300))) for _ in range(90)]
    near = []
    for _ in range(12):
        words = texts[0].split(" ")
        words[rng.randrange(len(words))] = "changed"
        near.append(" ".join(words))
    texts += near + [texts[1]] * 6 + [texts[2].replace(" ", "  ")] * 2 + ["too short"] * 3 + [None, ""] + [" ".join(w + "###" for w in prose(rng, 90).split()) for _ in range(3)]
    return [(i * 2, t, rng.choice(("en", "fr", None)), rng.choice(("a", "b", "b", None)), 1, "x", i) for i, t in enumerate(texts)]


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    from quillframe.llm.packing import vocabulary_path

    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        seen.append(docs)
    for df in seen[:-1]:
        assert df.columns == [c.split(" ")[0] for c in SCHEMA.split(", ")]
    text = {r[0]: r[1] for r in rows}
    told = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    left = {i for i, keep in told.items() if keep}
    assert {r.doc_id for r in seen[0].collect()} == left and len(left) < len(rows)
    firsts = {}
    for i in sorted(left):
        firsts.setdefault(re.sub(r"[ \t-\r]+", " ", text[i] or ""), i)
    assert {r.doc_id for r in seen[1].collect()} == set(firsts.values())
    parts = brute([(i, text[i]) for i in firsts.values()], 5, 80)
    kept = {i for i, (_, root) in parts.items() if i == root}
    assert {r.doc_id for r in seen[2].collect()} == kept
    size, source = {i: len((text[i] or "").split()) for i in kept}, {r[0]: r[3] for r in rows}
    sizes = defaultdict(int)
    for i in kept:
        sizes[source[i]] += size[i]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, water([sizes[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))], 3), strict=True))
    mixed, taken = Counter(r.doc_id for r in seen[3].collect()), defaultdict(int)
    for i, n in mixed.items():
        assert i in kept and n <= 3
        taken[source[i]] += n * size[i]
    assert all(abs(taken[s] - targets[s]) <= max(size[i] for i in kept if source[i] == s) + 1e-6 for s in order)
    t, want = Tokenizer.from_file(vocabulary_path()), Counter()
    for i, n in mixed.items():
        ids = [*t.encode(text[i] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want[i, k // 4096, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())] += n
    packed = seen[4].collect()
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed) == want
    filled = Counter()
    for r in packed:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 4096


def test_run_and_empty(spark, tmp_path):
    spark.createDataFrame(corpus()[:20], SCHEMA).write.parquet(str(tmp_path / "some" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "some")).count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
