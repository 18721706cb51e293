"""Operators whose rules the catalogue's tables don't reach."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.operators import aggregates, concepts, fulltext, grading, graph, joins, lint, lookup, metrics, ranking, snapshots, vectors
from quillframe.sources import external, pages
from quillframe.streaming import events


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_lookup_rules(spark):
    with pytest.raises(ValueError):
        lookup.year_filter(F.col("y"), span=(2001, 1999))
    df = spark.createDataFrame([(None,), ("",), (" Todo ",), ("none",), ("10.1/x",)], "d string")
    assert [r.m for r in df.select(lookup.is_missing(F.col("d")).alias("m")).collect()] == [True, True, True, True, False]
    words = F.array(*[F.lit(w) for w in (" Alpha", "alpha", "beta", "a,b", "deny", "gamma", "delta", "x" * 51, "eps")])
    assert one(spark, lookup.clean_keywords(words, ["deny"])) == ["Alpha", "beta", "gamma", "delta", "eps"]
    assert one(spark, lookup.clean_keywords(F.array(F.lit("a"), F.lit("b")), [])) is None
    weak = lambda *a: one(spark, lookup.weak_claim(*[F.lit(x) for x in a]))
    assert weak(1, False, 0.9, 20.0) and weak(0, True, 0.9, 20.0) and weak(0, False, 0.39, 20.0) and weak(0, False, 0.54, 7.0)
    assert not weak(0, False, 0.56, 7.0) and not weak(None, None, 0.9, 20.0)


def test_prioritised_union_and_same_work(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 1)], "k string, v int"), spark.createDataFrame([("y", 2), ("z", 2)], "k string, v int")
    assert {(r.k, r.v, r.source_rank) for r in joins.prioritised_union([a, b], "k").collect()} == {("x", 1, 0), ("y", 1, 0), ("z", 2, 1)}
    reason = lambda *v: one(spark, joins.same_work_reason(*[F.lit(x) for x in v]))
    assert reason("Lee", "lee", 2020, 2021, 0.6) is None and reason("Lee", "Kim", 2020, 2020, 0.9) == "author"
    assert reason("Lee", "Lee", 2020, 2022, 0.9) == "year" and reason("Lee", "Lee", None, 2022, 0.4) == "title" and reason(None, "Lee", 2020, 2020, None) == "unjudgeable"


def test_paired_t_edges(spark):
    df = spark.createDataFrame([("one", 1.0), ("same", 2.0), ("same", 2.0), ("zero", 0.0), ("zero", 0.0)], "g string, d double")
    got = {r.g: (r.n, r.t, r.df) for r in df.groupBy("g").agg(*aggregates.paired_t(F.col("d"))).collect()}
    assert got == {"one": (1, 0.0, 0), "same": (2, float("inf"), 1), "zero": (2, 0.0, 1)}


def test_snapshot_versions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    snapshots.swap_in(df, str(tmp_path), "001")
    snapshots.swap_in(snapshots.upsert(df, spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), ["k"]), str(tmp_path), "002")
    assert {tuple(r) for r in snapshots.latest(spark, str(tmp_path)).collect()} == {(1, "b"), (2, "c")}
    held, todo = snapshots.cache_refresh(spark.createDataFrame([(1, "h"), (2, "n")], "k int, h string"), spark.createDataFrame([(1, "h", 5.0), (2, "o", 6.0)], "k int, h string, v double"), ["k"], "h")
    assert [tuple(r) for r in held.collect()] == [(1, "h", 5.0)] and [tuple(r) for r in todo.collect()] == [(2, "n")]


def test_edge_upsert_leaves_rejected(spark):
    s = "k int, status string, confidence double"
    old, new = spark.createDataFrame([(1, "rejected", 0.1), (2, "active", 0.2)], s), spark.createDataFrame([(1, "candidate", 0.9), (2, "candidate", 0.8), (3, "candidate", 0.7)], s)
    got = {r.k: (r.status, r.confidence, r.action) for r in snapshots.edge_upsert(old, new, ["k"]).collect()}
    assert got == {1: ("rejected", 0.1, "skipped"), 2: ("candidate", 0.8, "updated"), 3: ("candidate", 0.7, "inserted")}


def test_neighbours_filter_before_k_and_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, grp long")
    whole = {tuple(r) for r in vectors.top_k(df, df, 4, "other").collect()}
    assert whole == {tuple(r) for r in vectors.top_k(df, df, 4, "other", block_rows=7).collect()}
    pairs = {(r.a, r.b) for r in vectors.similar_pairs(df, 3.0, block_rows=9).collect()}
    want = {(i, j) for i, x, g in rows for j, y, h in rows if i < j and g != h and round(sum(a * b for a, b in zip(x, y, strict=True)), 6) >= 3.0}
    assert pairs == want


def test_fusion_is_one_sided_when_it_must(spark):
    s = "q int, k string, rank int"
    a, none = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], s), spark.createDataFrame([], s)
    assert [(r.k, r.rank) for r in ranking.fuse(a, none, ["q"], "k").orderBy("rank").collect()] == [("x", 1), ("y", 2)]


@pytest.mark.parametrize(("postings", "queries"), [(2_000_000, 16_384), (60, 4)])
def test_bm25_top_scores_in_blocks(spark, monkeypatch, postings, queries):
    """As all pairs, ties and own keys included, while no pair of a query and a document is a row of a shuffle."""
    monkeypatch.setattr(fulltext, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(fulltext, "PART_QUERIES", queries)
    rng = np.random.default_rng(1)
    rows = [(i, "ab"[i % 2], " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 12) % 40)) for i in range(60)]
    rows += [(i + 60, g, t) for i, g, t in rows[:20]]
    docs = spark.createDataFrame(rows, "d long, g string, t string").repartition(3)
    terms = fulltext.query_terms(docs.where("d % 7 = 0").select("d", F.concat("t", F.lit(" zz"))).toDF("d", "t"), "d", "t")
    every = fulltext.bm25(docs, terms, "d", F.col("t"))
    for others in (False, True):
        want = fulltext.top(every.where("qid <> d") if others else every, ["qid"], "d", 4)
        got = fulltext.bm25_top(docs, terms, "d", F.col("t"), 4, others_only=others)
        assert sorted(got.select("qid", "d", "score", "rank").collect()) == sorted(want.select("qid", "d", "score", "rank").collect())
        plan = got._jdf.queryExecution().toString()
        assert "FlatMapCoGroupsInPandas" in plan and "hashpartitioning(qid#" not in plan.split("FlatMapCoGroupsInPandas")[-1]
    want = fulltext.top(fulltext.bm25(docs, terms, "d", F.col("t"), "g"), ["qid", "g"], "d", 4)
    assert sorted(fulltext.bm25_top(docs, terms, "d", F.col("t"), 4, "g").select("qid", "g", "d", "score", "rank").collect()) == sorted(want.select("qid", "g", "d", "score", "rank").collect())
    want = fulltext.top(fulltext.token_count_score(docs, terms, "d", F.col("t")), ["qid"], "d", 4)
    assert sorted(fulltext.both_tops(docs, terms, "d", F.col("t"), 4)[1].select("qid", "d", "score", "rank").collect()) == sorted(want.select("qid", "d", "score", "rank").collect())


def test_bm25_of_empty_table(spark):
    docs = spark.createDataFrame([], "d long, t string")
    terms = fulltext.query_terms(spark.createDataFrame([(1, "a b")], "q long, t string"), "q", "t")
    assert fulltext.bm25(docs, terms, "d", F.col("t")).count() == 0


def test_chunks_tail(spark):
    df = spark.createDataFrame([(n, " ".join(["w"] * n)) for n in (0, 5, 250, 251, 279, 280, 440, 441, 500)], "n int, t string")
    got = {}
    for r in ranking.chunks(df, "n", "t").collect():
        got.setdefault(r.n, {})[r.chunk_id] = r.n_words
    assert got == {5: {0: 5}, 250: {0: 250}, 251: {0: 250, 1: 61}, 279: {0: 250, 1: 89}, 280: {0: 250, 1: 90}, 440: {0: 250, 1: 250}, 441: {0: 250, 1: 250, 2: 61}, 500: {0: 250, 1: 250, 2: 120}}


def test_metrics(spark):
    ranks = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3)], "qid int, key string, rank int")
    expected = spark.createDataFrame([(1, "b", "critical"), (1, "a", "nice"), (2, "z", "nice")], "qid int, key string, importance string")
    got = {r.qid: r for r in metrics.rank_metrics(ranks, expected).collect()}
    assert got[1].mrr == 0.5 and got[1].recall == 1.0 and abs(got[1].ndcg - 0.796716) < 1e-5
    assert got[2].mrr == 0.0 and got[2].critical_recall == 1.0 and got[2].hits == 0


def louvain_plain(nodes, edges, threshold):
    """The whole graph at once, written from the gain formula."""
    kept = [(a, b, w) for a, b, w in edges if w > threshold]
    m = sum(w for *_, w in kept) or 1.0
    k = {n: sum(w for a, b, w in kept if n in (a, b)) for n in nodes}
    home = {n: n for n in nodes}
    for _ in range(50):
        moved = False
        for n in sorted(nodes):
            to = {}
            for a, b, w in sorted(kept):
                if n in (a, b):
                    to[home[b if a == n else a]] = to.get(home[b if a == n else a], 0.0) + w
            sums = {c: sum(k[x] for x in nodes if home[x] == c) for c in {home[n], *to}}
            best, gain = home[n], 0.0
            for c in sorted(to):
                g = (to[c] - to.get(home[n], 0.0)) / m + k[n] * (sums[home[n]] - k[n] - sums[c]) / (2 * m) ** 2
                if c != home[n] and g > gain + 1e-12:
                    best, gain = c, g
            moved |= best != home[n]
            home[n] = best
        if not moved:
            break
    least = {}
    for n in sorted(nodes):
        least.setdefault(home[n], n)
    return {n: least[home[n]] for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_communities(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(min(a, b), max(a, b), round(rng.uniform(0.5, 3), 3)) for a, b in ((rng.randrange(14), rng.randrange(14)) for _ in range(22)) if a != b})
    edges = list({(a, b): (a, b, w) for a, b, w in edges}.values())
    nodes = range(16)
    got = graph.communities(spark.createDataFrame(edges, "a long, b long, w double"), spark.range(16).select("id"), 0.8)
    assert {r.id: r.community for r in got.collect()} == louvain_plain(nodes, edges, 0.8)


def test_two_triangles(spark):
    e = [(0, 1, 3.0), (1, 2, 3.0), (0, 2, 3.0), (3, 4, 3.0), (4, 5, 3.0), (3, 5, 3.0), (2, 3, 1.0)]
    got = {r.id: r.community for r in graph.communities(spark.createDataFrame(e, "a long, b long, w double"), spark.range(7).select("id")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6}


def test_components_of_chain_and_no_edges(spark):
    chain = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in graph.components(chain, spark.range(41).select("id")).collect()} == {0}
    assert graph.components(chain.limit(0), spark.range(3).select("id")).count() == 3


def test_links_resolve_by_stem(spark):
    links = spark.createDataFrame([("p", "a/x"), ("p", "y"), ("p", "nope")], "src string, link string")
    known = spark.createDataFrame([("a/x", "x"), ("b/y", "y"), ("a/y", "y")], "key string, stem string")
    good, broken = graph.resolve_links(links, known)
    assert {tuple(r) for r in good.collect()} == {("p", "a/x"), ("p", "a/y")} and [tuple(r) for r in broken.collect()] == [("p", "nope")]


def test_text_functions(spark):
    assert one(spark, T.numeric_tokens(F.lit("In 1,200 cases 3.50 of x9, v2.0 and 7. Of 12.00"))) == ["1200", "3.5", "7", "12"]
    assert one(spark, T.canonical_key(F.lit("graph-studies"))) == "graph-study" and one(spark, T.singular(F.lit("bus"))) == "bus"
    body = F.lit("# T\n## Summary\nshort one\n## Results\n- a **bold** [[x|shown]] claim\n# End\nno")
    assert one(spark, T.section(body, "results")) == "- a **bold** [[x|shown]] claim"
    assert one(spark, T.strip_markdown(F.lit("- a **bold** [[x|shown]] [t](u) claim"))) == "a bold shown t claim"
    assert one(spark, T.dois(F.lit("see 10.1000/AB-1. and (10.1000/ab-1), 10.22/no"))) == ["10.1000/ab-1"]
    assert one(spark, T.slugify(F.lit(" Ä b--C! "))) == "ä-b-c" and one(spark, T.negates(F.lit("This is not so"))) is True
    assert one(spark, T.sanitize_query(F.lit('a+(b) "c"  d'))) == "a b c d"


def test_grading(spark):
    v = lambda o, c, m: one(spark, grading.overlap_verdict(F.lit(o), F.lit(c), F.lit(m)))
    assert v(0.8, None, 0) == "match" and v(0.8, None, 1) == "partial" and v(0.1, 0.76, 0) == "match" and v(0.1, 0.51, 2) == "miss"
    q = lambda f, s, n: one(spark, F.round(grading.combined_quality(F.lit(f).cast("double"), F.lit(s).cast("double"), F.lit(n)), 6))
    assert q(0.8, 0.4, 10) == 0.6 and q(0.8, None, 10) == 0.8 and q(None, 0.4, 0) == 0.4 and q(0.8, 0.4, 0) == 0.8
    order = lambda *a: one(spark, grading.fidelity_verdict(*[F.lit(x) for x in a]))
    assert order(False, True, True, True, 9.0, 0.9) == "uncited" and order(True, True, True, True, 9.0, 0.9) == "misattributed"
    assert order(True, False, False, False, 0.5, 0.1) == "weak" and order(True, False, False, False, 0.5, 0.4) == "supported"


def test_merge_sources_keeps_best(spark):
    df = spark.createDataFrame([("k", "short", 1, 9, 1), ("k", "longer", 0, 3, 2), ("m", "x", 2, 4, 1)], "key string, term string, source_rank int, pages int, categories int")
    assert {tuple(r) for r in concepts.merge_sources(df).collect()} == {("k", "longer", 0, 9, 2), ("m", "x", 2, 4, 1)}


PAGE = """---
title: "A study"
keywords: [a, 'b', c]
tags:
  - one
  - two
year: 2020
---
# A study
## Results
- A first claim that is long enough [[p#q]]
- short
| Model | Score |
|---|---|
| Ours is better | 9.1 |
## Other
- not taken from here at all
"""


def test_pages(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.md").write_text(PAGE)
    (tmp_path / "y.md").write_text("no fence")
    p = pages.parsed(pages.scan(spark, str(tmp_path))).cache()
    r = p.select("stem", "fields", pages.list_field(F.col("fields")["keywords"]).alias("k"), pages.list_field(F.col("fields")["tags"]).alias("t")).collect()
    assert len(r) == 1 and r[0].stem == "x" and r[0].fields["title"] == "A study" and r[0].k == ["a", "b", "c"] and r[0].t == ["one", "two"]
    got = {(c.position, c.text, c.is_cross_ref) for c in pages.claims(p).collect()}
    assert (0, "A first claim that is long enough p#q", True) in got and (2, "Ours is better ; 9.1", False) in {(a, b.replace("; ", " ; "), c) for a, b, c in got} and len(got) == 3
    assert [tuple(x) for x in pages.links(p).collect()] == [("x", "p")]


def test_lint_pages(spark):
    df = spark.createDataFrame([("k", "paper", "paper", None, None, 2021, "lee-2020b-x", ["a"], "", "- (none)\n- real")], "key string, type string, folder string, doi string, no_doi_reason string, year int, stem string, keywords array<string>, hook string, body string")
    assert {r.rule for r in lint.report(lint.page_rules(df), "key").collect()} == {"missing-doi", "stem-year", "few-keywords", "missing-hook", "none-beside-bullets"}


def test_guarded_sql(spark):
    spark.range(3).createOrReplaceTempView("t3")
    assert external.read_only_sql(spark, "WITH a AS (SELECT id FROM t3) SELECT count(*) AS n FROM a WHERE id > 0 GROUP BY id ORDER BY 1 LIMIT 1").first().n == 1
    for bad in ("DROP VIEW t3", "CREATE TABLE x AS SELECT 1", "INSERT INTO t3 VALUES (1)", "SET a=b"):
        with pytest.raises(PermissionError):
            external.read_only_sql(spark, bad)
    with pytest.raises(Exception):  # noqa: B017, PT011
        external.read_only_sql(spark, "SELECT 1; SELECT 2")


def test_cache_expiry(spark, tmp_path):
    for name, raw in {"a": '{"fetched": "2024-01-01", "found": true, "v": 1}', "b": '{"fetched": "2024-01-01", "found": false}', "c": '{"fetched": "2024-02-20", "found": false}', "d": "{broken"}.items():
        (tmp_path / f"{name}.json").write_text(raw)
    load = lambda **k: external.cached_answers(spark, str(tmp_path), "fetched string, found boolean, v int", "2024-03-01", **k).count()
    assert load() == 2 and load(refresh_older=0) == 0 and load(refresh_older=15) == 1


def test_rendering_and_audit(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb"), (2, None)], "n int, s string")
    assert external.render(df) == "n\ts\n1\ta b\n2\t" and external.render(df, True).splitlines()[0] == '{"n":1,"s":"a\\tb"}'
    external.audit_snapshot(df, str(tmp_path), "2024-01-01")
    external.audit_snapshot(df.limit(1), str(tmp_path), "2024-02-01")
    assert external.latest_audit(spark, str(tmp_path)).count() == 1


def test_stream_goes_on_batch_by_batch(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 00:00:0{i % 10}", i % 2, "click", 1.0, "{}") for i in range(12)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.repartition(3).write.parquet(str(tmp_path / "in" / "events.parquet"))
    numbers = []
    stream = spark.readStream.schema(events.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))
    out = events.run_available(events.windowed(stream, "1 day"), "complete", lambda b, n: numbers.append(n))
    assert len(numbers) >= 3 and out.agg(F.sum("n")).first()[0] == 12


@pytest.mark.parametrize("most", [7, 400, 500_000])
def test_linked_components(spark, monkeypatch, most):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200)]
    star = [(1000, 1001 + i) for i in range(3000)] + [(4001 + i, 4000) for i in range(1, 50)] + [(4001, 3999)]
    links = spark.createDataFrame(chain + star, "a long, b long")
    got = [(r.id, r.root) for r in graph.linked_components(links, most=most).collect()]
    want = {**{i: 0 for i in range(61)}, 100: 100, 200: 100, **{i: 1000 for i in range(1000, 4051)}}
    assert len(got) == len(want) and dict(got) == want
    if most == 7:
        monkeypatch.setattr(graph, "ROUNDS", 0)
        with pytest.raises(RuntimeError):
            graph.linked_components(links, most=most)


def test_forest_equals_union_find():
    rng = random.Random(5)
    for n in (2, 30, 300):
        a, b = [np.array([rng.randrange(n) for _ in range(n)]) for _ in range(2)]
        above = {}

        def top(x, above=above):
            while x in above:
                x = above[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            x, y = sorted((top(x), top(y)))
            if x != y:
                above[y] = x
        node, root = graph.forest(a, b)
        assert dict(zip(node.tolist(), root.tolist())) == {x: top(x) for x in {*a.tolist(), *b.tolist()} if top(x) != x}


def test_run_available_goes_on(spark, tmp_path):
    row = lambda i: (i, datetime.datetime(2024, 1, 1, 0, i), 1, "view", 1.0, "{}")
    for part in (0, 1):
        spark.createDataFrame([row(part * 2), row(part * 2 + 1)], events.SCHEMA).write.parquet(str(tmp_path / "in" / f"p{part}"))
        (tmp_path / "log").mkdir(exist_ok=True)
        for k, file in enumerate((tmp_path / "in" / f"p{part}").glob("*.parquet")):
            file.rename(tmp_path / "log" / f"events-{part}-{k}.parquet")
        out = events.run_available(events.read_events(spark, str(tmp_path / "log")).select("event_id"), "append", folder=str(tmp_path / "run"))
        assert sorted(r.event_id for r in out.collect()) == list(range(2 * part + 2))
    assert len(list((tmp_path / "run" / "out").glob("batch=*"))) == 2


def test_mentions_shuffle_only_what_is_found(spark):
    rows = spark.createDataFrame([(1, "Of the Of the of"), (2, "a b c d e"), (3, None), (4, "of, the"), (5, "b c")], "id int, text string")
    terms = spark.createDataFrame([("of the",), ("OF THE",), ("b c d e",), ("a b c d e",), ("d",), ("",)], "term string")
    got = concepts.mentions(rows, "id", "text", terms)
    assert {tuple(r) for r in got.collect()} == {(1, "of the"), (1, "OF THE"), (4, "of the"), (4, "OF THE"), (2, "b c d e"), (2, "d")} and got.count() == 6
    assert concepts.mentions(rows, "id", "text", terms.limit(0)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_settling_holds_edges_in_files_whatever_the_frames(spark):
    rng = random.Random(3)
    edges = {(min(a, b), max(a, b)): round(rng.uniform(0.1, 2), 3) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(120)) if a != b}
    both = pd.DataFrame(sorted([(a, b, w) for (a, b), w in edges.items()] + [(b, a, w) for (a, b), w in edges.items()]), columns=["u", "v", "w"])
    frames = [both.iloc[i : i + 7] for i in range(0, len(both), 7)]
    told = pd.concat(graph._settle(iter(frames), sum(edges.values())))
    plain = louvain_plain(range(40), [(a, b, w) for (a, b), w in edges.items()], 0.0)
    assert dict(zip(told["id"], told["community"], strict=True)) == {n: plain[n] for n in set(both["u"])}
    assert list(graph._settle(iter([]), 1.0)) == []


@pytest.mark.parametrize(("postings", "terms_of_part"), [(2_000_000, 2_000_000), (60, 30)])
def test_bm25_fields_shuffle_no_posting(spark, monkeypatch, postings, terms_of_part):
    """As all pairs, ties, own keys, empty texts and queries without a hit included; the asked terms needn't be few."""
    monkeypatch.setattr(fulltext, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(fulltext, "PART_TERMS", terms_of_part)
    monkeypatch.setattr(fulltext, "TERMS_LIMIT", 0)
    written, materialise = [], fulltext.materialise
    monkeypatch.setattr(fulltext, "materialise", lambda df, name: written.append((name, df._jdf.queryExecution().executedPlan().toString())) or materialise(df, name))
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, 12) % 40) for _ in range(60)]
    docs = spark.createDataFrame([(3 * i, t) for i, t in enumerate([*texts, *texts[:20], None, ""])], "d long, t string").repartition(3)
    terms = fulltext.query_terms(docs.where("d % 7 = 0").select("d", F.concat("t", F.lit(" zz"))).unionAll(spark.createDataFrame([(-1, "nowhere")], "d long, t string")).toDF("d", "t"), "d", "t")
    every = fulltext.bm25(docs, terms, "d", F.col("t"))
    for others in (False, True):
        want = fulltext.top(every.where("qid <> d") if others else every, ["qid"], "d", 4)
        written.clear()
        got = fulltext.bm25_fields(docs, terms, "d", {"t": F.col("t")}, {"t": 1.0}, 4, others_only=others)
        assert [name for name, _ in written].count("bm25-postings") == 1
        assert all(plan.count("Exchange") <= plan.count("RoundRobin") for name, plan in written if name in ("bm25-postings", "bm25-best"))
        assert sorted(got.select("qid", "d", "score", "rank").collect()) == sorted(want.select("qid", "d", "score", "rank").collect())
    twice = fulltext.bm25_fields(docs, terms, "d", {"t": F.col("t"), "u": F.col("t")}, {"t": 1.0, "u": 2.0}, 4)
    assert all(abs(r.score / 3 - s.score) < 2e-6 for r, s in zip(twice.orderBy("qid", "rank").collect(), fulltext.top(every, ["qid"], "d", 4).orderBy("qid", "rank").collect(), strict=True))
    assert fulltext.bm25_fields(docs.limit(0), terms, "d", {"t": F.col("t")}, {"t": 1.0}, 4).count() == 0
    assert fulltext.bm25_fields(docs, terms.limit(0), "d", {"t": F.col("t")}, {"t": 1.0}, 4).count() == 0
