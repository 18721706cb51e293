import pytest
from pyspark.sql import functions as F

from quillframe.operators import claims as C
from quillframe.operators import edges as E
from quillframe.operators import records as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_authors_and_stems(spark):
    s = lambda a: one(spark, R.first_surname(F.lit(a)))
    assert s("Ludwig van Beethoven and Clara Schumann") == "van Beethoven" and s("Müller, Anna; Lee, B") == "Müller" and s("Li Wei et al.") == "Wei"
    assert s("The Atlas Consortium; Lee, B") == "The Atlas Consortium"
    assert one(spark, R.stem(F.lit("Müller, Anna"), F.lit(2020), F.lit("On the use of a big red barn"))) == "muller-2020-on-the-use-of-a-big"
    assert one(spark, R.fold(F.lit("Łódź Straße Ærø"))) == "lodz strasse aero"


def test_venues(spark):
    v = lambda a, b: one(spark, R.venue_agrees(F.lit(a), F.lit(b)))
    assert v("Nature Methods", "nature methods (online)") and v("J. Chem. Inf.", "Journal of Chemical Information") is False or v("Jour Chem Inf", "Journal Chemistry Information")
    assert v("PNAS", "Proceedings of the National Academy of Sciences") and not v("Cell", "Science") and v(None, "x") is False


def test_kinds_and_status(spark):
    k = lambda t, v=None, x=None: one(spark, R.paper_kind(F.lit(t), F.lit(v), F.lit(x)))
    assert k("A review of tools") == "review" and k("A tool for x") == "method" and k("X", None, "A randomised trial") == "trial" and k("X") == "research"
    st = lambda d, x: one(spark, R.publication_status(F.lit(d), F.lit(x), ["10.1101/"]))
    assert st("10.1101/1", "") == "preprint" and st("10.1/1", "RETRACTED ARTICLE") == "retracted" and st(None, None) == "unknown" and st("10.1/1", None) == "published"
    assert one(spark, R.retraction_status(F.array(F.lit("Journal Article"), F.lit("Retracted Publication")))) == "retracted"
    sig = R.commentary_signals(F.lit("Perspective\ntext"), F.lit("10.9/1"), F.lit(1), F.lit(5), ["10.1038/d"])
    assert one(spark, sig) == ["weak-label", "one-page"] and one(spark, R.is_commentary(sig)) is True
    unknown = R.commentary_signals(F.lit("Perspective\ntext"), F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int"), ["10.1038/d"])
    assert one(spark, R.is_commentary(unknown)) is False


def test_records(spark):
    df = spark.createDataFrame([([(2010, "old"), (None, "never"), (2020, "new"), (2020, "later")],)], "a array<struct<start_year:int,name:string>>")
    assert df.select(R.latest_affiliation(F.col("a")).alias("x")).first().x == "new"
    rec = spark.createDataFrame([((None, [[2019, 2]]),)], "r struct<print:array<array<int>>,online:array<array<int>>>")
    assert rec.select(R.record_year(F.col("r"), ["print", "online"]).alias("y")).first().y == 2019
    text = F.lit("Body Müller 2020\nReferences\n1. Müller A (2020). Title.\n")
    assert one(spark, R.cites_within(text, F.lit("Müller"), F.lit(2020))) and not one(spark, R.cites_within(text, F.lit("Lee"), F.lit(2020)))
    idx = R.doi_index(spark.createDataFrame([("10.1/A", "p1"), (" 10.1/a", "p2"), ("", "p3"), (None, "p4")], "doi string, key string"), "doi", "key")
    assert [tuple(r) for r in idx.collect()] == [("10.1/a", "p2")]
    assert R.crosslinks(spark.createDataFrame([("p2", "10.1/a"), ("p9", "10.1/A ")], "src string, doi string"), idx).count() == 1


def test_edges(spark):
    s = "id int, src string, tgt string, relation string, status string, updated_at int"
    e = spark.createDataFrame([(1, "a", "b", "supports", "active", 5), (2, "b", "c", "contradicts", "candidate", 7), (3, "c", "a", "supports", "active", 7)], s)
    assert [r.id for r in E.query(e, node="b").collect()] == [2, 1] and [r.id for r in E.query(e, relation="supports", status="active").collect()] == [3, 1]
    with pytest.raises(ValueError):
        E.query(e, relation="likes")
    assert {r.status for r in E.transition(e, F.col("id") == 2, "rejected").where("id = 2").collect()} == {"rejected"}
    refs = spark.createDataFrame([("s1", "synthesis", "a"), ("s1", "synthesis", "b"), ("i1", "idea", "a"), ("i1", "idea", "b")], "page string, kind string, stem string")
    assert [tuple(r) for r in E.pages_of_both_ends(e, refs, {"synthesis": 0, "idea": 1}).collect()] == [(1, "s1", "synthesis")]
    m = spark.createDataFrame([("h", "a", "x"), ("h", "b", "y"), ("h", "c", "x")], "hub string, stem string, category string")
    assert {tuple(r) for r in E.bridges(e, m).collect()} == {("h", "supports", "x / y", 1), ("h", "contradicts", "x / y", 1)}
    k, c = spark.createDataFrame([("a", None), ("b", None)], "stem string, slug string"), spark.createDataFrame([("a", "s2"), ("a", "s1")], "stem string, slug string")
    assert {tuple(r) for r in E.members(k, c).collect()} == {("a", "s1", "claim"), ("b", None, "keyword")}


def test_links_scores_and_backfill(spark):
    d = spark.createDataFrame([("p", "x"), ("p", "y"), ("p", "z")], "src string, link string")
    got = E.verified_links(d, spark.createDataFrame([("x",), ("y",)], "key string"), spark.createDataFrame([("p", "x")], "src string, link string"))
    assert {(r.link, r.state) for r in got.collect()} == {("x", "ok"), ("y", "unverified"), ("z", "broken")}
    b = E.back_links(spark.createDataFrame([("a", "b", "cites it"), ("c", "a", "near")], "src string, tgt string, note string"), spark.createDataFrame([("a", "c")], "src string, tgt string"))
    assert [tuple(r) for r in b.collect()] == [("b", "a", "cited by it")]
    cl = spark.createDataFrame([("s", 1, 0.5), ("s", 2, None)], "stem string, pos int, score double")
    out = E.persist_scores(cl, spark.createDataFrame([("s", 2, 0.9), ("t", 1, 0.1)], "stem string, pos int, score double"), ["stem", "pos"], ["score"])
    assert {(r.pos, r.score) for r in out.collect()} == {(1, 0.5), (2, 0.9)}
    f = E.backfill(spark.createDataFrame([(1, None), (1, "s"), (2, None)], "attempt int, stem string"), "attempt", "stem")
    assert sorted((r.attempt, r.stem or "") for r in f.collect()) == [(1, "s"), (1, "s"), (2, "")]
    t = E.tally(spark.createDataFrame([("p", "bad"), ("p", "good"), ("q", "good")], "page string, verdict string"), ["page"], ["bad", "good"])
    assert {(r.page, r.bad, r.good, r.ok) for r in t.collect()} == {("p", 1, 1, False), ("q", 0, 1, True)}
    miss = E.two_way_missing(spark.createDataFrame([("a", 1)], "f string, n int"), spark.createDataFrame([("b", 1)], "f string, n int"), ["f"])
    assert {tuple(r) for r in miss.collect()} == {("a", "missing"), ("b", "unlisted")}


def test_listed_anchors_of_one_doi_spread_over_tasks(spark, monkeypatch):
    for name, most in {"BLOCK_PAGES": 20, "BLOCK_ANCHORS": 10, "TASK_ROWS": 1000}.items():
        monkeypatch.setattr(C, name, most, raising=False)
    pages = [(k, "P2: 10.1234/hot. and 10.1234/hot again") for k in range(90)] + [(7, "10.1234/hot"), (1, "10.1234/cold, 10.1234/none"), (2, None), (3, "no DOI"), (None, "10.1234/cold")]
    anchors = [(k, "10.1234/hot") for k in range(110)] + [(5, "10.1234/hot"), (5, "10.1234/cold"), (None, "10.1234/cold"), (6, None), *[(k, "10.1234/unlisted") for k in range(50)]]
    told = lambda p, a: C.listed_anchors(spark.createDataFrame(p, "page long, text string"), spark.createDataFrame(a, "anchor long, doi string"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = told(pages, anchors).withColumn("task", F.spark_partition_id()).collect()
        none = [told(pages, []).count(), told([], anchors).count()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = [(d, p, a) for p, t in pages for d in sorted({w.strip(".,") for w in (t or "").split() if w.startswith("10.")}) for a, known in anchors if known == d]
    assert sorted(map(str, ((r.doi, r.page, r.anchor) for r in got))) == sorted(map(str, want)) and none == [0, 0]
    hot = [r.task for r in got if r.doi == "10.1234/hot"]
    assert len(hot) == 91 * 111 and max(map(hot.count, set(hot))) <= len(hot) / 3
