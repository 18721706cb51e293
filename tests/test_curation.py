from pyspark.sql import functions as F

from quillframe.operators import curation as C


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_index_text(spark):
    body = "## Summary\ns1\n## References\nr\n## Results\nr1\n"
    t = lambda kind: one(spark, C.index_text(F.lit(kind), F.lit("T"), F.lit(body), F.array(F.lit("k1"), F.lit("k2"))))
    assert t("paper") == "T\n\ns1\n\nr1\n\nk1, k2" and "r\n" not in t("note") and t("note").startswith("T\n\n## Summary")
    r = lambda x: one(spark, C.thin_reason(F.lit(x), F.lit("T")))
    assert [r(None), r(" T "), r("short"), r("x" * 200)] == ["empty", "title-only", "short", None]


def test_category_cascade(spark):
    def cascade(*v):
        category, strong = C.suggested_category(*[F.lit(x) for x in v])
        return one(spark, category), one(spark, strong)

    assert cascade("a", 0.8, True, "a", True) == ("a", True) and cascade("a", 0.8, True, "b", True) == ("a", False)
    assert cascade("a", 0.5, True, "b", True) == ("other", False) and cascade("a", 0.9, False, "b", True) == ("other", False) and cascade(None, None, None, "b", True) == ("b", True)


def test_small_rules(spark):
    assert [one(spark, C.should_retry(F.lit(x).cast("int"))) for x in (0, 1, 2, 3, None)] == [True, False, True, False, True]
    assert one(spark, C.relation_of(F.lit(" Conflict "))) == "contradicts" and one(spark, C.relation_of(F.lit("x"))) is None
    y = lambda s, v=2020: one(spark, C.in_span(F.lit(v).cast("int"), s))
    assert y("2020") and y("2018-2021") and y("2020-") and y("-2020") and not y("2021-") and not y("2018-2021", None)
    assert one(spark, C.flat_references(F.lit('["a", ["papers/b.md", "[[c#x]]"], a]'))) == ["a", "b", "c"]


def test_best_chunk(spark):
    claims = spark.createDataFrame([("d", 1, [1.0, 0.0])], "doc string, claim_id int, vec array<double>")
    chunks = spark.createDataFrame([("d", 0, [0.0, 1.0], "no"), ("d", 1, [0.9, 0.1], "yes"), ("e", 0, [1.0, 0.0], "other")], "doc string, chunk_id int, vec array<double>, text string")
    assert [tuple(r) for r in C.best_chunk(claims, chunks, "doc").collect()] == [(1, 0.9, "yes")]


def test_terms_and_edges(spark):
    claims = spark.createDataFrame([("p", "Results", 0, "Deep nets help", "s0"), ("p", "Summary", 3, "We use deep nets here", "s1"), ("p", "Other", 0, "deep nets", "s2"), ("q", "Summary", 0, "a deepnet", "s3")], "stem string, section string, position int, text string, slug string")
    found = C.term_claims(claims, spark.createDataFrame([("Deep nets",)], "term string"))
    assert [(r.slug, r.rank) for r in found.orderBy("rank").collect()] == [("s1", 1), ("s0", 2)]
    e = C.instantiates(spark.createDataFrame([("deep-net", "Deep nets")], "key string, term string"), spark.createDataFrame([("p", "Deep Nets"), ("q", "deep net")], "stem string, keyword string"), found)
    assert {(r.src, r.src_slug, r.tgt, r.by) for r in e.collect()} == {("p", "s1", "deep-net", "claim"), ("q", None, "deep-net", "keyword")}


def test_salience(spark):
    line = lambda k: f"Sentence {k} has quite many long words inside."
    docs = spark.createDataFrame([("p", " ".join(map(line, "ab")), line("c"), " ".join(map(line, "defg")) + " Too short.")], "stem string, abstract string, results string, discussion string")
    a = C.salience_anchors(docs).cache()
    assert [(r.axis, r.n) for r in a.groupBy("axis").agg(F.count(F.lit(1)).alias("n")).orderBy("axis").collect()] == [("discussion", 2), ("headline", 2), ("limitations", 2), ("results", 1)]
    gaps = C.coverage_gaps(a, spark.createDataFrame([("p", "nothing of it")], "stem string, text string")).first()
    assert (gaps.gaps, gaps.revise) == (2, True)


def test_clean_rows(spark):
    rows = spark.createDataFrame([("g", 0, "low", "Same text"), ("g", 1, "high", "same  TEXT!"), ("g", 2, "high", "b"), ("g", 3, "odd", "c"), ("g", 4, "high", "d")], "g string, position int, tier string, text string")
    assert [(r.position, r.place) for r in C.clean_rows(rows, "g", ["high", "low"], 2).orderBy("place").collect()] == [(2, 1), (4, 2)]
