import datetime

from pyspark.sql import functions as F

from quillframe.functions import values as V
from quillframe.operators import fulltext, grounding, migration


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_dates(spark):
    d = lambda *t: one(spark, V.any_date(*[F.lit(x) for x in t]))
    assert d("2024-03-05T10:00", "2020") == datetime.date(2024, 3, 5) and d("bad", "2020-02") == datetime.date(2020, 2, 1) and d(None, "1999") == datetime.date(1999, 1, 1) and d("x") is None
    assert one(spark, V.count_drift(F.lit(24), F.lit(20))) is False and one(spark, V.count_drift(F.lit(25), F.lit(20))) is True and one(spark, V.count_drift(F.lit(119), F.lit(100))) is False
    today = F.lit("2024-03-10").cast("date")
    assert one(spark, V.due(F.lit("2024-03-03").cast("date"), today)) is True and one(spark, V.due(F.lit("2024-03-04").cast("date"), today)) is False and one(spark, V.due(F.lit(None).cast("date"), today)) is True
    r = lambda s: one(spark, V.relative_time(F.lit(s)))
    assert [r(5), r(120), r(7300), r(90_000), r(70 * 86_400)] == ["just now", "2m ago", "2h ago", "1d ago", "2mo ago"]
    assert one(spark, V.age_days(F.lit(200_000), F.lit(100_000))) == 1 and one(spark, V.cutoff(F.lit(864_000), 2)) == 691_200


def test_json_and_claims(spark):
    j = lambda t: one(spark, V.json_in(F.lit(t)))
    assert j('so\n```json\n{"a": {"b": 1}}\n```\nthanks') == '{"a": {"b": 1}}' and j('it is {"a": 1} ok') == '{"a": 1}' and j("none") is None
    s = lambda t: one(spark, V.claim_slug(F.lit(t)))
    assert s("- The **model** improves [[x|results]] by 5.5%.") == s("the model improves results by 5.5%") != s("the model improves results by 5.6%")
    assert s("The model improves results").startswith("the-model-improves-results-")
    assert one(spark, V.claim_ref(F.lit("a"), F.lit("b"))) == "[[a#b]]" and one(spark, V.claim_ref(F.lit("a"), F.lit(None).cast("string"))) == "[[a]]"


def test_sentences_keywords_and_repair(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<string>")
    assert one(spark, V.first_and_last(arr("a", "b", "c", "d"), 2, 1)) == ["a", "b", "d"] and one(spark, V.first_and_last(arr("a", "b"), 2, 1)) == ["a", "b"] and one(spark, V.first_and_last(arr(), 2, 1)) == []
    assert one(spark, V.keyword_gap(arr("Graph theory", "cells"), F.lit("about GRAPH things"))) == ["cells"]
    assert one(spark, V.repaired_ligatures(F.lit("efﬁcient con-\ntrol\x07"))) == "efficient control"
    ratio, verdict = V.compression(F.lit("a b"), F.lit("w " * 400))
    assert one(spark, ratio) == 0.005 and one(spark, verdict) == "too short"
    assert one(spark, V.adaptive_cap(F.lit(60))) == 7 and one(spark, V.token_text(F.lit(1500))) == "1.5K"


BODY = """# Page
Intro paragraph goes over
two lines [[known#s]] with enough words to be a claim.

## Results
- A bullet that is long enough to count as one claim
  - nested evidence [[known]]
- short
- Is this a question that nobody will take for a claim?
```
- not this line inside the fence because it is code
```
- Something from the model alone is told here plainly (model prior)
- Another unsupported sentence with more than eight words in it
"""


def test_grounding(spark):
    u = grounding.units(spark.createDataFrame([("p", BODY), ("q", None)], "stem string, body string"))
    got = grounding.judged(u, spark.createDataFrame([("known",)], "key string")).orderBy("position").collect()
    assert [r.state for r in got] == ["not-a-claim", "grounded", "not-a-claim", "grounded", "not-a-claim", "not-a-claim", "model-prior", "ungrounded"]
    r = grounding.report(grounding.judged(u, spark.createDataFrame([("known",)], "key string"))).first()
    assert (r.claims, r.grounded, r.model_prior, r.ungrounded, r.coverage) == (4, 2, 1, 1, 0.5)


def test_migration(spark):
    pages = spark.createDataFrame([("p", {"Author(s)": "Lee", "authors": "Kim", "Pub Year": "c. 2020", "odd": "1"})], "stem string, fields map<string,string>")
    aliases = spark.createDataFrame([("author(s)", "authors"), ("authors", "authors"), ("pub_year", "year")], "alias string, key string")
    got = {r.key: (r.value, r.conflict) for r in migration.mapped_keys(pages, aliases).collect()}
    assert got == {"authors": (None, True), "year": ("c. 2020", False), "odd": ("1", False)}
    assert one(spark, migration.year_of(F.lit("c. 2020"))) == 2020 and one(spark, migration.year_of(F.lit("12020"))) is None
    heads = spark.createDataFrame([("p", 0, "Summary"), ("p", 1, "Abstract:"), ("p", 2, "Key points"), ("p", 3, "Other")], "stem string, position int, heading string")
    plan = migration.heading_plan(heads, spark.createDataFrame([("summary", "Summary"), ("abstract", "Summary"), ("key points", "Key Contributions")], "alias string, canonical string"))
    assert [r.how for r in plan.orderBy("position").collect()] == ["same", "merge", "rename", "unknown"]
    links = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, link string")
    assert {tuple(r) for r in migration.relinked(links, spark.createDataFrame([("b", "B")], "old string, new string")).collect()} == {("a", "B"), ("B", "c")}
    v = lambda *a: one(spark, migration.verdict(*[F.lit(x) for x in a]))
    assert [v(False, True, 0, 0, 0), v(True, True, 1, 0, 0), v(True, False, 1, 0, 0), v(True, False, 0, 0, 0), v(True, False, 0, 2, 2), v(True, False, 0, 3, 2)] == ["blocked", "duplicate", "needs-human", "compliant", "fixable", "needs-human"]


def test_filter_after_the_best(spark):
    scores = spark.createDataFrame([(1, i, float(10 - i)) for i in range(8)], "qid int, d int, score double")
    got = fulltext.top_then_filter(scores, ["qid"], "d", 2, spark.createDataFrame([(3,), (5,), (6,)], "d int"))
    assert [(r.d, r.rank) for r in got.orderBy("rank").collect()] == [(3, 1)]
