"""Phrases, spokes and repaired ligatures."""

from pyspark.sql import functions as F

from quillframe.operators import phrases


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_lower_phrases(spark):
    found = lambda t: one(spark, phrases.lower_phrases(F.lit(t)))
    assert found("We use the prime editing and off-target  effects; a Base editing screen.") == ["prime editing", "off-target effects", "editing screen"]
    assert found("for the model of our design and full model, rare variants") == [] and found("") == []


def test_phrases_inside_longer_ones_count_once(spark):
    rows = spark.createDataFrame([(1, ["base editing screen", "editing screen", "editing screen"]), (2, ["editing screen"]), (3, ["base editing screen", "base editing screen"])], "k int, p array<string>")
    got = {r.phrase: (r.n, r.alone, r.texts) for r in phrases.phrase_counts(rows, "k", F.col("p")).collect()}
    assert got == {"base editing screen": (3, 3, 2), "editing screen": (3, 2, 2)}


def test_replaced_takes_repeats_and_neighbours(spark):
    new = F.create_map(F.lit("[a]"), F.lit("<A>"), F.lit("[b]"), F.lit(""))
    assert one(spark, phrases.replaced(F.lit("[a][a]x[c][b][a]"), r"\[[a-z]\]", new)) == "<A><A>x[c]<A>"
    assert one(spark, phrases.replaced(F.lit(""), r"\[[a-z]\]", new)) == ""


HUB = """---
referenced_papers: [x]
---
- [[cat/a]]
## How it appears across the corpus
- [[cat/a]] and - [[a]] and [[a]]
- [[a]]
- [[b#kc-1]] - [[c|c]]
-  [[d]]

## Next
- [[a]]
"""


def test_spokes(spark):
    claims = [("a", "res-2", 1, 0, "The Term is here"), ("a", "kc-9", 0, 3, "a term, again"), ("a", "kc-8", 0, 1, "midterm only"), ("d", "kc-1", 0, 0, "terms")]
    frame = spark.createDataFrame(claims, "stem string, slug string, section_rank int, position int, text string")
    hubs = spark.createDataFrame([("h", "term", HUB), ("n", " ", HUB), ("e", "term", "no section\n- [[a]]")], "hub string, term string, body string")
    got = {r.hub: r for r in phrases.upgraded_spokes(hubs, frame).collect()}
    want = HUB.replace("- [[cat/a]] and - [[a]] and", "- [[cat/a#kc-9]] and - [[a#kc-9]] and").replace("- [[a]]\n- [[b", "- [[a#kc-9]]\n- [[b")
    assert (got["h"].body, got["h"].upgraded, got["h"].skipped) == (want, 3, 1)
    assert (got["n"].body, got["n"].upgraded, got["n"].skipped) == (HUB, 0, 0) and got["e"].body == "no section\n- [[a]]"
    again = phrases.upgraded_spokes(spark.createDataFrame([("h", "term", want)], "hub string, term string, body string"), frame).first()
    assert (again.body, again.upgraded) == (want, 0)


def test_ligatures_are_restored_from_the_own_words(spark):
    rng = __import__("random").Random(2)
    base = ["efficient", "office", "off-target", "flow", "field", "offer", "find", "fund", "finding", "shelf", "refill", "finish", "flnish"]
    texts = [(i, " ".join(rng.choice(base) for _ in range(40))) for i in range(30)]
    damaged = [
        (100, "e\x83cient o\x83ice"), (101, "the \x83ow of a \x84\x84eld, o\x83-target re\x90ll"), (102, "eld cient unknown\x83word she lf"), (103, "E\x83cient \x83nding"), (104, "ow off nd nish"), (105, None), (106, ""),
    ]
    every = spark.createDataFrame(texts + damaged, "k int, t string")
    words = phrases.known_words(every, "t", 5)
    got = {r.k: r.t for r in phrases.repaired(every, "k", "t", phrases.repairs(every, "t", words)).collect()}
    assert got[100] == "efficient office" and got[103] == "Efficient finding"
    assert got[101] == "the flow of a field, off-target refill"
    # "eld" can only be "field"; "cient" has no one-ligature repair; unknown words stay.
    assert got[102] == "field cient unknown\x83word she lf"
    assert got[104] == "ow off nd nish" and got[105] is None and got[106] == ""  # two letters are too short; ambiguous ones stay
    assert all(got[k] == t for k, t in texts)
