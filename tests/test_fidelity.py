"""Quantities, units with their marks, and fidelity of pages to sources."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillframe.functions import quantities as Q
from quillframe.operators import fidelity, units


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [
    ("8 heads, 128nm, K562 and 3.22Å", ["8", "128", "3.22"]), ("1,024.50 or 350 K and 8.6M, 5 km", ["1,024.50", "350 K", "8.6M", "5"]), ("v1.2 a_3 .5", []), ("", []), (None, []),
])
def test_numbers(spark, text, want):
    assert one(spark, Q.numbers(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(("token", "want"), [("8,081.0", {"8081"}), ("350 K", {"350", "350000"}), ("8.6M", {"8.6", "8600000"}), ("0.500", {"0.5"}), ("1.5g", {"1.5", "1500000000"})])
def test_forms(spark, token, want):
    assert set(one(spark, Q.forms(F.lit(token)))) == want


@pytest.mark.parametrize(("text", "want"), [
    ("300 000 and 1 158 017", "300000 and 1158017"), ("2024 300 000", "2024 300000"), ("a (2023)73 524,000", "a (2023)73 524,000"), ("300 000, and", "300000, and"), ("1 000 000", "1000000"), ("8 heads 1000", "8 heads 1000"),
])
def test_joined_thousands(spark, text, want):
    assert one(spark, Q.joined_thousands(F.lit(text))) == want


def test_negation_dates_and_comparisons(spark):
    mismatch = lambda a, b: one(spark, Q.negation_mismatch(F.lit(a), F.lit(b)))
    assert mismatch("It does not work", "It works") and not mismatch("It does not work", "It can't work") and not mismatch("It works", "It doesn't") and mismatch("a lack of data", "knot") and not mismatch("nothing", "x")
    assert one(spark, Q.without_citations(F.lit("in [[a/b-2019|x]] 2048 and [^k-2020] on 2024-05-06 or 2024-05"))).split() == ["in", "2048", "and", "on", "or"]
    assert one(spark, Q.compares(F.lit("A is faster"))) and one(spark, Q.compares(F.lit("Outperforms it"))) and not one(spark, Q.compares(F.lit("A is fast")))


PAGE = """---
type: "idea"
---
# Title
A paragraph of at least eight words that goes on
over a second line with [[cat/known#res-1a]]

- bullet with enough words to count as a claim here
  - nested with [[plain|name]]
  goes on
- second bullet with enough words to count as a claim
1. numbered item with enough words to count as a claim
```
- code that is not a unit at all, long as it is
```
<!-- skip-grounding-start -->
Skipped text that would be a claim if anybody looked at it
<!-- skip-grounding-end -->
text <!-- with a
comment --> behind it and enough words to make it a claim [^n]

## Plans for later
This is assumed by the model without any paper to show *(model prior)*

## Other
This is assumed by the model without any paper to show *(model prior)*

Cites a claim that is gone and says so in these words [[known#res-9z]]

A heading link is plain and this is a claim of words [[known#Definition]]

I don't have any paper on this, as far as I can see it now
Is this a question of eight words or more than that?

## What would update this page
A paper that measures this for more than one of the models

## Notes
[^n]: see [[cat/known]]
[^m]: nothing
"""


def judged(spark, text, claims=(("known", "res-1a"),)):
    pages = spark.createDataFrame([(1, text)], "page int, body string")
    told = units.judged(units.units(pages), units.footnotes(pages), spark.createDataFrame(list(claims), "stem string, slug string"))
    return pages, told


def test_units_and_states(spark):
    _, told = judged(spark, PAGE)
    found = [(r.line, r.last, r.kind, r.state) for r in told.orderBy("unit").collect()]
    assert found == [
        (4, 4, "heading", "not-a-claim"), (5, 6, "paragraph", "grounded"), (8, 10, "bullet", "grounded"), (11, 11, "bullet", "ungrounded"), (12, 12, "bullet", "ungrounded"),
        (19, 20, "paragraph", "grounded"), (22, 22, "heading", "not-a-claim"), (23, 23, "paragraph", "model-prior"), (25, 25, "heading", "not-a-claim"),
        (26, 26, "paragraph", "ungrounded"), (28, 28, "paragraph", "dangling-anchor"), (30, 30, "paragraph", "grounded"), (32, 33, "paragraph", "not-a-claim"), (38, 38, "heading", "not-a-claim"), (39, 40, "paragraph", "not-a-claim"),
    ]
    lines = PAGE.split("\n")
    for r in told.collect():
        assert r.text.split("\n")[-1].strip() in lines[r.last - 1]


def test_marks_can_be_taken_back_and_grounded_pages_stay(spark):
    pages, told = judged(spark, PAGE)
    marked = units.annotated(pages, told).first().body
    assert marked.replace(units.UNGROUNDED, "").replace(units.PRIOR, "") == PAGE
    assert marked.count("⚠ ungrounded") == 4 and marked.count("⚠ model prior") == 1
    again = spark.createDataFrame([(1, marked)], "page int, body string")
    assert units.annotated(again, told).first().body == marked
    bare = units.stripped(pages, told).first().body
    assert bare.count(units.PLACEHOLDER) == 4 and f"- {units.PLACEHOLDER}" in bare and f"1. {units.PLACEHOLDER}" in bare and "nested with" in bare
    for text in ("", "# Only a heading\n", "Short.\r\n\r\nStill short.\n"):
        pages, told = judged(spark, text)
        assert units.annotated(pages, told).first().body == text == units.stripped(pages, told).first().body
    empty = spark.createDataFrame([(1, None)], "page int, body string")
    assert units.units(empty).count() == 0


def test_units_are_cut_once_for_both_texts(spark):
    texts = [(i, PAGE if i % 3 == 0 else "" if i % 3 == 1 else "# Only a heading\n") for i in range(2 * units.PAGES + 50)]
    pages = spark.createDataFrame(texts, "page int, body string")
    told = units.judged(units.units(pages), units.footnotes(pages), spark.createDataFrame([("known", "res-1a")], "stem string, slug string"))
    assert told.select("page").distinct().count() == sum(bool(t) for _, t in texts)
    for out in (units.annotated(pages, told), units.stripped(pages, told)):
        assert "MapInPandas" not in out._jdf.queryExecution().toString()
        got = {r.page: r.body for r in out.collect()}
        assert len(got) == len(texts) and all(got[i] == t for i, t in texts if i % 3) and len({got[i] for i, _ in texts if i % 3 == 0}) == 1


def test_cited_stems_in_order(spark):
    text = "Says [[b/x|name]] and [^n] and [[x]] then [[y#res-1a]] more\n\n[^n]: see [[old]]\n[^n]: see [[z]] and [[x]]\n"
    pages = spark.createDataFrame([(1, text)], "page int, body string")
    found = units.cited(units.units(pages).where("unit = 0"), units.footnotes(pages)).orderBy("place")
    assert [r.stem for r in found.collect()] == ["x", "y", "z"]


def ranked(claim, source, k=5):
    """Chunks of a source by BM25 with its own statistics, by hand."""
    words = source.split()
    cut = [words[i : i + 250] for i in range(0, max(len(words) - 250, 0) + 190, 190) if i == 0 or i + 60 < len(words)]
    cut = [" ".join(c) for n, c in enumerate(cut) if n == 0 or len(c) >= 30]
    ts = [re.findall(r"[^\W_]+", c.lower()) for c in cut]
    mean = sum(map(len, ts)) / len(ts)
    out = []
    for i, t in enumerate(ts):
        tf, score = Counter(t), 0.0
        for w in re.findall(r"[^\W_]+", claim.lower()):
            df = sum(w in x for x in ts)
            if tf[w]:
                score += math.log(1 + (len(ts) - df + 0.5) / (df + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / mean))
        if score:
            out.append((round(score, 6), i, cut[i]))
    return sorted(out, key=lambda x: (-x[0], x[1]))[:k]


def test_page_fidelity_ranks_within_the_own_source(spark):
    base = " ".join(f"w{i % 97} x{i % 13}" for i in range(600))
    sources = [("p", base + " the answer is 42 of 300 000 cells"), ("q", "w1 w2 w3 never 7"), ("r", "")]
    claims = [("p", "a", 0, "the answer is 42 or 300,000 or 43", False), ("p", "a", 1, "w5 x5 w5", False), ("q", "a", 0, "not w2 at 7.0", False), ("q", "a", 1, "[[p]] 12", True), ("r", "a", 0, "no text 5", False), ("q", "b", 0, "zzz 9", False)]
    got = fidelity.page_fidelity(spark.createDataFrame(claims, "stem string, section string, position int, text string, is_cross_ref boolean"), spark.createDataFrame(sources, "stem string, text string"))
    got = {(r.stem, r.section, r.position): r for r in got.collect()}
    for stem, section, position, text, ref in claims:
        hits = [] if ref else ranked(text, dict(sources)[stem])
        r = got[stem, section, position]
        assert (r.top1_score, r.top1_chunk_id) == ((hits[0][0], hits[0][1]) if hits else (0.0, -1)), (stem, text)
        assert r.top3_mean == pytest.approx(sum(h[0] for h in hits[:3]) / len(hits[:3]) if hits else 0.0, abs=1.1e-6)
        assert r.supporting_text == (hits[0][2][:500] if hits else "") and r.graded == (not ref)
    assert got["p", "a", 0].numeric_tokens == ["42", "300,000", "43"] and got["p", "a", 0].numeric_unmatched == ["43"]
    assert got["q", "a", 0].numeric_unmatched == [] and not got["q", "a", 0].negation_mismatch
    assert got["q", "a", 1].numeric_tokens == [] and got["q", "b", 0].numeric_unmatched == []


def test_page_fidelity_hands_on_a_row_a_claim_and_splits_large_sets(spark, monkeypatch):
    sizes, kept = {}, fidelity.materialise

    def counted(df, name):
        out = kept(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(fidelity, "materialise", counted)
    sources = spark.createDataFrame([("p", " ".join(f"w{i % 97} x{i % 13} {i}" for i in range(2000))), ("q", "w1 x1 7")], "stem string, text string")
    rows = [("p", "a", i, f"w{i % 97} w{i % 89} {i % 2500}", False) for i in range(500)] + [("q", "a", 0, "w1 12 7", False)] * 2
    claims = spark.createDataFrame(rows, "stem string, section string, position int, text string, is_cross_ref boolean")
    got = fidelity.page_fidelity(claims, sources).collect()
    assert len(got) == 502 and max(sizes.values()) <= 501  # no table of postings, a claim that is there twice is graded once
    assert all((r.top1_score, r.top1_chunk_id) == ranked(r.text, sources.where("stem = 'p'").first().text)[0][:2] for r in got if r.stem == "p" and r.position % 100 == 0)
    assert all(r.numeric_unmatched == ["12"] for r in got if r.stem == "q")
    keyed = claims.select(F.concat_ws("|", "stem", "position").alias("qid"), "stem", "text", F.col("text").alias("told"))
    held = [len(r.of) for r in fidelity._met(keyed, sources).where("stem = 'p'").collect()]
    assert sum(held) == 500 and len(held) == 8 and max(held) < 2 * fidelity.BLOCK


def test_page_report_and_persisted_scores(spark):
    rows = [("p", "s", i, f"c{i}", i == 3, i != 3, float(x), 0.0, i, "e", ["1"], ["1"] if i == 1 else [], i == 2, None) for i, x in enumerate((3, 1, 2, 0, 1))]
    graded = spark.createDataFrame(rows, "stem string, section string, position int, text string, is_cross_ref boolean, graded boolean, top1_score double, top3_mean double, top1_chunk_id int, supporting_text string, numeric_tokens array<string>, numeric_unmatched array<string>, negation_mismatch boolean, semantic_score double")
    r = fidelity.page_report(graded).first()
    assert (r.n_claims, r.n_graded, r.n_cross_refs, r.mean_top1, r.median_top1, r.weakest_claim, r.weakest_score, r.n_with_numeric_drift, r.n_negation_mismatches) == (5, 4, 1, 1.75, 2.0, "c1", 1.0, 1, 1)
    stored = spark.createDataFrame([("p", "s", 1, 9.0, "x"), ("p", "s", 3, 9.0, "x"), ("p", "s", 8, 9.0, "x")], "stem string, section string, position int, bm25_top1 double, note string")
    done = {r.position: r for r in fidelity.persisted(stored, graded, 5).collect()}
    assert (done[1].bm25_top1, done[1].numeric_unmatched, done[1].last_graded_at, done[1].note) == (1.0, '["1"]', 5, "x")
    assert (done[3].bm25_top1, done[3].bm25_top1_chunk_id, done[3].last_graded_at) == (None, None, 5) and (done[8].bm25_top1, done[8].last_graded_at) == (9.0, None)


def test_synthesis_verdicts(spark):
    sources = [("a", "alpha has 300 000 cells and alpha beta gamma delta words in it"), ("b", "beta has 12 cells and 99 rows but gamma is not there"), ("c", "")]
    claims = [("a", "res-1a", "alpha has 5 cells")]
    page = "\n\n".join([
        "Alpha beta has 300,000 cells in it and gamma delta words [[a]] [[b]]",          # either source will do
        "Alpha beta has 12 cells and 77 rows in it and more words [[a]] [[b]]",           # 77 is in neither
        "Alpha beta has 300 K cells in it and gamma delta words [[a#res-1a]]",            # in the paper, not in the claim
        "Alpha beta is faster than gamma delta words in it are now [[a]] [[b]]",          # compares two
        "Qqq www eee rrr ttt yyy uuu iii ooo ppp [[b]]",                                  # no word in common
        "Nobody at hand has said anything of this kind before [[gone]] at all",           # no source
        "Qqq www eee rrr ttt yyy uuu iii is not known [[c]]",                             # an empty source
    ])
    pages = spark.createDataFrame([(1, page)], "page int, body string")
    graded = fidelity.synthesis_fidelity(pages, spark.createDataFrame(sources, "stem string, text string"), spark.createDataFrame(claims, "stem string, slug string, text string"))
    got = graded.orderBy("unit").collect()
    assert [r.verdict for r in got] == ["supported", "misattributed", "anchor_misattributed", "composite", "weak", "uncited", "weak"]
    assert got[1].numeric_unmatched == ["77"] and got[2].wrong_anchors == ["a#res-1a"] and got[5].unresolved == ["gone"] and got[0].cited == ["a", "b"] and got[0].best_stem == "a" and got[6].negation_mismatch
    r = fidelity.synthesis_report(graded).first()
    assert (r.n_claims, r.n_supported, r.n_misattributed, r.n_anchor_misattributed, r.n_uncited, r.ok) == (6, 1, 1, 1, 1, False)
    near = spark.createDataFrame([(1, got[4].unit, 0.5)], "page int, unit int, cosine double")
    again = fidelity.synthesis_fidelity(pages, spark.createDataFrame(sources, "stem string, text string"), cosines=near).orderBy("unit").collect()
    assert [r.verdict for r in again] == ["supported", "misattributed", "supported", "composite", "supported", "uncited", "weak"]
