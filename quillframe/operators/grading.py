"""Grading (PIP, STR): overlap verdicts, numbers without support, extractiveness, quality blends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import text as T


def significant(text: Column) -> Column:
    return F.array_distinct(F.filter(T.tokens(text), lambda t: F.length(t) >= 4))


def overlap_verdict(overlap: Column, cosine: Column, missing_numbers: Column, match: float = 0.75, partial: float = 0.45, cos_match: float = 0.75, cos_partial: float = 0.50) -> Column:
    """match without missing numbers, partial with one at most, else miss; a null cosine counts as none."""
    c = F.coalesce(cosine, F.lit(0.0))
    return F.when(((overlap >= match) | (c >= cos_match)) & (missing_numbers == 0), "match").when(((overlap >= partial) | (c >= cos_partial)) & (missing_numbers <= 1), "partial").otherwise("miss")


def unmatched_numbers(claim: Column, evidence: Column) -> Column:
    return F.array_except(F.array_distinct(T.numeric_tokens(claim)), T.numeric_tokens(evidence))


def negation_mismatch(claim: Column, evidence: Column) -> Column:
    return T.negates(claim) & ~T.negates(evidence)


def extractiveness(pages: DataFrame, sources: DataFrame, n: int = 10) -> DataFrame:
    """(page, sentences, copied, ratio): sentences that share an n-gram with the page's source.

    Grams are hashed to 8 bytes and met by equality on (page, gram)."""
    s = pages.select("page", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).select("page", "pos", T.tokens(F.col("sentence")).alias("_w"))
    grams = s.select("page", "pos", F.explode(T.ngrams(F.col("_w"), n)).alias("g")).select("page", "pos", F.xxhash64("g").alias("g"))
    known = sources.select("page", T.tokens(F.col("text")).alias("_w")).select("page", F.explode(T.ngrams(F.col("_w"), n)).alias("g")).select("page", F.xxhash64("g").alias("g")).distinct()
    hit = grams.join(known, ["page", "g"], "left_semi").select("page", "pos").distinct().withColumn("hit", F.lit(1))
    told = s.select("page", "pos").join(hit, ["page", "pos"], "left")
    return told.groupBy("page").agg(F.count(F.lit(1)).alias("sentences"), F.count("hit").alias("copied")).withColumn("ratio", F.round(F.col("copied") / F.col("sentences"), 6))


def combined_quality(fidelity: Column, salience: Column, anchors: Column, w_fidelity: float = 0.5, confident: int = 10) -> Column:
    """A blend in which salience weighs as much as its anchors allow; one missing part leaves the other."""
    trust = (1 - w_fidelity) * F.least(F.coalesce(anchors, F.lit(0)) / confident, F.lit(1.0))
    return F.when(fidelity.isNull(), salience).when(salience.isNull(), fidelity).otherwise((w_fidelity * fidelity + trust * salience) / (w_fidelity + trust))


def improves(new: Column, old: Column, new_floor: Column, old_floor: Column, drift: Column, eps: float = 0.01, floor: float = 0.03) -> Column:
    """Better by eps, the weakest part no worse by more than the floor margin, and no drift."""
    return F.coalesce((new >= old + eps) & (new_floor >= old_floor - floor) & (drift == 0), F.lit(False))


def coherence(body: Column, n_links: Column, n_words: Column) -> Column:
    """Six structural checks, weighted."""
    has = lambda h: T.section(body, h) != ""
    checks = [(has("Summary"), 0.30), (has("Key Contributions"), 0.20), (has("Results"), 0.15), (has("Related Papers"), 0.15), (n_words.between(600, 4000), 0.10), (n_links * 40 >= n_words, 0.10)]
    total = F.lit(0.0)
    for ok, w in checks:
        total = total + F.when(F.coalesce(ok, F.lit(False)), w).otherwise(0.0)
    return F.round(total, 6)


def fidelity_verdict(cited: Column, misattributed: Column, anchor_wrong: Column, composite: Column, bm25: Column, cosine: Column) -> Column:
    """The first that holds: uncited, misattributed, anchor_misattributed, composite, weak, supported."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(~yes(cited), "uncited").when(yes(misattributed), "misattributed").when(yes(anchor_wrong), "anchor_misattributed").when(yes(composite), "composite")
        .when((F.coalesce(bm25, F.lit(0.0)) < 1.0) & (F.coalesce(cosine, F.lit(0.0)) < 0.35), "weak").otherwise("supported")
    )
