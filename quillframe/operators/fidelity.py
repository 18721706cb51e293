"""Fidelity of pages to their sources (PIP-1, PIP-2).

A claim is ranked only against the chunks of the sources it stands for, with each source's own statistics.  A source meets its claims in
blocks of about BLOCK, and what is compared stays in that row: no token is shuffled, and no large set of claims falls to one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import quantities as Q
from quillframe.functions.text import tokens
from quillframe.operators import units as U
from quillframe.operators.fulltext import B, K1
from quillframe.operators.ranking import chunk_texts, words
from quillframe.scratch import materialise

#: Below these a claim counts as weak; evidence of a claim on its own page, and of a claim that cites several sources.
BM25_FLOOR, COSINE_FLOOR, EVIDENCE, HITS, CITED_HITS = 1.0, 0.35, 3, 5, 10
PREVIEW = 500
#: Claims that meet their source in one row.
BLOCK = 64


def _mean(score: Column) -> Column:
    """The mean in millionths, rounded down: the same whatever the order of the sum."""
    micro = F.round(score * 1_000_000).cast("long")
    return F.floor(F.sum(micro) / F.count(micro)) / F.lit(1e6)


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` reads it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _count(held: Column, value: Column) -> Column:
    return F.size(held) - F.size(F.array_remove(held, value))


def _met(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """(stem, text, of: some of its claims) of each source (stem, text) that has claims (qid, stem, text, told)."""
    parts = materialise(claims.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("stem", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "fidelity-parts")
    parts_ = F.coalesce("parts", F.lit(1))
    asked = claims.select("stem", "qid", tokens(F.col("text")).alias("terms"), F.array_distinct(Q.numbers(Q.joined_thousands(F.col("told")))).alias("numbers")).join(parts, "stem", "left")
    of = asked.groupBy("stem", F.pmod(F.xxhash64("qid"), parts_).cast("int").alias("part")).agg(F.collect_list(F.struct("qid", "terms", "numbers")).alias("of"))
    # Rows of one claim are one claim, whose terms count as often.
    same = F.transform(F.array_distinct("of.qid"), lambda q: F.struct(q.alias("qid"), F.filter("of", lambda c: c["qid"] == q).alias("c")))
    of = of.select("stem", "part", F.transform(same, lambda g: F.struct(g["qid"].alias("qid"), F.flatten(g["c"]["terms"]).alias("terms"), F.array_distinct(F.flatten(g["c"]["numbers"])).alias("numbers"))).alias("of"))
    spread = sources.select("stem", "text").join(parts, "stem", "left").select("stem", "text", F.explode(F.sequence(F.lit(0), parts_ - 1)).alias("part"))
    return spread.join(of, ["stem", "part"]).drop("part")


def matched(claims: DataFrame, sources: DataFrame, k: int, most: int) -> DataFrame:
    """(qid, stem, hits, evidence, missing) of claims (qid, stem, text, told) whose source (stem, text) is there; stems of sources are unique.

    hits are the best k chunks (score, chunk_id, chunk) by BM25 within the source: a term that a claim repeats counts as often; chunks without any
    of its terms aren't hits; equal scores go to the earlier chunk.  evidence is the text of the first ``most``; missing are numbers of ``told`` of
    which neither the evidence nor the whole source has a form."""
    cut = _met(claims, sources).select("stem", "of", words(F.col("text")).alias("_w"), Q.all_forms(F.col("text")).alias("_whole"))
    cut = cut.select("stem", "of", "_whole", chunk_texts(F.col("_w")).alias("_chunks"))
    cut = cut.select("stem", "of", "_whole", "_chunks", F.transform("_chunks", tokens).alias("_tokens"))
    total = F.aggregate("_tokens", F.lit(0).cast("long"), lambda n, t: n + F.size(t))
    one = cut.select("stem", "_whole", "_chunks", "_tokens", (total / F.greatest(F.size("_tokens"), F.lit(1))).alias("_mean"), F.explode("of").alias("of")).select("*", "of.*").drop("of")
    # Of each chunk the claim's terms that it has; all of them together tell how many chunks have one.
    one = one.withColumn("_has", F.transform("_tokens", lambda t: F.array_intersect(t, F.col("terms")))).withColumn("_all", F.flatten("_has"))

    def score(t: Column, has: Column) -> Column:
        def part(w: Column) -> Column:
            df, tf = _count(F.col("_all"), w), _count(t, w)
            idf = F.log(1 + (F.size("_tokens") - df + 0.5) / (df + 0.5))
            return _count(F.col("terms"), w) * idf * _with(tf, lambda f: f * (K1 + 1) / (f + K1 * (1 - B + B * F.size(t) / F.col("_mean"))))

        return F.aggregate(has, F.lit(0.0), lambda s, w: s + part(w))

    ranked = F.transform(F.zip_with("_tokens", "_has", lambda t, h: F.when(F.size(h) > 0, F.round(score(t, h), 6))), lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
    one = one.withColumn("_best", F.slice(F.sort_array(F.filter(ranked, lambda r: r["s"].isNotNull())), 1, k))
    hits = F.transform("_best", lambda r: F.struct((-r["s"]).alias("score"), r["i"].alias("chunk_id"), F.get(F.col("_chunks"), r["i"]).alias("chunk")))
    one = one.select("qid", "stem", "numbers", "_whole", hits.alias("hits"))
    one = one.select("qid", "stem", "numbers", "_whole", "hits", F.array_join(F.slice("hits.chunk", 1, most), " ").alias("evidence"))
    lacking = lambda tokens_, have: F.filter(tokens_, lambda t: ~F.arrays_overlap(Q.forms(t), have))
    # Numbers of the evidence are looked up only for what the source doesn't have as such: words of two chunks may make a number of their own.
    one = one.select("qid", "stem", "hits", "evidence", lacking("numbers", F.col("_whole")).alias("_open"))
    missing = F.when(F.size("_open") > 0, _with(Q.all_forms(F.col("evidence")), lambda have: lacking("_open", have))).otherwise(F.col("_open"))
    return one.select("qid", "stem", "hits", "evidence", missing.alias("missing"))


def page_fidelity(claims: DataFrame, sources: DataFrame, cosines: DataFrame | None = None) -> DataFrame:
    """Each claim (stem, section, position, text, is_cross_ref) graded against its page's source (stem, text).

    top1_score and top3_mean (over the hits there are), the winning chunk and the first PREVIEW characters of it, the numbers and those that
    neither the best three chunks nor the source hold, whether it negates what they don't, and the greatest of ``cosines`` (stem, section,
    position, cosine) if given.  Cross references aren't graded."""
    key = F.concat_ws("\x1f", "stem", "section", F.col("position").cast("string"))
    asked = claims.where("not is_cross_ref").select(key.alias("qid"), "stem", "text", F.col("text").alias("told"))
    micro = F.transform(F.slice("hits.score", 1, EVIDENCE), lambda s: F.round(s * 1_000_000).cast("long"))
    mean = F.floor(F.aggregate(micro, F.lit(0).cast("long"), lambda n, x: n + x) / F.greatest(F.size(micro), F.lit(1))) / F.lit(1e6)
    first = F.get(F.col("hits"), F.lit(0))
    best = matched(asked, sources, HITS, EVIDENCE).select(
        "qid", first["score"].alias("top1_score"), F.when(F.size("hits") > 0, mean).alias("top3_mean"), first["chunk_id"].alias("top1_chunk_id"),
        F.substring(first["chunk"], 1, PREVIEW).alias("supporting_text"), Q.negates(F.col("evidence")).alias("_denied"), F.col("missing").alias("_missing"))
    out = claims.withColumn("qid", key).join(materialise(best, "fidelity-hits"), "qid", "left")
    hit = F.col("top1_score").isNotNull() & ~F.col("is_cross_ref")
    none = F.array().cast("array<string>")
    tokens_ = Q.numbers(Q.joined_thousands(F.col("text")))
    out = out.select(
        "stem", "section", "position", "text", "is_cross_ref", (~F.col("is_cross_ref")).alias("graded"),
        F.when(hit, F.col("top1_score")).otherwise(0.0).alias("top1_score"), F.when(hit, F.col("top3_mean")).otherwise(0.0).alias("top3_mean"),
        F.when(hit, F.col("top1_chunk_id")).otherwise(-1).alias("top1_chunk_id"), F.when(hit, F.col("supporting_text")).otherwise("").alias("supporting_text"),
        F.when(hit, tokens_).otherwise(none).alias("numeric_tokens"),
        F.when(hit, F.filter(tokens_, lambda t: F.array_contains(F.coalesce("_missing", none), t))).otherwise(none).alias("numeric_unmatched"),
        F.when(hit, Q.negates(F.col("text")) & ~F.col("_denied")).otherwise(False).alias("negation_mismatch"),
    )
    if cosines is None:
        return out.withColumn("semantic_score", F.lit(None).cast("double"))
    own = cosines.groupBy("stem", "section", "position").agg(F.max("cosine").alias("semantic_score"))
    return out.join(own, ["stem", "section", "position"], "left").withColumn("semantic_score", F.when(F.col("graded"), F.col("semantic_score")))


def _upper_median(rows: DataFrame, by: str, score: str, name: str) -> DataFrame:
    """(by, name): the value at place n // 2 of a group's sorted values, counted from sums by value instead of gathered."""
    per = rows.where(F.col(score).isNotNull()).groupBy(by, score).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(by).orderBy(score))
    of = F.sum("_n").over(Window.partitionBy(by))
    return per.withColumns({"_upto": upto, "_of": of}).where(F.col("_upto") > F.floor(F.col("_of") / 2)).groupBy(by).agg(F.min(score).alias(name))


def page_report(graded: DataFrame, order: Column | None = None) -> DataFrame:
    """One row a page: counts, mean and upper median of its graded claims, and the weakest, the first of equal ones."""
    place = order if order is not None else F.struct("section", "position")
    mine = graded.where("graded")
    sums = graded.groupBy("stem").agg(
        F.count(F.lit(1)).alias("n_claims"), F.count_if("graded").alias("n_graded"), F.count_if("is_cross_ref").alias("n_cross_refs"),
        F.coalesce(_mean(F.when(F.col("graded"), F.col("top1_score"))), F.lit(0.0)).alias("mean_top1"),
        F.min(F.when(F.col("graded"), F.struct(F.col("top1_score").alias("score"), place.alias("place"), "text"))).alias("_w"),
        F.count_if(F.col("graded") & (F.size("numeric_unmatched") > 0)).alias("n_with_numeric_drift"), F.count_if("negation_mismatch").alias("n_negation_mismatches"),
        F.round(F.avg(F.when(F.col("graded"), F.col("semantic_score"))), 6).alias("semantic_score"),
    )
    out = sums.join(_upper_median(mine, "stem", "top1_score", "median_top1"), "stem", "left").join(_upper_median(mine, "stem", "semantic_score", "semantic_median"), "stem", "left")
    return out.select(
        "stem", "n_claims", "n_graded", "n_cross_refs", "mean_top1", F.coalesce("median_top1", F.lit(0.0)).alias("median_top1"), F.col("_w.text").alias("weakest_claim"),
        F.col("_w.score").alias("weakest_score"), "n_with_numeric_drift", "n_negation_mismatches", "semantic_score", "semantic_median",
    )


def persisted(stored: DataFrame, graded: DataFrame, at: int, model: str | None = None) -> DataFrame:
    """``stored`` claims (stem, section, position, ..) with the grader's columns updated; claims that aren't stored are let go.

    Empty lists, texts and missing chunks become null; ungraded claims have no scores."""
    g, some = F.col("graded"), lambda c: F.when(F.size(c) > 0, F.to_json(c))
    told = graded.select(
        "stem", "section", "position", F.when(g, F.col("top1_score")).alias("bm25_top1"), F.when(g, F.col("top3_mean")).alias("bm25_top3_mean"),
        F.when(g & (F.col("top1_chunk_id") >= 0), F.col("top1_chunk_id")).alias("bm25_top1_chunk_id"), F.when(g & (F.col("supporting_text") != ""), F.col("supporting_text")).alias("supporting_text"),
        "semantic_score", F.when(F.col("semantic_score").isNotNull(), F.lit(model)).alias("embed_model"), F.col("negation_mismatch").cast("int").alias("negation_mismatch"),
        some("numeric_tokens").alias("numeric_tokens"), some("numeric_unmatched").alias("numeric_unmatched"), F.lit(at).cast("long").alias("last_graded_at"),
    )
    new = [c for c in told.columns if c not in ("stem", "section", "position")]
    kept = [F.col(f"s.{c}") for c in stored.columns if c not in new]
    met = F.col("g.last_graded_at").isNotNull()
    updated = [F.when(met, F.col(f"g.{c}")).otherwise(F.col(f"s.{c}") if c in stored.columns else F.lit(None)).alias(c) for c in new]
    on = [F.col(f"s.{c}") == F.col(f"g.{c}") for c in ("stem", "section", "position")]
    return stored.alias("s").join(told.alias("g"), on, "left").select(*kept, *updated)


def synthesis_fidelity(pages: DataFrame, sources: DataFrame, claims: DataFrame | None = None, cosines: DataFrame | None = None) -> DataFrame:
    """Each claim unit of pages (page, body) graded against all sources (stem, text) it cites.

    verdict is the first that holds: uncited (no source at hand), misattributed (a number that no cited source has), anchor_misattributed (a number that a cited
    claim of ``claims`` (stem, slug, text) lacks), composite (two sources and a comparison), weak, supported."""
    found = materialise(U.units(pages).where("claim").select("page", "unit", "line", "text"), "fidelity-units")
    cites = U.cited(found, U.footnotes(pages))
    cites = cites.join(sources.select("stem").distinct().withColumn("held", F.lit(True)), "stem", "left").withColumn("qid", F.concat_ws("\x1f", F.col("page").cast("string"), F.col("unit").cast("string")))
    cites = materialise(cites, "fidelity-cites")
    asked = cites.where("held").join(found, ["page", "unit"]).select("qid", "page", "unit", "stem", "place", "text", Q.without_citations(F.col("text")).alias("told"))
    best = matched(asked, sources, CITED_HITS, CITED_HITS).select("qid", "stem", F.get(F.col("hits"), F.lit(0))["score"].alias("score"), Q.negates(F.col("evidence")).alias("_denied"), "missing")
    best = materialise(best, "fidelity-hits")
    # A number is missing only if it is missing from every cited source.
    missing = best.select("qid", F.explode("missing").alias("token")).groupBy("qid", "token").agg(F.count(F.lit(1)).alias("lacking"))
    n_cited = cites.groupBy("page", "unit", "qid").agg(
        F.count_if("held").alias("n_cited"), F.array_sort(F.collect_list(F.when(F.col("held"), F.struct("place", "stem")))).alias("_c"), F.array_sort(F.collect_list(F.when(F.col("held").isNull(), F.struct("place", "stem")))).alias("_u"))
    missing = missing.join(n_cited.select("qid", "n_cited"), "qid").where("lacking = n_cited").groupBy("qid").agg(F.collect_list("token").alias("_missing"))
    negated = best.groupBy("qid").agg(F.max("_denied").alias("_denied"))
    best = best.where("score is not null").join(asked.select("qid", "stem", "place"), ["qid", "stem"]).groupBy("qid").agg(F.min(F.struct((-F.col("score")).alias("s"), "place", "stem")).alias("b"))
    out = found.join(n_cited, ["page", "unit"], "left").join(missing, "qid", "left").join(best, "qid", "left").join(negated, "qid", "left")
    if cosines is None:
        out = out.withColumn("best_semantic", F.lit(None).cast("double"))
    else:
        out = out.join(cosines.groupBy("page", "unit").agg(F.max("cosine").alias("best_semantic")), ["page", "unit"], "left")
    if claims is None:
        out = out.withColumn("_wrong", F.lit(None).cast("array<string>"))
    else:
        marks = U.anchors(found).join(claims.select("stem", "slug", F.col("text").alias("claim")), ["stem", "slug"]).join(found, ["page", "unit"])
        lacking = Q.unmatched(Q.numbers(Q.joined_thousands(Q.without_citations(F.col("text")))), Q.all_forms(F.col("claim")))
        wrong = marks.where(F.size(lacking) > 0).groupBy("page", "unit").agg(F.array_sort(F.collect_set(F.concat_ws("#", "stem", "slug"))).alias("_wrong"))
        out = out.join(wrong, ["page", "unit"], "left")
    none = F.array().cast("array<string>")
    plain = Q.numbers(Q.without_citations(F.col("text")))
    cited_ = F.coalesce("n_cited", F.lit(0)) > 0
    out = out.withColumns({"best_bm25": F.greatest(F.coalesce(-F.col("b.s"), F.lit(0.0)), F.lit(0.0)), "unmatched": F.filter(plain, lambda t: F.array_contains(F.coalesce("_missing", none), t))})
    verdict = (
        F.when(~cited_, "uncited").when(F.size("unmatched") > 0, "misattributed").when(F.col("_wrong").isNotNull(), "anchor_misattributed")
        .when((F.col("n_cited") >= 2) & Q.compares(F.col("text")), "composite")
        .when((F.col("best_bm25") < BM25_FLOOR) & (F.coalesce("best_semantic", F.lit(-1.0)) < COSINE_FLOOR), "weak").otherwise("supported")
    )
    return out.select(
        "page", "unit", "line", "text", F.coalesce(F.col("_c.stem"), none).alias("cited"), F.coalesce(F.col("_u.stem"), none).alias("unresolved"), F.col("b.stem").alias("best_stem"), "best_bm25", "best_semantic",
        F.when(cited_, F.col("unmatched")).otherwise(none).alias("numeric_unmatched"), (cited_ & Q.negates(F.col("text")) & ~F.coalesce("_denied", F.lit(False))).alias("negation_mismatch"), F.coalesce("_wrong", none).alias("wrong_anchors"), verdict.alias("verdict"),
    )


def synthesis_report(graded: DataFrame) -> DataFrame:
    """One row a page: how many claims of each verdict, and ok if none is misattributed."""
    n = {v: F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("supported", "weak", "composite", "misattributed", "anchor_misattributed", "uncited")}
    out = graded.groupBy("page").agg(F.count_if(F.col("verdict") != "uncited").alias("n_claims"), *n.values())
    return out.withColumn("ok", F.col("n_misattributed") + F.col("n_anchor_misattributed") == 0)
