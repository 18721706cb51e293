"""Curation of pages (VEC, FLT, JOIN, PIP, SUB): index texts, category cascade, salience anchors, term claims, clean-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.functions.vectors import clamp01, dot

#: Sections that make a page's index text, by page type; other types take the body.
INDEX_SECTIONS = {"paper": ("Summary", "Key Contributions", "Results"), "concept": ("Definition", "Bridge"), "synthesis": ("Summary", "Synthesis")}
SECTION_WEIGHT = {"Summary": 3.0, "Key Contributions": 2.0, "Results": 1.0}


def without_section(body: Column, heading: str) -> Column:
    return F.regexp_replace(body, rf"(?ims)^##[ \t]+{heading}[ \t]*$.*?(?=^##?[ \t]|\z)", "")


def index_text(page_type: Column, title: Column, body: Column, keywords: Column) -> Column:
    """Title, the type's sections (or else the body without references), and keywords; blank parts are left out."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    sections = F.coalesce(*[F.when(page_type == kind, F.concat_ws("\n\n", *[blank(T.section(body, s)) for s in names])) for kind, names in INDEX_SECTIONS.items()])
    return F.concat_ws("\n\n", blank(title), F.coalesce(blank(sections), blank(without_section(body, "References"))), blank(F.array_join(keywords, ", ")))


def thin_reason(text: Column, title: Column, least: int = 200) -> Column:
    """empty, title-only, short, or null for a text fit to index."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t == "", "empty").when(t == F.trim(F.coalesce(title, F.lit(""))), "title-only").when(F.length(t) < least, "short")


def best_chunk(claims: DataFrame, chunks: DataFrame, by: str) -> DataFrame:
    """(claim_id, cosine, preview): each claim's best chunk of its own document; claims (by, claim_id, vec), chunks (by, chunk_id, vec, text)."""
    both = claims.select(by, "claim_id", F.col("vec").alias("_a")).join(chunks.select(by, "chunk_id", F.col("vec").alias("_b"), F.substring("text", 1, 200).alias("preview")), by)
    scored = both.select("claim_id", "preview", F.struct(F.round(clamp01(dot(F.col("_a"), F.col("_b"))), 6).alias("cosine"), (-F.col("chunk_id")).alias("first")).alias("r"))
    return scored.groupBy("claim_id").agg(F.max("r").alias("r"), F.max_by("preview", "r").alias("preview")).select("claim_id", F.col("r.cosine").alias("cosine"), "preview")


def suggested_category(model: Column, confidence: Column, valid: Column, neighbours: Column, neighbours_strong: Column) -> tuple[Column, Column]:
    """(category, strong): the model's unless it abstains (below 0.60) or names none, then the neighbours', else other; strong if
    both agree and the model is at 0.75, or if only the neighbours speak and are strong."""
    named = F.coalesce((confidence >= 0.60) & valid, F.lit(False))
    category = F.when(named, model).when(model.isNull(), F.coalesce(neighbours, F.lit("other"))).otherwise("other")
    strong = F.when(named, (model == neighbours) & (confidence >= 0.75)).when(model.isNull(), neighbours_strong).otherwise(False)
    return category, F.coalesce(strong, F.lit(False))


def should_retry(exit_code: Column) -> Column:
    """Unknown exits are retried; 1 and 3 are final."""
    return F.coalesce(~exit_code.isin(1, 3), F.lit(True))


def relation_of(verdict: Column) -> Column:
    v = F.lower(F.trim(verdict))
    return F.when(v.isin("contradiction", "contradicts", "conflict"), "contradicts").when(v.isin("agreement", "supports", "corroborates"), "supports").when(v.isin("extension", "extends", "refines"), "extends").when(v.isin("same", "duplicate", "same_as"), "same_as")


def in_span(year: Column, span: str) -> Column:
    """"2020", "2018-2021", "2018-" or "-2021"; a missing year is outside."""
    low, dash, high = span.partition("-")
    low_, high_ = int(low) if low else None, int(high) if high else (None if dash else int(low))
    ok = F.lit(True)
    if low_ is not None:
        ok = ok & (year >= low_)
    if high_ is not None:
        ok = ok & (year <= high_)
    return F.coalesce(ok, F.lit(False)) & year.isNotNull()


def term_claims(claims: DataFrame, terms: DataFrame) -> DataFrame:
    """(stem, term, section, position, slug, rank): claims that hold a term as whole words, best section first.

    Terms meet claims by equality of word n-grams, up to four words."""
    worded = claims.where(F.col("section").isin(*SECTION_WEIGHT)).withColumn("_w", T.tokens(F.col("text")))
    grams = F.concat(F.array_distinct("_w"), *[T.ngrams(F.col("_w"), n) for n in (2, 3, 4)])
    asked = terms.select("term", F.array_join(T.tokens(F.col("term")), " ").alias("_g")).where("_g <> ''")
    hit = worded.select("stem", "section", "position", "slug", F.explode(grams).alias("_g")).join(asked, "_g")
    weight = F.coalesce(*[F.when(F.col("section") == s, w) for s, w in SECTION_WEIGHT.items()])
    r = F.row_number().over(Window.partitionBy("stem", "term").orderBy(weight.desc(), "position"))
    return hit.withColumn("rank", r.cast("long")).select("stem", "term", "section", "position", "slug", "rank")


def instantiates(candidates: DataFrame, keywords: DataFrame, found: DataFrame) -> DataFrame:
    """Edges page -> concept for keywords that are a candidate's (by canonical key), at the best claim that names it, if any."""
    k = keywords.select("stem", T.canonical_key(T.slugify(F.col("keyword"))).alias("key")).distinct().join(candidates.select("key", "term"), "key")
    best = found.where("rank = 1").select("stem", "term", F.col("slug").alias("src_slug"))
    return k.join(best, ["stem", "term"], "left").select(F.col("stem").alias("src"), "src_slug", F.col("key").alias("tgt"), F.lit("instantiates").alias("relation"), F.when(F.col("src_slug").isNull(), "keyword").otherwise("claim").alias("by"))


def salience_anchors(docs: DataFrame, most_abstract: int = 12) -> DataFrame:
    """(stem, axis, importance, anchor): sentences a page should carry: the abstract's, critical; two from results; from the
    discussion two first and, marked as limitations, two last.  Sentences below six words are left out."""
    s = lambda c: F.filter(T.sentences(F.col(c)), lambda x: F.size(T.tokens(x)) >= 6)
    tag = lambda arr, axis, importance: F.transform(arr, lambda x: F.struct(F.lit(axis).alias("axis"), F.lit(importance).alias("importance"), x.alias("anchor")))
    discussion = s("discussion")
    tail = F.when(F.size(discussion) > 2, F.slice(discussion, -F.least(F.lit(2), F.size(discussion) - 2), F.lit(2))).otherwise(F.array().cast("array<string>"))
    every = F.concat(tag(F.slice(s("abstract"), 1, most_abstract), "headline", "critical"), tag(F.slice(s("results"), 1, 2), "results", "important"), tag(F.slice(discussion, 1, 2), "discussion", "nice"), tag(tail, "limitations", "important"))
    return docs.select("stem", F.explode(every).alias("a")).select("stem", "a.axis", "a.importance", "a.anchor")


def coverage_gaps(anchors: DataFrame, pages: DataFrame, least: float = 0.45) -> DataFrame:
    """Critical anchors whose significant words the page (stem, text) mostly lacks, and whether that calls for a revision."""
    j = anchors.where("importance = 'critical'").join(pages, "stem").withColumn("_s", F.array_distinct(F.filter(T.tokens(F.col("anchor")), lambda t: F.length(t) >= 4)))
    share = F.size(F.array_intersect("_s", T.tokens(F.col("text")))) / F.greatest(F.size("_s"), F.lit(1))
    gaps = j.where(share < least).groupBy("stem").agg(F.count(F.lit(1)).alias("gaps"))
    return gaps.withColumn("revise", F.col("gaps") >= 2)


def clean_rows(rows: DataFrame, by: str, tiers: list[str], most: int) -> DataFrame:
    """Rows (by, position, tier, text) with a known tier, the first of equal texts, by tier and position, at most ``most`` a group."""
    rank = F.coalesce(*[F.when(F.col("tier") == t, i) for i, t in enumerate(tiers)])
    fit = rows.withColumn("_t", rank).where("_t is not null").withColumn("_k", F.array_join(T.tokens(F.col("text")), " "))
    first = fit.withColumn("_n", F.row_number().over(Window.partitionBy(by, "_k").orderBy("position"))).where("_n = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("_t", "position")).cast("long")).where(F.col("place") <= most).drop("_t", "_k", "_n")


def flat_references(nested: Column) -> Column:
    """Distinct stems of a JSON text of references, nested or not, quoted or linked, in order."""
    bare = F.regexp_extract_all(nested, F.lit(r"[^\s\[\]\",']+"), F.lit(0))
    return F.array_distinct(F.transform(bare, lambda x: F.regexp_replace(F.element_at(F.split(x, "/"), -1), r"\.md$|#.*$", "")))
