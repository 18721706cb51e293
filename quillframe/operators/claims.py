"""Claims, anchors and the event log (FLT, TOP, SNK, AGG, SUB, PIP, STR, LNT): look-ups, sinks and work lists as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.operators import fulltext
from quillframe.scratch import materialise

# Roles that may stand in the event log, types that count as papers, what typesetting prints for a venue, and DOIs that are templates.
ROLES = (
    "reconcile", "extract", "target_claims", "crosslinks", "author", "grade", "grade_persist", "tournament", "critic", "debug", "short_name",
    "keywords", "commit", "memory_evolve", "pdf_upgrade", "claim_support",
)
PAPER_TYPES = ("paper", "commentary")
PAGE_TYPE_FOLDERS = ("concept", "synthesis", "digest")
FURNITURE = ("journal of latex class files", "latex class files", "manuscript submitted to", "submitted to", "to appear in", "preprint", "unpublished", "in preparation")
PLACEHOLDER_DOI = r"(?i)^10\.[0-9]{4,9}/(?:[nx]{4,}(?:[._-][nx]{4,})*|0+(?:[._-]0+)*|(?:doi|todo|tbd|xxx|placeholder))$"
#: Pages and anchors of a DOI that a block holds, rows (read and made) that a task is for, and how many tasks there are at most.
BLOCK_PAGES, BLOCK_ANCHORS, TASK_ROWS, MOST_TASKS = 4_000, 1_000, 4_000_000, 2_000


def paper_like(kind: Column, folder: Column, is_root: Column, kinds: tuple[str, ...] = PAPER_TYPES) -> Column:
    """A page of one of these types (none or an empty one is a paper, quotes around it don't count), outside the folders of page types, and not
    a root page."""
    bare = F.regexp_replace(F.trim(F.coalesce(F.nullif(kind, F.lit("")), F.lit("paper"))), "^[\"']+|[\"']+$", "")
    return bare.isin(*kinds) & ~F.coalesce(folder, F.lit("")).isin(*PAGE_TYPE_FOLDERS) & ~is_root


def invalid_categories(pages: DataFrame, folders: DataFrame) -> DataFrame:
    """Pages whose category is neither a folder of contents nor "other"; pages in a folder of page types are let be."""
    known = folders.select(F.col("folder").alias("category")).where(~F.col("folder").isin(*PAGE_TYPE_FOLDERS)).distinct()
    checked = pages.where(~F.col("folder").isin(*PAGE_TYPE_FOLDERS) & (F.coalesce("category", F.lit("")) != "other"))
    return checked.join(known, "category", "left_anti")


def venue_suspect(venue: Column) -> Column:
    """What typesetting prints where a venue should stand."""
    v = F.lower(F.trim(venue))
    hit = F.lit(False)
    for f in FURNITURE:
        hit = hit | v.contains(f)
    return F.coalesce(hit, F.lit(False))


def placeholder_doi(doi: Column) -> Column:
    """A DOI whose suffix is a template's: runs of n or x, zeros, or a word for nothing."""
    return F.coalesce(F.trim(doi).rlike(PLACEHOLDER_DOI), F.lit(False))


def resolve_anchors(asked: DataFrame, claims: DataFrame) -> DataFrame:
    """``asked`` (stem, slug) with the claim's text, null where no claim has that anchor."""
    return asked.join(claims.select("stem", "slug", F.col("text").alias("claim")), ["stem", "slug"], "left")


def claim_lookup(claims: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): claims (id, text, semantic, bm25, is_cross_ref) by full text, then semantic score, then own BM25 (both 0 if null), then
    id; cross references aren't looked up, but count in the statistics."""
    terms = fulltext.query_terms(queries, "qid", "text")
    scores = fulltext.bm25(claims, terms, "id", F.col("text"))
    joined = scores.join(claims.where("not is_cross_ref").select("id", F.coalesce("semantic", F.lit(0.0)).alias("semantic"), F.coalesce("bm25", F.lit(0.0)).alias("bm25")), "id")
    order = [F.desc("score"), F.desc("semantic"), F.desc("bm25"), F.col("id")]
    return joined.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)).cast("long")).where(F.col("rank") <= k).select("qid", "id", "score", "rank")


def resolve_mode(asked: str, has_vectors: bool, has_text_index: bool) -> str:
    """The mode that the indexes at hand allow: both make hybrid, else vectors; full text is what is left."""
    if asked not in ("auto", "hybrid", "semantic", "bm25"):
        raise ValueError(f"unknown mode {asked}")
    if asked == "bm25" or not has_vectors:
        return "bm25"
    return "semantic" if asked == "semantic" or not has_text_index else "hybrid"


def missed_anchors(anchors: DataFrame, importance: list[str], k: int = 5) -> DataFrame:
    """The first missed anchors (id, axis, importance, verdict) by importance, axis and id."""
    rank = F.coalesce(*[F.when(F.col("importance") == v, i) for i, v in enumerate(importance)], F.lit(len(importance)))
    return anchors.where("verdict = 'miss'").orderBy(rank, "axis", "id").limit(k)


def recent(pages: DataFrame, changed: str, key: str, k: int) -> DataFrame:
    return pages.orderBy(F.desc(changed), key).limit(k)


def pending(inputs: DataFrame, runs: DataFrame, key: str, final: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Inputs that neither succeeded (exit 0) nor failed for good."""
    return inputs.join(runs.where(F.col("exit").isin(0, *final)).select(key), key, "left_anti")


def common_keywords(members: DataFrame, by: str, least: int = 2) -> DataFrame:
    """(by, keyword, members, place): keywords that at least so many members of a group share, commonest first."""
    n = members.groupBy(by, "keyword").agg(F.countDistinct("member").alias("members")).where(F.col("members") >= least)
    return n.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("members"), "keyword")).cast("long"))


def means(scores: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean of each column and the number of rows; nulls count in neither."""
    return scores.groupBy(*by).agg(*[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in columns], F.count(F.lit(1)).alias("n"))


def append_events(log: DataFrame, new: DataFrame, roles: tuple[str, ...] = ROLES) -> tuple[DataFrame, DataFrame]:
    """(the log with the new rows of a known role, the refused rows); empty scores, ``{}``, become null."""
    known = F.coalesce(F.col("role").isin(*roles), F.lit(False))
    scores = F.when(F.regexp_replace("scores", r"\s", "") != "{}", F.col("scores"))
    return log.unionByName(new.where(known).withColumn("scores", scores)), new.where(~known)


def rebuild(pages: DataFrame, claims: DataFrame, fresh_pages: DataFrame, fresh_claims: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, claims, deleted stems) of a full rebuild: what is on disk, claims of papers only; stems gone from disk cascade."""
    deleted = pages.select("stem").join(fresh_pages.select("stem"), "stem", "left_anti")
    papers = fresh_pages.where("kind = 'paper'").select("stem")
    return fresh_pages, fresh_claims.join(papers, "stem", "left_semi"), deleted.unionByName(claims.select("stem").distinct().join(fresh_pages.select("stem"), "stem", "left_anti")).distinct()


def mark_covered(stems: DataFrame, log: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger rows to add for stems that the log knows and the ledger doesn't: stem, events."""
    seen = log.where("stem is not null").groupBy("stem").agg(F.count(F.lit(1)).alias("events"))
    return stems.select("stem").join(seen, "stem").join(ledger.select("stem"), "stem", "left_anti")


def count_graded(claims: DataFrame, stems: DataFrame) -> DataFrame:
    """(stem, graded) for the asked stems, 0 where nothing is graded."""
    n = claims.where("semantic is not null").groupBy("stem").agg(F.count(F.lit(1)).alias("graded"))
    return stems.select("stem").distinct().join(n, "stem", "left").select("stem", F.coalesce("graded", F.lit(0)).cast("long").alias("graded"))


def first_containing(claims: DataFrame, part: str) -> DataFrame:
    """The first claim by stem and slug whose text holds ``part``, whatever the case."""
    return claims.where(F.lower("text").contains(part.lower())).orderBy("stem", "slug").limit(1)


def top_graded(claims: DataFrame, k: int) -> DataFrame:
    """The best k claims of a page by semantic score, then BM25, then position; ungraded ones come last, in order."""
    order = [F.col("semantic").desc_nulls_last(), F.col("bm25").desc_nulls_last(), F.col("position")]
    return claims.withColumn("place", F.row_number().over(Window.partitionBy("stem").orderBy(*order)).cast("long")).where(F.col("place") <= k)


def members_by_category(members: DataFrame) -> DataFrame:
    """(hub, category, n, stems): members of each hub by category, stems in order."""
    return members.groupBy("hub", "category").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("stem")), ",").alias("stems"))


def attempt_trace(log: DataFrame, attempt: str, order: list[str]) -> DataFrame:
    """An attempt's rows with their step, in order."""
    return log.withColumn("step", F.row_number().over(Window.partitionBy(attempt).orderBy(*order)).cast("long"))


def draft_grade(claims: DataFrame, by: list[str]) -> DataFrame:
    """Mean and upper median of the scores, the weakest claim, and how many verdicts of each kind.

    The median comes from counts by score, so no group is gathered."""
    out = claims.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.min(F.struct("score", "id")).alias("_w"),
        F.count_if(F.col("verdict") == "match").alias("match"), F.count_if(F.col("verdict") == "miss").alias("miss"),
    )
    per = claims.where("score is not null").groupBy(*by, "score").agg(F.count(F.lit(1)).alias("_k"))
    own = Window.partitionBy(*by)
    per = per.withColumns({"_upto": F.sum("_k").over(own.orderBy("score")), "_of": F.sum("_k").over(own)}).where(F.col("_upto") > F.floor(F.col("_of") / 2))
    middle = per.groupBy(*by).agg(F.min("score").alias("upper_median"))
    return out.join(middle, by, "left").select(*by, "n", "mean", "upper_median", F.col("_w.id").alias("weakest"), "match", "miss")


def count_map(rows: DataFrame, by: list[str], of: str) -> DataFrame:
    """A group's counts by value, as "value=n" in order of value."""
    n = rows.groupBy(*by, of).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col(of), F.lit("="), F.col("_n")))), ",").alias("counts"))


def expanded_number(token: Column) -> Column:
    """A number with K, M, B or G behind it, in full; other numbers without separators; null for anything else."""
    plain = F.regexp_replace(F.trim(token), ",", "")
    base, unit = F.regexp_extract(plain, r"^([0-9]+(?:\.[0-9]+)?)[ ]?([KkMmBbGg]?)$", 1), F.upper(F.regexp_extract(plain, r"^([0-9]+(?:\.[0-9]+)?)[ ]?([KkMmBbGg]?)$", 2))
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit.isin("B", "G"), 1e9).otherwise(1.0)
    return F.round(F.nullif(base, F.lit("")).try_cast("double") * factor, 6)


def comparator_check(text: Column, ratio: Column, expected: Column, others: Column, reach: int = 100) -> Column:
    """match if the expected comparator is the nearest to the ratio among all known within ``reach`` characters, partial if the
    ratio is there without it or another is nearer, else miss."""
    low = F.lower(text)
    at = F.instr(low, F.lower(ratio))
    away = lambda c: F.when(F.instr(low, F.lower(c)) > 0, F.abs(F.instr(low, F.lower(c)) - at))
    own = away(expected)
    nearest = F.array_min(F.filter(F.transform(others, away), lambda d: d.isNotNull()))
    return F.when(F.coalesce(at, F.lit(0)) == 0, "miss").when((own <= reach) & (nearest.isNull() | (own <= nearest)), "match").otherwise("partial")


def split_gloss(text: Column) -> tuple[Column, Column]:
    """(claim, gloss): the gloss stands behind the last " -- "."""
    at = F.regexp_extract(text, r"(?s)^(.*) -- (.*)$", 1)
    return F.when(at != "", at).otherwise(text), F.nullif(F.regexp_extract(text, r"(?s)^(.*) -- (.*)$", 2), F.lit(""))


def doi_verdict(given: Column, resolved: Column, year: Column, resolved_year: Column, title_overlap: Column) -> Column:
    """The first that holds: malformed, unresolved, conflict, mismatch, year-drift, ok."""
    return (
        F.when(~F.coalesce(F.lower(F.trim(given)).rlike(r"^10\.[0-9]{4,9}/[^ ]+$"), F.lit(False)), "malformed").when(resolved.isNull(), "unresolved")
        .when(F.lower(F.trim(given)) != F.lower(F.trim(resolved)), "conflict").when(title_overlap < 0.5, "mismatch").when(F.abs(year - resolved_year) > 1, "year-drift").otherwise("ok")
    )


def work_list(pages: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(key, lacks): what each page lacks, in the order of the checks, for pages that lack something."""
    lacks = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()])), ",")
    return pages.select("key", lacks.alias("lacks")).where("lacks <> ''")


def listed_anchors(pages: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doi, page, anchor) for DOIs in a page's text that the audit has as anchors.

    Every page of a DOI meets every anchor of it.  DOIs with many of either are cut into blocks by hashes of page and anchor, and pairs of blocks
    meet in a task: it holds the anchors of one block at a time, and no DOI falls to one task alone.  A page's rows of a block come in a row."""
    found = materialise(pages.select("page", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"10\.[0-9]{4,9}/[a-z0-9.]+"), F.lit(0)), lambda d: F.lower(F.rtrim(d, F.lit(".")))))).alias("doi")), "listed-dois")
    anchors = anchors.where("doi is not null")
    per = found.groupBy("doi").agg(F.count(F.lit(1)).alias("_p")).join(anchors.groupBy("doi").agg(F.count(F.lit(1)).alias("_a")), "doi", "full")
    per = materialise(per.na.fill(0, ["_p", "_a"]), "listed-counts")
    of = per.agg(F.sum(F.col("_p") * F.col("_a") + F.col("_p") + F.col("_a")).alias("rows"), F.count_if((F.col("_p") > BLOCK_PAGES) | (F.col("_a") > BLOCK_ANCHORS)).alias("cut")).first()
    tasks = min(MOST_TASKS, 1 + (of.rows or 0) // TASK_ROWS)
    blocks = lambda n, most: F.greatest(F.lit(1), F.ceil(F.col(n) / most)).cast("int").alias(n)
    cut = per.select("doi", blocks("_p", BLOCK_PAGES), blocks("_a", BLOCK_ANCHORS)).where("_p > 1 or _a > 1")
    cut = F.broadcast(cut) if of.cut <= fulltext.TERMS_LIMIT else cut

    def dealt(rows: DataFrame, own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
        (key, n), (_, n_other) = own, other
        rows = rows.join(cut, "doi", "left").withColumn(f"{n}b", F.pmod(F.xxhash64(key), F.coalesce(n, F.lit(1))).cast("int"))
        rows = rows.withColumn(f"{n_other}b", F.explode(F.sequence(F.lit(0), F.coalesce(n_other, F.lit(1)) - 1))).drop("_p", "_a")
        return rows.repartition(tasks, "doi", "_pb", "_ab") if tasks > 1 else rows

    page, anchor = ("page", "_p"), ("anchor", "_a")
    return dealt(found, page, anchor).join(dealt(anchors, anchor, page).hint("merge"), ["doi", "_pb", "_ab"]).drop("_pb", "_ab")


def new_digests(digests: DataFrame, by_layer: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """``seen_by`` of each digest: the first layer (name, column, known values) that knows it; null is new."""
    out, tests = digests, []
    for name, column, known in by_layer:
        mark = f"_{name}"
        out = out.join(known.select(F.col(column), F.lit(True).alias(mark)).distinct(), column, "left")
        tests.append(F.when(F.col(mark), name))
    return out.withColumn("seen_by", F.coalesce(*tests)).drop(*[f"_{n}" for n, _, _ in by_layer])
