"""Bibliographic records (SRC, FLT, STR): identity, kind and status of a work, from fields and text.

Every rule is a Column, evaluated in order where the order matters; unknown stays null and never counts as zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import text as T

PARTICLES = ("de", "der", "den", "del", "della", "di", "du", "la", "le", "van", "von", "ter", "ten", "dos", "da")


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def has_prefix(doi: Column, prefixes: list[str]) -> Column:
    """A DOI under one of these prefixes; null and blank are under none."""
    return F.coalesce(any_of(*[F.lower(F.trim(doi)).startswith(p) for p in prefixes]), F.lit(False))


def record_year(record: Column, keys: list[str]) -> Column:
    """The first year found under these date keys, each an array of [year, month, day] parts."""
    return F.coalesce(*[F.try_element_at(F.try_element_at(record[k], F.lit(1)), F.lit(1)) for k in keys])


def retraction_status(publication_types: Column) -> Column:
    has = lambda t: F.array_contains(publication_types, t)
    return F.when(publication_types.isNull(), "unknown").when(has("Retracted Publication"), "retracted").when(has("Expression of Concern"), "concern").when(has("Published Erratum"), "corrected").otherwise("ok")


def latest_affiliation(affiliations: Column) -> Column:
    """The name with the greatest start year of an array of (start_year, name); a missing year is the oldest."""
    ranked = F.transform(affiliations, lambda a, i: F.struct(F.coalesce(a["start_year"], F.lit(-1)).alias("y"), (-i).alias("i"), a["name"].alias("name")))
    return F.array_max(ranked)["name"]


def fold(text: Column) -> Column:
    """Latin letters without their marks, in lower case."""
    marked = "àáâãäåāăąçćčďèéêëēėęěğìíîïīįıłñńňòóôõöøōőŕřśşšťùúûüūůűýÿźżž"
    plain = "aaaaaaaaacccdeeeeeeeegiiiiiiilnnnoooooooorrssstuuuuuuuyyzzz"
    out = F.translate(F.lower(text), marked, plain)
    for mark, letters in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ð", "d")):
        out = F.replace(out, F.lit(mark), F.lit(letters))
    return out


def first_surname(authors: Column) -> Column:
    """Of "Surname, Given; ..." or "Given Surname and ...": the first author's surname with its particles; groups stay whole."""
    first = F.trim(F.regexp_replace(F.split(authors, r"\s*;\s*|\s+and\s+|\s*&\s*")[0], r"(?i),?\s+et al\.?$", ""))
    group = first.rlike(r"(?i)\b(consortium|collaboration|group|network|team|initiative)\b")
    words = F.split(first, r"\s+")
    lead = F.regexp_extract(first, r"(?i)\s((?:(?:" + "|".join(PARTICLES) + r")\s+)+)\S+$", 1)
    return F.when(group, first).when(first.contains(","), F.trim(F.substring_index(first, ",", 1))).otherwise(F.concat(lead, F.element_at(words, -1)))


def stem(authors: Column, year: Column, title: Column, words: int = 5, stop: tuple[str, ...] = T.STOP_WORDS) -> Column:
    """surname-year-title: the first words of the title, and on to the first that isn't a stop word if the last is one."""
    parts = F.filter(F.split(T.slugify(fold(title)), "-"), lambda w: w != "")
    ahead = F.slice(parts, words, F.greatest(F.size(parts), F.lit(1)))
    more = F.array_position(F.transform(ahead, lambda w: ~w.isin(*stop)), True).cast("int")
    taken = F.slice(parts, F.lit(1), F.lit(words) + F.greatest(more - 1, F.lit(0)))
    return F.concat_ws("-", T.slugify(fold(first_surname(authors))), year.cast("string"), F.array_join(taken, "-"))


def venue_agrees(a: Column, b: Column) -> Column:
    """One contains the other, words are abbreviations in order, or one is an acronym of the other."""
    x, y = fold(F.trim(a)), fold(F.trim(b))
    initials = lambda v: F.array_join(F.transform(F.filter(F.split(T.slugify(v), "-"), lambda w: ~w.isin(*T.STOP_WORDS)), lambda w: F.substring(w, 1, 1)), "")
    words = lambda v: F.filter(F.split(T.slugify(v), "-"), lambda w: ~w.isin(*T.STOP_WORDS))
    short = F.forall(F.zip_with(words(x), words(y), lambda p, q: p.isNotNull() & q.isNotNull() & (p.startswith(q) | q.startswith(p))), lambda ok: ok)
    return F.coalesce(x.contains(y) | y.contains(x) | short | (initials(x) == F.replace(y, F.lit("."), F.lit(""))) | (initials(y) == F.replace(x, F.lit("."), F.lit(""))), F.lit(False))


def paper_kind(title: Column, venue: Column, text: Column) -> Column:
    """The first that fits: protocol, review, trial, dataset, method, research."""
    t, head = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 3000))
    return (
        F.when(t.rlike("protocol"), "protocol").when(t.rlike("review|survey|meta-analysis|perspective") | F.lower(F.coalesce(venue, F.lit(""))).rlike("reviews|annual review|trends in"), "review")
        .when(head.rlike("randomi[sz]ed|phase [1-4i]+ trial|clinical trial"), "trial").when(t.rlike("dataset|data set|corpus|benchmark|atlas"), "dataset")
        .when(t.rlike("method|tool|software|framework|pipeline|algorithm"), "method").otherwise("research")
    )


def publication_status(doi: Column, text: Column, preprint_prefixes: list[str]) -> Column:
    head = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 6000))
    return (
        F.when(head.rlike("retracted article|this article has been retracted"), "retracted").when(has_prefix(doi, preprint_prefixes) | head.rlike("not (?:been )?(?:certified by )?peer.review|this is a preprint"), "preprint")
        .when(head.rlike("accepted manuscript|in press|uncorrected proof"), "accepted").when(doi.isNotNull(), "published").otherwise("unknown")
    )


def commentary_signals(text: Column, doi: Column, pages: Column, references: Column, news_prefixes: list[str]) -> Column:
    """Distinct signals in order; a document is commentary with a strong one, or with a weak label and a structural one."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 1200)
    return F.array_compact(F.array(
        F.when(head.rlike(r"(?im)^\s*(news\s*(?:&|and)\s*views|editorial|commentary|research highlight)\s*$"), F.lit("strong-label")),
        F.when(has_prefix(doi, news_prefixes), F.lit("news-doi")), F.when((pages == 1) & (references == 0), F.lit("one-page-no-references")),
        F.when(head.rlike(r"(?im)^\s*(perspective|opinion|viewpoint|comment)\s*$"), F.lit("weak-label")), F.when(pages == 1, F.lit("one-page")), F.when(references == 0, F.lit("no-references"))))


def is_commentary(signals: Column) -> Column:
    has = lambda *s: F.arrays_overlap(signals, F.array(*[F.lit(x) for x in s]))
    return has("strong-label", "news-doi", "one-page-no-references") | (has("weak-label") & has("one-page", "no-references"))


def doi_index(pages: DataFrame, doi: str, key: str) -> DataFrame:
    """One row a DOI, in lower case; of several pages the last by key."""
    return pages.where(F.trim(F.col(doi)) != "").groupBy(F.lower(F.trim(F.col(doi))).alias("doi")).agg(F.max(key).alias("key"))


def crosslinks(references: DataFrame, index: DataFrame, own: str | None = None) -> DataFrame:
    """References (src, doi) met with known pages (doi, key), without a page's own."""
    hit = references.select("src", F.lower(F.trim(F.col("doi"))).alias("doi")).join(index, "doi").distinct()
    return hit.where(F.col("src") != F.col("key"))


def cites_within(text: Column, surname: Column, year: Column, reach: int = 300) -> Column:
    """A surname with the year at most ``reach`` characters behind it, in what follows the references heading."""
    refs = fold(F.regexp_extract(text, r"(?is)(?:^|\n)\s*(?:references|bibliography)\s*\n(.*)\z", 1))
    quoted = F.regexp_replace(fold(surname), r"([^\p{L}\p{N} ])", r"\\$1")
    return F.coalesce(F.regexp(refs, F.concat(F.lit("(?s)"), quoted, F.lit(f".{{0,{reach}}}"), year.cast("string"))), F.lit(False))


def best_match(candidates: DataFrame, by: str, passes: Column, order: list[Column]) -> DataFrame:
    """The first candidate that passes."""
    w = Window.partitionBy(by).orderBy(*order)
    return candidates.where(passes).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def trusted(*sources: tuple[Column, Column]) -> Column:
    """The first non-null value whose source may be trusted: (value, trusted) pairs by rank."""
    return F.coalesce(*[F.when(ok, v) for v, ok in sources])
