"""Text expressions: tokens, numbers, negation, slugs, terms.  All JVM-side; classes are spelt out, as ``\\w`` and ``\\b`` differ between engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
NEGATIONS = ("no", "not", "never", "none", "nicht", "kein", "ne", "pas", "aucun", "nunca", "ninguno")
#: Words that never begin or end a term.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def query_tokens(text: Column, least: int = 3) -> Column:
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) >= least) & ~t.isin(*STOP_WORDS)))


def sanitize_query(text: Column, most: int = 2000) -> Column:
    """Query metacharacters become spaces, runs of space one, and what is over ``most`` characters goes."""
    return F.substring(F.trim(F.regexp_replace(F.translate(text, "+-&|!(){}[]^\"~*?:\\/<>'", " " * 23), " +", " ")), 1, most)


def numeric_tokens(text: Column) -> Column:
    """Numbers that no letter or digit touches on the left, thousands separators included."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?:^|[^\p{L}\p{N}.,])([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1))
    return F.transform(found, normal_number)


def normal_number(x: Column) -> Column:
    """Without thousands separators, and without zeros behind the decimals."""
    plain = F.replace(x, F.lit(","), F.lit(""))
    return F.when(F.contains(plain, F.lit(".")), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")).otherwise(plain)


def negates(text: Column) -> Column:
    return F.arrays_overlap(tokens(text), F.array(*[F.lit(n) for n in NEGATIONS]))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def singular(word: Column) -> Column:
    """A plain English singular: -ies to -y, -sses to -ss, -s off unless -ss, -us or -is."""
    return (
        F.when(word.rlike("[^aeiou]ies$"), F.regexp_replace(word, "ies$", "y")).when(word.rlike("sses$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("[^sui]s$") & (F.length(word) > 3), F.regexp_replace(word, "s$", "")).otherwise(word)
    )


def canonical_key(slug: Column) -> Column:
    """The slug with its last part in the singular."""
    parts = F.split(slug, "-")
    last = F.element_at(parts, -1)
    return F.when(F.size(parts) > 1, F.concat(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "-"), F.lit("-"), singular(last))).otherwise(singular(last))


def title_terms(text: Column) -> Column:
    """Distinct phrases of two to four capitalised words."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}"), F.lit(0)))


def acronyms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Z][A-Z0-9-]+"), F.lit(0)), lambda a: F.length(a).between(2, 10)))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])[ \n]+"), lambda s: F.trim(s)), lambda s: s != "")


def ngrams(words: Column, n: int) -> Column:
    """Distinct n-grams, joined by one space; ``words`` should be a plain column, as it is read for each n-gram."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " ")))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def overlap_coefficient(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))


def section(body: Column, heading: str) -> Column:
    """Text below an H2 heading, up to the next H1 or H2."""
    return F.regexp_replace(F.regexp_extract(body, rf"(?ims)^##[ \t]+{heading}[ \t]*$(.*?)(?=^##?[ \t]|\z)", 1), r"\A\s+|\s+\z", "")


def strip_markdown(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?s)```.*?```", " ")
    out = F.regexp_replace(out, r"!?\[\[([^\]|]*\|)?([^\]]*)\]\]", "$2")
    out = F.regexp_replace(out, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?m)^[ \t]*(?:#+|[-*+]|\d+\.)[ \t]+", ""), r"[*_`]+", ""))


def wikilinks(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[\[([^\]|#]+)"), F.lit(1)))


def dois(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"10\.\d{4,9}/[^\s\"<>|\\^`{}\[\]]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda d: F.lower(F.regexp_replace(d, r"[.,;:)\]'\"]+$", "")))))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha1(F.coalesce(text, F.lit("")).cast("binary")), 1, 16)
