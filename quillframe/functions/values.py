"""Dates, JSON in noisy text, hashes and slugs of claims, small scalars (DAT, JSN, STR, MTH)."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quillframe.functions import text as T


def cutoff(now: Column, days: int) -> Column:
    """Epoch seconds ``days`` before now."""
    return now - F.lit(days * 86_400)


def age_days(now: Column, then: Column) -> Column:
    return F.floor((now - then) / 86_400).cast("int")


def any_date(*texts: Column) -> Column:
    """The first that is a date, of full dates, months or years; file times are never consulted."""
    tries = []
    for t in texts:
        s = F.trim(t)
        tries += [F.try_to_date(F.when(s.rlike(r"^\d{4}-\d\d-\d\d"), F.substring(s, 1, 10)), "yyyy-MM-dd"), F.try_to_date(F.when(s.rlike(r"^\d{4}-\d\d$"), F.concat(s, F.lit("-01"))), "yyyy-MM-dd"), F.try_to_date(F.when(s.rlike(r"^\d{4}$"), F.concat(s, F.lit("-01-01"))), "yyyy-MM-dd")]
    return F.coalesce(*tries)


def count_drift(now: Column, then: Column) -> Column:
    """Whether a count moved by five and by a fifth at least."""
    return F.abs(now - then) >= F.greatest(F.lit(5), F.floor(then * 0.2))


def due(last: Column, today: Column, days: int = 7) -> Column:
    """Whether a check that was last stamped then is due again; never stamped is due."""
    return F.coalesce(F.datediff(today, last) >= days, F.lit(True))


def relative_time(seconds: Column) -> Column:
    n = lambda d: F.floor(seconds / d).cast("long").cast("string")
    return F.when(seconds < 60, "just now").when(seconds < 3600, F.concat(n(60), F.lit("m ago"))).when(seconds < 86_400, F.concat(n(3600), F.lit("h ago"))).when(seconds < 30 * 86_400, F.concat(n(86_400), F.lit("d ago"))).otherwise(F.concat(n(30 * 86_400), F.lit("mo ago")))


def adaptive_cap(corpus: Column) -> Column:
    """How many categories a corpus of this size may start with."""
    return F.when(corpus < 20, 3).when(corpus < 60, 5).when(corpus < 150, 7).otherwise(10)


def token_text(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.concat(F.format_number(n / 1_000_000, 1), F.lit("M"))).when(n >= 1_000, F.concat(F.format_number(n / 1_000, 1), F.lit("K"))).otherwise(n.cast("string"))


def json_in(text: Column) -> Column:
    """The JSON object in an answer: inside a fence if there is one, from the first brace to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.nullif(F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1)), F.lit(""))


def normal_claim(text: Column) -> Column:
    """Lower case, without markup, links, marks and repeated space, so that small edits keep the slug."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(T.strip_markdown(text)), r"[^\p{L}\p{N}.%]+", " "), r"\.(?=\s|$)", ""))


@pandas_udf(StringType())
def blake2s_hex(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else hashlib.blake2s(t.encode(), digest_size=5).hexdigest())


def claim_slug(text: Column, words: int = 4) -> Column:
    """The first words of a claim and a short hash of all of it."""
    normal = normal_claim(text)
    return F.concat(F.array_join(F.slice(F.split(T.slugify(normal), "-"), 1, words), "-"), F.lit("-"), blake2s_hex(normal))


def claim_ref(stem: Column, slug: Column) -> Column:
    return F.when(slug.isNull(), F.concat(F.lit("[["), stem, F.lit("]]"))).otherwise(F.concat(F.lit("[["), stem, F.lit("#"), slug, F.lit("]]")))


def first_and_last(sentences: Column, first: int, last: int) -> Column:
    """The first and last sentences, none twice."""
    n = F.size(sentences)
    tail = F.least(F.lit(last), F.greatest(n - first, F.lit(0)))
    return F.concat(F.slice(sentences, 1, first), F.when(tail > 0, F.slice(sentences, n - tail + 1, tail)).otherwise(F.array().cast("array<string>")))


def keyword_gap(keywords: Column, body: Column) -> Column:
    """Keywords whose first word the body doesn't have."""
    low = F.lower(body)
    return F.filter(keywords, lambda k: ~F.contains(low, F.lower(F.split(F.trim(k), " ")[0])))


def compression(page: Column, source: Column, low: float = 0.01, high: float = 0.30, least: int = 300) -> tuple[Column, Column]:
    """Ratio of words, and its verdict; unknown below ``least`` words of source."""
    ratio = F.size(T.tokens(page)) / F.greatest(F.size(T.tokens(source)), F.lit(1))
    return F.round(ratio, 6), F.when(F.size(T.tokens(source)) < least, "unknown").when(ratio < low, "too short").when(ratio > high, "too long").otherwise("ok")


def repaired_ligatures(text: Column) -> Column:
    """Ligature characters as letters, control characters as nothing, words broken at a line end as one."""
    out = text
    for mark, letters in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        out = F.replace(out, F.lit(mark), F.lit(letters))
    return F.regexp_replace(F.regexp_replace(out, r"[\x00-\x08\x0E-\x1F\x7F]", ""), r"(\p{Ll})-\n(\p{Ll})", "$1$2")
