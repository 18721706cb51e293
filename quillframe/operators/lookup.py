"""Filters and point look-ups (FLT): composed predicates, missing values, case-insensitive keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACEHOLDERS = ("", "todo", "none")


def all_of(*conditions: Column | None) -> Column:
    """AND of the conditions given; none at all is true."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def year_filter(year: Column, exact: int | None = None, span: tuple[int, int] | None = None) -> Column | None:
    """``= exact`` or ``BETWEEN span``; a reversed span is an error."""
    if span is not None:
        if span[0] > span[1]:
            raise ValueError(f"year range {span[0]}-{span[1]} is reversed")
        return year.between(*span)
    return None if exact is None else year == exact


def like_ci(column: Column, part: str | None) -> Column | None:
    """Contains ``part``, whatever the case."""
    return None if part is None else column.ilike(f"%{part}%")


def is_missing(column: Column) -> Column:
    """Null, blank or a placeholder."""
    return column.isNull() | F.lower(F.trim(column)).isin(*PLACEHOLDERS)


def lookup(rows: DataFrame, conditions: list[Column | None], order: list[Column], limit: int | None = None) -> DataFrame:
    found = rows.where(all_of(*conditions)).orderBy(*order)
    return found if limit is None else found.limit(limit)


def point_lookup(rows: DataFrame, column: str, value: str, tie: str) -> DataFrame:
    """The row whose ``column`` equals ``value`` in any case; of several that with the least ``tie``."""
    return rows.where(F.lower(F.trim(F.col(column))) == value.strip().lower()).orderBy(tie).limit(1)


def collision_kind(new_id: Column, old_id: Column, preprint_prefixes: list[str]) -> Column:
    """duplicate, upgrade (preprint to journal), downgrade, or unclear, for two identifiers of one title."""
    preprint = lambda c: reduce(lambda a, b: a | b, [F.lower(c).startswith(p) for p in preprint_prefixes])
    return (
        F.when(new_id.isNull() | old_id.isNull(), "unclear").when(F.lower(F.trim(new_id)) == F.lower(F.trim(old_id)), "duplicate")
        .when(preprint(old_id) & ~preprint(new_id), "upgrade").when(~preprint(old_id) & preprint(new_id), "downgrade").otherwise("unclear")
    )


def clean_keywords(words: Column, denied: list[str], longest: int = 50, most: int = 10, least: int = 5) -> Column:
    """Trimmed, no longer than ``longest``, without commas or denied words, first of equal-but-case, at most
    ``most``; null if fewer than ``least`` remain."""
    fit = F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: (F.length(w) > 0) & (F.length(w) <= longest) & ~w.contains(",") & ~F.lower(w).isin(*denied))
    first = F.aggregate(fit, F.array().cast("array<string>"), lambda acc, w: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(w)), acc).otherwise(F.array_append(acc, w)))
    return F.when(F.size(first) >= least, F.slice(first, 1, most))


def weak_claim(unmatched: Column, negated: Column, semantic: Column, bm25: Column) -> Column:
    """Unmatched numbers, a negation mismatch, a low semantic score, or both scores middling."""
    return F.coalesce((F.coalesce(unmatched, F.lit(0)) > 0) | F.coalesce(negated, F.lit(False)) | (F.coalesce(semantic, F.lit(1.0)) < 0.40) | ((F.coalesce(bm25, F.lit(0.0)) < 8) & (F.coalesce(semantic, F.lit(0.0)) < 0.55)), F.lit(False))


def gate_reasons(checks: list[tuple[Column, str]]) -> Column:
    """The messages of all checks that fail, in order; empty means the gate is open.  A null check fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for ok, text in checks]))
