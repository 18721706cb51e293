"""Quantities and negations in prose: numbers by value, not by spelling.

A number may carry thousands separators, decimals and a magnitude letter; numbers are equal if one of their normal forms is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide what counts as a number, a negation, a date, a citation mark and a comparison.
NUMBER = r"(?=[0-9])(?<![\p{L}\p{N}_.])[0-9][0-9,]*(?:\.[0-9]+)?(?:\s?[KkMmBbGg](?![A-Za-z]))?"
MAGNITUDE = r"([0-9][0-9,]*(?:\.[0-9]+)?)\s?([KkMmBbGg])\b"
MAGNITUDES = {"k": 1_000, "m": 1_000_000, "b": 1_000_000_000, "g": 1_000_000_000}
THIN_SPACES = " \u00a0\u2009\u202f"
NEGATION = (
    r"(?i)\b(not|no|never|without|cannot|can'?t|don'?t|doesn'?t|didn'?t|won'?t|wouldn'?t|isn'?t|aren'?t|wasn'?t|weren'?t|hasn'?t|haven'?t"
    r"|fails?\s+to|failed\s+to|unable\s+to|lack\s+of|absence\s+of|absent)\b"
)
DATE = r"\b[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?\b"
WIKILINK = r"\[\[([^\]]+)\]\]"
FOOTNOTE_REF = r"\[\^([^\]\s]+)\]"
COMPARISON = (
    r"(?i)\b(faster|slower|higher|lower|larger|smaller|better|worse|cheaper|more|less|greater|fewer|outperform\w*|exceed\w*|surpass\w*"
    r"|compared\s+to|relative\s+to|whereas|unlike|versus|vs\.?|in\s+contrast|than)\b"
)

#: A space between three-digit groups: a whole group after it that no separator cuts off, some digits of a group before it.  What stands
#: behind is looked at first, as looking back is slow and most spaces have no digit behind them.
_GROUP_SPACE = (
    rf"[{THIN_SPACES}](?=[0-9]{{3}}(?:[{THIN_SPACES}][0-9]{{3}})*(?![0-9])(?!,[0-9]))"
    rf"(?<=(?<![0-9.])[0-9]{{1,3}}(?:[{THIN_SPACES}][0-9]{{3}}){{0,9}}[{THIN_SPACES}])"
)


def joined_thousands(text: Column) -> Column:
    """``300 000`` as ``300000``."""
    return F.regexp_replace(text, _GROUP_SPACE, "")


def numbers(text: Column) -> Column:
    """Numbers in order, as they are spelt."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))


def _trimmed(number: Column) -> Column:
    """Without zeros at the end of decimals."""
    return F.when(F.contains(number, F.lit(".")), F.regexp_replace(F.regexp_replace(number, "0+$", ""), r"\.$", "")).otherwise(number)


def forms(number: Column) -> Column:
    """The number's normal forms: plain, and in full if it has a magnitude letter."""
    plain = _trimmed(F.regexp_replace(number, "[^0-9.]", ""))
    base, letter = F.regexp_extract(number, MAGNITUDE, 1), F.lower(F.regexp_extract(number, MAGNITUDE, 2))
    factor = F.create_map(*[F.lit(x) for pair in MAGNITUDES.items() for x in pair])[letter]
    full = F.replace(base, F.lit(","), F.lit("")).try_cast("decimal(28,9)") * factor.cast("decimal(10,0)")
    # Casting what isn't a number is slow, so it is left to numbers that have a letter.
    return F.array_compact(F.array(F.nullif(plain, F.lit("")), F.when(number.rlike("[KkMmBbGg]"), _trimmed(full.cast("string")))))


def all_forms(text: Column) -> Column:
    """The forms of every number of a text, thousands joined."""
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(numbers(joined_thousands(text))), forms)))


def unmatched(tokens: Column, known: Column) -> Column:
    """Those of the numbers without a form among the known ones, in order."""
    return F.filter(tokens, lambda t: ~F.arrays_overlap(forms(t), known))


def negates(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(NEGATION)


def negation_mismatch(claim: Column, evidence: Column) -> Column:
    return negates(claim) & ~negates(evidence)


def without_citations(text: Column) -> Column:
    """Wiki links, footnote marks and ISO dates become blanks, so that their digits aren't quantities."""
    out = text
    for pattern in (WIKILINK, FOOTNOTE_REF, DATE):
        out = F.regexp_replace(out, pattern, " ")
    return out


def compares(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(COMPARISON)
