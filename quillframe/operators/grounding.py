"""Grounding (STR, AGG, PIP): a page's units, which of them are claims, which claims have evidence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import text as T

_UNIT = "stem string, section string, position int, kind string, text string"


def page_units(body: str | None) -> list[tuple[str, str, str]]:
    """(section, kind, text): paragraphs, bullets with what is nested below them, headings; fences are left out."""
    out: list[tuple[str, str, str]] = []
    section, held, kind, depth, fenced = "", [], "", 0, False

    def flush() -> None:
        if held:
            out.append((section, kind, " ".join(held)))
            held.clear()

    for line in (body or "").split("\n"):
        bare = line.strip()
        if bare.startswith("```"):
            flush()
            fenced = not fenced
        elif fenced:
            continue
        elif not bare:
            flush()
        elif bare.startswith("#"):
            flush()
            section = bare.lstrip("#").strip()
            out.append((section, "heading", section))
        elif bare[:2] in ("- ", "* ", "+ "):
            indent = len(line) - len(line.lstrip())
            if kind != "bullet" or not held or indent <= depth:
                flush()
                kind, depth = "bullet", indent
            held.append(bare[2:].strip())
        else:
            if not held:
                kind = "paragraph"
            held.append(bare)
    flush()
    return out


def units(pages: DataFrame) -> DataFrame:
    """The units of pages (stem, body), in order."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(s, sec, i, kind, text) for s, body in zip(batch["stem"], batch["body"], strict=True) for i, (sec, kind, text) in enumerate(page_units(body))]
            yield pd.DataFrame(rows, columns=["stem", "section", "position", "kind", "text"])

    return pages.select("stem", "body").mapInPandas(cut, _UNIT)


def is_claim(kind: Column, text: Column, least_words: int = 8) -> Column:
    """Neither heading nor question nor disclaimer, and long enough."""
    return (kind != "heading") & ~F.trim(text).endswith("?") & ~F.lower(text).rlike(r"^\(?(?:note|disclaimer|none|no claims?)\b") & (F.size(T.tokens(text)) >= least_words)


def judged(units_: DataFrame, known: DataFrame) -> DataFrame:
    """``state`` of each unit: grounded by a link to a known stem, model-prior if marked so, ungrounded, or not a claim."""
    u = units_.withColumn("claim", is_claim(F.col("kind"), F.col("text")))
    links = u.select("stem", "position", F.explode(T.wikilinks(F.col("text"))).alias("key"))
    hit = links.join(known.select("key").distinct(), "key").select("stem", "position").distinct().withColumn("_hit", F.lit(True))
    state = F.when(~F.col("claim"), "not-a-claim").when(F.col("_hit"), "grounded").when(F.lower("text").contains("(model prior)"), "model-prior").otherwise("ungrounded")
    return u.join(hit, ["stem", "position"], "left").withColumn("state", state).drop("_hit")


def report(judged_: DataFrame) -> DataFrame:
    """Counts a page, and the grounded share of its claims, which is 1 for a page without claims."""
    n = lambda s: F.count_if(F.col("state") == s)
    out = judged_.groupBy("stem").agg(F.count_if("claim").alias("claims"), n("grounded").alias("grounded"), n("model-prior").alias("model_prior"), n("ungrounded").alias("ungrounded"))
    return out.withColumn("coverage", F.when(F.col("claims") == 0, 1.0).otherwise(F.round(F.col("grounded") / F.col("claims"), 6)))
