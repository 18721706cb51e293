"""Units of a page and their citations (STR-24, STR-4): what can be a claim, what it cites, and marks put back into the text.

One fold over a page's lines finds the units; everything after it is joins.  Regions that aren't prose (front matter, fences, marked regions,
comments, a closing section on what would update the page) are blanked line by line, so line numbers are those of the page."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.quantities import FOOTNOTE_REF, WIKILINK
from quillframe.scratch import materialise

# What is left out, what opens a unit, what excuses a missing citation, and how flagged text is marked.
REGIONS = (
    r"\A---\s*\n.*?\n---\s*\n", r"```.*?```", r"<!--\s*skip-grounding-start\s*-->.*?<!--\s*skip-grounding-end\s*-->", r"<!--.*?-->",
    r"^##[ \t]+(?i:what would update this page)\b.*?(?=^##[ \t]+\S|\Z)",
)
HEADING = r"^\s{0,3}#{1,6}\s"
BULLET = r"^(\s*)(?:[-*+]|\d+\.)\s+"
IDEA = r"^type:\s*[\"']?idea[\"']?\s*(?:#.*)?$"
OPEN_SECTION = r"^##[ \t]+(opportunities|plans)\b"
CLAIM_ANCHOR = r"^([^\]\|#\s]+)#([a-z0-9]{2,3}-[a-z0-9-]+)(?:\|[^\]]+)?$"
CLAIM_ID = r"(?i)\bclaim_id\s*[:=]\s*\d+\b"
FOOTNOTE_DEF = r"(?m)^[ \t]*\[\^([^\]\s]+)\]:[ \t]*(.*)$"
FOOTNOTE_LINE = r"^[ \t]*\[\^[^\]\s]+\]:"
MODEL_PRIOR = r"(?i)\*\(\s*model\s+prior\s*\)\*"
DISCLAIMERS = (
    r"(?i)\bno (paper|wiki page) (covers|in this wiki)", r"(?i)\bthe wiki (has no|does not|doesn't)", r"(?i)\bi (don't have|do not have|haven't|need to check)",
    r"(?i)\bi'?d need to check the pdf", r"(?i)\bi (would need|cannot answer|can't answer)",
)
CLAIM_WORDS = 8
#: Pages whose units leave a task together.
PAGES = 100
UNGROUNDED, PRIOR = " ⚠ ungrounded", " ⚠ model prior"
PLACEHOLDER = "*[ungrounded — I'd need to check the PDF for this.]*"

_UNIT = "unit int, line int, last int, lines int, kind string, section string, open boolean, text string"


def fold_units(text: str | None) -> Iterator[tuple[int, int, int, str, str, bool, str]]:
    """(line, last line with text, lines, kind, section, whether a model's own knowledge may stand for a citation, text), in order.

    A bullet takes in bullets further in and lines that follow; a blank line or heading ends any unit."""
    text = (text or "").replace("\r\n", "\n")
    head = re.match(REGIONS[0], text, re.DOTALL)
    idea = bool(head and re.search(IDEA, head[0], re.MULTILINE | re.IGNORECASE))
    for region in REGIONS:
        text = re.sub(region, lambda m: "\n" * m[0].count("\n"), text, flags=re.DOTALL | re.MULTILINE)
    held: list[str] = []
    begun, kind, depth, section, open_ = 0, "", 0, "", False

    def unit() -> tuple[int, int, int, str, str, bool, str]:
        last = max(i for i, line in enumerate(held) if line.strip())
        return begun, begun + last, len(held), kind, section, open_, "\n".join(held).rstrip()

    for number, line in enumerate(text.split("\n"), start=1):
        heading, bullet = re.match(HEADING, line), re.match(BULLET, line)
        indent = len(bullet[1].expandtabs()) if bullet else 0
        ends = not line.strip() or heading or (bullet and (kind != "bullet" or indent <= depth))
        if ends and held:
            yield unit()
            held = []
        if not line.strip():
            continue
        if heading:
            if re.match(r"##[ \t]+\S", line):
                section, open_ = line[2:].strip(), idea and bool(re.match(OPEN_SECTION, line, re.IGNORECASE))
            yield number, number, 1, "heading", section, open_, line.rstrip()
            continue
        if not held:
            begun, kind, depth = number, "bullet" if bullet else "paragraph", indent
        held.append(line)
    if held:
        yield unit()


def units(pages: DataFrame, key: str = "page", body: str = "body") -> DataFrame:
    """(page, unit, line, last, lines, kind, section, open, text, claim) of each page (key, body)."""
    names = ["unit", "line", "last", "lines", "kind", "section", "open", "text"]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), PAGES):
                part = frame.iloc[at : at + PAGES]
                yield pd.DataFrame([(page, i, *u) for page, text in zip(part["page"], part["body"], strict=True) for i, u in enumerate(fold_units(text))], columns=["page", *names])

    kind = pages.schema[key].dataType.simpleString()
    found = pages.select(F.col(key).alias("page"), F.col(body).alias("body")).mapInPandas(cut, f"page {kind}, {_UNIT}")
    return found.withColumn("_bare", bare_text(F.col("text"))).withColumn("claim", is_claim(F.col("kind"), F.col("text"), F.col("_bare"))).drop("_bare")


def bare_text(text: Column) -> Column:
    """A unit's text without marks and links."""
    bare = F.regexp_replace(text, r"[*_`>~]+", "")
    for pattern in (WIKILINK, r"\bclaim_id\s*[:=]\s*\d+", FOOTNOTE_REF):
        bare = F.regexp_replace(bare, pattern, "")
    return F.regexp_replace(bare, r"\A\s+|\s+\z", "")


def is_claim(kind: Column, text: Column, bare: Column) -> Column:
    """Prose of eight words or more that is neither heading, footnote definitions, question nor disclaimer; link texts don't count.

    ``bare`` is ``bare_text`` as a plain column, as each test reads it."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    excused = F.lit(False)
    for pattern in DISCLAIMERS:
        excused = excused | bare.rlike(pattern)
    words = F.regexp_count(bare, F.lit(r"[A-Za-z][A-Za-z0-9'\-]+"))
    return (kind != "heading") & ~F.forall(lines, lambda x: x.rlike(FOOTNOTE_LINE)) & ~bare.endswith("?") & ~excused & (words >= CLAIM_WORDS)


def target(link: Column) -> Column:
    """The stem that a link's inside leads to: no alias, fragment or folder."""
    return F.trim(F.element_at(F.split(F.trim(F.element_at(F.split(F.element_at(F.split(link, r"\|"), 1), "#"), 1)), "/"), -1))


def footnotes(pages: DataFrame, key: str = "page", body: str = "body") -> DataFrame:
    """(page, note, links, grounds): of each footnote the links of its last definition that has some, and whether any definition cites."""
    whole = F.regexp_extract_all(F.regexp_replace(F.col(body), "\r\n", "\n"), F.lit(FOOTNOTE_DEF), F.lit(0))
    defs = pages.select(F.col(key).alias("page"), F.posexplode(whole).alias("at", "line"))
    line = F.regexp_extract("line", FOOTNOTE_DEF, 2)
    defs = defs.select("page", "at", F.regexp_extract("line", FOOTNOTE_DEF, 1).alias("note"), F.regexp_extract_all(line, F.lit(WIKILINK), F.lit(1)).alias("links"), line.rlike(CLAIM_ID).alias("id"))
    last = F.max(F.when(F.size("links") > 0, F.struct("at", "links")))["links"]
    return defs.groupBy("page", "note").agg(F.coalesce(last, F.array().cast("array<string>")).alias("links"), F.max((F.size("links") > 0) | F.col("id")).alias("grounds"))


def cited(units_: DataFrame, notes: DataFrame) -> DataFrame:
    """(page, unit, stem, place): the stems that a unit cites, each once, links of its own before those of its footnotes."""
    own = units_.select("page", "unit", F.posexplode(F.regexp_extract_all("text", F.lit(WIKILINK), F.lit(1))).alias("i", "link")).withColumns({"tier": F.lit(0), "j": F.lit(0)})
    refs = units_.select("page", "unit", F.posexplode(F.regexp_extract_all("text", F.lit(FOOTNOTE_REF), F.lit(1))).alias("i", "note"))
    through = refs.join(notes.select("page", "note", F.posexplode("links").alias("j", "link")), ["page", "note"]).withColumn("tier", F.lit(1))
    names = ["page", "unit", "tier", "i", "j", "link"]
    both = own.select(*names).unionByName(through.select(*names)).withColumn("stem", target(F.col("link")))
    first = both.groupBy("page", "unit", "stem").agg(F.min(F.struct("tier", "i", "j")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("page", "unit").orderBy("at"))).drop("at")


def anchors(units_: DataFrame) -> DataFrame:
    """(page, unit, link, stem, slug): claim anchors; links to headings of other shapes aren't."""
    links = units_.select("page", "unit", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WIKILINK), F.lit(1)))).alias("link")).where(F.col("link").rlike(CLAIM_ANCHOR))
    return links.select("page", "unit", "link", F.element_at(F.split(F.regexp_extract("link", CLAIM_ANCHOR, 1), "/"), -1).alias("stem"), F.regexp_extract("link", CLAIM_ANCHOR, 2).alias("slug"))


def judged(units_: DataFrame, notes: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """``units_`` with ``state``: not-a-claim, grounded, model-prior, dangling-anchor or ungrounded.

    With ``claims`` (stem, slug) an anchor counts only if the claim is there; without, every anchor counts."""
    links = F.regexp_extract_all("text", F.lit(WIKILINK), F.lit(1))
    plain = F.size(F.filter(links, lambda x: ~x.rlike(CLAIM_ANCHOR)))
    # Units are cut once.  Only those whose anchors or footnotes decide meet claims and notes; the others stay where they are.
    u = units_.withColumns({"_plain": plain + F.regexp_count("text", F.lit(CLAIM_ID)), "_anchors": F.size(links), "_refs": F.regexp_count("text", F.lit(FOOTNOTE_REF))})
    u = materialise(u.withColumn("_anchors", F.when(F.col("_anchors") > 0, F.size(F.filter(links, lambda x: x.rlike(CLAIM_ANCHOR)))).otherwise(0)), "units")
    prior = F.when(F.col("open") & F.col("text").rlike(MODEL_PRIOR), "model-prior").when(F.col("_anchors") > 0, "dangling-anchor").otherwise("ungrounded")
    decided = ~F.col("claim") | (F.col("_plain") > 0) | ((F.col("_anchors") == 0) & (F.col("_refs") == 0))
    alone = u.where(decided).withColumn("state", F.when(~F.col("claim"), "not-a-claim").when(F.col("_plain") > 0, "grounded").otherwise(prior))
    rest = u.where(~decided)
    wanted = anchors(rest.where("_anchors > 0"))
    met = wanted if claims is None else wanted.join(claims.select("stem", "slug").distinct(), ["stem", "slug"], "left_semi")
    refs = rest.where("_refs > 0").select("page", "unit", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(FOOTNOTE_REF), F.lit(1)))).alias("note"))
    noted = refs.join(notes.where("grounds").select("page", "note"), ["page", "note"], "left_semi")
    grounded = met.select("page", "unit").unionByName(noted.select("page", "unit")).distinct().withColumn("_grounded", F.lit(True))
    rest = rest.join(grounded, ["page", "unit"], "left").withColumn("state", F.when(F.col("_grounded"), "grounded").otherwise(prior)).drop("_grounded")
    return alone.unionByName(rest).drop("_plain", "_anchors", "_refs")


def _by_line(marks: Column, first: str, after: Callable[[Column], Column], told: Callable[[Column], Column]) -> Column:
    """One value a line, null where none is told, from marks in order of their lines; linear in the lines."""
    ends = F.slice(F.concat(F.array(F.lit(0)), F.transform(marks, after)), 1, F.size(marks))
    return F.flatten(F.zip_with(marks, ends, lambda m, e: F.concat(F.array_repeat(F.lit(None).cast("string"), m[first] - e - 1), told(m))))


def marked(pages: DataFrame, judged_: DataFrame, key: str = "page", body: str = "body") -> DataFrame:
    """``pages`` with the texts ``annotated`` and ``stripped``.

    annotated has a mark behind the last line of each unit that isn't grounded; a mark that is there stays alone.  stripped has a placeholder for each
    such unit, unless a model's own knowledge may stand for a citation; a bullet keeps its mark, what it took in goes."""
    mark = F.when(F.col("state").isin("ungrounded", "dangling-anchor"), UNGROUNDED).when(F.col("state") == "model-prior", PRIOR)
    lead = F.when(F.col("kind") == "bullet", F.regexp_extract("text", BULLET, 0)).otherwise("")
    told = judged_.where(F.col("state").isin("ungrounded", "dangling-anchor", "model-prior")).select(F.col("page").alias(key), F.struct("line", "last", "lines", mark.alias("mark"), lead.alias("lead")).alias("_m"))
    out = pages.join(told.groupBy(key).agg(F.sort_array(F.collect_list("_m")).alias("_marks")), key, "left")  # a page's marks
    behind = _by_line(F.col("_marks"), "last", lambda m: m["last"], lambda m: F.array(m["mark"]))
    instead = _by_line(
        F.filter("_marks", lambda m: m["mark"] == UNGROUNDED), "line", lambda m: m["line"] + m["lines"] - 1, lambda m: F.concat(F.array(F.concat(m["lead"], F.lit(PLACEHOLDER))), F.array_repeat(F.lit(""), m["lines"] - 1)))
    out = out.withColumns({"_lines": F.split(body, "\n"), "_behind": behind, "_instead": instead})
    with_marks = F.transform("_lines", lambda x, i: F.coalesce(F.when(~F.contains(x, F.get(F.col("_behind"), i)), F.concat(F.regexp_replace(x, r"\s+$", ""), F.get(F.col("_behind"), i))), x))
    left = F.filter(F.zip_with("_lines", "_instead", lambda x, y: F.when(x.isNotNull(), F.coalesce(F.nullif(y, F.lit("")), F.when(y.isNull(), x)))), lambda x: x.isNotNull())
    none = F.col("_marks").isNull()
    out = out.withColumns({"annotated": F.when(none, F.col(body)).otherwise(F.array_join(with_marks, "\n")), "stripped": F.when(none, F.col(body)).otherwise(F.array_join(left, "\n"))})
    return out.drop("_marks", "_lines", "_behind", "_instead")


def annotated(pages: DataFrame, judged_: DataFrame, key: str = "page", body: str = "body") -> DataFrame:
    return marked(pages, judged_, key, body).withColumn(body, F.col("annotated")).drop("annotated", "stripped")


def stripped(pages: DataFrame, judged_: DataFrame, key: str = "page", body: str = "body") -> DataFrame:
    return marked(pages, judged_, key, body).withColumn(body, F.col("stripped")).drop("annotated", "stripped")
