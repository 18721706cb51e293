"""Queries on units, grounding and fidelity: pages made from documents and benchmark items, sources that are whole documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import quantities as Q
from quillframe.operators import fidelity, units
from quillframe.sources.tables import table

# Rows that both engines read.
_SHEET = """SELECT doc_id AS page, CASE WHEN doc_id % 4 = 0 THEN '---' || chr(10) || 'type: idea' || chr(10) || 'hook: x' || chr(10) || '---' || chr(10) ELSE '' END || '# A page' || chr(10)
    || replace(replace(text, chr(10), CASE doc_id % 5 WHEN 0 THEN chr(10) || '- ' WHEN 1 THEN chr(10) || chr(10) WHEN 2 THEN chr(10) || '1. ' WHEN 3 THEN chr(10) ELSE chr(10) || '  * ' END),
        '. ', CASE doc_id % 3 WHEN 0 THEN '.' || chr(10) || '    - ' WHEN 1 THEN ' [[en/d' || (doc_id % 90) || '#kc-' || (doc_id % 7) || 'a]].' || chr(10) ELSE '. ' END)
    || chr(10) || chr(10) || '## Plans' || chr(10) || 'It is held by the model alone that this will work out well *(model prior)* in time' || chr(10)
    || chr(10) || 'Two of them say so in the same words as before [^a] and others did' || chr(10) || chr(10) || 'One of them says so in the same words as before [^b] and others did' || chr(10)
    || '<!-- one line' || chr(10) || '- of a note that nobody reads in the page at all -->' || chr(10) || '```' || chr(10) || '- code' || chr(10) || '```' || chr(10)
    || '- Is it so that this one asks a question of eight words?' || chr(10) || '- The wiki has no page that would say more about this one' || chr(10)
    || '## What would update this page' || chr(10) || 'Anything that was measured after the page was written down by its author' || chr(10)
    || '## Notes' || chr(10) || '[^a]: see [[fr/d' || doc_id || ']]' || chr(10) || '[^b]: nothing' AS body FROM documents"""
_SLUGS = "SELECT DISTINCT 'd' || (doc_id % 60) AS stem, 'kc-' || (doc_id % 5) || 'a' AS slug FROM documents"
_SOURCE = "SELECT 'd' || doc_id AS stem, text || ' It has ' || (n_chars % 50) || ' rows and 300 000 cells, not 12.50 K, since 2024-05-06.' AS text FROM documents"
_CLAIM = """SELECT 'd' || doc_id AS stem, 'results' AS section, CAST(0 AS INT) AS position, b.text || ' has 300,000 cells' AS text, false AS is_cross_ref FROM documents JOIN benchmark b ON item_id = doc_id % 40
    UNION ALL SELECT 'd' || doc_id, 'results', CAST(1 AS INT), 'It never has ' || (n_chars % 60) || ' rows and 12500 more', false FROM documents
    UNION ALL SELECT 'd' || doc_id, 'links', CAST(0 AS INT), 'It has ' || doc_id || ' links', doc_id % 3 = 0 FROM documents"""
_SYNTHESIS = """SELECT item_id AS page, '# Review' || chr(10) || b.text || ' [[en/d' || item_id || ']]' || chr(10) || chr(10)
    || 'They hold 300,000 cells and so do all the others [[d' || (item_id * 3) || '|one]] [^n] that were read' || chr(10) || chr(10)
    || 'One is faster than the other and holds more cells [[d' || (item_id * 5 + 1) || ']] [[d' || (item_id * 7 + 2) || ']] here' || chr(10) || chr(10)
    || 'It has never had ' || item_id || ' rows in any of its many tables [[d' || (item_id * 11) || ']] [[d' || (item_id * 2) || ']]' || chr(10) || chr(10)
    || 'There are 300000 cells to be counted in every one of them [[en/d' || item_id || '#kc-' || (item_id % 4) || 'a]] so far' || chr(10) || chr(10)
    || 'Zyx qwv kjh zzq wxv qqz xxk vvz jjq [[d' || (item_id + 3) || ']]' || chr(10) || chr(10) || 'Nobody at all has said anything of this kind before now [[gone]]' || chr(10) || chr(10)
    || '[^n]: see [[d' || (item_id + 1) || ']] and [[gone]]' AS body FROM benchmark b"""
_FACTS = "SELECT 'd' || doc_id AS stem, 'kc-' || (doc_id % 4) || 'a' AS slug, CASE WHEN doc_id % 2 = 0 THEN 'It has 300 K cells' ELSE 'It has 300 cells' END AS text FROM documents"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SELECT over the tables, which are handed in under other names than the session's."""
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace("FROM documents", "FROM {documents}").replace("FROM benchmark", "FROM {benchmark}").replace("JOIN benchmark", "JOIN {benchmark}"),
                     documents=table(spark, sf_dir, "documents"), benchmark=table(spark, sf_dir, "benchmark"))


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f"q_{f.__name__}"] = f
    return f


@_query
def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each number occurs in the sources, and its forms."""
    n = _rows(spark, sf_dir, _SOURCE).select(F.explode(Q.numbers(Q.joined_thousands(F.col("text")))).alias("number"))
    return n.groupBy("number").agg(F.count(F.lit(1)).alias("n")).withColumn("forms", F.array_join(Q.forms(F.col("number")), "|"))


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = _rows(spark, sf_dir, _SHEET)
    return pages, units.judged(units.units(pages), units.footnotes(pages), _rows(spark, sf_dir, _SLUGS))


@_query
def grounding_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, told = _judged(spark, sf_dir)
    return told.select("page", F.col("unit").cast("long").alias("unit"), F.col("line").cast("long").alias("line"), F.col("lines").cast("long").alias("lines"), "kind", "state", F.md5(F.col("text").cast("binary")).alias("digest"))


@_query
def grounding_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of pages with marks, and of pages with what isn't grounded taken out."""
    pages, told = _judged(spark, sf_dir)
    return units.marked(pages, told).select("page", F.md5(F.col("annotated").cast("binary")).alias("annotated"), F.md5(F.col("stripped").cast("binary")).alias("stripped"))


@_query
def page_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = fidelity.page_fidelity(_rows(spark, sf_dir, _CLAIM), _rows(spark, sf_dir, _SOURCE))
    return graded.select(
        "stem", "section", "position", "graded", "top1_score", "top3_mean", F.col("top1_chunk_id").cast("long").alias("chunk"), F.md5(F.col("supporting_text").cast("binary")).alias("evidence"),
        F.array_join("numeric_tokens", "|").alias("numbers"), F.array_join("numeric_unmatched", "|").alias("unmatched"), "negation_mismatch")


@_query
def page_fidelity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = fidelity.page_fidelity(_rows(spark, sf_dir, _CLAIM), _rows(spark, sf_dir, _SOURCE))
    return fidelity.page_report(graded).select("stem", "n_claims", "n_graded", "n_cross_refs", "mean_top1", "median_top1", F.md5(F.col("weakest_claim").cast("binary")).alias("weakest"), "weakest_score", "n_with_numeric_drift", "n_negation_mismatches")


@_query
def page_fidelity_persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored claims, of which every fourth is gone from the store, with the grader's columns."""
    claims = _rows(spark, sf_dir, _CLAIM)
    stored = claims.where("(length(text) + position) % 4 <> 0").select("stem", "section", "position", F.lit("kept").alias("note"), F.lit(-1.0).alias("bm25_top1"))
    done = fidelity.persisted(stored, fidelity.page_fidelity(claims, _rows(spark, sf_dir, _SOURCE)), at=7)
    return done.select("stem", "section", "position", "note", "bm25_top1", "bm25_top3_mean", "numeric_tokens", "numeric_unmatched", F.col("negation_mismatch").cast("long").alias("negation_mismatch"), "last_graded_at")


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fidelity.synthesis_fidelity(_rows(spark, sf_dir, _SYNTHESIS), _rows(spark, sf_dir, _SOURCE), _rows(spark, sf_dir, _FACTS))


@_query
def synthesis_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).select(
        "page", F.col("line").cast("long").alias("line"), F.array_join("cited", "|").alias("cited"), F.array_join("unresolved", "|").alias("unresolved"), "best_stem", "best_bm25",
        F.array_join("numeric_unmatched", "|").alias("unmatched"), "negation_mismatch", F.array_join("wrong_anchors", "|").alias("wrong_anchors"), "verdict")


@_query
def synthesis_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fidelity.synthesis_report(_graded(spark, sf_dir))


# ---- the same in SQL


def _blank(rows: str, region: str) -> str:
    """Rows (page, body) with each region replaced by its line ends."""
    return f"""SELECT page, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || repeat(chr(10), coalesce(len(e[i]) - len(replace(e[i], chr(10), '')), 0)::BIGINT)), '') AS body
        FROM (SELECT page, regexp_split_to_array(body, '{region}') AS p, regexp_extract_all(body, '{region}') AS e FROM {rows})"""


_LINK = r"\[\[[^\]]+\]\]"


def _units(rows: str) -> str:
    """CTEs up to u(page, unit, line, lines, kind, section, open, text, claim) of rows (page, body)."""
    return rf"""
        raw AS ({rows}),
        b1 AS ({_blank("raw", r"(?s)\A---\s*\n.*?\n---\s*\n")}), b2 AS ({_blank("b1", r"(?s)```.*?```")}), b3 AS ({_blank("b2", r"(?s)<!--\s*skip-grounding-start\s*-->.*?<!--\s*skip-grounding-end\s*-->")}), b4 AS ({_blank("b3", r"(?s)<!--.*?-->")}),
        l0 AS (SELECT b4.page, regexp_matches(raw.body, '\A---\n(.*\n)*?type: idea\n(.*\n)*?---\n') AS idea, unnest(string_split(b4.body, chr(10))) AS line, generate_subscripts(string_split(b4.body, chr(10)), 1) AS i FROM b4 JOIN raw ON raw.page = b4.page),
        l1 AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^##[ \t]+\S') THEN line END IGNORE NULLS) OVER (PARTITION BY page ORDER BY i) AS section FROM l0),
        l2 AS (SELECT page, i, idea, section, CASE WHEN regexp_matches(coalesce(section, ''), '(?i)^##[ \t]+what would update this page\b') THEN '' ELSE line END AS line FROM l1),
        l3 AS (SELECT *, regexp_matches(line, '^\s*$') AS blank, regexp_matches(line, '^\s{{0,3}}#{{1,6}}\s') AS heading, CASE WHEN regexp_matches(line, '^\s*([-*+]|\d+\.)\s+') THEN len(regexp_extract(line, '^(\s*)', 1)) END AS indent FROM l2),
        l4 AS (SELECT *, sum((blank OR heading)::INT) OVER (PARTITION BY page ORDER BY i) AS run FROM l3),
        l5 AS (SELECT *, min(indent) OVER w AS depth, row_number() OVER (PARTITION BY page, run, blank OR heading ORDER BY i) AS nth FROM l4 WINDOW w AS (PARTITION BY page, run, blank OR heading ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l6 AS (SELECT *, heading OR nth = 1 OR (indent IS NOT NULL AND (depth IS NULL OR indent <= depth)) AS opens FROM l5 WHERE NOT blank),
        l7 AS (SELECT *, sum(opens::INT) OVER (PARTITION BY page ORDER BY i) - 1 AS unit FROM l6),
        u0 AS (SELECT page, unit, min(i) AS line, count(*) AS lines, arg_min(CASE WHEN heading THEN 'heading' WHEN indent IS NOT NULL THEN 'bullet' ELSE 'paragraph' END, i) AS kind,
          arg_min(idea AND regexp_matches(coalesce(section, ''), '(?i)^##[ \t]+(opportunities|plans)\b'), i) AS open, regexp_replace(string_agg(line, chr(10) ORDER BY i), '\s+$', '') AS text FROM l7 GROUP BY page, unit),
        u1 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[*_`>~]+', '', 'g'), '{_LINK}', '', 'g'), '\bclaim_id\s*[:=]\s*\d+', '', 'g'), '\[\^[^\]\s]+\]', '', 'g') AS bare0 FROM u0),
        u2 AS (SELECT *, regexp_replace(regexp_replace(bare0, '^\s+', ''), '\s+$', '') AS bare FROM u1),
        u AS (SELECT page, unit, line, lines, kind, open, text, kind <> 'heading' AND len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^[ \t]*\[\^[^\]\s]+\]:'))) > 0 AND right(bare, 1) <> '?'
          AND NOT regexp_matches(bare, '(?i)\bno (paper|wiki page) (covers|in this wiki)|\bthe wiki (has no|does not|doesn''t)|\bi (don''t have|do not have|haven''t|need to check)|\bi''?d need to check the pdf|\bi (would need|cannot answer|can''t answer)')
          AND len(regexp_extract_all(bare, '[A-Za-z][A-Za-z0-9''\-]+')) >= 8 AS claim FROM u2)"""


_NOTES = rf"""
        fn0 AS (SELECT page, unnest(regexp_extract_all(body, '(?m)^[ \t]*\[\^[^\]\s]+\]:[ \t]*.*$')) AS d, generate_subscripts(regexp_extract_all(body, '(?m)^[ \t]*\[\^[^\]\s]+\]:[ \t]*.*$'), 1) AS k FROM raw),
        fn AS (SELECT page, regexp_extract(d, '\[\^([^\]\s]+)\]', 1) AS note, k, regexp_extract_all(regexp_extract(d, '\]:[ \t]*(.*)$', 1), '\[\[([^\]]+)\]\]', 1) AS links, regexp_matches(d, '(?i)\bclaim_id\s*[:=]\s*\d+\b') AS id FROM fn0)"""
_ANCHOR = r"^([^\]\|#\s]+)#([a-z0-9]{2,3}-[a-z0-9-]+)(\|[^\]]+)?$"
_STATES = rf"""
        sl AS ({_SLUGS}),
        k AS (SELECT page, unit, unnest(regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1)) AS link FROM u),
        ka AS (SELECT page, unit, bool_or(NOT regexp_matches(link, '{_ANCHOR}')) AS plain, bool_or(regexp_matches(link, '{_ANCHOR}')) AS anchored,
          bool_or(EXISTS (SELECT 1 FROM sl WHERE sl.stem = regexp_extract(regexp_extract(link, '{_ANCHOR}', 1), '([^/]*)$', 1) AND sl.slug = regexp_extract(link, '{_ANCHOR}', 2))) AS met FROM k GROUP BY page, unit),
        r AS (SELECT DISTINCT page, unit, unnest(regexp_extract_all(text, '\[\^([^\]\s]+)\]', 1)) AS note FROM u),
        rn AS (SELECT DISTINCT r.page, r.unit FROM r JOIN fn ON fn.page = r.page AND fn.note = r.note WHERE len(links) > 0 OR id),
        j AS (SELECT u.*, CASE WHEN NOT claim THEN 'not-a-claim' WHEN coalesce(plain, false) OR coalesce(met, false) OR rn.page IS NOT NULL OR regexp_matches(text, '(?i)\bclaim_id\s*[:=]\s*\d+\b') THEN 'grounded'
          WHEN open AND regexp_matches(text, '(?i)\*\(\s*model\s+prior\s*\)\*') THEN 'model-prior' WHEN coalesce(anchored, false) THEN 'dangling-anchor' ELSE 'ungrounded' END AS state
          FROM u LEFT JOIN ka ON ka.page = u.page AND ka.unit = u.unit LEFT JOIN rn ON rn.page = u.page AND rn.unit = u.unit)"""


def _numbers(text: str) -> str:
    """Numbers as they are spelt; a letter that begins a word is no magnitude."""
    return rf"""regexp_extract_all(regexp_replace({text}, '([0-9])(\s?[KkMmBbGg][A-Za-z])', '\1' || chr(1) || '\2', 'g'), '(?:^|[^\p{{L}}\p{{N}}_.])([0-9][0-9,]*(?:\.[0-9]+)?(?:\s?[KkMmBbGg])?)', 1)"""


def _joined(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '(^|[^0-9.])([0-9]{{1,3}}) ([0-9]{{3}})([^0-9,]|,[^0-9]|,$|$)', '\1\2\3\4', 'g'), '(^|[^0-9.])([0-9]{{1,3}}) ([0-9]{{3}}) ([0-9]{{3}})([^0-9,]|,[^0-9]|,$|$)', '\1\2\3\4\5', 'g')"


def _trim(x: str) -> str:
    return rf"CASE WHEN contains({x}, '.') THEN regexp_replace(regexp_replace({x}, '0+$', ''), '\.$', '') ELSE {x} END"


def _forms(t: str) -> str:
    mag = r"([0-9][0-9,]*(?:\.[0-9]+)?)\s?([KkMmBbGg])\b"
    plain = f"regexp_replace({t}, '[^0-9.]', '', 'g')"
    full = f"(TRY_CAST(replace(regexp_extract({t}, '{mag}', 1), ',', '') AS DECIMAL(28,8)) * CASE lower(regexp_extract({t}, '{mag}', 2)) WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 WHEN 'b' THEN 1000000000 WHEN 'g' THEN 1000000000 END::DECIMAL(10,0))::VARCHAR"
    return f"list_filter([{_trim(plain)}, {_trim(full)}], lambda z: z IS NOT NULL AND z <> '')"


def _all_forms(text: str) -> str:
    return f"list_distinct(flatten(list_transform({_numbers(_joined(text))}, lambda t: {_forms('t')})))"


_NEG = r"(?i)\b(not|no|never|without|cannot|can''?t|don''?t|doesn''?t|didn''?t|won''?t|wouldn''?t|isn''?t|aren''?t|wasn''?t|weren''?t|hasn''?t|haven''?t|fails?\s+to|failed\s+to|unable\s+to|lack\s+of|absence\s+of|absent)\b"
_TOKENS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"


def _hits(claims: str, k: int) -> str:
    """CTEs up to hit(qid, stem, c, score, rank, chunk) for claims CTE (qid, stem, text) over sources CTE ``src``."""
    return rf"""
        w0 AS (SELECT stem, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM src WHERE stem IN (SELECT stem FROM {claims})),
        w1 AS (SELECT stem, w, unnest(range(0, greatest(ceil((len(w) - 250) / 190.0), 0)::BIGINT + 1)) AS c FROM w0 WHERE len(w) > 0),
        ch AS (SELECT stem, c, array_to_string(w[c * 190 + 1 : c * 190 + 250], ' ') AS chunk FROM w1 WHERE len(w[c * 190 + 1 : c * 190 + 250]) >= 30 OR c = 0),
        ct AS (SELECT stem, c, {_TOKENS.format('chunk')} AS t FROM ch), st AS (SELECT stem, count(*) AS n, avg(len(t)) AS mean FROM ct GROUP BY stem),
        tf AS (SELECT stem, c, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT stem, c, len(t) AS dl, unnest(t) AS term FROM ct) GROUP BY stem, c, term),
        df AS (SELECT *, count(*) OVER (PARTITION BY stem, term) AS df FROM tf),
        q AS (SELECT qid, stem, term, count(*) AS asked FROM (SELECT qid, stem, unnest({_TOKENS.format('text')}) AS term FROM {claims}) GROUP BY ALL),
        sc AS (SELECT q.qid, q.stem, df.c, round(sum(asked * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM q JOIN df ON df.stem = q.stem AND df.term = q.term JOIN st ON st.stem = q.stem GROUP BY ALL),
        rk AS (SELECT *, row_number() OVER (PARTITION BY qid, stem ORDER BY score DESC, c) AS rank FROM sc), hit AS (SELECT rk.*, chunk FROM rk JOIN ch ON ch.stem = rk.stem AND ch.c = rk.c WHERE rank <= {k})"""


_PAGE = rf"""
        src AS ({_SOURCE}), cl AS (SELECT *, stem || '|' || section || '|' || position AS qid FROM ({_CLAIM})), asked AS (SELECT qid, stem, text FROM cl WHERE NOT is_cross_ref), {_hits('asked', 5)},
        ev AS (SELECT qid, string_agg(chunk, ' ' ORDER BY rank) FILTER (rank <= 3) AS e, max(score) FILTER (rank = 1) AS top1, floor(sum(round(score * 1000000)::BIGINT) FILTER (rank <= 3) / count(*) FILTER (rank <= 3)) / 1e6 AS top3, max(c) FILTER (rank = 1) AS c, max(chunk) FILTER (rank = 1) AS best FROM hit GROUP BY qid),
        kn AS (SELECT qid, {_all_forms('e')} AS f FROM ev), sf AS (SELECT stem, {_all_forms('text')} AS f FROM src),
        g AS (SELECT cl.*, NOT is_cross_ref AS graded, coalesce(ev.top1, 0) AS top1, coalesce(ev.top3, 0) AS top3, coalesce(ev.c, -1) AS c, substr(coalesce(best, ''), 1, 500) AS support,
          CASE WHEN ev.qid IS NULL THEN [] ELSE {_numbers(_joined('cl.text'))} END AS nums, kn.f AS near, sf.f AS whole, ev.qid IS NOT NULL AND regexp_matches(cl.text, '{_NEG}') AND NOT regexp_matches(e, '{_NEG}') AS neg
          FROM cl LEFT JOIN ev ON ev.qid = cl.qid LEFT JOIN kn ON kn.qid = cl.qid LEFT JOIN sf ON sf.stem = cl.stem),
        gr AS (SELECT *, list_filter(nums, lambda t: NOT list_has_any({_forms('t')}, list_concat(near, whole))) AS bad FROM g)"""
_CITED = rf"""
        src AS ({_SOURCE}), fact AS ({_FACTS}),
        cu AS (SELECT *, page || '|' || unit AS qid, regexp_replace(regexp_replace(regexp_replace(text, '{_LINK}', ' ', 'g'), '\[\^[^\]\s]+\]', ' ', 'g'), '\b[0-9]{{4}}-[0-9]{{2}}(?:-[0-9]{{2}})?\b', ' ', 'g') AS told FROM u WHERE claim),
        own AS (SELECT qid, 0 AS tier, generate_subscripts(regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1), 1) AS i, 0 AS j, unnest(regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1)) AS link FROM (SELECT qid, text FROM cu)),
        ref AS (SELECT qid, page, unnest(regexp_extract_all(text, '\[\^([^\]\s]+)\]', 1)) AS note, generate_subscripts(regexp_extract_all(text, '\[\^([^\]\s]+)\]', 1), 1) AS i FROM cu),
        lastd AS (SELECT page, note, arg_max(links, k) AS links FROM fn WHERE len(links) > 0 GROUP BY page, note),
        thr AS (SELECT qid, 1 AS tier, i, generate_subscripts(links, 1) AS j, unnest(links) AS link FROM ref JOIN lastd ON lastd.page = ref.page AND lastd.note = ref.note),
        ci0 AS (SELECT qid, tier, i, j, trim(regexp_extract(trim(string_split(string_split(link, '|')[1], '#')[1]), '([^/]*)$', 1)) AS stem FROM (FROM own UNION ALL FROM thr)),
        ci AS (SELECT qid, stem, min((tier, i, j)) AS spot, stem IN (SELECT stem FROM src) AS held FROM ci0 GROUP BY qid, stem),
        asked AS (SELECT ci.qid, ci.stem, spot, cu.text, cu.told FROM ci JOIN cu ON cu.qid = ci.qid WHERE held), {_hits('asked', 10)},
        ev AS (SELECT qid, stem, string_agg(chunk, ' ' ORDER BY rank) AS e, max(score) AS top FROM hit GROUP BY qid, stem),
        per AS (SELECT a.*, coalesce(e, '') AS e, coalesce(top, 0) AS top, s.f AS whole, {_all_forms("coalesce(e, '')")} AS near FROM asked a LEFT JOIN ev ON ev.qid = a.qid AND ev.stem = a.stem JOIN (SELECT stem, {_all_forms('text')} AS f FROM src) s ON s.stem = a.stem),
        mis AS (SELECT qid, t, count(*) AS lacking FROM (SELECT qid, stem, near, whole, unnest(list_distinct({_numbers(_joined('told'))})) AS t FROM per) WHERE NOT list_has_any({_forms('t')}, list_concat(near, whole)) GROUP BY qid, t),
        agg AS (SELECT qid, count(*) AS n, string_agg(stem, '|' ORDER BY spot) AS cited, min((-top, spot, stem)) FILTER (top > 0) AS b, bool_or(regexp_matches(e, '{_NEG}')) AS denied FROM per GROUP BY qid),
        un AS (SELECT qid, string_agg(stem, '|' ORDER BY spot) AS unresolved FROM ci WHERE NOT held GROUP BY qid),
        wr AS (SELECT qid, string_agg(DISTINCT x.stem || '#' || x.slug, '|' ORDER BY x.stem || '#' || x.slug) AS wrong FROM (SELECT qid, told, regexp_extract(regexp_extract(link, '{_ANCHOR}', 1), '([^/]*)$', 1) AS stem, regexp_extract(link, '{_ANCHOR}', 2) AS slug
          FROM (SELECT cu.qid, told, link FROM cu JOIN own ON own.qid = cu.qid) WHERE regexp_matches(link, '{_ANCHOR}')) x JOIN fact ON fact.stem = x.stem AND fact.slug = x.slug
          WHERE len(list_filter({_numbers(_joined('x.told'))}, lambda t: NOT list_has_any({_forms('t')}, {_all_forms('fact.text')}))) > 0 GROUP BY qid),
        res AS (SELECT cu.page, cu.line, coalesce(cited, '') AS cited, coalesce(unresolved, '') AS unresolved, b[3] AS best_stem, coalesce(-b[1], 0) AS best_bm25,
          array_to_string(list_filter({_numbers('told')}, lambda t: list_contains(coalesce(lack, []), t)), '|') AS unmatched,
          coalesce(n, 0) > 0 AND regexp_matches(text, '{_NEG}') AND NOT coalesce(denied, false) AS negation_mismatch, coalesce(wrong, '') AS wrong_anchors, n, text
          FROM cu LEFT JOIN agg ON agg.qid = cu.qid LEFT JOIN (SELECT mis.qid, list(t) AS lack FROM mis JOIN agg ON agg.qid = mis.qid WHERE lacking = agg.n GROUP BY mis.qid) lk ON lk.qid = cu.qid LEFT JOIN un ON un.qid = cu.qid LEFT JOIN wr ON wr.qid = cu.qid),
        fin AS (SELECT * EXCLUDE (n, text), CASE WHEN coalesce(n, 0) = 0 THEN 'uncited' WHEN unmatched <> '' THEN 'misattributed' WHEN wrong_anchors <> '' THEN 'anchor_misattributed'
          WHEN n >= 2 AND regexp_matches(text, '(?i)\b(faster|slower|higher|lower|larger|smaller|better|worse|cheaper|more|less|greater|fewer|outperform\w*|exceed\w*|surpass\w*|compared\s+to|relative\s+to|whereas|unlike|versus|vs\.?|in\s+contrast|than)\b') THEN 'composite'
          WHEN best_bm25 < 1.0 THEN 'weak' ELSE 'supported' END AS verdict FROM res)"""

ORACLES |= {
    "q_quantities": f"SELECT number, count(*) AS n, array_to_string(any_value({_forms('number')}), '|') AS forms FROM (SELECT unnest({_numbers(_joined('text'))}) AS number FROM ({_SOURCE})) GROUP BY number",
    "q_grounding_units": f"WITH {_units(_SHEET)}, {_NOTES}, {_STATES} SELECT page, unit::BIGINT AS unit, line, lines, kind, state, md5(text) AS digest FROM j",
    "q_grounding_marks": rf"""WITH {_units(_SHEET)}, {_NOTES}, {_STATES},
        o AS (SELECT page, unnest(string_split(body, chr(10))) AS x, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM raw),
        m AS (SELECT page, line, lines, CASE WHEN state IN ('ungrounded', 'dangling-anchor') THEN ' ⚠ ungrounded' WHEN state = 'model-prior' THEN ' ⚠ model prior' END AS mark, CASE WHEN kind = 'bullet' THEN regexp_extract(text, '^(\s*)(?:[-*+]|\d+\.)\s+') ELSE '' END AS lead FROM j),
        a AS (SELECT o.page, md5(string_agg(CASE WHEN mark IS NULL OR contains(x, mark) THEN x ELSE regexp_replace(x, '\s+$', '') || mark END, chr(10) ORDER BY i)) AS annotated FROM o LEFT JOIN m ON m.page = o.page AND i = line + lines - 1 GROUP BY o.page),
        s AS (SELECT o.page, md5(string_agg(CASE WHEN i = line THEN lead || '*[ungrounded — I''d need to check the PDF for this.]*' ELSE x END, chr(10) ORDER BY i) FILTER (line IS NULL OR i = line)) AS stripped
          FROM o LEFT JOIN m ON m.page = o.page AND mark = ' ⚠ ungrounded' AND i BETWEEN line AND line + lines - 1 GROUP BY o.page)
        SELECT page, annotated, stripped FROM a JOIN s USING (page)""",
    "q_page_fidelity": f"WITH {_PAGE} SELECT stem, section, position, graded, top1 AS top1_score, top3 AS top3_mean, c AS chunk, md5(support) AS evidence, array_to_string(nums, '|') AS numbers, array_to_string(bad, '|') AS unmatched, neg AS negation_mismatch FROM gr",
    "q_page_fidelity_report": f"""WITH {_PAGE}, s AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY top1, section, position) AS r, count(*) OVER (PARTITION BY stem) AS n FROM gr WHERE graded)
        SELECT gr.stem, count(*) AS n_claims, count(*) FILTER (gr.graded) AS n_graded, count(*) FILTER (gr.is_cross_ref) AS n_cross_refs, coalesce(floor(sum(round(gr.top1 * 1000000)::BIGINT) FILTER (gr.graded) / count(*) FILTER (gr.graded)) / 1e6, 0) AS mean_top1,
          coalesce((SELECT top1 FROM s WHERE s.stem = gr.stem AND r = n // 2 + 1), 0) AS median_top1, md5((SELECT text FROM s WHERE s.stem = gr.stem AND r = 1)) AS weakest, (SELECT top1 FROM s WHERE s.stem = gr.stem AND r = 1) AS weakest_score,
          count(*) FILTER (gr.graded AND len(gr.bad) > 0) AS n_with_numeric_drift, count(*) FILTER (gr.neg) AS n_negation_mismatches FROM gr GROUP BY gr.stem""",
    "q_page_fidelity_persisted": f"""WITH {_PAGE} SELECT stem, section, position, 'kept' AS note, CASE WHEN graded THEN top1 END AS bm25_top1, CASE WHEN graded THEN top3 END AS bm25_top3_mean,
        CASE WHEN len(nums) > 0 THEN to_json(nums)::VARCHAR END AS numeric_tokens, CASE WHEN len(bad) > 0 THEN to_json(bad)::VARCHAR END AS numeric_unmatched, neg::BIGINT AS negation_mismatch, 7::BIGINT AS last_graded_at FROM gr WHERE (length(text) + position) % 4 <> 0""",
    "q_synthesis_fidelity": f"WITH {_units(_SYNTHESIS)}, {_NOTES}, {_CITED} SELECT * FROM fin",
    "q_synthesis_report": f"""WITH {_units(_SYNTHESIS)}, {_NOTES}, {_CITED}, t AS (SELECT page, count(*) FILTER (verdict <> 'uncited') AS n_claims, count(*) FILTER (verdict = 'supported') AS n_supported, count(*) FILTER (verdict = 'weak') AS n_weak, count(*) FILTER (verdict = 'composite') AS n_composite,
        count(*) FILTER (verdict = 'misattributed') AS n_misattributed, count(*) FILTER (verdict = 'anchor_misattributed') AS n_anchor_misattributed, count(*) FILTER (verdict = 'uncited') AS n_uncited FROM fin GROUP BY page)
        SELECT *, n_misattributed + n_anchor_misattributed = 0 AS ok FROM t""",
}
