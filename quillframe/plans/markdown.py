"""Queries on pages as files: front matter, link lists, spokes, phrases, ligatures.  Pages are made from documents, whole texts in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators import phrases
from quillframe.plans.fidelity import _rows
from quillframe.sources import frontmatter

_FILES = """SELECT 'wiki/' || lang || '/d' || doc_id || '.md' AS path, CASE WHEN doc_id % 13 = 0 THEN 'no fence ' ELSE '---' || chr(10) END || 'title: "It''s no. ' || doc_id || ': ' || source || ' # x"' || chr(10) || 'year: ' || (2000 + doc_id % 25) || '   # when'
    || chr(10) || 'meta:' || chr(10) || '  size: {chars: ' || n_chars || ', lang: [' || lang || ', x]}' || chr(10) || 'tags:' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '- [[' || lang || '/x]]' ELSE '  - "[[' || lang || '/x]]"' END || chr(10)
    || 'notes: |2-' || chr(10) || '  ' || replace(text, chr(10), chr(10) || '  ') || chr(10) || CASE WHEN doc_id % 11 = 0 THEN 'bad: a: b' || chr(10) ELSE '' END || '---' || chr(10) || 'Body of ' || doc_id AS raw, doc_id, lang, n_chars, text, source FROM documents"""
_TEXTS = """SELECT doc_id, replace(replace(text, '. ', CASE doc_id % 4 WHEN 0 THEN ' of the base editing assay. ' WHEN 1 THEN ' for off-target  effects. ' WHEN 2 THEN ' when using our foundation model. ' ELSE ' and this model. ' END), ', ', ', a prime editing screen ') AS text FROM documents"""
_HUBS = """SELECT doc_id AS hub, CASE doc_id % 3 WHEN 0 THEN 'cells' WHEN 1 THEN ' Base ' ELSE '' END AS term, '# Hub' || chr(10) || '- [[d1]]' || chr(10) || '## How it appears across the corpus' || chr(10)
    || '- [[' || lang || '/d' || (doc_id % 50) || ']] says ' || replace(text, chr(10), ' ') || chr(10) || '- [[d' || (doc_id % 70) || ']], - [[d' || (doc_id % 50) || ']] and [[d2]]' || chr(10) || '- [[d3#kc-1a]]' || chr(10) || '-  [[d4|four]] - [[d' || (doc_id % 70) || ']]'
    || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '## Next' || chr(10) || '- [[d' || (doc_id % 50) || ']]' ELSE '' END AS body FROM documents"""
_CLAIMS = "SELECT 'd' || doc_id AS stem, 'kc-' || (doc_id % 9) || 'a' AS slug, CAST(doc_id % 2 AS INT) AS section_rank, CAST(doc_id % 3 AS INT) AS position, CASE doc_id % 4 WHEN 0 THEN 'It has 9 cells ' WHEN 1 THEN 'Two-base steps ' WHEN 2 THEN 'Subcells of baseline ' ELSE 'The BASE of all cells: ' END || text AS text FROM documents"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f"q_{f.__name__}"] = f
    return f


@_query
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of every page, nested ones and whole texts among them; pages that don't parse have an error's line and no fields."""
    get = lambda p, kind: F.try_variant_get("fields", p, kind)
    return frontmatter.pages(_rows(spark, sf_dir, _FILES).select("path", "raw")).select(
        "stem", "category", get("$.title", "string").alias("title"), get("$.year", "long").alias("year"), get("$.meta.size.chars", "long").alias("chars"), get("$.meta.size.lang[0]", "string").alias("lang"),
        F.md5(get("$.notes", "string").cast("binary")).alias("notes"), F.col("line").cast("long").alias("line"), "body")


@_query
def invalid_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontmatter.invalid(frontmatter.pages(_rows(spark, sf_dir, _FILES).select("path", "raw"))).select("path", F.col("line").cast("long").alias("line"))


@_query
def unquoted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontmatter.unquoted_links(_rows(spark, sf_dir, _FILES).select("path", "raw"))


@_query
def phrase_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrase_counts(_rows(spark, sf_dir, _TEXTS), "doc_id", phrases.lower_phrases(F.col("text")))


@_query
def upgraded_spokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = phrases.upgraded_spokes(_rows(spark, sf_dir, _HUBS), _rows(spark, sf_dir, _CLAIMS))
    return done.select("hub", F.md5(F.col("body").cast("binary")).alias("digest"), "upgraded", "skipped")


_LINE = "len(raw) - len(replace(raw, chr(10), '')) - 1"
_BASE = f"base AS (SELECT *, doc_id % 11 = 0 AS bad FROM ({_FILES}) WHERE doc_id % 13 <> 0)"
_NOUNS = "|".join(sorted(phrases.HEAD_NOUNS, key=lambda h: (-len(h), h)))
ORACLES = {
    "q_front_matter": rf"""WITH {_BASE} SELECT 'd' || doc_id AS stem, lang AS category, CASE WHEN NOT bad THEN 'It''s no. ' || doc_id || ': ' || source || ' # x' END AS title, CASE WHEN NOT bad THEN 2000 + doc_id % 25 END AS year, CASE WHEN NOT bad THEN n_chars END AS chars,
        CASE WHEN NOT bad THEN lang END AS lang, CASE WHEN NOT bad THEN md5(regexp_replace(text, '\n+$', '')) END AS notes, CASE WHEN bad THEN {_LINE} END AS line, 'Body of ' || doc_id AS body FROM base""",
    "q_invalid_front_matter": f"WITH {_BASE} SELECT path, {_LINE} AS line FROM base WHERE bad",
    "q_unquoted_links": f"WITH {_BASE} SELECT path, 'tags' AS field FROM base WHERE doc_id % 3 = 0",
    "q_phrase_candidates": rf"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:[a-z][a-z\-]*(?:\s+|-)){{1,2}}(?:{_NOUNS})\b')) AS x FROM ({_TEXTS})),
        c AS (SELECT doc_id, regexp_replace(regexp_replace(trim(x), '\s+', ' ', 'g'), '^(?:(?:{'|'.join(phrases.LEADING_STOPWORDS)}) )+', '') AS phrase FROM f),
        e AS (SELECT doc_id, phrase, count(*) AS n FROM c WHERE contains(phrase, ' ') AND phrase NOT IN {phrases.STOP_PHRASES} GROUP BY ALL),
        w AS (SELECT a.doc_id, a.phrase, a.n, coalesce(sum(b.n), 0) AS within FROM e a LEFT JOIN e b ON b.doc_id = a.doc_id AND ends_with(b.phrase, ' ' || a.phrase) GROUP BY ALL)
        SELECT phrase, sum(n)::BIGINT AS n, sum(greatest(n - within, 0))::BIGINT AS alone, count(*) AS texts FROM w GROUP BY phrase""",
    "q_upgraded_spokes": rf"""WITH h AS ({_HUBS}), s AS (SELECT *, regexp_extract(body, '(?s)^(.*?## How it appears across the corpus\n)', 1) AS a FROM h),
        p AS (SELECT *, substr(body, len(a) + 1) AS rest FROM s), q AS (SELECT *, CASE WHEN contains(rest, chr(10) || '## ') THEN regexp_extract(rest, '(?s)^(.*?)\n## ', 1) ELSE rest END AS m FROM p),
        r AS (SELECT *, substr(rest, len(m) + 1) AS z, regexp_split_to_array(m, '-\s*\[\[[^\]\|#]+\]\]') AS ps, regexp_extract_all(m, '-\s*\[\[[^\]\|#]+\]\]') AS ms FROM q),
        x AS (SELECT hub, lower(trim(term)) AS term, unnest(ms) AS sp, generate_subscripts(ms, 1) AS i FROM r),
        y AS (SELECT hub, i, sp, term, regexp_extract(sp, '([^/\[]+)\]\]$', 1) AS stem FROM x WHERE term <> ''),
        b AS (SELECT hub, i, sp, arg_min(slug, (section_rank, position, slug)) AS slug FROM y JOIN ({_CLAIMS}) c ON c.stem = y.stem AND regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])' || term || '($|[^\p{{L}}\p{{N}}_])') GROUP BY hub, i, sp),
        n AS (SELECT x.hub, list(coalesce(replace(x.sp, ']]', '#' || b.slug || ']]'), x.sp) ORDER BY x.i) AS ns, count(b.slug) AS up, count(*) FILTER (term <> '') AS asked FROM x LEFT JOIN b ON b.hub = x.hub AND b.i = x.i GROUP BY x.hub)
        SELECT r.hub, md5(CASE WHEN coalesce(up, 0) = 0 THEN body ELSE a || array_to_string(list_transform(range(1, len(ps) + 1), lambda k: ps[k] || coalesce(ns[k], '')), '') || z END) AS digest, coalesce(up, 0) AS upgraded, coalesce(asked, 0) - coalesce(up, 0) AS skipped
        FROM r LEFT JOIN n ON n.hub = r.hub""",
}
