"""Queries on claim edges, curation, records, the event log and work lists.

The tables stand for them by plain SELECTs that Spark and DuckDB both read; each query applies an operator to such rows, and its
SQL counterpart says the same over the same SELECTs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.functions import quantities, values
from quillframe.operators import claims, concepts, curation, edges, fulltext, grading, joins, lint, lookup, ranking, records, snapshots, vectors
from quillframe.sources.tables import TABLES, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rows by name, as both engines read them.
ROWS = {
    "edge": "SELECT o_orderkey AS id, 'c' || (o_custkey % 40) AS src, 'c' || (o_orderkey % 37) AS tgt, CASE o_orderkey % 3 WHEN 0 THEN 'supports' WHEN 1 THEN 'contradicts' ELSE 'extends' END AS relation, CASE (o_orderkey + o_custkey) % 4 WHEN 0 THEN 'candidate' WHEN 1 THEN 'active' WHEN 2 THEN 'rejected' ELSE 'stale' END AS status, o_orderdate AS updated_at FROM orders",
    "ref": "SELECT DISTINCT l_orderkey AS page, CASE l_orderkey % 3 WHEN 0 THEN 'synthesis' WHEN 1 THEN 'concept' ELSE 'paper' END AS kind, l_suppkey AS stem FROM lineitem",
    "next_edge": "SELECT DISTINCT l_suppkey AS id, l_suppkey AS src, l_suppkey + 1 AS tgt, CASE l_suppkey % 2 WHEN 0 THEN 'supports' ELSE 'extends' END AS relation FROM lineitem",
    "member": "SELECT DISTINCT l_orderkey AS hub, l_suppkey AS stem, 'k' || (l_suppkey % 4) AS category FROM lineitem",
    "by_claim": "SELECT DISTINCT l_suppkey AS stem, 's' || l_linenumber AS slug FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 3 <> 0",
    "by_keyword": "SELECT DISTINCT l_suppkey AS stem, 'k' || (l_partkey % 7) AS slug FROM lineitem",
    "drafted": "SELECT DISTINCT o_custkey AS src, o_orderkey % 900 AS link FROM orders",
    "known": "SELECT c_custkey AS key FROM customer WHERE c_custkey % 3 <> 0",
    "allowed": "SELECT DISTINCT o_custkey AS src, o_orderkey % 900 AS link FROM orders WHERE o_orderstatus = 'F'",
    "listed": "SELECT DISTINCT l_partkey AS stem, l_linenumber AS file FROM lineitem WHERE l_returnflag = 'A'",
    "present": "SELECT DISTINCT l_partkey AS stem, l_linenumber AS file FROM lineitem WHERE l_returnflag = 'R'",
    "link": "SELECT o_orderkey AS src, o_custkey AS tgt, CASE o_orderkey % 3 WHEN 0 THEN 'cites it' WHEN 1 THEN 'cited by it' ELSE 'same topic' END AS note FROM orders",
    "back": "SELECT o_custkey AS src, o_orderkey AS tgt FROM orders WHERE o_orderstatus = 'O'",
    "page": "SELECT doc_id, lang, n_chars AS score FROM documents",
    "score": "SELECT doc_id, CAST(quality AS BIGINT) * 100 AS score FROM labels",
    "log": "SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 's' || user_id END AS stem FROM events",
    "candidate": "SELECT DISTINCT p_name AS slug FROM part",
    "verdict": "SELECT p_name AS slug, min(p_brand) AS verdict FROM part WHERE p_size < 3 GROUP BY p_name",
    "told": "SELECT lang, CASE WHEN toxic = 1 THEN 'hard' WHEN quality = 0 THEN 'weak' ELSE 'supported' END AS verdict FROM documents JOIN labels ON documents.doc_id = labels.doc_id",
    "cited": "SELECT o_custkey AS src, o_orderkey % 50 AS tgt FROM orders",
    "citing": "SELECT o_orderkey % 70 AS src, o_custkey AS tgt FROM orders WHERE o_orderstatus = 'F'",
    "recommended": "SELECT p_brand AS category, l_suppkey AS src, 'd' || (l_partkey % 200) AS doi FROM lineitem JOIN part ON l_partkey = p_partkey",
    "ruled": "SELECT doc_id AS key, CASE WHEN doc_id % 5 = 0 THEN 'review' ELSE 'paper' END AS type, CASE WHEN doc_id % 7 = 0 THEN 'concept' ELSE 'paper' END AS folder, lang AS category, CASE doc_id % 4 WHEN 0 THEN 'todo' WHEN 1 THEN NULL ELSE '10.1/' || doc_id END AS doi, CASE WHEN doc_id % 8 = 0 THEN 'thesis' END AS no_doi_reason, CAST(2000 + doc_id % 20 AS INT) AS year, 'smith-' || (2000 + doc_id % 19) || 'b-x' AS stem, split(substr(text, 1, 40), ' ') AS keywords, substr(text, 1, CAST(n_chars % 400 AS INT)) AS hook, source AS venue, '- (none)' || chr(10) || CASE WHEN doc_id % 6 = 0 THEN '- one' ELSE '' END AS body FROM documents",
    "voted": "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE lang END AS model, CAST(doc_id % 100 AS DOUBLE) / 100 AS confidence, lang <> 'fr' AS valid, CASE doc_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN lang END AS near, doc_id % 2 = 0 AS strong FROM documents",
    "tiered": "SELECT lang, doc_id AS position, CASE doc_id % 4 WHEN 0 THEN 'key' WHEN 1 THEN 'side' WHEN 2 THEN 'other' ELSE 'unknown' END AS tier, text FROM documents",
    "doi_page": "SELECT c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE ' 10.1/X' || (c_custkey % 300) END AS doi FROM customer",
    "doi_ref": "SELECT o_custkey AS src, '10.1/x' || (o_orderkey % 400) AS doi FROM orders",
    "titled": "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'A survey of ' WHEN 1 THEN 'Protocol for ' WHEN 2 THEN 'An atlas of ' WHEN 3 THEN 'A new tool, ' ELSE '' END || substr(text, 1, 30) AS title, CASE doc_id % 11 WHEN 0 THEN 'Annual Review of X' ELSE source END AS venue, CASE doc_id % 5 WHEN 0 THEN 'This article has been retracted. ' WHEN 1 THEN 'This is a preprint. ' WHEN 2 THEN 'Accepted Manuscript ' WHEN 3 THEN 'A randomised study. ' ELSE '' END || text AS text, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '10.1/' || doc_id END AS doi FROM documents",
    "draft": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(doc_id % 100 AS DOUBLE) / 100 END AS fidelity, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(n_chars % 100 AS DOUBLE) / 100 END AS salience, CAST(doc_id % 14 AS INT) AS anchors, CAST(doc_id % 3 AS INT) AS drift FROM documents",
    "claim": "SELECT doc_id AS id, 'p' || (doc_id % 60) AS stem, 'q' || (doc_id % 500) AS slug, doc_id AS position, text, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(doc_id % 90 AS DOUBLE) / 100 END AS semantic, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(n_chars % 20 AS DOUBLE) END AS bm25, CAST(doc_id % 2 AS INT) AS unmatched, doc_id % 13 = 0 AS negated, doc_id % 6 = 0 AS is_cross_ref FROM documents",
    "ranked_term": "SELECT p_name AS key, p_brand AS term, p_size % 3 AS source_rank, p_size AS pages, p_partkey % 5 AS categories FROM part",
    "hashed": "SELECT doc_id, n_chars AS h, lang FROM documents",
    "cached": "SELECT doc_id, n_chars + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS h, 1 AS vec FROM documents WHERE doc_id % 7 <> 0",
    "hit": "SELECT DISTINCT l_suppkey AS page, l_partkey AS key FROM lineitem WHERE l_returnflag = 'N'",
    "linked": "SELECT DISTINCT l_suppkey AS page, l_partkey AS key FROM lineitem WHERE l_returnflag = 'R'",
    "anchor": "SELECT DISTINCT 'p' || (l_suppkey % 70) AS stem, 'q' || (l_partkey % 600) AS slug FROM lineitem",
    "run": "SELECT DISTINCT o_custkey AS stem, CAST(o_orderkey % 6 AS INT) AS exit FROM orders WHERE o_orderstatus <> 'O'",
    "input": "SELECT c_custkey AS stem FROM customer",
    "keyword": "SELECT DISTINCT 'h' || (l_suppkey % 20) AS hub, p_name AS keyword, l_orderkey AS member FROM lineitem JOIN part ON l_partkey = p_partkey",
    "old_event": "SELECT event_id, 'grade' AS role, props AS scores FROM events WHERE event_id % 2 = 0",
    "new_event": "SELECT event_id, CASE event_id % 7 WHEN 1 THEN 'author' WHEN 3 THEN 'revise' WHEN 4 THEN 'critic' WHEN 5 THEN 'claim_support' WHEN 6 THEN 'reconcile' ELSE event_type END AS role, CASE WHEN event_id % 3 = 0 THEN '{ }' ELSE props END AS scores FROM events WHERE event_id % 2 = 1",
    "db_page": "SELECT doc_id AS stem, 'paper' AS kind FROM documents WHERE doc_id % 5 <> 1",
    "db_claim": "SELECT doc_id AS stem, 1 AS position FROM documents WHERE doc_id % 5 <> 2",
    "disk_page": "SELECT doc_id AS stem, CASE WHEN doc_id % 4 = 0 THEN 'concept' ELSE 'paper' END AS kind FROM documents WHERE doc_id % 3 <> 0",
    "disk_claim": "SELECT doc_id AS stem, 1 AS position FROM documents WHERE doc_id % 3 <> 0",
    "stem_log": "SELECT CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS stem, event_type FROM events",
    "ledger": "SELECT c_custkey AS stem FROM customer WHERE c_custkey % 2 = 0",
    "missed": "SELECT item_id AS id, 'axis' || (item_id % 3) AS axis, CASE item_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'important' ELSE 'nice' END AS importance, CASE WHEN item_id % 2 = 0 THEN 'miss' ELSE 'match' END AS verdict FROM benchmark",
    "step": "SELECT conv_id, turn, role, length(text) AS chars FROM conversations",
    "number": "SELECT DISTINCT CASE p_size % 6 WHEN 0 THEN p_size || 'K' WHEN 1 THEN p_size || '.5 m' WHEN 2 THEN '1,' || (100 + p_size) WHEN 3 THEN p_size || 'G' WHEN 4 THEN 'x' || p_size ELSE '' || p_size END AS token FROM part",
    "dated": "SELECT item_id, 'On 2024-01-' || (10 + item_id % 20) || ' and 2023-11 (Smith, 2019b) [[en/lee-' || (2000 + item_id % 20) || '#kc-01|x]] 12 of 30 [^kim-2020] [3,4] ' || text || ' ' || item_id AS text FROM benchmark",
    "compared": "SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'It is 3.5 times faster than Alpha, and Beta is slow.' WHEN 1 THEN 'Alpha was slow; Beta is 3.5 times faster.' WHEN 2 THEN 'Nothing of the kind.' ELSE '3.5 times, they say.' END AS text FROM benchmark",
    "checked": "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'doi' ELSE '10.1234/' || doc_id END AS given, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '10.1234/other' ELSE '10.1234/' || doc_id END AS resolved, CAST(2000 + doc_id % 4 AS INT) AS year, 2001 AS resolved_year, CAST(doc_id % 10 AS DOUBLE) / 10 AS overlap FROM documents",
    "digest": "SELECT o_orderkey AS id, '10.1/' || (o_orderkey % 300) AS doi, 's' || (o_custkey % 200) AS stem FROM orders",
    "digest_doi": "SELECT DISTINCT '10.1/' || (c_custkey % 290) AS doi FROM customer WHERE c_custkey % 2 = 0",
    "digest_stem": "SELECT DISTINCT 's' || (c_custkey % 190) AS stem FROM customer WHERE c_custkey % 3 = 0",
    "fenced": "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'see ```json ' || chr(10) || '{\"a\": ' || turn || '} ``` end' WHEN 1 THEN 'x {\"b\": {\"c\": 1}} y' ELSE 'none' END AS text FROM conversations",
    "timed": "SELECT event_id, event_id * 977 AS seconds, CAST(event_id % 200 AS INT) AS corpus, CAST(event_id % 5 AS INT) AS code, CAST(CASE WHEN event_id % 6 = 0 THEN NULL ELSE 2010 + event_id % 15 END AS INT) AS year, CASE event_id % 4 WHEN 0 THEN ' Conflict' WHEN 1 THEN 'refines' WHEN 2 THEN 'DUPLICATE' ELSE 'so' END AS verdict FROM events",
    "paged": "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'paper' WHEN 2 THEN 'review' WHEN 3 THEN 'commentary' WHEN 4 THEN ' ' || chr(34) || 'paper' || chr(34) || ' ' WHEN 5 THEN '' ELSE 'note' END AS kind, CASE doc_id % 5 WHEN 0 THEN 'concept' ELSE lang END AS folder, doc_id % 17 = 0 AS is_root, CASE doc_id % 6 WHEN 0 THEN 'other' WHEN 1 THEN NULL WHEN 2 THEN 'xx' ELSE lang END AS category, CASE doc_id % 9 WHEN 0 THEN 'Journal of LaTeX Class Files, vol. 1' WHEN 1 THEN ' Manuscript submitted to X' WHEN 2 THEN 'To appear in ' || source WHEN 3 THEN 'bioRxiv preprint' WHEN 4 THEN 'UNPUBLISHED' WHEN 5 THEN 'in preparation' WHEN 6 THEN NULL WHEN 7 THEN '12 (3), 45' ELSE source END AS venue, CASE doc_id % 6 WHEN 0 THEN '10.1145/nnnnnnn.nnnnnnn' WHEN 1 THEN '10.1000/000.00' WHEN 2 THEN '10.1000/TODO' WHEN 3 THEN '10.1000/xxx1' WHEN 4 THEN NULL ELSE '10.1000/' || doc_id END AS doi FROM documents",
    "folder": "SELECT DISTINCT lang AS folder FROM documents UNION ALL SELECT 'concept'",
    "titled_doc": "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' A title ' WHEN 2 THEN ' ' ELSE substr(text, 1, CAST(n_chars % 500 AS INT)) END AS text, 'A title' AS title FROM documents",
    "changed": "SELECT o_orderkey AS key, o_orderdate AS mtime FROM orders",
    "glossed": "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN text ELSE substr(text, 1, 20) || ' -- a -- ' || substr(text, 21, 20) END AS text FROM benchmark",
}
_NAMES = re.compile(r"\b(" + "|".join(TABLES) + r")\b")


def rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = ROWS[name]
    for t in sorted(set(_NAMES.findall(sql))):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)


def query(name: str, names: str, sql: str):
    """Registers a function of the named rows as q_``name``, and its SQL, which may use them as tables."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f"q_{name}"] = lambda spark, sf_dir: f(*[rows(spark, sf_dir, n) for n in names.split()])
        ORACLES[f"q_{name}"] = "WITH " + ", ".join(f"{n} AS ({ROWS[n]})" for n in names.split()) + " " + sql
        return f

    return register


TOKENS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"

query("edges_of_node", "edge", "SELECT id, src, tgt, relation FROM edge WHERE (src = 'c5' OR tgt = 'c5') AND status = 'active'")(
    lambda e: edges.query(e, node="c5", status="active").select("id", "src", "tgt", "relation"))
query("edges_by_relation", "edge", "SELECT relation, count(*) AS n FROM edge GROUP BY 1")(edges.counts_by_relation)
query("edge_promotion", "edge", "SELECT relation, CASE WHEN status = 'candidate' AND relation = 'supports' THEN 'promoted' ELSE status END AS status, count(*) AS n FROM edge GROUP BY 1, 2")(
    lambda e: edges.transition(e, (F.col("status") == "candidate") & (F.col("relation") == "supports"), "promoted").groupBy("relation", "status").agg(F.count(F.lit(1)).alias("n")))
query("pages_of_both_ends", "next_edge ref", """SELECT id, page, kind FROM (SELECT e.id, a.page, a.kind, row_number() OVER (PARTITION BY e.id ORDER BY CASE a.kind WHEN 'synthesis' THEN 0 WHEN 'concept' THEN 1 ELSE 99 END, a.page) AS r
    FROM next_edge e JOIN ref a ON a.stem = e.src JOIN ref b ON b.stem = e.tgt AND b.page = a.page) WHERE r = 1""")(
    lambda e, r: edges.pages_of_both_ends(e, r, {"synthesis": 0, "concept": 1}))
query("hub_bridges", "next_edge member", """SELECT a.hub, e.relation, least(a.category, b.category) || ' / ' || greatest(a.category, b.category) AS pair, count(*) AS n
    FROM next_edge e JOIN member a ON a.stem = e.src JOIN member b ON b.stem = e.tgt AND b.hub = a.hub WHERE a.category <> b.category GROUP BY 1, 2, 3""")(edges.bridges)
query("concept_members", "by_keyword by_claim", """SELECT stem, slug, CASE rank WHEN 0 THEN 'claim' ELSE 'keyword' END AS "by" FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY rank, slug) AS r
    FROM (SELECT stem, slug, 0 AS rank FROM by_claim UNION ALL SELECT stem, slug, 1 FROM by_keyword)) WHERE r = 1""")(edges.members)
query("verified_links", "drafted known allowed", """SELECT state, count(*) AS n FROM (SELECT CASE WHEN link NOT IN (SELECT key FROM known) THEN 'broken' WHEN NOT EXISTS (SELECT 1 FROM allowed a WHERE a.src = d.src AND a.link = d.link) THEN 'unverified' ELSE 'ok' END AS state FROM drafted d) GROUP BY 1""")(
    lambda d, k, a: edges.verified_links(d, k, a).groupBy("state").agg(F.count(F.lit(1)).alias("n")))
query("listed_and_present", "listed present", "SELECT *, 'missing' AS issue FROM (SELECT * FROM listed EXCEPT SELECT * FROM present) UNION ALL SELECT *, 'unlisted' FROM (SELECT * FROM present EXCEPT SELECT * FROM listed)")(
    lambda a, b: edges.two_way_missing(a, b, ["stem", "file"]))
query("back_links", "link back", """SELECT tgt AS src, src AS tgt, CASE note WHEN 'cites it' THEN 'cited by it' WHEN 'cited by it' THEN 'cites it' ELSE 'topical' END AS note FROM link l WHERE NOT EXISTS (SELECT 1 FROM back b WHERE b.src = l.tgt AND b.tgt = l.src)""")(edges.back_links)
query("persist_scores", "page score", "SELECT p.doc_id, p.lang, CASE WHEN s.doc_id IS NULL THEN p.score ELSE s.score END AS score FROM page p LEFT JOIN score s USING (doc_id)")(
    lambda p, s: edges.persist_scores(p, s, ["doc_id"], ["score"]))
query("backfill_stems", "log", "SELECT event_id, user_id, coalesce(stem, min(stem) OVER (PARTITION BY user_id)) AS stem FROM log")(lambda e: edges.backfill(e, "user_id", "stem").select("event_id", "user_id", "stem"))
query("triage", "candidate verdict", "SELECT slug, coalesce(verdict, 'uncertain') AS verdict FROM candidate LEFT JOIN verdict USING (slug)")(edges.triage)
query("verdict_tally", "told", "SELECT lang, count(*) FILTER (verdict = 'hard') AS hard, count(*) FILTER (verdict = 'weak') AS weak, count(*) FILTER (verdict = 'supported') AS supported, count(*) AS total, count(*) FILTER (verdict = 'hard') = 0 AS ok FROM told GROUP BY 1")(
    lambda t: edges.tally(t, ["lang"], ["hard", "weak", "supported"]))
query("citation_edges", "cited citing", "SELECT src, tgt FROM cited UNION SELECT tgt, src FROM citing")(edges.citation_edges)
query("recommendations", "recommended", """SELECT doi, count(DISTINCT src) AS times, count(DISTINCT category) AS breadth, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories, round(count(DISTINCT src) / 100.0, 6) AS share FROM recommended GROUP BY 1 HAVING times >= 2""")(
    lambda r: edges.recommendations(r, 100).withColumn("categories", F.array_join("categories", ",")))
_PAGE_RULES = r"""SELECT 'type-folder' AS rule, key, type || '/' || folder AS detail FROM ruled WHERE type <> folder
    UNION ALL SELECT 'missing-doi', key, coalesce(doi, '') FROM ruled WHERE lower(trim(coalesce(doi, ''))) IN ('', 'todo', 'none') AND no_doi_reason IS NULL
    UNION ALL SELECT 'stem-year', key, regexp_extract(stem, '-((?:19|20)\d\d)[a-z]?(?:-|$)', 1) FROM ruled WHERE regexp_extract(stem, '-((?:19|20)\d\d)[a-z]?(?:-|$)', 1)::INT <> year
    UNION ALL SELECT 'few-keywords', key, len(keywords)::VARCHAR FROM ruled WHERE len(keywords) < 5
    UNION ALL SELECT 'missing-hook', key, '' FROM ruled WHERE trim(coalesce(hook, '')) = ''
    UNION ALL SELECT 'long-hook', key, length(hook)::VARCHAR FROM ruled WHERE length(hook) > CASE type WHEN 'review' THEN 300 ELSE 200 END
    UNION ALL SELECT 'none-beside-bullets', key, '' FROM ruled WHERE key % 6 = 0"""
query("page_rules", "ruled", _PAGE_RULES)(lambda r: lint.report(lint.page_rules(r), "key"))
query("suggested_category", "voted", """SELECT doc_id, CASE WHEN model IS NOT NULL AND confidence >= 0.60 AND valid THEN model WHEN model IS NULL THEN coalesce(near, 'other') ELSE 'other' END AS category,
    coalesce(CASE WHEN model IS NOT NULL AND confidence >= 0.60 AND valid THEN model = near AND confidence >= 0.75 WHEN model IS NULL THEN strong ELSE false END, false) AS strong FROM voted""")(
    lambda v: v.select("doc_id", *[c.alias(n) for c, n in zip(curation.suggested_category(F.when(F.col("model").isNotNull(), F.col("model")), F.col("confidence"), F.col("valid") & F.col("model").isNotNull(), F.col("near"), F.col("strong")), ("category", "strong"), strict=True)]))
query("clean_rows", "tiered", f"""SELECT lang, position, tier, text, place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY CASE tier WHEN 'key' THEN 0 WHEN 'side' THEN 1 ELSE 2 END, position) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, array_to_string({TOKENS.format('text')}, ' ') ORDER BY position) AS n FROM tiered WHERE tier <> 'unknown') WHERE n = 1) WHERE place <= 40""")(
    lambda t: curation.clean_rows(t, "lang", ["key", "side", "other"], 40))
query("doi_crosslinks", "doi_page doi_ref", """SELECT DISTINCT src, lower(trim(r.doi)) AS doi, key FROM doi_ref r JOIN (SELECT lower(trim(doi)) AS doi, max(key) AS key FROM doi_page WHERE trim(doi) <> '' GROUP BY 1) i ON lower(trim(r.doi)) = i.doi WHERE src <> key""")(
    lambda p, r: records.crosslinks(r, records.doi_index(p, "doi", "key")))
_HEAD = "lower(substr(coalesce(text, ''), 1, {}))"
query("record_kinds", "titled", f"""SELECT kind, status, count(*) AS n FROM (SELECT CASE WHEN contains(lower(title), 'protocol') THEN 'protocol' WHEN regexp_matches(lower(title), 'review|survey|meta-analysis|perspective') OR regexp_matches(lower(venue), 'reviews|annual review|trends in') THEN 'review'
      WHEN regexp_matches({_HEAD.format(3000)}, 'randomi[sz]ed|phase [1-4i]+ trial|clinical trial') THEN 'trial' WHEN regexp_matches(lower(title), 'dataset|data set|corpus|benchmark|atlas') THEN 'dataset' WHEN regexp_matches(lower(title), 'method|tool|software|framework|pipeline|algorithm') THEN 'method' ELSE 'research' END AS kind,
    CASE WHEN regexp_matches({_HEAD.format(6000)}, 'retracted article|this article has been retracted') THEN 'retracted' WHEN coalesce(starts_with(lower(trim(doi)), '10.1/7'), false) OR regexp_matches({_HEAD.format(6000)}, 'not (?:been )?(?:certified by )?peer.review|this is a preprint') THEN 'preprint'
      WHEN regexp_matches({_HEAD.format(6000)}, 'accepted manuscript|in press|uncorrected proof') THEN 'accepted' WHEN doi IS NOT NULL THEN 'published' ELSE 'unknown' END AS status FROM titled) GROUP BY 1, 2""")(
    lambda t: t.select(records.paper_kind(F.col("title"), F.col("venue"), F.col("text")).alias("kind"), records.publication_status(F.col("doi"), F.col("text"), ["10.1/7"]).alias("status")).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n")))
query("quality_blend", "draft", """SELECT doc_id, round(CASE WHEN fidelity IS NULL THEN salience WHEN salience IS NULL THEN fidelity ELSE (0.5 * fidelity + 0.5 * least(anchors / 10, 1) * salience) / (0.5 + 0.5 * least(anchors / 10, 1)) END, 6) AS quality,
    coalesce(salience >= fidelity + 0.01::DOUBLE AND drift = 0, false) AS better FROM draft""")(
    lambda d: d.select("doc_id", F.round(grading.combined_quality(F.col("fidelity"), F.col("salience"), F.col("anchors")), 6).alias("quality"), grading.improves(F.col("salience"), F.col("fidelity"), F.lit(0.5), F.lit(0.5), F.col("drift")).alias("better")))
query("weak_claims", "claim", """SELECT id FROM claim WHERE unmatched > 0 OR negated OR coalesce(semantic, 1) < 0.40 OR (coalesce(bm25, 0) < 8 AND coalesce(semantic, 0) < 0.55)""")(
    lambda c: c.where(lookup.weak_claim(F.col("unmatched"), F.col("negated"), F.col("semantic"), F.col("bm25"))).select("id"))
query("merged_terms", "ranked_term", """SELECT key, term, source_rank, p AS pages, c AS categories FROM (SELECT *, max(pages) OVER (PARTITION BY key) AS p, max(categories) OVER (PARTITION BY key) AS c,
    row_number() OVER (PARTITION BY key ORDER BY source_rank, pages DESC, length(term) DESC, term) AS r FROM ranked_term) WHERE r = 1""")(concepts.merge_sources)
query("cache_refresh", "hashed cached", "SELECT lang, count(c.doc_id) AS reused, count(*) - count(c.doc_id) AS anew FROM hashed h LEFT JOIN cached c ON c.doc_id = h.doc_id AND c.h = h.h GROUP BY 1")(
    lambda h, c: (lambda parts: parts[0].select("lang", F.lit(1).alias("r")).unionAll(parts[1].select("lang", F.lit(0).alias("r"))))(snapshots.cache_refresh(h, c, ["doc_id"], "h")).groupBy("lang").agg(F.sum("r").alias("reused"), F.sum(1 - F.col("r")).alias("anew")))
query("unreferenced", "hit linked", "SELECT page, count(*) AS n FROM (SELECT * FROM hit EXCEPT SELECT * FROM linked) GROUP BY 1")(
    lambda h, k: ranking.unreferenced(h, k, ["page"][0], "key").groupBy("page").agg(F.count(F.lit(1)).alias("n")))
query("candidate_union", "by_keyword by_claim known", """SELECT key, min(rank) AS source_rank FROM (SELECT stem AS key, 0 AS rank FROM by_claim UNION ALL SELECT stem, 1 FROM by_keyword UNION ALL SELECT key, 2 FROM known) GROUP BY 1 ORDER BY 2, 1 LIMIT 60""")(
    lambda k, c, o: joins.prioritised_union([c.select(F.col("stem").alias("key")), k.select(F.col("stem").alias("key")), o], "key", 60))
query("json_answers", "fenced", r"""SELECT conv_id, turn, nullif(CASE WHEN regexp_extract(text, '(?s)```(?:json)?\s*(\{.*?\})\s*```', 1) <> '' THEN regexp_extract(text, '(?s)```(?:json)?\s*(\{.*?\})\s*```', 1) ELSE regexp_extract(text, '(?s)(\{.*\})', 1) END, '') AS found FROM fenced""")(
    lambda t: t.select("conv_id", "turn", values.json_in(F.col("text")).alias("found")))
query("scalar_rules", "timed", """SELECT event_id, CASE WHEN seconds < 60 THEN 'just now' WHEN seconds < 3600 THEN seconds // 60 || 'm ago' WHEN seconds < 86400 THEN seconds // 3600 || 'h ago' WHEN seconds < 2592000 THEN seconds // 86400 || 'd ago' ELSE seconds // 2592000 || 'mo ago' END AS ago,
    CASE WHEN corpus < 20 THEN 3 WHEN corpus < 60 THEN 5 WHEN corpus < 150 THEN 7 ELSE 10 END AS cap, code NOT IN (1, 3) AS retry, coalesce(year BETWEEN 2012 AND 2018, false) AS in_span, CASE lower(trim(verdict)) WHEN 'conflict' THEN 'contradicts' WHEN 'refines' THEN 'extends' WHEN 'duplicate' THEN 'same_as' END AS relation, (seconds / 86400)::INT AS age FROM (SELECT *, seconds - seconds % 86400 AS x FROM timed)""".replace("(seconds / 86400)::INT AS age", "seconds // 86400 AS age"))(
    lambda t: t.select("event_id", values.relative_time(F.col("seconds")).alias("ago"), values.adaptive_cap(F.col("corpus")).alias("cap"), curation.should_retry(F.col("code")).alias("retry"), curation.in_span(F.col("year"), "2012-2018").alias("in_span"), curation.relation_of(F.col("verdict")).alias("relation"), values.age_days(F.col("seconds"), F.lit(0)).alias("age")))
query("thin_texts", "titled_doc", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN trim(text) = 'A title' THEN 'title-only' WHEN length(trim(text)) < 200 THEN 'short' END AS reason FROM titled_doc) GROUP BY 1")(
    lambda t: t.select(curation.thin_reason(F.col("text"), F.col("title")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")))
query("sanitized_queries", "dated", r"""SELECT item_id, substr(trim(regexp_replace(translate(text, '+-&|!(){}[]^"~*?:\/<>''', repeat(' ', 23)), ' +', ' ', 'g')), 1, 2000) AS q FROM dated""")(
    lambda t: t.select("item_id", T.sanitize_query(F.col("text")).alias("q")))
query("claim_refs", "anchor", "SELECT stem, slug, CASE WHEN slug IS NULL THEN '[[' || stem || ']]' ELSE '[[' || stem || '#' || slug || ']]' END AS ref FROM anchor")(
    lambda a: a.select("stem", "slug", values.claim_ref(F.col("stem"), F.col("slug")).alias("ref")))
# ---- claims, anchors and the event log
query("paper_like", "paged", "SELECT doc_id FROM paged WHERE trim(trim(coalesce(nullif(kind, ''), 'paper')), chr(34)) IN ('paper', 'commentary') AND folder NOT IN ('concept', 'synthesis', 'digest') AND NOT is_root")(
    lambda p: p.where(claims.paper_like(F.col("kind"), F.col("folder"), F.col("is_root"))).select("doc_id"))
query("invalid_categories", "paged folder", "SELECT doc_id, category FROM paged WHERE folder <> 'concept' AND coalesce(category, '') <> 'other' AND NOT EXISTS (SELECT 1 FROM folder f WHERE f.folder = category AND f.folder <> 'concept')")(
    lambda p, f: claims.invalid_categories(p, f).select("doc_id", "category"))
query("venue_suspects", "paged", "SELECT doc_id, venue FROM paged WHERE regexp_matches(lower(venue), 'latex class files|submitted to|to appear in|preprint|unpublished|in preparation')")(
    lambda p: p.where(claims.venue_suspect(F.col("venue"))).select("doc_id", "venue"))
query("placeholder_dois", "paged", r"SELECT doc_id, doi FROM paged WHERE regexp_matches(lower(doi), '^10\.[0-9]{4,9}/([nx]{4,}([._-][nx]{4,})*|0+([._-]0+)*|doi|todo|tbd|xxx|placeholder)$')")(
    lambda p: p.where(claims.placeholder_doi(F.col("doi"))).select("doc_id", "doi"))
query("claim_anchors", "anchor claim", "SELECT stem, slug, md5(text) AS hash FROM anchor LEFT JOIN claim USING (stem, slug)")(
    lambda a, c: claims.resolve_anchors(a, c).select("stem", "slug", F.md5(F.col("claim").cast("binary")).alias("hash")))
query("dangling_anchors", "anchor claim", "SELECT stem, count(*) AS dangling FROM anchor ANTI JOIN claim USING (stem, slug) GROUP BY 1")(
    lambda a, c: claims.resolve_anchors(a, c).where("claim is null").groupBy("stem").agg(F.count(F.lit(1)).alias("dangling")))
query("missed_anchors", "missed", "SELECT id, axis, importance, verdict FROM missed WHERE verdict = 'miss' ORDER BY CASE importance WHEN 'critical' THEN 0 WHEN 'important' THEN 1 ELSE 2 END, axis, id LIMIT 5")(
    lambda m: claims.missed_anchors(m, ["critical", "important", "nice"]))
query("recent_pages", "changed", "SELECT key, mtime FROM changed ORDER BY mtime DESC, key LIMIT 10")(lambda c: claims.recent(c, "mtime", "key", 10))
query("pending_inputs", "input run", "SELECT stem FROM input WHERE stem NOT IN (SELECT stem FROM run WHERE exit IN (0, 1, 3))")(lambda i, r: claims.pending(i, r, "stem"))
query("common_keywords", "keyword", "SELECT *, row_number() OVER (PARTITION BY hub ORDER BY members DESC, keyword) AS place FROM (SELECT hub, keyword, count(DISTINCT member) AS members FROM keyword GROUP BY 1, 2 HAVING members >= 2)")(lambda k: claims.common_keywords(k, "hub"))
query("set_means", "draft", "SELECT drift, round(avg(fidelity), 6) AS mean_fidelity, round(avg(salience), 6) AS mean_salience, count(*) AS n FROM draft GROUP BY 1")(lambda d: claims.means(d, ["drift"], ["fidelity", "salience"]))
query("event_append", "old_event new_event", """SELECT role, count(*) AS n, count(scores) AS scored FROM (SELECT * FROM old_event UNION ALL SELECT event_id, role, CASE WHEN regexp_replace(scores, '\\s', '', 'g') <> '{}' THEN scores END FROM new_event WHERE role IN ('reconcile', 'extract', 'target_claims', 'crosslinks', 'author', 'grade', 'grade_persist', 'tournament', 'critic', 'debug', 'short_name', 'keywords', 'commit', 'memory_evolve', 'pdf_upgrade', 'claim_support')) GROUP BY 1
    UNION ALL SELECT 'refused', count(*), 0 FROM new_event WHERE role NOT IN ('reconcile', 'extract', 'target_claims', 'crosslinks', 'author', 'grade', 'grade_persist', 'tournament', 'critic', 'debug', 'short_name', 'keywords', 'commit', 'memory_evolve', 'pdf_upgrade', 'claim_support')""".replace("\\\\", "\\"))(
    lambda o, n: (lambda told: told[0].groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count("scores").alias("scored")).unionAll(told[1].agg(F.lit("refused"), F.count(F.lit(1)), F.lit(0))))(claims.append_events(o, n)))
query("rebuild", "db_page db_claim disk_page disk_claim", """SELECT 'page' AS what, count(*) AS n FROM disk_page UNION ALL SELECT 'claim', count(*) FROM disk_claim WHERE stem IN (SELECT stem FROM disk_page WHERE kind = 'paper')
    UNION ALL SELECT 'deleted', count(*) FROM (SELECT stem FROM db_page UNION SELECT stem FROM db_claim) WHERE stem NOT IN (SELECT stem FROM disk_page)""")(
    lambda p, c, fp, fc: (lambda told: told[0].agg(F.lit("page").alias("what"), F.count(F.lit(1)).alias("n")).unionAll(told[1].agg(F.lit("claim"), F.count(F.lit(1)))).unionAll(told[2].agg(F.lit("deleted"), F.count(F.lit(1)))))(claims.rebuild(p, c, fp, fc)))
query("mark_covered", "input stem_log ledger", "SELECT stem, count(*) AS events FROM stem_log WHERE stem IN (SELECT stem FROM input) AND stem NOT IN (SELECT stem FROM ledger) GROUP BY 1")(claims.mark_covered)
query("count_graded", "claim anchor", "SELECT stem, count(semantic) AS graded FROM (SELECT DISTINCT stem FROM anchor) LEFT JOIN claim USING (stem) GROUP BY 1")(claims.count_graded)
query("first_containing", "claim", "SELECT stem, slug FROM claim WHERE contains(lower(text), 'the') ORDER BY stem, slug LIMIT 1")(lambda c: claims.first_containing(c, "The").select("stem", "slug"))
query("top_graded", "claim", "SELECT stem, id, place FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY semantic DESC NULLS LAST, bm25 DESC NULLS LAST, position) AS place FROM claim) WHERE place <= 3")(lambda c: claims.top_graded(c, 3).select("stem", "id", "place"))
query("members_by_category", "member", "SELECT hub, category, count(*) AS n, string_agg(DISTINCT stem::VARCHAR, ',' ORDER BY stem::VARCHAR) AS stems FROM member GROUP BY 1, 2")(lambda m: claims.members_by_category(m.withColumn("stem", F.col("stem").cast("string"))))
query("attempt_trace", "step", "SELECT conv_id, turn, role, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM step")(lambda s: claims.attempt_trace(s, "conv_id", ["turn"]))
query("draft_grade", "told", "SELECT lang, n, round(s / n, 6) AS mean FROM (SELECT lang, count(*) AS n, sum(CASE verdict WHEN 'supported' THEN 1 ELSE 0 END) AS s FROM told GROUP BY 1)")(
    lambda t: claims.draft_grade(t.withColumn("score", F.when(F.col("verdict") == "supported", 1.0).otherwise(0.0)).withColumn("id", F.lit(1)), ["lang"]).select("lang", "n", "mean"))
query("count_maps", "step", "SELECT conv_id, string_agg(role || '=' || n, ',' ORDER BY role || '=' || n) AS counts FROM (SELECT conv_id, role, count(*) AS n FROM step GROUP BY 1, 2) GROUP BY 1")(lambda s: claims.count_map(s, ["conv_id"], "role"))
query("expanded_numbers", "number", r"""SELECT token, round(TRY_CAST(nullif(regexp_extract(t, '^([0-9]+(?:\.[0-9]+)?)[ ]?([KkMmBbGg]?)$', 1), '') AS DOUBLE) * CASE upper(regexp_extract(t, '^([0-9]+(?:\.[0-9]+)?)[ ]?([KkMmBbGg]?)$', 2)) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 WHEN 'G' THEN 1e9 ELSE 1.0 END, 6) AS value FROM (SELECT token, replace(trim(token), ',', '') AS t FROM number)""")(
    lambda n: n.select("token", claims.expanded_number(F.col("token")).alias("value")))
query("numbers_without_dates", "dated", r"""SELECT item_id, regexp_replace(regexp_replace(regexp_replace(text, '\[\[[^\]]+\]\]', ' ', 'g'), '\[\^[^\]\s]+\]', ' ', 'g'), '\b[0-9]{4}-[0-9]{2}(-[0-9]{2})?\b', ' ', 'g') AS text FROM dated""")(
    lambda t: t.select("item_id", quantities.without_citations(F.col("text")).alias("text")))
query("comparators", "compared", "SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'match' WHEN 1 THEN 'partial' WHEN 2 THEN 'miss' ELSE 'partial' END AS verdict FROM compared")(
    lambda t: t.select("item_id", claims.comparator_check(F.col("text"), F.lit("3.5 times"), F.lit("Alpha"), F.array(F.lit("Alpha"), F.lit("Beta"))).alias("verdict")))
query("glosses", "glossed", "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN text ELSE substr(text, 1, 25) END AS claim, CASE WHEN item_id % 3 <> 0 THEN nullif(substr(text, 30), '') END AS gloss FROM glossed")(
    lambda t: t.select("item_id", *[c.alias(n) for c, n in zip(claims.split_gloss(F.col("text")), ("claim", "gloss"), strict=True)]))
query("doi_verdicts", "checked", """SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN given = 'doi' THEN 'malformed' WHEN resolved IS NULL THEN 'unresolved' WHEN given <> resolved THEN 'conflict' WHEN overlap < 0.5 THEN 'mismatch' WHEN abs(year - resolved_year) > 1 THEN 'year-drift' ELSE 'ok' END AS verdict FROM checked) GROUP BY 1""")(
    lambda c: c.select(claims.doi_verdict(F.col("given"), F.col("resolved"), F.col("year"), F.col("resolved_year"), F.col("overlap")).alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n")))
query("work_list", "ruled", """SELECT key, array_to_string(list_filter([CASE WHEN len(keywords) < 5 THEN 'keywords' END, CASE WHEN trim(hook) = '' THEN 'hook' END, CASE WHEN coalesce(doi, 'todo') = 'todo' THEN 'doi' END], lambda x: x IS NOT NULL), ',') AS lacks FROM ruled WHERE len(keywords) < 5 OR trim(hook) = '' OR coalesce(doi, 'todo') = 'todo'""")(
    lambda r: claims.work_list(r, {"keywords": F.size("keywords") < 5, "hook": F.trim("hook") == "", "doi": lookup.is_missing(F.col("doi"))}))
query("listed_anchors", "checked digest", "SELECT doc_id AS page, d.doi, id AS anchor FROM (SELECT doc_id, '10.1234/' || (doc_id % 200) AS doi FROM checked) d JOIN (SELECT id, '10.1234/' || (id % 1000) AS doi FROM digest) a ON a.doi = d.doi")(
    lambda c, d: claims.listed_anchors(c.select(F.col("doc_id").alias("page"), F.concat(F.lit("P2: 10.1234/"), (F.col("doc_id") % 200).cast("string"), F.lit(". And so on")).alias("text")), d.select(F.col("id").alias("anchor"), F.concat(F.lit("10.1234/"), (F.col("id") % 1000).cast("string")).alias("doi"))))
query("new_digests", "digest digest_doi digest_stem", "SELECT seen_by, count(*) AS n FROM (SELECT CASE WHEN doi IN (SELECT doi FROM digest_doi) THEN 'doi' WHEN stem IN (SELECT stem FROM digest_stem) THEN 'stem' END AS seen_by FROM digest) GROUP BY 1")(
    lambda d, a, b: claims.new_digests(d, [("doi", "doi", a), ("stem", "stem", b)]).groupBy("seen_by").agg(F.count(F.lit(1)).alias("n")))


def _bm25_sql(docs: str, terms: str) -> str:
    """scored(qid, key, score) over x(key, field, boost, ts) and q(qid, term)."""
    return f"""x AS ({docs}), q AS ({terms}), n AS (SELECT field, count(*) AS n, avg(len(ts)) AS av FROM x GROUP BY 1),
        p AS (SELECT key, field, boost, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT key, field, boost, len(ts) AS dl, unnest(ts) AS term FROM x) GROUP BY 1, 2, 3, 4),
        d AS (SELECT field, term, count(*) AS df FROM p GROUP BY 1, 2),
        scored AS (SELECT qid, key, round(sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS score FROM p JOIN d USING (field, term) JOIN n USING (field) JOIN q USING (term) GROUP BY 1, 2)"""


def bm25_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source, language and whole text as a query on all fields."""
    d, boosts = table(spark, sf_dir, "documents"), {"text": 1.0, "source": 2.0, "lang": 0.5}
    seeds = d.where("doc_id % 50 = 0").select("doc_id", F.concat_ws(" ", "source", "lang", "text").alias("q"))
    return fulltext.bm25_fields(d, fulltext.query_terms(seeds, "doc_id", "q"), "doc_id", {f: F.col(f) for f in boosts}, boosts, 10)


def claim_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text"))
    return claims.claim_lookup(rows(spark, sf_dir, "claim"), asked, 5)


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near pairs of different groups, judged by a verdict table, as edges in the order of their ends."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("long").alias("grp"))
    pairs = vectors.similar_pairs(v, 0.30).select("a", "b", "cos")
    judged = pairs.withColumn("verdict", F.when((F.col("a") + F.col("b")) % 3 == 0, "conflict").otherwise("agreement"))
    new = judged.where(curation.relation_of(F.col("verdict")) == "contradicts").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("tgt"), F.lit("candidate").alias("status"), F.col("cos").alias("confidence"))
    old = new.where("(src + tgt) % 2 = 0").withColumn("status", F.lit("rejected"))
    return snapshots.edge_upsert(old, new, ["src", "tgt"]).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


QUERIES |= {f"q_{f.__name__}": f for f in (bm25_fields, claim_lookup, contradictions)}
_DOC_FIELDS = " UNION ALL ".join(f"SELECT doc_id AS key, '{f}' AS field, {b}::DOUBLE AS boost, {TOKENS.format(f)} AS ts FROM documents" for f, b in (("text", 1.0), ("source", 2.0), ("lang", 0.5)))
_SEEDS = f"SELECT doc_id AS qid, unnest(list_distinct({TOKENS.format(chr(39) + chr(39) + ' || source || chr(32) || lang || chr(32) || coalesce(text, chr(32))')})) AS term FROM documents WHERE doc_id % 50 = 0"
ORACLES |= {
    "q_bm25_fields": f"WITH {_bm25_sql(_DOC_FIELDS, _SEEDS)} SELECT qid, doc_id, score, rank FROM (SELECT qid, key AS doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM scored) WHERE rank <= 10",
    "q_claim_lookup": f"""WITH claim AS ({ROWS['claim']}), {_bm25_sql("SELECT id AS key, 'text' AS field, 1::DOUBLE AS boost, " + TOKENS.format('text') + " AS ts FROM claim", "SELECT item_id AS qid, unnest(list_distinct(" + TOKENS.format('text') + ")) AS term FROM benchmark")}
        SELECT qid, id, score, rank FROM (SELECT qid, key AS id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, coalesce(semantic, 0) DESC, coalesce(bm25, 0) DESC, key) AS rank FROM scored JOIN claim ON id = key WHERE NOT is_cross_ref) WHERE rank <= 5""",
    "q_contradictions": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label AS grp FROM embeddings), p AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id < b.id AND a.grp <> b.grp WHERE round(list_inner_product(a.e, b.e), 6) >= 0.30 AND (a.id + b.id) % 3 = 0)
        SELECT CASE WHEN (a + b) % 2 = 0 THEN 'skipped' ELSE 'inserted' END AS action, count(*) AS n FROM p GROUP BY 1""",
}
