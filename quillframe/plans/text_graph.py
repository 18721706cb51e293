"""Queries on texts, terms and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.functions import values
from quillframe.operators import aggregates, concepts, fulltext, grading, graph, joins, ranking, vectors
from quillframe.plans.retrieval import _BM25, _CHUNKED, _NEAR, _V, _COS, THRESHOLD, TOKEN_SQL, _neighbours, _vectors
from quillframe.scratch import materialise
from quillframe.sources.tables import table


def _lines(text: str, least: int) -> Column:
    return F.explode(F.array_distinct(F.filter(F.split(text, "\n"), lambda x: F.length(x) >= least)))


def claims_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "claim"))
    return d.where(F.length("claim") >= 10).select("doc_id", F.col("position").cast("long").alias("position"), "claim", F.col("claim").contains("|").alias("is_table"))


def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ranking.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return c.select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.md5("chunk").alias("hash"), F.col("n_words").cast("long").alias("n_words"))


def term_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("page"), F.col("source").alias("category"), F.posexplode(F.split("text", "\n")).alias("section", "line"))
    found = concepts.text_candidates(rows, F.concat(T.acronyms(F.col("line")), T.title_terms(F.col("line"))), F.when(F.col("section") == 0, 2.0).otherwise(1.0))
    return found.withColumn("tier", concepts.tier(F.col("term"), F.col("pages"), F.col("categories"), d.count()))


def keyword_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    words = p.select(F.col("p_partkey").alias("page"), F.col("p_type").alias("category"), F.explode(F.array(F.col("p_name"), F.concat("p_name", F.lit("s")))).alias("term")).where("page % 3 = 0 or not term like '%ss'")
    return concepts.keyword_candidates(words)


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", F.array_distinct(T.tokens(F.col("p_name"))).alias("ts"))
    posts = names.select("p_name", "ts", F.explode("ts").alias("t"))
    pairs = posts.select(F.col("p_name").alias("a"), F.col("ts").alias("x"), "t").join(posts.select(F.col("p_name").alias("b"), F.col("ts").alias("y"), "t"), "t").where("a < b").dropDuplicates(["a", "b"])
    return pairs.select("a", "b", F.round(T.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"), F.round(T.overlap_coefficient(F.col("x"), F.col("y")), 6).alias("overlap")).where("jaccard >= 0.2")


def numeric_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.numeric_tokens(F.col("text"))).alias("number"))
    return d.groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


def numeric_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    said = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("claim"))
    j = said.join(c.select("conv_id", "turn", F.col("text").alias("evidence")), ["conv_id", "turn"])
    missing = grading.unmatched_numbers(F.col("claim"), F.col("evidence"))
    return j.select("conv_id", "turn", F.size(F.array_distinct(T.numeric_tokens(F.col("claim")))).cast("long").alias("numbers"), F.size(missing).cast("long").alias("unmatched"))


def negation_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    said = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("claim"))
    j = said.join(c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("evidence")), ["conv_id", "turn"])
    return j.select("conv_id", "turn", grading.negation_mismatch(F.col("claim"), F.col("evidence")).alias("mismatch"))


def _item_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id): documents that share a line of at least 40 characters with a benchmark item."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return b.select("item_id", _lines("text", 40).alias("line")).join(d.select("doc_id", _lines("text", 40).alias("line")), "line").select("item_id", "doc_id").distinct()


def extractiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b, j = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), _item_docs(spark, sf_dir)
    pages = j.join(d, "doc_id").select(F.concat_ws("/", "item_id", "doc_id").alias("page"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    sources = j.join(b, "item_id").select(F.concat_ws("/", "item_id", "doc_id").alias("page"), "text")
    return grading.extractiveness(pages, sources).groupBy("sentences", "copied", "ratio").agg(F.count(F.lit(1)).alias("pairs"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b, j = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("evidence")), table(spark, sf_dir, "benchmark"), _item_docs(spark, sf_dir)
    rows = j.join(b, "item_id").join(d, "doc_id")
    sig = grading.significant(F.col("text"))
    overlap = F.size(F.array_intersect(sig, T.tokens(F.col("evidence")))) / F.greatest(F.size(sig), F.lit(1))
    missing = F.size(grading.unmatched_numbers(F.col("text"), F.col("evidence")))
    return rows.select("item_id", "doc_id", "lang", F.round(overlap, 6).alias("overlap"), grading.overlap_verdict(F.round(overlap, 6), F.lit(None).cast("double"), missing).alias("verdict"))


def overlap_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir)


def weighted_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("verdict") == "match", 1.0).when(F.col("verdict") == "partial", 0.5).otherwise(0.0)
    weight = F.when(F.col("item_id") % 3 == 0, 3.0).when(F.col("item_id") % 3 == 1, 2.0).otherwise(1.0)
    r = aggregates.weighted_recall(_verdicts(spark, sf_dir), "lang", score, weight)
    return r.select(F.coalesce("lang", F.lit("(all)")).alias("axis"), "n", F.round("recall", 6).alias("recall"))


def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_name", "p_brand").distinct()
    s = T.slugify(F.concat_ws(" ", "p_brand", "p_name"))
    return p.select("p_name", "p_brand", s.alias("slug"), T.canonical_key(s).alias("canonical"))


def top_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand in several sources: breadth and top quintile of the 40 most frequent."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", _lines("text", 20).alias("line"))
    g = d.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("breadth")).where("n >= 2")
    top = ranking.ranked(g, [], [F.desc("n"), F.desc("breadth"), F.col("line")], "rank", 40)
    cutoff = top.where("rank = 8").select("n").first()
    return top.select(F.md5("line").alias("hash"), "n", "breadth", "rank", (F.col("n") >= (cutoff[0] if cutoff else 0)).alias("quintile"))


def mode_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = aggregates.mode_first_seen(table(spark, sf_dir, "documents"), ["lang"], "source", "doc_id")
    return m.select("lang", "source", "votes", "first_seen")


def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    terms = spark.createDataFrame([("of the",), ("the",), ("in the",), ("and the",), ("de la",)], "term string")
    return concepts.mentions(d, "doc_id", "text", terms).groupBy("term").agg(F.count(F.lit(1)).alias("docs"))


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Page words as link targets: each page's menu names, and pages known by the last part of their path."""
    p = table(spark, sf_dir, "pages")
    href = F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))
    links = p.select(F.col("page_id").alias("src"), F.explode(F.array_distinct(href)).alias("link"))
    words = F.regexp_extract("html", "<h1>([^ <]*)", 1)
    known = p.select(F.col("page_id").alias("key"), words.alias("stem")).where("stem <> ''").groupBy("stem").agg(F.min("key").alias("key"))
    return links, known


def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, known = _links(spark, sf_dir)
    edges = links.join(known.select(F.col("stem").alias("link"), F.col("key").alias("tgt")), "link")
    return edges.select("src", "tgt").distinct()


def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, known = _links(spark, sf_dir)
    return links.join(known.select(F.col("stem").alias("link")), "link", "left_anti").groupBy("src").agg(F.count(F.lit(1)).alias("broken"))


def _digraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir, 3).select(F.col("qid").alias("src"), F.col("id").alias("tgt"), "cos")


def missing_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.missing_backlinks(_digraph(spark, sf_dir))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = vectors.similar_pairs(_vectors(spark, sf_dir), THRESHOLD)
    return graph.orphans(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), pairs.select(F.col("a").alias("src"), F.col("b").alias("tgt")))


def degree_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, v = _digraph(spark, sf_dir), _vectors(spark, sf_dir)
    flow = g.join(v.select(F.col("id").alias("src"), F.col("grp").alias("src_label")), "src").join(v.select(F.col("id").alias("tgt"), F.col("grp").alias("tgt_label")), "tgt")
    return flow.groupBy("src_label", "tgt_label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tgt").alias("targets"))


def top_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = graph.degrees(_digraph(spark, sf_dir))
    return d.orderBy(F.desc("in_degree"), "id").limit(5)


def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.density(_digraph(spark, sf_dir), table(spark, sf_dir, "embeddings").count())


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, semantic, link, keyword, total).  Near pairs, which grow with the square of the vectors, learn of their labels and links where they are
    compared and are never shuffled; linked pairs that aren't near come from the links, few for each vector."""
    v = _vectors(spark, sf_dir)
    index = vectors.Index(v)
    links = materialise(vectors.top_k(v, v, 3, index=index).select(F.col("qid").alias("src"), F.col("id").alias("tgt"), "cos"), "signal-links")
    near = vectors.similar_pairs(v, THRESHOLD, links=links, index=index)
    far = links.where(F.col("cos") < THRESHOLD).select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).distinct()
    none = F.lit(0.0)
    both = near.select("a", "b", F.col("cos").alias("semantic"), F.when(F.col("linked"), 1.0).otherwise(none).alias("link"), F.when(F.col("same"), 0.2).otherwise(none).alias("keyword"))
    both = both.unionAll(far.select("a", "b", none, F.lit(1.0), none))
    return both.withColumn("total", F.col("semantic") + F.col("link") + F.col("keyword"))


def multi_signal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("a", "b", *[F.round(c, 6).alias(c) for c in ("semantic", "link", "keyword", "total")])


def _graph_edges(spark: SparkSession, sf_dir: str, t: float) -> DataFrame:
    return vectors.similar_pairs(_vectors(spark, sf_dir).withColumn("grp", F.col("id")), t)


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = graph.components(_graph_edges(spark, sf_dir, 0.38), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")))
    return roots.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where("size >= 2")


def split_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components within a label: the largest is its core, others of three and more could be split off."""
    v = _vectors(spark, sf_dir)
    inside = _graph_edges(spark, sf_dir, 0.25).join(v.select(F.col("id").alias("a"), F.col("grp").alias("ga")), "a").join(v.select(F.col("id").alias("b"), F.col("grp").alias("gb")), "b").where("ga = gb")
    roots = graph.components(inside, v.select("id")).join(v.select("id", "grp"), "id")
    sizes = roots.groupBy(F.col("grp").alias("label"), "root").agg(F.count(F.lit(1)).alias("size")).where("size >= 2")
    r = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("size"), "root"))
    return sizes.withColumn("place", r).where("place = 1 or size >= 3").select("label", "root", "size", F.when(F.col("place") == 1, "core").otherwise("split").alias("kind"))


def louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities over every edge with a signal."""
    s = _signals(spark, sf_dir).select("a", "b", F.round("total", 6).alias("w"))
    return graph.communities(s, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")))


def edge_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _graph_edges(spark, sf_dir, THRESHOLD).select(F.col("a").alias("src"), F.col("b").alias("tgt"), (F.col("a") % 4).alias("version"))
    live = table(spark, sf_dir, "embeddings").where("vec_id % 6 <> 0").select(F.col("vec_id").alias("id"))
    return joins.reconcile_endpoints(e, live, "id", F.col("version") < 3).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def shared_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _graph_edges(spark, sf_dir, THRESHOLD).select(F.col("a").alias("src"), F.col("b").alias("tgt"))
    v = table(spark, sf_dir, "embeddings")
    hubs = v.select(F.col("vec_id").alias("node"), F.explode(F.array(F.concat(F.lit("l"), F.col("label")), F.concat(F.lit("m"), F.col("vec_id") % 7))).alias("hub"))
    return joins.shared_hubs(e, hubs).groupBy("hub").agg(F.count(F.lit(1)).alias("edges"))


def cluster_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's best covered share by any residue's members, with its verdict."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("cluster"))
    refs = v.select("id", (F.col("id") % 3).alias("page")).where("id % 5 <> 0")
    size = v.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    hit = v.join(refs, "id").groupBy("cluster", "page").agg(F.count(F.lit(1)).alias("hit"))
    cover = hit.join(size, "cluster").groupBy("cluster").agg(F.max(F.struct((F.col("hit") / F.col("size")).alias("c"), (-F.col("page")).alias("p"))).alias("t"))
    share = F.round(F.col("t.c"), 6)
    return cover.select("cluster", (-F.col("t.p")).alias("page"), share.alias("coverage"), F.when(share >= 0.7, "covered").when(share >= 0.3, "extend").otherwise("new").alias("verdict"))


def more_like_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language filter comes after the best 2k, so some queries have fewer than k rows."""
    d = table(spark, sf_dir, "documents")
    scores = fulltext.bm25_top(d, fulltext.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text"), "doc_id", F.col("text"), 2 * 3).drop("rank")
    return fulltext.top_then_filter(scores, ["qid"], "doc_id", 3, d.where("lang <> 'en'").select("doc_id"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = fulltext.postings(table(spark, sf_dir, "conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn")), "key", {"text": F.col("text"), "role": F.col("role")})
    return index.where("term <> ''").groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"), F.max("dl").cast("long").alias("longest"))


def count_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).alias("before"), F.count_if(F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")).alias("after"))
    return e.select("user_id", "before", "after", values.count_drift(F.col("after"), F.col("before")).alias("drift"))


def stale_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose latest order is older than one from their nation, by more than 30 days, with the count of such nations' peers."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"))
    newest = c.groupBy("c_nationkey").agg(F.max("last").alias("newest"))
    return c.join(newest, "c_nationkey").where(F.datediff("newest", "last") > 30).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("stale"), F.max(F.datediff("newest", "last")).alias("worst_days"))


def first_last_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", T.sentences(F.col("text")).alias("s"))
    return b.select("item_id", F.size("s").cast("long").alias("sentences"), F.array_join(values.first_and_last(F.col("s"), 2, 1), " | ").alias("taken"))


def weakest(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return ranking.ranked(li, ["l_suppkey"], [F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], "place", 3)


def claim_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", _lines("text", 40).alias("line"))
    return d.select("doc_id", values.claim_slug(F.col("line")).alias("slug")).groupBy("slug").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


QUERIES = {f"q_{f.__name__}": f for f in (
    more_like_then_filter, postings, count_drift, stale_links, first_last_sentences, weakest, claim_slugs, claims_by_doc, exact_dup_groups, chunks, term_candidates, keyword_fold, jaccard_pairs, numeric_tokens, numeric_unmatched, negation_parity, extractiveness, overlap_verdict,
    weighted_recall, slug, top_lines, mode_source, mention_counts, link_graph, broken_links, missing_backlinks, orphans, degree_flow, top_degrees, density, multi_signal_edges, components,
    split_candidates, louvain, edge_reconcile, shared_hubs, cluster_coverage)}

_NUM = r"regexp_extract_all(coalesce({}, ''), '(?:^|[^\p{{L}}\p{{N}}.,])([0-9][0-9,]*(?:\.[0-9]+)?)', 1)"
_NORM = r"list_transform({}, lambda x: CASE WHEN contains(replace(x, ',', ''), '.') THEN regexp_replace(regexp_replace(replace(x, ',', ''), '0+$', ''), '\.$', '') ELSE replace(x, ',', '') END)"
_NUMBERS = lambda c: _NORM.format(_NUM.format(c))
_PAIRS = """said AS (SELECT conv_id, turn - 1 AS turn, text AS claim FROM conversations WHERE role = 'assistant'), pr AS (SELECT s.*, c.text AS evidence FROM said s JOIN conversations c USING (conv_id, turn) {})"""
_ITEMS = """bl AS (SELECT DISTINCT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark), dl AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    it AS (SELECT DISTINCT item_id, doc_id FROM bl JOIN dl USING (line) WHERE length(line) >= 40)"""
_SIG = f"list_distinct(list_filter({TOKEN_SQL.format('b.text')}, lambda t: length(t) >= 4))"
_VERDICTS = f"""{_ITEMS}, vv AS (SELECT item_id, doc_id, lang, round(len(list_intersect({_SIG}, {TOKEN_SQL.format('d.text')})) / greatest(len({_SIG}), 1), 6) AS overlap,
    len(list_filter(list_distinct({_NUMBERS('b.text')}), lambda x: NOT list_contains({_NUMBERS('d.text')}, x))) AS missing FROM it JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id)),
    ver AS (SELECT item_id, doc_id, lang, overlap, CASE WHEN overlap >= 0.75 AND missing = 0 THEN 'match' WHEN overlap >= 0.45 AND missing <= 1 THEN 'partial' ELSE 'miss' END AS verdict FROM vv)"""
_DIGRAPH = f"{_NEAR}, g AS (SELECT qid AS src, id AS tgt, qgrp, grp FROM n WHERE rank <= 3)"
_SLUG = r"regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g')"
_SINGULAR = "CASE WHEN regexp_matches({0}, '[^aeiou]ies$') THEN regexp_replace({0}, 'ies$', 'y') WHEN regexp_matches({0}, 'sses$') THEN regexp_replace({0}, 'es$', '') WHEN regexp_matches({0}, '[^sui]s$') AND length({0}) > 3 THEN regexp_replace({0}, 's$', '') ELSE {0} END"
_KEY = lambda s: f"CASE WHEN contains({s}, '-') THEN regexp_replace({s}, '[^-]*$', '') || {_SINGULAR.format(f'string_split({s}, chr(45))[-1]')} ELSE {_SINGULAR.format(s)} END"
_LINKS = r"""l AS (SELECT DISTINCT page_id AS src, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS link FROM pages), k AS (SELECT regexp_extract(html, '<h1>([^ <]*)', 1) AS link, min(page_id) AS tgt FROM pages GROUP BY 1 HAVING link <> '')"""


def _component_sql(edges: str) -> str:
    return f"""WITH RECURSIVE {_V}, e AS ({edges}), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r AS (SELECT id, id AS root FROM v UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.id),
        c AS (SELECT id, min(root) AS root FROM r GROUP BY 1)"""


ORACLES = {
    "q_more_like_then_filter": f"""WITH {_BM25}, t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM scored),
        f AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM t WHERE r <= 6 AND doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'en')) SELECT * FROM f WHERE rank <= 3""",
    "q_postings": f"""WITH x AS (SELECT conv_id * 1000 + turn AS key, 'text' AS field, {TOKEN_SQL.format('text')} AS ts FROM conversations UNION ALL SELECT conv_id * 1000 + turn, 'role', {TOKEN_SQL.format('role')} FROM conversations),
        t AS (SELECT field, key, len(ts) AS dl, unnest(ts) AS term FROM x) SELECT field, term, count(DISTINCT key) AS df, count(*) AS tf, max(dl) AS longest FROM t GROUP BY 1, 2""",
    "q_count_drift": """WITH c AS (SELECT user_id, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS before, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS after FROM events GROUP BY 1)
        SELECT user_id, before, after, abs(after - before) >= greatest(5, floor(before * 0.2::DOUBLE)) AS drift FROM c""",
    "q_stale_links": """WITH c AS (SELECT c_nationkey, c_custkey, max(o_orderdate) AS last FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2), n AS (SELECT *, max(last) OVER (PARTITION BY c_nationkey) AS newest FROM c)
        SELECT c_nationkey, count(*) AS stale, max(date_diff('day', last, newest))::INTEGER AS worst_days FROM n WHERE date_diff('day', last, newest) > 30 GROUP BY 1""",
    "q_first_last_sentences": r"""WITH s AS (SELECT item_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \n]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM benchmark)
        SELECT item_id, len(s) AS sentences, array_to_string(list_concat(s[1:2], CASE WHEN len(s) > 2 THEN s[-1:] ELSE [] END), ' | ') AS taken FROM s""",
    "q_weakest": "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS place FROM lineitem) WHERE place <= 3",
    "q_claims_by_doc": "SELECT doc_id, i - 1 AS position, claim, contains(claim, '|') AS is_table FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS claim, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE length(claim) >= 10",
    "q_exact_dup_groups": "SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING n > 1",
    "q_chunks": f"WITH {_CHUNKED} SELECT doc_id, c AS chunk_id, md5(chunk) AS hash, n_words FROM chunked",
    "q_term_candidates": r"""
        WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS s FROM documents),
        t AS (SELECT DISTINCT doc_id, source, s, unnest(list_concat(list_filter(regexp_extract_all(line, '[A-Z][A-Z0-9-]+'), lambda a: length(a) BETWEEN 2 AND 10), regexp_extract_all(line, '[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}'))) AS term FROM l),
        g AS (SELECT term, count(DISTINCT doc_id) AS pages, count(DISTINCT source) AS categories, round(sum(CASE WHEN s = 0 THEN 2.0::DOUBLE ELSE 1.0 END), 6) AS weighted FROM t GROUP BY 1 HAVING pages >= 3)
        SELECT *, CASE WHEN regexp_matches(term, '^[A-Z0-9][A-Z0-9-]{1,9}$') AND pages >= 10 AND pages > 0.05 * (SELECT count(*) FROM documents) THEN 'glossary' WHEN categories >= 2 THEN 'bridge' WHEN pages >= 5 THEN 'deep' ELSE 'candidate' END AS tier FROM g""",
    "q_keyword_fold": f"""
        WITH w AS (SELECT p_partkey AS page, p_type AS category, unnest([p_name, p_name || 's']) AS term FROM part), f AS (SELECT *, {_SLUG.format('term')} AS slug FROM w WHERE page % 3 = 0 OR NOT term LIKE '%ss'),
        t AS (SELECT *, {_KEY('slug')} AS k FROM f), m AS (SELECT DISTINCT k, slug FROM (SELECT page, k, slug, count(DISTINCT slug) OVER (PARTITION BY page, k) AS c FROM t) WHERE c > 1),
        z AS (SELECT t.*, CASE WHEN m.k IS NOT NULL THEN t.k ELSE t.slug END AS key FROM t LEFT JOIN m ON m.k = t.k AND m.slug = t.slug)
        SELECT key, max_by(term, (length(term), term)) AS term, count(DISTINCT page) AS pages, count(DISTINCT category) AS categories, round(count(DISTINCT page) * sqrt(greatest(count(DISTINCT category), 1)), 6) AS weight FROM z GROUP BY 1 HAVING pages >= 3""",
    "q_jaccard_pairs": f"""
        WITH n AS (SELECT DISTINCT p_name, list_distinct({TOKEN_SQL.format('p_name')}) AS ts FROM part)
        SELECT a.p_name AS a, b.p_name AS b, round(len(list_intersect(a.ts, b.ts)) / len(list_distinct(list_concat(a.ts, b.ts))), 6) AS jaccard, round(len(list_intersect(a.ts, b.ts)) / least(len(a.ts), len(b.ts)), 6) AS overlap
        FROM n a JOIN n b ON a.p_name < b.p_name WHERE round(len(list_intersect(a.ts, b.ts)) / len(list_distinct(list_concat(a.ts, b.ts))), 6) >= 0.2""",
    "q_numeric_tokens": f"SELECT number, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({_NUMBERS('text')}) AS number FROM documents) GROUP BY 1",
    "q_numeric_unmatched": f"WITH {_PAIRS.format('')} SELECT conv_id, turn, len(list_distinct({_NUMBERS('claim')})) AS numbers, len(list_filter(list_distinct({_NUMBERS('claim')}), lambda x: NOT list_contains({_NUMBERS('evidence')}, x))) AS unmatched FROM pr",
    "q_negation_parity": f"WITH {_PAIRS.format('WHERE c.role = ' + chr(39) + 'user' + chr(39))} SELECT conv_id, turn, len(list_intersect({TOKEN_SQL.format('claim')}, {list(T.NEGATIONS)})) > 0 AND len(list_intersect({TOKEN_SQL.format('evidence')}, {list(T.NEGATIONS)})) = 0 AS mismatch FROM pr",
    "q_overlap_verdict": f"WITH {_VERDICTS} SELECT * FROM ver",
    "q_weighted_recall": f"""WITH {_VERDICTS}, s AS (SELECT lang, CASE verdict WHEN 'match' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5 ELSE 0 END AS s, (3 - item_id % 3)::DOUBLE AS w FROM ver)
        SELECT coalesce(lang, '(all)') AS axis, count(*) AS n, round(sum(s * w) / sum(w), 6) AS recall FROM s GROUP BY ROLLUP (lang) HAVING count(*) > 0""",
    "q_slug": f"WITH p AS (SELECT DISTINCT p_name, p_brand, {_SLUG.format(chr(112) + '_brand || chr(32) || p_name')} AS slug FROM part) SELECT p_name, p_brand, slug, {_KEY('slug')} AS canonical FROM p",
    "q_top_lines": """
        WITH l AS (SELECT DISTINCT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents), g AS (SELECT line, count(*) AS n, count(DISTINCT source) AS breadth FROM l WHERE length(line) >= 20 GROUP BY 1 HAVING n >= 2),
        t AS (SELECT *, row_number() OVER (ORDER BY n DESC, breadth DESC, line) AS rank FROM g) SELECT md5(line) AS hash, n, breadth, rank, n >= coalesce((SELECT n FROM t WHERE rank = 8), 0) AS quintile FROM t WHERE rank <= 40""",
    "q_mode_source": "SELECT lang, source, votes, first_seen FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY votes DESC, first_seen) AS r FROM (SELECT lang, source, count(*) AS votes, min(doc_id) AS first_seen FROM documents GROUP BY 1, 2)) WHERE r = 1",
    "q_mention_counts": f"""
        WITH d AS (SELECT doc_id, ' ' || array_to_string({TOKEN_SQL.format('text')}, ' ') || ' ' AS t FROM documents), m(term) AS (VALUES ('of the'), ('the'), ('in the'), ('and the'), ('de la'))
        SELECT term, count(*) AS docs FROM m JOIN d ON contains(t, ' ' || term || ' ') GROUP BY 1""",
    "q_link_graph": f"WITH {_LINKS} SELECT DISTINCT src, tgt FROM l JOIN k USING (link)",
    "q_broken_links": f"WITH {_LINKS} SELECT src, count(*) AS broken FROM l ANTI JOIN k USING (link) GROUP BY 1",
    "q_missing_backlinks": f"WITH {_DIGRAPH} SELECT src, tgt FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.src = g.tgt AND h.tgt = g.src)",
    "q_orphans": f"WITH {_V}, e AS (SELECT a.id AS x, b.id AS y FROM v a JOIN v b ON a.id < b.id AND a.grp <> b.grp WHERE {_COS} >= {THRESHOLD}) SELECT id FROM v WHERE id NOT IN (SELECT x FROM e UNION SELECT y FROM e)",
    "q_degree_flow": f"WITH {_DIGRAPH} SELECT qgrp::BIGINT AS src_label, grp::BIGINT AS tgt_label, count(*) AS n, count(DISTINCT tgt) AS targets FROM g GROUP BY 1, 2",
    "q_top_degrees": f"WITH {_DIGRAPH}, o AS (SELECT src AS id, count(*) AS n FROM g GROUP BY 1), i AS (SELECT tgt AS id, count(*) AS n FROM g GROUP BY 1) SELECT id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM o FULL JOIN i USING (id) ORDER BY in_degree DESC, id LIMIT 5",
    "q_density": f"WITH {_DIGRAPH} SELECT count(*) AS directed, count(DISTINCT (least(src, tgt), greatest(src, tgt))) AS undirected, round(count(DISTINCT (least(src, tgt), greatest(src, tgt))) / ((SELECT count(*) * (count(*) - 1) FROM v) / 2), 6) AS density FROM g",
    "q_multi_signal_edges": f"""WITH {_DIGRAPH}, s AS (SELECT a.id AS a, b.id AS b, {_COS} AS semantic, CASE WHEN a.grp = b.grp THEN 0.2::DOUBLE ELSE 0 END AS keyword FROM v a JOIN v b ON a.id < b.id WHERE {_COS} >= {THRESHOLD}), h AS (SELECT DISTINCT least(src, tgt) AS a, greatest(src, tgt) AS b FROM g)
        SELECT coalesce(s.a, h.a) AS a, coalesce(s.b, h.b) AS b, coalesce(semantic, 0) AS semantic, CASE WHEN h.a IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END AS link, coalesce(keyword, 0) AS keyword, round(coalesce(semantic, 0) + coalesce(keyword, 0) + CASE WHEN h.a IS NOT NULL THEN 1 ELSE 0 END, 6) AS total FROM s FULL JOIN h ON s.a = h.a AND s.b = h.b""",
    "q_components": _component_sql(f"SELECT a.id AS x, b.id AS y FROM v a JOIN v b ON a.id < b.id WHERE {_COS} >= 0.38") + " SELECT root, count(*) AS size FROM c GROUP BY 1 HAVING size >= 2",
    "q_split_candidates": _component_sql(f"SELECT a.id AS x, b.id AS y FROM v a JOIN v b ON a.id < b.id AND a.grp = b.grp WHERE {_COS} >= 0.25") + """, z AS (SELECT grp AS label, root, count(*) AS size FROM c JOIN v USING (id) GROUP BY 1, 2 HAVING size >= 2), p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY size DESC, root) AS place FROM z)
        SELECT label::BIGINT AS label, root, size, CASE WHEN place = 1 THEN 'core' ELSE 'split' END AS kind FROM p WHERE place = 1 OR size >= 3""",
    "q_edge_reconcile": f"""WITH {_V}, e AS (SELECT a.id AS src, b.id AS tgt FROM v a JOIN v b ON a.id < b.id WHERE {_COS} >= {THRESHOLD})
        SELECT CASE WHEN src % 6 = 0 OR tgt % 6 = 0 THEN 'stale-missing' WHEN src % 4 >= 3 THEN 'stale-version' ELSE 'active' END AS status, count(*) AS n FROM e GROUP BY 1""",
    "q_shared_hubs": f"""WITH {_V}, e AS (SELECT a.id AS s, b.id AS t, a.grp AS x, b.grp AS y FROM v a JOIN v b ON a.id < b.id WHERE {_COS} >= {THRESHOLD}),
        h AS (SELECT 'l' || x AS hub FROM e WHERE x = y UNION ALL SELECT 'm' || (s % 7) FROM e WHERE s % 7 = t % 7 UNION ALL SELECT '_no_hub_' FROM e WHERE x <> y AND s % 7 <> t % 7) SELECT hub, count(*) AS edges FROM h GROUP BY 1""",
    "q_cluster_coverage": """
        WITH v AS (SELECT vec_id AS id, label AS cluster FROM embeddings), z AS (SELECT cluster, count(*) AS size FROM v GROUP BY 1), h AS (SELECT cluster, id % 3 AS page, count(*) AS hit FROM v WHERE id % 5 <> 0 GROUP BY 1, 2),
        t AS (SELECT cluster, page, hit / size AS c, row_number() OVER (PARTITION BY cluster ORDER BY hit / size DESC, page) AS k FROM h JOIN z USING (cluster))
        SELECT cluster::BIGINT AS cluster, page, round(c, 6) AS coverage, CASE WHEN round(c, 6) >= 0.7 THEN 'covered' WHEN round(c, 6) >= 0.3 THEN 'extend' ELSE 'new' END AS verdict FROM t WHERE k = 1""",
}
