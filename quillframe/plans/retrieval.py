"""Queries on vectors and full text: neighbours, pairs, votes, BM25, fusion, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators import aggregates, fulltext, metrics, ranking, vectors
from quillframe.sources.tables import table

THRESHOLD = 0.30
TOKEN_SQL = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"
_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label AS grp FROM embeddings)"
_COS = "round(list_inner_product(a.e, b.e), 6)"
_NEAR = f"""{_V}, c AS (SELECT a.id AS qid, b.id, b.grp, a.grp AS qgrp, {_COS} AS cos FROM v a JOIN v b ON a.id <> b.id),
    n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id) AS rank FROM c WHERE cos > 0)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("long").alias("grp"))


def _neighbours(spark: SparkSession, sf_dir: str, k: int, **how) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return vectors.top_k(v, v, k, **how)


def knn_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return vectors.top_k(v.where("id % 50 = 0"), v, 10).select("qid", "id", "cos", "rank")


def knn_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters come before k; the seeds of q_knn_seed are the queries, all rows of the filtered groups are searched."""
    v = _vectors(spark, sf_dir)
    return vectors.top_k(v.where("id % 50 = 0"), v.where("grp in (1, 3, 5)"), 5, positive=False).select("qid", "id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "cos")), 6).alias("cos"), "rank")


def knn_text_filter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, under its earlier name."""
    return knn_text_filter(spark, sf_dir)


def sim_join_cross_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.similar_pairs(_vectors(spark, sf_dir), THRESHOLD)


def best_overlap_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    near = vectors.similar_pairs(v.where("grp = 0").withColumn("grp", F.lit(-1).cast("long")).unionByName(v.where("grp <> 0")), 0.25)
    labelled = near.join(v.select(F.col("id").alias("a"), F.col("grp").alias("ga")), "a").join(v.select(F.col("id").alias("b"), F.col("grp").alias("gb")), "b").where("(ga = 0) <> (gb = 0)")
    flat = labelled.select(F.when(F.col("ga") == 0, F.col("a")).otherwise(F.col("b")).alias("new_id"), F.when(F.col("ga") == 0, F.col("b")).otherwise(F.col("a")).alias("old_id"), F.greatest("ga", "gb").alias("label"), "cos")
    best = flat.groupBy("label").agg(F.max(F.struct("cos", (-F.col("new_id")).alias("x"), (-F.col("old_id")).alias("y"))).alias("t"))
    return best.select("label", (-F.col("t.x")).alias("new_id"), (-F.col("t.y")).alias("old_id"), F.col("t.cos").alias("cos")).orderBy(F.desc("cos"), "label").limit(10)


def reciprocal_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    near = _neighbours(spark, sf_dir, 1, same_group="other", positive=False).select(F.col("qid").alias("id"), F.col("grp").alias("best_page")).join(v.select("id", F.col("grp").alias("page")), "id")
    sizes = v.groupBy(F.col("grp").alias("page")).agg(F.count(F.lit(1)).alias("n"))
    return aggregates.reciprocal_top1(near.select("page", "best_page"), sizes, 8, 0.10).select("a", "b", F.round("score", 6).alias("score"))


def cluster_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    c = vectors.centroids(v)
    near = v.join(c.select("grp", F.col("vec").alias("c")), "grp").select("grp", "id", F.round(F.aggregate(F.zip_with("vec", "c", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x), 6).alias("cos"))
    return ranking.ranked(near, ["grp"], [F.desc("cos"), F.col("id")], "rank", 8)


def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vote(_neighbours(spark, sf_dir, 5))


def loo_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave one out: each vector's vote against its own label."""
    v = _vectors(spark, sf_dir)
    told = v.select(F.col("id").alias("qid"), F.col("grp").alias("actual")).join(vectors.vote(_neighbours(spark, sf_dir, 5)), "qid")
    return told.groupBy("actual", F.col("category").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def adaptive_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _neighbours(spark, sf_dir, 20).select("qid", "id", "cos")
    return ranking.adaptive_select(hits, ["qid"], "cos", "id", 0.15, 0.12, 4, 8)


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.bm25_top(table(spark, sf_dir, "documents"), _queries(spark, sf_dir), "doc_id", F.col("text"), 10)


def bm25_more_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seed's first line as query, the seed itself left out before k."""
    d = table(spark, sf_dir, "documents")
    seeds = d.where("doc_id % 50 = 0").select("doc_id", F.element_at(F.split("text", "\n"), 1).alias("line"))
    return fulltext.bm25_fields(d, fulltext.query_terms(seeds, "doc_id", "line"), "doc_id", {"text": F.col("text")}, {"text": 1.0}, 5, others_only=True)


def _local_chunks(spark: SparkSession, sf_dir: str, items: DataFrame) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.struct("doc_id", "source").alias("of"), "text")
    parts = ranking.chunks(d, "of", "text").select("of.source", (F.col("of.doc_id") * 10_000 + F.col("chunk_id")).alias("key"), "chunk")
    terms = fulltext.query_terms(items, "item_id", "text")
    return fulltext.bm25_top(parts, terms, "key", F.col("chunk"), 3, "source")


def bm25_local_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks ranked inside their own source, with that source's statistics, for all benchmark items."""
    return _local_chunks(spark, sf_dir, table(spark, sf_dir, "benchmark"))


def bm25_local_chunks_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, under its earlier name."""
    return bm25_local_chunks(spark, sf_dir)


def like_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = fulltext.token_count_score(table(spark, sf_dir, "documents"), _queries(spark, sf_dir), "doc_id", F.col("text"))
    return fulltext.top(scores, ["qid"], "doc_id", 10)


def _two_rankings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fulltext.both_tops(table(spark, sf_dir, "documents"), _queries(spark, sf_dir), "doc_id", F.col("text"), 50)


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.fuse(*_two_rankings(spark, sf_dir), ["qid"], "doc_id").select("qid", "doc_id", "rrf", "rank")


def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected: documents that hold the benchmark item's text, critical in English, else important."""
    first, _ = _two_rankings(spark, sf_dir)
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    lines = lambda t: F.explode(F.array_distinct(F.filter(F.split(t, "\n"), lambda x: F.length(x) >= 40)))
    shared = b.select(F.col("item_id").alias("qid"), lines(F.col("text")).alias("line")).join(d.select(F.col("doc_id").alias("key"), "lang", lines(F.col("text")).alias("line")), "line")
    expected = shared.select("qid", "key", F.when(F.col("lang") == "en", "critical").otherwise("important").alias("importance")).distinct()
    return metrics.rank_metrics(first.select("qid", F.col("doc_id").alias("key"), "rank"), expected)


def ranking_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_rankings(spark, sf_dir)
    both = a.where("rank <= 10").select("qid", "doc_id", F.lit(1).alias("x")).join(b.where("rank <= 10").select("qid", "doc_id", F.lit(1).alias("y")), ["qid", "doc_id"], "full_outer")
    return both.groupBy("qid").agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("stayed"), F.count_if(F.col("x").isNull()).alias("entered"), F.count_if(F.col("y").isNull()).alias("left_out"))


QUERIES = {f"q_{f.__name__}": f for f in (
    knn_seed, knn_text_filter, knn_text_filter_all, sim_join_cross_label, best_overlap_per_label, reciprocal_top1, cluster_representatives, knn_vote, loo_confusion, adaptive_select,
    bm25_topk, bm25_more_like, bm25_local_chunks, bm25_local_chunks_all, like_token_count, rrf_hybrid, rank_metrics, ranking_overlap)}


def _bm25(docs: str, terms: str, key: str, local: str | None = None) -> str:
    """CTEs up to scored(qid, key, score) over docs CTE ``dd`` (key, ts) and ``q`` (qid, term)."""
    by, on = (f"{local}, ", f"AND p.{local} = s.{local}") if local else ("", "")
    part = f"PARTITION BY {local}" if local else ""
    return f"""
        q AS ({terms}), dd AS ({docs}),
        s AS (SELECT {by}count(*) AS n, avg(len(ts)) AS avgdl FROM dd {f'GROUP BY {local}' if local else ''}),
        p AS (SELECT {by}{key}, len(ts) AS dl, unnest(ts) AS term FROM dd),
        tf AS (SELECT {by}{key}, term, count(*) AS tf, any_value(dl) AS dl FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        df AS (SELECT *, count(*) OVER (PARTITION BY {by}term) AS df FROM tf),
        scored AS (SELECT q.qid, {by.replace(', ', '') and f'p.{local}, '}p.{key}, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
          FROM df p JOIN q USING (term) JOIN s ON true {on} GROUP BY ALL)"""


_DOCS = f"SELECT doc_id, {TOKEN_SQL.format('text')} AS ts FROM documents"
_TERMS = f"SELECT item_id AS qid, unnest(list_distinct({TOKEN_SQL.format('text')})) AS term FROM benchmark"
_BM25 = _bm25(_DOCS, _TERMS, "doc_id")
_COUNTED = "counted AS (SELECT qid, doc_id, count(*)::DOUBLE AS score FROM (SELECT DISTINCT doc_id, term FROM p) x JOIN q USING (term) GROUP BY ALL)"
_TOP = "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM {}"
_TWO = f"{_BM25}, {_COUNTED}, r1 AS (SELECT * FROM ({_TOP.format('scored')}) WHERE rank <= 50), r2 AS (SELECT * FROM ({_TOP.format('counted')}) WHERE rank <= 50)"
_CHUNKED = r"""
        w AS (SELECT doc_id, source, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
        st AS (SELECT doc_id, source, w, unnest(range(0, greatest(ceil((len(w) - 250) / 190.0), 0)::BIGINT + 1)) AS c FROM w WHERE len(w) > 0),
        ch AS (SELECT doc_id, source, c, w[c * 190 + 1 : c * 190 + 250] AS x FROM st), chunked AS (SELECT doc_id, source, c, array_to_string(x, ' ') AS chunk, len(x) AS n_words FROM ch WHERE len(x) >= 30 OR c = 0)"""

ORACLES = {
    "q_knn_seed": f"WITH {_NEAR} SELECT qid, id, cos, rank FROM n WHERE qid % 50 = 0 AND rank <= 10",
    "q_knn_text_filter": f"""WITH {_V}, c AS (SELECT a.id AS qid, b.id, {_COS} AS cos FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0 AND b.grp IN (1, 3, 5)),
        n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id) AS rank FROM c) SELECT qid, id, greatest(0, least(1, cos)) AS cos, rank FROM n WHERE rank <= 5""",
    "q_sim_join_cross_label": f"WITH {_V} SELECT a.id AS a, b.id AS b, {_COS} AS cos FROM v a JOIN v b ON a.id < b.id AND a.grp <> b.grp WHERE {_COS} >= {THRESHOLD}",
    "q_best_overlap_per_label": f"""WITH {_V}, c AS (SELECT b.grp AS label, a.id AS new_id, b.id AS old_id, {_COS} AS cos FROM v a JOIN v b ON a.grp = 0 AND b.grp <> 0 WHERE {_COS} >= 0.25),
        r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cos DESC, new_id, old_id) AS k FROM c) SELECT label::BIGINT AS label, new_id, old_id, cos FROM r WHERE k = 1 ORDER BY cos DESC, label LIMIT 10""",
    "q_reciprocal_top1": f"""WITH {_V}, c AS (SELECT a.id, a.grp AS page, b.grp AS best, row_number() OVER (PARTITION BY a.id ORDER BY {_COS} DESC, b.id) AS k FROM v a JOIN v b ON a.grp <> b.grp),
        z AS (SELECT grp AS page, count(*) AS n FROM v GROUP BY 1), s AS (SELECT c.page, best, count(*) / any_value(n) AS share FROM c JOIN z USING (page) WHERE k = 1 AND n >= 8 GROUP BY 1, 2)
        SELECT x.page::BIGINT AS a, x.best::BIGINT AS b, round(least(x.share, y.share), 6) AS score FROM s x JOIN s y ON x.page = y.best AND x.best = y.page WHERE x.page < x.best AND least(x.share, y.share) >= 0.10""",
    "q_cluster_representatives": f"""WITH {_V}, m AS (SELECT grp, d, avg(e[d]) AS x FROM v, range(1, 65) r(d) GROUP BY 1, 2), u AS (SELECT grp, list(x / z ORDER BY d) AS c FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY grp)) AS z FROM m) GROUP BY 1),
        n AS (SELECT v.grp::BIGINT AS grp, id, round(list_inner_product(e, c), 6) AS cos FROM v JOIN u USING (grp)) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY cos DESC, id) AS rank FROM n) WHERE rank <= 8""",
    "q_knn_vote": f"""WITH {_NEAR}, k AS (SELECT qid, grp, count(*) AS votes, min(rank) AS f FROM n WHERE rank <= 5 GROUP BY 1, 2), r AS (SELECT *, sum(votes) OVER (PARTITION BY qid) AS t, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, f) AS r FROM k)
        SELECT qid, grp::BIGINT AS category, round(votes / t, 6) AS confidence, votes >= 3 AS strong FROM r WHERE r = 1""",
    "q_loo_confusion": f"""WITH {_NEAR}, k AS (SELECT qid, qgrp, grp, count(*) AS votes, min(rank) AS f FROM n WHERE rank <= 5 GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, f) AS r FROM k)
        SELECT qgrp::BIGINT AS actual, grp::BIGINT AS predicted, count(*) AS n FROM r WHERE r = 1 GROUP BY 1, 2""",
    "q_adaptive_select": f"""WITH {_NEAR}, t AS (SELECT qid, id, cos, rank, max(cos) OVER (PARTITION BY qid) AS top FROM n WHERE rank <= 20)
        SELECT qid, id, cos, CASE WHEN cos < 0.15 THEN 'floor' WHEN rank <= 4 THEN 'kept' WHEN rank > 8 THEN 'cap' WHEN cos >= round(top - 0.12, 9) THEN 'kept' ELSE 'gap' END AS reason FROM t""",
    "q_bm25_topk": f"WITH {_BM25} SELECT * FROM ({_TOP.format('scored')}) WHERE rank <= 10",
    "q_bm25_more_like": "WITH " + _bm25(_DOCS, f"SELECT doc_id AS qid, unnest(list_distinct({TOKEN_SQL.format('string_split(text, chr(10))[1]')})) AS term FROM documents WHERE doc_id % 50 = 0", "doc_id") + f" SELECT * FROM ({_TOP.format('scored')} WHERE qid <> doc_id) WHERE rank <= 5",
    "q_bm25_local_chunks": f"WITH {_CHUNKED}, " + _bm25(f"SELECT doc_id * 10000 + c AS key, source, {TOKEN_SQL.format('chunk')} AS ts FROM chunked", _TERMS, "key", "source") + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, key) AS rank FROM scored) WHERE rank <= 3",
    "q_like_token_count": f"WITH {_BM25}, {_COUNTED} SELECT * FROM ({_TOP.format('counted')}) WHERE rank <= 10",
    "q_rrf_hybrid": f"""WITH {_TWO}, f AS (SELECT coalesce(r1.qid, r2.qid) AS qid, coalesce(r1.doc_id, r2.doc_id) AS doc_id, r1.rank AS a, r2.rank AS b, round(coalesce(1.0::DOUBLE / (60 + r1.rank), 0) + coalesce(1.0::DOUBLE / (60 + r2.rank), 0), 9) AS rrf FROM r1 FULL JOIN r2 ON r1.qid = r2.qid AND r1.doc_id = r2.doc_id)
        SELECT qid, doc_id, rrf, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, a NULLS LAST, b NULLS LAST, doc_id) AS rank FROM f) WHERE rank <= 10""",
    "q_rank_metrics": f"""WITH {_TWO}, dl AS (SELECT DISTINCT doc_id AS key, lang, unnest(string_split(text, chr(10))) AS line FROM documents), bl AS (SELECT DISTINCT item_id AS qid, unnest(string_split(text, chr(10))) AS line FROM benchmark),
        e AS (SELECT DISTINCT qid, key, CASE WHEN lang = 'en' THEN 3.0::DOUBLE ELSE 2.0 END AS gain FROM bl JOIN dl USING (line) WHERE length(line) >= 40),
        i AS (SELECT e.*, row_number() OVER (PARTITION BY e.qid ORDER BY gain DESC, e.key) AS i, r1.rank FROM e LEFT JOIN r1 ON r1.qid = e.qid AND r1.doc_id = e.key AND r1.rank <= 10)
        SELECT qid, round(coalesce(1.0::DOUBLE / coalesce(min(rank) FILTER (gain = 3), min(rank)), 0), 6) AS mrr, round(sum(coalesce(gain / log2(rank + 1), 0)) / sum(CASE WHEN i <= 10 THEN gain / log2(i + 1) ELSE 0 END), 6) AS ndcg,
          round(count(rank) / count(*), 6) AS recall, round(CASE WHEN count(*) FILTER (gain = 3) > 0 THEN count(rank) FILTER (gain = 3) / count(*) FILTER (gain = 3) ELSE 1 END, 6) AS critical_recall, count(rank) AS hits FROM i GROUP BY 1""",
    "q_ranking_overlap": f"""WITH {_TWO}, f AS (SELECT coalesce(x.qid, y.qid) AS qid, x.doc_id AS a, y.doc_id AS b FROM (FROM r1 WHERE rank <= 10) x FULL JOIN (FROM r2 WHERE rank <= 10) y ON x.qid = y.qid AND x.doc_id = y.doc_id)
        SELECT qid, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS stayed, count(*) FILTER (a IS NULL) AS entered, count(*) FILTER (b IS NULL) AS left_out FROM f GROUP BY 1""",
}
ORACLES["q_bm25_local_chunks_all"] = ORACLES["q_bm25_local_chunks"]
ORACLES["q_knn_text_filter_all"] = ORACLES["q_knn_text_filter"]
