"""The queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import chat, embedding_dedup, exact_dedup, hard_negatives, html_extract, importance, language_id, line_dedup, mixing, near_dedup, packing, quality, sharding


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave_shards(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = quality.judge(_table(spark, sf_dir, "documents"))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_of(_table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.planted_conversation(spark))
    return chat.chat_digests(chat.render(chat.fold_events(chat.events_of(rows))))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.drop_shared_lines(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("id") % 50 == 0)


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.importance_draw(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mix_sources, op2_extract_html, op3_shard, op4_quality, op5_pack, op6_language, op7_near_dedup, op8_chat, op9_line_dedup, op10_exact_dedup, op11_hard_negatives, op12_embedding_dedup, op13_importance)}

ORACLES: dict[str, str] = {
    "op11_hard_negatives": r"""
        WITH e AS (
          SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
          FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT a.id AS anchor, b.id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
          FROM e a JOIN e b ON a.id % 50 = 0 AND a.id <> b.id),
        p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
        n AS (
          SELECT p.anchor, p.id AS positive, p.score AS ps, s.id AS negative, s.score AS ns, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS r
          FROM p JOIN s ON s.anchor = p.anchor AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
        SELECT anchor AS anchor_id, positive AS positive_id, r::INTEGER AS rank, negative AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 3""",
    "op12_embedding_dedup": r"""
        WITH RECURSIVE e AS (
          SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (
          SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.label = b.label AND a.id <> b.id
            AND list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.93),
        reach AS (SELECT vec_id AS id, vec_id AS other FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN l ON l.a = r.other),
        c AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
        d AS (SELECT a AS id, count(*) AS n FROM l GROUP BY a)
        SELECT c.id AS vec_id, coalesce(d.n, 0) AS n_links, component_id, c.id = component_id AS kept FROM c LEFT JOIN d ON d.id = c.id""",
    "op13_importance": r"""
        WITH RECURSIVE bits AS (
          SELECT range AS i, range::BIGINT AS v, 0 AS k FROM range(256)
          UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
        tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
        w AS (
          SELECT doc_id AS id, true AS raw, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
          UNION ALL
          SELECT item_id, false, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
        f AS (
          SELECT id, raw, unnest(ws) AS g FROM w
          UNION ALL SELECT id, raw, unnest(list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1])) FROM w),
        h AS (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM f)),
        y AS (SELECT g, list_transform(range(0, len(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::BIGINT) AS bytes FROM h),
        b AS (SELECT g, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, d: xor(c >> 8, t[(xor(c, d) & 255) + 1])), 4294967295) % 10000 AS bucket FROM y, tab),
        fb AS (SELECT id, raw, bucket FROM f JOIN b ON f.g = b.g),
        n AS (SELECT bucket, count(*) FILTER (raw) AS s, count(*) FILTER (NOT raw) AS t FROM fb GROUP BY bucket),
        a AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM n),
        gain AS (SELECT bucket, floor(1000 * ln(((n.t + 1)::DOUBLE * (a.s + 10000)::DOUBLE) / ((n.s + 1)::DOUBLE * (a.t + 10000)::DOUBLE)))::BIGINT AS g FROM n, a),
        d AS (SELECT id, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM fb JOIN gain USING (bucket) WHERE raw GROUP BY id),
        q AS (
          SELECT w.id AS doc_id, len(ws) AS n, greatest(2 * len(ws) - 1, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
          FROM w LEFT JOIN d ON d.id = w.id WHERE raw),
        r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM q WHERE n >= 20),
        m AS (SELECT count(*) * 25 // 100 AS most FROM q WHERE n >= 20)
        SELECT q.doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= most THEN rank END AS rank FROM q CROSS JOIN m LEFT JOIN r ON r.doc_id = q.doc_id""",
    "op10_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g ON n.t = g.t""",
    "op9_line_dedup": r"""
        WITH l AS (
          SELECT doc_id, u.i, u.line, translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
               LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS i) u),
        k AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        m AS (SELECT l.*, k.keeper IS NULL OR k.keeper = l.doc_id AS stays FROM l LEFT JOIN k ON l.key = k.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
          sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op8_chat": r"""
        WITH c AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        e AS (SELECT *, length(role) + length(text) + 22 + length(regexp_replace(role || text, '[^\\<\[]', '', 'g')) AS n FROM c)
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
          sum(n)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
}
