"""The queries of this subpackage. Each applies one operator with its production parameters to a
whole table; the operator has the general interface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chunks, hilbert, id_files, langid, near_dup, packing, projection, top_k, toxicity, warc
from .shared import work_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_elias_fano_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = id_files.write_ids(_table(spark, sf_dir, "documents"), work_dir(spark), chunks.default_vocabulary(), end_id=2)
    return id_files.read_ids(manifest)


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hilbert.assign(_table(spark, sf_dir, "documents"), work_dir(spark), ["lang", "source", "n_chars"], shards=8, id_column="doc_id", text_column="text")
    return found.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("place").alias("curve_place"))


def op3_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), work_dir(spark))


def op4_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.components(_table(spark, sf_dir, "embeddings"), work_dir(spark))


def op5_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), toxicity.learnable())
    return toxicity.score(docs, model).select("doc_id", (~toxicity.learnable()).alias("held_out"), "score", "predicted")


def op6_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), chunks.default_vocabulary())


def op7_naive_bayes_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(langid.learnable()))
    return langid.identify(docs, model).select("doc_id", (~langid.learnable()).alias("held_out"), "lang_pred", "score")


def op8_setsketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), work_dir(spark))


def op9_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), work_dir(spark), chunks.default_vocabulary(), end_id=1)


def op10_kd_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return top_k.top_k(vectors, vectors.where("vec_id % 50 = 0"), work_dir(spark), k=5)


QUERIES = {
    "op1_elias_fano_ids": op1_elias_fano_ids,
    "op2_hilbert_shards": op2_hilbert_shards,
    "op3_warc_chunks": op3_warc_chunks,
    "op4_sorted_projections": op4_sorted_projections,
    "op5_nnpu_toxicity": op5_nnpu_toxicity,
    "op6_rank_array_bpe": op6_rank_array_bpe,
    "op7_naive_bayes_langid": op7_naive_bayes_langid,
    "op8_setsketch_near_duplicates": op8_setsketch_near_duplicates,
    "op9_power_of_two_packing": op9_power_of_two_packing,
    "op10_kd_tree_top_k": op10_kd_tree_top_k,
}

ORACLE_SQL: dict[str, str] = {
    "op4_sorted_projections": """
        WITH RECURSIVE v AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
        ), good AS (
            SELECT r, vec_id, e FROM v
            WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0
        ), links AS (
            SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
        ), reach AS (
            SELECT r, r AS t FROM v UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.t
        ), least AS (
            SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.t GROUP BY reach.r
        ), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT v.vec_id, coalesce(n.n, 0) AS n_links, component_id, v.vec_id IS NOT DISTINCT FROM component_id AS kept
        FROM v JOIN least ON least.r = v.r LEFT JOIN n ON n.a = v.r""",
    "op8_setsketch_near_duplicates": r"""
        WITH RECURSIVE w AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), sh AS (
            SELECT r, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w
        ), u AS (
            SELECT r, len(s) AS n, unnest(s) AS x FROM sh
        ), pairs AS (
            SELECT a.r AS a, b.r AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r
        ), half AS (
            SELECT a, b FROM pairs WHERE 100 * shared >= 75 * (na + nb - shared)
        ), links AS (
            SELECT a, b FROM half UNION ALL SELECT b, a FROM half
        ), reach AS (
            SELECT r, r AS t FROM w UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.t
        ), least AS (
            SELECT reach.r, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.t GROUP BY reach.r
        )
        SELECT w.doc_id, CAST(len(sh.s) AS BIGINT) AS n_shingles, component_id, w.doc_id IS NOT DISTINCT FROM component_id AS kept
        FROM w JOIN sh ON sh.r = w.r JOIN least ON least.r = w.r""",
    "op10_kd_tree_top_k": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score,
                   row_number() OVER (PARTITION BY q.r ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS rank
            FROM v q JOIN v c ON c.r <> q.r AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM s WHERE rank <= 5""",
    "op3_warc_chunks": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), f AS (
            SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first
            FROM p
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM f""",
}
