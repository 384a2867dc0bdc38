"""Queries on shard plans, ledgers, half precision and assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..functions import text as T
from ..operators import assembly, corpus, ledger
from ..operators.checks import rounded
from . import corpus_queries as C
from .views import N_SCORES, SCORE_K, frame, with_views


def shard_offsets(spark, d):
    return ledger.plan_shards(C._sharded(spark, d))


OFFSETS_SQL = C._recursive(
    """SELECT shard_id, n_docs, n_tokens, CAST(sum(n_tokens) OVER (ORDER BY shard_id) - n_tokens AS BIGINT) AS token_offset
  FROM (SELECT shard_id, count(*) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM g GROUP BY shard_id)"""
)


def pending_shards(spark, d):
    planned = frame(spark, d, "orders").select((F.col("o_custkey") % 500).alias("shard_id")).distinct()
    done = frame(spark, d, "customer").select(F.col("c_custkey").alias("shard_id"), F.when(F.col("c_nationkey") % 2 == 0, "done").otherwise("failed").alias("status"))
    return ledger.pending(planned, done)


PENDING_SQL = """SELECT DISTINCT o_custkey % 500 AS shard_id FROM orders WHERE o_custkey % 500 NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey % 2 = 0)"""


def pending_cells(spark, d):
    return ledger.pending_cells(frame(spark, d, "panel"), ("F0", "F1", "F2", "F3", "F4"), frame(spark, d, "cells"))


PENDING_CELLS_SQL = with_views(
    """SELECT p.model, CAST(l.layer AS INT) AS layer, f.feature FROM panel p JOIN (SELECT unnest(range(6)) AS layer) l ON l.layer < p.n_moe_layers
  CROSS JOIN (SELECT unnest(['F0', 'F1', 'F2', 'F3', 'F4']) AS feature) f
  WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.model = p.model AND c.layer = l.layer AND c.feature = f.feature)""",
    "panel", "cells",
)


def sample_across(spark, d):
    t = frame(spark, d, "tokens")
    return ledger.sample_across(t.select((F.col("doc_id") * 64 + F.col("pos")).alias("index"), "token_id"), "index", 60_000, 500)


SAMPLE_SQL = with_views("SELECT doc_id * 64 + pos AS index, token_id FROM tokens WHERE (doc_id * 64 + pos) % 120 = 0", "tokens")


def language_order(spark, d):
    return ledger.next_language(frame(spark, d, "documents"))


LANGUAGE_SQL = """SELECT source, lang, CAST(row_number() OVER (PARTITION BY source ORDER BY md5('lang|0|' || source || '|' || lang), lang) - 1 AS INT) AS place
  FROM (SELECT DISTINCT source, lang FROM documents)"""


def half_precision_ties(spark, d):
    """Rows in which storing scores in half precision makes ties."""
    e = frame(spark, d, "embeddings").select("label", ledger.half(F.col("embedding")).alias("stored"))
    tied = F.avg((~arrays.distinct(F.col("stored"))).cast("double"))
    return e.groupBy("label").agg(F.count("*").alias("n"), rounded(tied).alias("tied"))


def router_recheck(spark, d):
    """Selections recomputed from vectors and router rows; the router is the identity, so scores are the
    vector itself and only what half precision ties may differ."""
    e = frame(spark, d, "embeddings").withColumn("layer", F.lit(0))
    weights = spark.range(N_SCORES).select(F.lit(0).alias("layer"), F.col("id").cast("int").alias("expert"), F.transform(F.sequence(F.lit(0), F.lit(N_SCORES - 1)), lambda i: (i == F.col("id")).cast("double")).alias("weight"))
    selected = e.select(F.col("vec_id").alias("token"), "layer", arrays.top_m(ledger.half(F.col("embedding")), SCORE_K).alias("experts"))
    return ledger.recheck_router(e.select(F.col("vec_id").alias("token"), "layer", F.col("embedding").alias("hidden")), weights, selected, SCORE_K)


def corpus_assembly(spark, d):
    """Documents delivered from four volume sources and one control, by source and language. Every document
    belongs to one of the five by its id, with the languages that there are."""
    names = ("math", "prose", "code", "volume", "parallel")
    name = F.element_at(F.array(*map(F.lit, names)), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    docs = frame(spark, d, "documents").select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"), name.alias("source"))
    # Rows of the control are translations of one text: here four documents that follow one another.
    docs = docs.withColumn("row", F.when(F.col("source") == "parallel", F.floor(F.col("doc_id") / 200)).otherwise(F.col("doc_id")))
    found = sorted(r["lang"] for r in docs.select("lang").distinct().collect())
    sources = [corpus.Source(n, n, 1) for n in names[:3]] + [corpus.Source("volume", "multilingual", 4), corpus.Source("parallel", "multilingual", 1, control=True)]
    total = max(1, int(docs.agg(F.sum(T.reference_tokens(F.col("text")))).first()[0] or 0) // 2)
    out, _, _ = assembly.assemble(docs, total, sources, {n: found for n in names}, 24, 512, normalise=T.normalise_lines)
    return out.groupBy("domain", "source", "lang").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


QUERIES = {
    "shard_offsets": shard_offsets, "pending_shards": pending_shards, "pending_cells": pending_cells, "sample_across": sample_across, "language_order": language_order,
    "half_precision_ties": half_precision_ties, "router_recheck": router_recheck, "corpus_assembly": corpus_assembly,
}
ORACLE_SQL = {
    "shard_offsets": OFFSETS_SQL, "pending_shards": PENDING_SQL, "pending_cells": PENDING_CELLS_SQL, "sample_across": SAMPLE_SQL, "language_order": LANGUAGE_SQL,
}
