"""Relations that the queries run on, derived from the driver's tables by SQL that Spark and DuckDB
both read. Each view has the SQL text once; ``frame`` gives it as a DataFrame and ``with_views``
puts it before an oracle's SELECT.

The derived trace has 16 experts, 4 selected, 4 layers: layer 0 and 1 route by token and document
(layer 1 copies layer 0), layer 2 by token and position, layer 3 by document alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

N_EXPERTS, TOP_K, N_LAYERS = 16, 4, 4
N_SCORES, SCORE_K = 64, 8

#: name -> (tables it reads, views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], tuple[str, ...], str]] = {
    # A line's place in its order; (l_orderkey, l_linenumber) repeats, so the order is by all columns.
    "tokens": (
        ("lineitem",),
        (),
        """SELECT l_orderkey AS doc_id,
             CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
               l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS INT) AS pos,
             l_partkey % 40 AS token_id
           FROM lineitem""",
    ),
    "doc_splits": (
        ("orders",),
        (),
        """SELECT o_orderkey AS doc_id,
             CASE WHEN substring(md5(concat('split|0|', CAST(o_orderkey AS STRING))), 1, 1) < '8' THEN 'train'
                  WHEN substring(md5(concat('split|0|', CAST(o_orderkey AS STRING))), 1, 1) < 'c' THEN 'val'
                  ELSE 'test' END AS split
           FROM orders""",
    ),
    "routed": (
        (),
        ("tokens",),
        """SELECT t.doc_id, t.pos, t.token_id, l.layer,
             CASE l.layer WHEN 2 THEN t.token_id % 5 + t.pos % 3 WHEN 3 THEN t.doc_id % 16 ELSE t.token_id % 5 + t.doc_id % 7 END AS base
           FROM tokens t CROSS JOIN (SELECT 0 AS layer UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) l""",
    ),
    "slots": (
        (),
        ("routed",),
        """SELECT r.doc_id, r.pos, r.token_id, r.layer, CAST((r.base + 5 * s.slot) % 16 AS INT) AS expert
           FROM routed r CROSS JOIN (SELECT 0 AS slot UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) s""",
    ),
    "event_tokens": (
        ("events",),
        (),
        """SELECT user_id AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS pos, event_type AS token
           FROM events""",
    ),
    # Result documents as cells: three models of different depth, five features, holes of each kind.
    "panel": (
        (),
        (),
        """SELECT model, n_moe_layers, n_experts, top_k, reached, aux_loss FROM (VALUES
             ('alpha', 4, 64, 8, 4, CAST(0.01 AS DOUBLE)), ('beta', 6, 32, 4, 5, CAST(NULL AS DOUBLE)), ('gamma', 1, 16, 4, 1, CAST(0.02 AS DOUBLE)))
             AS t(model, n_moe_layers, n_experts, top_k, reached, aux_loss)""",
    ),
    "cells": (
        (),
        ("panel",),
        """SELECT p.model, f.feature, l.layer, l.layer + 1 AS model_layer, CASE WHEN f.feature = 'F2' AND l.layer = 0 THEN 'skipped' ELSE 'ok' END AS status,
             CAST(round(p.n_experts * 0.05 + 1.5, 3) AS DOUBLE) AS entropy_bits,
             CAST(f.gain * (1 + l.layer * (3 - l.layer) * 0.05) - (l.layer % 3) * 0.015 AS DOUBLE) AS mi_bits,
             CAST(f.gain / 2 + 0.01 * l.layer AS DOUBLE) AS agreement,
             CAST(0.2 + 0.02 * l.layer + p.top_k * 0.01 AS DOUBLE) AS repetition
           FROM panel p CROSS JOIN (SELECT feature, CAST(gain AS DOUBLE) AS gain FROM (VALUES ('F0', 0.01), ('F1', 0.4), ('F2', 0.6), ('F3', 0.2), ('F4', 0.9)) AS t(feature, gain)) f
             CROSS JOIN (SELECT layer FROM (VALUES (0), (1), (2), (3), (4), (5)) AS t(layer)) l
           WHERE l.layer < p.reached AND NOT (p.model = 'gamma' AND f.feature = 'F4')""",
    ),
    # One row per document of the corpus; short texts and languages make the strata.
    "corpus": (
        ("documents",),
        (),
        """SELECT doc_id, text, lang, source,
             CASE WHEN lang <> 'en' THEN 'multilingual' WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4') THEN 'code'
                  WHEN source IN ('src5', 'src6', 'src7', 'src8') THEN 'math' ELSE 'prose' END AS domain,
             greatest(1, CAST(ceil(length(text) / CAST(4 AS DOUBLE)) AS BIGINT)) AS n_tokens
           FROM documents""",
    ),
}


def frame(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A table of the driver or a view, as a DataFrame; ``given`` are those that are at hand, by name."""
    if given and name in given:
        return given[name]
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables, views, sql = VIEWS[name]
    return spark.sql(_bound(sql, (*tables, *views)), **{n: frame(spark, sf_dir, n, given) for n in (*tables, *views)})


def _bound(sql: str, names: tuple[str, ...]) -> str:
    """Table names as parameters, so that no temporary view is registered in the caller's session."""
    for n in names:
        sql = sql.replace(f"FROM {n} ", f"FROM {{{n}}} ").replace(f"FROM {n}\n", f"FROM {{{n}}}\n")
        sql = sql[: -len(n)] + f"{{{n}}}" if sql.endswith(f"FROM {n}") else sql
    return sql


def with_views(select: str, *names: str) -> str:
    """``select`` for DuckDB with the named views, and those they read, defined before it."""
    order: list[str] = []

    def visit(n: str) -> None:
        for m in VIEWS[n][1]:
            visit(m)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    defined = "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][2]})" for n in order)
    return f"{defined},\n{select[5:]}" if select.startswith("WITH ") else f"{defined}\n{select}"
