"""Queries over ``documents`` as a corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus
from ..operators.checks import rounded
from .views import frame, with_views

LEAST, MOST, SHARD_TOKENS = 24, 512, 50_000


def _corpus(spark, d):
    return frame(spark, d, "corpus")


def _light(spark, d):
    return _corpus(spark, d).drop("text")


# The oracle has the rule's ASCII white space only; the documents hold no other.
_NORMAL = """n AS (SELECT doc_id, lang, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    text, '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0b-\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '[ \\t\\x{A0}]+(\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') AS t FROM corpus)"""
_CUT = f"""cut AS (SELECT doc_id, lang, t, substr(t, 1, {4 * MOST}) AS c FROM n),
  ps AS (SELECT *, length(c) - strpos(reverse(c), chr(10)) AS nl, length(c) - strpos(reverse(c), ' ') AS sp FROM cut),
  drawn AS (SELECT *, CASE WHEN strpos(c, chr(10)) > 0 AND nl >= {int(4 * MOST * 0.85)} THEN substr(c, 1, nl)
      WHEN strpos(c, ' ') > 0 AND sp >= {int(4 * MOST * 0.85)} THEN substr(c, 1, sp) ELSE c END AS dr FROM ps),
  clean AS (SELECT doc_id, lang, t, CASE WHEN length(t) <= {4 * MOST} THEN t WHEN regexp_replace(dr, '\\s+$', '') = '' THEN dr ELSE regexp_replace(dr, '\\s+$', '') END AS clean FROM drawn),
  judged AS (SELECT *, greatest(1, CAST(ceil(length(clean) / 4.0::DOUBLE) AS BIGINT)) AS n_clean FROM clean),
  reasons AS (SELECT *, CASE WHEN regexp_matches(clean, '^\\s*$') THEN 'empty_after_normalise' WHEN n_clean < {LEAST} THEN 'too_short' WHEN n_clean > {MOST} THEN 'over_max_tokens' END AS reason FROM judged)"""


def reference_tokens(spark, d):
    return _corpus(spark, d).select("doc_id", T.reference_tokens(F.col("text")).alias("n_tokens"))


REFERENCE_SQL = "SELECT doc_id, greatest(1, CAST(ceil(length(text) / 4.0::DOUBLE) AS BIGINT)) AS n_tokens FROM documents"


def normalise_lines(spark, d):
    return _corpus(spark, d).select("doc_id", F.md5(T.normalise_lines(F.col("text"))).alias("digest"))


NORMALISE_SQL = with_views(f"WITH {_NORMAL} SELECT doc_id, md5(t) AS digest FROM n", "corpus")


def normalise_whitespace(spark, d):
    """With NFC, which no SQL engine here has; the documents are in NFC, so the oracle agrees."""
    return _corpus(spark, d).select("doc_id", F.md5(T.normalise_whitespace(F.col("text"))).alias("digest"))


def truncate_reference_tokens(spark, d):
    c = corpus.cleaned(_corpus(spark, d), LEAST, MOST, T.normalise_lines)
    return c.select("doc_id", "n_clean", "was_truncated", F.md5("clean").alias("digest"))


TRUNCATE_SQL = with_views(f"WITH {_NORMAL}, {_CUT} SELECT doc_id, n_clean, clean <> t AS was_truncated, md5(clean) AS digest FROM reasons", "corpus")


def length_bounds_reasons(spark, d):
    c = corpus.cleaned(_corpus(spark, d), LEAST, MOST, T.normalise_lines)
    return c.where("reason IS NOT NULL").select("doc_id", "reason")


REASONS_SQL = with_views(f"WITH {_NORMAL}, {_CUT} SELECT doc_id, reason FROM reasons WHERE reason IS NOT NULL", "corpus")


def drop_report(spark, d):
    return corpus.drop_report(corpus.cleaned(_corpus(spark, d), LEAST, MOST, T.normalise_lines))


REPORT_SQL = with_views(
    f"""WITH {_NORMAL}, {_CUT}
  SELECT s.reason, count(r.doc_id) AS n FROM (SELECT unnest(['empty_after_normalise', 'too_short', 'over_max_tokens', 'lang_mismatch', 'duplicate_exact', 'duplicate_near', 'parallel_row_incomplete', 'kept']) AS reason) s
  LEFT JOIN (SELECT doc_id, coalesce(reason, 'kept') AS reason FROM reasons) r ON r.reason = s.reason GROUP BY s.reason""",
    "corpus",
)


def script_fraction(spark, d):
    """Share of lower-case Latin letters, and whether the text would pass as Russian."""
    c = _corpus(spark, d)
    return c.select("doc_id", rounded(T.class_fraction(F.col("text"), "a-z")).alias("latin"), T.looks_like(F.col("text"), F.lit("ru")).alias("russian"), T.is_unspaced(F.col("text")).alias("unspaced"))


SCRIPT_SQL = r"""SELECT doc_id, round(length(regexp_replace(text, '[^a-z]', '', 'g')) / nullif(length(regexp_replace(text, '\s', '', 'g')), 0)::DOUBLE, 9) AS latin,
  length(regexp_replace(text, '[^\x{0400}-\x{052F}]', '', 'g')) >= 0.1 * length(regexp_replace(text, '\s', '', 'g')) AS russian,
  length(regexp_replace(text, '[^\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{0E00}-\x{0E7F}]', '', 'g')) >= 0.2 * length(regexp_replace(text, '\s', '', 'g')) AS unspaced
  FROM documents"""

_SKETCH = r"""w AS (SELECT doc_id, lower(text) AS low, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM corpus),
  q AS (SELECT doc_id, ws, trim(regexp_replace(low, '\s+', ' ', 'g')) AS sq FROM w),
  u AS (SELECT doc_id, CASE WHEN len(ws) < 5 AND length(sq) < 24 THEN [sq]
      WHEN len(ws) < 5 THEN list_transform(range(1, length(sq) - 10), lambda i: substr(sq, i, 12))
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END AS units FROM q),
  sk AS (SELECT doc_id, list_sort(list_transform(list_distinct(units), lambda x: md5(x)))[1:16] AS sketch FROM u),
  bs AS (SELECT doc_id, CASE WHEN len(sketch) >= 4 THEN list_transform(range(0, len(sketch) // 4), lambda b: concat(b, '|', array_to_string(sketch[b * 4 + 1:b * 4 + 4], ',')))
      ELSE [concat('0|', array_to_string(sketch, ','))] END AS bands FROM sk)"""


def shingle_signature(spark, d):
    return _corpus(spark, d).select("doc_id", F.array_join(T.signature(F.col("text")), ",").alias("sketch"))


SIGNATURE_SQL = with_views(f"WITH {_SKETCH} SELECT doc_id, array_to_string(sketch, ',') AS sketch FROM sk", "corpus")


def lsh_bands(spark, d):
    b = _corpus(spark, d).select("doc_id", F.explode(T.bands(T.signature(F.col("text")))).alias("band"))
    return b.groupBy("band").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc_id")).where("n > 1").select(F.md5("band").alias("band"), "n", "first_doc_id")


BANDS_SQL = with_views(
    f"WITH {_SKETCH} SELECT md5(band) AS band, count(*) AS n, min(doc_id) AS first_doc_id FROM (SELECT doc_id, unnest(bands) AS band FROM bs) GROUP BY band HAVING count(*) > 1",
    "corpus",
)


def exact_duplicates(spark, d):
    c = _corpus(spark, d).select("doc_id", F.md5("text").alias("digest"))
    g = c.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("kept_doc_id"))
    return g.where("n > 1")


EXACT_SQL = "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS kept_doc_id FROM documents GROUP BY text HAVING count(*) > 1"


def near_duplicates_first_kept(spark, d):
    return corpus.first_kept(_corpus(spark, d))


# The rule as it reads: documents in order, with the keys of those kept so far.
FIRST_KEPT_SQL = with_views(
    f"""WITH {_SKETCH},
  k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY c.doc_id) AS i, c.doc_id, md5(c.text) AS digest, bands FROM corpus c JOIN bs ON bs.doc_id = c.doc_id),
  walk AS (
    SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS VARCHAR) AS reason, CAST([] AS VARCHAR[]) AS digests, CAST([] AS VARCHAR[]) AS held
    UNION ALL
    SELECT i, doc_id, reason, CASE WHEN reason IS NULL THEN list_append(digests, digest) ELSE digests END, CASE WHEN reason IS NULL THEN list_concat(held, bands) ELSE held END FROM (
      SELECT k.i, k.doc_id, k.digest, k.bands, w.digests, w.held,
        CASE WHEN list_contains(w.digests, k.digest) THEN 'duplicate_exact' WHEN list_has_any(w.held, k.bands) THEN 'duplicate_near' END AS reason
      FROM walk w JOIN k ON k.i = w.i + 1))
  SELECT doc_id, reason FROM walk WHERE i > 0""",
    "corpus",
).replace("WITH corpus", "WITH RECURSIVE corpus", 1)


def budget_fill(spark, d):
    return corpus.budget_fill(_light(spark, d), 3000).select("source", "lang", "doc_id", "before")


BUDGET_SQL = with_views(
    """SELECT source, lang, doc_id, CAST(before AS BIGINT) AS before FROM (
    SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, lang ORDER BY md5('fetch|0|' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM corpus)
    WHERE before < 3000""",
    "corpus",
)


def parallel_row_alignment(spark, d):
    r = corpus.complete_rows(_light(spark, d), F.col("doc_id") % 211, ["de", "fr", "es"])
    return r.select("row", "doc_id", "lang")


PARALLEL_SQL = with_views(
    """SELECT doc_id % 211 AS row, doc_id, lang FROM corpus WHERE lang IN ('de', 'fr', 'es') AND doc_id % 211 IN (
    SELECT doc_id % 211 FROM corpus WHERE lang IN ('de', 'fr', 'es') GROUP BY 1 HAVING count(DISTINCT lang) = 3)""",
    "corpus",
)


def doc_split_assignment(spark, d):
    return corpus.assign_splits(_light(spark, d)).select("doc_id", "domain", "lang", "split")


_SPLITS = """st AS (SELECT domain, lang, count(*) AS n FROM corpus GROUP BY ALL),
  ex AS (SELECT *, n * 0.8::DOUBLE AS e0, n * 0.1::DOUBLE AS e1, n * 0.1::DOUBLE AS e2 FROM st),
  lg AS (SELECT domain, lang, n, s, f, row_number() OVER (PARTITION BY domain, lang ORDER BY e - f DESC, s) AS place, n - sum(f) OVER (PARTITION BY domain, lang) AS rest FROM (
      SELECT domain, lang, n, unnest([0, 1, 2]) AS s, unnest([e0, e1, e2]) AS e, floor(unnest([e0, e1, e2])) AS f FROM ex)),
  al AS (SELECT domain, lang, any_value(n) AS n, list(CAST(f + CASE WHEN place <= rest THEN 1 ELSE 0 END AS BIGINT) ORDER BY s) AS a FROM lg GROUP BY ALL),
  r0 AS (SELECT domain, lang, n, CASE WHEN n >= 3 AND a[1] = 0 AND list_max(a) > 1 THEN CASE WHEN a[2] >= a[3] THEN [a[1] + 1, a[2] - 1, a[3]] ELSE [a[1] + 1, a[2], a[3] - 1] END ELSE a END AS a FROM al),
  r1 AS (SELECT domain, lang, n, CASE WHEN n >= 3 AND a[2] = 0 AND list_max(a) > 1 THEN CASE WHEN a[1] >= a[3] THEN [a[1] - 1, a[2] + 1, a[3]] ELSE [a[1], a[2] + 1, a[3] - 1] END ELSE a END AS a FROM r0),
  r2 AS (SELECT domain, lang, n, CASE WHEN n >= 3 AND a[3] = 0 AND list_max(a) > 1 THEN CASE WHEN a[1] >= a[2] THEN [a[1] - 1, a[2], a[3] + 1] ELSE [a[1], a[2] - 1, a[3] + 1] END ELSE a END AS a FROM r1),
  sp AS (SELECT c.*, CASE WHEN rn <= a[1] THEN 'train' WHEN rn <= a[1] + a[2] THEN 'val' ELSE 'test' END AS split FROM (
      SELECT *, row_number() OVER (PARTITION BY domain, lang ORDER BY md5('split|0|' || doc_id), doc_id) AS rn FROM corpus) c JOIN r2 ON r2.domain = c.domain AND r2.lang = c.lang)"""
SPLIT_SQL = with_views(f"WITH {_SPLITS} SELECT doc_id, domain, lang, split FROM sp", "corpus")


def split_counts(spark, d):
    return corpus.split_counts(corpus.assign_splits(_light(spark, d)))


SPLIT_COUNTS_SQL = with_views(
    f"""WITH {_SPLITS} SELECT split, domain || '/' || lang AS stratum, count(*) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM sp GROUP BY ALL
  UNION ALL SELECT split, '' AS stratum, count(*), CAST(sum(n_tokens) AS BIGINT) FROM sp GROUP BY split""",
    "corpus",
)


def interleave_order(spark, d):
    return corpus.interleaved(_light(spark, d)).select("doc_id", "position", rounded(F.col("fraction")).alias("fraction"))


_ORDER = """fr AS (SELECT doc_id, domain, lang, n_tokens, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang ORDER BY md5('order|0|' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      / sum(n_tokens) OVER (PARTITION BY domain, lang)::DOUBLE AS fraction FROM corpus),
  po AS (SELECT *, row_number() OVER (ORDER BY fraction, domain, lang, doc_id) - 1 AS position FROM fr)"""
ORDER_SQL = with_views(f"WITH {_ORDER} SELECT doc_id, position, round(fraction, 9) AS fraction FROM po", "corpus")


def _sharded(spark, d):
    c = corpus.interleaved(_light(spark, d))
    shards = corpus.greedy_shards(c, SHARD_TOKENS).select("doc_id", "shard_id")
    return c.join(shards, "doc_id")


def greedy_shards(spark, d):
    return corpus.greedy_shards(corpus.interleaved(_light(spark, d)), SHARD_TOKENS)


_GREEDY = f"""{_ORDER},
  g AS (SELECT position, doc_id, n_tokens, CAST(CASE WHEN n_tokens >= {SHARD_TOKENS} THEN 1 ELSE 0 END AS BIGINT) AS next_shard, CAST(0 AS BIGINT) AS shard_id,
      CAST(CASE WHEN n_tokens >= {SHARD_TOKENS} THEN 0 ELSE n_tokens END AS BIGINT) AS used FROM po WHERE position = 0
    UNION ALL
    SELECT p.position, p.doc_id, p.n_tokens,
      g.next_shard + CASE WHEN g.used > 0 AND g.used + p.n_tokens > {SHARD_TOKENS} THEN 1 ELSE 0 END + CASE WHEN (CASE WHEN g.used > 0 AND g.used + p.n_tokens > {SHARD_TOKENS} THEN 0 ELSE g.used END) + p.n_tokens >= {SHARD_TOKENS} THEN 1 ELSE 0 END,
      g.next_shard + CASE WHEN g.used > 0 AND g.used + p.n_tokens > {SHARD_TOKENS} THEN 1 ELSE 0 END,
      CASE WHEN (CASE WHEN g.used > 0 AND g.used + p.n_tokens > {SHARD_TOKENS} THEN 0 ELSE g.used END) + p.n_tokens >= {SHARD_TOKENS} THEN 0
        ELSE (CASE WHEN g.used > 0 AND g.used + p.n_tokens > {SHARD_TOKENS} THEN 0 ELSE g.used END) + p.n_tokens END
    FROM g JOIN po p ON p.position = g.position + 1)"""


def _recursive(select: str) -> str:
    return with_views(f"WITH {_GREEDY} {select}", "corpus").replace("WITH ", "WITH RECURSIVE ", 1)


GREEDY_SQL = _recursive("SELECT doc_id, n_tokens, shard_id FROM g")


def shard_table(spark, d):
    t = corpus.shard_table(_sharded(spark, d))
    return t.select("shard_id", "n_docs", "n_tokens", F.explode("domains").alias("domain", "tokens"))


SHARD_TABLE_SQL = _recursive(
    """SELECT shard_id, n_docs, n_tokens, domain, tokens FROM (
    SELECT shard_id, domain, CAST(sum(g.n_tokens) AS BIGINT) AS tokens, CAST(sum(count(*)) OVER (PARTITION BY shard_id) AS BIGINT) AS n_docs, CAST(sum(sum(g.n_tokens)) OVER (PARTITION BY shard_id) AS BIGINT) AS n_tokens
    FROM g JOIN fr ON fr.doc_id = g.doc_id GROUP BY shard_id, domain)"""
)


def realized_shares(spark, d):
    r = corpus.realized_shares(_light(spark, d))
    return r.select("level", "key", "tokens", rounded(F.col("share")).alias("share"))


SHARES_SQL = with_views(
    """WITH t AS (SELECT sum(n_tokens) AS total FROM corpus),
  c AS (SELECT 'domain' AS level, domain AS key, sum(n_tokens) AS tokens FROM corpus GROUP BY domain
    UNION ALL SELECT 'stratum', domain || '/' || lang, sum(n_tokens) FROM corpus GROUP BY ALL UNION ALL SELECT 'total', '', sum(n_tokens) FROM corpus)
  SELECT level, key, CAST(tokens AS BIGINT) AS tokens, round(tokens / total::DOUBLE, 9) AS share FROM c CROSS JOIN t""",
    "corpus",
)


def byte_budget_ladder(spark, d):
    shards = _sharded(spark, d).groupBy("shard_id").agg(F.sum("n_tokens").alias("n_tokens"))
    return corpus.byte_ladder(spark, shards, n_experts=64, hidden_dim=2048, n_layers=16, top_k=8, subsample=50_000, cap=200_000_000)


LADDER_SQL = _recursive(
    """SELECT step, CAST(max(size) AS BIGINT) AS worst_bytes, count(*) FILTER (size > 200000000) AS over_cap, max(size) <= 200000000 AS within_cap,
    coalesce(step = min(CASE WHEN max(size) <= 200000000 THEN step END) OVER (), FALSE) AS recommended FROM (
    SELECT step, CASE WHEN stride > 0 THEN ceil(e / stride::DOUBLE) - ceil(s / stride::DOUBLE) ELSE 0 END * 65536 + CASE WHEN scores THEN n * 2048 ELSE 0 END + n * 512 AS size FROM (
      SELECT shard_id, n, sum(n) OVER (ORDER BY shard_id) - n AS s, sum(n) OVER (ORDER BY shard_id) AS e, sum(n) OVER () AS total FROM (SELECT shard_id, sum(n_tokens) AS n FROM g GROUP BY shard_id)) x,
      LATERAL (SELECT step, CASE WHEN hidden > 0 THEN greatest(1, total // hidden) ELSE 0 END AS stride, scores FROM (VALUES (0, 50000, TRUE), (1, 32000, TRUE), (2, 16000, TRUE), (3, 16000, FALSE), (4, 0, FALSE)) v(step, hidden, scores)) l)
  GROUP BY step"""
)

QUERIES = {
    "reference_tokens": reference_tokens, "normalise_lines": normalise_lines, "normalise_whitespace": normalise_whitespace, "truncate_reference_tokens": truncate_reference_tokens,
    "length_bounds_reasons": length_bounds_reasons, "drop_report": drop_report, "script_fraction": script_fraction, "shingle_signature": shingle_signature,
    "lsh_bands": lsh_bands, "exact_duplicates": exact_duplicates, "near_duplicates_first_kept": near_duplicates_first_kept, "budget_fill": budget_fill,
    "parallel_row_alignment": parallel_row_alignment, "doc_split_assignment": doc_split_assignment, "split_counts": split_counts, "interleave_order": interleave_order,
    "greedy_shards": greedy_shards, "shard_table": shard_table, "realized_shares": realized_shares, "byte_budget_ladder": byte_budget_ladder,
}
ORACLE_SQL = {
    "reference_tokens": REFERENCE_SQL, "normalise_lines": NORMALISE_SQL, "normalise_whitespace": NORMALISE_SQL, "truncate_reference_tokens": TRUNCATE_SQL,
    "length_bounds_reasons": REASONS_SQL, "drop_report": REPORT_SQL, "script_fraction": SCRIPT_SQL, "shingle_signature": SIGNATURE_SQL, "lsh_bands": BANDS_SQL,
    "exact_duplicates": EXACT_SQL, "near_duplicates_first_kept": FIRST_KEPT_SQL, "budget_fill": BUDGET_SQL, "parallel_row_alignment": PARALLEL_SQL, "doc_split_assignment": SPLIT_SQL, "split_counts": SPLIT_COUNTS_SQL,
    "interleave_order": ORDER_SQL, "greedy_shards": GREEDY_SQL, "shard_table": SHARD_TABLE_SQL, "realized_shares": SHARES_SQL, "byte_budget_ladder": LADDER_SQL,
}
