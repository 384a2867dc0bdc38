"""Checks of trace shards. Each gives counts; ``verdict`` turns findings into an outcome."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from .checks import FAILED, PASSED, refuse_if_any, require_unique
from .tables import running

#: Merge-invariant fields: shards that differ in one belong to different experiments.
INVARIANT = ("run_config_sha256", "logit_tensor_used", "gguf_sha256", "llama_cpp_commit", "quant", "n_experts", "checkpoint_status")


def split_gaps(tokens: DataFrame, splits: DataFrame) -> DataFrame:
    """``doc_id, n_tokens`` of documents without a split."""
    return tokens.join(splits.select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n_tokens"))


def contiguity(tokens: DataFrame) -> DataFrame:
    """One row: documents, tokens, and tokens whose position is not one past their predecessor's (0 at
    a document's start)."""
    before = F.lag("pos").over(Window.partitionBy("doc_id").orderBy("pos"))
    t = tokens.select("doc_id", "pos", before.alias("before"))
    return t.agg(F.countDistinct("doc_id").alias("n_documents"), F.count("*").alias("n_tokens"), F.count_if(F.col("pos") != F.coalesce(F.col("before") + 1, F.lit(0))).alias("out_of_step"))


#: Rows of the order that a window spans.
SPAN = 1 << 16


def ascending(rows: DataFrame, index: str, shard: Column, order: str | None = None) -> DataFrame:
    """``shard, n, not_ascending``: rows whose index is not above that of the row before, in the order
    of the number ``order`` (the index itself by default, which finds repeats).

    Rows are compared within ranges of SPAN places of the order, and the last row of a range with the
    first of the next by one row per range.
    """
    at = order or index
    r = rows.select(F.col(index).alias("index"), F.col(at).alias("at"), shard.alias("shard")).withColumn("part", F.floor(F.col("at") / SPAN))
    inside = r.withColumn("before", F.lag("index").over(Window.partitionBy("shard", "part").orderBy("at", "index")))
    ends = inside.groupBy("shard", "part").agg(F.count("*").alias("n"), F.count_if(F.col("index") <= F.col("before")).alias("off"), F.min(F.struct("at", "index")).alias("first"), F.max(F.struct("at", "index")).alias("last"))
    ends = ends.withColumn("before", F.lag("last.index").over(Window.partitionBy("shard").orderBy("part")))
    return ends.groupBy("shard").agg(F.sum("n").alias("n"), (F.sum("off") + F.count_if(F.col("first.index") <= F.col("before"))).alias("not_ascending"))


def on_stride(doc: Column, pos: Column, span: int, stride: int) -> Column:
    """Whether a token belongs to the hidden subsample; a stride of 0 takes none."""
    return F.lit(False) if stride == 0 else (doc * span + pos) % stride == 0


def stride_for(total: int, wanted: int) -> int:
    """Stride that takes about ``wanted`` of ``total`` tokens; 0 takes none."""
    return max(1, total // wanted) if wanted else 0


def stride(tokens: DataFrame, span: int, stride: int) -> DataFrame:
    """One row: tokens, how many the subsample takes, and positions that do not fit the index span."""
    return tokens.agg(F.count("*").alias("n_tokens"), F.count_if(on_stride(F.col("doc_id"), F.col("pos"), span, stride)).alias("n_captured"), F.count_if(F.col("pos") >= span).alias("outside_span"))


def labels(sets: DataFrame, n_experts: int, k: int) -> DataFrame:
    """``layer, n, out_of_range, repeated`` of selected sets."""
    bad = (F.array_min("experts") < 0) | (F.array_max("experts") >= n_experts)
    return sets.groupBy("layer").agg(F.count("*").alias("n"), F.count_if(bad).alias("out_of_range"), F.count_if(F.size(F.array_distinct("experts")) != k).alias("repeated"))


def alignment(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: positions of two traces, those that only one has, those with different tokens, and the
    first such position (null if none)."""
    x = a.select("doc_id", "pos", F.col("token_id").alias("a"))
    y = b.select("doc_id", "pos", F.col("token_id").alias("b"))
    j = x.join(y, ["doc_id", "pos"], "full_outer")
    off = ~F.col("a").eqNullSafe(F.col("b"))
    first = F.min(F.when(off, F.struct("doc_id", "pos")))
    out = j.agg(F.count("*").alias("n"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"), F.count_if(F.col("a") != F.col("b")).alias("different"), first.alias("f"))
    return out.select("n", "unmatched", "different", F.col("f.doc_id").alias("first_doc_id"), F.col("f.pos").alias("first_pos"))


def size_arithmetic(streams: DataFrame) -> DataFrame:
    """``*, fault`` of ``(stream, bytes, n_tokens, per_token, per_layer_row)``: null where bytes are
    tokens times stride; else a shortage of whole tokens, of layer rows, or a ragged end."""
    short = F.col("n_tokens") * F.col("per_token") - F.col("bytes")
    fault = F.when(short == 0, None).when(short % F.col("per_token") == 0, "whole tokens").when(short % F.col("per_layer_row") == 0, "layer rows").otherwise("ragged")
    return streams.withColumn("fault", fault)


def lockstep(counts: DataFrame) -> DataFrame:
    """``shard_id, fault`` of shards whose streams disagree: ``(shard_id, n_tokens, n_topk, n_logits,
    n_hidden, n_index, n_flagged)``."""
    same = (F.col("n_topk") == F.col("n_tokens")) & (F.col("n_logits") == F.col("n_tokens"))
    hidden = (F.col("n_hidden") == F.col("n_index")) & (F.col("n_flagged") == F.col("n_hidden")) & (F.col("n_hidden") <= F.col("n_tokens"))
    return counts.select("shard_id", F.when(~same, "token counts differ").when(~hidden, "captured counts differ").alias("fault")).where("fault IS NOT NULL")


def nonfinite(rows: DataFrame, scores: str = "scores", k: int = 1) -> DataFrame:
    """One row: score rows, rows with NaN or infinity, the first of them, the least margin."""
    bad = F.exists(scores, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.agg(F.count("*").alias("n"), F.count_if(bad).alias("nonfinite"), F.min(F.when(bad, F.col("token"))).alias("first_token"), F.min(F.when(~bad, arrays.margin(F.col(scores), k))).alias("least_margin"))


def argsort_agreement(rows: DataFrame, k: int, scores: str = "scores", truth: str = "truth") -> DataFrame:
    """One row: how often the k highest scores are the selected set, and how many of the other rows have
    tied scores at the boundary, which storage may have caused."""
    same = arrays.same_set(arrays.top_m(F.col(scores), k), F.col(truth))
    tied = arrays.margin(F.col(scores), k) == 0
    return rows.agg(F.count("*").alias("n"), F.count_if(same).alias("agree"), F.count_if(~same & tied).alias("tied"), F.count_if(~same & ~tied).alias("unexplained"))


def conflicts(manifests: DataFrame, keys: Sequence[str] = INVARIANT) -> DataFrame:
    """``field, n_values`` of merge-invariant fields with more than one value over the shards; a missing
    value counts as one."""
    each = [F.struct(F.lit(k).alias("field"), F.countDistinct(F.coalesce(F.col(k).cast("string"), F.lit("<missing>"))).alias("n_values")) for k in keys]
    return manifests.agg(F.array(*each).alias("x")).select(F.explode("x").alias("x")).select("x.field", "x.n_values").where("n_values > 1")


#: Names of the index scheme and of the layouts that a capture records.
INDEX_SCHEME, LAYOUT_MIXED, LAYOUT_NONE = "doc_id * n_ctx + pos_in_doc", "mixed", "none"
#: Fields on which a capture's statistics and its manifest must agree.
SHAPE = ("n_tokens", "n_moe_layers", "n_experts", "top_k", "hidden_dim")


def capture_stats(manifests: DataFrame, stats: DataFrame) -> DataFrame:
    """``shard_id, check, severity, message`` for what the capture's own statistics say against a shard.

    ``manifests(shard_id, n_tokens, n_moe_layers, n_experts, top_k, hidden_dim, n_captured)`` and
    ``stats`` with these, ``exit_code, topk_layout, n_docs_truncated, n_tokens_dropped,
    first_truncated_doc, nodes_captured``; a shard without statistics gets a warning, as truncation then
    can't be ruled out. Truncation and disagreement are errors, a capture that never met a layout or
    whose nodes are no multiple of three per layer a warning.
    """
    s = stats.select("shard_id", F.struct(*[F.col(c) for c in stats.columns if c != "shard_id"]).alias("s"))
    j = manifests.join(s, "shard_id", "left")
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nothing"))
    finding = lambda when, severity, *parts: F.when(when, F.struct(F.lit(severity).alias("severity"), F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]).alias("message")))
    there = F.col("s").isNotNull()
    differs = lambda c: there & ~F.col(f"s.{c}").eqNullSafe(F.col(c))
    truncated = there & ((F.coalesce("s.n_docs_truncated", F.lit(0)) > 0) | (F.coalesce("s.n_tokens_dropped", F.lit(0)) > 0))
    layout = F.coalesce("s.topk_layout", F.lit(LAYOUT_NONE))
    found = [
        finding(~there, "warning", "no statistics: truncation can not be ruled out"),
        finding(there & (F.coalesce("s.exit_code", F.lit(0)) != 0), "error", "the capture ended with ", say("s.exit_code")),
        finding(truncated, "error", say("s.n_docs_truncated"), " documents cut, ", say("s.n_tokens_dropped"), " tokens lost, the first in document ", say("s.first_truncated_doc")),
        finding(there & (layout == LAYOUT_MIXED), "error", "selections were read in two layouts"),
        finding(there & (layout == LAYOUT_NONE), "warning", "no layout of the selections is recorded"),
        finding(there & (F.coalesce("s.nodes_captured", F.lit(0)) % (3 * F.col("n_moe_layers")) != 0), "warning", say("s.nodes_captured"), " nodes are no multiple of three per layer"),
        *[finding(differs(c), "error", f"{c} is ", say(f"s.{c}"), ", the manifest has ", say(c)) for c in (*SHAPE, "n_captured")],
    ]
    rows = j.select("shard_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f"))
    return rows.select("shard_id", F.lit("capture_stats").alias("check"), "f.severity", "f.message")


def hidden_rows(tokens: DataFrame, index: DataFrame, span: int, step: int) -> DataFrame:
    """``kind, n, first_index`` of each way in which the hidden index departs, row by row, from the tokens:
    ``missing`` and ``extra`` rows against the stride, ``unflagged`` and ``flagged`` tokens whose mark
    says otherwise, ``outside`` positions past the span, ``repeated`` index values.

    ``tokens(doc_id, pos, captured)`` and ``index(value)``, where a value is doc_id * span + pos."""
    t = tokens.select((F.col("doc_id") * span + F.col("pos")).alias("value"), F.coalesce("captured", F.lit(False)).alias("marked"), on_stride(F.col("doc_id"), F.col("pos"), span, step).alias("due"), (F.col("pos") >= span).alias("past"))
    h = index.groupBy("value").agg(F.count("*").alias("times"))
    j = t.join(h, "value", "full_outer")
    has, due, marked = F.col("times").isNotNull(), F.coalesce("due", F.lit(False)), F.coalesce("marked", F.lit(False))
    kinds = {"missing": due & ~has, "extra": ~due & has, "unflagged": due & ~marked, "flagged": ~due & marked, "outside": F.coalesce("past", F.lit(False)), "repeated": F.coalesce("times", F.lit(0)) > 1}
    each = [F.struct(F.lit(k).alias("kind"), F.count_if(c).alias("n"), F.min(F.when(c, F.col("value"))).alias("first_index")) for k, c in kinds.items()]
    return j.agg(F.array(*each).alias("x")).select(F.explode("x").alias("x")).select("x.kind", "x.n", "x.first_index").where("n > 0")


def captured(rows: DataFrame, hidden: DataFrame, keys: Sequence[str] = ("doc_id", "pos")) -> DataFrame:
    """The rows whose hidden vector was captured."""
    return rows.join(hidden.select(*keys).distinct(), list(keys), "left_semi")


def with_hidden(rows: DataFrame, hidden: DataFrame, keys: Sequence[str] = ("doc_id", "pos", "layer"), column: str = "hidden") -> DataFrame:
    """The rows with their hidden vector; a row without one, or a key that ``hidden`` repeats, is refused."""
    require_unique(hidden, *keys)
    refuse_if_any(rows.join(hidden.select(*keys), list(keys), "left_anti"), "no hidden vector")
    return rows.join(hidden.select(*keys, column), list(keys))


def first_tokens(tokens: DataFrame, most: int, row: str = "row_id", keys: Sequence[str] = ("shard_id",)) -> DataFrame:
    """The first ``most`` tokens in the order of (``keys``, ``row``): those whose number of tokens before
    them is less, counted by running sums over ranges of rows."""
    ranked = running(tokens.withColumn("_all", F.lit(0)), ["_all"], F.struct(*keys, F.floor(F.col(row) / SPAN).alias("lead")), [*keys, row], F.lit(1), "_before")
    return ranked.where(F.col("_before") < most).drop("_all", "_before")


def verdict(findings: DataFrame) -> int:
    """PASSED unless a finding ``(check, severity, message)`` has the severity ``error``."""
    return FAILED if findings.where("severity = 'error'").take(1) else PASSED
