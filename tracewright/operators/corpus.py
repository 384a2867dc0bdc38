"""Corpus assembly: cleaning with drop reasons, duplicates, budgets, splits, interleaving, shards.

Documents are ``doc_id, text, domain, lang, source, n_tokens``. Order never depends on how rows arrive:
it is the order of a digest of (purpose, seed, doc_id).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .checks import Refused, refuse_if_any
from .tables import kept, running

#: Domains and their shares, splits in order, drop reasons, the control's largest share.
SHARES = {"prose": 0.25, "code": 0.25, "math": 0.20, "multilingual": 0.30}
SPLITS = ("train", "val", "test")
REASONS = ("empty_after_normalise", "too_short", "over_max_tokens", "lang_mismatch", "duplicate_exact", "duplicate_near", "parallel_row_incomplete")
CONTROL_SHARE = 0.20
#: Steps down when a shard's capture would be too large: (hidden tokens, None for what was
#: asked, and whether scores are kept). Labels are kept on every step.
LADDER = ((None, True), (32_000, True), (16_000, True), (16_000, False), (0, False))


def order_key(purpose: str, seed: int = 0, doc: str = "doc_id") -> Column:
    """Digest that orders documents for a purpose."""
    return F.md5(F.concat(F.lit(f"{purpose}|{seed}|"), F.col(doc).cast("string")))


@dataclass(frozen=True)
class Source:
    """A source of a domain; ``control`` sources are parallel text and may not dominate."""

    name: str
    domain: str
    weight: float
    control: bool = False


def token_targets(total: int, sources: Sequence[Source], shares: dict[str, float] | None = None) -> dict[str, int]:
    """Token budget per source: a domain's share of the total, the largest domain taking what rounding
    leaves, split by weight within the domain, its last source taking the rest."""
    shares = SHARES if shares is None else shares
    for domain in shares:
        weights = [s.weight for s in sources if s.domain == domain]
        for s in sources:
            if s.domain == domain and s.control and s.weight / sum(weights) > CONTROL_SHARE + 1e-9:
                raise Refused(f"{s.name} is a control with {s.weight / sum(weights):.0%} of {domain}")
    budgets = {d: round(total * share) for d, share in shares.items() if share > 0}
    largest = max(budgets, key=budgets.get)
    budgets[largest] += total - sum(budgets.values())
    out: dict[str, int] = {}
    for domain, budget in budgets.items():
        own = [s for s in sources if s.domain == domain]
        for s in own[:-1]:
            out[s.name] = round(budget * s.weight / sum(x.weight for x in own))
        if own:
            out[own[-1].name] = budget - sum(out[s.name] for s in own[:-1])
    return out


def cleaned(docs: DataFrame, least: int, most: int, normalise=T.normalise_whitespace) -> DataFrame:
    """Adds ``clean``, ``n_clean``, ``was_truncated`` and ``reason`` (null: kept so far): normalise, cut
    to the cap, length bounds, script; the first rule that applies gives the reason."""
    c = docs.withColumn("_normal", normalise(F.col("text"))).withColumn("clean", T.truncated(F.col("_normal"), most))
    reason = F.coalesce(T.length_reason(F.col("clean"), least, most), F.when(~T.looks_like(F.col("clean"), F.col("lang")), "lang_mismatch"))
    return c.withColumns({"n_clean": T.reference_tokens(F.col("clean")), "was_truncated": F.col("clean") != F.col("_normal"), "reason": reason}).drop("_normal")


def drop_report(rows: DataFrame) -> DataFrame:
    """``reason, n`` for every reason, zero included, and ``kept``."""
    spark = rows.sparkSession
    spine = spark.createDataFrame([(r,) for r in (*REASONS, "kept")], "reason string")
    counts = rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    return spine.join(F.broadcast(counts), "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def duplicate_keys(text: Column) -> Column:
    """Keys under which a text can repeat an earlier one: its digest (``=...``) and its sketch's bands."""
    return F.concat(F.array(F.concat(F.lit("="), F.md5(text))), T.bands(T.signature(text)))


def first_kept(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """``order, reason`` of every document under the rule that the first of its kind is kept and a dropped
    document leaves no trace: ``duplicate_exact`` if a kept earlier document has the same digest,
    ``duplicate_near`` if one shares a band, null if the document is kept."""
    rows = docs.select(F.col(order).alias("at"), F.explode(duplicate_keys(F.col(text))).alias("key"))
    return first_of_kind(rows).withColumnRenamed("at", order)


#: Undecided rows that one task settles in order, where a chain keeps the rounds going.
FEW_ROWS = 1 << 18


def in_order(rows: DataFrame) -> DataFrame:
    """The rule of ``first_kept`` as it reads, over at most ``FEW_ROWS`` rows ``(at, key)`` in one task."""

    def run(batches):
        keys: dict = {}
        for batch in batches:
            if batch.isna().any(axis=None):
                raise RuntimeError("an undecided document has a null id or key")
            for at, key in zip(batch["at"].tolist(), batch["key"].tolist()):
                keys.setdefault(at, set()).add(key)
        held: set = set()
        out = []
        for at in sorted(keys):
            hit = keys[at] & held
            held |= set() if hit else keys[at]
            out.append((at, ("duplicate_exact" if any(k.startswith("=") for k in hit) else "duplicate_near") if hit else None))
        yield pd.DataFrame(out, columns=["at", "reason"])

    return rows.select("at", "key").coalesce(1).mapInPandas(run, f"at {dict(rows.dtypes)['at']}, reason string")


def first_of_kind(rows: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``at, reason`` from rows ``(at, key)`` under the rule of ``first_kept``.

    A fixpoint: what comes first among the undecided under all its keys is kept; what shares a key with
    something kept is dropped. Only minima per key are taken, never pairs, so a key that many documents
    share costs one row per document and round. Each round settles at least the least document, and the
    rounds go on until none is undecided. After ``most_rounds`` of them, which takes a chain of more than
    that many links, a rest of few rows is settled in order by one task.
    """
    rows = kept(rows)
    open_, done, rounds = rows, None, 0
    while not open_.isEmpty():
        if rounds >= most_rounds and open_.count() <= FEW_ROWS:
            rest = kept(in_order(open_))
            return rest if done is None else done.unionByName(rest)
        rounds += 1
        first = open_.groupBy("key").agg(F.min("at").alias("first"))
        state = open_.join(first, "key").groupBy("at").agg(F.bool_and(F.col("at") == F.col("first")).alias("leads"))
        leaders = kept(state.where("leads").select("at"))
        if leaders.isEmpty():
            raise RuntimeError("undecided documents are left that nothing leads: a null id or key")
        held = open_.join(leaders, "at", "left_semi").select("key").distinct()
        # Every key of a leader is led by it, so what else bears the key comes later and is dropped.
        rest = open_.join(leaders, "at", "left_anti")
        hit = rest.join(held, "key").groupBy("at").agg(F.max(F.col("key").startswith("=")).alias("exact"))
        hit = kept(hit.select("at", F.when(F.col("exact"), "duplicate_exact").otherwise("duplicate_near").alias("reason")))
        decided = leaders.select("at", F.lit(None).cast("string").alias("reason")).unionByName(hit)
        done = decided if done is None else done.unionByName(decided)
        open_ = kept(rest.join(hit, "at", "left_anti"))
    return rows.select("at", F.lit(None).cast("string").alias("reason")) if done is None else done


def budget_fill(docs: DataFrame, budget: int, keys: Sequence[str] = ("source", "lang"), tokens: str = "n_tokens") -> DataFrame:
    """Documents of each unit, in digest order, while what was delivered before is under the budget; the
    last may overshoot. Adds ``before``."""
    d = docs.withColumn("_key", order_key("fetch"))
    d = running(d, keys, F.substring("_key", 1, 2), ["_key", "doc_id"], F.col(tokens), "before")
    return d.where(F.col("before") < budget).drop("_key")


def complete_rows(docs: DataFrame, row: Column, languages: Sequence[str]) -> DataFrame:
    """Parallel rows that have every language once: all languages or none."""
    d = docs.withColumn("row", row).where(F.col("lang").isin(*languages))
    whole = d.groupBy("row").agg(F.countDistinct("lang").alias("n")).where(F.col("n") == len(languages)).select("row")
    return d.join(whole, "row", "left_semi")


def allocation(n: Column, ratios: Sequence[float]) -> list[Column]:
    """Documents per split: floors, then one more by largest remainder (earlier split first), then one
    from the largest to any split left empty, if there are as many documents as splits."""
    if len(ratios) != 3:
        raise ValueError("three splits are expected")
    exact = [n * F.lit(float(r)) for r in ratios]
    floors = [F.floor(x) for x in exact]
    rest = [x - f for x, f in zip(exact, floors)]
    left = n - (floors[0] + floors[1] + floors[2])
    ahead = lambda i: sum(F.when((rest[j] > rest[i]) | ((rest[j] == rest[i]) & F.lit(j < i)), 1).otherwise(0) for j in range(3) if j != i)
    a = [floors[i] + F.when(ahead(i) < left, 1).otherwise(0) for i in range(3)]
    return a


def _repaired(row: DataFrame) -> DataFrame:
    """One step per split: an empty split takes one from the largest, the earlier where equal."""
    for i in range(3):
        donor = F.when((F.col("a0") >= F.col("a1")) & (F.col("a0") >= F.col("a2")), 0).when(F.col("a1") >= F.col("a2"), 1).otherwise(2)
        row = row.withColumn("_donor", F.when((F.col(f"a{i}") == 0) & (F.col("n") >= 3) & (F.greatest("a0", "a1", "a2") > 1), donor))
        row = row.withColumns({f"a{j}": F.col(f"a{j}") - F.when(F.col("_donor") == j, 1).otherwise(0) + (F.when(F.col("_donor").isNotNull(), 1).otherwise(0) if j == i else F.lit(0)) for j in range(3)})
    return row.drop("_donor")


def assign_splits(docs: DataFrame, ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 0) -> DataFrame:
    """Adds ``split``: within each (domain, lang), documents in digest order fill train, val and test."""
    n = docs.groupBy("domain", "lang").agg(F.count("*").alias("n"))
    a = allocation(F.col("n"), ratios)
    sizes = _repaired(n.select("domain", "lang", "n", *[c.alias(f"a{i}") for i, c in enumerate(a)]))
    d = running(docs.withColumn("_key", order_key("split", seed)), ["domain", "lang"], F.substring("_key", 1, 2), ["_key", "doc_id"], F.lit(1), "_rank")
    d = d.join(F.broadcast(sizes.drop("n")), ["domain", "lang"])
    split = F.when(F.col("_rank") < F.col("a0"), SPLITS[0]).when(F.col("_rank") < F.col("a0") + F.col("a1"), SPLITS[1]).otherwise(SPLITS[2])
    return d.withColumn("split", split).drop("_key", "_rank", "a0", "a1", "a2")


def interleaved(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Adds ``fraction``, the share of its stratum's tokens delivered before the document, and
    ``position``. Emitting always from the stratum with the least delivered share is a merge of rising
    sequences, so it is the order by (fraction, domain, lang)."""
    d = docs.withColumn("_key", order_key("order", seed))
    total = docs.groupBy("domain", "lang").agg(F.sum("n_tokens").alias("_total"))
    d = running(d, ["domain", "lang"], F.substring("_key", 1, 2), ["_key", "doc_id"], F.col("n_tokens"), "_before").join(F.broadcast(total), ["domain", "lang"])
    d = d.withColumn("fraction", F.col("_before") / F.col("_total")).withColumn("_all", F.lit(0))
    # One row per thousandth of the order is what the outer sum runs over.
    d = running(d, ["_all"], F.floor(F.col("fraction") * 1000), ["fraction", "domain", "lang", "doc_id"], F.lit(1), "position")
    return d.drop("_key", "_before", "_total", "_all")


#: Shards' worth of tokens in a block of the greedy fill.
FILL = 256


def _fill(sizes: np.ndarray, cap: int, shard: int, used: int) -> np.ndarray:
    """Shard numbers of documents in order: each goes to the open shard unless that holds something and
    would pass ``cap``; a shard that reaches it is closed. ``used`` tokens of shard ``shard`` are taken."""
    start = np.concatenate([[0], np.cumsum(sizes)])
    out, i = np.empty(len(sizes), np.int64), 0
    while i < len(sizes):
        room = start[i] - used + cap
        # The first document, from the second of a new shard on, whose end passes the room or whose start fills it.
        stop = min(int(np.searchsorted(start[1:], room, side="right")), int(np.searchsorted(start[:-1], room, side="left")))
        stop = max(stop, i + (used == 0))
        out[i:stop] = shard
        i, shard, used = stop, shard + 1, 0
    return out


def _ways(sizes: np.ndarray, cap: int) -> tuple[int, int, list[int], list[int], list[int], int]:
    """How a block turns the tokens that are taken on entry into those taken on exit. Begun anew it opens
    ``more`` shards beyond the first and ends with ``used`` taken. Else the open shard is left at the first
    document whose least number, falling from one to the next, is at most the tokens taken: for each such
    document the least number, the shards opened after that one, and the tokens taken at the end."""
    start = np.concatenate([[0], np.cumsum(sizes)])
    n, total = len(sizes), int(start[-1])
    after = np.minimum(np.searchsorted(start[1:], start[:-1] + cap, side="right"), np.searchsorted(start[:-1], start[:-1] + cap, side="left"))
    after = np.maximum(after, np.arange(1, n + 1)).tolist()
    more, used = [0] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            more[i], used[i] = 1 + more[after[i]], used[after[i]]
        elif total - int(start[i]) >= cap:
            more[i] = 1
        else:
            used[i] = total - int(start[i])
    least = np.minimum(cap - start[1:] + 1, cap - start[:-1])
    reach = int(np.argmax(least <= 1)) + 1 if (least <= 1).any() else n
    return more[0], used[0], least[:reach].tolist(), more[:reach], used[:reach], total


def greedy_shards(ordered: DataFrame, shard_tokens: int, position: str = "position") -> DataFrame:
    """``doc_id, n_tokens, shard_id``: documents in order fill a shard until the next would pass its size;
    one that reaches it closes the shard; none is split.

    Where a shard begins depends on all before it, but a block of documents can be summed up without
    knowing that: on entry only the tokens taken from the open shard matter, and they only decide at which
    of the block's first few documents that shard is left. Blocks of FILL shards' worth of tokens are summed
    up side by side, one task walks through the sums, one row a block, and the blocks are then filled side
    by side. A block holds (position, id, size) of its documents.
    """
    if shard_tokens <= 0:
        raise Refused("shard_tokens must be positive")
    rows = ordered.select(F.col(position).alias("_at"), "doc_id", F.col("n_tokens").cast("long").alias("n_tokens")).withColumn("_all", F.lit(0))
    rows = running(rows, ["_all"], F.floor(F.col("_at") / 65536), ["_at"], F.col("n_tokens"), "_before")
    rows = kept(rows.withColumn("block", F.floor(F.col("_before") / (FILL * shard_tokens))).drop("_all", "_before"))

    def sum_up(block: pd.DataFrame) -> pd.DataFrame:
        sizes = block.sort_values("_at")["n_tokens"].to_numpy()
        return pd.DataFrame([(int(block["block"].iloc[0]), *_ways(sizes, shard_tokens))], columns=["block", "more", "used", "least", "mores", "useds", "total"])

    ways = rows.groupBy("block").applyInPandas(sum_up, "block long, more long, used long, least array<long>, mores array<long>, useds array<long>, total long")

    def walk(batches):
        shard = used = 0
        for batch in batches:
            out = []
            for row in batch.itertuples():
                out.append((row.block, shard, used))
                if not used:
                    shard, used = shard + row.more, row.used
                    continue
                left = next((k for k, least in enumerate(row.least) if used >= least), None)
                if left is not None:
                    shard, used = shard + 1 + int(row.mores[left]), int(row.useds[left])
                else:
                    used += row.total
                    if used >= shard_tokens:
                        shard, used = shard + 1, 0
            yield pd.DataFrame(out, columns=["block", "shard", "used"])

    entries = kept(kept(ways).repartitionByRange(1, "block").sortWithinPartitions("block").mapInPandas(walk, "block long, shard long, used long"))

    def fill(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_at")
        shard = _fill(block["n_tokens"].to_numpy(), shard_tokens, int(block["shard"].iloc[0]), int(block["used"].iloc[0]))
        return pd.DataFrame({"doc_id": block["doc_id"], "n_tokens": block["n_tokens"], "shard_id": shard})

    kind = dict(rows.dtypes)["doc_id"]
    return rows.join(entries, "block").groupBy("block").applyInPandas(fill, f"doc_id {kind}, n_tokens long, shard_id long")


def shard_table(docs: DataFrame) -> DataFrame:
    """``shard_id, n_docs, n_tokens, domains`` (tokens by domain); a document without shard is refused."""
    refuse_if_any(docs.where("shard_id IS NULL").select("doc_id"), "no shard")
    by = docs.groupBy("shard_id", "domain").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("domain", "tokens"))))
    return by.groupBy("shard_id").agg(F.sum("n").alias("n_docs"), F.sum("tokens").alias("n_tokens"), entries.alias("domains"))


def realized_shares(docs: DataFrame) -> DataFrame:
    """``level, key, tokens, share`` by domain, by stratum, and in total."""
    stratum = T.stratum(F.col("domain"), F.col("lang"))
    d = docs.withColumn("stratum", stratum)
    per = d.groupBy("domain", "stratum").agg(F.sum("n_tokens").alias("tokens"))
    cube = per.groupingSets([["domain"], ["stratum"], []], "domain", "stratum").agg(F.sum("tokens").alias("tokens"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "domain").otherwise("stratum")
    total = F.sum(F.when(F.col("g") == 3, F.col("tokens"))).over(Window.partitionBy())
    return cube.select(level.alias("level"), F.coalesce("domain", "stratum", F.lit("")).alias("key"), "tokens", (F.col("tokens") / total).alias("share"))


def split_counts(docs: DataFrame) -> DataFrame:
    """``split, stratum, n_docs, n_tokens``; the stratum is empty in the row of all."""
    d = docs.withColumn("stratum", T.stratum(F.col("domain"), F.col("lang")))
    c = d.groupingSets([["split", "stratum"], ["split"]], "split", "stratum").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return c.withColumn("stratum", F.coalesce("stratum", F.lit("")))


def byte_ladder(spark: SparkSession, shards: DataFrame, n_experts: int, hidden_dim: int, n_layers: int, top_k: int, subsample: int, cap: int) -> DataFrame:
    """``step, worst_bytes, over_cap, within_cap, recommended`` for each step of LADDER: bytes per
    shard from its token range, where every stride-th token carries hidden state; the first step within
    the cap is recommended."""
    total = int(shards.agg(F.sum("n_tokens")).first()[0] or 0)
    if not total:
        raise Refused("an empty corpus has no budget")
    steps = []
    for i, (wanted, scores) in enumerate(LADDER):
        hidden = subsample if wanted is None else min(subsample, wanted)
        steps.append((i, max(1, total // hidden) if hidden else 0, scores))
    ladder = spark.createDataFrame(steps, "step int, stride long, scores boolean")
    start = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = shards.select("shard_id", "n_tokens", start.alias("start")).withColumn("end", F.col("start") + F.col("n_tokens"))
    j = placed.join(F.broadcast(ladder), F.lit(True))
    below = lambda x: F.ceil(F.col(x).cast("double") / F.col("stride"))
    captured = F.when(F.col("stride") > 0, below("end") - below("start")).otherwise(0)
    size = captured * (n_layers * hidden_dim * 2) + F.when(F.col("scores"), F.col("n_tokens") * (n_layers * n_experts * 2)).otherwise(0) + F.col("n_tokens") * (n_layers * top_k * 4)
    worst = j.groupBy("step").agg(F.max(size).alias("worst_bytes"), F.count_if(size > cap).alias("over_cap"))
    worst = worst.withColumn("within_cap", F.col("over_cap") == 0)
    first = F.min(F.when(F.col("within_cap"), F.col("step"))).over(Window.partitionBy())
    return worst.withColumn("recommended", F.coalesce(F.col("step") == first, F.lit(False)))
