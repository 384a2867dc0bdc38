"""The corpus from its sources: cleaning, duplicates and budgets in visitation order.

Reading stops at a budget and what was never read must not count as seen, so units (a source's language)
are visited one after another and only the keys of delivered documents are carried forward. Within a unit
the work is set-based: nothing kept depends on a later document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .corpus import Source, cleaned, duplicate_keys, first_of_kind, order_key, token_targets
from .tables import dealt, kept, running

DRIFT = 0.02


def language_order(source: str, langs: Sequence[str], seed: int = 0) -> list[str]:
    """Languages in the order of a digest of (seed, source, language): adding one moves no other."""
    return sorted(langs, key=lambda x: (hashlib.md5(f"lang|{seed}|{source}|{x}".encode()).hexdigest(), x))


def _unseen(rows: DataFrame, index: DataFrame | None) -> DataFrame:
    """Adds ``hit``: the reason a row's keys give against the index of delivered documents."""
    if index is None:
        return rows.withColumn("hit", F.lit(None).cast("string"))
    found = rows.select("at", F.explode("keys").alias("key")).join(index, "key", "left_semi").groupBy("at").agg(F.max(F.col("key").startswith("=")).alias("exact"))
    return rows.join(found, "at", "left").withColumn("hit", F.when(F.col("exact"), "duplicate_exact").when(F.col("exact").isNotNull(), "duplicate_near")).drop("exact")


def assemble(docs: DataFrame, total: int, sources: Sequence[Source], langs: dict[str, Sequence[str]], least: int, most: int, seed: int = 0, normalise=T.normalise_whitespace) -> tuple[DataFrame, list[dict], list[str]]:
    """Delivered documents ``(doc_id, text, domain, lang, source, n_tokens)``, a report per unit with what
    was read, dropped by reason and delivered, and the problems found.

    ``docs(doc_id, text, lang, source)``; a control's documents also have ``row``, equal for the
    translations of one text, and a row is delivered whole or not at all. Parallel controls come first and
    what they lack goes to their domain's volume sources by weight.
    """
    budgets = token_targets(total, sources)
    # Cleaned and keyed once for all units, and dealt so that each unit reads its own rows.
    docs = docs if "row" in docs.columns else docs.withColumn("row", F.col("doc_id"))
    docs = dealt(cleaned(docs, least, most, normalise).withColumn("keys", duplicate_keys(F.col("clean"))).drop("text"), ["source", "lang"])
    delivered: list[DataFrame] = []
    reports, problems = [], []
    index: DataFrame | None = None
    got = dict.fromkeys(budgets, 0)

    def visit(source: Source, lang: str | None, budget: int, unit: DataFrame, languages: int) -> None:
        nonlocal index
        c = unit.withColumn("at", F.col("row") if source.control else F.col("doc_id"))
        fine = c.where("reason IS NULL")
        if source.control:
            whole = fine.groupBy("at").agg(F.countDistinct("lang").alias("n")).where(F.col("n") == languages).select("at")
            fine = fine.join(whole, "at", "left_semi")
        known = kept(_unseen(fine.groupBy("at").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"), F.sum("n_clean").alias("n")), index))
        fresh = first_of_kind(known.where("hit IS NULL").select("at", F.explode("keys").alias("key")))
        chosen = known.join(fresh.where("reason IS NULL").select("at"), "at", "left_semi").withColumn("_key", order_key("fetch", seed, "at")).withColumn("_all", F.lit(0))
        chosen = running(chosen, ["_all"], F.substring("_key", 1, 2), ["_key", "at"], F.col("n"), "before").where(F.col("before") < budget)
        chosen = kept(chosen.select("at", "keys"))
        out = kept(fine.join(chosen.select("at"), "at", "left_semi").select("doc_id", F.col("clean").alias("text"), F.lit(source.domain).alias("domain"), "lang", F.lit(source.name).alias("source"), F.col("n_clean").alias("n_tokens")))
        keys = chosen.select(F.explode("keys").alias("key"))
        index = keys if index is None else index.unionByName(keys)
        tokens = int(out.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0])
        got[source.name] += tokens
        dropped = {r["reason"]: r["n"] for r in c.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")).collect()}
        for r in known.where("hit IS NOT NULL").select(F.col("hit").alias("reason")).unionByName(fresh.where("reason IS NOT NULL").select("reason")).groupBy("reason").count().collect():
            dropped[r["reason"]] = dropped.get(r["reason"], 0) + r["count"]
        reports.append({"source": source.name, "lang": lang, "budget": budget, "n_records": c.count(), "n_docs": out.count(), "n_tokens": tokens, "dropped": dropped})
        delivered.append(out)

    for source in (s for s in sources if s.control):
        visit(source, None, budgets[source.name], docs.where(F.col("source") == source.name), len(langs[source.name]))
    for domain in {s.domain: None for s in sources}:
        short = sum(budgets[s.name] - got[s.name] for s in sources if s.domain == domain and s.control and got[s.name] < budgets[s.name])
        volume = [s for s in sources if s.domain == domain and not s.control]
        if short and not volume:
            problems.append(f"{domain} is {short} tokens short and has no volume source")
        handed = 0
        for i, s in enumerate(volume if short else []):
            take = short - handed if i == len(volume) - 1 else round(short * s.weight / sum(v.weight for v in volume))
            budgets[s.name] += take
            handed += take
    for source in (s for s in sources if not s.control):
        order = language_order(source.name, langs[source.name], seed)
        for i, lang in enumerate(order):
            left = budgets[source.name] * (i + 1) // len(order) - got[source.name]
            if left > 0:
                unit = docs.where((F.col("source") == source.name) & (F.col("lang") == lang))
                visit(source, lang, left, unit, 1)
        if got[source.name] < budgets[source.name]:
            problems.append(f"{source.name} ran dry at {got[source.name]} of {budgets[source.name]} tokens")
    out = delivered[0]
    for d in delivered[1:]:
        out = out.unionByName(d)
    whole = sum(got.values())
    for domain in {s.domain: None for s in sources}:
        share = sum(got[s.name] for s in sources if s.domain == domain) / whole if whole else 0.0
        wanted = sum(v for k, v in token_targets(total, sources).items() if any(s.name == k and s.domain == domain for s in sources)) / total
        if abs(share - wanted) > DRIFT:
            problems.append(f"{domain} has a share of {share:.3f}, planned {wanted:.3f}")
    return out, reports, problems
