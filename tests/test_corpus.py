import hashlib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tracewright.functions import text as T
from tracewright.operators import corpus
from tracewright.operators.checks import Refused


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def documents(spark, n=240, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["prose", "code", "math"]), rng.choice(["en", "de", ""]), rng.randrange(1, 900)) for i in rng.sample(range(1000), n)]
    return rows, spark.createDataFrame(rows, "doc_id long, domain string, lang string, n_tokens long")


def test_splits_against_a_plain_rule(spark):
    rows, frame = documents(spark)
    found = {r.doc_id: r.split for r in corpus.assign_splits(frame).collect()}
    again = {r.doc_id: r.split for r in corpus.assign_splits(frame.repartition(13)).collect()}
    assert found == again
    groups = {}
    for r in rows:
        groups.setdefault(r[1:3], []).append(r[0])
    for ids in groups.values():
        ids.sort(key=lambda d: (md5(f"split|0|{d}"), d))
        sizes = [sum(found[d] == s for d in ids) for s in corpus.SPLITS]
        assert [found[d] for d in ids] == [s for s, k in zip(corpus.SPLITS, sizes) for _ in range(k)]
        assert all(abs(k - len(ids) * x) <= 1.0001 for k, x in zip(sizes, (0.8, 0.1, 0.1))) or len(ids) < 10


@pytest.mark.parametrize("n, expect", [(1, [1, 0, 0]), (2, [2, 0, 0]), (3, [1, 1, 1]), (4, [2, 1, 1]), (10, [8, 1, 1]), (7, [5, 1, 1])])
def test_small_strata_reach_every_split(spark, n, expect):
    frame = spark.createDataFrame([(i, "prose", "en", 5) for i in range(n)], "doc_id long, domain string, lang string, n_tokens long")
    found = [r.split for r in corpus.assign_splits(frame).collect()]
    assert [found.count(s) for s in corpus.SPLITS] == expect


def test_interleaving_is_the_greedy_merge(spark):
    rows, frame = documents(spark, 90)
    groups = {}
    for d, a, b, n in rows:
        groups.setdefault((a, b), []).append((md5(f"order|0|{d}"), d, n))
    for g in groups.values():
        g.sort()
    total = {k: sum(x[2] for x in g) for k, g in groups.items()}
    given, at, order = {k: 0 for k in groups}, {k: 0 for k in groups}, []
    for _ in rows:
        k = min((k for k in groups if at[k] < len(groups[k])), key=lambda k: (given[k] / total[k], k))
        order.append(groups[k][at[k]][1])
        given[k] += groups[k][at[k]][2]
        at[k] += 1
    found = corpus.interleaved(frame).orderBy("position").collect()
    assert [r.doc_id for r in found] == order and [r.position for r in found] == list(range(90))


def test_greedy_shards(spark):
    sizes = [60, 50, 10, 120, 5, 95, 30, 71, 100, 1]
    frame = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long").withColumn("position", F.col("doc_id"))
    found = [r.shard_id for r in corpus.greedy_shards(frame.repartition(4), 100).orderBy("doc_id").collect()]
    assert found == [0, 1, 1, 2, 3, 3, 4, 5, 6, 7]
    with pytest.raises(Refused):
        corpus.greedy_shards(frame, 0)


def folded(sizes, cap):
    """The rule as it reads, one document after another."""
    shard = used = 0
    out = []
    for n in sizes:
        if used and used + n > cap:
            shard, used = shard + 1, 0
        out.append(shard)
        used += n
        if used >= cap:
            shard, used = shard + 1, 0
    return out


@pytest.mark.parametrize("fill", [1, 2, 7, 256])
def test_greedy_shards_in_blocks_are_the_fold(spark, monkeypatch, fill):
    monkeypatch.setattr(corpus, "FILL", fill)
    rng = random.Random(fill)
    sizes = [rng.choice([1, 2, 30, 50, 99, 100, 101, 350]) if rng.random() < 0.5 else rng.randrange(1, 60) for _ in range(600)] + [1] * 400 + [100] * 5 + [1200, 1, 1]
    frame = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long").withColumn("position", F.col("doc_id"))
    found = {r.doc_id: r.shard_id for r in corpus.greedy_shards(frame.repartition(5), 100).collect()}
    assert [found[i] for i in range(len(sizes))] == folded(sizes, 100)


def sequential(rows):
    kept_exact, kept_bands, out = set(), set(), {}
    for d, text in rows:
        words = re.findall(r"\w+", text.lower())
        squeezed = re.sub(r"\s+", " ", text.lower()).strip()
        if len(words) >= 5:
            units = {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}
        elif len(squeezed) >= 24:
            units = {squeezed[i : i + 12] for i in range(len(squeezed) - 11)}
        else:
            units = {squeezed}
        sketch = sorted(md5(u) for u in units)[:16]
        bands = [f"{i // 4}|" + ",".join(sketch[i : i + 4]) for i in range(0, len(sketch) - 3, 4)] or ["0|" + ",".join(sketch)]
        if text in kept_exact:
            out[d] = "duplicate_exact"
        elif any(b in kept_bands for b in bands):
            out[d] = "duplicate_near"
        else:
            out[d] = None
            kept_exact.add(text)
            kept_bands.update(bands)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_first_kept_is_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts).split()
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(99)}"
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(2, 30))))
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.reason for r in corpus.first_kept(frame).collect()} == sequential(rows)


def test_truncation_by_a_counter(spark):
    """With a counter that takes a quarter of the code points, the general rule is the rule for that ratio; by
    words, the result holds as many as it may."""
    texts = ["", "word " * 30, "line one is here\nline two is longer than it", "x" * 50, " " * 60, None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for cap in (1, 5, 7, 10):
        got = frame.select(T.truncated(F.col("t"), cap).alias("a"), T.truncated_by(F.col("t"), lambda s: max(1, -(-len(s) // 4)), cap).alias("b")).collect()
        assert all(r.a == r.b for r in got)
    words = [r.w for r in frame.select(T.truncated_by(F.col("t"), lambda s: len(s.split()), 4, slack=0.5).alias("w")).collect()]
    assert words == ["", "word word word word", "line one is here", "x" * 50, " " * 60, None]


def test_text_rules(spark):
    raw = "a \r\n\r\n\r\n\r\nb\x00c\t\r  d é  "
    row = spark.createDataFrame([(raw,)], "t string").select(T.normalise_whitespace(F.col("t")).alias("n")).first()
    assert row.n == "a\n\nbc\n  d é" == unicodedata.normalize("NFC", row.n)
    long = "word " * 30
    cases = [(long, 10), ("line one is here\nline two is longer than it", 7), ("x" * 50, 5), ("short", 5), (" " * 60, 5)]
    for t, cap in cases:
        got = spark.createDataFrame([(t,)], "t string").select(T.truncated(F.col("t"), cap).alias("c")).first().c
        cut = t[: 4 * cap]
        if len(t) > 4 * cap:
            for sep in "\n ":
                at = cut.rfind(sep)
                if at >= int(4 * cap * 0.85) and at > 0:
                    cut = cut[:at]
                    break
            assert got == (cut.rstrip() or cut)
        else:
            assert got == t
    r = spark.createDataFrame([("Привет мир", "ru"), ("hello", "ru"), ("hello", "de"), ("  ", "ru")], "t string, l string").select(T.looks_like(F.col("t"), F.col("l")).alias("ok")).collect()
    assert [x.ok for x in r] == [True, False, True, False]
    assert spark.createDataFrame([("漢字かな交じり文です",)], "t string").select(T.is_unspaced(F.col("t")).alias("u")).first().u


def test_reasons_add_up(spark):
    frame = spark.createDataFrame([(1, "word " * 50, "en"), (2, "tiny", "en"), (3, " \n ", "en"), (4, "latin letters " * 9, "ru")], "doc_id long, text string, lang string")
    report = {r.reason: r.n for r in corpus.drop_report(corpus.cleaned(frame, 24, 512)).collect()}
    assert report == {"empty_after_normalise": 1, "too_short": 1, "over_max_tokens": 0, "lang_mismatch": 1, "duplicate_exact": 0, "duplicate_near": 0, "parallel_row_incomplete": 0, "kept": 1}


def test_targets_leave_nothing_over():
    sources = [corpus.Source("p", "prose", 1), corpus.Source("c", "code", 1), corpus.Source("m", "math", 1), corpus.Source("v", "multilingual", 4), corpus.Source("f", "multilingual", 1, control=True)]
    t = corpus.token_targets(1_000_003, sources)
    assert sum(t.values()) == 1_000_003 and t["v"] > 3 * t["f"]
    with pytest.raises(Refused):
        corpus.token_targets(1000, [*sources[:3], corpus.Source("v", "multilingual", 1), corpus.Source("f", "multilingual", 1, control=True)])


def test_ladder_and_shares(spark):
    shards = spark.createDataFrame([(0, 40_000), (1, 60_000)], "shard_id int, n_tokens long")
    rows = {r.step: r for r in corpus.byte_ladder(spark, shards, 64, 2048, 16, 8, 50_000, 200_000_000).collect()}
    # step 0: every second token, 30,000 captured of 60,000 at 65,536 bytes, scores 2,048, labels 512
    assert rows[0].worst_bytes == 30_000 * 65_536 + 60_000 * 2_048 + 60_000 * 512 and not rows[0].within_cap
    assert rows[4].worst_bytes == 60_000 * 512 and [r.step for r in rows.values() if r.recommended] == [4]
    with pytest.raises(Refused):
        corpus.byte_ladder(spark, shards.limit(0), 64, 2048, 16, 8, 50_000, 1)


def test_a_long_chain_is_settled_to_its_end(spark):
    # Document i shares a key with i - 1 and i + 1 alone, so every other one is kept.
    rows = spark.createDataFrame([(i, f"b{k}") for i in range(300) for k in (i, i + 1)], "at long, key string")
    found = sorted((r.at, r.reason) for r in corpus.first_of_kind(rows, most_rounds=3).collect())
    assert found == [(i, "duplicate_near" if i % 2 else None) for i in range(300)]


def test_rounds_go_on_while_the_rest_is_too_large_for_a_task(spark, monkeypatch):
    monkeypatch.setattr(corpus, "FEW_ROWS", 0, raising=False)
    rows = spark.createDataFrame([(i, f"b{k}") for i in range(10) for k in (i, i + 1)], "at long, key string")
    found = sorted((r.at, r.reason) for r in corpus.first_of_kind(rows, most_rounds=2).collect())
    assert found == [(i, "duplicate_near" if i % 2 else None) for i in range(10)]
