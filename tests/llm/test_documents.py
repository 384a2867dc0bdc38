import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewright.llm import hilbert, langid, near_dup, toxicity
from tracewright.llm.shared import connected_components, work_dir


def shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute(rows, numerator=75, denominator=100):
    """component of each row index, by all pairs"""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) * denominator >= len(sets[a] | sets[b]) * numerator:
                parent[top(a)] = top(b)
    members = defaultdict(list)
    for a in range(len(rows)):
        members[top(a)].append(a)
    least = {a: min((rows[x][0] for x in m if rows[x][0] is not None), default=None) for m in members.values() for a in m}
    return sets, least


def check_near(spark, frame, rows):
    found = near_dup.near_duplicates(frame, work_dir(spark)).collect()
    sets, least = brute(rows)
    key = lambda d, n, c: (d is not None, d or 0, n, c is not None, c or 0)
    assert sorted(key(r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(key(rows[i][0], len(sets[i]), least[i]) for i in range(len(rows)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_on_awkward_rows(spark, docs):
    check_near(spark, docs, [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_near_duplicates_in_groups_around_the_threshold(spark, monkeypatch):
    """Groups in which some pairs pass and some do not, so components must be joined across bands."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(3)
    rows = []
    for g in range(4):
        base = [f"w{rng.randrange(400)}" for _ in range(120)]
        for _ in range(40):
            own = list(base)
            for _ in range(rng.randrange(0, 9)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(1000 + i, " ".join(f"w{rng.randrange(400)}" for _ in range(60))) for i in range(40)]
    rng.shuffle(rows)
    check_near(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_near_duplicates_in_blocks_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "HASHES", 500)
    rng = random.Random(13)
    rows = []
    for _ in range(3):
        base = [f"w{rng.randrange(300)}" for _ in range(150)]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randrange(0, 10)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9999)}"
            rows.append((rng.randrange(10_000), " ".join(own)))
    check_near(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_many_rows_without_an_id_meet_only_copies(spark):
    """10,000 texts without an id and 5,000 with one id, of which some are near copies: no row meets all."""
    rng = random.Random(14)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(30)) for _ in range(7000)]
    rows = [(None, t) for t in texts[:5000]] + [(None, t + " end") for t in texts[:5000]] + [(77, t) for t in texts[4000:]] + [(77, texts[0])] * 2000
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), work_dir(spark)).collect()
    assert len(found) == len(rows)
    # A text with its end has 26 of 27 shingles in common with it; copies that have an id give it.
    assert sum(r.component_id == 77 for r in found) == sum(1 for i, t in rows if i == 77 or t.removesuffix(" end") in {*texts[4000:], texts[0]})


def test_near_duplicates_of_nothing(spark, docs):
    assert near_dup.near_duplicates(docs.limit(0), work_dir(spark)).collect() == []


def test_registers_estimate_and_merge():
    rng = np.random.default_rng(4)
    for share in (0.3, 0.6, 0.9):
        both = rng.integers(0, 1 << 63, int(2000 * share), dtype=np.uint64)
        only = [rng.integers(0, 1 << 63, int(1000 * (1 - share)), dtype=np.uint64) for _ in range(2)]
        a, b = (np.unique(np.concatenate([both, o])) for o in only)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        ra, rb = near_dup.registers(a), near_dup.registers(b)
        j = near_dup.estimate(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(j - true) < 0.13
        assert (near_dup.merge(ra, rb) == near_dup.registers(np.union1d(a, b))).all()


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(200, 260)] + [(1, 2), (2, 3), (3, 1), (5, 5), (9, 8), (8, 9)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), work_dir(spark), "t").collect()}
    groups = defaultdict(set)
    for node, root in found.items():
        groups[root].add(node)
    assert sorted(map(sorted, groups.values())) == sorted([list(range(100, 141)), [7, *range(200, 260)], [1, 2, 3], [8, 9]])


def corpora():
    rng = random.Random(11)
    parts = {"en": ["the", "ing", "tion", "er", "and"], "de": ["sch", "ein", "ung", "keit", "ü"], "fr": ["eau", "oi", "ment", "é", "qu"]}
    rows = []
    for i in range(600):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))), lang))
    return rows


def test_languages_are_told_apart(spark):
    frame = spark.createDataFrame(corpora(), "doc_id long, text string, lang string")
    model = langid.fit(frame.where(langid.learnable()))
    found = frame.join(langid.identify(frame, model), "doc_id").where(~langid.learnable()).collect()
    assert len(found) > 50 and sum(r.lang == r.lang_pred for r in found) / len(found) > 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_long_texts_are_cut_into_windows_without_loss(monkeypatch):
    texts = ["the ing tion " * 50, "sch ein ung " * 70, "é", "", None, "12 34", "x" * 1000]
    whole = [langid.grams(langid._codes([(t.lower() + "\n\n", len(t.lower()))])[0]) for t in texts if t]
    monkeypatch.setattr(langid, "WINDOW", 37)
    sums = []
    for t in texts:
        if not t:
            continue
        total = np.zeros((3, (1 << 16) + 1), int)
        for group, _ in langid.segments([t]):
            codes, _, own = langid._codes(group)
            for k, b in enumerate(langid.grams(codes)):
                total[k] += np.bincount(b[own], minlength=(1 << 16) + 1)
        sums.append(total)
    for g, total in zip(whole, sums):
        for k in range(3):
            assert (np.bincount(g[k], minlength=(1 << 16) + 1) == total[k]).all()


def plain_bayes(rows, texts, smoothing=0.05):
    """The model in plain loops over characters, with the same hash: log posterior of each language."""

    def buckets(text):
        codes = [ord(c) if c.isalpha() else 0 for c in text.lower()] + [0, 0]
        out = []
        for i in range(len(codes) - 2):
            key = 0
            for k in range(3):
                key = ((key * 0x01000193) & 0xFFFFFFFF) ^ ((codes[i + k] * 0xC2B2AE35) & 0xFFFFFFFF)
                if any(codes[i : i + k + 1]):
                    x = ((key + k) * 0x9E3779B1) & 0xFFFFFFFF
                    x ^= x >> 15
                    out.append(((x * 0x85EBCA77) & 0xFFFFFFFF) >> 16)
        return out

    counts, documents = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for _, text, lang in rows:
        documents[lang] += 1
        for b in buckets(text):
            counts[lang][b] += 1
    out = []
    for text in texts:
        logs = {}
        for lang in sorted(documents):
            whole = sum(counts[lang].values()) + smoothing * 65536
            logs[lang] = np.log(documents[lang] / len(rows)) + sum(np.log((counts[lang].get(b, 0) + smoothing) / whole) for b in buckets(text))
        best = max(logs, key=logs.get)
        out.append((best, 1 / sum(np.exp(v - logs[best]) for v in logs.values())))
    return out


def test_language_scores_are_those_of_the_plain_model(spark):
    rows = [r for r in corpora() if r[2] != "fr" or r[0] % 9 == 0]
    texts = ["the ing", "sch", "é the", "ein ung ment er", "x", "eau the sch " * 3, rows[5][1], "Ünd 12 the."]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    langs, scores = model.predict(texts)
    for lang, score, (expect, p) in zip(langs, scores, plain_bayes(rows, texts)):
        assert lang == expect and abs(score - p) < 1e-3


def test_priors_are_shares_of_all_documents_and_labels_are_bounded(spark):
    rows = [(i, f"w{i % 7} the", "en" if i % 10 else "de") for i in range(1000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame, per_language=20)
    assert np.allclose(np.exp(model.priors), [0.1, 0.9])
    with pytest.raises(ValueError):
        langid.fit(frame.withColumn("lang", F.col("doc_id").cast("string")), most_languages=50)


def test_language_edge_cases(spark, docs):
    model = langid.fit(docs)
    found = langid.identify(docs, model).collect()
    assert len(found) == docs.count()
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by[200].lang_pred == by[201].lang_pred == by[202].lang_pred == by[203].lang_pred == "und"
    assert by[300].lang_pred in ("en", "de", "fr")
    assert langid.identify(docs.limit(0), model).collect() == []
    none = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and not {200, 201, 202, 203} & {r.doc_id for r in kept.collect()}


def toxic_corpus():
    rng = random.Random(5)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(900)]
    rows, labels = [], []
    for i in range(1500):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 80))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["zyxxa", "qwort"]) + rng.choice(["", "ing", "ed", "s"]))
        rows.append((i, " ".join(words)))
        if rng.random() < 0.6:
            labels.append((i, int(toxic)))
    return rows, labels


def test_toxic_texts_are_found_and_clean_ones_left(spark):
    rows, labels = toxic_corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(frame, marks, toxicity.learnable())
    found = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    held = [(found[i].predicted, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100
    assert sum(p and y for p, y in held) >= 0.95 * sum(y for _, y in held)
    assert sum(p and not y for p, y in held) <= 0.02 * len(held)
    again = toxicity.fit(frame.repartition(7), marks.repartition(3), toxicity.learnable())
    assert again.weights == model.weights and again.bias == model.bias


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows, labels = toxic_corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    a, b = (toxicity.fit(frame, spark.createDataFrame(x, "doc_id long, toxic int"), toxicity.learnable()) for x in (labels, flipped))
    assert a.weights == b.weights and a.bias == b.bias


def test_risk_is_as_written_down_and_its_slope_is_its_slope():
    """The risk against a plain loop over documents, and the slope against differences of the risk."""
    rng = np.random.default_rng(9)
    for prior, shift in ((0.3, 0.0), (0.6, -2.0), (0.1, 1.0)):
        positive = rng.random(40) < 0.4
        z, weight = rng.standard_normal(40) + shift, rng.integers(1, 4, 40).astype(float)
        loss = lambda t: 1 / (1 + np.exp(t))
        mean = lambda sign, which: sum(w * loss(sign * x) for x, w, p in zip(z, weight, positive) if p == which) / sum(w for w, p in zip(weight, positive) if p == which)  # noqa: E731, B023
        below = mean(-1, False) - prior * mean(-1, True)
        assert np.isclose(toxicity.risk(z, weight, positive, prior), prior * mean(1, True) + max(0.0, below))
        if below > 0:
            step = 1e-6 * np.eye(40)
            slow = [(toxicity.risk(z + s, weight, positive, prior) - toxicity.risk(z - s, weight, positive, prior)) / 2e-6 for s in step]
            assert np.allclose(toxicity.slope(z, weight, positive, prior), slow, atol=1e-6)
        else:
            assert (toxicity.slope(z, weight, positive, prior)[~positive] < 0).all()
    # Where the second part is negative, the step raises it.
    z, positive, weight = np.array([6.0, 6.0, -6.0, -6.0]), np.array([True, True, False, False]), np.ones(4)
    g = toxicity.slope(z, weight, positive, 0.5)
    assert (g[~positive] < 0).all() and (g[positive] > 0).all()


def test_classifier_lowers_the_risk_and_copies_weigh_as_often_as_they_occur():
    rng = np.random.default_rng(10)
    lists = [tuple(sorted(set(rng.integers(0, 6, 3).tolist()) | ({6} if k < 60 else set()))) for k in range(200)]
    rows, columns, weight, positive = toxicity._merged(lists, [k < 60 for k in range(200)])
    assert weight.sum() == 200 and len(weight) < 200
    w, b = toxicity.nnpu(rows, columns, weight, positive, 7, 0.3)
    margin = np.bincount(rows, w[columns], len(weight)) + b
    assert toxicity.risk(margin, weight, positive, 0.3) < 0.5 * toxicity.risk(np.zeros(len(weight)), weight, positive, 0.3) and w.argmax() == 6
    one = np.repeat(np.arange(200), [len(x) for x in lists]), np.array([c for x in lists for c in x])
    again = toxicity.nnpu(*one, np.ones(200), np.arange(200) < 60, 7, 0.3)
    assert np.allclose(again[0], w, atol=1e-6)


def test_every_unlabelled_document_counts(spark, monkeypatch):
    """Blocks of 100: a word that only late documents hold beside the positives is no feature."""
    rows, labels = toxic_corpus()
    rows = [(i, t + " zeitung" * (i > 700 or dict(labels).get(i) == 1)) for i, t in rows]
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    whole = toxicity.fit(frame, marks, toxicity.learnable())
    monkeypatch.setattr(toxicity, "BLOCK", 100)
    split = toxicity.fit(frame, marks, toxicity.learnable())
    assert set(split.weights) == set(whole.weights) and "=zeitung" not in split.weights
    texts = [t for _, t in rows]
    assert ((split.scores(texts) >= 0.3) == (whole.scores(texts) >= 0.3)).mean() > 0.99
    assert split == toxicity.fit(frame.repartition(9), marks, toxicity.learnable())


def test_toxicity_edge_cases(spark, docs):
    marks = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (100, 1), (101, 1), (205, 0)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    for model in (toxicity.fit(docs, marks, toxicity.learnable()), toxicity.fit(docs, marks.limit(0), toxicity.learnable()), toxicity.fit(docs.limit(0), marks, toxicity.learnable())):
        found = toxicity.score(docs, model).collect()
        assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
        assert toxicity.score(docs.limit(0), model).collect() == []
        assert toxicity.keep_clean(docs, model).columns == docs.columns


@pytest.mark.parametrize("dims, bits", [(2, 1), (2, 3), (3, 2), (3, 4)])
def test_curve_is_a_path_through_all_cells(spark, dims, bits):
    cells = [r.cell for r in hilbert.curve(spark, dims, bits).orderBy("place").collect()]
    at = [[(c >> (bits * (dims - 1 - i))) & ((1 << bits) - 1) for i in range(dims)] for c in cells]
    assert sorted(cells) == list(range(1 << (dims * bits)))
    assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for a, b in zip(at, at[1:]))


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_even_and_ordered(spark, docs, shards):
    hot = docs.unionByName(docs.where("doc_id = 5").withColumn("doc_id", F.explode(F.sequence(F.lit(5000), F.lit(5200)))))
    rows = hilbert.assign(hot, work_dir(spark), ["lang", "source", "n_chars"], shards, "doc_id", "text").collect()
    assert len(rows) == hot.count()
    counts = [sum(r.shard == k for r in rows) for k in range(shards)]
    assert max(counts) - min(counts) <= 1
    for k in range(shards):
        own = sorted((r for r in rows if r.shard == k), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own))) and [r.place for r in own] == sorted(r.place for r in own)
    text = {d: t or "" for d, t in hot.select("doc_id", "text").collect() if d is not None}
    assert all(r.size == len(text[r.id].encode()) + 1 and r.crc == zlib.crc32(text[r.id].encode()) for r in rows if r.id is not None)


def walk(dims, bits):
    """Cells in the order of the curve, by the other way round: from the place to the coordinates, with
    Gray codes, entry points and directions of sub-cubes."""

    def turn(x, d):
        d %= dims
        return ((x << d) | (x >> (dims - d))) & ((1 << dims) - 1)

    gray = lambda i: i ^ (i >> 1)
    entry = lambda i: 0 if i == 0 else gray(2 * ((i - 1) // 2))
    ones = lambda i: (~i & (i + 1)).bit_length() - 1
    direction = lambda i: 0 if i == 0 else (ones(i - 1) if i % 2 == 0 else ones(i)) % dims
    cells = []
    for place in range(1 << (dims * bits)):
        e, d, at = 0, 0, [0] * dims
        for level in range(bits - 1, -1, -1):
            w = (place >> (level * dims)) & ((1 << dims) - 1)
            corner = turn(gray(w), d + 1) ^ e
            for j in range(dims):
                at[j] |= ((corner >> j) & 1) << level
            e, d = e ^ turn(entry(w), d + 1), (d + direction(w) + 1) % dims
        cells.append(tuple(at))
    return cells


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (3, 4)])
def test_curve_is_a_hilbert_curve(spark, dims, bits):
    """Equal, but for the order and direction of the axes, to a curve made in another way."""
    mine = {r.place: tuple((r.cell >> (bits * (dims - 1 - i))) & ((1 << bits) - 1) for i in range(dims)) for r in hilbert.curve(spark, dims, bits).collect()}
    # Both visit aligned cubes of every size one after another, and each step changes one coordinate by 1.
    for cells in ([mine[k] for k in range(len(mine))], walk(dims, bits)):
        assert cells[0] == (0,) * dims and sorted(cells[-1]) == [0] * (dims - 1) + [(1 << bits) - 1]
        for level in range(1, bits):
            size = 1 << (dims * level)
            for at in range(0, len(cells), size):
                assert len({tuple(x >> level for x in c) for c in cells[at : at + size]}) == 1
        assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for a, b in zip(cells, cells[1:]))
    if dims == 2:
        assert [mine[k] for k in range(len(mine))] in ([c[::s] for c in walk(dims, bits)] for s in (1, -1))


def test_each_row_has_its_own_cell_and_place(spark, docs, monkeypatch):
    """Against a plain computation of quantiles, cells and order, on rows without ties of size."""
    monkeypatch.setattr(hilbert, "PIECES", 3)
    monkeypatch.setattr(hilbert, "WINDOW", 4)
    names, bits = ["lang", "n_chars"], 2
    rows = hilbert.assign(docs, work_dir(spark), names, 3, "doc_id", "text", bits=bits).collect()
    frame = docs.select("doc_id", "text", "lang", "n_chars").collect()
    number = lambda x: None if x is None else float(int.from_bytes(x.encode()[:7].ljust(7, b"\0"), "big")) if isinstance(x, str) else float(x)
    bounds = {}
    for c in names:
        values = sorted(number(r[c]) for r in frame if r[c] is not None)
        bounds[c] = sorted({values[max(0, -(-k * len(values) // 4) - 1)] for k in (1, 2, 3)})
    place = {c: k for k, c in enumerate(hilbert_order(spark, 2, bits))}
    expect = sorted((str(r.doc_id), zlib.crc32((r.text or "").encode()), place[tuple(0 if r[c] is None else sum(b < number(r[c]) for b in bounds[c]) for c in names)]) for r in frame)
    assert sorted((str(r.id), r.crc, r.place) for r in rows) == expect
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.place for r in order] == sorted(r.place for r in rows)


def hilbert_order(spark, dims, bits):
    return [tuple((r.cell >> (bits * (dims - 1 - i))) & ((1 << bits) - 1) for i in range(dims)) for r in hilbert.curve(spark, dims, bits).orderBy("place").collect()]


def test_sharding_of_nothing(spark, docs):
    assert hilbert.assign(docs.limit(0), work_dir(spark), ["lang", "n_chars"], 4, "doc_id", "text").collect() == []


def test_ranges_prune(spark, docs):
    rows = hilbert.assign(docs, work_dir(spark), ["n_chars"], 4, "doc_id", "text")
    wide = rows.join(docs.select(F.col("doc_id").alias("id"), "n_chars"), "id")
    found = sorted(hilbert.file_ranges(wide, ["n_chars"]).collect(), key=lambda r: r.shard)
    # Along one dimension the curve is the order of the steps, so ranges meet at most in one step.
    bounds = hilbert.steps(docs, ["n_chars"], 4)["n_chars"]
    step = lambda x: sum(b < (x or 0) for b in bounds)
    assert len(found) == 4 and all(step(a.max_n_chars) <= step(b.min_n_chars) for a, b in zip(found, found[1:]))


def test_pipeline_stages(spark, docs, tmp_path):
    import shutil

    folder = tmp_path / "sf"
    docs.write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(40)], "doc_id long, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "near_duplicates", "packing"]
    kept = corpus_pipeline.identified(spark, docs, f"file://{folder}")
    one = corpus_pipeline.distinct(spark, kept, f"file://{folder}")
    assert one.columns == docs.columns
    rows = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    _, least = brute(rows)
    expect = sorted(rows[i][0] for i in range(len(rows)) if rows[i][0] is not None and rows[i][0] == least[i])
    assert sorted(r.doc_id for r in one.collect() if r.doc_id is not None) == expect
    out = corpus_pipeline.run(spark, f"file://{folder}")
    assert out.count() > 0 and "sequence_id" in out.columns
    shutil.rmtree(folder)


def test_pipeline_of_nothing(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []
