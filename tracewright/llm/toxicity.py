"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents that are marked toxic; everything else that may be learned from is taken as
unlabelled. With the class prior p, the risk of a linear classifier is

    p * mean over positives of loss(+z)
    + max(0, mean over unlabelled of loss(-z) - p * mean over positives of loss(-z))

and where the second part falls below zero, the step goes against it, as the estimator's authors have
it. The loss is the sigmoid one, 1 / (1 + exp(z)): it is bounded, so that large margins of the
positives seen don't pay for unlabelled texts that score too high. Features are presence of words and
of word beginnings, in one word or in several, that are commoner among positives.

Every unlabelled document counts. They are dealt to blocks of bounded size, each block trains a numpy
classifier against the same positives, and the model is the mean of the classifiers. The only sample is
that of the positives, which are labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import alone, small_batches, work_dir, written

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are features beside the whole word.
PREFIXES = (4, 5, 6, 7, 8)
#: Before a beginning: the text has it in two different chunks or more.
TWICE = "2"
#: Chunks that a worker keeps the features of: those of a model, and all features, which take far more room.
KEPT_CHUNKS, KEPT_WHOLE = 100_000, 20_000
#: Unlabelled documents of a block, on average.
BLOCK = 16_384


def features(text: str) -> set[str]:
    """Features of one chunk or text: whole words as ``=word``, beginnings as they are."""
    out = set()
    for word in WORD.findall(text.lower()):
        out.add("=" + word)
        out.update(word[:n] for n in PREFIXES if len(word) >= n)
    return out


class _Chunks(dict):
    """Chunk of a lower-cased text between white space -> its features, of those that ``names`` has alone
    or twice; all of them where there are no names."""

    def __init__(self, names=None):
        super().__init__()
        self.names = None if names is None else {f.removeprefix(TWICE) for f in names}
        # What a word with a named feature begins with: most words are passed over by this alone.
        self.heads = None if names is None else {f.removeprefix("=")[: PREFIXES[0]] for f in self.names}

    def __missing__(self, chunk: str) -> tuple:
        words = (chunk,) if chunk.isalpha() else WORD.findall(chunk)
        if self.names is None:
            found = tuple(features(chunk))
        elif self.heads.isdisjoint([w[: PREFIXES[0]] for w in words]):
            found = ()
        else:
            found = tuple(features(chunk) & self.names)
        self[chunk] = found
        return found

    def of(self, text: str) -> list[str]:
        """The features of a text, those that it has twice among them."""
        times = Counter(chain.from_iterable(map(self.__getitem__, set(text.lower().split()))))
        if len(self) > (KEPT_WHOLE if self.names is None else KEPT_CHUNKS):
            self.clear()
        return [*times, *(TWICE + f for f, n in times.items() if n > 1 and f[0] != "=")]


@dataclass
class Model:
    """Weights of the selected features, and the bias."""

    weights: dict[str, float]
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of the label for each text; a null or empty text has the bias alone."""
        known, get = _known(self), self.weights.get
        out = np.array([self.bias + (sum(get(f, 0.0) for f in sorted(known.of(text))) if text else 0.0) for text in texts])
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


_KNOWN: dict[int, tuple] = {}


def _known(model: Model) -> _Chunks:
    alone("toxicity", _KNOWN.clear)
    held = _KNOWN.get(id(model))
    if held is None or held[0] is not model:
        _KNOWN.clear()
        _KNOWN[id(model)] = held = (model, _Chunks(model.weights))
    return held[1]


def risk(z: np.ndarray, weight: np.ndarray, positive: np.ndarray, prior: float) -> float:
    """The non-negative risk of the margins ``z`` of weighted documents."""
    loss = 1 / (1 + np.exp(z))
    n_pos, n_unl = weight[positive].sum(), weight[~positive].sum()
    below = ((1 - loss[~positive]) * weight[~positive]).sum() / n_unl - prior * ((1 - loss[positive]) * weight[positive]).sum() / n_pos
    return float(prior * (loss[positive] * weight[positive]).sum() / n_pos + max(0.0, below))


def slope(z: np.ndarray, weight: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """The slope of ``risk`` in each margin where its second part is not negative; else that of the
    second part alone, turned round, which is the step that the estimator takes there."""
    p = 1 / (1 + np.exp(-z))
    n_pos, n_unl = weight[positive].sum(), weight[~positive].sum()
    steep = p * (1 - p) * weight
    minus = np.where(positive, -prior * steep / n_pos, steep / n_unl)
    if (p[~positive] * weight[~positive]).sum() / n_unl >= prior * (p[positive] * weight[positive]).sum() / n_pos:
        return minus - np.where(positive, prior * steep / n_pos, 0)
    return -minus


def nnpu(rows: np.ndarray, columns: np.ndarray, weight: np.ndarray, positive: np.ndarray, n_features: int, prior: float, steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear classifier that minimises the non-negative risk. ``rows,
    columns`` list the features present; ``positive`` marks the positive documents, the others are
    unlabelled; a document counts ``weight`` times. Full gradients and Adam, so that the result depends
    on no order."""
    weights, m, v = np.zeros(n_features), np.zeros(n_features + 1), np.zeros(n_features + 1)
    bias = float(np.log(prior / (1 - prior)))
    for step in range(1, steps + 1):
        g = slope(np.bincount(rows, weights[columns], len(positive)) + bias, weight, positive, prior)
        g = np.append(np.bincount(columns, g[rows], n_features) + decay * weights, g.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - change[:-1], bias - float(change[-1])
    return weights, bias


def _merged(lists: list[tuple], positive: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal documents as one, in an order that depends on nothing else: ``rows, columns, weight,
    positive`` for ``nnpu``."""
    times: dict[tuple, int] = {}
    for key in zip(positive, lists):
        times[key] = times.get(key, 0) + 1
    order = sorted(times)
    rows = np.repeat(np.arange(len(order)), [len(x) for _, x in order])
    columns = np.array([c for _, x in order for c in x], np.int64)
    return rows, columns, np.array([times[k] for k in order], float), np.array([p for p, _ in order], bool)


def learnable(id_column: str = "doc_id", folds: int = 4, held_out: int = 2) -> Column:
    """True for rows whose label may be learned; a row without an id isn't learned from."""
    fold = F.crc32(F.col(id_column).cast("string")) % folds
    return F.coalesce(fold != held_out, F.lit(False))


def _lot(c: str, salt: int) -> Column:
    return F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def _matches(texts: pa.Array, known: _Chunks, place: dict[str, int]):
    """For each text the sorted places of the features that it has."""
    for text in texts.to_pylist():
        yield sorted([place[f] for f in known.of(text) if f in place])


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", positives: int = 8000, labelled: int = 16000, tasks: int = 8, least: int = 5, surprise: float = 50.0) -> Model:
    """Fits on at most about ``positives`` documents marked toxic, chosen by a hash of the id and read
    whole, and on all documents that may be learned from as unlabelled ones.

    ``may_learn`` is a condition on ``id_column``; labels and texts of other rows are not used, nor are
    those of rows whose id or text is null. An id with several labels is positive if one of them is. The
    class prior is the share of positives among all labels that may be learned. Copies of a positive
    count once; unlabelled documents count as they are. Features are those found in at least ``least``
    of the positives and there so much oftener than all unlabelled documents let expect, that the
    squared excess is ``surprise`` times the expected number. Which features are counted in all documents
    is decided on the positives and about ``labelled`` documents with any label, by half that excess: what
    the driver holds and broadcasts are features of a sample whose size is bounded. Without positives, documents or features that
    pass the model scores the prior, or 0. Columns other than those named don't matter, and an empty
    table on either side gives the model without positives.
    """
    spark = docs.sparkSession
    small_batches(spark)
    marks = labels.where(may_learn).select(F.col(id_column).alias("id"), F.col(label_column).alias("y")).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    n_marks, n_toxic = marks.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("y") == 1, 1)), F.lit(0))).first()
    own = docs.where(may_learn).select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    if not n_toxic:
        return Model({}, -40.0)
    prior = min(0.99, max(1e-4, n_toxic / n_marks))
    chosen = marks.withColumns({"positive": (F.col("y") == 1) & (_lot("id", 1) < positives / n_toxic), "other": _lot("id", 2) < labelled / n_marks}).where("positive OR other").select("id", "positive", "other")
    # At most about `positives` and `labelled` ids: that bound is what makes the broadcast safe.
    sample = own.join(F.broadcast(chosen), "id").groupBy("text").agg(F.max("positive").alias("positive"), F.max("other").alias("other"))
    sample = written(sample.repartition(tasks), work_dir(spark), "sample")
    pos = sample.where("positive").select("text")

    def tally(batches):
        inside, beside = Counter(), Counter()
        known = _Chunks()
        for batch in batches:
            for text, positive, other in zip(*(c.to_pylist() for c in batch.columns)):
                # The empty name stands for the number of documents.
                found = ["", *known.of(text)]
                if positive:
                    inside.update(found)
                if other:
                    beside.update(found)
        names = [*inside]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(inside.values(), pa.int64()), pa.array([beside[f] for f in names], pa.int64())], names=["f", "p", "u"])
        rest = [f for f in beside if f not in inside]
        yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([beside[f] for f in rest], pa.int64())], names=["f", "p", "u"])

    counts = sample.mapInArrow(tally, "f string, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    counts = written(counts.where((F.col("p") >= least) | (F.col("f") == "")), work_dir(spark), "counts")
    sizes = counts.where("f = ''").first()
    if sizes is None or not sizes["p"]:
        return Model({}, -40.0)
    n_pos = sizes["p"]
    guess = F.lit(float(n_pos)) * (F.col("u") + 1) / F.lit(max(1, sizes["u"]))
    likely = (F.col("f") != "") & (F.col("p") > guess) & ((F.col("p") - guess) * (F.col("p") - guess) >= guess * (surprise / 2))
    inside = {r["f"]: r["p"] for r in counts.where(likely).select("f", "p").collect()}
    if not inside:
        return Model({}, float(np.log(prior / (1 - prior))))
    place = {f: i for i, f in enumerate(sorted(inside))}
    held = spark.sparkContext.broadcast(place)

    def among_all(batches):
        known, counts, n = _Chunks(held.value), np.zeros(len(held.value), np.int64), 0
        for batch in batches:
            at = [i for match in _matches(batch.column(0), known, held.value) for i in match]
            counts += np.bincount(np.array(at, np.int64), minlength=len(counts))
            n += batch.num_rows
        if n:
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(counts[some], n), pa.int64())], names=["at", "n"])

    everywhere = {r["at"]: r["n"] for r in own.select("text").mapInArrow(among_all, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    held.unpersist()
    n_unl = everywhere.pop(-1)
    names = []
    for f, i in place.items():
        expected = n_pos * (everywhere.get(i, 0) + 1) / n_unl
        if inside[f] > expected and (inside[f] - expected) ** 2 >= surprise * expected:
            names.append(f)
    if not names:
        return Model({}, float(np.log(prior / (1 - prior))))
    chosen_place = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def design(batches):
        known = _Chunks(chosen_place.value)
        for batch in batches:
            rows = list(_matches(batch.column(batch.num_columns - 1), known, chosen_place.value))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.int32()))], names=[*batch.schema.names[:-1], "at"])

    positive = spark.sparkContext.broadcast(sorted(map(tuple, pos.mapInArrow(design, "at array<int>").toArrow().column("at").to_pylist())))
    blocks = -(-n_unl // BLOCK)
    dealt = own.select(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int").alias("block"), "text")

    def train(group: pa.Table) -> pa.Table:
        some = list(map(tuple, group.column("at").to_pylist()))
        lists = [*positive.value, *some]
        rows, columns, weight, marked = _merged(lists, [True] * len(positive.value) + [False] * len(some))
        weights, bias = nnpu(rows, columns, weight, marked, len(names), prior)
        at = np.append(np.flatnonzero(weights), -1)
        return pa.table({"at": pa.array(at, pa.int32()), "w": pa.array(np.append(weights[at[:-1]], bias))})

    trained = dealt.mapInArrow(design, "block int, at array<int>").groupBy("block").applyInArrow(train, "at int, w double")
    # Rounded before they are added, so that the sum does not depend on the order of the blocks.
    total = {r["at"]: float(r["w"]) for r in trained.groupBy("at").agg(F.sum(F.col("w").cast("decimal(28,12)")).alias("w")).collect()}
    return Model({f: total[i] / blocks for i, f in enumerate(names) if i in total}, total[-1] / blocks)


def scorer(spark, model: Model):
    """A column function: text -> score. The model, some features of the positives, is broadcast."""
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(held.value.scores(texts.to_pylist()), pa.float64())

    return score


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` of every row, null ids and repeated rows as they are."""
    own = docs.select(F.col(id_column).alias("doc_id"), scorer(docs.sparkSession, model)(F.col(text_column)).alias("score"))
    return own.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: Model, text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows that score below the threshold; all columns as they were."""
    return docs.where(scorer(docs.sparkSession, model)(F.col(text_column)) < threshold)
