"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log probabilities, one row a language and one column a hash bucket, fitted on
a bounded sample of the labelled documents and broadcast. Scoring takes batches of texts: the n-grams
of all their characters are hashed with array arithmetic and looked up, and the sums are cut at the
texts' ends.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Answer for a text without a letter.
UNDETERMINED = "und"
BITS = 16
ORDERS = 3
#: Characters that are scored at a time.
WINDOW = 1 << 18

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> itself if it is a letter, else 0."""
    if not _LETTERS:
        _LETTERS.append(np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32))
    return _LETTERS[0]


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint32(salt)) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    return (x * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)


def grams(codes: np.ndarray) -> list[np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams that begin at each character but the last two; a gram
    without a letter has the bucket past the last. ``codes`` has 0 for what is no letter, so a word's
    ends show in its grams and all signs look alike."""
    n = len(codes) - (ORDERS - 1)
    out = []
    with np.errstate(over="ignore"):
        key, some = np.zeros(n, np.uint32), np.zeros(n, bool)
        for k in range(ORDERS):
            part = codes[k : k + n]
            key = key * np.uint32(0x01000193) ^ part * np.uint32(0xC2B2AE35)
            some = some | (part > 0)
            out.append(np.where(some, _mixed(key, k), np.uint32(1 << BITS)))
    return out


def segments(texts: list[str | None]):
    """Groups of about WINDOW characters: (codes with separators, where each segment begins, whose it
    is). A longer text is cut in segments that each own the grams beginning in them."""
    group, owners, size = [], [], 0
    for owner, text in enumerate(texts):
        if not text:
            continue
        low = text.lower()
        for at in range(0, len(low), WINDOW):
            stop = min(len(low), at + WINDOW)
            group.append((low[at : stop + ORDERS - 1] + "\n" * (max(0, stop + ORDERS - 1 - len(low))), stop - at))
            owners.append(owner)
            size += stop - at
            if size >= WINDOW:
                yield group, owners
                group, owners, size = [], [], 0
    if group:
        yield group, owners


def _codes(group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer("".join(t for t, _ in group).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([n + ORDERS - 1 for _, n in group])
    starts = np.cumsum(lengths) - lengths
    own = np.ones(len(raw), bool)
    for k in range(1, ORDERS):
        own[starts + lengths - k] = False
    return _letters()[raw], starts, own[: len(raw) - (ORDERS - 1)]


@dataclass
class Model:
    """``weights[language, bucket]`` are log probabilities, 0 in the bucket of no letter; ``priors``
    are the log shares of all documents learned from, of which the weights' counts are a sample."""

    languages: list[str]
    weights: np.ndarray
    priors: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its probability; ``und`` with probability 1 for a
        text that is null or has no letter, and where no language was learned."""
        total = np.zeros((len(texts), len(self.languages)))
        letters = np.zeros(len(texts), np.int64)
        for group, owners in segments(texts):
            codes, starts, own = _codes(group)
            found = grams(codes)
            buckets = [np.where(own, b, np.uint32(1 << BITS)) for b in found]
            owners = np.array(owners)
            np.add.at(letters, owners, np.add.reduceat((buckets[0] != 1 << BITS).astype(np.int64), starts))
            for k in range(len(self.languages)):
                row = self.weights[k]
                np.add.at(total[:, k], owners, np.add.reduceat(sum(row[b] for b in buckets), starts, dtype=np.float64))
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.ones(len(texts))
        total += self.priors
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        known = letters > 0
        return [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known)], np.where(known, score, 1.0)


def learnable(id_column: str = "doc_id", folds: int = 5, held_out: int = 0) -> Column:
    """True for rows that a fold may learn from; a row without an id isn't learned from."""
    fold = F.crc32(F.col(id_column).cast("string")) % folds
    return F.coalesce(fold != held_out, F.lit(False))


def fit(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", per_language: int = 4000, smoothing: float = 0.05, tasks: int = 8, most_languages: int = 512) -> Model:
    """Fits on about ``per_language`` documents of each language, chosen by a hash of the id; all of
    a language that has fewer. Rows whose text, label or id is null are not learned from.

    The sample is the only part that is bounded; each of its texts counts whole, and the priors are the
    languages' shares of all documents. Counts of (language, bucket) are summed by Spark and only their
    matrix reaches the driver. That matrix and each task's counts have 65,537 numbers a language; more
    than ``most_languages`` labels are refused before any is counted. An empty table gives a model that
    answers ``und``; columns other than those named don't matter.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(label_column).alias("label")).where("id IS NOT NULL AND text IS NOT NULL AND label IS NOT NULL")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} labels: not a table of languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, (1 << BITS) + 1), np.float32), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / sizes[k]))])
    lot = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(lot < share[F.col("label")]).select("label", "text").repartition(tasks)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tally = sums.setdefault(label, np.zeros((1 << BITS) + 1, np.int64))
                for group, _ in segments([text]):
                    codes, _, own = _codes(group)
                    for b in grams(codes):
                        tally += np.bincount(b[own], minlength=(1 << BITS) + 1)
        for label, tally in sums.items():
            # The bucket of no letter is not a gram.
            tally[1 << BITS] = 0
            at = np.flatnonzero(tally)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(tally[at], pa.int64())], names=["label", "bucket", "n"])

    found = sample.mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), (1 << BITS) + 1))
    rank = {k: i for i, k in enumerate(languages)}
    counts[np.array([rank[x] for x in found.column("label").to_pylist()], np.int64), found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    counts = counts[:, :-1]
    weights = np.log(counts + smoothing) - np.log(counts.sum(axis=1, keepdims=True) + smoothing * counts.shape[1])
    weights = np.concatenate([weights, np.zeros((len(languages), 1))], axis=1).astype(np.float32)
    documents = np.array([sizes[k] for k in languages], float)
    return Model(languages, weights, np.log(documents / documents.sum()))


def predictor(spark, model: Model):
    """A column function: text -> struct(lang_pred, score). The model is broadcast; its size is the
    number of languages times 2**16 buckets of 4 bytes."""
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        langs, scores = held.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))

    return predict


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row. Null ids and repeated rows stay as they are; the
    score is a probability; a text that is null or has no letter is ``und`` with score 1."""
    return docs.select(F.col(id_column).alias("doc_id"), predictor(docs.sparkSession, model)(F.col(text_column)).alias("p")).select("doc_id", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, model: Model, text_column: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose language is determined with a probability of at least ``least``; all columns
    as they were."""
    p = predictor(docs.sparkSession, model)(F.col(text_column))
    return docs.where((p["lang_pred"] != UNDETERMINED) & (p["score"] >= least))
