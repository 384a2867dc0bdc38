"""BPE encoding and decoding with a contiguous rank array.

A pre-token is a list of parts and, beside it, the list of the ranks of neighbouring parts. The least
rank is found by a scan, the boundary it stands for is deleted, and the one or two ranks next to it
are looked up anew. For a word of a few dozen parts that beats any queue; longer pre-tokens, whose
scans would cost the square of their length, use a queue over a linked list and give the same parts.
"""

from __future__ import annotations

import hashlib
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkTable, specification
from .shared import alone, small_batches

#: Parts up to which a pre-token is scanned.
SCANNED = 128
#: Rank of a pair that no merge joins.
NEVER = 1 << 62


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where
    Latin-1 prints it, else the next one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class _Settled(dict):
    """Character -> whether its classes are settled: it stands in Unicode 3.2, the oldest tables that
    Python has. Case, category and composition of such characters are the same in Python's tables and
    in the library's older ones; of later characters (combining marks above all) they may not be."""

    def __missing__(self, c: str) -> bool:
        self[c] = known = unicodedata.ucd_3_2_0.category(c) != "Cn"
        return known


_SETTLED = _Settled()


class Codec:
    """Encodes and decodes as the tokenizers library does with a BPE file of this make: NFC, white
    space squeezed, lower case; pre-tokens by the file's pattern; byte-level letters; an end-of-word
    mark on the last of a pre-token; merges by rank, the leftmost first; no decoder. Special tokens
    in a text are recognised as such; none are added."""

    def __init__(self, path: str):
        spec = specification(path)
        model = spec["model"]
        self.path, self.rules = path, None
        self.vocabulary = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocabulary | self.special).items()}
        self.ending = model["end_of_word_suffix"]
        self.letters = byte_letters()
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.parting = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.ranks: dict[tuple[int, int], int] = {}
        self.joined: list[int] = []
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks[self.vocabulary[a], self.vocabulary[b]] = rank
            self.joined.append(self.vocabulary[a + b])
        self.table = ChunkTable(self._chunks, top=max(self.tokens))

    def merge(self, parts: list[int]) -> list[int]:
        """Merges the parts of one pre-token."""
        if len(parts) > SCANNED:
            return self._merge_long(parts)
        get, joined = self.ranks.get, self.joined
        ranks = [get(pair, NEVER) for pair in zip(parts, parts[1:])]
        while ranks:
            rank = min(ranks)
            if rank == NEVER:
                break
            i = ranks.index(rank)
            parts[i] = joined[rank]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), NEVER)
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), NEVER)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        queue = [(rank, i) for i, pair in enumerate(zip(parts, parts[1:])) if (rank := self.ranks.get(pair)) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if parts[i] < 0 or j < 0 or self.ranks.get((parts[i], parts[j])) != rank:
                continue
            parts[i], parts[j], after[i] = self.joined[rank], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 <= b and (found := self.ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(queue, (found, a))
        return [p for p in parts if p >= 0]

    def _words(self, text: str):
        """The pre-tokens of a text, in byte-level letters."""
        if not text.isascii() and not all(map(_SETTLED.__getitem__, text)):
            # The library's own tables decide on order, case and class.
            if self.rules is None:
                from tokenizers import Tokenizer

                self.rules = Tokenizer.from_file(self.path)
            return [w for w, _ in self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(text))]
        # Case by character, as the library maps it: no final sigma.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return ["".join([self.letters[b] for b in word.encode()]) for word in self.pattern.findall(text)]

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        for word in self._words(text):
            letters = list(word)
            letters[-1] += self.ending
            out += self.merge([self.vocabulary[x] for x in letters])
        return out

    def encode_chunk(self, chunk: str) -> list[int]:
        """The ids of a text without white space."""
        if self.parting is None or not any(s in chunk for s in self.special):
            return self._plain(chunk)
        return [i for piece in self.parting.split(chunk) if piece for i in ([self.special[piece]] if piece in self.special else self._plain(piece))]

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [self.encode_chunk(c) for c in chunks]
        sizes = np.array([len(ids) for ids in found], np.int64)
        return np.array([i for ids in found for i in ids], np.uint32), np.cumsum(sizes) - sizes, sizes

    def encode(self, text: str | None) -> list[int]:
        return self.table.texts([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids, joined by spaces; ids that the vocabulary lacks are left out."""
        return " ".join([t for i in ids if (t := self.tokens.get(i)) is not None])


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per Python worker and file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False, slice_rows: int = 256) -> DataFrame:
    """Encodes every whole text, decodes the ids, and returns per row ``doc_id, n_tokens, ids_sha256,
    decoded_sha256``; with ``with_ids`` also ``ids array<int>`` and ``decoded string``.

    The digests are of the decimal ids joined by one space and of the decoded text in UTF-8. A null
    or empty text has no ids and decodes to the empty text. Rows stand for themselves: null ids and
    repeated rows are returned as they are. Columns other than the two named don't matter. No row
    meets another, so nothing is shuffled.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * with_ids
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    small_batches(docs.sparkSession)

    def run(batches):
        alone("bpe", _CODECS.clear)
        own = codec(vocabulary)
        numerals = [str(i) for i in range(own.table.top + 1)]
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                here = batch.slice(at, slice_rows)
                flat, bounds = own.table.texts(here.column(1).to_pylist())
                rows = []
                for name, low, high in zip(here.column(0).to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                    ids = flat[low:high].tolist()
                    text = own.decode(ids)
                    digests = hashlib.sha256(" ".join([numerals[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
                    rows.append((name, len(ids), *digests, *([ids, text] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], schema=pa.schema(fields))

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, schema)
