"""Exact token ids of whole texts from a table of white-space separated chunks.

For a vocabulary whose normaliser squeezes white space and whose pre-tokenizer drops it, no token,
special token, composition or case mapping spans white space. A text's ids are therefore its chunks'
ids in order, and each distinct chunk needs to be encoded once. ``ChunkTable`` keeps the ids of the
chunks seen so far in one flat array; a batch of texts becomes an index array and one gather.
"""

from __future__ import annotations

import json
import re
from itertools import compress

import numpy as np

from .shared import alone

#: The separators that str.split() knows and the vocabulary's white space does not.
NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Unicode White_Space.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


#: Characters that no plain text holds. Outside these ranges case mapping and
#: composition may depend on neighbours.
NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u024f\u2010-\u2027]")
#: A full stop or comma after a sign belongs to that sign's chunk.
SIGN_STOP = re.compile(r"[^\w\s][.,]")


def _plain(text: str) -> bool:
    if text.isascii():
        return not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text)
    return NOT_PLAIN.search(text) is None


def split_chunks(text: str) -> list[str]:
    """The maximal runs of a text without Unicode white space.

    In a plain text (no special token's opening, which must keep its case, and none of the above)
    they are lower-cased and a last full stop or comma stands alone, which leaves the ids as they
    are and makes the distinct chunks far fewer.
    """
    if "<|" not in text and "_" not in text and _plain(text) and SIGN_STOP.search(text) is None:
        text = f"{text} ".lower()
        return text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ").replace(",\n", " , ").split()
    if NOT_SPACE.search(text) is None:
        return text.split()
    return [c for c in SPACE.split(text) if c]


class ChunkTable(dict):
    """Chunk -> slot. ``encode`` maps a list of distinct chunks to all their ids in one array, and
    where each chunk's begin there and how many they are. ``top`` is the largest id there can be.

    ``limit`` bounds the slots kept between batches: beyond it only chunks met more than once since
    the last such time stay, and none if they are over half. That costs time and changes no result.
    """

    def __init__(self, encode, limit: int = 400_000, top: int = (1 << 32) - 1):
        super().__init__()
        self.encode, self.limit, self.top = encode, limit, top
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.waiting: list[str] = []
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.length, self.slots = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0
        self.met = np.zeros(1 << 14, np.int64)

    def _shrink(self) -> None:
        stay = np.flatnonzero(self.met[: self.slots] > 1)
        if len(stay) > self.limit // 2:
            return self._reset()
        chunks = list(self)
        sizes = self.length[stay]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.start[stay] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        self.clear()
        self.update((chunks[i], k) for k, i in enumerate(stay.tolist()))
        self.flat[: len(ids)], self.used, self.slots = ids, len(ids), len(stay)
        self.start[: len(stay)], self.length[: len(stay)] = ends - sizes, sizes
        self.met[:] = 0
        return None

    def __missing__(self, chunk: str) -> int:
        self[chunk] = slot = self.slots + len(self.waiting)
        self.waiting.append(chunk)
        return slot

    def _fill(self) -> None:
        for at in range(0, len(self.waiting), 4096):
            ids, starts, sizes = self.encode(self.waiting[at : at + 4096])
            while self.used + len(ids) > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            while self.slots + len(sizes) > len(self.start):
                self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
                self.met = np.concatenate([self.met, np.zeros(len(self.met), np.int64)])
            self.flat[self.used : self.used + len(ids)] = ids
            here = slice(self.slots, self.slots + len(sizes))
            self.start[here], self.length[here] = self.used + starts, sizes
            self.used, self.slots = self.used + len(ids), self.slots + len(sizes)
        self.waiting = []

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another (uint32), and where each text's begin, with the
        end as last entry. A null text has no ids."""
        if len(self) > self.limit:
            self._shrink()
        slots: list[int] = []
        ends = [0]
        at = self.__getitem__
        for text in texts:
            if text:
                slots.extend(map(at, split_chunks(text)))
            ends.append(len(slots))
        self._fill()
        index = np.array(slots, np.int64)
        self.met[: self.slots] += np.bincount(index, minlength=self.slots)
        sizes = self.length[index]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        shift = np.repeat(self.start[index] - stops[:-1], sizes)
        return self.flat[shift + np.arange(stops[-1])], stops[np.array(ends)]


def specification(path: str) -> dict:
    """A tokenizers file, after checking that it is of the make that this module rests on: BPE after NFC,
    squeezed white space and lower case; pre-tokens by a pattern that drops white space, then byte-level
    letters; a mark on the last token of a word; no decoder. Another make is refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, normalizer, pre = spec["model"], spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
    steps = [s["type"] for s in normalizer.get("normalizers", ())], [s["type"] for s in pre.get("pretokenizers", ())]
    if model["type"] != "BPE" or steps != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["decoder"] is not None:
        raise ValueError("a vocabulary of another make")
    squeezed, split = normalizer["normalizers"][1], pre["pretokenizers"][0]
    # With "Removed" turned round, the pattern's matches are kept and what lies between them is dropped.
    if squeezed["pattern"] != {"Regex": r"\s+"} or not squeezed["content"].isspace() or split["behavior"] != "Removed" or not split["invert"] or not model["end_of_word_suffix"]:
        raise ValueError("a vocabulary of another make")
    return spec


#: Words of these letters are one pre-token and stay so under composition.
ONE_WORD = re.compile("[a-zß-öø-ÿ]+")

_TABLES: dict = {}


def library_table(path: str) -> ChunkTable:
    """The table of a tokenizers file, encoded by the tokenizers library without added special
    tokens, padding or truncation. One per Python worker and file.

    Plain words go to the library as one text, in which the ids that close a word part them; other
    chunks go one by one.
    """
    alone("chunks", _TABLES.clear)
    if path not in _TABLES:
        from tokenizers import Tokenizer

        ending = specification(path)["model"]["end_of_word_suffix"]
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        tokens = tokenizer.get_vocab(with_added_tokens=True)
        closes = np.zeros(max(tokens.values()) + 1, bool)
        closes[[i for t, i in tokens.items() if t.endswith(ending)]] = True

        def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            plain = np.fromiter((ONE_WORD.fullmatch(c) is not None for c in chunks), bool, len(chunks))
            sizes, starts = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
            words = np.array(tokenizer.encode_batch_fast([" ".join(compress(chunks, plain))], add_special_tokens=False)[0].ids, np.uint32)
            sizes[plain] = np.diff(np.flatnonzero(closes[words]), prepend=-1)
            found = tokenizer.encode_batch_fast(list(compress(chunks, ~plain)), add_special_tokens=False)
            sizes[~plain] = [len(e) for e in found]
            starts[plain] = np.cumsum(sizes[plain]) - sizes[plain]
            starts[~plain] = len(words) + np.cumsum(sizes[~plain]) - sizes[~plain]
            return np.concatenate([words, np.array([i for e in found for i in e.ids], np.uint32)]), starts, sizes

        _TABLES[path] = ChunkTable(encode, top=len(closes) - 1)
    return _TABLES[path]


def default_vocabulary() -> str:
    """Path of the public vocabulary that the queries use; found on each machine by the package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
