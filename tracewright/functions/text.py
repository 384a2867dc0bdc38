"""Text rules of the corpus stage, as expressions. Code points count, as in ``length``."""

from __future__ import annotations

import bisect
import hashlib
import heapq
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Code point ranges of scripts written without spaces.
UNSPACED = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u0e00-\u0e7f\U00020000-\U0002a6df"
#: Code point ranges that a document of a language must show some of.
SCRIPTS = {
    "zh": "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0002a6df",
    "ja": "\u3040-\u30ff\u4e00-\u9fff\u31f0-\u31ff",
    "ko": "\u1100-\u11ff\u3130-\u318f\uac00-\ud7af",
    "ru": "\u0400-\u04ff\u0500-\u052f",
    "uk": "\u0400-\u04ff",
    "bg": "\u0400-\u04ff",
    "ar": "\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufeff",
    "fa": "\u0600-\u06ff\ufb50-\ufdff",
    "ur": "\u0600-\u06ff\ufb50-\ufdff",
    "he": "\u0590-\u05ff\ufb1d-\ufb4f",
    "hi": "\u0900-\u097f\ua8e0-\ua8ff",
    "mr": "\u0900-\u097f",
    "ne": "\u0900-\u097f",
    "bn": "\u0980-\u09ff",
    "ta": "\u0b80-\u0bff",
    "te": "\u0c00-\u0c7f",
    "th": "\u0e00-\u0e7f",
    "el": "\u0370-\u03ff\u1f00-\u1fff",
}
LEAST_SCRIPT, LEAST_UNSPACED = 0.10, 0.20
#: Shingles of words and of characters, sketch and band sizes.
SHINGLE_WORDS, SHINGLE_CHARS, SKETCH, BAND = 5, 12, 16, 4


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def reference_tokens(text: Column) -> Column:
    """A quarter of the code points, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / F.lit(4.0).cast("double")).cast("long"))


def nfc(text: Column) -> Column:
    """Unicode NFC, which Spark has no function for."""

    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else t if t.isascii() else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())

    return run(text)


def normalise_lines(text: Column) -> Column:
    """Line ends to LF, control characters out, trailing space of each line out, runs of blank lines
    to one, outer line ends out; indentation stays."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.regexp_replace(text, "[\\x00-\\x08\\x0b-\\x0c\\x0e-\\x1f\\x7f]", "")
    text = F.regexp_replace(text, "[\\t \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+(?=\n|\\z)", "")
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    return F.regexp_replace(text, "\\A\n+|\n+\\z", "")


def normalise_whitespace(text: Column) -> Column:
    """``normalise_lines`` after NFC. NFC changes neither line ends nor controls, so it may come first
    as the only step that leaves the JVM."""
    return normalise_lines(nfc(text))


def truncated(text: Column, most_tokens: int, slack: float = 0.15) -> Column:
    """The longest prefix within the reference-token cap, drawn back to the last line end, else the
    last space, in its final ``slack`` part, without trailing space; the prefix itself if nothing
    else is left of it. Texts within the cap stay."""
    cap = 4 * most_tokens
    floor = int(cap * (1.0 - slack))

    def drawn_back(cut: Column) -> Column:
        # 0-based place of the last line end and of the last space
        line, space = (F.length(cut) - F.instr(F.reverse(cut), sep) for sep in ("\n", " "))
        good = lambda at, sep: (F.instr(cut, sep) > 0) & (at >= floor) & (at > 0)
        return F.when(good(line, "\n"), F.left(cut, line)).when(good(space, " "), F.left(cut, space)).otherwise(cut)

    trimmed = lambda drawn: let(F.regexp_replace(drawn, "(?U)[\\s\\x1c-\\x1f]+\\z", ""), lambda t: F.when(t == "", drawn).otherwise(t))
    return F.when(F.length(text) <= cap, text).otherwise(let(let(F.left(text, F.lit(cap)), drawn_back), trimmed))


def truncated_by(text: Column, count: Callable[[str], int], most_tokens: int, slack: float = 0.15) -> Column:
    """``truncated`` for a counter of one's own, such as a tokenizer: ``count`` must not fall when a text grows
    and reaches the workers pickled. The longest prefix within the cap is found by bisection; null stays null."""

    def cut(text: str) -> str:
        if count(text) <= most_tokens:
            return text
        prefix = text[: max(0, bisect.bisect_right(range(len(text)), most_tokens, key=lambda n: count(text[:n])) - 1)]
        ends = (prefix.rfind(sep) for sep in "\n ")
        back = next((at for at in ends if at > 0 and at >= int(len(prefix) * (1.0 - slack))), len(prefix))
        return prefix[:back].rstrip() or prefix[:back]

    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else cut(t) for t in texts.to_pylist()], pa.string())

    return run(text)


def length_reason(text: Column, least: int, most: int) -> Column:
    """Why a text is dropped for its length, or null."""
    n = reference_tokens(text)
    blank = ~text.rlike("(?U)[^\\s\\x1c-\\x1f]")
    return F.when(blank, "empty_after_normalise").when(n < least, "too_short").when(n > most, "over_max_tokens")


def class_fraction(text: Column, ranges: str | Column) -> Column:
    """Share of the characters that are not space which lie in the ranges; null for a blank text."""
    ranges = F.lit(ranges) if isinstance(ranges, str) else ranges
    inside = F.length(F.regexp_replace(text, F.concat(F.lit("[^"), ranges, F.lit("]")), F.lit("")))
    return F.try_divide(inside.cast("double"), F.length(F.regexp_replace(text, "(?U)[\\s\\x1c-\\x1f]", "")).cast("double"))


def looks_like(text: Column, lang: Column, least: float = LEAST_SCRIPT) -> Column:
    """Whether a text shows the script of its language; true for languages without an entry, false
    for a blank text of one that has."""
    ranges = F.create_map(*[F.lit(x) for pair in SCRIPTS.items() for x in pair])[lang]
    return F.when(ranges.isNull(), True).otherwise(F.coalesce(class_fraction(text, ranges) >= least, F.lit(False)))


def is_unspaced(text: Column) -> Column:
    """Whether a fifth of the characters belong to scripts without word spaces."""
    return F.coalesce(class_fraction(text, UNSPACED) >= LEAST_UNSPACED, F.lit(False))


#: What parts words in a squeezed text: Unicode white space.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_WORDS, _UNSPACED = re.compile(r"\w+"), re.compile(f"[{UNSPACED}]")


def _units(low: str) -> set[str]:
    """The distinct shingles of a lower-cased text: of words, of characters for unspaced scripts and short
    texts, the whole text where that is shorter than two shingles."""
    words = _WORDS.findall(low)
    solid = 0 if low.isascii() else len(_SPACE.sub("", low))
    if len(words) < SHINGLE_WORDS or (solid and len(_UNSPACED.findall(low)) >= LEAST_UNSPACED * solid):
        q = _SPACE.sub(" ", low).strip(" ")
        return {q} if len(q) < 2 * SHINGLE_CHARS else {q[i : i + SHINGLE_CHARS] for i in range(len(q) - SHINGLE_CHARS + 1)}
    return {" ".join(words[i : i + SHINGLE_WORDS]) for i in range(len(words) - SHINGLE_WORDS + 1)}


def signature(text: Column) -> Column:
    """The smallest MD5 digests of a text's distinct shingles, in order; null for a null text. Only the
    least SKETCH are kept while a text's shingles are gone through, a batch of texts at a time."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        digest = lambda u: hashlib.md5(u.encode(), usedforsecurity=False).hexdigest()
        return pa.array([None if t is None else heapq.nsmallest(SKETCH, map(digest, _units(t))) for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(F.lower(text))


def bands(sketch: Column) -> Column:
    """Whole bands of the sketch as ``number|values``; the whole sketch as band 0 if there is none."""

    def cut(k: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.floor(F.size(k) / BAND).cast("int") - 1), lambda b: F.concat(b.cast("string"), F.lit("|"), F.array_join(F.slice(k, b * BAND + 1, BAND), ",")))
        return F.when(F.size(k) >= BAND, whole).otherwise(F.array(F.concat(F.lit("0|"), F.array_join(k, ","))))

    return let(sketch, cut)


def stratum(domain: Column, lang: Column) -> Column:
    """``domain/lang``, or the domain alone where there is no language."""
    return F.when(F.coalesce(lang, F.lit("")) == "", domain).otherwise(F.concat_ws("/", domain, lang))


def slug(text: Column) -> Column:
    """Every character but letters, numbers, dash and underscore becomes a dash."""
    return F.regexp_replace(text, "[^\\p{L}\\p{N}_-]", "-")
