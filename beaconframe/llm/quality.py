"""Quality rules: word statistics and the divergence from language references.

A document's histograms of character classes and of common words are compared with
references for each language by Jensen-Shannon distance.  Text that is far from every
language is rejected; texts too short for a histogram are left to the other rules.

Each document is judged by itself in one pass over the scan, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, column

# Rounded relative frequencies of common words in general prose (1 in 1,000
# words), and shares of character classes among visible characters (1 in 1,000).
COMMON_WORDS = {
    "en": {"the": 62, "of": 30, "and": 28, "to": 26, "in": 21, "a": 21, "is": 11, "that": 11, "for": 10, "it": 10, "was": 9, "with": 7, "on": 7, "as": 7, "be": 6, "by": 6, "at": 5, "this": 5, "are": 5, "from": 5},
    "de": {"der": 34, "die": 33, "und": 29, "in": 19, "den": 13, "von": 11, "zu": 11, "das": 10, "mit": 10, "des": 9, "sich": 9, "auf": 9, "für": 9, "ist": 9, "im": 8, "dem": 8, "nicht": 8, "ein": 8, "eine": 7, "auch": 5},
    "fr": {"de": 48, "la": 30, "le": 24, "et": 22, "les": 20, "des": 18, "en": 14, "un": 13, "du": 13, "une": 12, "que": 10, "est": 9, "pour": 9, "qui": 8, "dans": 8, "par": 7, "sur": 6, "au": 6, "pas": 6, "avec": 5},
    "es": {"de": 63, "la": 38, "que": 31, "el": 29, "en": 26, "y": 26, "a": 20, "los": 17, "se": 13, "del": 12, "las": 11, "un": 10, "por": 10, "con": 9, "no": 9, "una": 8, "su": 8, "para": 7, "es": 7, "lo": 5},
}
CLASSES = ("lower", "upper", "other_letter", "digit", "sentence_mark", "symbol")
CLASS_SHARES = {
    "en": (930, 30, 0, 10, 30, 0),
    "de": (890, 55, 15, 10, 30, 0),
    "fr": (900, 30, 30, 10, 30, 0),
    "es": (910, 25, 25, 10, 30, 0),
}
_SENTENCE_MARKS = b".,;:!?'\"()-"
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"


@cache
def _byte_class() -> np.ndarray:
    """The class of each UTF-8 byte: a lead byte stands for its character, the bytes after it for none."""
    of = np.full(256, len(CLASSES) - 1, np.uint8)
    for chars, k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 3), (_SENTENCE_MARKS, 4), (bytes(range(0x80, 0xC0)) + bytes(range(33)) + b"\x7f", len(CLASSES))):
        of[list(chars)] = k
    of[0xC0:] = 2
    return of


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """The square root of the Jensen-Shannon divergence in bits: 0 for equal, 1 for disjoint histograms."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda x: float(np.sum(x * np.log2(np.divide(x, m, out=np.ones_like(x), where=x > 0))))
    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def repeated_words(words: list, width: int = 5) -> int:
    """Words in windows of ``width`` words that are found twice or more, the first included.

    Words become numbers, and windows become exact numbers by pairing ranks, so that no
    hash can join different windows.
    """
    if len(words) <= width:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
    n, base = len(words) - width + 1, np.uint64(len(number))
    key, top = ids[:n].copy(), len(number)
    for k in range(1, width):
        if top * len(number) >= 1 << 63:
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
            top = int(key.max()) + 1
        key, top = key * base + ids[k : n + k], top * len(number)
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[at] > 1
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : n + k] |= twice
    return int(covered.sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    word_chars = len(text) - sum(map(text.count, _SPACES))
    n_dup, seen = 0, set()
    for line in text.split("\n"):
        if line in seen:
            n_dup += bool(line.strip(_SPACES))
        else:
            seen.add(line)
    return len(words), word_chars, sum(map(text.count, _SYMBOLS)), n_dup, repeated_words(words)


def divergence(text: str | None) -> float:
    """The smallest mean distance to a language: of the character classes and of the common words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    classes = np.bincount(_byte_class()[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)].astype(float)
    if not classes.sum():
        return 1.0
    counts: dict[str, int] = {}
    words = (text or "").lower().split()
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    best = 1.0
    for lang, common in COMMON_WORDS.items():
        got = np.array([counts.get(w, 0) + counts.get(w + ",", 0) + counts.get(w + ".", 0) for w in common], float)
        want = np.array([*common.values()], float)
        far = js_distance(np.append(got, max(0.0, len(words) - got.sum())), np.append(want, 1000 - want.sum()))
        best = min(best, (js_distance(classes, np.array(CLASS_SHARES[lang], float)) + far) / 2)
    return best


def judge_quality(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_divergence: float = 0.22,
    noise: float = 0.5,
    min_words: int = 50,
    keep_rows: bool = False,
) -> DataFrame:
    """Statistics and verdict of each document, or with ``keep_rows`` the rows that are kept.

    base_failed: under 10 words, or over a fifth of the words in repeated 5-word windows.
    kept is false if base_failed, or if the text has at least ``min_words`` words and its
    distance to the nearest language reference is over ``max_divergence`` plus ``noise`` /
    sqrt(words), for a histogram of few words is far from any reference by chance;
    divergence is null for texts below that length.

    Null and empty texts have no words and fail.  Null ids and repeated rows are judged row
    by row, an empty table gives no rows, and with ``keep_rows`` all columns pass through,
    whatever their names.
    """

    def judged(text: str | None) -> tuple:
        n, *rest = text_stats(text)
        failed = n < 10 or 100 * rest[-1] > 20 * n
        far = divergence(text) if n >= min_words and not (failed and keep_rows) else None
        return n, *rest, failed, not failed and (far is None or far <= max_divergence + noise / n**0.5), far

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            got = [judged(t) for t in column(batch, text_col).to_pylist()]
            if keep_rows:
                yield batch.filter(pa.array([x[6] for x in got], pa.bool_()))
                continue
            cols = list(zip(*got, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            arrays = [column(batch, id_col), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "divergence"])

    if keep_rows:
        return docs.mapInArrow(rows, docs.schema)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        rows, f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, divergence double"
    )
