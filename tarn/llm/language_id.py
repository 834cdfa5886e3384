"""Language identification by rank-order n-gram profiles.

A profile lists the PROFILE most frequent n-grams (1 to 3 letters, a mark
standing for the edge of a word) by falling count, ties by code points. A
document has the language whose profile is nearest by out-of-place distance: the
differences of ranks summed, PROFILE for an n-gram that the language's profile
lacks; ties go to the language that is first by code point.

N-grams are integers of three 21-bit letters, so counting is sorting. Profiles
are learned from all training rows: tasks send (language, n-gram, count) sums,
and the driver gets at most PROFILE n-grams for each of SALTS parts of a
language's n-grams, at most MAX_LANGUAGES languages (more raise an error).

Defined results: a null text or one without letters is ``und`` with score 0, as is
every text when nothing could be learned. The score is 1 - distance / the largest
possible distance. Rows without a language teach nothing. Whole texts are read,
in pieces of PIECE characters for counting. Other columns are not read.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, pieces

PROFILE = 300
SALTS = 16
MAX_LANGUAGES = 10_000
PIECE = 1 << 22
HELD = 4 << 20
BATCH_BYTES = 2 << 20
BITS = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    out = np.zeros(sys.maxunicode + 1, bool)
    for i in range(sys.maxunicode + 1):
        out[i] = unicodedata.category(chr(i))[0] == "L"
    return out


def ngrams(text: str) -> np.ndarray:
    """All n-grams of the text's words, as integers; 1 marks an edge."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    a = np.where(letter, points, 1).astype(np.int64)
    a = np.concatenate([[1], a, [1]])
    keep = np.concatenate([[True], (a[1:] != 1) | (a[:-1] != 1)])
    a = a[keep]
    one = a[a != 1] << 2 * BITS
    two = (a[:-1] << 2 * BITS) | (a[1:] << BITS)
    three = ((a[:-2] << 2 * BITS) | (a[1:-1] << BITS) | a[2:])[a[1:-1] != 1]
    return np.concatenate([one, two, three])


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text and how often each occurs; long texts in pieces that end at a non-letter."""
    if len(text) <= PIECE:
        return np.unique(ngrams(text), return_counts=True)
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end].isalpha():
            end += 1
        parts.append(np.unique(ngrams(text[at:end]), return_counts=True))
        at = end
    return _summed([p[0] for p in parts], [p[1] for p in parts])


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    grams, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(grams), np.int64)
    np.add.at(total, where, np.concatenate(n))
    return grams, total


def ranked(grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The profile: the most frequent n-grams in order."""
    return grams[np.lexsort((grams, -n))[:PROFILE]]


def _teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "gram", "n"]
    by: dict[str, list] = {}
    held: dict[str, int] = {}

    def out(lang: str) -> pa.RecordBatch:
        grams, n = _summed(*zip(*by.pop(lang), strict=True))
        held[lang] = 0
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(n)], names)

    for batch in batches:
        for piece in pieces(batch, 1, BATCH_BYTES):
            for lang, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                grams, n = counts(text)
                by.setdefault(lang, []).append((grams, n))
                held[lang] = held.get(lang, 0) + len(grams)
                if held[lang] > HELD // 4 or sum(held.values()) > HELD:
                    yield out(lang)
    for lang in sorted(by):
        yield out(lang)


def learn(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """A profile for each language of the rows where ``train`` holds."""
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sums = in_batches(rows, _teach, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    salted = sums.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS)))
    best = salted.withColumn("r", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= PROFILE)
    found: dict[str, list] = {}
    for lang, gram, n in best.select("lang", "gram", "n").toLocalIterator():
        found.setdefault(lang, []).append((gram, n))
        if len(found) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {lang: ranked(*(np.array(c, np.int64) for c in zip(*pairs, strict=True))) for lang, pairs in sorted(found.items())}


def nearest(text: str | None, profiles: list[tuple[str, np.ndarray, np.ndarray]]) -> tuple[str, float]:
    """Language and score by out-of-place distance; profiles hold sorted n-grams and their ranks."""
    if not text or not profiles:
        return "und", 0.0
    grams, n = counts(text)
    if not len(grams):
        return "und", 0.0
    own = ranked(grams, n)
    place = np.arange(len(own))
    best = None
    for lang, keys, ranks in profiles:
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        distance = int(np.where(keys[at] == own, np.abs(ranks[at] - place), PROFILE).sum())
        if best is None or distance < best[0]:
            best = (distance, lang)
    return best[1], 1 - best[0] / (PROFILE * len(own))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score."""
    ready = [(lang, np.sort(p), np.argsort(p, kind="stable")) for lang, p in sorted(profiles.items()) if len(p)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [nearest(t, ready) for piece in pieces(batch, 1, BATCH_BYTES) for t in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b[0] for b in both], pa.string()), pa.array([b[1] for b in both], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_batches(rows, run, "doc_id long, lang_pred string, score double")
