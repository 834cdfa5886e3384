"""Edit-aware token counts: a segment tree over each document's pre-tokens.

Byte-level BPE never merges across pre-tokens, so a document's count is the sum
of its pre-tokens' counts. Leaves hold pre-tokens, one each when a text is first read; every node above
holds the characters and the tokens of its FAN children. An edit replaces a span of characters: the tree is descended by
characters to the leaf where it begins, only the pre-tokens that it
touches and the context beside them are split and encoded again, until old and
new boundaries meet, and only the sums on the paths above these leaves change. New pre-tokens go into the leaves whose own they
replace, so no other leaf moves; a leaf that comes to hold more than LEAF is dealt out by growing the tree anew,
which LEAF pre-tokens pay for. An edit thus costs its own size and a path, however long the text and however many edits came before.

Boundaries meet where a pre-token begins, in the old text and the new one, behind a
whole pre-token that lies beyond the edit: splitting goes from left to right and looks
ahead at most one character beyond the white space that follows.

Defined results: a null text counts as empty (no tokens); an edit beyond the text's end appends; edits of a
document apply from the last to the first by their place in the original text, and edits
that overlap an earlier one (by start, then end) raise ValueError. Texts are whole; the
cache of pre-token counts is cleared beyond CACHE entries, which changes no result.
Rows that repeat an id are rows of their own. Other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, pieces

CACHE = 500_000
LOOK_BACK = 2
AHEAD = 4
FAN = 16
LEAF = 64
BATCH_BYTES = 2 << 20
PRETOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EMAIL = regex.compile(r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
RUN = regex.compile(r"\s{2,}")


class Counter:
    """Token counts of pre-tokens, by the ranks of a vocabulary file."""

    def __init__(self, path: str, pattern: str = PRETOKEN):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, parts: list[str]) -> np.ndarray:
        known = self.known
        new = set(parts).difference(known)
        if len(known) + len(new) > CACHE:
            known.clear()
            new = set(parts)
        encode = self.encoding.encode_ordinary
        for part in new:
            known[part] = len(encode(part))
        return np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))

    def few(self, parts: list[str]) -> list[int]:
        """The same for some pre-tokens, most of them known."""
        try:
            return [self.known[p] for p in parts]
        except KeyError:
            return self.counts(parts).tolist()


class Document:
    """A text as the leaves of a segment tree."""

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        parts = counter.split.findall(text)
        self.encoded = len(parts)
        self.leaves: list[list[str]] = []
        self.levels: list[tuple[list[int], list[int]]] = []
        self._whole: tuple[list[str], np.ndarray] | None = (parts, counter.counts(parts))  # the tree grows with the first edit

    def _grow(self, parts: list[str], tokens: np.ndarray) -> None:
        """A leaf for each pre-token, and the sums above."""
        self.leaves = [[p] for p in parts] or [[]]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) if parts else np.zeros(1, np.int64)
        tokens = tokens if parts else np.zeros(1, np.int64)
        self.levels = [(sizes.tolist(), tokens.tolist())]
        while len(sizes) > 1:
            starts = np.arange(0, len(sizes), FAN)
            sizes, tokens = np.add.reduceat(sizes, starts), np.add.reduceat(tokens, starts)
            self.levels.append((sizes.tolist(), tokens.tolist()))
        self._whole = None

    @property
    def tokens(self) -> int:
        return int(self._whole[1].sum()) if self._whole else self.levels[-1][1][0]

    @property
    def parts(self) -> list[str]:
        return self._whole[0] if self._whole else [p for leaf in self.leaves for p in leaf]

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at a place, and where that leaf begins; the last one that is not empty, for the text's end."""
        place = max(0, min(place, self.levels[-1][0][0] - 1))
        node, begin = 0, 0
        for sizes, _ in reversed(self.levels[:-1]):
            node *= FAN
            while node < len(sizes) - 1 and begin + sizes[node] <= place:
                begin += sizes[node]
                node += 1
        return node, begin

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from ``start`` to ``end`` and update counts along the paths above them."""
        if self._whole:
            self._grow(*self._whole)
        total = self.levels[-1][0][0]
        start, end = min(start, total), min(max(start, end), total)
        # from LOOK_BACK pre-tokens before the one where the edit begins
        first, begin = self._leaf_at(start)
        kept = self.leaves[first]
        inside = _upto(kept, start - begin)
        sizes = self.levels[0][0]
        while inside < LOOK_BACK and begin > 0:
            if sizes[first - 1]:
                first, begin = first - 1, begin - sizes[first - 1]
            else:
                first, begin = self._leaf_at(begin - 1)
            inside += len(self.leaves[first])
        head = self.leaves[first][: max(0, inside - LOOK_BACK)]
        at = begin + sum(map(len, head))
        # old pre-tokens from there to some way beyond the edit; more of them until boundaries meet
        old: list[str] = self.leaves[first][len(head) :]
        last, reach, more = first, at + sum(map(len, old)), AHEAD
        while True:
            wanted = 0
            while last + 1 < len(self.leaves) and (reach <= end or wanted < more):
                last += 1
                if reach > end:
                    wanted += len(self.leaves[last])
                old += self.leaves[last]
                reach += sizes[last]
            done = last + 1 == len(self.leaves)
            met = self._meet(old, start - at, end - at, new, done)
            if met:
                break
            more *= 2
        fresh, tail = met
        self.encoded += len(fresh)
        self._put(first, last, head, fresh, tail)

    def _meet(self, old: list[str], start: int, end: int, new: str, done: bool) -> tuple[list[str], list[str]] | None:
        """New pre-tokens up to where old and new boundaries meet, and the old ones from there; None if the text read so far is too short to tell."""
        was = "".join(old)
        text = was[:start] + new + was[end:]
        moved, beyond = len(new) - (end - start), start + len(new)
        bounds = {place: k for k, place in enumerate(accumulate(map(len, old), initial=0))}
        # what the text beyond may still change: the last LOOK_BACK pre-tokens, unless nothing follows
        sure = len(old) if done else len(old) - LOOK_BACK
        fresh: list[str] = []
        for match in self.counter.split.finditer(text):
            place = match.start()
            if place > beyond and (k := bounds.get(place - moved)) is not None and end < place - moved:
                return (fresh, old[k:]) if k <= sure else None
            fresh.append(match.group())
        return (fresh, []) if done else None

    def _put(self, first: int, last: int, head: list[str], fresh: list[str], tail: list[str]) -> None:
        """Pre-tokens into the leaves from ``first`` to ``last``, about as many into each."""
        parts = head + fresh + tail
        room = last - first + 1
        over = len(parts) - room
        if over > LEAF:
            every = [p for leaf in self.leaves[:first] for p in leaf] + parts + [p for leaf in self.leaves[last + 1 :] for p in leaf]
            self._grow(every, self.counter.counts(every))
            return
        counts = self.counter.few(parts)
        sizes, tokens = self.levels[0]
        at = 0
        for i in range(first, last + 1):
            take = -(-(len(parts) - at) // (last + 1 - i))
            self.leaves[i] = parts[at : at + take]
            sizes[i], tokens[i] = sum(map(len, self.leaves[i])), sum(counts[at : at + take])
            at += take
        for (sizes, tokens), (above_sizes, above_tokens) in zip(self.levels, self.levels[1:]):
            first, last = first // FAN, last // FAN
            for i in range(first, last + 1):
                above_sizes[i], above_tokens[i] = sum(sizes[FAN * i : FAN * i + FAN]), sum(tokens[FAN * i : FAN * i + FAN])


def _upto(parts: list[str], size: int) -> int:
    """How many pre-tokens begin before a place, or the number of the one that holds it."""
    at = 0
    for k, part in enumerate(parts):
        at += len(part)
        if at > size:
            return k
    return len(parts)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def apply_edits(document: Document, edits: list[tuple[int, int, str]]) -> None:
    """Edits by places in the original text, applied from the last to the first."""
    ordered = sorted(edits)
    for a, b in zip(ordered, ordered[1:]):
        if b[0] < a[1]:
            raise ValueError(f"edits overlap: {a} and {b}")
    for start, end, new in reversed(ordered):
        document.edit(start, end, new)


def cleaning(text: str) -> list[tuple[int, int, str]]:
    """Edits that replace e-mail addresses by a mark and runs of white space by one space or line break, and end the text with a line break."""
    found = [(*m.span(), "[EMAIL]") for m in EMAIL.finditer(text)] if "@" in text else []
    found += [(*m.span(), "\n" if "\n" in m.group() else " ") for m in RUN.finditer(text)]
    return found if text.endswith("\n") else [*found, (len(text), len(text), "\n")]


def recount(docs: DataFrame, vocabulary: str, edits: Callable[[str], list[tuple[int, int, str]]] = cleaning, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, n_edits, n_tokens_after, n_encoded_again (pre-tokens encoded because of edits)."""
    names = ["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_encoded_again"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            for piece in pieces(batch, 1, BATCH_BYTES):
                rows = []
                for key, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    document = Document(text or "", own)
                    before, parts = document.tokens, document.encoded
                    wanted = edits(text or "")
                    apply_edits(document, wanted)
                    rows.append((key, before, len(wanted), document.tokens, document.encoded - parts))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_batches(rows, run, ", ".join(f"{n} long" for n in names))
