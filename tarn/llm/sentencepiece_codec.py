"""SentencePiece encoding that keeps offsets, and decoding.

Normalisation walks the text with the longest prefixes of the model's compiled
character map (a double-array trie) and records which source byte each
normalised byte comes from. The normalised text is cut where no piece of the
vocabulary can reach across, every segment is encoded once and remembered, and
the byte lengths of the pieces, summed up, project each piece through the
alignment to its span in the original UTF-8 bytes.

Cuts are exact for BPE: a merge makes a vocabulary piece, so if no piece holds
the two characters beside a cut, nothing merges over it.

Defined results: a null text counts as empty; an empty text gives the begin and
end ids alone, with empty spans. Texts of any length are encoded whole.
Repeated rows give repeated results; other columns are not read. The cache of
words is cleared beyond CACHE_WORDS entries, which changes no result.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, pieces

SPACE = "▁"
LETTER = "[A-Za-zÀ-ɏ]"
#: Marks a part that is normalised already; words of ordinary texts never begin with it.
DONE = SPACE
CACHE_WORDS = 200_000
BATCH_BYTES = 3 << 20


class CharacterMap:
    """Longest-prefix replacement by a compiled character map: four bytes of trie size, the trie, then replacements ending in NUL."""

    def __init__(self, blob: bytes):
        self.empty = not blob
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.replacements = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at ``at``, and what replaces it."""
        units, best, node = self.units, None, 0
        node ^= self._offset(units[0])
        for i in range(at, len(text)):
            byte = text[i]
            node ^= byte
            if node >= len(units) or units[node] & 0x800000FF != byte:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                best = (i + 1 - at, self.replacements[value : self.replacements.index(b"\0", value)])
        return best

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)


class Normalizer:
    """Text to normalised text, with the source byte of every normalised byte."""

    def __init__(self, spec, user_defined: list[str] = ()):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix = spec.add_dummy_prefix
        self.squeeze = spec.remove_extra_whitespaces
        self.escape = spec.escape_whitespaces
        self.kept = sorted((p.encode() for p in user_defined), key=len, reverse=True)
        self.plain = self.map.empty and not self.squeeze and self.escape and not self.kept

    def text(self, text: str) -> str:
        """The normalised text alone."""
        if self.plain:
            return (SPACE * self.prefix + text.replace(" ", SPACE)) if text else ""
        return self.aligned(text)[0]

    def aligned(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the offset of its source byte."""
        raw = text.encode()
        if not raw:
            return "", np.zeros(1, np.int64)
        if self.plain:
            of = np.frombuffer(raw, np.uint8)
            widths = np.where(of == 0x20, 3, 1)
            source = np.repeat(np.arange(len(raw)), widths)
            return self.text(text), np.concatenate([np.zeros(3 * self.prefix, np.int64), source, [len(raw)]])
        parts: list[tuple[bytes, int, int]] = []
        at = 0
        while at < len(raw):
            length, new = self._step(raw, at)
            parts.append((new, at, length))
            at += length
        if self.squeeze:
            parts = self._squeezed(parts)
            if not parts:
                return "", np.zeros(1, np.int64)
        mark = SPACE.encode() if self.escape else b" "
        out, source = bytearray(mark * self.prefix), [parts[0][1]] * (len(mark) * self.prefix)
        for new, begin, length in parts:
            step = [begin + min(i, length - 1) if len(new) == length else begin for i in range(len(new))]
            for byte, place in zip(new, step, strict=True):
                if byte == 0x20:
                    out += mark
                    source += [place] * len(mark)
                else:
                    out.append(byte)
                    source.append(place)
        source.append(parts[-1][1] + parts[-1][2])
        return out.decode(), np.array(source, np.int64)

    def _step(self, raw: bytes, at: int) -> tuple[int, bytes]:
        for piece in self.kept:
            if raw.startswith(piece, at):
                return len(piece), piece
        if not self.map.empty and (found := self.map.longest(raw, at)):
            return found
        first = raw[at]
        length = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return length, raw[at : at + length]

    @staticmethod
    def _squeezed(parts):
        out = []
        for new, begin, length in parts:
            if (not out or out[-1][0].endswith(b" ")) and new.startswith(b" "):
                new = new.lstrip(b" ")
            if new:
                out.append((new, begin, length))
        while out and out[-1][0].endswith(b" "):
            new, begin, length = out.pop()
            if new := new.rstrip(b" "):
                out.append((new, begin, length))
        return out


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            blob = f.read()
        model = sentencepiece_model_pb2.ModelProto.FromString(blob)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        user = [p.piece for p in model.pieces if p.type == p.USER_DEFINED]
        self.normalizer = Normalizer(model.normalizer_spec, user)
        pieces = [p.piece for p in model.pieces if p.type in (p.NORMAL, p.USER_DEFINED)]
        safe_space = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.cut_lines = not any("\n" in p for p in pieces)
        self.cuts = model.trainer_spec.model_type == model.trainer_spec.BPE and safe_space and not user and not model.trainer_spec.treat_whitespace_as_suffix
        line = "\n" if self.cut_lines else ""
        stops = "".join(c for c in ".,;:" if not any(re.search(f"{LETTER}{re.escape(c)}", p) for p in pieces))
        word = f"{SPACE}*{LETTER}++(?=[{stops}])|" if stops else ""
        self.segment = re.compile(f"{word}{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + ("|\n" if line else ""))
        spec = model.normalizer_spec
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, True
        core = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.core = core
        self.words: dict[str, bytes] = {}
        self.widths = np.array([1 if p.type == p.BYTE else 0 if p.type == p.CONTROL else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.unknown = self.library.unk_id()
        self.ends = [np.array([i], "<u4").tobytes() for i in (self.library.bos_id(), self.library.eos_id())]
        raw = [bytes([int(p.piece[3:-1], 16)]) if p.type == p.BYTE else b"" if p.type == p.CONTROL else p.piece.encode() for p in model.pieces]
        self.bytes, self.lengths = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        self.simple = spec.escape_whitespaces and self.normalizer.prefix and not model.denormalizer_spec.precompiled_charsmap

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """All ids of each text, with begin and end."""
        ordinary = [self._ordinary(t) for t in texts]
        split = pc.split_pattern(pa.array([t if o else None for t, o in zip(texts, ordinary, strict=True)], pa.large_string()), " ")
        other = pa.array([None if o else self._parts(t) for t, o in zip(texts, ordinary, strict=True)], pa.large_list(pa.large_string()))
        coded = pa.concat_arrays([split.cast(other.type).flatten(), other.flatten()]).dictionary_encode()
        table = [*self._encoded(coded.dictionary.to_pylist()), *self.ends]
        counts = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (split, other)]
        lists, at = [], [0, int(counts[0].sum())]
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for k, o in enumerate(ordinary):
            n = int(counts[not o][k])
            lists.append(index[at[not o] : at[not o] + n])
            at[not o] += n
        flat = np.frombuffer(b"".join(table), "<u4")
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        starts = np.cumsum(sizes) - sizes
        begin, end = np.array([len(table) - 2]), np.array([len(table) - 1])
        rows = np.concatenate([x for own in lists for x in (begin, own, end)]) if lists else begin[:0]
        docs = np.concatenate([[0], np.cumsum([len(x) + 2 for x in lists])]).astype(np.int64)
        all_ids, bounds = _gather(flat, starts, sizes, rows)
        bounds = bounds[docs]
        return [all_ids[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]

    def _ordinary(self, text: str) -> bool:
        """Whether the words between single spaces can be encoded one by one, each behind a space mark."""
        plain = self.cuts and self.normalizer.plain and self.normalizer.prefix
        return bool(plain and text and SPACE not in text and "  " not in text and text[-1] != " " != text[0])

    def _parts(self, text: str) -> list[str]:
        """Normalised text in parts that can be encoded one by one, each marked as normalised."""
        normal = self.normalizer.text(text)
        return [DONE + p for p in (self.segment.findall(normal) if self.cuts else [normal] if normal else [])]

    def _encoded(self, words: list[str]) -> list[bytes]:
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        found = list(map(self.words.get, words))
        new = [i for i, x in enumerate(found) if x is None]
        ready = [words[i][len(DONE) :] if words[i].startswith(DONE) else SPACE + words[i] for i in new]
        for i, ids in zip(new, self.core.encode(ready, num_threads=1), strict=True):
            found[i] = struct.pack(f"<{len(ids)}I", *ids)
            if len(words[i]) <= 64:
                self.words[words[i]] = found[i]
        return found

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of every piece in the text's UTF-8 bytes; begin and end ids have empty spans."""
        normal, source = self.normalizer.aligned(text)
        widths = self.widths[ids]
        if (ids == self.unknown).any():
            widths = self._unknown_widths(normal, ids, widths)
        stop = np.cumsum(widths)
        return source[stop - widths], source[stop]

    def _unknown_widths(self, normal: str, ids: np.ndarray, widths: np.ndarray) -> np.ndarray:
        """An unknown id stands for one character or a run of them: what lies before the next known piece."""
        raw, out, at = normal.encode(), widths.copy(), 0
        pieces = [self.library.id_to_piece(int(i)).encode() for i in ids]
        for k, i in enumerate(ids):
            if i == self.unknown:
                following = next((p for p, j in zip(pieces[k + 1 :], ids[k + 1 :], strict=True) if j != self.unknown and self.widths[j]), b"")
                out[k] = (raw.index(following, at + 1) if following else len(raw)) - at
            at += int(out[k])
        return out

    def decode(self, ids: np.ndarray) -> str:
        """As the library decodes; its bytes are looked up here, and the library itself decodes what is not plain."""
        if self.simple and not (ids == self.unknown).any():
            raw = _gather(self.bytes, np.cumsum(self.lengths) - self.lengths, self.lengths, ids.astype(np.int64))[0].tobytes()
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                return self.library.decode(ids.tolist())
            return text.replace(SPACE, " ").removeprefix(" ")
        return self.library.decode(ids.tolist())


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table's entries of ``rows`` one after another, and where each begins and the last ends."""
    n = sizes[rows]
    bounds = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(starts[rows] - bounds[:-1], n) + np.arange(bounds[-1])], bounds


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _batches(batches: Iterator[pa.RecordBatch], own: Codec):
    """(ids of documents, texts, arrays of ids) of at most BATCH_BYTES bytes, or of one longer text."""
    for batch in batches:
        for piece in pieces(batch, 1, BATCH_BYTES):
            texts = [t or "" for t in piece.column(1).to_pylist()]
            yield piece.column(0).to_pylist(), texts, own.ids(texts)


def _encoder(path: str):
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for keys, texts, ids in _batches(batches, own):
            spans = [own.spans(t, i) for t, i in zip(texts, ids, strict=True)]
            columns = [keys, [len(i) for i in ids], [i.astype(np.int32) for i in ids], [b for b, _ in spans], [e for _, e in spans], [own.decode(i) for i in ids]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_tokens", "ids", "begins", "ends", "decoded"])

    return run


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids, begins and ends (spans in UTF-8 bytes of the text), decoded."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_batches(rows, _encoder(model_path), "doc_id long, n_tokens long, ids array<int>, begins array<long>, ends array<long>, decoded string")


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and spans_sha256 of what ``encode`` returns, and the ids if asked for."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_batches(rows, _digester(model_path, with_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string" + ", ids array<int>" * with_ids)


def _digester(path: str, with_ids: bool):
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for keys, texts, ids in _batches(batches, own):
            rows = []
            for key, text, own_ids in zip(keys, texts, ids, strict=True):
                places = np.stack(own.spans(text, own_ids), 1).astype("<i8").tobytes()
                rows.append((key, len(own_ids), *(hashlib.sha256(x).hexdigest() for x in (own_ids.tobytes(), own.decode(own_ids).encode(), places)), *[own_ids.astype(np.int32)] * with_ids))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run
