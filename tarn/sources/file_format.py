"""The SQLite 3 file format: pages, cells and rows of table and index trees, and files written whole.

Reading checks what it relies on and raises FileFormatError; it never follows a tree deeper than
MAX_DEPTH, nor an overflow chain beyond its row. Stored integers keep their sign. Text must be UTF-8.
"""

from __future__ import annotations

import re
import struct
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

from ..errors import FileFormatError
from ..functions.host import order_key

MAGIC = b"SQLite format 3\x00"
# Kinds of pages.
INDEX_INTERIOR, TABLE_INTERIOR, INDEX_LEAF, TABLE_LEAF = 0x02, 0x05, 0x0A, 0x0D
ROWID_MIN, ROWID_MAX = -(2**63), 2**63 - 1
MAX_DEPTH = 64
SPLITS = 64


def varint(data: bytes, at: int) -> tuple[int, int]:
    """An integer of 1 to 9 bytes, seven bits each and eight in the ninth; and where it ends."""
    value = 0
    for k in range(9):
        if at + k >= len(data):
            raise FileFormatError("an integer runs over the end of its page")
        byte = data[at + k]
        if k == 8:
            return value << 8 | byte, at + 9
        value = value << 7 | byte & 0x7F
        if byte < 0x80:
            return value, at + k + 1
    raise AssertionError


def encode_varint(value: int) -> bytes:
    """The shortest such form of 64 bits; negative integers count as their two's complement."""
    value &= 2**64 - 1
    tail = b""
    if value >> 56:
        value, tail = value >> 8, bytes([value & 0xFF])
    groups = range(7 if tail else max(0, (value.bit_length() - 1) // 7), -1, -1)
    out = [value >> 7 * g & 0x7F | 0x80 for g in groups]
    if not tail:
        out[-1] &= 0x7F
    return bytes(out) + tail


def signed(value: int) -> int:
    """A rowid from its 64 bits."""
    return value - (value >> 63 << 64)


_WIDTHS = {1: 1, 2: 2, 3: 3, 4: 4, 5: 6, 6: 8}


@lru_cache(maxsize=4096)
def _layout(head: bytes) -> tuple[tuple[int, int, int], ...]:
    """(kind, begin, end) of each value behind a row's header."""
    out, at, place = [], 0, 0
    while at < len(head):
        kind, at = varint(head, at)
        if kind in (10, 11):
            raise FileFormatError("reserved kind of value")
        size = (kind - 12) // 2 if kind > 11 else 8 if kind == 7 else _WIDTHS.get(kind, 0)
        out.append((kind, place, place + size))
        place += size
    return tuple(out)


def record(data: bytes, wanted: Iterable[int] | None = None) -> list:
    """The values of a row; of the columns ``wanted`` only, if given (None where the row is too short)."""
    wide, at = varint(data, 0)
    if wide > len(data):
        raise FileFormatError("a row's header runs over its end")
    layout = _layout(bytes(data[at:wide]))
    if wanted is not None:
        layout = [layout[k] if k < len(layout) else (0, 0, 0) for k in wanted]
    out = []
    for kind, begin, end in layout:
        if wide + end > len(data):
            raise FileFormatError("a value runs over the end of its row")
        if kind == 0:
            out.append(None)
        elif kind <= 6:
            out.append(int.from_bytes(data[wide + begin : wide + end], "big", signed=True))
        elif kind == 7:
            out.append(struct.unpack_from(">d", data, wide + begin)[0])
        elif kind < 10:
            out.append(kind - 8)
        else:
            part = data[wide + begin : wide + end]
            out.append(part.decode() if kind % 2 else bytes(part))
    return out


def encode_record(values: Iterable) -> bytes:
    """A row, each integer in the least width that holds it."""
    kinds, body = [], []
    for v in values:
        if v is None:
            kinds.append(0)
        elif isinstance(v, float):
            kinds.append(7)
            body.append(struct.pack(">d", v))
        elif isinstance(v, int):
            if v in (0, 1):
                kinds.append(8 + int(v))
                continue
            kind = next((k for k, w in _WIDTHS.items() if -(1 << 8 * w - 1) <= v < 1 << 8 * w - 1), None)
            if kind is None:
                raise FileFormatError(f"{v} does not fit 64 bits")
            kinds.append(kind)
            body.append(v.to_bytes(_WIDTHS[kind], "big", signed=True))
        else:
            part = v.encode() if isinstance(v, str) else bytes(v)
            kinds.append(2 * len(part) + (13 if isinstance(v, str) else 12))
            body.append(part)
    head = b"".join(map(encode_varint, kinds))
    wide = len(head) + 1
    while len(head) + len(encode_varint(wide)) != wide:
        wide = len(head) + len(encode_varint(wide))
    return b"".join([encode_varint(wide), head, *body])


@dataclass(frozen=True)
class Header:
    page_size: int
    usable: int
    encoding: int
    page_count: int = 0

    @classmethod
    def parse(cls, data: bytes) -> Header:
        """The first 100 bytes, checked."""
        if len(data) < 100 or data[:16] != MAGIC:
            raise FileFormatError("not a database file")
        (size,) = struct.unpack_from(">H", data, 16)
        size = 65536 if size == 1 else size
        if size < 512 or size & (size - 1):
            raise FileFormatError(f"page size {size}")
        if data[18] not in (1, 2) or data[19] not in (1, 2):
            raise FileFormatError("unknown format version")
        if tuple(data[21:24]) != (64, 32, 32):
            raise FileFormatError("payload fractions are not 64, 32 and 32")
        schema, encoding = struct.unpack_from(">I", data, 44)[0], struct.unpack_from(">I", data, 56)[0]
        if schema > 4 or encoding > 3:
            raise FileFormatError("unknown schema format or encoding")
        if any(data[72:92]):
            raise FileFormatError("reserved bytes are set")
        if encoding > 1:
            raise FileFormatError("only UTF-8 databases can be read")
        if size - data[20] < 480:
            raise FileFormatError("pages have too little usable space")
        return cls(size, size - data[20], encoding, struct.unpack_from(">I", data, 28)[0])


@dataclass(frozen=True)
class Page:
    """A page's kind, its bytes, the places of its cells, and its right-most child (0 of a leaf)."""

    kind: int
    data: bytes
    places: list[int]
    right: int

    @property
    def interior(self) -> bool:
        return self.kind in (TABLE_INTERIOR, INDEX_INTERIOR)


@dataclass(frozen=True)
class Split:
    """A subtree and the rowids that it may hold."""

    page: int
    low: int
    high: int


class Pages:
    """Random access to the pages of a file: a path, a URI of a file system that pyarrow knows, or bytes in memory."""

    def __init__(self, source: str | bytes):
        if isinstance(source, bytes):
            import io

            self.file = io.BytesIO(source)
        elif re.match(r"[a-z][a-z0-9+.-]*:/", source):
            from pyarrow import fs

            system, inner = fs.FileSystem.from_uri(source)
            self.file = system.open_input_file(inner)
        else:
            self.file = open(source, "rb")  # noqa: SIM115
        self.header = Header.parse(self.file.read(100))

    def __enter__(self) -> Pages:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    @property
    def count(self) -> int:
        """Pages of the file."""
        return self.file.seek(0, 2) // self.header.page_size

    def page(self, number: int) -> bytes:
        """A page as it is."""
        if number < 1:
            raise FileFormatError(f"page {number}")
        self.file.seek((number - 1) * self.header.page_size)
        data = self.file.read(self.header.page_size)
        if len(data) < self.header.page_size:
            raise FileFormatError(f"page {number} lies beyond the end of the file")
        return data

    def parse(self, number: int, index: bool = False) -> Page:
        """A page of a table's tree, or of an index's."""
        data = self.page(number)
        at = 100 if number == 1 else 0
        kind = data[at]
        if kind not in ((INDEX_LEAF, INDEX_INTERIOR) if index else (TABLE_LEAF, TABLE_INTERIOR)):
            raise FileFormatError(f"page {number} is no page of {'an index' if index else 'a table'} (kind {kind})")
        (count,) = struct.unpack_from(">H", data, at + 3)
        wide = 12 if kind in (TABLE_INTERIOR, INDEX_INTERIOR) else 8
        if at + wide + 2 * count > len(data):
            raise FileFormatError(f"page {number} has too many cells")
        places = list(struct.unpack_from(f">{count}H", data, at + wide))
        if any(p >= len(data) or p < at + wide + 2 * count for p in places):
            raise FileFormatError(f"page {number} has a cell outside of its place")
        return Page(kind, data, places, struct.unpack_from(">I", data, at + 8)[0] if wide == 12 else 0)

    def payload(self, data: bytes, at: int, size: int, index: bool = False) -> bytes:
        """A row from its cell and the overflow pages behind it."""
        usable = self.header.usable
        most = (usable - 12) * 64 // 255 - 23 if index else usable - 35
        local = size if size <= most else self._local(size, most)
        if at + local + (4 if local < size else 0) > len(data):
            raise FileFormatError("a row runs over the end of its page")
        if local == size:
            return data[at : at + size]
        parts, left = [data[at : at + local]], size - local
        (following,) = struct.unpack_from(">I", data, at + local)
        while left > 0:
            page = self.page(following)
            (following,) = struct.unpack_from(">I", page)
            parts.append(page[4 : 4 + min(left, usable - 4)])
            left -= len(parts[-1])
        if following:
            raise FileFormatError("an overflow chain goes on beyond its row")
        return b"".join(parts)

    def _local(self, size: int, most: int) -> int:
        least = (self.header.usable - 12) * 32 // 255 - 23
        local = least + (size - least) % (self.header.usable - 4)
        return least if local > most else local

    # trees of tables

    def children(self, page: Page) -> list[tuple[int, int]]:
        """(page, largest rowid) of an interior page's children, in order; none of a leaf."""
        if not page.interior:
            return []
        below = [(struct.unpack_from(">I", page.data, p)[0], signed(varint(page.data, p + 4)[0])) for p in page.places]
        return [*below, (page.right, ROWID_MAX)]

    def page_rows(self, page: Page) -> Iterator[tuple[int, bytes]]:
        """(rowid, row) of a leaf's cells, in order."""
        for k in range(len(page.places)):
            yield self._cell(page, k)

    def _cell(self, page: Page, k: int) -> tuple[int, bytes]:
        size, at = varint(page.data, page.places[k])
        rowid, at = varint(page.data, at)
        return signed(rowid), self.payload(page.data, at, size)

    def _rowid(self, page: Page, k: int) -> int:
        return signed(varint(page.data, varint(page.data, page.places[k])[1])[0])

    def raw_rows(self, root: int, low: int = ROWID_MIN, high: int = ROWID_MAX, reverse: bool = False, depth: int = 0) -> Iterator[tuple[int, bytes]]:
        """(rowid, row) of a tree in order of rowid, or back from its end; subtrees outside of the range are not read."""
        if depth > MAX_DEPTH:
            raise FileFormatError("a tree that contains itself")
        page = self.parse(root)
        turn = reversed if reverse else iter
        if page.interior:
            least, inside = ROWID_MIN, []
            for child, most in self.children(page):
                if most >= low and least <= high:
                    inside.append(child)
                least = most + 1
            for child in turn(inside):
                yield from self.raw_rows(child, low, high, reverse, depth + 1)
            return
        numbers = range(len(page.places))
        first = bisect_left(numbers, low, key=lambda k: self._rowid(page, k)) if low > ROWID_MIN else 0
        last = bisect_left(numbers, high + 1, key=lambda k: self._rowid(page, k)) if high < ROWID_MAX else len(numbers)
        for k in turn(range(first, last)):
            yield self._cell(page, k)

    def rows(self, root: int, low: int = ROWID_MIN, high: int = ROWID_MAX, reverse: bool = False) -> Iterator[tuple[int, list]]:
        """(rowid, values) of a tree in order of rowid, or back from its end."""
        for rowid, row in self.raw_rows(root, low, high, reverse):
            yield rowid, record(row)

    def seek(self, root: int, rowid: int) -> list | None:
        """The values of one row, by a path from the root."""
        return next((values for _, values in self.rows(root, rowid, rowid)), None)

    def splits(self, root: int, want: int = SPLITS) -> list[Split]:
        """Subtrees that cover a tree, with their ranges of rowids; at least ``want`` if the tree has as many pages below one level."""
        out = [Split(root, ROWID_MIN, ROWID_MAX)]
        while len(out) < want:
            deeper = []
            for s in out:
                low, children = s.low, self.children(self.parse(s.page))
                if not children:
                    return out
                for page, high in children:
                    deeper.append(Split(page, low, min(high, s.high)))
                    low = min(high, ROWID_MAX - 1) + 1
            out = deeper
        return out

    # trees of indexes: a row holds the key's values and the rowid, also on interior pages

    def _entry(self, page: Page, k: int) -> list:
        size, at = varint(page.data, page.places[k] + (4 if page.interior else 0))
        return record(self.payload(page.data, at, size, index=True))

    def entries(self, root: int, low: tuple | None = None, high: tuple | None = None, depth: int = 0) -> Iterator[list]:
        """Entries of an index in order, from the key ``low`` to the key ``high``, both inclusive; keys may be shorter than entries."""
        if depth > MAX_DEPTH:
            raise FileFormatError("a tree that contains itself")
        page = self.parse(root, index=True)
        key = lambda k, n: tuple(map(order_key, self._entry(page, k)[:n]))
        numbers = range(len(page.places))
        first = 0
        if low is not None:
            least = tuple(map(order_key, low))
            first = bisect_left(numbers, least, key=lambda k: key(k, len(least)))
        most = None if high is None else tuple(map(order_key, high))
        for k in range(first, len(page.places) + 1):
            if page.interior:
                child = struct.unpack_from(">I", page.data, page.places[k])[0] if k < len(page.places) else page.right
                yield from self.entries(child, low, high, depth + 1)
            if k == len(page.places) or (most is not None and key(k, len(most)) > most):
                return
            yield self._entry(page, k)

    def find(self, root: int, key: tuple) -> list[int]:
        """Rowids of the rows whose key begins with the given values, by paths from the root."""
        return [entry[-1] for entry in self.entries(root, key, key)]


class FileWriter:
    """A database file of tables, each written once from rows in order of rowid; trees grow from their leaves."""

    def __init__(self, page_size: int = 4096):
        self.size, self.pages, self.master = page_size, [b""], []

    def _new(self, data: bytes) -> int:
        self.pages.append(data)
        return len(self.pages)

    def _cell(self, rowid: int, row: bytes) -> bytes:
        most = self.size - 35
        least = (self.size - 12) * 32 // 255 - 23
        local = len(row)
        if local > most:
            local = least + (len(row) - least) % (self.size - 4)
            local = least if local > most else local
        head = encode_varint(len(row)) + encode_varint(rowid)
        if local == len(row):
            return head + row
        parts = [row[at : at + self.size - 4] for at in range(local, len(row), self.size - 4)]
        following = 0
        for part in reversed(parts):
            following = self._new(struct.pack(">I", following) + part.ljust(self.size - 4, b"\0"))
        return head + row[:local] + struct.pack(">I", following)

    def _pack(self, kind: int, cells: list[bytes], right: int | None, offset: int) -> bytes:
        at, places = self.size, []
        for cell in cells:
            at -= len(cell)
            places.append(at)
        head = struct.pack(">BHHHB", kind, 0, len(cells), at % 65536, 0) + (b"" if right is None else struct.pack(">I", right))
        head += struct.pack(f">{len(cells)}H", *places)
        return head + bytes(at - offset - len(head)) + b"".join(reversed(cells))

    def _tree(self, rows: Iterable[tuple[int, bytes]], offset: int = 0) -> bytes:
        """The root page of a tree; all pages below it are added. ``offset`` bytes stand before the root."""
        nodes: list[tuple[int, int]] = []  # page, largest rowid
        cells, room, last = [], self.size - 8, None
        for rowid, row in rows:
            if last is not None and rowid <= last:
                raise FileFormatError("rows are not in order of rowid")
            cell = self._cell(rowid, row)
            if cells and len(cell) + 2 > room:
                nodes.append((self._new(self._pack(TABLE_LEAF, cells, None, 0)), last))
                cells, room = [], self.size - 8
            cells.append(cell)
            room -= len(cell) + 2
            last = rowid
        if not nodes and room >= offset:
            return self._pack(TABLE_LEAF, cells, None, offset)
        nodes.append((self._new(self._pack(TABLE_LEAF, cells, None, 0)), last))
        wide = (self.size - 12) // 15  # a child's number, its rowid and the cell's place
        while len(nodes) > (self.size - 12 - offset) // 15:
            nodes = [(self._new(self._interior(nodes[at : at + wide], 0)), nodes[min(at + wide, len(nodes)) - 1][1]) for at in range(0, len(nodes), wide)]
        return self._interior(nodes, offset)

    def _interior(self, nodes: list[tuple[int, int]], offset: int) -> bytes:
        return self._pack(TABLE_INTERIOR, [struct.pack(">I", page) + encode_varint(rowid) for page, rowid in nodes[:-1]], nodes[-1][0], offset)

    def table(self, name: str, ddl: str, rows: Iterable[tuple[int, Iterable]]) -> None:
        """Add a table of (rowid, values)."""
        root = self._new(self._tree((rowid, encode_record(values)) for rowid, values in rows))
        self.master.append(["table", name, name, root, ddl])

    def finish(self) -> bytes:
        """The whole file."""
        first = self._tree(((k, encode_record(row)) for k, row in enumerate(self.master, 1)), 100)
        head = MAGIC + struct.pack(">HBBBBBBIIIIIIIIIIII", self.size % 65536 or 1, 1, 1, 0, 64, 32, 32, 1, len(self.pages), 0, 0, 1, 4, 0, 0, 1, 0, 0, 0)
        head = head.ljust(92, b"\0") + struct.pack(">II", 1, 3_040_000)
        return b"".join([head, first, *self.pages[1:]])
