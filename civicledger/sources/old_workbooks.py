"""The old binary workbook: sectors chained in a compound file, and in its workbook stream a row of records."""

from __future__ import annotations

import struct
from collections.abc import Iterator

#: How a compound file begins, sector numbers from which on there is no sector, and records of the workbook stream.
MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
NO_SECTOR = 0xFFFFFFFA
BOF, EOF, CONTINUE, PASSWORD, SHEET, STRINGS = 0x809, 0x0A, 0x3C, 0x2F, 0x85, 0xFC
STRING_CELL, NUMBER, RK, MANY_RK, LABEL, FORMULA, FORMULA_TEXT, TRUTH = 0xFD, 0x203, 0x27E, 0xBD, 0x204, 0x06, 0x207, 0x205
VERSION_8 = 0x600


def _chain(start: int, table: list[int]) -> Iterator[int]:
    """Sectors from start on; a chain that runs in circles is an error."""
    for _ in range(len(table) + 1):
        if start >= NO_SECTOR:
            return
        yield start
        start = table[start]
    raise ValueError("a chain of sectors has no end")


def _longs(data: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(data) // 4}I", data[: len(data) // 4 * 4]))


def workbook_stream(data: bytes) -> bytes:
    """The workbook's records out of a compound file."""
    if not data.startswith(MAGIC):
        raise ValueError("this is no compound file")
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    folder, _, least, small_table, _, more, _ = struct.unpack_from("<7I", data, 48)
    sector = lambda i: data[(i + 1) * size : (i + 2) * size]
    tables = _longs(data[76:512])
    seen = set()
    while more < NO_SECTOR and more not in seen:  # what the header has no room for
        seen.add(more)
        *some, more_next = _longs(sector(more))
        tables += some
        more = more_next
    table = [n for i in tables if i < NO_SECTOR for n in _longs(sector(i))]
    read = lambda start: b"".join(map(sector, _chain(start, table)))
    entries = read(folder)
    found = {}
    for at in range(0, len(entries) - 127, 128):
        length, kind = struct.unpack_from("<HB", entries, at + 64)
        name = entries[at : at + max(0, length - 2)].decode("utf-16-le", "replace")
        found[{2: name, 5: ""}.get(kind)] = struct.unpack_from("<II", entries, at + 116)
    start, length = found.get("Workbook") or found.get("Book") or (None, 0)
    if start is None:
        raise ValueError("the compound file holds no workbook")
    if length >= least:
        return read(start)[:length]
    inner, small_next = read(found[""][0]), _longs(read(small_table))
    return b"".join(inner[i * small : (i + 1) * small] for i in _chain(start, small_next))[:length]


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(stream):
        kind, length = struct.unpack_from("<HH", stream, at)
        yield kind, stream[at + 4 : at + 4 + length]
        at += 4 + length


class _Pieces:
    """Data that goes on in later records. Characters that go on there say anew whether they are wide."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.i, self.at = pieces, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n and self.i < len(self.pieces):
            part = self.pieces[self.i][self.at : self.at + n - len(out)]
            out += part
            self.at += len(part)
            if self.at >= len(self.pieces[self.i]) and len(out) < n:
                self.i, self.at = self.i + 1, 0
        return out

    def text(self, n: int, wide: bool) -> str:
        out = ""
        while n:
            if self.at >= len(self.pieces[self.i]):
                self.i, self.at = self.i + 1, 1
                wide = bool(self.pieces[self.i][0] & 1)
            width = 2 if wide else 1
            part = self.pieces[self.i][self.at : self.at + n * width]
            part = part[: len(part) // width * width]
            if not part:
                raise ValueError("a text ends before it should")
            out += part.decode("utf-16-le" if wide else "latin-1", "replace")
            self.at += len(part)
            n -= len(part) // width
        return out

    def string(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out = self.text(n, bool(flags & 1))
        self.take(4 * runs + extra)
        return out


def _rk(x: int) -> float:
    """A number in 30 bits: whole, or the upper part of a float; a hundredth of it if the last bit says so."""
    value = float((x - (1 << 32) if x >= 1 << 31 else x) >> 2) if x & 2 else struct.unpack("<d", struct.pack("<II", 0, x & ~3))[0]
    return value / 100 if x & 1 else value


def old_sheet_rows(data: bytes) -> list[list[str | float]]:
    """Rows of the first sheet as lists of texts and numbers."""
    stream = workbook_stream(data)
    shared: list[str] = []
    first, version, pieces = None, VERSION_8, None
    for kind, body in records(stream):
        if kind == CONTINUE and pieces is not None:
            pieces.append(body)
            continue
        if kind == BOF:
            version = struct.unpack_from("<H", body)[0]
        elif kind == PASSWORD:
            raise ValueError("the workbook is encrypted")
        elif kind == SHEET and first is None and body[5] == 0:
            first = struct.unpack_from("<I", body)[0]
        elif kind == EOF:
            break
        if kind == STRINGS:
            pieces = [body]
        elif pieces is not None and not shared:
            shared = _shared(pieces)
    if pieces is not None and not shared:
        shared = _shared(pieces)
    if first is None:
        raise ValueError("the workbook has no sheet")
    text = lambda body, at: _Pieces([body[at:]]).string() if version == VERSION_8 else body[at + 2 : at + 2 + struct.unpack_from("<H", body, at)[0]].decode("cp1252", "replace")
    cells: dict[int, dict[int, str | float]] = {}
    waiting = None  # the cell whose formula's text comes in a record of its own
    for kind, body in records(stream, first):
        if kind == EOF:
            break
        if kind == FORMULA_TEXT and waiting:
            cells.setdefault(waiting[0], {})[waiting[1]] = text(body, 0)
        if kind not in (STRING_CELL, NUMBER, RK, MANY_RK, LABEL, FORMULA, TRUTH):
            continue
        row, col = struct.unpack_from("<HH", body)
        put = cells.setdefault(row, {}).__setitem__
        if kind == STRING_CELL:
            put(col, shared[struct.unpack_from("<I", body, 6)[0]])
        elif kind == NUMBER:
            put(col, struct.unpack_from("<d", body, 6)[0])
        elif kind == RK:
            put(col, _rk(struct.unpack_from("<I", body, 6)[0]))
        elif kind == MANY_RK:
            for k, at in enumerate(range(4, len(body) - 2, 6)):
                put(col + k, _rk(struct.unpack_from("<I", body, at + 2)[0]))
        elif kind == LABEL:
            put(col, text(body, 6))
        elif kind == TRUTH and not body[7]:
            put(col, str(body[6]))
        elif kind == FORMULA:
            waiting = None
            if body[12:14] != b"\xff\xff":
                put(col, struct.unpack_from("<d", body, 6)[0])
            elif body[6] == 0:
                waiting = (row, col)
            elif body[6] == 1:
                put(col, str(body[8]))
    return [[row.get(c, "") for c in range(max(row) + 1)] for _, row in sorted(cells.items()) if row]


def _shared(pieces: list[bytes]) -> list[str]:
    different = struct.unpack_from("<I", pieces[0], 4)[0]
    at = _Pieces([pieces[0][8:], *pieces[1:]])
    return [at.string() for _ in range(different)]
