"""Old binary workbooks that the test itself writes, read as the same table in the newer format is."""

import struct

import pytest
from test_ingest import _workbook

from civicledger.sources import old_workbooks as O
from civicledger.sources.spreadsheets import rows_of


def rec(kind, body=b""):
    return struct.pack("<HH", kind, len(body)) + body


def strings(texts, room=60):
    """The shared texts, cut over many records within characters and between them."""
    out, body = b"", struct.pack("<II", len(texts), len(texts))
    kind = O.STRINGS
    for i, t in enumerate(texts):
        wide = any(ord(c) > 255 for c in t)
        rich, extra = i % 3 == 1, i % 4 == 2
        head = struct.pack("<HB", len(t), wide | rich << 3 | extra << 2) + (struct.pack("<H", 1) if rich else b"") + (struct.pack("<I", 5) if extra else b"")
        if len(body) + len(head) > room:
            out, kind, body = out + rec(kind, body), O.CONTINUE, b""
        body += head
        for c in t:
            c = c.encode("utf-16-le" if wide else "latin-1")
            if len(body) + len(c) > room:
                out, kind, body = out + rec(kind, body), O.CONTINUE, bytes([wide])
            body += c
        for tail in (b"\0" * 4 if rich else b"", b"\0" * 5 if extra else b""):
            if tail and len(body) + len(tail) > room:
                out, kind, body = out + rec(kind, body), O.CONTINUE, b""
            body += tail
    return out + rec(kind, body)


def stream(rows, pad=0):
    texts = [c for r in rows for c in r if isinstance(c, str) and c]
    bof = rec(O.BOF, struct.pack("<HHHHII", O.VERSION_8, 5, 0, 0, 0, 0))
    shared = strings(texts)
    names = lambda at: rec(O.SHEET, struct.pack("<IBB", at, 0, 2) + b"\1\0m") + rec(O.SHEET, struct.pack("<IBB", at, 0, 0) + b"\1\0s") + rec(O.SHEET, struct.pack("<IBB", 0, 0, 0) + b"\1\0t")
    start = len(bof + names(0) + shared + rec(O.EOF))
    body, n = bof + names(start) + shared + rec(O.EOF) + bof, 0
    for y, r in enumerate(rows):
        for x, c in enumerate(r):
            at = struct.pack("<HHH", y + 3, x, 0)
            if isinstance(c, str):
                if not c:
                    continue
                kind = n % 4
                flat = c.encode("utf-16-le")
                if kind == 0 and len(c) < 100:
                    body += rec(O.LABEL, at + struct.pack("<HB", len(c), 1) + flat)
                elif kind == 1 and len(c) < 100:
                    body += rec(O.FORMULA, at + b"\0\0\0\0\0\0\xff\xff" + b"\0" * 8) + rec(O.FORMULA_TEXT, struct.pack("<HB", len(c), 1) + flat)
                else:
                    body += rec(O.STRING_CELL, at + struct.pack("<I", n))
                n += 1
            elif c == int(c) and abs(c) < 1 << 28:
                whole = struct.pack("<i", int(c) << 2 | 2)
                body += rec(O.RK, at + whole) if x % 2 else rec(O.MANY_RK, at[:4] + b"\0\0" + whole + struct.pack("<H", x))
            elif x % 2:
                body += rec(O.NUMBER, at + struct.pack("<d", c))
            else:
                body += rec(O.FORMULA, at + struct.pack("<d", c) + b"\0" * 8)
    return body + b"".join(rec(0x1234, b"x" * 1000) for _ in range(pad)) + rec(O.EOF)


def compound(body, cutoff=4096):
    """A compound file: the stream in small sectors if it is short, in whole ones (not in their order) if not."""
    size, free, end = 512, 0xFFFFFFFF, 0xFFFFFFFE
    small = len(body) < cutoff
    cut = lambda b, n: [b[i : i + n].ljust(n, b"\0") for i in range(0, len(b), n)]
    data = cut(b"".join(cut(body, 64)) if small else body, size)[::-1]  # the last comes first
    chain = [end if i == 0 else i - 1 for i in range(len(data))]  # sector i holds part n - 1 - i
    entry = lambda name, kind, start, length: (name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 0) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IQ", start, length))
    n, last = len(data), len(data) - 1
    small_sectors = -(-len(body) // 64)
    minis = cut(struct.pack(f"<{small_sectors}I", *[i + 1 for i in range(small_sectors - 1)], end), size) if small else []
    folder = [(entry("Root Entry", 5, last if small else end, len(data) * size) + entry("Other", 2, 0, 0) + entry("Workbook", 2, 0 if small else last, len(body))).ljust(size, b"\0")]
    sectors = data + folder + minis
    chain += [end] + [n + 2 + i for i in range(len(minis) - 1)] + [end] * bool(minis)
    tables = 1
    while tables * 128 < len(chain) + tables:
        tables += 1
    where = list(range(len(sectors), len(sectors) + tables))
    chain += [0xFFFFFFFD] * tables
    chain += [free] * (tables * 128 - len(chain))
    sectors += cut(struct.pack(f"<{len(chain)}I", *chain), size)
    head = O.MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<II", 0, tables) + struct.pack("<7I", n, 0, cutoff, n + 1 if minis else end, len(minis), end, 0)
    return head + struct.pack("<109I", *where[:109], *[free] * (109 - len(where[:109]))) + b"".join(sectors)


TABLE = [("Supplier", "Amount", "Date", "Description"), ("Acme, Ltd", 1500000.0, 45292.5, "long " * 60), ("Żółć & Søn", -2.25, "", "x"), ("", 7.0, 45292.0, ""), ("Last", 1e300, 0.1, "日本" * 40)]


@pytest.mark.parametrize("pad", [0, 5, 80])
def test_old_workbook_as_the_new_one(pad):
    data = compound(stream(TABLE, pad))
    head, rows = rows_of("a.xls", data)
    assert (head, rows) == (list(TABLE[0]), [dict(zip(TABLE[0], r)) for r in TABLE[1:]])
    assert rows_of("renamed.csv", data) == (head, rows)


def test_old_workbook_through_ingestion(spark, tmp_path):
    from civicledger.operators import runs as R
    from civicledger.operators.warehouse import Ledger

    table = [TABLE[0], *(("S" + str(i), float(i), 45292.0 + i, "d") for i in range(1, 200))]
    files = [(1, "old", "a.xls", compound(stream(table)), None), (2, "new", "a.xlsx", _workbook(table), None), (3, "bad", "b.xls", O.MAGIC + b"\0" * 600, None), (4, "text", "c.xls", b"Supplier,Amount\nA,1\n", None)]
    ledger = Ledger.create(spark, f"file://{tmp_path}/ledger")
    got = {r.council_id: (r.inserted, r.errors) for r in R.ingest(ledger, spark.createDataFrame(files, "council_id long, url string, filename string, content binary, profile string"), "now").collect()}
    assert got == {1: (199, 0), 2: (199, 0), 3: (0, 1), 4: (1, 0)}
    rows = ledger.table("transactions").drop("council_id", "supplier_id", "source_document_id", "batch")
    ids = {r.council_id: r.source_document_id for r in ledger.table("transactions").select("council_id", "source_document_id").distinct().collect()}
    t = ledger.table("transactions")
    part = lambda c: sorted(map(repr, t.filter(f"source_document_id = {ids[c]}").select(*rows.columns).collect()))
    assert part(1) == part(2)


def test_what_is_no_workbook():
    for bad in (b"", b"PK", O.MAGIC, compound(rec(O.BOF, b"\0\6\5\0") + rec(O.EOF)), compound(rec(O.BOF, b"\0\6\5\0") + rec(O.PASSWORD, b"x"))):
        with pytest.raises((ValueError, struct.error, IndexError, KeyError)):
            O.old_sheet_rows(bad)
