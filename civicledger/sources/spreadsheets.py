"""Published spreadsheets: CSV by Spark's reader, whole files of any format (told by their bytes) by small parsers in tasks. Empty cells are ''."""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicledger.sources.old_workbooks import MAGIC, old_sheet_rows


def read_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Columns as in the header row, with __file of each row, of files that share one header row: Spark raises an error where they don't. For files of any size."""
    df = spark.read.option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').csv(paths)
    return df.na.fill("").withColumn("__file", F.col("_metadata.file_name"))


def list_files(spark: SparkSession, folder: str, pattern: str = "*.{[cC][sS][vV],[xX][lL][sS][xX],[xX][lL][sS]}", recursive: bool = False) -> DataFrame:
    """(filename, path, content) of a folder's spreadsheets, by name; their extensions in any case. recursive: and of those below it. Content is read only where it is used."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path", "content").orderBy("filename")


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, cells: map of header to text) of every data row of each workbook's first sheet."""
    def parse(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                _, rows = rows_of(name, data)
                cells = [[(h, v if isinstance(v, str) else f"{v:.15g}") for h, v in r.items()] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.string()), pa.array(range(1, len(cells) + 1), pa.int64()), pa.array(cells, pa.map_(pa.string(), pa.string()))], ["file", "row", "cells"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select(F.col("_metadata.file_name"), "content").mapInArrow(parse, "file string, row long, cells map<string,string>")


def rows_of(name: str, data: bytes) -> tuple[list[str], list[dict[str, str | float]]]:
    """(headers, rows as header -> cell) of a file's first sheet: texts, and numbers where a workbook's cell is one.

    Rows without any text are no rows. A header that comes again gets a number behind it.
    """
    if data.startswith(b"PK"):
        table = list(sheet_rows(data))
    elif data.startswith(MAGIC):
        table = old_sheet_rows(data)
    else:
        table = list(csv.reader(io.StringIO(_decoded(data), newline="")))
    table = [r for r in table if any(c != "" for c in r)]
    if not table:
        return [], []
    head: list[str] = []
    for i, h in enumerate(str(c) for c in table[0]):
        h = h or f"__EMPTY_{i}"
        head.append(h if h not in head else f"{h}_{sum(x == h or re.fullmatch(re.escape(h) + r'_\d+', x) is not None for x in head)}")
    return head, [{h: r[i] if i < len(r) else "" for i, h in enumerate(head)} for r in table[1:]]


def _decoded(data: bytes) -> str:
    """UTF-8 with or without a mark, else the Western code page that spreadsheets write."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _first_sheet(z: zipfile.ZipFile) -> str:
    """The part of the sheet that the workbook names first."""
    sheet = next(e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _tag(e) == "sheet")
    link = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
    target = next(e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")) if e.get("Id") == link)
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")


def sheet_rows(data: bytes):
    """Rows of the first sheet as lists of texts and numbers."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _tag(si) == "si"]
        if "xl/workbook.xml" in names:
            sheet = _first_sheet(z)
        else:
            sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        for row in (e for e in ElementTree.fromstring(z.read(sheet)).iter() if _tag(e) == "row"):
            out: list[str | float] = []
            for c in row:
                at = 0
                for letter in re.match(r"[A-Z]*", c.get("r", "")).group():
                    at = at * 26 + ord(letter) - 64
                while len(out) < at - 1:
                    out.append("")
                text = "".join(x.text or "" for x in c.iter() if _tag(x) in ("v", "t"))
                kind = c.get("t", "n")
                out.append(shared[int(text)] if kind == "s" and text else float(text) if kind == "n" and text else text)
            yield out
