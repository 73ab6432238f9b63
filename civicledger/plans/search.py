"""Searching the stored ledger for a text within texts, reading only files that can hold it.

A file's signature is a bitmap of hashes of all three-character pieces of its searched columns, folded as the
search folds. A text that contains the needle contains its pieces, so a file whose signature lacks one
can't have a hit. Files without a signature are always read. Signatures are rows of a table of the ledger,
made by Spark's bitmap aggregates; a search compares a few bits of each.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicledger.operators.warehouse import Ledger

SEARCHED = ("description", "service")
PIECE = 3
#: Bits of a signature: those of one of Spark's bitmaps.
BITS = 8 * 4096


def _folded(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _bit(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(BITS))


def sign(ledger: Ledger, table: str = "transactions", columns: tuple[str, ...] = SEARCHED) -> int:
    """Adds the signatures of files that have none yet. Returns how many files that were."""
    rows = ledger.table(table)
    known = {r["file"] for r in ledger.table("signatures").filter(F.col("table_name") == table).select("file").collect()}
    new = [f for f in rows.inputFiles() if _name(f) not in known]
    if not new:
        return 0
    texts = ledger.scan_paths(table, new, with_file=True).select(_name_of(F.col("__file")).alias("file"), F.explode(F.array(*map(F.col, columns))).alias("text"))
    # a text that repeats in a file is cut once
    texts = texts.filter(F.char_length("text") >= PIECE).select("file", _folded(F.col("text")).alias("text")).distinct()
    pieces = texts.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("text") - (PIECE - 1)), lambda i: F.substring(F.col("text"), i, F.lit(PIECE)))).alias("piece"))
    marks = pieces.groupBy("file").agg(F.bitmap_construct_agg(F.bitmap_bit_position(_bit(F.col("piece")) + 1)).alias("bits"))
    every = ledger.spark.createDataFrame([(_name(f),) for f in new], "file string").join(marks, "file", "left")
    ledger.write("signatures", every.select(F.lit(table).alias("table_name"), "file", F.coalesce("bits", F.lit(b"")).alias("bits")))
    return len(new)


def _name(path: str) -> str:
    """A data file's name, which is its own: it holds a number that no other write has."""
    return path.rsplit("/", 1)[1]


def _name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def files_for(ledger: Ledger, needle: str, table: str = "transactions") -> list[str]:
    """The table's files that may hold a text like %needle% (% and _ within it are wildcards)."""
    everything = ledger.table(table).inputFiles()
    runs = re.split("[%_]", needle)
    pieces = sorted({r[i : i + PIECE] for r in runs for i in range(len(r) - PIECE + 1)})
    if not pieces:
        return everything
    spark = ledger.spark
    bits = [r["b"] for r in spark.createDataFrame([(p,) for p in pieces], "p string").select(_bit(_folded(F.col("p"))).alias("b")).distinct().collect()]
    byte = lambda b: F.conv(F.hex(F.substring("bits", b // 8 + 1, 1)), 16, 10).cast("int")
    has = [F.coalesce(byte(b).bitwiseAND(1 << b % 8) != 0, F.lit(False)) for b in bits]
    lacks = ~has[0]
    for h in has[1:]:
        lacks = lacks | ~h
    gone = {r["file"] for r in ledger.table("signatures").filter((F.col("table_name") == table) & lacks).select("file").collect()}
    return [f for f in everything if _name(f) not in gone]


def searchable(ledger: Ledger, needle: str) -> dict[str, DataFrame]:
    """The ledger's tables, of whose transactions only files are read that may hold the needle: for questions that ask for it."""
    files = files_for(ledger, needle)
    return ledger.tables() | {"transactions": ledger.scan_paths("transactions", files)}
