"""Deep pages: rows from a place in an order to the next, without gathering all that stands before them.

The order's first column is cut into equal ranges and the rows of each are counted; ranges before the page
are passed over as numbers, and only those that it touches are looked at again, more finely, until what is
left is few rows. Where all rows that are left agree in a column, the next column goes on. So a page costs a
few counting passes over ever fewer rows; counts alone come to the driver, and at most `most` rows
plus the page meet in the last sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, NumericType

#: Ranges that a column is cut into at a time, and rows that are few enough to be sorted.
RANGES, MOST = 1024, 20_000
#: Bytes of a text that are one number.
CHUNK = 7
#: A column of the order: its name and whether it ascends.
Order = list[tuple[str, bool]]


def sort_columns(order: Order) -> list[Column]:
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in order]


def _levels(rows: DataFrame, order: Order):
    """Numbers that, one after the other, order rows as `order` does; (number, ascends). Texts are numbers by CHUNK bytes."""
    for name, up in order:
        kind = rows.schema[name].dataType
        if isinstance(kind, DecimalType):
            if kind.precision > 18:
                raise ValueError(f"{name} is too wide to be paged by")
            yield (F.col(name) * 10**kind.scale).cast("long"), up
        elif isinstance(kind, (DoubleType, FloatType)):
            yield F.col(name).cast("double"), up
        elif isinstance(kind, NumericType):
            yield F.col(name).cast("long"), up
        else:
            data = F.col(name).cast("string").cast("binary")
            longest = rows.agg(F.max(F.octet_length(data))).first()[0] or 0
            for at in range(0, longest, CHUNK):
                part = F.rpad(F.hex(F.substring(data, at + 1, CHUNK)), 2 * CHUNK, "0")
                yield F.when(data.isNotNull(), F.conv(part, 16, 10).cast("long")), up
            yield F.octet_length(data).cast("long"), up


def _pieces(rows: DataFrame, n: int, levels: list[tuple[Column, bool]], skip: int, take: int, most: int) -> list[tuple[DataFrame, int, int]]:
    """(rows, skip, take) of disjoint parts, in order, that hold the page; each of few rows or of rows that agree in all levels."""
    if n <= most or not levels:
        return [(rows, skip, take)]
    x, up = levels[0]
    lo, hi, nulls = rows.agg(F.min(x), F.max(x), F.count_if(x.isNull())).first()
    if lo is None or lo == hi and not nulls:
        return _pieces(rows, n, levels[1:], skip, take, most)
    if isinstance(lo, float):
        bucket = F.floor((x - F.lit(lo)) / F.lit(max((hi - lo) / RANGES, 5e-324))).cast("long")
    else:
        bucket = F.floor((x.cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")) / F.lit((hi - lo) // RANGES + 1).cast("decimal(20,0)")).cast("long")
    bucket = F.coalesce(bucket, F.lit(-1).cast("long"))  # nulls come first where the order ascends, last where it descends
    counts = rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()
    out = []
    for r in sorted(counts, key=lambda r: r["b"], reverse=not up):
        if skip >= r["n"]:
            skip -= r["n"]
            continue
        here = min(take, r["n"] - skip)
        part = rows.filter(bucket == r["b"])
        out += _pieces(part, r["n"], levels if r["b"] >= 0 else levels[1:], skip, here, most)
        take, skip = take - here, 0
        if not take:
            break
    return out


def deep_page(rows: DataFrame, order: Order, offset: int, limit: int, most: int = MOST) -> DataFrame:
    """Rows offset to offset + limit (from 0) in an order, as `orderBy(...).offset(offset).limit(limit)` gives them where the order has no ties.

    Nulls come first where a column ascends and last where it descends. Pages beyond the end are empty.
    """
    n = rows.count()
    if offset >= n or limit < 1:
        return rows.limit(0)
    found = _pieces(rows, n, list(_levels(rows, order)), offset, min(limit, n - offset), most)
    by = sort_columns(order)
    return reduce(DataFrame.unionByName, (part.orderBy(*by).offset(skip).limit(take) for part, skip, take in found)).orderBy(*by)
