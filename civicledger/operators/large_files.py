"""Files too large for a task: CSV of any header signature, scanned in splits.

One pass over the lines finds each file's first ones, and whether a quoted field holds a line break. The
first lines tell header and mapping; files of one header and one mapping are one scan that Spark cuts where it
likes. Files that can't be cut (a field with a line break, not UTF-8) are parsed whole, as small ones are. The rows are
those of `runs.parse_files`, but for the numbers of rows, which ascend in a file without being dense.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicledger.operators.headers import URL_SAMPLE, detect, swap_url_supplier
from civicledger.operators.ingest import FIELDS
from civicledger.operators.runs import PARSED, header_of, override_of, parse_files
from civicledger.sources.scratch import materialise
from civicledger.sources.spreadsheets import rows_of

#: Lines of a file that are looked at for its header and the supplier column's first values.
HEAD = 3 * URL_SAMPLE + 1
#: Row numbers: the place of the split in the file by so many bytes, then the place in the task.
UNIT, PLACE_BITS = 1 << 12, 33


def _surveyed(lines: DataFrame) -> DataFrame:
    """(path, odd, head): lines with an odd number of quotes or undecodable bytes, and the first lines of each file. One pass."""
    def first(batches):
        seen: dict[str, int] = {}
        for b in batches:
            rows = []
            for path, at, value, odd in zip(*(b.column(i).to_pylist() for i in range(4))):
                n = seen.get(path, 0)
                if at == 0 and value.strip() and n < HEAD:
                    seen[path] = n + 1
                    rows.append((path, int(odd), n, value))
                elif odd:
                    rows.append((path, 1, None, None))
            cols = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["path", "odd", "n", "value"])

    odd = (F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    # only what the survey is after goes to Python: lines of first splits, and odd ones
    cut = lines.select("path", "at", F.make_valid_utf8("value").alias("value"), (odd | ~F.is_valid_utf8("value")).alias("odd")).filter("at = 0 OR odd")
    found = cut.mapInArrow(first, "path string, odd long, n long, value string")
    return found.groupBy("path").agg(F.sum("odd").alias("odd"), F.sort_array(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "value")))).alias("head"))


def _plain(path: str) -> str:
    """A path as Spark's readers write it: file:/x for file:///x."""
    return re.sub(r"^file:/+", "file:/", path)


def scan_files(files: DataFrame) -> DataFrame:
    """files (council_id, url, filename, path, profile) of CSV as rows of PARSED: one for each file (file_row 0), one for each data row.

    What comes to the driver is each file's first lines. A path belongs to one file.
    """
    spark = files.sparkSession
    files = files.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    told = {r["path"]: r for r in files.select("path", "filename", "profile").collect()}
    if not told:
        return spark.createDataFrame([], PARSED)
    where = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at")
    survey = _surveyed(spark.read.text(sorted(told)).select(*where, "value")).collect()
    whole, groups, about = sorted(set(told) - {unquote(_plain(r["path"])) for r in survey}), {}, []
    for r in survey:
        path = unquote(_plain(r["path"]))  # the readers' metadata is an encoded address
        text = "\n".join(x["value"] for x in r["head"])
        if r["odd"]:
            whole.append(path)
            continue
        head, sample = rows_of(told[path]["filename"], text.encode())
        mapping = detect(head, override_of(told[path]["profile"]))
        if sample and not mapping.missing:
            mapping = swap_url_supplier(mapping, [str(x.get(header_of(mapping, "supplier"), "")) for x in sample[:URL_SAMPLE]], head)
        about.append((path, r["path"], json.dumps(mapping.fields), ", ".join(mapping.missing)))
        at = {f: head.index(h) for h, f in mapping.fields.items()}
        groups.setdefault((len(head), tuple(at.get(f) for f in FIELDS), bool(mapping.missing)), []).append(path)
    own = files.select("council_id", "url", "filename", "path")
    parts = []
    if about:
        scans = []
        for (width, at, lacks), paths in sorted(groups.items(), key=repr):
            raw = spark.read.schema(", ".join(f"c{i} string" for i in range(width))).option("header", True).option("enforceSchema", True).option("escape", '"').csv(sorted(paths))
            filled = reduce(lambda a, b: a | b, (F.coalesce(F.col(f"c{i}"), F.lit("")) != "" for i in range(width)))
            place = (F.floor(F.col("_metadata.file_block_start") / UNIT).cast("long") * (1 << PLACE_BITS) + F.monotonically_increasing_id() % (1 << PLACE_BITS) + 1).alias("file_row")
            cells = ((F.coalesce(F.col(f"c{i}"), F.lit("")) if i is not None else F.lit("")).alias(f) for f, i in zip(FIELDS, at))
            scans.append(raw.filter(filled).select(where[0], place, *cells, F.lit(lacks).alias("lacks")))
        rows = materialise(reduce(DataFrame.unionByName, scans), "scanned-rows")
        counts = rows.groupBy("path").agg(F.count("*").alias("n"))
        info = spark.createDataFrame(about, "path string, address string, mapping string, missing string").join(counts.withColumnRenamed("path", "address"), "address", "left")
        own = own.join(info, "path")
        data = own.join(rows.filter("NOT lacks").withColumnRenamed("path", "address"), "address").select("council_id", "url", "filename", "file_row", *FIELDS)
        heads = own.select("council_id", "url", "filename", F.lit(0).cast("long").alias("file_row"), *(F.lit("").alias(f) for f in FIELDS), F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"), "mapping", "missing")
        names = [x.split() for x in PARSED.split(", ")]
        parts = [df.select(*(F.col(n) if n in df.columns else F.lit(None).cast(k).alias(n) for n, k in names)) for df in (heads, data)]
    if whole:
        contents = spark.read.format("binaryFile").load(whole).select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), "content")
        there = files.join(spark.createDataFrame([(p,) for p in whole], "path string"), "path").join(contents, "path", "left")
        parts.append(parse_files(there.withColumn("content", F.coalesce("content", F.lit(b"")))))  # readers pass over files without bytes
    return reduce(DataFrame.unionByName, parts)
