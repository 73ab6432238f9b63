from pyspark.sql import functions as F

from civicledger.operators import runs as R
from civicledger.operators.large_files import scan_files
from civicledger.operators.warehouse import Ledger

BIG = "Supplier,Amount,Date\n" + "".join(f'"S{i % 50}, Ltd",{i},{i % 28 + 1}/01/2024\n' + ("\n,,\n" if i % 997 == 0 else "") for i in range(60_000))
FILES = {
    "a-2024-05.csv": BIG.encode(), "b c+1%.csv": b"Vendor,Net Amount\nA,1\nB,2\n", "c.csv": b"Vendor,Net Amount\nC,3\n", "lacking.csv": b"Date,Notes\n1/1/2024,x\n", "empty.csv": b"", "head.csv": b"Vendor,Net Amount\n",
    "break.csv": b'Supplier,Amount,Description\nA,1,"two\nlines"\nB,2,x\n', "latin.csv": "Supplier,Amount\nCaf\xe9,5\n".encode("latin-1"), "urls.csv": b"Publisher,Supplier,Name,Amount\nb,http://s/1,Bolt,3\nb,http://s/2,Nut,4\n",
    "twice.csv": b"Supplier,Amount,Supplier\nA,1,B\n", "profile.csv": b"Q,Z\nA,8\n", "quoted.csv": b'Supplier,Amount,Description\n"A ""x"" B",7,"p,q"\n',
}


def test_large_files_as_small_ones(spark, tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    base = f"file://{tmp_path}"
    rows = [(1 + i % 3, f"u{i}", name, f"{base}/{name}", '{"q": "supplier", "z": "amount"}' if name == "profile.csv" else None) for i, name in enumerate(FILES)]
    files = spark.createDataFrame(rows, "council_id long, url string, filename string, path string, profile string")
    contents = spark.createDataFrame([(f"{base}/{n}", d) for n, d in FILES.items()], "path string, content binary")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")  # many splits
    try:
        got = scan_files(files)
        assert spark.read.text(f"{base}/a-2024-05.csv").rdd.getNumPartitions() > 10
        mine, theirs = got.collect(), R.parse_files(files.join(contents, "path")).collect()
        plain = lambda found: sorted(repr((r.url, r.file_row == 0, *(r[f] for f in R.FIELDS), r.n_rows, r.mapping, r.missing, r.error)) for r in found)
        assert plain(mine) == plain(theirs)
        numbers = [r.file_row for r in mine if r.url == "u0"]
        assert len(set(numbers)) == len(numbers)
        order = [(r.file_row, int(r.amount)) for r in mine if r.url == "u0" and r.file_row and r.amount]
        assert [a for _, a in sorted(order)] == list(range(60_000))
        ledger = Ledger.create(spark, f"{base}/ledger")
        stats = R.ingest(ledger, files, "now", parse=scan_files)
        assert stats.agg(F.sum("inserted")).first()[0] == sum(1 for r in theirs if r.file_row and r.amount not in ("", "0")) and ledger.table("transactions").filter("month = '2024-01'").count() == 59_999
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert scan_files(files.limit(0)).count() == 0
