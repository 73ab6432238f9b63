"""The stored ledger's log: changes, crashes, reloads, compaction, quarantine, and the stream's batches."""

import pytest
from pyspark.sql import functions as F

from civicledger.operators import runs as R
from civicledger.operators.warehouse import Ledger

FILES = "council_id long, url string, filename string, content binary, profile string"


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger.create(spark, f"file://{tmp_path}/ledger")


def rows_of(df):
    return sorted(map(repr, df.collect()))


def transactions(spark, n, councils=3, start=0):
    k = F.col("id") + start
    return spark.range(n).select((k % councils).alias("council_id"), F.when(k % 5 > 0, F.concat(F.lit("20"), (10 + k % 4).cast("string"), F.lit("-x"))).alias("fy"), k.alias("file_row"), k.cast("decimal(18,2)").alias("amount"), F.lit("s").alias("service"))


def test_many_changes_are_one_scan_and_compaction_keeps_rows(spark, ledger):
    for i in range(12):
        ledger.write("transactions", transactions(spark, 20, start=20 * i))
    before = ledger.table("transactions")
    rows = rows_of(before)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert len(rows) == 240 and plan(before).count("FileScan") == 1
    assert "PartitionFilters: [isnotnull(council_id" in plan(before.filter("council_id = 1"))
    files = sum(e.files for e in ledger.entries("transactions"))
    old = Ledger(spark, ledger.path, as_of=ledger.history().agg(F.max("at")).first()[0])
    assert ledger.compact("transactions") == 36
    after = ledger.table("transactions")
    assert rows_of(after) == rows and rows_of(before) == rows and rows_of(old.table("transactions")) == rows
    assert sum(e.files for e in ledger.entries("transactions")) < files / 4 and plan(after).count("FileScan") == 1
    assert ledger.compact("transactions") == 0  # nothing is left to do
    with pytest.raises(ValueError):
        old.begin()


def test_compaction_packs_bins(spark, ledger):
    for i in range(4):
        ledger.write("suppliers", spark.range(50 * i, 50 * i + 50).select("id", F.lit(1).alias("council_id"), F.lit("n").alias("name")))
        ledger.write("transactions", transactions(spark, 60, councils=6, start=60 * i))
    sizes = [e.bytes for e in ledger.entries("transactions")]
    commits = lambda: ledger.history().filter("note = 'compact'").select("commit").distinct().count()
    ledger.compact("transactions", bin_bytes=sum(sizes) // 3 + max(sizes) * 4)
    assert 2 <= commits() <= 4 and ledger.table("transactions").agg(F.countDistinct("file_row")).first()[0] == 240 == ledger.table("transactions").count()
    ledger.compact("suppliers")
    assert len(ledger.entries("suppliers")) == 1 and ledger.table("suppliers").agg(F.countDistinct("id")).first()[0] == 200


def test_changes_of_several_tables_come_at_once(spark, ledger):
    with ledger.begin("both") as change:
        change.add("transactions", transactions(spark, 10))
        assert ledger.table("transactions").count() == 0
        change.add("councils", spark.range(3).select("id"))
        change.add("budgets", spark.createDataFrame([], "council_id long, fy string"))
    assert ledger.table("transactions").count() == 10 and ledger.table("councils").count() == 3 and ledger.table("budgets").count() == 0
    assert {(r.table_name, r.rows) for r in ledger.history().filter("kind = 'wrote'").collect()} == {("transactions", 10), ("councils", 3), ("budgets", 0)} and change.rows == {"transactions": 10, "councils": 3, "budgets": 0}
    assert ledger.committed("both") and not ledger.committed("neither")


def test_of_two_changes_that_take_the_same_away_the_second_is_void(spark, ledger):
    ledger.write("councils", spark.range(3).select("id"))
    one, two = ledger.begin(), ledger.begin()
    for change, n in ((one, 5), (two, 7)):
        change.replace("councils", spark.range(n).select("id"))
    one.commit()
    with pytest.raises(RuntimeError):
        two.commit()
    assert ledger.table("councils").count() == 5
    ledger.write("councils", spark.range(1).select("id"), replace=True)
    assert ledger.table("councils").count() == 1
    with pytest.raises(ValueError):
        ledger.begin().drop("councils", 1)


LANDED = [
    (1, "u1", "spend-2024-05.csv", b"Supplier,Amount\nA,1\nB,2\n", None), (2, "u2", "spend-2024-05.csv", b"Supplier,Amount\nA,3\n", None),
    (1, "u3", "bad.csv", b"Date,Notes\n1/1/2024,x\n", None), (1, "u4", "broken.xlsx", b"PK broken", None), (2, "u5", "empty.csv", b"", None),
]


def test_reload_of_a_council(spark, ledger, monkeypatch):
    R.ingest(ledger, spark.createDataFrame(LANDED, FILES), "now")
    ledger.write("source_documents", spark.range(1).select(F.lit(1).alias("council_id"), F.lit("book").alias("url"), F.lit("budget").alias("type"), F.lit(9).alias("id")))
    rows = lambda: {(r.council_id, float(r.amount)) for r in ledger.table("transactions").collect()}
    reader = ledger.table("transactions")
    corrected = spark.createDataFrame([(1, "u1", "spend-2024-05.csv", b"Supplier,Amount\nA,10\n", None), (2, "u9", "x.csv", b"Supplier,Amount\nA,99\n", None)], FILES)
    # a crash before the end changes nothing
    with monkeypatch.context() as m:
        m.setattr(R, "failures", lambda files: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            R.reload_council(ledger, 1, corrected, "later")
    assert rows() == {(1, 1.0), (1, 2.0), (2, 3.0)}
    got = R.reload_council(ledger, 1, corrected, "later").collect()
    assert [(r.council_id, r.new, r.inserted) for r in got] == [(1, 1, 1)]
    assert rows() == {(1, 10.0), (2, 3.0)} and {float(r.amount) for r in reader.collect()} == {1.0, 2.0, 3.0}
    assert {(r.council_id, r.url) for r in ledger.table("source_documents").collect()} == {(1, "u1"), (1, "book"), (2, "u2")}
    R.reload_council(ledger, 1, corrected, "again")
    assert rows() == {(1, 10.0), (2, 3.0)} and ledger.table("suppliers").count() == 3


def test_quarantine(spark, ledger):
    landed = spark.createDataFrame(LANDED, FILES)
    R.ingest(ledger, landed, "2024")
    R.ingest(ledger, landed, "2025")
    got = {r.url: r for r in R.open_failures(ledger).collect()}
    assert set(got) == {"u3", "u4"} and got["u3"].error == "missing columns supplier, amount" and got["u3"].n_rows == 1 and got["u3"].times == 2 and "BadZipFile" in got["u4"].error
    mended = spark.createDataFrame([(1, "u3", "bad.csv", b"Supplier,Amount\nA,1\n", None)], FILES)
    R.ingest(ledger, mended, "2026")
    assert {r.url for r in R.open_failures(ledger).collect()} == {"u4"} and ledger.table("quarantine").count() == 4


def test_a_batch_of_the_stream_counts_once(spark, ledger, tmp_path):
    from civicledger.streaming.incremental import ingest_new_files

    ledger.write("councils", spark.range(6).select("id", F.lit("pending").alias("status")))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes(b"Vendor,Value\nNew,9\n")
    run = lambda: ingest_new_files(ledger, f"file://{tmp_path}/in", 4, f"file://{tmp_path}/ck", "now").awaitTermination()
    run()
    for f in (tmp_path / "ck" / "commits").iterdir():  # as if the run had died after its change and before the stream noted it
        f.unlink()
    run()
    assert ledger.table("transactions").count() == 1 and ledger.history().filter("note LIKE 'stream%'").select("commit").distinct().count() == 1
    assert {(r.id, r.status) for r in ledger.table("councils").collect()} == {(i, "active" if i == 4 else "pending") for i in range(6)}


def test_a_ledger_that_is_not_there_is_empty(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/none")
    assert ledger.table("councils").count() == 0 and ledger.entries() == [] and not ledger.committed("x")
    ledger.write("councils", spark.range(2).select("id"))
    Ledger.create(spark, ledger.path)
    assert ledger.table("councils").count() == 2


def test_publication_turns_bad_rows_away_alone(spark, tmp_path):
    from civicledger.operators import publish as P

    good = [(i, 1, f"f{i}", "u", "t", "x") for i in range(700)]
    bad = [(900, 1, None, "u", "t", "x"), (901, None, "f", "u", "t", "x"), (3, 1, "again", "u", "t", "x"), (None, 1, "f", "u", "t", "x")]
    rows = spark.createDataFrame(good + bad, "id long, council_id long, filename string, url string, type string, extra string")
    shards, rejected = P.publish_table(rows, "source_documents", shard_rows=200)
    assert shards.count() >= 3 and shards.agg(F.sum("n_rows")).first()[0] == 701  # null ids don't clash
    reasons = sorted(r.error for r in rejected.collect())
    assert [e.split(":")[0] for e in reasons] == ["NOT NULL constraint failed"] * 2 + ["UNIQUE constraint failed"]
    assert P.ask_shards(shards, "SELECT count(*) FROM source_documents", "n long").agg(F.sum("n")).first()[0] == 701
    assert P.ask_shards(shards, "SELECT name FROM sqlite_master WHERE type = 'index' AND sql IS NOT NULL", "name string").distinct().count() == 2
    counts, rejects = P.publish({"source_documents": rows, "councils": spark.createDataFrame([], "id long, name string")}, f"file://{tmp_path}/out", 200)
    assert {tuple(r) for r in counts.collect()} == {("source_documents", 701, 3), ("councils", 0, 0)} and rejects.count() == 3
    assert spark.read.parquet(f"file://{tmp_path}/out/source_documents").agg(F.sum("n_rows")).first()[0] == 701
    with pytest.raises(ValueError):
        P.publish({}, "x")


def test_publication_over_a_connection(spark, tmp_path):
    """The same path to a database that stays: here a file that the local tasks share."""
    import sqlite3

    from civicledger.operators import publish as P

    path = str(tmp_path / "db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE suppliers (id INTEGER UNIQUE, council_id INTEGER, name TEXT NOT NULL, normalised_name TEXT)")
    rows = spark.range(500).select((F.col("id") % 450).alias("id"), F.lit(1).alias("council_id"), F.when(F.col("id") != 7, "n").alias("name"))
    shards, rejected = P.publish_table(rows, "suppliers", connect=lambda: sqlite3.connect(path, timeout=60))
    with sqlite3.connect(path) as db:
        assert db.execute("SELECT count(*) FROM suppliers").fetchone()[0] == 450
    assert rejected.count() == 50 and {(r.n_rows, r.database) for r in shards.collect()} == {(450, None)}


def test_search_reads_only_files_that_can_hold_it(spark, ledger):
    from civicledger.functions import exprs as X
    from civicledger.plans import search

    for i, word in enumerate(("plumbing", "Straße", "road works", None, "ab", "PLUMB line")):
        ledger.write("transactions", spark.range(40).select(F.lit(1).alias("council_id"), F.lit(word).alias("description"), F.lit(i).alias("file_row"), F.lit("s%").alias("service")))
    files = ledger.table("transactions").inputFiles()
    assert search.files_for(ledger, "plumb") == files  # none has a signature yet
    assert search.sign(ledger) == len(files) and search.sign(ledger) == 0
    for needle, want in (("PLUMB", {0, 5}), ("umb%ing", {0}), ("pl_mb", {0, 5}), ("raße", {1}), ("nowhere", set()), ("b", {0, 4, 5}), ("road_works", {2}), ("ROAD", {2})):
        found = search.searchable(ledger, needle)["transactions"]
        hit = X.like_ascii(F.col("description"), needle) | X.like_ascii(F.col("service"), needle)
        assert {r.file_row for r in found.filter(hit).select("file_row").distinct().collect()} == want
        if len(needle) > 3 and needle != "pl_mb":
            assert {r.file_row for r in found.select("file_row").distinct().collect()} == want  # nothing else was read
    ledger.write("transactions", spark.range(1).select(F.lit(1).alias("council_id"), F.lit("nowhere").alias("description"), F.lit(9).alias("file_row")))
    assert {r.file_row for r in search.searchable(ledger, "nowhere")["transactions"].collect()} == {9}
    ledger.compact("transactions")
    assert search.searchable(ledger, "plumb")["transactions"].count() == 241 and search.sign(ledger) >= 1
