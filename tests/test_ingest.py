import io
import zipfile

import pytest
from pyspark.sql import functions as F

from civicledger.functions import exprs as X
from civicledger.operators import headers as H
from civicledger.operators import ingest as I
from civicledger.sources import links as L
from civicledger.sources import spreadsheets as S

GOLDEN = {
    "Name": ("supplier", 0.8), "Paid": ("supplier", 0.8), "VAT": ("amount", 0.8), "Irrecoverable VAT": None, "Type": ("category", 0.8), "Code": ("service", 0.8), "Transaction": ("amount", 0.8),
    "Consumer Group": ("amount", 0.8), "Community Safety": ("service", 0.8), "Supplier Category": ("supplier", 0.8), "Merchant Category": ("category", 0.8), "Amount (£)": ("amount", 1.0),
    "Posted On": ("date", 0.5), "_foo": ("supplier", 0.5), "Body Name": None, "Supplier ID": None, "Ref": None, "Month": None, "Invoice Number": None,
}


@pytest.mark.parametrize("header", GOLDEN)
def test_score(header):
    assert H.score(header) == GOLDEN[header]


def test_detect():
    m = H.detect(["Supplier", "Amount", "Date", "Ref"])
    assert m.fields == {"Supplier": "supplier", "Amount": "amount", "Date": "date"} and m.unmapped == ["Ref"] and not m.missing and m.confidence == 1.0
    assert H.detect(["Date", "Description"]).missing == ["supplier", "amount"]
    assert H.detect(["Col A", "Col B"], {"col a": "supplier", "col b": "amount"}).missing == []
    # of two overrides for a field the first counts, and the other header is scored like any other
    m = H.detect(["B", "A", "a ", "Paid Amount", "Value"], {"a": "supplier", "b": "supplier", "VALUE": "amount", "paid amount": "amount", "none": "date"})
    assert m.fields == {"A": "supplier", "Value": "amount"} and m.unmapped == ["B", "a ", "Paid Amount"]
    assert H.detect(["Vendor", "X"], {"x": "supplier", "vendor": "supplier"}).fields == {"X": "supplier"}
    assert H.detect(["Amount", "X"], {"x": "supplier", "amount": "supplier"}).fields == {"X": "supplier", "Amount": "amount"}
    m = H.detect(["Body Name", "Supplier", "Name", "Amount"])
    assert H.swap_url_supplier(m, ["http://x", "https://y", ""], ["Body Name", "Supplier", "Name", "Amount"]).fields["Name"] == "supplier"


@pytest.mark.parametrize("text,want", [("£1,234.56", 1234.56), ("-£5", -5.0), ("(123.45)", 0.0), ("12abc", 12.0), ("1e3", 1000.0), ("", 0.0), ("abc", 0.0), (" 7", 7.0), (None, 0.0)])
def test_amount(spark, text, want):
    assert spark.createDataFrame([(text,)], "c string").select(X.parse_amount(F.col("c"))).first()[0] == want


def test_texts(spark):
    one = lambda f, v: spark.createDataFrame([(v,)], "c string").select(f(F.col("c"))).first()[0]
    assert one(X.parse_date, "1.2.2024") == "2024-02-01" and one(X.parse_date, "31/02/2024") == "2024-02-31" and one(X.parse_date, " 01/02/2024") == "" and one(X.parse_date, "01/02/24") == ""
    assert one(X.month_of_filename, "spend-2024-25.csv") == "2024-25" and one(X.month_of_filename, "2023-2024.csv") == "2023-20" and one(X.month_of_filename, "spend.csv") == ""
    assert one(X.normalise_name, "  Café & Co. (UK) Ltd ") == "CAF & CO UK LTD" and one(X.normalise_name, "a b") == "A B"
    assert one(X.fy_of_month, "1999-04") == "1999-00" and one(X.fy_of_month, "2025-03") == "2024-25" and one(X.previous_fy, "2024-25") == "2023-24"
    assert one(X.slug, "Royal Borough of Greenwich") == "royal-greenwich" and one(X.slug, "Leeds City Council") == "leeds-city"
    assert one(L.filename, "https://x/a%20b+c.csv?y=1") == "a-b+c.csv" and one(L.filename, "https://x/50%.csv") == "50%.csv"
    assert spark.range(1).select(X.serial_date(F.lit(45292.0))).first()[0] == "2024-01-01"
    assert one(lambda c: X.like_ascii(c, "A\\b%"), "xa\\bc") and not one(lambda c: X.like_ascii(c, "É"), "é")


def test_csv_to_store_and_stream(spark, tmp_path):
    from civicledger.streaming.incremental import ingest_new_csv

    folder = tmp_path / "raw"
    folder.mkdir()
    head = ["Supplier", "Amount", "Date", "Description"]
    (folder / "spend-2024-05.csv").write_text('Supplier,Amount,Date,Description\nAcme Ltd.,"£1,000.50",01/05/2024,"a ""b"""\n,99,,\nB,0,,x\n,5,02/05/2024,y\n')
    mapping = H.detect(head)
    rows = I.clean_rows(I.apply_mapping(S.read_csv(spark, str(folder)), mapping))
    got = {(r.supplier, float(r.amount), r.fy, r.skip) for r in rows.collect()}
    assert got == {("Acme Ltd.", 1000.5, "2024-25", None), ("Redacted", 99.0, "2024-25", "totals_line"), ("B", 0.0, "2024-25", "zero_amount"), ("Redacted", 5.0, "2024-25", None)}
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for want in (2, 2, 3):
        ingest_new_csv(spark, str(folder), head, mapping, 7, out, check).awaitTermination()
        assert spark.read.parquet(out).count() == want  # the same files aren't taken in again
        if want == 2:
            (folder / "spend-2024-06.csv").write_text("Supplier,Amount,Date,Description\nC,1,01/06/2024,z\n") if (folder / "seen").exists() else (folder / "seen").mkdir()


def test_xlsx(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Supplier</t></si><si><t>Amount</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>Acme</t></is></c><c r="C2"><v>5</v></c></row></sheetData></worksheet>')
    (tmp_path / "a.xlsx").write_bytes(data.getvalue())
    assert [(r.row, dict(r.cells)) for r in S.read_xlsx(spark, str(tmp_path)).collect()] == [(1, {"Supplier": "Acme", "__EMPTY_1": "", "Amount": "5"})]


def test_links(spark):
    html = '<a href="/d/a.csv">x</a><a href="#">n</a><a href="mailto:x">m</a><a href="/d/a.csv">again</a><a href="/s">Spend over 500 January 2024</a><a href="b.pdf">p</a><a href="/old">Spending archive</a>'
    pages = spark.createDataFrame([("https://x.org/p/q", html), ("https://y.org", None)], "url string, html string")
    assert {(r.url, r.filename, r.format) for r in L.discover(pages).collect()} == {("https://x.org/d/a.csv", "a.csv", "csv"), ("https://x.org/s", "s.csv", "csv")}
    body = '{"success":true,"result":{"resources":[{"url":"http://x/1.xlsx","format":" XLSX ","created":"c"},{"url":"http://x/1.pdf","format":"PDF"}]}}'
    got = L.catalogue_files(spark.createDataFrame([(body,), ("broken",)], "json string")).collect()
    assert [(r.filename, r.format, r.modified) for r in got] == [("1.xlsx", "xlsx", "c")]


def _workbook(rows, sheets=("b.xml", "a.xml")):
    """A workbook whose first sheet by order, not by name, holds rows of texts and numbers."""
    cell = lambda v: f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="x"><sheets><sheet name="one" r:id="r1"/><sheet name="two" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<R>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/{n}"/>' for i, n in enumerate(sheets, 1)) + "</R>")
        z.writestr(f"xl/worksheets/{sheets[0]}", "<worksheet><sheetData>" + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>")
        z.writestr(f"xl/worksheets/{sheets[1]}", "<worksheet><sheetData><row><c><v>1</v></c></row></sheetData></worksheet>")
    return data.getvalue()


def test_ingestion_end_to_end(spark, tmp_path):
    from civicledger.operators import runs as R
    from civicledger.operators.warehouse import Ledger
    from civicledger.plans import queries as Q
    from civicledger.streaming.incremental import ingest_new_files

    files = [
        (1, "u1", "spend-2024-05.xlsx", _workbook([("Supplier", "Amount", "Date", "Description"), ("Acme, Ltd", 1500000, 45292, ""), ("", 7, "", ""), ("ACME LTD", 2.5, 45292.5, "x"), ("", "", "", "")]), None),
        (1, "u2", "spend.csv", "Body Name,Col A,Col B\nhttp://b,Acme Ltd,\"£1,234.50\"\n".encode(), '{"col a": "supplier", "COL B": "amount"}'),
        (1, "u3", "empty.csv", b"Supplier,Amount\n", None), (1, "u4", "lacking.csv", b"Date,Notes\n1/1/2024,x\n", None), (1, "u5", "broken.xlsx", b"PK broken", None),
        (2, "u6", "x.csv", b"Publisher,Supplier,Name,Amount\nb,http://s/1,Bolt,3\nb,http://s/2,,4\n", "not json"), (3, "u7", "none.csv", b"", None),
    ]
    landed = spark.createDataFrame(files, "council_id long, url string, filename string, content binary, profile string")
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.table("transactions").count() == 0
    first = {r.council_id: r for r in R.ingest(ledger, landed, "now").collect()}
    assert (first[1].discovered, first[1].new, first[1].inserted, first[1].skipped, first[1].errors, first[1].status) == (5, 5, 3, 2, 2, "active")
    assert (first[2].inserted, first[2].skipped, first[2].errors, first[3].inserted, first[3].errors, first[3].status) == (1, 1, 0, 0, 0, "active")
    again = {r.council_id: r for r in R.ingest(ledger, landed, "later").collect()}
    assert (again[1].new, again[1].inserted, again[1].status, again[2].new) == (3, 0, "failing", 0)
    t = ledger.tables()
    rows = {(r.supplier_name, float(r.amount), r.date, r.month, r.source_file) for r in Q.transactions_page(t, 1).collect()}
    assert rows == {("Acme, Ltd", 1500000.0, "2024-01-01", "2024-01", "spend-2024-05.xlsx"), ("Acme, Ltd", 2.5, "2024-01-01", "2024-01", "spend-2024-05.xlsx"), ("Acme, Ltd", 1234.5, "", "", "spend.csv")}
    assert {r.supplier_name for r in Q.transactions_page(t, 2).collect()} == {"Bolt"} and t["suppliers"].count() == 2
    assert {(r.council_id, r.label, r.start_date, r.end_date) for r in t["financial_years"].collect()} == {(1, "2023-24", "2023-04-01", "2024-03-31"), (1, "2024-25", "2024-04-01", "2025-03-31")}
    # rows of a run that died before its change was committed aren't seen
    with pytest.raises(RuntimeError), ledger.begin() as change:
        change.add("transactions", t["transactions"].limit(1))
        raise RuntimeError("died")
    assert ledger.table("transactions").count() == 4 and ledger.unreferenced().count() == 1
    (tmp_path / "in").mkdir()
    for name in ("a.csv", "b.csv"):
        (tmp_path / "in" / name).write_bytes(b"Vendor,Value\nNew,9\n")
        ingest_new_files(ledger, f"file://{tmp_path}/in", 4, f"file://{tmp_path}/ck", "now").awaitTermination()
    assert ledger.table("transactions").filter("council_id = 4").count() == 2


def test_fixed_decimals(spark):
    from civicledger.functions import exprs as X

    cases = [(1.15, "1.1"), (1.005, "1.0"), (0.25, "0.3"), (0.75, "0.8"), (2.5, "2.5"), (-1.25, "-1.3"), (1e6 / 3, "333333.3"), (0.05, "0.1"), (8.345, "8.3"), (1.45, "1.4"), (None, None)]
    got = spark.createDataFrame(cases, "x double, y string").select(X.to_fixed(F.col("x"), 1).alias("a"), "y", X.to_fixed(F.col("x"), 0).alias("b")).collect()
    assert [r.a for r in got] == [r.y for r in got] and [r.b for r in got][:5] == ["1", "1", "0", "1", "3"]
    assert spark.range(1).select(X.short_amount(F.lit(1_150_000.0))).first()[0] == "£1.1m"


def test_list_files(spark, tmp_path):
    for name in ("b.Csv", "a.XLSX", "c.xls", "d.csv", "e.pdf", "f.csv.bak", "g.txt"):
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "h.csv").write_bytes(b"x")
    assert [(r.filename, bytes(r.content)) for r in S.list_files(spark, f"file://{tmp_path}").collect()] == [(n, n.encode()) for n in ("a.XLSX", "b.Csv", "c.xls", "d.csv")]
    assert "h.csv" in {r.filename for r in S.list_files(spark, f"file://{tmp_path}", recursive=True).collect()}
