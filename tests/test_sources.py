import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from auditflow.operators import quality
from auditflow.sources import csvtext, fixture, manifest, store, workbook


def test_csv_cells_stay_text(spark, tmp_path):
    (tmp_path / "c.csv").write_text('customer_id,name,note\n00101,"Ann, ""A""",NA\n00015,,"null"\n')
    df = csvtext.read_text_table(spark, str(tmp_path / "c.csv"))
    assert [f.dataType.simpleString() for f in df.schema] == ["string"] * 3
    assert [tuple(r) for r in df.collect()] == [("00101", 'Ann, "A"', "NA"), ("00015", "", "null")]


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "c.csv").write_text("a,b\n1,2\n3\n4,5,6\n7,8\n")
    df = csvtext.read_flagging_malformed(spark, str(tmp_path / "c.csv"), ["a", "b"])
    issue = csvtext.malformed_records(df, "t").first()
    assert (issue.issue_type, issue.affected_rows, issue.total_rows, issue.evidence_samples) == ("malformed_file", 2, 4, ["3", "4,5,6"])
    clean = csvtext.read_flagging_malformed(spark, str(tmp_path / "c.csv"), ["a", "b"]).where(F.col("b").isin("2", "8"))
    assert clean.count() == 2


def _workbook(path, sheets):
    """A minimal workbook: sheet name to rows; strings are shared, others are numbers."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared = []
    with zipfile.ZipFile(path, "w") as book:
        for n, rows in enumerate(sheets.values(), 1):
            body = ""
            for r, row in enumerate(rows, 1):
                cells = ""
                for c, value in enumerate(row):
                    ref = f"{chr(65 + c)}{r}"
                    if isinstance(value, str):
                        shared.append(value)
                        cells += f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'
                    elif isinstance(value, tuple):  # a date by style
                        cells += f'<c r="{ref}" s="1"><v>{value[0]}</v></c>'
                    elif value is not None:
                        cells += f'<c r="{ref}"><v>{value}</v></c>'
                body += f'<row r="{r}">{cells}</row>'
            book.writestr(f"xl/worksheets/sheet{n}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
        names = "".join(f'<sheet name="{s}" sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="t" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        book.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')


def test_workbooks(spark, tmp_path):
    _workbook(
        tmp_path / "products.xlsx",
        {
            "Products": [["product_id", "base_price", "since"], ["PROD_001", 4500, (46023,)], ["002", None, None]],
            "Categories": [["category_id"], ["CAT_TECH"]],
        },
    )
    (tmp_path / "other.csv").write_text("a\n1\n")
    rows = workbook.workbook_rows(spark, str(tmp_path))
    assert workbook.sheet_names(rows).first().sheets == ["Products", "Categories"]
    products = workbook.sheet_table(rows)
    assert products.columns == ["product_id", "base_price", "since"]
    assert [tuple(r) for r in products.collect()] == [("PROD_001", "4500", "2026-01-01 00:00:00"), ("002", "", "")]
    assert [tuple(r) for r in workbook.sheet_table(rows, sheet="Categories").collect()] == [("CAT_TECH",)]
    with pytest.raises(ValueError):
        workbook.sheet_table(rows, sheet="None")


def test_admission_and_fingerprints(spark, tmp_path):
    (tmp_path / "Big Orders.csv").write_text("a,b\n" + "1,2\n" * 50)
    (tmp_path / "small.csv").write_text("a\n1\n")
    (tmp_path / "x.exe").write_bytes(b"MZ")
    files = manifest.admission(manifest.list_files(spark, str(tmp_path)), max_bytes=100)
    assert {r.file_name: r.reject_reason for r in files.select("file_name", "reject_reason").collect()} == {
        "Big Orders.csv": "File exceeds 100 bytes", "small.csv": None, "x.exe": "Extension not allowed: .exe",
    }
    prints = {r.file_name: r.sha256 for r in manifest.fingerprints(manifest.list_files(spark, str(tmp_path))).collect()}
    assert prints["small.csv"] == hashlib.sha256(b"a\n1\n").hexdigest()


def test_listing_does_not_read_content(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a\n")
    listed = manifest.admission(manifest.list_files(spark, str(tmp_path))).select("file_name", "reject_reason")
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_manifest_and_changes(spark, tmp_path):
    (tmp_path / "Big Orders.csv").write_text('id,"a,b"\n1,x\n2,"y,z"\n')
    (tmp_path / "empty.csv").write_text("id\n")
    listed = {r.table_name: r for r in manifest.csv_manifest(spark, str(tmp_path)).collect()}
    assert (listed["big_orders"].row_count, listed["big_orders"].column_count) == (2, 2)
    assert (listed["empty"].row_count, listed["empty"].column_count) == (0, 1)
    before = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    after = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, sha256 string")
    states = {r.path: r.state for r in manifest.file_changes(after, before).collect()}
    assert states == {"a": "unchanged", "b": "changed", "c": "missing", "d": "new"}


def test_artifacts(spark, tmp_path, rows):
    path = str(tmp_path / "artifacts")

    def save(artifact_id, kind, payload, at):
        df = spark.createDataFrame([(payload,)], "v int")
        store.append_artifacts(
            store.as_artifacts(df, run_id="r1", artifact_type=kind, artifact_id=F.lit(artifact_id), created_at=F.lit(at).cast("timestamp")), path
        )

    save("a", "Plan", 1, "2026-01-01 10:00:00")
    save("b", "Plan", 2, "2026-01-01 11:00:00")
    save("a", "Plan", 3, "2026-01-01 12:00:00")  # replaces the first
    save("c", "Report", 4, "2026-01-01 09:00:00")
    artifacts = store.read_artifacts(spark, path)
    assert artifacts.count() == 4 and store.current_artifacts(artifacts).count() == 3
    latest = store.latest_artifacts(artifacts)
    assert rows(latest, "artifact_type", "data_json") == [("Plan", '{"v":3}'), ("Report", '{"v":4}')]


def test_events(spark, tmp_path):
    path = str(tmp_path / "events")
    events = spark.createDataFrame([(2, "r1", "B"), (1, "r1", "A"), (3, "r2", "A")], "event_id long, run_id string, stage string")
    store.append_events(events, path)
    read = spark.read.parquet(path)
    assert [r.stage for r in store.run_events(read, "r1").collect()] == ["A", "B"]
    assert [r.event_id for r in store.newest(read, by="event_id", limit=2).collect()] == [3, 2]


def test_fixture(spark):
    orders = fixture.orders(spark, draws=4000)
    assert orders.columns == list(fixture.ORDER_COLUMNS)
    assert orders.count() == orders.select("order_id").distinct().count()
    # the same rows whatever the partitioning
    assert sorted(map(tuple, orders.collect())) == sorted(map(tuple, fixture.orders(spark, draws=4000).repartition(3).collect()))
    assert orders.where(F.col("customer_id") == fixture.ORPHAN_CUSTOMER).count() == 5
    assert orders.where(F.col("product_id") == fixture.ORPHAN_PRODUCT).count() == 3
    invalid = quality.invalid_dates(orders, "orders").first()
    assert (invalid.affected_rows, invalid.evidence_samples) == (2, ["2026-02-30", "CORRUPT_DATE"])
    june = quality.incomplete_last_period(orders, "orders", column="order_date").first()
    assert june.evidence_samples == ["2026-06: 4 of 30 days"]
    customers = fixture.customers(spark)
    assert customers.count() == 81 and quality.duplicate_keys(customers, "customers").first().evidence_samples == ["00015"]
    truth = {(r.period, r.channel): r.net_sales for r in fixture.truth(orders).collect()}
    assert truth["2026-05", fixture.WHOLESALE] < 0.5 * truth["2026-03", fixture.WHOLESALE]
    assert [t.count() for t in (fixture.products(spark), fixture.categories(spark), fixture.campaigns(spark))] == [8, 4, 4]


def test_facts_by_month(spark, tmp_path):
    path = str(tmp_path / "fact")
    fact = spark.range(1200).select(
        "id", F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("order_date_clean")
    )
    store.write_by_month(fact, path)
    assert store.read_months(spark, path).count() == 1200
    february = store.read_months(spark, path, "2026-02", "2026-02")
    assert february.columns == ["id", "order_date_clean"]
    assert february.count() == fact.where("month(order_date_clean) = 2").count()
    plan = february._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan
