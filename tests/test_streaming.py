from datetime import datetime

import pytest
from pyspark.sql import functions as F

from auditflow.operators import ledger
from auditflow.streaming import audits

SCHEMA = "order_id string, order_date string, status string, net_sales string"


def _land(spark, folder, batch, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{batch}")


def test_quarantine_split(spark, tmp_path):
    source = str(tmp_path / "in")
    _land(spark, source, "b=1", [("O1", "2026-01-01", "COMPLETED", "1,5"), ("O2", "bad", "COMPLETED", "2")])
    _land(spark, source, "b=2", [("O3", "2026-01-02", "CANCELLED", "3"), ("O4", "2026-07-01", "COMPLETED", "4")])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    split = audits.split_quarantine(stream, cutoff="2026-05-31")
    query = audits.write_quarantine(split, str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True)
    query.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    found = {r.order_id: (r.row_state, r.exclusion_reason) for r in out.collect()}
    assert found["O1"] == ("clean", None)
    assert {k: v[0] for k, v in found.items() if k != "O1"} == dict.fromkeys(["O2", "O3", "O4"], "quarantined")
    # the same split as in batch
    batch = ledger.clean_rows(ledger.flag_exclusions(spark.read.schema(SCHEMA).parquet(f"{source}/*"), cutoff="2026-05-31"))
    assert [r.order_id for r in batch.collect()] == ["O1"]


def test_closed_periods(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "order_ts timestamp, net_sales double"
    _land(spark, source, "b1", [(datetime(2026, 1, 30, 9), 1.0), (datetime(2026, 1, 31, 9), 2.0)], schema)
    _land(spark, source, "b2", [(datetime(2026, 2, 3, 9), 4.0), (datetime(2026, 1, 31, 23), 8.0)], schema)
    _land(spark, source, "b3", [(datetime(2026, 1, 2, 9), 99.0), (datetime(2026, 2, 10, 9), 16.0)], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{source}/*")
    days = audits.closed_days(stream, "order_ts", delay="1 day")
    query = (
        days.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination(120)
    emitted = spark.read.parquet(str(tmp_path / "out"))
    found = {str(r.day): float(r.net_sales) for r in emitted.collect()}
    assert found["2026-01-31"] == 10.0 and "2026-02-10" not in found
    assert "2026-01-02" not in found  # too late: dropped by the watermark
    months = audits.closed_month_trend(emitted).collect()
    assert [(r.period, r.net_sales, r.order_count) for r in months] == [("2026-01", 11.0, 3)]


def test_stream_static_join(spark, tmp_path):
    source = str(tmp_path / "in")
    _land(spark, source, "b1", [("O1", "C1"), ("O2", "C9")], "order_id string, customer_id string")
    dim = spark.createDataFrame([("C1", "first"), ("C1", "second")], "customer_id string, name string")
    stream = spark.readStream.schema("order_id string, customer_id string").parquet(f"{source}/*")
    query = (
        audits.join_dimension(stream, dim, "customer_id").writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("order_id", "name").collect()) == [("O1", "first"), ("O2", None)]


def test_closed_months_and_corrections_make_the_trend(spark, sf_dir, tmp_path):
    """Orders arrive by date, a tenth of them much later."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("order_ts"), F.col("o_totalprice").alias("net_sales"))
    when = F.when(F.col("o_orderkey") % 10 == 3, F.add_months("order_ts", 9)).otherwise(F.col("order_ts").cast("date"))
    arriving = orders.withColumn("year", F.year(when))
    years = [r[0] for r in arriving.select("year").distinct().orderBy("year").collect()]
    source, folder, schema = str(tmp_path / "in"), str(tmp_path / "out"), "order_ts timestamp, net_sales double"
    for i, year in enumerate(years):
        arriving.where(F.col("year") == year).select("order_ts", "net_sales").coalesce(1).write.parquet(f"{source}/b{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    for _ in range(2):  # started again, it adds nothing
        query = audits.write_closed_days(stream, folder, str(tmp_path / "ck"), time_col="order_ts", available_now=True)
        query.awaitTermination(240)
        assert query.exception() is None
    days, late = audits.read_closed_days(spark, folder), audits.late_rows(spark, folder)
    assert days.groupBy("day").count().where("count > 1").count() == 0 and late.count() > 0
    trend = {r.period: (r.net_sales, r.order_count) for r in audits.closed_month_trend(days).collect()}
    more = {r.period: (r.net_sales, r.order_count) for r in audits.month_corrections(late).collect()}
    plain = orders.groupBy(F.date_format("order_ts", "yyyy-MM").alias("p")).agg(F.sum(F.col("net_sales").cast("decimal(18,4)")).cast("double").alias("v"), F.count(F.lit(1)).alias("n"))
    expected = {r.p: (r.v, r.n) for r in plain.collect()}
    assert len(trend) > 20
    for period in trend:
        value, n = (a + b for a, b in zip(trend[period], more.get(period, (0, 0))))
        assert n == expected[period][1] and value == pytest.approx(expected[period][0], abs=0.02)
