"""Business views over the star-schema tables: a fact, its dimensions, and defects.

The defect views carry every row of their source. Bad dates, repeated keys and
keys without a partner are put in by rules on the key, so that their number grows
with the tables.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from auditflow.operators.joins import safe_left_join
from auditflow.operators.ledger import keep_usable
from auditflow.operators.periods import infer_cutoff
from auditflow.plans import methods

REFUND_FLAG = "R"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a sales fact with exact amounts."""
    return _sales(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))


def _sales(lines: DataFrame, orders: DataFrame) -> DataFrame:
    gross = F.col("l_extendedprice").cast("decimal(18,2)")
    discount = F.col("l_discount").cast("decimal(4,2)")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("o_orderpriority").alias("channel"),
        F.col("l_quantity").cast("long").alias("units"),
        gross.alias("gross_sales"),
        (gross * discount).cast("decimal(18,4)").alias("discount_amount"),
        (gross * (1 - discount)).cast("decimal(18,4)").alias("net_sales"),
        F.when(F.col("l_returnflag") == REFUND_FLAG, "REFUNDED").otherwise("COMPLETED").alias("status"),
    )


def prepared_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed sales up to the last closed month.

    One small job finds the cutoff. As a literal on the stored column, and with the
    status tested on the flag it comes from, both reach the scans.
    """
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    cutoff = infer_cutoff(orders, "o_orderdate")
    if cutoff is not None:
        after = F.lit(cutoff + timedelta(days=1)).cast(orders.schema["o_orderdate"].dataType)
        orders = orders.where(F.col("o_orderdate") < after)
    kept = _sales(lines.where(~F.col("l_returnflag").eqNullSafe(REFUND_FLAG)), orders)
    return keep_usable(kept, date_col="order_date", status_col="status", cutoff=cutoff)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with segment, nation and region."""
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            F.col("c_mktsegment").alias("segment"),
            F.col("n_name").alias("nation"),
            F.col("r_name").alias("region"),
        )
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("category_id"),
        F.col("p_retailprice").cast("decimal(18,4)").alias("base_price"),
    )


def padded_id(c: Column) -> Column:
    return F.lpad(c.cast("string"), 7, "0")


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as text: some dates impossible, corrupt or blank, some orders cancelled."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("order_id"),
        padded_id(F.col("o_custkey")).alias("customer_id"),
        F.col("o_totalprice").cast("decimal(18,4)").alias("net_sales"),
        F.when(key % 211 == 0, "2001-02-30")
        .when(key % 503 == 0, "CORRUPT_DATE")
        .when(key % 701 == 0, "")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("order_date"),
        F.when(F.col("o_orderstatus") == "P", "CANCELLED").otherwise("COMPLETED").alias("status"),
    )


def dirty_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with text ids: some listed twice, some under an id no order uses."""
    key = F.col("c_custkey")
    wrong_id = F.concat(F.lit("X"), padded_id(key))
    branches = F.when(key % 50 == 0, F.array(F.lit(""), F.lit(" (Secondary Branch)"))).otherwise(F.array(F.lit("")))
    return (
        table(spark, sf_dir, "customer")
        .withColumn("branch", F.explode(branches))
        .select(
            F.when(key % 97 == 0, wrong_id).otherwise(padded_id(key)).alias("customer_id"),
            F.concat("c_name", "branch").alias("customer_name"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_nationkey").alias("nation_id"),
        )
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the log of runs: a user is a run, an event type a stage."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("run_id"),
        F.col("event_type").alias("stage"),
        F.col("ts").alias("created_at"),
        "value",
        "props",
    )


def text_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with every cell as text."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("order_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"),
        F.col("o_orderpriority").alias("channel"),
    )


def text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with every cell as text; large sizes are left blank."""
    return table(spark, sf_dir, "part").select(
        padded_id(F.col("p_partkey")).alias("part_no"),
        F.col("p_name").alias("part_name"),
        F.when(F.col("p_size") > 40, "").otherwise(F.col("p_size").cast("string")).alias("size"),
        F.replace(F.col("p_retailprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")).alias("price"),
    )


def untidy_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order amounts and dates as people type them."""
    key = F.col("o_orderkey")
    amount = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(
        key.alias("order_id"),
        F.when(key % 7 == 0, F.replace(amount, F.lit("."), F.lit(",")))
        .when(key % 11 == 0, F.concat(F.lit("1,"), amount))
        .when(key % 13 == 0, F.concat(amount, F.lit("d")))
        .when(key % 17 == 0, "")
        .when(key % 19 == 0, "NaN")
        .when(key % 23 == 0, F.concat(F.lit("-"), amount))
        .otherwise(amount)
        .alias("amount"),
        F.when(key % 7 == 0, F.substring(day, 1, 7))
        .when(key % 11 == 0, "2001-02-30")
        .when(key % 13 == 0, "")
        .otherwise(day)
        .alias("order_date"),
    )


def labelled_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared sales with the region and channel names that questions use.

    Summed per customer and channel before customers bring their region in;
    ``lines`` says how many sales a row stands for.
    """
    region = (
        F.when(F.col("region") == "AFRICA", "South")
        .when(F.col("region") == "EUROPE", "North")
        .when(F.col("region") == "ASIA", "Central")
        .otherwise("Metropolitan")
    )
    channel = (
        F.when(F.col("channel").isin("1-URGENT", "2-HIGH"), "Wholesale / B2B")
        .when(F.col("channel").isin("3-MEDIUM", "4-NOT SPECIFIED"), "Retail / Stores")
        .otherwise("Online / Direct")
    )
    homes = customers(spark, sf_dir).select("customer_id", region.alias("region"))
    summed = prepared_sales(spark, sf_dir).groupBy("customer_id", "channel").agg(
        F.sum("net_sales").alias("net_sales"), F.count(F.lit(1)).alias("lines")
    )
    return (
        safe_left_join(summed, homes, "customer_id")
        .withColumn("channel", channel)
        .select("region", "channel", "net_sales", "lines")
    )


def customer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question per customer, worded after its segment and id."""
    key = F.col("c_custkey")
    place = F.element_at(F.array(*[F.lit(p) for p in ("North", "sur", "Central", "Metropolitan", "Norte")]), (key % 5 + 1).cast("int"))
    way = F.element_at(F.array(*[F.lit(w) for w in ("wholesale", "stores", "online", "mayorista", "any")]), (key % 7 % 5 + 1).cast("int"))
    text = (
        F.when(key % 6 == 0, F.concat(F.lit("How much did the "), place, F.lit(" region sell via "), way, F.lit("?")))
        .when(key % 6 == 1, F.concat(F.lit("¿Cuánto vendió la región "), place, F.lit("?")))
        .when(key % 6 == 2, F.concat(F.lit("Which competitor lowered prices for "), "c_mktsegment", F.lit("?")))
        .when(key % 6 == 3, F.concat(F.lit("Build a predictive model of "), "c_mktsegment", F.lit(" sales")))
        .when(key % 6 == 4, F.concat(F.lit("Filter by "), way, F.lit(" and tell me how much it was")))
        .otherwise(F.concat(F.lit("Why did "), "c_mktsegment", F.lit(" fall?")))
    )
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("customer-"), key.cast("string")).alias("question_id"), text.alias("question"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer questions, conversation turns and documents as one text table."""
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.lit("turn"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
        F.col("text").alias("question"),
    )
    documents = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("document-"), F.col("doc_id").cast("string")).alias("question_id"), F.col("text").alias("question")
    )
    return customer_questions(spark, sf_dir).unionByName(turns).unionByName(documents)


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: the URL as path, the HTML as content."""
    content = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return table(spark, sf_dir, "pages").select(
        F.col("url").alias("path"), F.regexp_extract("url", "([^/]+)$", 1).alias("file_name"),
        F.octet_length(content).cast("long").alias("length"), content.alias("content"),
    )


def page_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Hashes of all pages, and those of a later version: some pages gone, some changed, some new."""
    key, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    pages = table(spark, sf_dir, "pages")
    path = F.concat(F.lit("page-"), key.cast("string"))
    then = pages.select(path.alias("path"), F.sha2(html, 256).alias("sha256"))
    altered = F.when(key % 5 == 0, F.concat(html, F.lit("x"))).otherwise(html)
    later = pages.where(key % 7 != 0).select(path.alias("path"), F.sha2(altered, 256).alias("sha256"))
    added = pages.where(key % 11 == 0).select(F.concat(F.lit("new-"), path).alias("path"), F.sha2(html, 256).alias("sha256"))
    return then, later.unionByName(added)


def order_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as a result and its orders as figures, a few of them not finite."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("result_id"),
        key.alias("item"),
        F.lit("o_totalprice").alias("field"),
        F.when(key % 499 == 0, float("nan")).when(key % 883 == 0, float("inf")).otherwise(F.col("o_totalprice")).alias("value"),
    )


def customer_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pending result per customer, with a warning if its balance is negative."""
    warning = F.when(F.col("c_acctbal") < 0, F.array(F.lit("negative balance"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("result_id"), F.col("c_mktsegment").alias("run_id"), warning.alias("warnings")
    )


def _result_no() -> Column:
    return F.concat(F.lit("R"), (F.floor("value").cast("long") % 10).cast("string"))


def event_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups and views as results of their user's run; high values are rejected."""
    return run_log(spark, sf_dir).where(F.col("stage").isin("signup", "view")).select(
        "run_id", _result_no().alias("result_id"),
        F.when(F.col("value") > 100, "rejected").otherwise("approved").alias("validation_status"),
    )


def event_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as cards, clicks and errors as charts of their user's run."""
    return run_log(spark, sf_dir).where(~F.col("stage").isin("signup", "view")).select(
        "run_id",
        F.col("event_id").alias("component_id"),
        F.when(F.col("stage") == "purchase", "card").otherwise("chart").alias("kind"),
        _result_no().alias("result_id"),
        F.when(F.col("value") > 10, "Total Net Change").otherwise("Baseline").alias("title"),
        F.when(F.col("value") > 5, "2024-01").otherwise("2023-12").alias("period"),
        (F.col("stage") == "error").alias("is_primary"),
        (F.get_json_object("props", "$.k").cast("long") % 5).alias("points"),
    )


def event_plan_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps that their user's plan proposes, with the columns they name."""
    stage = F.col("stage")
    step = (
        F.when(stage == "signup", methods.SUMMARY)
        .when(stage == "click", methods.TREND)
        .when(stage == "purchase", methods.COMPARISON)
        .when(stage == "view", methods.BREAKDOWN_CHANNEL)
        .otherwise("OP_99_UNREGISTERED")
    )
    columns = (
        F.when(F.col("value") > 60, F.array(F.lit("net_sales"), F.lit("no_such_column")))
        .when(stage == "view", F.array(F.lit("Channel"), F.lit("NET_SALES")))
        .otherwise(F.array(F.lit("net_sales")))
    )
    return run_log(spark, sf_dir).select(
        F.col("run_id").alias("plan_id"), F.col("event_id").alias("step_order"), step.alias("step_id"), columns.alias("columns")
    )


def event_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as artifacts of their user's run; each id is saved again from time to time."""
    return run_log(spark, sf_dir).select(
        F.concat_ws("-", "run_id", "stage", (F.col("event_id") % 3).cast("string")).alias("artifact_id"),
        "run_id",
        F.col("stage").alias("artifact_type"),
        F.col("props").alias("data_json"),
        "created_at",
    )


def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of model calls: the event type is the caller."""
    return run_log(spark, sf_dir).select(
        F.col("stage").alias("caller_agent"),
        F.when(F.col("value") > 30, "error").otherwise("success").alias("status"),
        F.floor(F.col("value") * 100).cast("long").alias("input_tokens"),
        F.get_json_object("props", "$.k").cast("long").alias("output_tokens"),
        F.floor(F.col("value") * 10).cast("long").alias("duration_ms"),
    )
