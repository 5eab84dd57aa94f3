"""A scalable sales fixture with known defects and a known truth.

Every value is a hash of the row number, so a row is the same whatever the
partitioning, and any number of rows can be made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from auditflow.functions.parsing import month_key, parse_date

# The members of the fixture and how often they occur.
CAMPAIGNS = (
    ("CMP-01", "Summer Launch", "2026-01-05", "2026-02-15", 15000.0),
    ("CMP-02", "Back to School", "2026-02-20", "2026-03-25", 22000.0),
    ("CMP-03", "B2B Industrial Renewal", "2026-03-01", "2026-04-10", 30000.0),
    ("CMP-04", "Autumn Cyber", "2026-05-01", "2026-05-20", 18000.0),
)
CATEGORIES = (
    ("CAT_TECH", "Technology & Equipment", "Hardware"),
    ("CAT_OFFICE", "Office Supplies", "Consumibles"),
    ("CAT_FURN", "Ergonomic Furniture", "Infraestructura"),
    ("CAT_SERV", "Services & Licenses", "Software"),
)
PRODUCTS = (
    ("PROD_001", "Enterprise Rack Server", "CAT_TECH", 3200.0, 4500.0),
    ("PROD_002", "Professional Workstation", "CAT_TECH", 1400.0, 2100.0),
    ("PROD_003", "Ultrawide 4K Monitor", "CAT_TECH", 450.0, 750.0),
    ("PROD_004", "Ergonomic Pro Chair", "CAT_FURN", 210.0, 380.0),
    ("PROD_005", "Motorized Standing Desk", "CAT_FURN", 390.0, 650.0),
    ("PROD_006", "Corporate Stationery Pack", "CAT_OFFICE", 25.0, 55.0),
    ("PROD_007", "High-Capacity Laser Toner", "CAT_OFFICE", 60.0, 120.0),
    ("PROD_008", "Annual Cloud Subscription", "CAT_SERV", 800.0, 1400.0),
)
REGIONS = ("Metropolitan", "North", "Central", "South")
SEGMENTS = (("Corporate B2B", 0.40), ("Direct Retail", 0.45), ("Institutional", 0.15))
CHANNELS = (("Wholesale / B2B", 0.45), ("Retail / Stores", 0.35), ("Online / Direct", 0.20))
DISCOUNTS = ((0.0, 0.50), (0.05, 0.25), (0.10, 0.15), (0.15, 0.10))
STATUSES = (("COMPLETED", 0.94), ("CANCELLED", 0.04), ("REFUNDED", 0.02))
CAMPAIGN_SHARES = ((1, "CMP-01", 0.6), (2, "CMP-02", 0.5), (3, "CMP-03", 0.4), (5, "CMP-04", 0.5))
WHOLESALE = "Wholesale / B2B"
SUPPRESSED_MONTHS, KEPT_SHARE = (4, 5), 0.25
FIRST_DAY, FULL_DAYS, LAST_MONTH_DAYS, LAST_MONTH_WEIGHT = "2026-01-01", 151, 4, 0.7
MISSING_DISCOUNT_SHARE = 0.05
CUSTOMER_COUNT, DUPLICATED_CUSTOMER = 80, 15
ORPHAN_CUSTOMER, ORPHAN_PRODUCT = "00999", "PROD_999"
INVALID_DATES = (
    ("2026-02-30", "00001", "PROD_002", "Retail / Stores", 2100.0),
    ("CORRUPT_DATE", "00002", "PROD_003", "Online / Direct", 750.0),
)

ORDER_COLUMNS = (
    "order_id", "order_date", "customer_id", "product_id", "campaign_id", "channel", "units", "unit_price",
    "discount_amount", "gross_sales", "net_sales", "status",
)


def _uniform(seed: int, salt: str) -> Column:
    """A number in [0, 1) that depends on the row id, the seed and the salt only."""
    steps = 1 << 30
    return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), F.lit(steps)) / F.lit(float(steps))


def _weighted(u: Column, choices) -> Column:
    picked, reached = F.lit(choices[-1][0]), sum(share for _, share in choices)
    for value, share in reversed(choices):
        reached -= share
        if value != choices[-1][0]:
            picked = F.when(u < reached + share, F.lit(value)).otherwise(picked)
    return picked


def _one_of(u: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


def _customer_id(number: Column) -> Column:
    return F.lpad(number.cast("string"), 5, "0")


def customers(spark: SparkSession, *, count: int = CUSTOMER_COUNT, seed: int = 42) -> DataFrame:
    """Customers with zero-padded ids; one is listed twice, with a second branch."""
    base = spark.range(1, count + 1).select(
        _customer_id(F.col("id")).alias("customer_id"),
        F.concat(F.lit("Corporate Client "), F.col("id").cast("string")).alias("customer_name"),
        _weighted(_uniform(seed, "segment"), SEGMENTS).alias("segment"),
        _one_of(_uniform(seed, "region"), REGIONS).alias("region"),
        F.date_format(
            F.date_add(F.lit("2025-06-01").cast("date"), F.floor(_uniform(seed, "signup") * 240).cast("int")), "yyyy-MM-dd"
        ).alias("signup_date"),
    )
    branch = base.where(F.col("customer_id") == _customer_id(F.lit(DUPLICATED_CUSTOMER))).withColumns(
        {"customer_name": F.concat("customer_name", F.lit(" (Secondary Branch)")), "region": F.lit("South")}
    )
    return base.unionByName(branch)


def _members(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(str(v) for v in row) for row in rows], schema)


def products(spark: SparkSession) -> DataFrame:
    return _members(
        spark, PRODUCTS, "product_id string, product_name string, category_id string, cost_price string, base_price string"
    )


def categories(spark: SparkSession) -> DataFrame:
    return _members(spark, CATEGORIES, "category_id string, category_name string, department string")


def campaigns(spark: SparkSession) -> DataFrame:
    return _members(
        spark, CAMPAIGNS, "campaign_id string, campaign_name string, start_date string, end_date string, budget string"
    )


def _regular_orders(spark: SparkSession, count: int, seed: int, customer_count: int) -> DataFrame:
    position = _uniform(seed, "day") * (FULL_DAYS + LAST_MONTH_DAYS * LAST_MONTH_WEIGHT)
    in_last_month = F.lit(FULL_DAYS) + F.floor((position - FULL_DAYS) / LAST_MONTH_WEIGHT)
    day_number = F.when(position < FULL_DAYS, F.floor(position)).otherwise(in_last_month).cast("int")
    drawn = spark.range(count).select(
        "id",
        F.date_add(F.lit(FIRST_DAY).cast("date"), day_number).alias("day"),
        _weighted(_uniform(seed, "channel"), CHANNELS).alias("channel"),
        _customer_id((F.floor(_uniform(seed, "customer") * customer_count) + 1)).alias("customer_id"),
        (F.floor(_uniform(seed, "product") * len(PRODUCTS)) + 1).cast("int").alias("product_no"),
        _uniform(seed, "units").alias("units_u"),
        _weighted(_uniform(seed, "discount"), DISCOUNTS).alias("discount_pct"),
        _weighted(_uniform(seed, "status"), STATUSES).alias("status"),
        _uniform(seed, "campaign").alias("campaign_u"),
        _uniform(seed, "missing").alias("missing_u"),
        _uniform(seed, "kept").alias("kept_u"),
    )
    month = F.month("day")
    wholesale = F.col("channel") == WHOLESALE
    suppressed = month.isin(*SUPPRESSED_MONTHS) & wholesale & (F.col("kept_u") > KEPT_SHARE)
    units = F.when(wholesale, 5 + F.floor(F.col("units_u") * 20)).otherwise(1 + F.floor(F.col("units_u") * 3))
    price = F.element_at(F.array(*[F.lit(p[4]) for p in PRODUCTS]), F.col("product_no")).cast("decimal(18,2)")
    campaign = F.lit(None).cast("string")
    for number, name, share in CAMPAIGN_SHARES:
        campaign = F.when((month == number) & (F.col("campaign_u") < share), F.lit(name)).otherwise(campaign)
    priced = drawn.where(~suppressed).withColumns({"units": units.cast("long"), "unit_price": price, "campaign_id": campaign})
    gross = (F.col("units") * F.col("unit_price")).cast("decimal(18,2)")
    discount = F.round(gross * F.col("discount_pct").cast("decimal(4,2)"), 2).cast("decimal(18,2)")
    return priced.select(
        "id",
        F.date_format("day", "yyyy-MM-dd").alias("order_date"),
        "customer_id",
        F.element_at(F.array(*[F.lit(p[0]) for p in PRODUCTS]), F.col("product_no")).alias("product_id"),
        "campaign_id",
        "channel",
        "units",
        "unit_price",
        F.when(F.col("missing_u") > MISSING_DISCOUNT_SHARE, discount).alias("discount_amount"),
        gross.alias("gross_sales"),
        (gross - discount).cast("decimal(18,2)").alias("net_sales"),
        "status",
    )


def _defect(rows: DataFrame, day: Column, customer: Column, product: Column, channel: Column, units: int, price: Column) -> DataFrame:
    unit_price = price.cast("decimal(18,2)")
    amount = (unit_price * units).cast("decimal(18,2)")
    return rows.select(
        "id",
        day.alias("order_date"),
        customer.alias("customer_id"),
        product.alias("product_id"),
        F.lit(None).cast("string").alias("campaign_id"),
        channel.alias("channel"),
        F.lit(units).cast("long").alias("units"),
        unit_price.alias("unit_price"),
        F.lit(0).cast("decimal(18,2)").alias("discount_amount"),
        amount.alias("gross_sales"),
        amount.alias("net_sales"),
        F.lit("COMPLETED").alias("status"),
    )


def orders(
    spark: SparkSession,
    *,
    draws: int = 3000,
    seed: int = 42,
    customer_count: int = CUSTOMER_COUNT,
    orphan_customers: int = 5,
    orphan_products: int = 3,
    invalid_date_rounds: int = 1,
) -> DataFrame:
    """Orders as text. ``draws`` counts orders before wholesale ones of two months are suppressed."""
    end = draws + orphan_customers
    orphans = _defect(
        spark.range(draws, end), F.lit("2026-03-15"), F.lit(ORPHAN_CUSTOMER), F.lit("PROD_001"),
        F.lit("Retail / Stores"), 2, F.lit(4500.0),
    )
    lost_products = _defect(
        spark.range(end, end + orphan_products), F.lit("2026-04-12"), F.lit("00005"), F.lit(ORPHAN_PRODUCT),
        F.lit("Online / Direct"), 1, F.lit(1000.0),
    )
    end += orphan_products
    rows = _regular_orders(spark, draws, seed, customer_count).unionByName(orphans).unionByName(lost_products)
    for i, (day, customer, product, channel, price) in enumerate(INVALID_DATES):
        ids = spark.range(end + i, end + i + invalid_date_rounds * len(INVALID_DATES), len(INVALID_DATES))
        rows = rows.unionByName(_defect(ids, F.lit(day), F.lit(customer), F.lit(product), F.lit(channel), 1, F.lit(price)))
    numbered = rows.withColumn("order_id", F.concat(F.lit("ORD-"), (F.col("id") + 10001).cast("string")))
    return numbered.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ORDER_COLUMNS])


def truth(order_rows: DataFrame) -> DataFrame:
    """Net sales per month and channel of completed, dated, non-orphan orders."""
    day = parse_date(F.col("order_date"))
    usable = (
        (F.col("status") == "COMPLETED")
        & day.isNotNull()
        & (F.col("customer_id") != ORPHAN_CUSTOMER)
        & (F.col("product_id") != ORPHAN_PRODUCT)
    )
    return (
        order_rows.where(usable)
        .groupBy(F.trunc(day, "MM").alias("month"), "channel")
        .agg(F.sum(F.col("net_sales").cast("decimal(18,4)")).alias("net_sales"), F.count(F.lit(1)).alias("orders"))
        .select(month_key(F.col("month")).alias("period"), "channel", F.col("net_sales").cast("double").alias("net_sales"), "orders")
    )
