"""Roles of tables and columns, read from their names. No Spark job is run."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

# Name fragments which give a table or column its role.
FACT_NAME_PARTS = ("order", "venta")
DIMENSION_NAME_PARTS = ("customer", "product")
ID_NAME_PARTS = ("id", "code")
KEY_NAME_PARTS = ("id", "cod")
DATE_NAME_PARTS = ("date", "fecha")
STATUS_NAMES = ("status", "estado")

# What one row of a table means, by column name or table name part.
ROW_MEANINGS = (
    (("order_id", "orden_id"), "venta", "Sales fact: a row is an order or an order line"),
    (("customer_id",), "cliente", "Customer dimension: a row is a customer"),
    (("product_id",), "producto", "Product dimension: a row is a product"),
    (("campaign_id",), "campaña", "Campaign dimension: a row is a campaign"),
)
GENERAL_MEANING = "Other table"


def has_part(name: str, parts: Iterable[str]) -> bool:
    return any(part in name.lower() for part in parts)


def columns_with(columns: Sequence[str], parts: Iterable[str]) -> list[str]:
    return [c for c in columns if has_part(c, parts)]


def first_with(columns: Sequence[str], parts: Iterable[str]) -> str | None:
    return next(iter(columns_with(columns, parts)), None)


def status_column(columns: Sequence[str]) -> str | None:
    return next((c for c in columns if c.lower() in STATUS_NAMES), None)


def is_fact_name(table_id: str) -> bool:
    return has_part(table_id, FACT_NAME_PARTS)


def is_keyed_dimension_name(table_id: str) -> bool:
    return has_part(table_id, DIMENSION_NAME_PARTS)


def pick_fact(table_ids: Sequence[str]) -> str:
    """The first table named like a fact, else the first table."""
    return next((t for t in table_ids if is_fact_name(t)), table_ids[0])


def row_meaning(table_id: str, columns: Sequence[str]) -> str:
    for names, part, meaning in ROW_MEANINGS:
        if part in table_id.lower() or any(n in columns for n in names):
            return meaning
    return GENERAL_MEANING


def display_title(table_id: str) -> str:
    return table_id.replace("_", " ").title()


def table_name_of(file_name: Column) -> Column:
    """File name to table name: lower-cased stem with underscores for blanks."""
    stem = F.regexp_extract(file_name, r"([^/]+?)(\.[^./]*)?$", 1)
    return F.replace(F.lower(stem), F.lit(" "), F.lit("_"))
