"""Canonical schema changes at run time: attributes become columns and columns attributes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.fixed import REGISTRY

TABLES = ("customers", "products", "salespersons", "regions", "orders", "order_line_items")
TYPES = {"STRING": "string", "INTEGER": "int", "DECIMAL": "decimal(15,2)", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp"}


def _checked(table: str, name: str) -> None:
    if table not in TABLES:
        raise ValueError(f"unknown table {table}")
    if not re.fullmatch(r"[a-z_][a-z0-9_]{0,62}", name):
        raise ValueError(f"not an identifier: {name}")


def promote(df: DataFrame, table: str, key: str, kind: str = "STRING") -> DataFrame:
    """Give ``additional_attributes[key]`` a column of its own; values that don't fit become null."""
    _checked(table, key)
    if key in df.columns:
        raise ValueError(f"{table} has a column {key}")
    out = df.withColumn(key, F.try_element_at("additional_attributes", F.lit(key)).try_cast(TYPES[kind]))
    return out.withColumn("additional_attributes", F.map_filter("additional_attributes", lambda k, v: k != key))


def demote(df: DataFrame, table: str, column: str) -> DataFrame:
    """Move a column's values back into the additional attributes; nulls leave no key."""
    _checked(table, column)
    rest = F.map_filter(F.coalesce("additional_attributes", F.create_map().cast("map<string,string>")), lambda k, v: k != column)
    own = F.create_map(F.lit(column), F.col(column).cast("string"))
    return df.withColumn("additional_attributes", F.when(F.col(column).isNotNull(), F.map_concat(rest, own)).otherwise(rest)).drop(column)


def register(table: str, column: str, kind: str, targets: list | None = None) -> list:
    return [*(targets or REGISTRY), (table, column, kind, [column])]


def deregister(table: str, column: str, targets: list | None = None) -> list:
    return [t for t in (targets or REGISTRY) if (t[0], t[1]) != (table, column)]
