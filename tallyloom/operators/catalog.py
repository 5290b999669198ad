"""Canonical tables in the session's catalog, whose columns change at run time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.functions.lineage import written
from tallyloom.operators import evolve
from tallyloom.operators.canonical import Entity, empty_store


class Catalog:
    """The tables of one database. Columns are looked up in the catalog once and kept until ``promote`` or ``demote`` change them."""

    def __init__(self, spark: SparkSession, database: str, location: str | None = None):
        self.spark, self.database = spark, database
        self._columns: dict[str, list[str]] = {}
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}" + (f" LOCATION '{location}'" if location else ""))

    def name(self, table: str) -> str:
        if table not in evolve.TABLES:
            raise ValueError(f"unknown table {table}")
        return f"{self.database}.{table}"

    def create(self, entity: Entity) -> None:
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in empty_store(self.spark, entity).schema)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name(entity.table)} ({columns}) USING parquet")

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def columns(self, table: str) -> list[str]:
        if table not in self._columns:
            self._columns[table] = [c.name for c in self.spark.catalog.listColumns(self.name(table))]
        return self._columns[table]

    def known(self) -> dict[str, list[str]]:
        """Columns of each table that exists, as ``mapping.transform_long`` takes them."""
        return {t: self.columns(t) for t in evolve.TABLES if self.spark.catalog.tableExists(f"{self.database}.{t}")}

    def put(self, table: str, rows: DataFrame) -> None:
        """Replace a table's rows; they are written aside first, so they may come from the table itself."""
        written(rows.select(*self.columns(table)), "rows").write.insertInto(self.name(table), overwrite=True)

    def promote(self, table: str, key: str, kind: str = "STRING") -> None:
        """Give an additional attribute a column of its own, filled from what rows have."""
        rows = evolve.promote(self.read(table), table, key, kind)
        self.spark.sql(f"ALTER TABLE {self.name(table)} ADD COLUMNS ({key} {evolve.TYPES[kind]})")
        self._columns.pop(table, None)
        self.put(table, rows)

    def demote(self, table: str, column: str) -> None:
        """Take a column away; its values become additional attributes. The table is made anew beside the old one, then takes its place."""
        if column not in self.columns(table):
            raise ValueError(f"{table} has no column {column}")
        rows = written(evolve.demote(self.read(table), table, column), "rows")
        rows.write.mode("overwrite").format("parquet").saveAsTable(f"{self.name(table)}_next")
        self.spark.sql(f"DROP TABLE {self.name(table)}")
        self.spark.sql(f"ALTER TABLE {self.name(table)}_next RENAME TO {self.name(table)}")
        self._columns.pop(table, None)
