"""Counts for each source, kept up to date by what changes instead of being counted anew.

The table has a partition for each source and a row (kind, key, n) for each count. A change is a table of the same columns
with the differences; only the partitions of its sources are read and written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.lineage import written

_COLUMNS = "kind string, key string, n long, source_id string"


@dataclass(frozen=True)
class Summaries:
    """The table under ``path``."""

    spark: SparkSession
    path: str

    def _all(self) -> DataFrame:
        self.spark.createDataFrame([], _COLUMNS).write.mode("ignore").partitionBy("source_id").parquet(self.path)
        return self.spark.read.schema(_COLUMNS).parquet(self.path)

    def read(self, kind: str | None = None) -> DataFrame:
        """source_id, kind, key, n of all counts that are not 0."""
        rows = self._all().where("n <> 0")
        return (rows if kind is None else rows.where(F.col("kind") == kind)).select("source_id", "kind", "key", "n")

    def apply(self, change: DataFrame) -> None:
        """Add a change (source_id, kind, key, n). Which sources it has is looked up first, by a job over the change; so many names go
        to the driver, no counts."""
        change = written(change.groupBy("source_id", "kind", "key").agg(F.sum("n").alias("n")), "change")
        sources = [r["source_id"] for r in change.select("source_id").distinct().collect()]
        old = self._all().where(F.col("source_id").isin(sources)).select(*change.columns)
        new = written(old.unionByName(change).groupBy("source_id", "kind", "key").agg(F.sum("n").alias("n")), "summary")
        new.select("kind", "key", "n", "source_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(self.path)


def of_conflicts(conflicts: DataFrame, sign: int = 1) -> DataFrame:
    """The change that open conflicts bring to each source they touch; ``sign`` -1: that their end brings."""
    touched = conflicts.where("status = 'OPEN'").select(F.explode(F.array_distinct(F.array("source_a", "source_b"))).alias("source_id"))
    return touched.groupBy("source_id").agg((F.count(F.lit(1)) * sign).alias("n")).select("source_id", F.lit("open_conflicts").alias("kind"), F.lit("").alias("key"), "n")


def of_issues(issues: DataFrame, sign: int = 1) -> DataFrame:
    """The change that issues bring to the counts by severity."""
    return issues.groupBy("source_id", F.col("severity").alias("key")).agg((F.count(F.lit(1)) * sign).alias("n")).select("source_id", F.lit("issues").alias("kind"), "key", "n")
