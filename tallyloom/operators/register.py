"""The register of sources and the list of jobs, as tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What sources can be.
TYPES = ("CSV_FILE", "EXCEL_FILE", "JDBC_POSTGRES", "JDBC_MYSQL", "KAFKA_STREAM")
SOURCES = "source_id string, name string, source_type string, trust decimal(3,2), active boolean, config map<string,string>, created_by long, created_at timestamp"


@dataclass(frozen=True)
class Sources:
    """The register under ``path``: rows are appended, one file for each call."""

    spark: SparkSession
    path: str

    def all(self) -> DataFrame:
        self.spark.createDataFrame([], SOURCES).write.mode("ignore").parquet(self.path)
        return self.spark.read.schema(SOURCES).parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        """Register sources (columns of SOURCES; created_at may lack). All are refused if one has no id or name, an unknown type, a trust outside 0
        to 1, or an id that is taken."""
        if "created_at" not in rows.columns:
            rows = rows.withColumn("created_at", F.lit(datetime.now(UTC)))
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.all().schema])
        good = (F.trim("source_id") != "") & (F.trim("name") != "") & F.col("source_type").isin(*TYPES) & F.col("trust").between(0, 1)
        bad = rows.where(~F.coalesce(good, F.lit(False))).select("source_id").head(1)
        if bad:
            raise ValueError(f"not a source: {bad[0]['source_id']}")
        taken = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).join(self.all().select("source_id", F.lit(True).alias("old")), "source_id", "left").where("n > 1 OR old").head(1)
        if taken:
            raise ValueError(f"there is a source {taken[0]['source_id']} already")
        rows.write.mode("append").parquet(self.path)

    def get(self, source_id: str) -> dict:
        found = self.all().where(F.col("source_id") == source_id).head(1)
        if not found:
            raise ValueError(f"no source {source_id}")
        return found[0].asDict()

    def of_user(self, user: int) -> DataFrame:
        return self.all().where(F.col("created_by") == user)


def jobs(counters: DataFrame, scores: DataFrame) -> DataFrame:
    """The list of finished jobs: their counters with score and grade."""
    return counters.join(scores.select("source_id", "job_id", "overall", "grade"), ["source_id", "job_id"], "left").withColumn("status", F.lit("COMPLETED"))
