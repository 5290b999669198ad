"""What jobs leave behind: field profiles, schema versions and a ledger, appended and never rewritten.

Each table is a folder under one root with a partition for each source and job (``seq``, rising with time; schema versions have one
for each source and version). A job looks up its forerunners in the ledger, which has one row for each job, and then
reads only the partitions of these. A job that runs again replaces its own partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators import profiling

_COLUMNS = {
    "profiles": "job_id string, field string, inferred_type string, null_rate decimal(5,4), top_values array<string>, min_value string, max_value string",
    "versions": "job_id string, field string, inferred_type string",
    "ledger": "job_id string, version int, changed int, drifted int",
}
_KEYS = {"profiles": "source_id string, seq long", "versions": "source_id string, version int", "ledger": "source_id string, seq long"}
#: Profiles that drift is judged by, the job's own among them.
DRIFT_JOBS = 3


@dataclass(frozen=True)
class History:
    """The tables under ``root``; read and written in the session ``spark``."""

    spark: SparkSession
    root: str

    def read(self, name: str) -> DataFrame:
        """The table, empty if nothing was written yet."""
        schema = f"{_COLUMNS[name]}, {_KEYS[name]}"
        self.spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*self._keys(name)).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def write(self, name: str, rows: DataFrame) -> None:
        keys = self._keys(name)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{self.root}/{name}")

    @staticmethod
    def _keys(name: str) -> list[str]:
        return [k.split()[0] for k in _KEYS[name].split(", ")]

    def before(self, source_id: str, seq: int, k: int = DRIFT_JOBS - 1) -> list[dict]:
        """The last ``k`` jobs of a source before ``seq``, newest first: their rows of the ledger."""
        own = self.read("ledger").where((F.col("source_id") == source_id) & (F.col("seq") < seq))
        return [r.asDict() for r in own.orderBy(F.desc("seq")).limit(k).collect()]

    def profiles(self, source_id: str, seqs: list[int]) -> DataFrame:
        """Profiles of some jobs of a source: no other partition is read."""
        return self.read("profiles").where((F.col("source_id") == source_id) & F.col("seq").isin([int(s) for s in seqs]))


def after_job(history: History, source_id: str, job_id: str, seq: int, profiles: DataFrame) -> DataFrame:
    """Record a job's profiles and, if its fields or their types differ from the active version's, a new version. Gives the issues that
    statistical drift against the last jobs raises, in the columns of record issues (without row and order of the rule)."""
    past = history.before(source_id, seq)
    now = profiles.withColumn("job_id", F.lit(job_id)).select(*[c.split()[0] for c in _COLUMNS["profiles"].split(", ")], F.lit(source_id).alias("source_id"), F.lit(seq).cast("long").alias("seq"))
    history.write("profiles", now)
    own = history.profiles(source_id, [seq])
    recent = history.profiles(source_id, [p["seq"] for p in past] + [seq])
    found = profiling.profile_drift(recent.withColumnRenamed("seq", "batch"), DRIFT_JOBS)
    issues = found.select(
        "source_id", F.lit(job_id).alias("job_id"), F.lit(None).cast("long").alias("row_number"), F.lit(None).cast("int").alias("rule_ord"), "rule", "dimension", "severity", "field", "message", F.lit("OPEN").alias("status")
    )
    version = past[0]["version"] if past else 0
    active = history.read("versions").where((F.col("source_id") == source_id) & (F.col("version") == version))
    changed = profiling.drift(active, own).count() if past else own.count()
    if changed:
        version += 1
        history.write("versions", own.select("job_id", "field", "inferred_type", "source_id", F.lit(version).alias("version")))
    line = [(source_id, seq, job_id, version, changed, issues.count())]
    history.write("ledger", history.spark.createDataFrame(line, "source_id string, seq long, job_id string, version int, changed int, drifted int").select("job_id", "version", "changed", "drifted", "source_id", "seq"))
    return issues


def schema_versions(history: History, source_id: str | None = None) -> DataFrame:
    """Schema versions, newest first within each source: source_id, version, status, job_id, fields. The newest is active."""
    rows = history.read("versions")
    if source_id is not None:
        rows = rows.where(F.col("source_id") == source_id)
    each = rows.groupBy("source_id", "version").agg(F.max("job_id").alias("job_id"), F.count(F.lit(1)).alias("fields"))
    newest = F.max("version").over(Window.partitionBy("source_id"))
    status = F.when(F.col("version") == newest, "ACTIVE").otherwise("SUPERSEDED")
    return each.select("source_id", "version", status.alias("status"), "job_id", "fields").orderBy("source_id", F.desc("version"))
