"""Canonical tables that grow by what changes: each window writes the rows that it made or changed, and readers merge.

A table is a folder with ``changes/window=n/bucket=b`` (the changed rows of a window, whole, by a hash of entity_id) and
``base/upto=n/bucket=b`` (the newest row of each entity up to a window, as compaction left them). ``bases`` names the finished bases,
one row each, written last: readers take the newest of these and the windows after it, so a compaction that dies halfway
leaves nothing that counts.

With ``keys`` the table can be asked for the rows that share a key with others, without reading the rest: ``new_keys/window=n`` has the keys
of each window's rows, ``base_keys/upto=n/part=p`` those of a base, dealt by their hash. A row that changes its key is found by the old one
too until the next base, so what is found is a few rows more than those that match, never fewer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.lineage import cut, written

#: Rows of a bucket come together when they are merged, so a bucket should fit in a task.
BUCKETS = 16
#: Parts of the keys of a base. A window reads those that its own keys fall in, so a store far larger than its windows should have more.
PARTS = 32


@dataclass(frozen=True)
class Versions:
    """A table under ``path`` of rows with the columns of ``schema``, keyed by ``key``. ``keys`` gives the ``hash`` (long) of each key by which rows
    may be asked for, with the columns of the row."""

    spark: SparkSession
    path: str
    schema: str
    key: str = "entity_id"
    buckets: int = BUCKETS
    keys: Callable[[DataFrame], DataFrame] | None = None
    parts: int = PARTS

    def _open(self, name: str, schema: str, *parts: str) -> DataFrame:
        self.spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*parts).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _table(self, name: str, part: str) -> DataFrame:
        return self._open(name, f"{self.schema}, {part} long, bucket int", part, "bucket")

    def _new_keys(self) -> DataFrame:
        return self._open("new_keys", f"hash long, {self.key} string, window long", "window")

    def _base_keys(self) -> DataFrame:
        return self._open("base_keys", f"hash long, {self.key} string, upto long, part int", "upto", "part")

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _part(self):
        return F.pmod("hash", F.lit(self.parts)).cast("int")

    def _put(self, rows: DataFrame, to: str) -> None:
        rows.select(*self.columns, self._bucket().alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{to}")

    @property
    def columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def base(self, before: int) -> int:
        """The newest finished base that ends before a window; -1: none."""
        self.spark.createDataFrame([], "upto long").write.mode("ignore").parquet(f"{self.path}/bases")
        found = self.spark.read.schema("upto long").parquet(f"{self.path}/bases").where(F.col("upto") < before).agg(F.max("upto")).first()[0]
        return -1 if found is None else found

    def write(self, changed: DataFrame, window: int) -> None:
        """Put a window's changed rows; a window that runs again puts them in place of what it had put."""
        self._table("changes", "window")
        if self.keys is not None:
            # the keys first: a window that dies between the two runs again, and keys without a row find nothing
            self._new_keys()
            self.keys(changed).select("hash", self.key).distinct().write.mode("overwrite").parquet(f"{self.path}/new_keys/window={window}")
        self._put(changed, f"changes/window={window}")

    def _rows(self, base: int, before: int) -> DataFrame:
        """All rows of a base and of the windows after it, with ``bucket`` and the window in ``_at``."""
        old = self._table("base", "upto").where(F.col("upto") == base).select(*self.columns, "bucket", F.col("upto").alias("_at"))
        new = self._table("changes", "window").where((F.col("window") > base) & (F.col("window") < before)).select(*self.columns, "bucket", F.col("window").alias("_at"))
        return old.unionByName(new)

    def _newest(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*self.columns), "_at").alias("_row")).select("_row.*")

    def read(self, before: int = 1 << 62) -> DataFrame:
        """The newest row of each entity before a window. Merging is one aggregation by key with partial results in each task."""
        return self._newest(self._rows(self.base(before), before))

    def sharing(self, hashes: DataFrame, before: int = 1 << 62) -> DataFrame:
        """The newest row, before a window, of each entity that has a key among ``hashes`` (hash), or had it since the last base. Of the base's keys only the
        parts of these hashes are read, of the rows only the buckets of the entities found, and only rows of these are merged."""
        if self.keys is None:
            raise ValueError("the table has no keys")
        base = self.base(before)
        wanted = written(hashes.select("hash").distinct(), "wanted")
        parts = sorted(r["part"] for r in wanted.select(self._part().alias("part")).distinct().collect())  # self.parts at most
        old = self._base_keys().where((F.col("upto") == base) & F.col("part").isin(parts)).select("hash", self.key)
        new = self._new_keys().where((F.col("window") > base) & (F.col("window") < before)).select("hash", self.key)
        # Parquet tables have a size, by which Spark decides whether the join needs a shuffle of what is stored
        found = written(old.unionByName(new).join(wanted, "hash", "left_semi").select(self.key).distinct(), "found")
        buckets = sorted(r["bucket"] for r in found.select(self._bucket().alias("bucket")).distinct().collect())  # self.buckets at most
        return self._newest(self._rows(base, before).where(F.col("bucket").isin(buckets)).join(found, self.key, "left_semi"))

    def compact(self, upto: int) -> None:
        """Merge all up to a window into a new base, bucket by bucket. Rows that it replaces stay for readers that have begun. A window that runs
        again makes its base anew from the one before, so it never reads what it replaces."""
        self._table("base", "upto")
        merged = self._newest(self._rows(self.base(upto), upto + 1))
        if self.keys is not None:
            self._base_keys()
            merged = cut(merged)
            dealt = self.keys(merged).select("hash", self.key).distinct().withColumn("part", self._part()).repartition("part").sortWithinPartitions("part", "hash")
            dealt.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/base_keys/upto={upto}")
        self._put(merged, f"base/upto={upto}")
        self.spark.createDataFrame([(upto,)], "upto long").write.mode("append").parquet(f"{self.path}/bases")
