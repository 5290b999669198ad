"""Which staged events were seen before, without a time limit and without reading all of them.

``recent/batch=n`` has the keys of each window since the last compaction, and is read as it is. ``base/gen=g/prefix=xx`` has the older
ones, dealt by the first digits of their hash, and ``blooms`` a Bloom filter for each generation and prefix. New events are tested against the
filters of their prefixes; only those that hit are looked up, and only in the prefixes where any did. ``gens`` names the finished
generations with the last window in each, written last, so a compaction that dies halfway leaves nothing that counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.lineage import cut, written

KEY = ["source_id", "record_hash"]
#: Bits of a filter for each key, and how many of them a key sets: about one key in a hundred hits by chance.
BITS, HASHES = 10, 7


def _bits(one: np.ndarray, two: np.ndarray, size: int) -> np.ndarray:
    """Places of the bits that keys set, a row for each, from two hashes."""
    steps = np.arange(HASHES, dtype="u8")
    return (one.view("u8")[:, None] + steps * (two.view("u8")[:, None] | np.uint64(1))) % np.uint64(size)


def _hashed(df: DataFrame, digits: int) -> DataFrame:
    return df.select(*KEY, F.substring("record_hash", 1, digits).alias("prefix"), F.xxhash64(*KEY).alias("one"), F.xxhash64(F.lit(7), *KEY).alias("two"))


def build_filters(keys: DataFrame) -> DataFrame:
    """prefix, size, bits: a Bloom filter of the keys (with prefix, one, two) of each prefix."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        size = max(64, rows.num_rows * BITS)
        bits = np.zeros(size, bool)
        bits[_bits(rows.column("one").to_numpy(), rows.column("two").to_numpy(), size).ravel()] = True
        return pa.table({"prefix": pa.array([key[0].as_py()]), "size": pa.array([size], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    return keys.select("prefix", "one", "two").groupBy("prefix").applyInArrow(run, "prefix string, size long, bits binary")


def possible(events: DataFrame, filters: DataFrame) -> DataFrame:
    """The events (with prefix, one, two) that any filter of their prefix may hold. A prefix' filters and events meet in one task."""

    def run(key: tuple, rows: pa.Table, filters: pa.Table) -> pa.Table:
        hit = np.zeros(rows.num_rows, bool)
        one, two = rows.column("one").to_numpy(), rows.column("two").to_numpy()
        for size, packed in zip(filters.column("size").to_pylist(), filters.column("bits").to_pylist(), strict=True):
            bits = np.unpackbits(np.frombuffer(packed, "u1"), count=size).astype(bool)
            hit |= bits[_bits(one, two, size)].all(1)
        return rows.select([*KEY, "prefix"]).filter(pa.array(hit))

    return events.groupBy("prefix").cogroup(filters.groupBy("prefix")).applyInArrow(run, "source_id string, record_hash string, prefix string")


@dataclass(frozen=True)
class Seen:
    """The index under ``path``. ``digits``: hexadecimal digits of the hash that make a prefix, so many that a prefix' keys of one generation fit in a task."""

    spark: SparkSession
    path: str
    digits: int = 2

    def _read(self, name: str, schema: str, *parts: str) -> DataFrame:
        self.spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*parts).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _gens(self, before: int) -> list:
        known = self._read("gens", "gen long, upto long").where(F.col("upto") < before)
        return known.orderBy("gen").collect()

    def recent(self, before: int, since: int) -> DataFrame:
        rows = self._read("recent", "source_id string, record_hash string, batch long", "batch")
        return rows.where((F.col("batch") < before) & (F.col("batch") > since))

    def base(self, gens: list[int], prefixes: list[str]) -> DataFrame:
        """The older keys of some prefixes: no other folder is read."""
        rows = self._read("base", "source_id string, record_hash string, gen long, prefix string", "gen", "prefix")
        return rows.where(F.col("gen").isin([int(g) for g in gens]) & F.col("prefix").isin(prefixes)).select(*KEY)

    def fresh(self, events: DataFrame, batch: int) -> DataFrame:
        """The first of equal events of a window that no window before it had. Columns of ``events`` stay."""
        once = written(events.dropDuplicates(KEY), "once")
        gens = self._gens(batch)
        since = max((g["upto"] for g in gens), default=-1)
        new = once.join(self.recent(batch, since).select(*KEY), KEY, "left_anti")
        if not gens:
            return new
        filters = self._read("blooms", "size long, bits binary, gen long, prefix string", "gen", "prefix").where(F.col("gen").isin([int(g["gen"]) for g in gens]))
        hits = cut(possible(_hashed(new, self.digits), filters))
        prefixes = sorted(r["prefix"] for r in hits.select("prefix").distinct().collect())  # 16 ** digits at most
        if not prefixes:
            return new
        known = hits.select(*KEY).join(self.base([g["gen"] for g in gens], prefixes), KEY, "left_semi")
        return new.join(known, KEY, "left_anti")

    def add(self, rows: DataFrame, batch: int) -> None:
        """Put a window's staged keys; a window that runs again puts them in place of what it had put."""
        self.recent(0, 0)
        rows.select(*KEY).write.mode("overwrite").parquet(f"{self.path}/recent/batch={batch}")

    def compact(self, upto: int) -> None:
        """Make the recent windows up to one a generation of the base, with its filters. Older generations stay as they are."""
        gens = self._gens(1 << 62)
        gen, since = len(gens), max((g["upto"] for g in gens), default=-1)
        keys = _hashed(self.recent(upto + 1, since), self.digits)
        self.base([], [])
        keys.select(*KEY, "prefix").repartition("prefix").sortWithinPartitions("prefix", "record_hash").write.mode("overwrite").partitionBy("prefix").parquet(f"{self.path}/base/gen={gen}")
        build_filters(keys).write.mode("overwrite").partitionBy("prefix").parquet(f"{self.path}/blooms/gen={gen}")
        self.spark.createDataFrame([(gen, upto)], "gen long, upto long").write.mode("append").parquet(f"{self.path}/gens")

