"""Sources to staged rows: (source_id, job_id, row_number, payload, raw_payload, record_hash).

``payload`` is a map of strings in column order; ``raw_payload`` its JSON with nulls kept;
``record_hash`` the SHA-256 of that JSON. Everything downstream reads staged rows only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import trim
from tallyloom.sources.excel import sheet_rows


def stage(df: DataFrame, fields: list[str], source_id: Column, job_id: Column, row_number: Column) -> DataFrame:
    """Stage a flat table: each field as trimmed text, empty text as null."""
    value = lambda c: F.nullif(trim(F.col(f"`{c}`").cast("string")), F.lit(""))
    payload = F.create_map(*[x for c in fields for x in (F.lit(c), value(c))])
    return with_hash(df.select(source_id.alias("source_id"), job_id.alias("job_id"), row_number.alias("row_number"), payload.alias("payload")))


def with_hash(staged: DataFrame) -> DataFrame:
    raw = staged.withColumn("raw_payload", F.to_json("payload"))
    return raw.withColumn("record_hash", F.sha2("raw_payload", 256))


def numbered(df: DataFrame, out: str = "row_number") -> DataFrame:
    """Rows of a file scan numbered from 1 in file order: partitions are counted, then offset."""
    placed = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, "_part").withColumn(out, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_start")


def read_csv(spark: SparkSession, path: str, source_id: str, job_id: str, sources: DataFrame | None = None) -> DataFrame:
    """A CSV upload with a header; a row with another number of columns fails the job. ``sources``: the register, in which the source
    must be one of this type."""
    if sources is not None:
        require_source(sources, source_id, "CSV")
    if not path.lower().endswith(".csv"):
        raise ValueError("a .csv file is needed")
    df = spark.read.options(header=True, inferSchema=False, mode="FAILFAST", multiLine=False).csv(path)
    if not df.columns:
        raise ValueError("the file is empty")
    return stage(numbered(df), df.columns, F.lit(source_id), F.lit(job_id), F.col("row_number"))


def read_jdbc(spark: SparkSession, config: dict[str, str], source_id: str, job_id: str, sources: DataFrame | None = None) -> DataFrame:
    """A query against a JDBC source, all columns as text. ``config``: jdbcUrl, user, password,
    driverClassName, query; anything but a SELECT is refused. The query runs once, as one partition, and its rows are numbered
    in the order in which they come. With ``keyColumn``, a whole-number column of the query's without repeats, it is read in
    ``partitions`` (8) ranges of the key side by side, between the least and the greatest that a first query asks for, and rows are numbered by the
    key, so every run gives the same numbers. ``sources``: the register, in which the source must be an active one of this type."""
    if sources is not None:
        require_source(sources, source_id, "JDBC")
    options = jdbc_options(config)
    if key := config.get("keyColumn"):
        return _read_ranges(spark, options, key, int(config.get("partitions", 8)), source_id, job_id)
    df = spark.read.format("jdbc").options(**options).load()
    return stage(df.withColumn("row_number", F.monotonically_increasing_id() + 1), df.columns, F.lit(source_id), F.lit(job_id), F.col("row_number"))


def _read_ranges(spark: SparkSession, options: dict[str, str], key: str, partitions: int, source_id: str, job_id: str) -> DataFrame:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", key):
        raise ValueError(f"not a column: {key}")
    query = options.pop("query")
    read = lambda **more: spark.read.format("jdbc").options(**options, **more).load()
    whole = read(query=query)
    own = next((c for c in whole.columns if c.lower() == key.lower()), None)
    if own is None:
        raise ValueError(f"the query has no column {key}")
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(options["url"]).quoteIdentifier(own)
    low, high = read(query=f"SELECT MIN({quoted}), MAX({quoted}) FROM ({query}) ends").first()
    if low is None:
        return stage(whole, whole.columns, F.lit(source_id), F.lit(job_id), F.lit(1).cast("long"))
    df = read(dbtable=f"({query}) ranges", partitionColumn=own, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions))
    # ranges ascend with the partitions, so sorting inside them sorts the whole
    rows = numbered(df.sortWithinPartitions(own))
    return stage(rows, df.columns, F.lit(source_id), F.lit(job_id), F.col("row_number"))


def jdbc_options(config: dict[str, str]) -> dict[str, str]:
    missing = [k for k in ("jdbcUrl", "user", "password", "driverClassName", "query") if not config.get(k)]
    if missing:
        raise ValueError(f"missing in the source's configuration: {', '.join(missing)}")
    if not re.match(r"\s*(select|with)\b", config["query"], re.IGNORECASE):
        raise ValueError("only SELECT queries are read")
    return {"url": config["jdbcUrl"], "user": config["user"], "password": config["password"], "driver": config["driverClassName"], "query": config["query"], "fetchsize": "1000"}


def read_excel(spark: SparkSession, path: str, source_id: str, job_id: str, sources: DataFrame | None = None, chunk: int = 2000) -> DataFrame:
    """Workbooks (one or a folder of them): first sheet, first row as header, blank headers ``_c<n>``; of columns with one header
    the last counts. Each file is read where Spark puts it, its sheet as a stream that is handed on every ``chunk`` rows; rows are numbered
    within their file, rows without a cell left out. A file without a header fails the job. ``sources``: the register, in
    which the source must be one of this type."""
    if sources is not None:
        require_source(sources, source_id, "EXCEL")
    if not re.search(r"\.xlsx$|/$|\*", path.lower()):
        raise ValueError("an .xlsx file is needed")
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches):
        import pandas as pd

        for pdf in batches:
            for name, data in zip(pdf.path, pdf.content, strict=True):
                sheet = sheet_rows(data)
                header = [h if h and h.strip() else f"_c{i}" for i, h in enumerate(next(sheet, []))]
                if not header:
                    raise ValueError(f"the file is empty: {name}")
                out = []
                for n, cells in enumerate((r for r in sheet if r), 1):
                    row = {h: cells[i] if i < len(cells) else None for i, h in enumerate(header)}
                    out.append((name, n, list(row.items())))
                    if len(out) >= chunk:
                        yield pd.DataFrame(out, columns=["path", "row_number", "cells"])
                        out = []
                yield pd.DataFrame(out, columns=["path", "row_number", "cells"])

    cells = files.mapInPandas(rows, "path string, row_number long, cells array<struct<name:string,value:string>>")
    staged = cells.select(F.lit(source_id).alias("source_id"), F.lit(job_id).alias("job_id"), "row_number", F.map_from_entries("cells").alias("payload"))
    return with_hash(staged)


def write_staged(staged: DataFrame, path: str) -> None:
    """Append to the staging table, a folder for each source and job."""
    staged.write.mode("append").partitionBy("source_id", "job_id").parquet(path)


def duplicate_hashes(staged: DataFrame) -> DataFrame:
    """Hashes that a source has more than once, with their number of rows."""
    return staged.groupBy("source_id", "record_hash").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def due_sources(sources: DataFrame, now: str) -> DataFrame:
    """Active JDBC sources whose next run after the last sync (else creation, else the epoch) is before
    ``now`` (UTC). Cron fields of six: lists, ranges, steps and stars; bad ones are never due, nor are sources whose ``running``
    column, if there is one, is true."""
    from tallyloom.sources.cron import next_after

    def run(batches):
        for pdf in batches:
            keep = [next_after(c, b) for c, b in zip(pdf.cron_expression, pdf.base, strict=True)]
            pdf["next_run"] = keep
            yield pdf[["source_id", "next_run"]]

    base = F.coalesce("last_sync_at", "created_at", F.timestamp_seconds(F.lit(0)))
    idle = sources.where("running IS NULL OR NOT running") if "running" in sources.columns else sources
    wanted = idle.where("split(source_type, '_')[0] = 'JDBC' AND active AND cron_expression IS NOT NULL").select("source_id", "cron_expression", base.alias("base"))
    return wanted.mapInPandas(run, "source_id string, next_run timestamp").where(F.col("next_run") < F.lit(now).cast("timestamp"))


def require_source(sources: DataFrame, source_id: str, kind: str) -> None:
    """Raise unless the registry (source_id, source_type, active) has the source, of this type, and active if it is polled."""
    found = sources.where(F.col("source_id") == source_id).select("source_type", "active").head(1)
    if not found:
        raise ValueError(f"no source {source_id}")
    if found[0]["source_type"].split("_")[0] != kind:
        raise ValueError(f"{source_id} is a source of type {found[0]['source_type']}, not {kind}")
    if kind == "JDBC" and not found[0]["active"]:
        raise ValueError(f"{source_id} is not active")
