"""Reads for analysts: filters, pages and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filtered(df: DataFrame, **equal: object) -> DataFrame:
    """Rows that meet every given equality; None asks nothing, lists mean any of."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return df


def conflicts_of(df: DataFrame, source: str | None = None, **equal: object) -> DataFrame:
    """Filtered conflicts; ``source`` may stand on either side."""
    out = filtered(df, **equal)
    return out if source is None else out.where((F.col("source_a") == source) | (F.col("source_b") == source))


def page(df: DataFrame, order: list, number: int = 0, size: int = 20) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows; ``order`` should end in a unique column."""
    return df.orderBy(*order).offset(number * size).limit(size)


def after(df: DataFrame, keys: list[str], last: list | None = None, size: int = 20) -> DataFrame:
    """The ``size`` rows that follow the row with the keys ``last`` (None: the first rows), by ascending ``keys``, which together are
    unique. Pages before it are not gone through: the condition reaches the scan, and a table that is sorted by the keys skips the files
    and row groups before them."""
    if last is not None:
        beyond = F.lit(False)
        for i in range(len(keys) - 1, -1, -1):
            beyond = (F.col(keys[i]) > F.lit(last[i])) | ((F.col(keys[i]) == F.lit(last[i])) & beyond) if i < len(keys) - 1 else F.col(keys[i]) > F.lit(last[i])
        df = df.where((F.col(keys[0]) >= F.lit(last[0])) & beyond)
    return df.orderBy(*keys).limit(size)


def seekable(df: DataFrame, keys: list[str], path: str) -> DataFrame:
    """``df`` as a table under ``path``, sorted by the keys as a whole, for ``after``."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted_page(df: DataFrame, order: list, number: int = 0, size: int = 20) -> tuple[DataFrame, int]:
    """The page, and how many rows there are on all pages."""
    return page(df, order, number, size), df.count()


def latest(df: DataFrame, by: list[str], newest: str, k: int = 1) -> DataFrame:
    """The k newest rows of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc(newest))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def acknowledge(issues: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    hit = ids.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return issues.join(hit, keys, "left").withColumn("status", F.when(F.col("_hit"), "ACKNOWLEDGED").otherwise(F.col("status"))).drop("_hit")


def score_summary(scores: DataFrame) -> DataFrame:
    """Newest score of each source and how many it has. ``scores``: source_id, job_id, overall, grade."""
    return scores.groupBy("source_id").agg(F.max_by(F.struct("overall", "grade"), "job_id").alias("s"), F.count(F.lit(1)).alias("n_scores")).select("source_id", F.col("s.overall").alias("overall"), F.col("s.grade").alias("grade"), "n_scores")


def score_trend(scores: DataFrame) -> DataFrame:
    """Overall scores of each source in order, with the change since the one before."""
    w = Window.partitionBy("source_id").orderBy("job_id")
    return scores.select("source_id", "job_id", "overall", (F.col("overall") - F.lag("overall").over(w)).alias("change"))


def order_totals(orders: DataFrame, lines: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Orders (order_id, total_amount) whose total isn't that of their lines (order_id, line_total)."""
    sums = lines.groupBy("order_id").agg(F.sum("line_total").alias("lines_total"), F.count(F.lit(1)).alias("n_lines"))
    return orders.join(sums, "order_id").where(F.abs(F.col("total_amount") - F.col("lines_total")) > tolerance)
