"""Field profiles, inferred types, schema drift and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.functions.fixed import DATE_FORMATS, DATETIME_FORMAT
from tallyloom.functions.lineage import written

JOB = ["source_id", "job_id"]
FIELD = [*JOB, "field"]


def cells(staged: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """A row for each field of each record: keys, row_number, field, pos, v (trimmed; blank is null).
    ``sample_rows``: only the first rows of each job, as inference by sample does."""
    rows = staged if sample_rows is None else staged.where(F.col("row_number") <= sample_rows)
    each = rows.select(*JOB, "row_number", F.posexplode(F.map_entries("payload")).alias("pos", "e"))
    return each.select(*JOB, "row_number", F.col("e.key").alias("field"), "pos", F.when(~X.is_blank(F.col("e.value")), X.trim(F.col("e.value"))).alias("v"))


def values(staged: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """Distinct values of each field: keys, v, n, first_row. The partial counts of a hot value are
    added before the shuffle."""
    return cells(staged, sample_rows).where("v IS NOT NULL").groupBy(*FIELD, "v").agg(F.count(F.lit(1)).alias("n"), F.min("row_number").alias("first_row"))


def null_rates(staged: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """Null rate of each field to four places; a record that lacks the field counts as null."""
    rows = staged if sample_rows is None else staged.where(F.col("row_number") <= sample_rows)
    totals = rows.groupBy(*JOB).agg(F.count(F.lit(1)).alias("total"))
    # by place first, with plain numbers as aggregates, so that the cells are hashed and not sorted
    placed = cells(staged, sample_rows).groupBy(*FIELD, "pos").agg(F.count("v").alias("some"), F.min("row_number").alias("row_number"))
    present = placed.groupBy(*FIELD).agg(F.sum("some").alias("present"), F.min(F.struct("row_number", "pos")).alias("seen"))
    nulls = F.col("total") - F.col("present")
    rate = F.round(nulls.cast("decimal(20,0)") / F.col("total").cast("decimal(20,0)"), 4).cast("decimal(5,4)")
    return present.join(totals, JOB).select(*FIELD, "total", nulls.alias("null_count"), rate.alias("null_rate"), (nulls > 0).alias("nullable"), "seen")


def _all(test: Column) -> Column:
    return F.bool_and(test)


def types(vals: DataFrame) -> DataFrame:
    """Inferred type and date format of each field: the first that all its values satisfy."""
    return _typed(vals)


def _typed(vals: DataFrame, more: tuple[Column, ...] = (), gives: dict[str, Column] | None = None) -> DataFrame:
    """``types``, with columns made of ``more`` aggregates (and of the type) of the same reading of the values."""
    v = F.col("v")
    tests = {"INTEGER": X.is_integer(v), "DECIMAL": X.is_decimal(v), "BOOLEAN": X.is_boolean(v), "DATETIME": X.is_datetime(v), "EMAIL": X.is_email(v), "PHONE": X.is_phone(v), "CURRENCY_AMOUNT": X.is_currency_amount(v)}
    agg = vals.groupBy(*FIELD).agg(
        F.count(F.lit(1)).alias("distinct_count"), *[_all(t).alias(f"is_{k}") for k, t in tests.items()], *[_all(X.matches_format(v, p)).alias(f"fmt_{i}") for i, (p, _) in enumerate(DATE_FORMATS)], *more
    )
    fmt = F.coalesce(*[F.when(F.col(f"fmt_{i}"), p) for i, (p, _) in enumerate(DATE_FORMATS)])
    chain = F.when(F.col("is_INTEGER"), "INTEGER").when(F.col("is_DECIMAL"), "DECIMAL").when(F.col("is_BOOLEAN"), "BOOLEAN")
    chain = chain.when(fmt.isNotNull(), F.when(fmt == DATETIME_FORMAT, "DATETIME").otherwise("DATE"))
    for k in ("DATETIME", "EMAIL", "PHONE", "CURRENCY_AMOUNT"):
        chain = chain.when(F.col(f"is_{k}"), k)
    chain = chain.when(F.col("distinct_count") < 20, "CATEGORY").otherwise("FREE_TEXT")
    plain = F.col("is_INTEGER") | F.col("is_DECIMAL") | F.col("is_BOOLEAN")
    out = agg.withColumns({"inferred_type": chain, "date_format": F.when(~plain, fmt)})
    return out.select(*FIELD, "distinct_count", "inferred_type", "date_format", *[c.alias(name) for name, c in (gives or {}).items()])


def top_values(vals: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent values of each field with their ranks; ties by value. The rank filter
    keeps k rows of each field per task before the shuffle."""
    w = Window.partitionBy(*FIELD).orderBy(F.desc("n"), "v")
    return vals.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*FIELD, "rank", "v", "n")


def sample_values(vals: DataFrame, k: int = 5) -> DataFrame:
    """The first k distinct values of each field in row order."""
    w = Window.partitionBy(*FIELD).orderBy("first_row", "v")
    return vals.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*FIELD, "rank", "v")


def types_and_extremes(vals: DataFrame) -> DataFrame:
    """``types`` and, from the same reading, the least and greatest value of each field: by number for INTEGER and DECIMAL (the text is kept,
    the first seen wins ties), else by text."""
    # doubles order any size and exponent; where two are equal, the decimals tell, if they fit
    number = F.when(F.col("v").try_cast("double").isNotNull(), F.struct(F.col("v").try_cast("double"), F.col("v").try_cast("decimal(38,10)")))
    ends = (
        F.min_by("v", F.when(number.isNotNull(), F.struct(number, "first_row"))).alias("num_min"),
        F.max_by("v", F.when(number.isNotNull(), F.struct(number, -F.col("first_row")))).alias("num_max"),
        F.min("v").alias("text_min"),
        F.max("v").alias("text_max"),
    )
    numeric = F.col("inferred_type").isin("INTEGER", "DECIMAL")
    return _typed(vals, ends, {"min_value": F.when(numeric, F.col("num_min")).otherwise(F.col("text_min")), "max_value": F.when(numeric, F.col("num_max")).otherwise(F.col("text_max"))})


def profile(staged: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """The field profiles of each job, a row for each field; fields without values are FREE_TEXT. The distinct values are counted once and written;
    types, extremes, frequent and first values come from that table."""
    vals = written(values(staged, sample_rows), "values")
    ranked = lambda df: df.groupBy(*FIELD).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "v"))), lambda x: x["v"]).alias("vs"))
    top, first = ranked(top_values(vals)).withColumnRenamed("vs", "top_values"), ranked(sample_values(vals)).withColumnRenamed("vs", "sample_values")
    out = null_rates(staged, sample_rows)
    for part in (types_and_extremes(vals), top, first):
        out = out.join(part, FIELD, "left")
    return out.withColumns({"distinct_count": F.coalesce("distinct_count", F.lit(0)), "inferred_type": F.coalesce("inferred_type", F.lit("FREE_TEXT"))})


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """What differs between two schemas (source_id, field, inferred_type): source_id, field, change."""
    o = old.select("source_id", "field", F.col("inferred_type").alias("old_type"), F.lit(True).alias("was"))
    n = new.select("source_id", "field", F.col("inferred_type").alias("new_type"), F.lit(True).alias("is"))
    change = F.when(F.col("was").isNull(), "ADDED").when(F.col("is").isNull(), "REMOVED").when(~F.col("old_type").eqNullSafe(F.col("new_type")), "TYPE_CHANGED")
    return o.join(n, ["source_id", "field"], "full_outer").withColumn("change", change).where("change IS NOT NULL").select("source_id", "field", "old_type", "new_type", "change")


def next_versions(versions: DataFrame, changed: DataFrame, seen: DataFrame) -> DataFrame:
    """Schema versions after a job. ``versions(source_id, version, status)``; ``changed``: drift of the
    sources; ``seen``: the sources of the job. A new source gets version 1, a drifted one supersedes
    its active version, others keep theirs."""
    drifted = changed.select("source_id").distinct().withColumn("drifted", F.lit(True))
    latest = versions.groupBy("source_id").agg(F.max("version").alias("latest"))
    jobs = seen.select("source_id").distinct().join(latest, "source_id", "left").join(drifted, "source_id", "left")
    fresh = jobs.where("latest IS NULL OR drifted").select("source_id", (F.coalesce("latest", F.lit(0)) + 1).alias("version"), F.lit("ACTIVE").alias("status"))
    kept = versions.join(fresh.select("source_id", F.lit(True).alias("new")), "source_id", "left").select("source_id", "version", F.when(F.col("new") & (F.col("status") == "ACTIVE"), "SUPERSEDED").otherwise(F.col("status")).alias("status"))
    return kept.unionByName(fresh)


def profile_drift(profiles: DataFrame, least_batches: int = 3) -> DataFrame:
    """Statistical drift of the newest of each source's last three profiles against the others.

    ``profiles(source_id, batch, field, null_rate, top_values, min_value, max_value)``, ``batch`` rising with
    time. Gives source_id, field, rule, dimension, severity, message. Sources with fewer batches, and fields with
    fewer than two earlier ones, have none.
    """
    newest = F.dense_rank().over(Window.partitionBy("source_id").orderBy(F.desc("batch")))
    last = profiles.withColumn("age", newest).where(F.col("age") <= least_batches)
    enough = last.groupBy("source_id").agg(F.max("age").alias("batches")).where(F.col("batches") >= least_batches).select("source_id")
    last = last.join(enough, "source_id", "left_semi")
    number = lambda c: F.col(c).try_cast("decimal(38,10)").cast("double")
    ends = F.explode_outer(F.filter(F.array(number("min_value"), number("max_value")), lambda x: x.isNotNull()))
    past = last.where("age > 1")
    spread = past.select("source_id", "field", ends.alias("x")).groupBy("source_id", "field").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    history = past.groupBy("source_id", "field").agg(
        F.count(F.lit(1)).alias("times"), F.round(F.avg(F.coalesce(F.col("null_rate").cast("decimal(5,4)"), F.lit(0)).cast("decimal(5,4)")), 4).cast("decimal(5,4)").alias("usual"), F.array_distinct(F.flatten(F.collect_list("top_values"))).alias("known")
    )
    now = last.where("age = 1").join(history.where(F.col("times") >= least_batches - 1), ["source_id", "field"]).join(spread, ["source_id", "field"])
    rate = F.coalesce(F.col("null_rate").cast("decimal(5,4)"), F.lit(0)).cast("decimal(5,4)")
    away = F.abs(rate - F.col("usual"))
    top = F.array_distinct(F.coalesce("top_values", F.array().cast("array<string>")))
    skewed = (F.size(top) > 0) & (F.size("known") > 0) & (F.size(F.array_except(top, "known")) / F.size(top) > 0.5)
    low, high = F.col("mean") - 3 * F.col("sd"), F.col("mean") + 3 * F.col("sd")
    wider = (F.col("n") >= 2) & (F.col("sd") != 0) & (F.coalesce(number("min_value") < low, F.lit(False)) | F.coalesce(number("max_value") > high, F.lit(False)))
    says = F.format_string("%s: %.1f%% of values are usually missing, now %.1f%%, which is %.1f points away", "field", (F.col("usual") * 100).cast("double"), (rate * 100).cast("double"), (away * 100).cast("double"))
    kinds = [
        (away > F.lit("0.20").cast("decimal(5,4)"), "COMPLETENESS_NULL_RATE_DRIFT", "COMPLETENESS", says),
        (skewed, "VALIDITY_VALUE_DISTRIBUTION_DRIFT", "VALIDITY", F.format_string("%s: most of the frequent values were not among those of the profiles before", "field")),
        (wider, "ACCURACY_RANGE_EXPANSION_DRIFT", "ACCURACY", F.format_string("%s: the least or the greatest value lies more than three deviations from the mean of earlier ends", "field")),
    ]
    fired = F.array(*[F.when(c, F.struct(F.lit(r).alias("rule"), F.lit(d).alias("dimension"), F.lit("MEDIUM").alias("severity"), m.alias("message"))) for c, r, d, m in kinds])
    return now.select("source_id", "field", F.explode(F.filter(fired, lambda x: x.isNotNull())).alias("i")).select("source_id", "field", "i.*")
