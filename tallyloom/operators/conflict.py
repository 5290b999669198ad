"""Conflicts between sources: detection, strategy, resolution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of each entity in which sources may disagree.
WATCHED = {"customers": ["segment", "region", "email"], "products": ["unit_price", "category", "sub_category"], "salespersons": ["territory", "team"], "orders": ["total_amount", "ship_mode"]}
#: What ``detect`` gives.
COLUMNS = "entity string, entity_id string, field string, source_a string, value_a string, source_b string, value_b string, trusted_source string, strategy string, status string"
LOW_IMPORTANCE = ("ship_mode", "sub_category")
_MONEY = "decimal(12,4)"


def _differ(field: Column, a: Column, b: Column) -> Column:
    """Prices differ by more than 1 % of the greater, totals by more than 0.01, other values if unequal."""
    x, y = a.try_cast(_MONEY), b.try_cast(_MONEY)
    gap, top = F.abs(x - y), F.greatest(F.abs(x), F.abs(y))
    price = F.when(x.isNull() | y.isNull(), a != b).when(top == 0, x != y).otherwise(F.round(gap.cast("decimal(24,10)") / top, 4) > F.lit("0.01").cast("decimal(3,2)"))
    amount = F.when(x.isNull() | y.isNull(), a != b).otherwise(gap > F.lit("0.01").cast("decimal(3,2)"))
    return F.when(field == "unit_price", price).when(field == "total_amount", amount).otherwise(a != b)


def differences(fields: list[str], a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Within a row that has both sides: the fields whose values are known on both and differ, as (field, value_a, value_b)."""
    each = []
    for c in fields:
        x, y = a(c).cast("string"), b(c).cast("string")
        each.append(F.when(_differ(F.lit(c), x, y), F.struct(F.lit(c).alias("field"), x.alias("value_a"), y.alias("value_b"))))
    return F.array_compact(F.array(*each))


def detect(entity: str, existing: DataFrame, incoming: DataFrame, trust: DataFrame) -> DataFrame:
    """Conflicts: entity, entity_id, field, source_a, value_a, source_b, value_b, strategy, status.

    ``existing`` and ``incoming`` have ``entity_id``, ``source`` (of incoming one source a row) and the entity's
    fields; ``trust(source_id, trust)`` is the small registry of sources. Only rows of another source
    than the one that owns the entity conflict. Strategy: a trust gap of 0.3 settles it; else, for
    fields of low importance between sources above 0.7, the latest wins; else it waits for review.
    """
    fields = [c for c in WATCHED[entity] if c in existing.columns and c in incoming.columns]
    a = existing.select("entity_id", F.col("source").alias("source_a"), *[F.col(c).alias(f"a_{c}") for c in fields])
    b = incoming.select("entity_id", F.col("source").alias("source_b"), *[F.col(c).alias(f"b_{c}") for c in fields])
    both = a.join(b, "entity_id").where("source_a <> source_b")
    return judged(entity, both.select("entity_id", "source_a", "source_b", differences(fields, lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")).alias("differ")), trust)


def judged(entity: str, pairs: DataFrame, trust: DataFrame) -> DataFrame:
    """``detect`` from rows (entity_id, source_a, source_b, differ) that have both sides; ``differ`` as ``differences`` gives it."""
    both = pairs.select("entity_id", "source_a", "source_b", F.explode("differ").alias("_d")).select("entity_id", "source_a", "source_b", "_d.*")
    for side in ("a", "b"):
        both = both.join(F.broadcast(trust.select(F.col("source_id").alias(f"source_{side}"), F.col("trust").alias(f"trust_{side}"))), f"source_{side}", "left")
    ta, tb = (F.coalesce(F.col(f"trust_{s}"), F.lit(0)).cast("decimal(3,2)") for s in "ab")
    gap = F.abs(ta - tb) >= F.lit("0.3").cast("decimal(3,2)")
    latest = F.col("field").isin(*LOW_IMPORTANCE) & (ta > F.lit("0.7").cast("decimal(3,2)")) & (tb > F.lit("0.7").cast("decimal(3,2)"))
    strategy = F.when(gap, "TRUST_HIERARCHY").when(latest, "LATEST_WINS").otherwise("FLAGGED_FOR_REVIEW")
    return both.select(
        F.lit(entity).alias("entity"), "entity_id", "field", "source_a", "value_a", "source_b", "value_b", F.when(ta >= tb, F.col("source_a")).otherwise(F.col("source_b")).alias("trusted_source"), strategy.alias("strategy")
    ).withColumn("status", F.when(F.col("strategy") == "FLAGGED_FOR_REVIEW", "OPEN").otherwise("RESOLVED"))


def resolve(conflicts: DataFrame, entities: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Settle open conflicts by hand. ``choices(entity_id, field, chosen)``: blank values are refused,
    conflicts that aren't open stay. Gives the conflicts and the entities with the chosen values. Whether a value is blank is
    looked up at once, by a job over the choices."""
    bad = choices.where("chosen IS NULL OR trim(chosen) = ''")
    if not bad.isEmpty():
        raise ValueError("a chosen value is blank")
    done = conflicts.join(choices, ["entity_id", "field"], "left")
    hit = (F.col("status") == "OPEN") & F.col("chosen").isNotNull()
    after = done.withColumns({"resolved_value": F.when(hit, F.col("chosen")), "status": F.when(hit, "RESOLVED").otherwise(F.col("status"))}).drop("chosen")
    made = after.where("resolved_value IS NOT NULL").groupBy("entity_id").agg(F.map_from_entries(F.collect_set(F.struct("field", "resolved_value"))).alias("_set"))
    put = {c: F.coalesce(F.try_element_at("_set", F.lit(c)).try_cast(entities.schema[c].dataType), F.col(c)) for c in entities.columns if any(c in of for of in WATCHED.values())}
    return after, entities.join(made, "entity_id", "left").withColumns(put).drop("_set")


def suppress(conflicts: DataFrame, ids: DataFrame) -> DataFrame:
    """Mark conflicts (entity_id, field), whatever their status, as suppressed; entities stay."""
    marked = ids.select("entity_id", "field", F.lit(True).alias("_hit"))
    out = conflicts.join(marked, ["entity_id", "field"], "left")
    return out.withColumn("status", F.when(F.col("_hit"), "SUPPRESSED").otherwise(F.col("status"))).drop("_hit")


def open_by_source(conflicts: DataFrame) -> DataFrame:
    """Open conflicts that touch each source, on either side."""
    touched = conflicts.where("status = 'OPEN'").select(F.explode(F.array_distinct(F.array("source_a", "source_b"))).alias("source_id"))
    return touched.groupBy("source_id").agg(F.count(F.lit(1)).alias("open_conflicts"))
