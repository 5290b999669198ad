"""Source fields to canonical targets, and payloads to entities."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.fixed import REGISTRY
from tallyloom.functions.lineage import cut, in_methods
from tallyloom.functions.text import changed_keys, is_blank, name_tokens, norm_name


log = logging.getLogger(__name__)


def registry(spark: SparkSession, targets: list | None = None) -> DataFrame:
    """The canonical targets as a table: ord, entity, target, target_type, names (synonyms and the field itself)."""
    rows = [(i, e, f, t, [f, *s]) for i, (e, f, t, s) in enumerate(targets or REGISTRY)]
    return spark.createDataFrame(rows, "ord int, entity string, target string, target_type string, names array<string>")


def score_pairs(fields: DataFrame, targets: DataFrame) -> DataFrame:
    """Every field (source_id, field, inferred_type) against every target: confidence 1.00 for an equal
    name, 0.85 within two edits, 0.70 for half of the words, 0.55 for the type alone, else 0.
    The targets are a small table of fixed size and are broadcast."""
    mine, words = norm_name(F.col("field")), name_tokens(F.col("field"))
    theirs = F.transform("names", norm_name)
    near = F.exists(theirs, lambda n: F.levenshtein(mine, n) <= 2)

    def overlap(n):
        other = name_tokens(n)
        every = F.size(F.array_union(words, other))
        return (every > 0) & (F.size(F.array_intersect(words, other)) / every >= 0.5)

    same_type = (F.col("inferred_type") == F.col("target_type")) | ((F.col("inferred_type") == "CURRENCY_AMOUNT") & (F.col("target_type") == "DECIMAL"))
    score = F.when(F.array_contains(theirs, mine), 1.0).when(near, 0.85).when(F.exists("names", overlap), 0.70).when(same_type, 0.55).otherwise(0.0)
    return fields.where(~is_blank(F.col("field"))).crossJoin(F.broadcast(targets)).withColumn("confidence", score.cast("decimal(3,2)"))


def best(scored: DataFrame) -> DataFrame:
    """The best target of each field; ties go to the earliest target."""
    w = Window.partitionBy("source_id", "field").orderBy(F.desc("confidence"), "ord")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def decide(chosen: DataFrame) -> DataFrame:
    """AUTO_CONFIRMED from 0.80, PENDING from 0.55, else IGNORED without a target."""
    status = F.when(F.col("confidence") >= 0.80, "AUTO_CONFIRMED").when(F.col("confidence") >= 0.55, "PENDING").otherwise("IGNORED")
    out = chosen.withColumn("status", status)
    keep = F.col("status") != "IGNORED"
    return out.select("source_id", "field", F.when(keep, F.col("entity")).otherwise("").alias("entity"), F.when(keep, F.col("target")).otherwise("").alias("target"), F.when(keep, F.col("confidence")).otherwise(F.lit(0)).cast("decimal(3,2)").alias("confidence"), "status")


def map_fields(fields: DataFrame, targets: DataFrame, existing: DataFrame | None = None, advisor: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Mappings of a schema. Existing ones that aren't IGNORED stay; those of fields that are gone go;
    blank names are IGNORED. ``advisor``: suggestions (source_id, field, entity, target, confidence), taken
    where the target exists and they are surer than the heuristic."""
    named = fields.select("source_id", "field", "inferred_type").distinct()
    kept = None
    if existing is not None:
        kept = existing.where("status <> 'IGNORED'").join(named.select("source_id", "field"), ["source_id", "field"], "left_semi")
        named = named.join(kept.select("source_id", "field"), ["source_id", "field"], "left_anti")
    chosen = best(score_pairs(named, targets))
    if advisor is not None:
        hint = advisor(named).select("source_id", "field", F.col("entity").alias("he"), F.col("target").alias("ht"), F.col("confidence").alias("hc"))
        real = hint.join(F.broadcast(targets.select(F.col("entity").alias("he"), F.col("target").alias("ht"))), ["he", "ht"])
        chosen = chosen.join(real, ["source_id", "field"], "left")
        surer = F.coalesce(F.col("hc") > F.col("confidence"), F.lit(False))
        chosen = chosen.withColumns({"entity": F.when(surer, F.col("he")).otherwise(F.col("entity")), "target": F.when(surer, F.col("ht")).otherwise(F.col("target")), "confidence": F.when(surer, F.col("hc")).otherwise(F.col("confidence")).cast("decimal(3,2)")})
    out = decide(chosen)
    blank = named.where(is_blank(F.col("field"))).select("source_id", "field", F.lit("").alias("entity"), F.lit("").alias("target"), F.lit(0).cast("decimal(3,2)").alias("confidence"), F.lit("IGNORED").alias("status"))
    out = out.unionByName(blank)
    return out if kept is None else kept.select(*out.columns).unionByName(out)


def samples(staged: DataFrame, k: int = 10, seed: int | None = None) -> DataFrame:
    """source_id, field, samples: up to k values of each field, drawn at random from its records that have one."""
    cells = staged.select("source_id", F.explode(F.map_entries("payload")).alias("e")).select("source_id", F.col("e.key").alias("field"), F.col("e.value").alias("v")).where(F.col("v").isNotNull())
    todo = cut(cells.groupBy("source_id", "field").agg(F.count(F.lit(1)).alias("_of")))
    w = Window.partitionBy("source_id", "field").orderBy("_r")
    done, turn = None, 0
    while done is None or not todo.isEmpty():
        # about 10 * k values of a field stay to be sorted, all if it has no more; a field that keeps fewer than k of them is drawn again
        drawn = cells.join(F.broadcast(todo), ["source_id", "field"]).withColumn("_r", F.rand(None if seed is None else seed + turn)).where(F.col("_r") * F.col("_of") < 10 * k)
        some = drawn.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).groupBy("source_id", "field").agg(F.collect_list("v").alias("samples"), F.first("_of").alias("_of"))
        some = cut(some.where(F.size("samples") >= F.least(F.lit(k), F.col("_of"))).drop("_of"))
        done = some if done is None else done.unionByName(some)
        todo = cut(todo.join(some, ["source_id", "field"], "left_anti"))
        turn += 1
    return done


def retried(advisor: Callable[[DataFrame], DataFrame], attempts: int = 3) -> Callable[[DataFrame], DataFrame]:
    """The advisor, asked again when it fails; after so many failures it has no suggestions, and the heuristic stands."""

    def ask(fields: DataFrame) -> DataFrame:
        for _ in range(attempts):
            try:
                return cut(advisor(fields))
            except Exception as failed:
                log.warning("the advisor failed: %s", failed)
        return fields.sparkSession.createDataFrame([], "source_id string, field string, entity string, target string, confidence double")

    return ask


def stale(existing: DataFrame, fields: DataFrame) -> DataFrame:
    """Mappings whose field the schema no longer has."""
    return existing.join(fields.select("source_id", "field").distinct(), ["source_id", "field"], "left_anti")


def override(mappings: DataFrame, source_id: str, field: str, entity: str | None = None, target: str | None = None, status: str = "AUTO_CONFIRMED") -> DataFrame:
    """Confirm, redirect (``entity`` and ``target``) or ignore (``status``) one mapping."""
    hit = (F.col("source_id") == source_id) & (F.col("field") == field)
    put = lambda c, v: F.when(hit, F.lit(v)).otherwise(F.col(c)) if v is not None else F.col(c)
    return mappings.withColumns({"entity": put("entity", entity), "target": put("target", target), "status": put("status", status)})


def _rules(mappings: DataFrame, known: dict[str, list[str]] | None) -> DataFrame:
    """source_id, _key (a field's name in lower case), entity (singular), field, extra: where the values of a field go."""
    columns = [f"{e}.{f}" for e, f, _, _ in REGISTRY] if known is None else [f"{e}.{f}" for e, fs in known.items() for f in fs]
    once = Window.partitionBy("source_id", "_key").orderBy("field")
    rules = mappings.where("entity <> '' AND target <> ''").select("source_id", F.lower("field").alias("_key"), "entity", "target", "status", "field")
    rules = rules.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    column = (F.col("status") == "AUTO_CONFIRMED") & F.concat_ws(".", "entity", "target").isin(*columns)
    return rules.select("source_id", "_key", F.regexp_replace("entity", "s$", "").alias("entity"), F.col("target").alias("field"), (~column).alias("extra"))


def transform_long(staged: DataFrame, mappings: DataFrame, known: dict[str, list[str]] | None = None) -> DataFrame:
    """Mapped values: keys, entity (singular), field, value, extra, pos (place in the payload). A confirmed mapping to a column that
    the entity has (``known``; all registry columns if not given) gives a column, other mappings go to
    the additional attributes if they have a value. Names match in any case; of several mappings the first by name wins."""
    rules = _rules(mappings, known)
    cells = staged.select("source_id", "job_id", "row_number", F.posexplode(F.map_entries("payload")).alias("pos", "e"))
    joined = cells.select("source_id", "job_id", "row_number", "pos", F.lower("e.key").alias("_key"), F.col("e.value").alias("value")).join(rules, ["source_id", "_key"])
    out = joined.select("source_id", "job_id", "row_number", "entity", "field", "value", "extra", "pos")
    return out.where(~F.col("extra") | F.col("value").isNotNull())


def entities(long: DataFrame) -> DataFrame:
    """One row for each record and entity: fields map and additional_attributes map. Of several source fields with one
    target the last in the payload counts, its null too."""
    return _folded(long.groupBy("source_id", "job_id", "row_number", "entity").agg(F.collect_list(F.struct("field", "value", "extra", "pos")).alias("cells")))


def record_entities(staged: DataFrame, mappings: DataFrame, known: dict[str, list[str]] | None = None) -> DataFrame:
    """``entities`` of ``transform_long``, made within each staged row: no value of a record is shuffled to meet the others. The mappings of a
    source, one for each field at most, are broadcast, a row for each entity, and look their values up among the record's keys, from the last
    to the first. Keys of the rows are unique, as staging gives them."""
    goals = _rules(mappings, known).groupBy("source_id", "entity", "field", "extra").agg(F.sort_array(F.collect_list("_key")).alias("keys"))
    own = lambda extra: F.sort_array(F.collect_list(F.when(F.col("extra") == extra, F.struct("field", "keys"))))
    rules = goals.groupBy("source_id", "entity").agg(own(False).alias("c"), own(True).alias("e"))
    rules = rules.select("source_id", "entity", F.col("c.field").alias("_columns"), F.col("c.keys").alias("_of"), F.flatten("c.keys").alias("_any"), F.col("e.field").alias("_extras"), F.col("e.keys").alias("_of_extras"))
    lists = (F.reverse(changed_keys("payload", F.lower)).alias("_keys"), F.reverse(F.map_values("payload")).alias("_values"))
    rows = in_methods(staged, "row_number", "source_id", "job_id", "row_number", *lists).join(F.broadcast(rules), "source_id")

    def last(keys: Column) -> Column:
        """The value of the last key that is one of these."""
        several = F.array_min(F.filter(F.transform(keys, lambda k: F.array_position("_keys", k)), lambda p: p > 0))
        return F.get("_values", (F.when(F.size(keys) == 1, F.array_position("_keys", keys[0])).otherwise(several) - 1).cast("int"))

    def last_said(keys: Column) -> Column:
        """The last value that is not null of these keys."""
        return F.get("_values", F.array_min(F.transform("_keys", lambda k, i: F.when(F.array_contains(keys, k) & F.get("_values", i).isNotNull(), i))))

    pairs = lambda fields, of, value: F.map_filter(F.map_from_arrays(fields, F.transform(of, value)), lambda k, v: v.isNotNull())
    found = rows.withColumn("additional_attributes", pairs("_extras", "_of_extras", last_said)).where(F.arrays_overlap("_keys", "_any") | (F.size("additional_attributes") > 0))
    return found.select("source_id", "job_id", "row_number", "entity", pairs("_columns", "_of", last).alias("fields"), "additional_attributes")


def _folded(gathered: DataFrame) -> DataFrame:
    cells = F.filter("cells", lambda c: ~F.exists("cells", lambda d: (d["field"] == c["field"]) & (d["extra"] == c["extra"]) & (d["pos"] > c["pos"])))

    def pairs(extra: bool) -> Column:
        own = F.filter("cells", lambda c: (c["extra"] if extra else ~c["extra"]) & c["value"].isNotNull())
        return F.map_from_entries(F.array_sort(F.transform(own, lambda c: F.struct(c["field"].alias("key"), c["value"].alias("value")))))

    return gathered.withColumn("cells", cells).select("source_id", "job_id", "row_number", "entity", pairs(False).alias("fields"), pairs(True).alias("additional_attributes"))
