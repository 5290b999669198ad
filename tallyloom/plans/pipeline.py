"""One job from staged rows to scores and canonical rows, and the same for each window of the live path."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.lineage import cut, written
from tallyloom.operators import canonical, mapping, profiling, quality
from tallyloom.operators.history import History, after_job
from tallyloom.operators.versions import Versions
from tallyloom.sources.staging import numbered

#: Entities that stand by themselves, loaded before the orders that link to them.
ALONE = {"customer": canonical.CUSTOMERS, "product": canonical.PRODUCTS, "salesperson": canonical.SALESPERSONS, "region": canonical.REGIONS}
JOB = ["source_id", "job_id"]
#: Stored rows of an entity that have a key among some hashes (``canonical.key_hashes``), and perhaps others.
Lookup = Callable[[DataFrame], DataFrame]
MAPPINGS = "source_id string, field string, entity string, target string, confidence decimal(3,2), status string"


def counters(judged: DataFrame, ids: dict[str, DataFrame], conflicts: list[DataFrame]) -> DataFrame:
    """Of one job: records read, without and with a critical issue, with any canonical row, and conflicts found."""
    hit = None
    for own in ids.values():
        hit = own.select("row_number") if hit is None else hit.unionByName(own.select("row_number"))
    marked = judged.select(*quality.KEYS, quality.critical().alias("_bad")).join(hit.distinct().withColumn("_loaded", F.lit(True)), "row_number", "left")
    out = marked.groupBy(*JOB).agg(F.count(F.lit(1)).alias("read_records"), F.count_if(~F.col("_bad")).alias("passed_records"), F.count_if("_bad").alias("rejected_records"), F.count("_loaded").alias("loaded_records"))
    return out.withColumn("conflicts", F.lit(sum(found.count() for found in conflicts)).cast("long"))


def only_job(staged: DataFrame) -> tuple[str, str] | None:
    """The source and job of the rows; None without rows. Row numbers are those of one job, so rows of more are refused."""
    found = staged.select(*JOB).distinct().limit(2).collect()
    if len(found) > 1:
        raise ValueError("rows of more than one source or job: load them one by one")
    return (found[0]["source_id"], found[0]["job_id"]) if found else None


def assess(staged: DataFrame, as_of: str, history: History | None = None, seq: int = 0) -> dict[str, DataFrame]:
    """Profiles, issues and scores of one job of one source. With ``history`` its profiles and schema are recorded as those of job
    ``seq``, and drift against the jobs before it counts among the issues and in the scores. The staged rows are read once: ``judged`` has
    their payloads too, and the profiles come from there."""
    judged = quality.judge(staged, as_of, payloads=True)
    job = only_job(judged)
    profiles = written(profiling.profile(judged), "profiles")
    issues = quality.issues(judged)
    if history is not None and job is not None:
        issues = issues.unionByName(after_job(history, *job, seq, profiles))
    issues = written(issues, "issues")
    return {"profiles": profiles, "judged": judged, "issues": issues, "scores": written(quality.scores(judged, issues), "scores")}


def run_job(
    staged: DataFrame, stores: dict[str, DataFrame | Lookup], trust: DataFrame, as_of: str, targets: DataFrame, mappings: DataFrame | None = None, winner: str = "incoming", history: History | None = None, seq: int = 0, changed_only: bool = False
) -> dict[str, DataFrame]:
    """Profile, map, check, score and load one job of one source; each result is a DataFrame by name. Rows of several are refused.

    ``stores``: the canonical tables by name, each an ``entity_id``-keyed DataFrame, or, with ``changed_only``, a function that looks up the rows
    that records can match. Records with a critical issue are not
    loaded. Customers, products, salespersons and regions come first, then orders with the customer of their record (and its
    salesperson and region if there are any), then line items. Rows carry additional attributes and the job's score.
    ``history``: where profiles and schemas of jobs are kept, see ``assess``. ``changed_only``: of the canonical tables only rows that are
    new or changed are given.
    """
    done = assess(staged, as_of, history, seq)
    profiles, judged, issues, scores = (done[k] for k in ("profiles", "judged", "issues", "scores"))
    _, job = only_job(judged) or ("", "")
    fields = profiles.select("source_id", "field", "inferred_type")
    maps = cut(mapping.map_fields(fields, targets, mappings))
    good = judged.where(~quality.critical())
    long = mapping.transform_long(good, maps)
    overall = scores.select(*JOB, F.col("overall").alias("quality_score"))
    parts = mapping.record_entities(good, maps).join(F.broadcast(overall), JOB)
    parts = written(parts.select(F.col("source_id").alias("source"), "row_number", "entity", "fields", "additional_attributes", "quality_score"), "parts", by=("entity",))
    out = {"profiles": profiles, "mappings": maps, "issues": issues, "scores": scores, "rejected": quality.rejected(issues)}
    ids, lines, conflicts = {}, [], []

    def put(name: str, entity: canonical.Entity, records: DataFrame) -> None:
        stored = stores[entity.table]
        if not isinstance(stored, DataFrame):
            records = cut(records)
            stored = stored(canonical.key_hashes(canonical.typed(records, entity), entity))
        store, found, ids[name] = canonical.load(records, stored, entity, trust, winner, changed_only, job)
        out[entity.table] = store
        if found is not None:
            out[f"{entity.table}_conflicts"] = found
            conflicts.append(out[f"{entity.table}_conflicts"])
        lines.append(canonical.lineage(long, ids[name], name))

    for name, entity in ALONE.items():
        put(name, entity, parts.where(F.col("entity") == name).drop("entity"))
    put("order", canonical.ORDERS, canonical.link_orders(parts.where("entity = 'order'").drop("entity"), ids["customer"], ids["salesperson"], ids["region"]))
    items = parts.where("entity = 'order_line_item'").drop("entity")
    out["order_line_items"] = canonical.line_items(items, ids["order"], ids["product"])
    lineage = lines[0]
    for more in lines[1:]:
        lineage = lineage.unionByName(more)
    return out | {"lineage": lineage, "counters": counters(judged, ids, conflicts)}


def empty_stores(spark: SparkSession) -> dict[str, DataFrame]:
    return {e.table: canonical.empty_store(spark, e) for e in (*ALONE.values(), canonical.ORDERS)}


def versioned(spark: SparkSession, root: str) -> dict[str, Versions]:
    """The canonical tables under ``root``, by name, as tables of changes whose rows can be looked up by their keys."""
    schema = lambda e: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in canonical.empty_store(spark, e).schema)
    return {e.table: Versions(spark, f"{root}/{e.table}", schema(e), keys=partial(canonical.key_hashes, entity=e, stored=True)) for e in (*ALONE.values(), canonical.ORDERS)}


#: Windows between two compactions of the canonical tables.
COMPACT_EVERY = 50


def each_window(root: str, trust: DataFrame, targets: DataFrame, as_of: Callable[[], str], compact_every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """What the live path does with each window: one job for each of its sources, in order of their ids.

    The first window of a source maps its fields, later ones keep those mappings and map new fields; every window is
    profiled, and drift counts among its issues. A window writes what it found, the mappings of its sources, and the canonical rows
    that are new or changed; of those before it only the ones that its records can match, by their keys, are read and merged. Every ``compact_every`` windows the changes become a base. A window
    that runs again replaces what it had written, since it reads only what came before it.
    """

    def each(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        history, tables = History(spark, f"{root}/history"), versioned(spark, root)
        staged = cut(numbered(rows.select("source_id", "job_id", "payload", "raw_payload", "record_hash")))
        sources = sorted(r["source_id"] for r in staged.select("source_id").distinct().collect())
        changed: dict[str, DataFrame] = {}

        def stored(name: str, hashes: DataFrame) -> DataFrame:
            found = tables[name].sharing(hashes, batch_id)
            if name in changed:
                found = found.join(changed[name].select("entity_id"), "entity_id", "left_anti").unionByName(changed[name])
            return cut(found)

        kept: dict[str, list[DataFrame]] = {}
        for source in sources:
            last = history.before(source, batch_id, 1)
            known = spark.read.schema(MAPPINGS).parquet(f"{root}/mappings/window={last[0]['seq']}").where(F.col("source_id") == source) if last else None
            stores = {name: partial(stored, name) for name in tables}
            out = run_job(staged.where(F.col("source_id") == source), stores, trust, as_of(), targets, known, history=history, seq=batch_id, changed_only=True)
            for name in tables:
                new = cut(out[name])
                changed[name] = new if name not in changed else cut(changed[name].join(new.select("entity_id"), "entity_id", "left_anti").unionByName(new))
            for name in ("profiles", "mappings", "issues", "scores", "lineage", "counters", "order_line_items", *[n for n in out if n.endswith("_conflicts")]):
                kept.setdefault(name, []).append(out[name])
        for name, found in kept.items():
            whole = found[0]
            for more in found[1:]:
                whole = whole.unionByName(more)
            whole.write.mode("overwrite").parquet(f"{root}/{name}/window={batch_id}")
        for name, rows_ in changed.items():
            tables[name].write(rows_, batch_id)
        if (batch_id + 1) % compact_every == 0:
            for table in tables.values():
                table.compact(batch_id)

    return each
