"""Queries over the test tables: one or more for each operator, each with SQL that states its result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.fixed import COUNTRIES, CURRENCIES, REGISTRY, WEIGHTS
from tallyloom.functions.lineage import cut, scratch, written
from tallyloom.operators import canonical, conflict, evolve, mapping, profiling, quality, reads
from tallyloom.operators import history as histories
from tallyloom.operators.catalog import Catalog
from tallyloom.operators.history import History
from tallyloom.operators.register import Sources, jobs
from tallyloom.operators.summaries import Summaries, of_conflicts
from tallyloom.plans import demo
from tallyloom.plans.pipeline import assess, empty_stores, run_job, versioned
from tallyloom.sources.staging import due_sources, read_csv, stage, write_staged
from tallyloom.sources.staging import duplicate_hashes as find_duplicates
from tallyloom.streaming import live
from tallyloom.streaming.seen import Seen

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _sql_list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _doubles(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


SALES = f"with sales as ({demo.SALES_SQL})"
_JSON = " || ',' || ".join(f"""'"{f}":' || coalesce('"' || "{f}" || '"', 'null')""" for f in demo.FIELDS)
HASHED = f"{SALES}, hashed as (select *, sha256('{{' || {_JSON} || '}}') as record_hash from sales)"
_ISO = "regexp_full_match(order_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}')"
_DATE = f"(case when {_ISO} then try_cast(order_date as date) end)"
_D, _M = "(0[1-9]|[12][0-9]|3[01])", "(0[1-9]|1[0-2])"
_OK_DATE = f"regexp_full_match(order_date, '[0-9]{{4}}-{_M}-{_D}|{_M}/{_D}/[0-9]{{4}}|{_D}-{_M}-[0-9]{{4}}')"
_K = "source_id, job_id, row_number"
_RULES = {
    "COMPLETENESS": [("COMPLETENESS_CUSTOMER_NAME", "CRITICAL", "customer_name", "customer_name is null"), ("COMPLETENESS_TOTAL_AMOUNT", "CRITICAL", "total_amount", "total_amount is null"), ("COMPLETENESS_SKU", "CRITICAL", "sku", "sku is null")],
    "VALIDITY": [
        ("VALIDITY_DATE_FORMAT", "HIGH", "order_date", f"not {_OK_DATE}"),
        ("VALIDITY_NEGATIVE_NUMBER", "HIGH", "total_amount", "try_cast(total_amount as double) < 0"),
        ("VALIDITY_NON_NUMERIC", "HIGH", "total_amount", "total_amount is not null and try_cast(total_amount as double) is null"),
        ("VALIDITY_EMAIL_FORMAT", "HIGH", "email", "not regexp_full_match(email, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+')"),
    ],
    "UNIQUENESS": [("UNIQUENESS_DUPLICATE_HASH", "HIGH", "record_hash", "copies > 1")],
    "CONSISTENCY": [
        ("CONSISTENCY_LINE_TOTAL", "MEDIUM", "line_total", "abs(cast(quantity as double) * cast(unit_price as double) - cast(line_total as double)) > 0.01"),
        ("CONSISTENCY_FUTURE_ORDER_DATE", "MEDIUM", "order_date", f"{_DATE} > date '{demo.AS_OF}'"),
    ],
    "TIMELINESS": [("TIMELINESS_FUTURE_DATE", "MEDIUM", "order_date", f"{_DATE} > date '{demo.AS_OF}'"), ("TIMELINESS_STALE_DATE", "MEDIUM", "order_date", f"{_DATE} < date '1999-08-01'")],
    "ACCURACY": [
        ("ACCURACY_INVALID_CURRENCY", "LOW", "currency", f"upper(currency) not in ({_sql_list(CURRENCIES)})"),
        ("ACCURACY_INVALID_COUNTRY", "LOW", "country", f"upper(country) not in ({_sql_list(COUNTRIES)})"),
    ],
}


def _issues_sql(dimensions: list[str]) -> str:
    parts = [f"select {_K}, '{r}' as rule, '{d}' as dimension, '{s}' as severity, '{f}' as field from counted where {c}" for d in dimensions for r, s, f, c in _RULES[d]]
    return f"{HASHED}, counted as (select *, count(*) over (partition by source_id, record_hash) as copies from hashed), issues as ({' union all '.join(parts)})"


ISSUES = _issues_sql(list(_RULES))


def _issues(spark: SparkSession, sf_dir: str, dimension: str | None = None) -> DataFrame:
    return quality.check(demo.sales(spark, sf_dir), demo.AS_OF, dimensions={dimension} if dimension else None)


@query(f"{HASHED} select {_K}, record_hash from hashed")
def stage_orders_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.sales(spark, sf_dir).select("source_id", "job_id", "row_number", "record_hash")


@query(f"{HASHED} select source_id, record_hash, count(*) as copies from hashed group by all having count(*) > 1")
def duplicate_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_duplicates(demo.sales(spark, sf_dir))


def _dimension_query(dimension: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _issues(spark, sf_dir, dimension).select("source_id", "job_id", "row_number", "rule", "dimension", "severity", "field")

    run.__name__ = f"{dimension.lower()}_issues"
    query(f"{_issues_sql([dimension])} select * from issues")(run)


for _dimension in _RULES:
    _dimension_query(_dimension)


@query(
    f"""{SALES} select {_K}, concat_ws('; ', case when customer_name is null then 'Required field ''customer_name'' is null or blank' end,
    case when sku is null then 'Required field ''sku'' is null or blank' end) as reason from sales where customer_name is null or sku is null"""
)
def rejected_with_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rejected(_issues(spark, sf_dir, "COMPLETENESS"))


@query(
    f"""{ISSUES}, marks as (select {_K}, max(cast(severity = 'CRITICAL' as int)) as critical from issues group by all)
    select s.source_id, s.job_id, count(*) as total_records, count(*) filter (where coalesce(critical, 0) = 0) as passed_records, count(critical) as failed_records
    from sales s left join marks m on s.source_id = m.source_id and s.job_id = m.job_id and s.row_number = m.row_number group by all"""
)
def pass_fail_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(demo.sales(spark, sf_dir), demo.AS_OF)
    return quality.pass_fail(judged, quality.issues(judged))


@query(f"{ISSUES} select source_id, job_id, dimension, severity, count(*) as n from issues group by all")
def issue_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.issue_matrix(_issues(spark, sf_dir))


_PENALTY = "case severity when 'CRITICAL' then 100 when 'HIGH' then 50 when 'MEDIUM' then 20 else 5 end"
_HALF_UP = "cast(floor({0} + 0.5) as bigint)"
# scores in whole ten-thousandths: 10000 * (1 - lost / (100 n)), rounded half up
_SCORE = "greatest(0, cast(floor((2 * (100 * n - least(lost_{0}, 100 * n)) * 10000 + 100 * n) / (200 * n)) as bigint))"
_SCORED = f"""totals as (select source_id, job_id, count(*) as n from sales group by all),
lost as (select source_id, job_id, {", ".join(f"coalesce(sum({_PENALTY}) filter (where dimension = '{d}'), 0) as lost_{d}" for d in WEIGHTS)} from issues group by all),
each as (select t.source_id, t.job_id, n, {", ".join(f"coalesce({_SCORE.format(d)}, 10000) as {d.lower()}" for d in WEIGHTS)} from totals t left join lost l on t.source_id = l.source_id and t.job_id = l.job_id),
overall as (select *, cast(floor(({" + ".join(f"{d.lower()} * {int(w.replace('0.', ''))}" for d, w in WEIGHTS.items())} + 50) / 100) as bigint) as total from each),
scores as (select source_id, job_id, n as total_records, {", ".join(f"{d.lower()} / 10000.0 as {d.lower()}" for d in WEIGHTS)}, total / 10000.0 as overall,
case when total >= 9500 then 'A' when total >= 8500 then 'B' when total >= 7000 then 'C' when total >= 5500 then 'D' else 'F' end as grade from overall)"""
SCORES = f"{ISSUES}, {_SCORED}"
_SCORE_COLS = [*[d.lower() for d in WEIGHTS], "overall"]


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(demo.sales(spark, sf_dir), demo.AS_OF)
    return quality.scores(judged, quality.issues(judged))


_AS_DOUBLE = ", ".join(f"cast({c} as double) as {c}" for c in _SCORE_COLS)


@query(f"{SCORES} select source_id, job_id, total_records, {_AS_DOUBLE}, grade from scores")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(_scores(spark, sf_dir), *_SCORE_COLS)


@query(f"{SCORES} select source_id, cast(arg_max(overall, job_id) as double) as overall, arg_max(grade, job_id) as grade, count(*) as n_scores from scores group by source_id")
def score_summary_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(reads.score_summary(_scores(spark, sf_dir)), "overall")


@query(f"{SCORES} select source_id, job_id, cast(overall as double) as overall, cast(round((overall - lag(overall) over (partition by source_id order by job_id)) * 10000) as bigint) as change from scores")
def score_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(reads.score_trend(_scores(spark, sf_dir)), "overall").withColumn("change", F.round(F.col("change") * 10000).cast("bigint"))


@query(f"{ISSUES} select * from issues where severity = 'MEDIUM' and source_id = 'web' order by row_number, rule limit 20 offset 40")
def issues_filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reads.filtered(_issues(spark, sf_dir), severity="MEDIUM", source_id="web", dimension=None)
    return reads.page(found, ["row_number", "rule"], number=2).select("source_id", "job_id", "row_number", "rule", "dimension", "severity", "field")


@query(f"{SALES} select {_K} from sales where not (cast(quantity as int) <= 5)")
def user_rule_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = quality.user_rule("SMALL_ORDERS", "VALIDITY", "LOW", "quantity", "cast(payload['quantity'] as int) <= 5")
    return quality.check(demo.sales(spark, sf_dir), demo.AS_OF, [rule], {"VALIDITY"}).where("rule = 'SMALL_ORDERS'").select("source_id", "job_id", "row_number")


# ---- profiles ----
_CELLS = f"{SALES}, cells as ({' union all '.join(f'''select {_K}, '{f}' as field, "{f}" as v from sales''' for f in demo.FIELDS)}), vals as (select source_id, job_id, field, v, count(*) as n, min(row_number) as first_row from cells where v is not null group by all)"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.values(demo.sales(spark, sf_dir))


@query(f"{_CELLS} select source_id, job_id, field, count(*) - count(v) as null_count, floor((count(*) - count(v)) * 10000.0 / count(*) + 0.5) / 10000.0 as null_rate, count(v) < count(*) as nullable, count(distinct v) as distinct_count from cells group by all")
def field_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profiling.profile(demo.sales(spark, sf_dir))
    return _doubles(out, "null_rate").select("source_id", "job_id", "field", "null_count", "null_rate", "nullable", "distinct_count")


_INT = "(regexp_full_match(v, '[+-]?[0-9]+') and not regexp_full_match(v, '-?0[0-9]+') and try_cast(v as int) is not null)"
_DEC = "(regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') and not regexp_full_match(v, '-?0[^.].*'))"
_TYPES = f"""types as (select source_id, job_id, field, count(*) as distinct_count,
case when bool_and({_INT}) then 'INTEGER' when bool_and({_DEC}) then 'DECIMAL' when bool_and(regexp_full_match(v, '[0-9]{{4}}-{_M}-{_D}')) then 'DATE'
when bool_and(regexp_full_match(v, '[A-Za-z0-9+_.-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')) then 'EMAIL' when count(*) < 20 then 'CATEGORY' else 'FREE_TEXT' end as inferred_type,
case when bool_and(regexp_full_match(v, '[0-9]{{4}}-{_M}-{_D}')) then 'yyyy-MM-dd' end as date_format from vals group by all)"""


@query(f"{_CELLS}, {_TYPES} select * from types")
def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.types(_values(spark, sf_dir))


@query(f"{_CELLS} select source_id, job_id, field, cast(rank as int) as rank, v, n from (select *, row_number() over (partition by source_id, job_id, field order by n desc, v) as rank from vals) where rank <= 10")
def top10_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.top_values(_values(spark, sf_dir))


@query(f"{_CELLS} select source_id, job_id, field, cast(rank as int) as rank, v from (select *, row_number() over (partition by source_id, job_id, field order by first_row, v) as rank from vals) where rank <= 5")
def sample_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.sample_values(_values(spark, sf_dir))


@query(
    f"""{_CELLS}, {_TYPES} select v.source_id, v.job_id, v.field,
    case when any_value(inferred_type) in ('INTEGER', 'DECIMAL') then arg_min(v, (try_cast(v as decimal(38,10)), first_row)) else min(v) end as min_value,
    case when any_value(inferred_type) in ('INTEGER', 'DECIMAL') then arg_max(v, (try_cast(v as decimal(38,10)), -first_row)) else max(v) end as max_value
    from vals v join types t on v.source_id = t.source_id and v.job_id = t.job_id and v.field = t.field group by all"""
)
def minmax_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.types_and_extremes(_values(spark, sf_dir)).select(*profiling.FIELD, "min_value", "max_value")


_OLD = f"{_CELLS}, {_TYPES}, old as (select source_id, field, inferred_type from types where job_id = 'job-1996'), new as (select source_id, case when field = 'sku' then 'product_sku' else field end as field, inferred_type from types where job_id = 'job-1999' and field <> 'country')"


def _schemas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    typed = profiling.types(_values(spark, sf_dir))
    new = typed.where("job_id = 'job-1999' AND field <> 'country'").withColumn("field", F.when(F.col("field") == "sku", "product_sku").otherwise(F.col("field")))
    return typed.where("job_id = 'job-1996'"), new


@query(
    f"""{_OLD} select source_id, field, o.inferred_type as old_type, n.inferred_type as new_type, case when o.inferred_type is null then 'ADDED' when n.inferred_type is null then 'REMOVED' else 'TYPE_CHANGED' end as change
    from old o full outer join new n using (source_id, field) where o.inferred_type is distinct from n.inferred_type"""
)
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.drift(*_schemas(spark, sf_dir))


@query("select * from (values ('store', 1, 'SUPERSEDED'), ('store', 2, 'ACTIVE'), ('web', 1, 'SUPERSEDED'), ('web', 2, 'SUPERSEDED'), ('web', 3, 'ACTIVE'), ('partner', 1, 'ACTIVE')) t(source_id, version, status)")
def schema_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = spark.createDataFrame([("store", 1, "ACTIVE"), ("web", 1, "SUPERSEDED"), ("web", 2, "ACTIVE")], "source_id string, version int, status string")
    seen = _schemas(spark, sf_dir)[1].select("source_id").unionByName(spark.createDataFrame([("partner",)], "source_id string"))
    return profiling.next_versions(before, profiling.drift(*_schemas(spark, sf_dir)), seen)


# ---- mapping ----
#: Fields of three sources as their tables give them: table, key, and what each field holds.
SOURCE_FIELDS = {
    "crm": ("customer", "c_custkey", {
        "Customer Name": "c_name", "group": "c_mktsegment", "City": "'City ' || cast(c_custkey % 40 as string)", "Country": "'Country ' || cast(c_nationkey as string)", "State": "'S' || cast(c_custkey % 9 as string)",
        "Postal Code": "cast(10000 + c_custkey % 5000 as string)", "email": "'c' || cast(c_custkey as string) || '@example.com'", "completely_random_field_name": "case when c_custkey % 2 = 0 then 'true' else 'FALSE' end", "Row ID": "cast(c_custkey as string)",
    }),
    "catalog": ("part", "p_partkey", {
        "sku": "'P' || cast(p_partkey as string)", "Price Paid": f"'$' || {demo.money('cast(round(p_retailprice * 100) as bigint)')}", "unit_price": demo.money("cast(round(p_retailprice * 100) as bigint)"),
        "Currency": "case when p_partkey % 2 = 0 then 'USD' else 'EUR' end", "Quantity": "cast(p_size as string)", "department": "p_brand",
    }),
    "shop": ("orders", "o_orderkey", {
        "Order Date": demo.ISO_DATE, "Ordr Date": demo.ISO_DATE, "Random Date Column": demo.ISO_DATE, "shipping_cost_fee": demo.money("o_orderkey % 900"), "Sales": demo.money("cast(round(o_totalprice * 100) as bigint)"),
        "Ship Mode": "case when o_orderkey % 2 = 0 then 'AIR' else 'SHIP' end", "Region": "'R' || cast(o_orderkey % 5 as string)", "customer_name": "case when o_orderkey % 3 = 0 then null else 'C' || cast(o_custkey as string) end",
    }),
}
_FIELD_CELLS = " union all ".join(f"select '{s}' as source_id, '{f}' as field, {e} as v from {t}" for s, (t, _, fields) in SOURCE_FIELDS.items() for f, e in fields.items())
_FIELD_TYPES = f"""select source_id, field, case when bool_and({_INT}) then 'INTEGER' when bool_and({_DEC}) then 'DECIMAL' when bool_and(lower(v) in ('true', 'false')) then 'BOOLEAN' when bool_and(regexp_full_match(v, '[0-9]{{4}}-{_M}-{_D}')) then 'DATE'
when bool_and(regexp_full_match(v, '[A-Za-z0-9+_.-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')) then 'EMAIL' when bool_and(regexp_full_match(v, '[$][0-9]+(\\.[0-9]{{1,2}})?')) then 'CURRENCY_AMOUNT' when count(distinct v) < 20 then 'CATEGORY' else 'FREE_TEXT' end as inferred_type
from ({_FIELD_CELLS}) where v is not null group by all"""
_TARGET_ROWS = ", ".join(f"({i}, '{e}', '{f}', '{t}', [{_sql_list([f, *s])}])" for i, (e, f, t, s) in enumerate(REGISTRY))
_NORM = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[ _]+'), lambda t: t <> ''))"
MAPPED = f"""with fields as ({_FIELD_TYPES}), targets as (select * from (values {_TARGET_ROWS}) t(ord, entity, target, target_type, names)),
names as (select source_id, field, inferred_type, ord, entity, target, target_type, {_NORM.format('field')} as mine, {_NORM.format('name')} as theirs, {_WORDS.format('field')} as a, {_WORDS.format('name')} as b from fields, (select *, unnest(names) as name from targets)),
pairs as (select source_id, field, ord, entity, target, max(case when mine = theirs then 1.00 when levenshtein(mine, theirs) <= 2 then 0.85 when len(list_intersect(a, b)) * 2 >= len(list_distinct(list_concat(a, b))) and len(a) + len(b) > 0 then 0.70
when inferred_type = target_type or (inferred_type = 'CURRENCY_AMOUNT' and target_type = 'DECIMAL') then 0.55 else 0 end) as confidence from names group by all),
best as (select source_id, field, entity, target, confidence from (select *, row_number() over (partition by source_id, field order by confidence desc, ord) as n from pairs) where n = 1),
mapped as (select source_id, field, case when confidence >= 0.55 then entity else '' end as entity, case when confidence >= 0.55 then target else '' end as target, cast(case when confidence >= 0.55 then confidence else 0 end as double) as confidence,
case when confidence >= 0.8 then 'AUTO_CONFIRMED' when confidence >= 0.55 then 'PENDING' else 'IGNORED' end as status from best)"""


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of the sources with the types that profiling finds."""
    found = None
    for source, (name, key, fields) in SOURCE_FIELDS.items():
        flat = demo.table(spark, sf_dir, name).select(F.col(key).alias("_row"), *[F.expr(e).alias(f) for f, e in fields.items()])
        staged = stage(flat, list(fields), F.lit(source), F.lit("job-1"), F.col("_row"))
        own = profiling.types(profiling.values(staged)).select("source_id", "field", "inferred_type")
        found = own if found is None else found.unionByName(own)
    return cut(found)


@query(f"{MAPPED} select source_id, field, entity, target, cast(confidence as double) as confidence from pairs")
def mapping_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(mapping.score_pairs(_fields(spark, sf_dir), mapping.registry(spark)).select("source_id", "field", "entity", "target", "confidence"), "confidence")


@query(f"{MAPPED} select * from mapped")
def mapping_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(mapping.map_fields(_fields(spark, sf_dir), mapping.registry(spark)), "confidence")


@query(f"{MAPPED} select source_id, field, case when field = 'City' then 'customers' else entity end as entity, case when field = 'City' then 'segment' else target end as target, case when field = 'City' then 1.0 else confidence end as confidence, case when field = 'City' then 'AUTO_CONFIRMED' else status end as status from mapped")
def mapping_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An existing mapping stays, an ignored one is scored again."""
    old = spark.createDataFrame([("crm", "City", "customers", "segment", "1.00", "AUTO_CONFIRMED"), ("shop", "Sales", "", "", "0.00", "IGNORED"), ("crm", "Gone", "orders", "total_amount", "1.00", "AUTO_CONFIRMED")], "source_id string, field string, entity string, target string, confidence string, status string")
    old = old.withColumn("confidence", F.col("confidence").cast("decimal(3,2)"))
    return _doubles(mapping.map_fields(_fields(spark, sf_dir), mapping.registry(spark), old), "confidence")


@query(f"{MAPPED} select * from (values ('crm', 'City'), ('crm', 'Gone'), ('shop', 'City')) t(source_id, field) where not exists (select 1 from fields f where f.source_id = t.source_id and f.field = t.field)")
def stale_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = spark.createDataFrame([("crm", "City"), ("crm", "Gone"), ("shop", "City")], "source_id string, field string")
    return mapping.stale(old, _fields(spark, sf_dir))


_MAPS = [("customer_name", "customers", "name", "AUTO_CONFIRMED"), ("EMAIL", "customers", "email", "AUTO_CONFIRMED"), ("segment", "customers", "segment", "PENDING"), ("sku", "products", "sku", "AUTO_CONFIRMED"), ("unit_price", "products", "unit_price", "AUTO_CONFIRMED"), ("order_date", "orders", "order_date", "AUTO_CONFIRMED"), ("total_amount", "orders", "total_amount", "AUTO_CONFIRMED"), ("ship mode", "orders", "ship_mode", "AUTO_CONFIRMED"), ("country", "customers", "country", "AUTO_CONFIRMED"), ("currency", "", "", "IGNORED")]


def _maps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, *m) for s in ("store", "web") for m in _MAPS], "source_id string, field string, entity string, target string, status string")


_LONG = " union all ".join(
    f"""select {_K}, '{e[:-1]}' as entity, '{t}' as field, "{next(f for f in demo.FIELDS if f.lower() == s.lower())}" as value, {str(st != 'AUTO_CONFIRMED' or t == 'country').lower()} as extra from sales"""
    for s, e, t, st in _MAPS
    if e
)


@query(f"{SALES}, long as ({_LONG}) select * from long where not extra or value is not null")
def transform_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.transform_long(demo.sales(spark, sf_dir), _maps(spark)).drop("pos")


@query(f"{SALES}, long as ({_LONG}), kept as (select * from long where not extra or value is not null) select {_K}, entity, count(*) filter (where extra) as extras, count(value) filter (where not extra) as columns from kept group by all")
def additional_attributes_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mapping.record_entities(demo.sales(spark, sf_dir), _maps(spark))
    return out.select("source_id", "job_id", "row_number", "entity", F.size("additional_attributes").cast("bigint").alias("extras"), F.size("fields").cast("bigint").alias("columns"))


_TWO = [("total_amount", "orders", "total_amount"), ("line_total", "orders", "total_amount"), ("email", "customers", "phone"), ("sku", "customers", "phone")]


@query(f"{SALES} select {_K}, 'order' as entity, line_total as value from sales union all select {_K}, 'customer', sku from sales")
def transform_two_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields with one target: the later in the payload counts, even if it is null."""
    maps = spark.createDataFrame([(s, *m, "AUTO_CONFIRMED") for s in ("store", "web") for m in _TWO], "source_id string, field string, entity string, target string, status string")
    known = {"orders": ["total_amount"], "customers": ["phone"]}
    out = mapping.record_entities(demo.sales(spark, sf_dir), maps, known)
    value = F.coalesce(F.try_element_at("fields", F.lit("total_amount")), F.try_element_at("fields", F.lit("phone")))
    return out.select("source_id", "job_id", "row_number", "entity", value.alias("value"))


# ---- canonical ----
def _loaded(spark: SparkSession, sf_dir: str, kind: str, entity: canonical.Entity, sources: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    store, found = canonical.empty_store(spark, entity), None
    for s in sources:
        store, conflicts, _ = canonical.load(demo.records(spark, sf_dir, s, kind), store if found is None else written(store, entity.table), entity, demo.trust(spark))
        found = conflicts if found is None else found.unionByName(conflicts)
    return store, found


_ALL = ("store", "web", "partner")
_C = f"with s as {demo.flat_sql('store', 'customers')}, w as {demo.flat_sql('web', 'customers')}, p as {demo.flat_sql('partner', 'customers')}"
_P = f"with s as {demo.flat_sql('store', 'products')}, w as {demo.flat_sql('web', 'products')}, p as {demo.flat_sql('partner', 'products')}"
_JOINED = "from s left join w on s.k = w.k left join p on s.k = p.k"
_PRICE_OFF = "round(cast(abs(cast(w.unit_price as decimal(12,4)) - cast(s.unit_price as decimal(12,4))) as decimal(24,10)) / greatest(cast(w.unit_price as decimal(12,4)), cast(s.unit_price as decimal(12,4))), 4) > 0.01"


@query(
    f"""{_C} select s.name, s.email, coalesce(p.phone, w.phone, s.phone) as phone, coalesce(p.segment, w.segment, s.segment) as segment, 'store' as source,
    case when p.k is not null then coalesce(p.segment <> coalesce(w.segment, s.segment), false) when w.k is not null then w.segment <> s.segment else false end as has_conflicts {_JOINED}"""
)
def canonical_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir, "customers", canonical.CUSTOMERS, _ALL)[0].select("name", "email", "phone", "segment", "source", "has_conflicts")


@query(
    f"""{_P} select s.sku, s.name, coalesce(p.category, s.category) as category, coalesce(p.sub_category, s.sub_category) as sub_category, cast(w.unit_price as double) as unit_price, 'store' as source,
    case when p.k is not null then p.category <> s.category or p.sub_category <> s.sub_category else {_PRICE_OFF} end as has_conflicts {_JOINED}"""
)
def canonical_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _loaded(spark, sf_dir, "products", canonical.PRODUCTS, _ALL)[0]
    return _doubles(store, "unit_price").select("sku", "name", "category", "sub_category", "unit_price", "source", "has_conflicts")


_S = f"with s as {demo.flat_sql('store', 'salespersons')}, w as {demo.flat_sql('web', 'salespersons')}"


@query(
    f"""{_S} select coalesce(w.name, s.name) as name, s.email, coalesce(w.territory, s.territory) as territory, coalesce(cast(w.active as boolean), true) as active, 'store' as source,
    coalesce(w.territory <> s.territory, false) as has_conflicts from s left join w on s.k = w.k"""
)
def canonical_salespersons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir, "salespersons", canonical.SALESPERSONS, ("store", "web"))[0].select("name", "email", "territory", "active", "source", "has_conflicts")


@query(f"with s as {demo.flat_sql('store', 'regions')}, w as {demo.flat_sql('web', 'regions')} select s.name, coalesce(w.country, s.country) as country, w.zone, 'store' as source from s left join w on s.k = w.k")
def canonical_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, conflicts = canonical.empty_store(spark, canonical.REGIONS), []
    for source in ("store", "web"):
        store, found, _ = canonical.load(demo.records(spark, sf_dir, source, "regions"), store, canonical.REGIONS, demo.trust(spark))
        store = cut(store)
        conflicts += [found] * (found is not None)
    if conflicts:
        raise AssertionError("regions are not watched for conflicts")
    return store.select("name", "country", "zone", "source")


@query(
    f"""with s as {demo.flat_sql('store', 'orders')}, w as {demo.flat_sql('web', 'orders')}
    select s.k as entity_id, 'total_amount' as field, cast(cast(s.total_amount as decimal(12,4)) as string) as value_a, cast(cast(w.total_amount as decimal(12,4)) as string) as value_b, 'TRUST_HIERARCHY' as strategy from s join w on s.k = w.k
    where abs(cast(s.total_amount as decimal(12,4)) - cast(w.total_amount as decimal(12,4))) > 0.01
    union all select s.k, 'ship_mode', s.ship_mode, w.ship_mode, 'TRUST_HIERARCHY' from s join w on s.k = w.k where s.ship_mode <> w.ship_mode"""
)
def order_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and ship modes of the same orders as two sources have them."""
    sides = [canonical.typed(demo.records(spark, sf_dir, s, "orders"), canonical.ORDERS).withColumnRenamed("row_number", "entity_id") for s in ("store", "web")]
    return conflict.detect("orders", *sides, demo.trust(spark)).select("entity_id", "field", "value_a", "value_b", "strategy")


@query("select o_orderkey as row_number, strftime(o_orderdate, '%Y-%m-%d') as order_date, cast(round(o_totalprice * 100) as bigint) as cents from orders")
def match_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second load of orders without references finds each by date, total and source."""
    bare = demo.records(spark, sf_dir, "store", "orders").withColumn("fields", F.map_filter("fields", lambda k, v: k != "external_ref"))
    store, _, _ = canonical.load(bare, canonical.empty_store(spark, canonical.ORDERS), canonical.ORDERS, demo.trust(spark))
    hit = canonical.match(canonical.typed(bare, canonical.ORDERS), cut(store), canonical.ORDERS).select("row_number", "entity_id")
    found = hit.join(store.select("entity_id", "order_date", "total_amount"), "entity_id")
    return found.select("row_number", F.col("order_date").cast("string").alias("order_date"), F.round(F.col("total_amount") * 100).cast("bigint").alias("cents"))


@query(f"{_C} select s.k as row_number, s.email as ref from s")
def external_refs_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a field named like one, the business key is the reference."""
    return canonical.typed(demo.records(spark, sf_dir, "store", "customers"), canonical.CUSTOMERS).select("row_number", "ref")


_WEB_SEGMENT = "case when source_id = 'web' and row_number % 5 = 0 then 'CORPORATE' else segment end"


@query(
    f"""{SALES}, marked as (select *, customer_name is not null and sku is not null as ok, {_WEB_SEGMENT} as said from sales),
    ends as (select source_id, email, arg_max(said, row_number) as said from marked where ok group by all),
    unlike as (select count(*) as n from ends s join ends w on s.email = w.email and s.source_id = 'store' and w.source_id = 'web' where s.said <> w.said)
    select source_id, 'job-1' as job_id, count(*) as read_records, count(*) filter (where ok) as passed_records, count(*) filter (where not ok) as rejected_records, count(*) filter (where ok) as loaded_records,
    case when source_id = 'web' then (select n from unlike) else 0 end as conflicts from marked group by source_id"""
)
def run_job_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job of each source, one after the other, into the same stores: the second finds what the first says otherwise."""
    maps = _maps(spark).withColumn("confidence", F.lit("1.00").cast("decimal(3,2)")).withColumn("status", F.when(F.col("field") == "segment", "AUTO_CONFIRMED").otherwise(F.col("status")))
    flat = demo.sales_flat(spark, sf_dir).withColumn("segment", F.expr(_WEB_SEGMENT))
    stores, told = empty_stores(spark), None
    for source in ("store", "web"):
        staged = stage(flat.where(F.col("source_id") == source), list(demo.FIELDS), F.col("source_id"), F.lit("job-1"), F.col("row_number"))
        out = run_job(staged, stores, demo.trust(spark), demo.AS_OF, mapping.registry(spark), maps.where(F.col("source_id") == source))
        stores = {name: written(out[name], name) for name in stores}
        told = out["counters"] if told is None else told.unionByName(out["counters"])
    return told


# ---- jobs one after another: what they leave behind, and drift among their issues ----
_JOBS = ["job-1996", "job-1997", "job-1998", "job-1999"]
_CHANGED = {"customer_name": "case when job_id = 'job-1999' and row_number % 4 = 0 then null else customer_name end", "unit_price": "case when job_id = 'job-1999' then '50' || unit_price else unit_price end", "segment": "case when job_id = 'job-1999' then 'New ' || segment else segment end"}
_FEWER = ("job-1998", "job-1999")
_LATER = f"""(select source_id, job_id, row_number, {", ".join(f'{_CHANGED.get(f) or (f"case when job_id in ({_sql_list(list(_FEWER))}) then null else country end" if f == "country" else chr(34) + f + chr(34))} as "{f}"' for f in demo.FIELDS)}
from ({demo.SALES_SQL}) where source_id = 'store' and job_id in ({_sql_list(_JOBS)}))"""
_DRIFTS = f"""jobs as (select * from (values {", ".join(f"('{j}', {i})" for i, j in enumerate(_JOBS, 1))}) t(job_id, seq)),
own as (select seq, c.* from cells c join jobs using (job_id) where not (field = 'country' and job_id in ({_sql_list(list(_FEWER))}))),
kinds as (select seq, types.* from types join jobs using (job_id)),
rates as (select seq, field, floor((count(*) - count(v)) * 10000.0 / count(*) + 0.5) / 10000.0 as null_rate from own group by all),
tops as (select seq, field, list(v) as top from (select seq, field, v, row_number() over (partition by seq, field order by n desc, v) as r from vals join jobs using (job_id)) where r <= 10 group by all),
ends as (select k.seq, k.field, case when any_value(inferred_type) in ('INTEGER', 'DECIMAL') then arg_min(v, (try_cast(v as decimal(38,10)), first_row)) else min(v) end as lo,
case when any_value(inferred_type) in ('INTEGER', 'DECIMAL') then arg_max(v, (try_cast(v as decimal(38,10)), -first_row)) else max(v) end as hi from vals v join kinds k on v.job_id = k.job_id and v.field = k.field group by k.seq, k.field),
profs as (select rates.seq, rates.field, null_rate, coalesce(top, []) as top, try_cast(lo as double) as lo, try_cast(hi as double) as hi from rates left join tops using (seq, field) left join ends using (seq, field)),
hist as (select n.seq, p.field, floor(avg(p.null_rate) * 10000 + 0.5 + 1e-7) / 10000.0 as usual, list_distinct(flatten(list(p.top))) as known from jobs n join profs p on p.seq in (n.seq - 1, n.seq - 2) where n.seq >= 3 group by all having count(*) = 2),
spread as (select n.seq, field, count(x) as times, avg(x) as m, stddev_pop(x) as sd from jobs n join (select seq, field, unnest([lo, hi]) as x from profs) p on p.seq in (n.seq - 1, n.seq - 2) group by all),
drift as (select job_id, field, unnest([case when abs(null_rate - usual) > 0.20 then 'COMPLETENESS_NULL_RATE_DRIFT' end, case when len(top) > 0 and len(known) > 0 and len(list_filter(top, lambda x: not list_contains(known, x))) > 0.5 * len(top) then 'VALIDITY_VALUE_DISTRIBUTION_DRIFT' end,
case when times >= 2 and sd <> 0 and (coalesce(lo < m - 3 * sd, false) or coalesce(hi > m + 3 * sd, false)) then 'ACCURACY_RANGE_EXPANSION_DRIFT' end]) as rule from profs join hist using (seq, field) join spread using (seq, field) join jobs using (seq))"""
_ASSESSED = f"{ISSUES}, {_CELLS[len(SALES) + 2 :]}, {_TYPES}, {_DRIFTS}".replace(demo.SALES_SQL, _LATER[1:-1])


def _assessed(spark: SparkSession, sf_dir: str) -> tuple[History, list[dict[str, DataFrame]]]:
    """Four jobs of a source: the third lacks a field, the fourth has other values, more nulls and a wider range."""
    history = History(spark, scratch(spark, "history"))
    flat = demo.sales_flat(spark, sf_dir).where("source_id = 'store'").withColumns({f: F.expr(e) for f, e in _CHANGED.items()})
    done = []
    for seq, job in enumerate(_JOBS, 1):
        fields = [f for f in demo.FIELDS if f != "country" or job not in _FEWER]
        staged = stage(flat.where(F.col("job_id") == job), fields, F.col("source_id"), F.col("job_id"), F.col("row_number"))
        done.append(assess(staged, demo.AS_OF, history, seq))
    return history, done


@query(f"{_ASSESSED} select job_id, field, rule from drift where rule is not null")
def job_drift_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of each job against those before it, as it stands among the job's issues."""
    found = None
    for out in _assessed(spark, sf_dir)[1]:
        own = out["issues"].where("row_number IS NULL").select("job_id", "field", "rule")
        found = own if found is None else found.unionByName(own)
    return found


@query(
    f"""{_ASSESSED}, {_SCORED.replace("from issues group by all)", "from (select source_id, job_id, severity, dimension from issues union all select 'store', job_id, 'MEDIUM', split_part(rule, '_', 1) from drift where rule is not null) group by all)")},
    differ as (select n.seq, count(*) filter (where a.inferred_type is distinct from b.inferred_type) as changed from jobs n cross join (select distinct field from kinds) f left join kinds a on a.seq = n.seq and a.field = f.field left join kinds b on b.seq = n.seq - 1 and b.field = f.field group by all)
    select j.job_id, cast(sum(case when changed > 0 then 1 else 0 end) over (order by j.seq) as int) as version, cast(coalesce(changed, 0) as int) as changed, cast((select count(*) from drift d where d.job_id = j.job_id and rule is not null) as int) as drifted, cast(overall as double) as overall, grade
    from jobs j left join differ using (seq) join scores s on s.job_id = j.job_id"""
)
def job_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of the four jobs, with the scores that drift has lowered."""
    history, done = _assessed(spark, sf_dir)
    scores = None
    for out in done:
        scores = out["scores"] if scores is None else scores.unionByName(out["scores"])
    return _doubles(history.read("ledger").join(scores.select("job_id", "overall", "grade"), "job_id").select("job_id", "version", "changed", "drifted", "overall", "grade"), "overall")


@query(
    f"""{_ASSESSED}, differ as (select n.seq, n.job_id, count(*) filter (where a.inferred_type is distinct from b.inferred_type) as changed, count(a.field) as fields from jobs n cross join (select distinct field from kinds) f left join kinds a on a.seq = n.seq and a.field = f.field left join kinds b on b.seq = n.seq - 1 and b.field = f.field group by all),
    made as (select job_id, fields, row_number() over (order by seq) as version from differ where changed > 0)
    select row_number() over (order by version desc) as place, 'store' as source_id, cast(version as int) as version, case when version = max(version) over () then 'ACTIVE' else 'SUPERSEDED' end as status, job_id, fields from made"""
)
def schema_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema's versions as the four jobs made them, newest first."""
    found = histories.schema_versions(_assessed(spark, sf_dir)[0], "store")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("version"))).cast("bigint"))


# ---- tables of changes ----
@query(
    """select 'O' || cast(o_orderkey as string) as ref, cast(round(o_totalprice * 100) as bigint) as cents, case when o_orderkey % 5 = 0 and o_orderkey % 3 <> 0 then 'RAIL' when o_orderkey % 2 = 0 then 'AIR' else 'SHIP' end as ship_mode,
    case when o_orderkey % 3 = 0 or o_orderkey % 5 = 0 then 1 else 0 end as window from orders"""
)
def orders_in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in two windows, the second with new ones and changes to some of the first: merged, they are what a full load has. The first
    is compacted before the second comes; ``window`` says where each row was last written."""
    everything = demo.records(spark, sf_dir, "store", "orders")
    rail = F.map_concat(F.map_filter("fields", lambda k, v: k != "ship_mode"), F.create_map(F.lit("ship_mode"), F.lit("RAIL")))
    first = everything.where("row_number % 3 <> 0")
    second = everything.where("row_number % 3 = 0").unionByName(everything.where("row_number % 3 <> 0 AND row_number % 5 = 0").withColumn("fields", rail))
    table = versioned(spark, scratch(spark, "tables"))["orders"]
    for window, records in enumerate((first, second)):
        changed, _, _ = canonical.load(records, table.read(window), canonical.ORDERS, demo.trust(spark), changed_only=True, job=f"job-{window}")
        table.write(changed, window)
        if window == 0:
            table.compact(0)
    now = spark.read.parquet(f"{table.path}/changes/window=1").select("entity_id", F.lit(1).alias("window"))
    merged = table.read().join(now, "entity_id", "left").fillna(0, ["window"])
    return merged.select("ref", F.round(F.col("total_amount") * 100).cast("bigint").alias("cents"), "ship_mode", "window")


@query(
    """select 'O' || cast(o_orderkey as string) as ref, case when o_orderkey % 5 = 0 and o_orderkey % 3 <> 0 then 'RAIL' when o_orderkey % 2 = 0 then 'AIR' else 'SHIP' end as ship_mode,
    case when o_orderkey % 3 = 0 or o_orderkey % 5 = 0 then 1 else 0 end as window, o_orderkey % 3 <> 0 and o_orderkey % 5 = 0 as looked_up from orders"""
)
def orders_found_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in two windows, where the second reads no more of the first than the orders that share a key with its records."""
    everything = demo.records(spark, sf_dir, "store", "orders")
    rail = F.map_concat(F.map_filter("fields", lambda k, v: k != "ship_mode"), F.create_map(F.lit("ship_mode"), F.lit("RAIL")))
    second = everything.where("row_number % 3 = 0").unionByName(everything.where("row_number % 3 <> 0 AND row_number % 5 = 0").withColumn("fields", rail))
    table = versioned(spark, scratch(spark, "tables"))["orders"]
    looked = None
    for window, records in enumerate((everything.where("row_number % 3 <> 0"), second)):
        looked = cut(table.sharing(canonical.key_hashes(canonical.typed(records, canonical.ORDERS), canonical.ORDERS), window))
        changed, _, _ = canonical.load(records, looked, canonical.ORDERS, demo.trust(spark), changed_only=True, job=f"job-{window}")
        table.write(changed, window)
        if window == 0:
            table.compact(0)
    now = spark.read.parquet(f"{table.path}/changes/window=1").select("entity_id", F.lit(1).alias("window"))
    merged = table.read().join(now, "entity_id", "left").join(looked.select("entity_id", F.lit(True).alias("looked_up")), "entity_id", "left").fillna(0, ["window"])
    return merged.select("ref", "ship_mode", "window", F.coalesce("looked_up", F.lit(False)).alias("looked_up"))


@query(f"{SALES} select source_id, field, least(10, count(*)) as drawn from (select source_id, unnest([{', '.join(f'{chr(39)}{f}{chr(39)}' for f in demo.FIELDS)}]) as field, unnest([{', '.join(f'{chr(34)}{f}{chr(34)}' for f in demo.FIELDS)}]) as v from sales) where v is not null group by source_id, field")
def random_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values the advisor sees of each field; which ones is left to chance."""
    return mapping.samples(demo.sales(spark, sf_dir)).select("source_id", "field", F.size("samples").cast("bigint").alias("drawn"))


@query(f"{ISSUES} select rule, count(*) as n, (select count(*) from issues where source_id = 'store') as total from (select * from issues where source_id = 'store' order by row_number, rule limit 20) group by rule")
def issues_counted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, total = reads.counted_page(reads.filtered(_issues(spark, sf_dir), source_id="store"), ["row_number", "rule"])
    return rows.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.lit(total))


def _with_owner(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders, each record with its customer; customers with ids; the order records."""
    orders = demo.records(spark, sf_dir, "store", "orders")
    owner = demo.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_number"), F.col("o_custkey").alias("k"))
    people = demo.records(spark, sf_dir, "store", "customers").withColumnRenamed("row_number", "k").select("k", F.col("fields").alias("who"))
    per_order = owner.join(people, "k").select(F.lit("store").alias("source"), "row_number", F.col("who").alias("fields"))
    return orders, per_order, owner


@query(
    """select 'O' || cast(o_orderkey as string) as ref, strftime(o_orderdate, '%Y-%m-%d') as order_date, cast(round(o_totalprice * 100) as bigint) as cents, case when o_orderkey % 2 = 0 then 'AIR' else 'SHIP' end as ship_mode, c_name as customer_name
    from orders join customer on o_custkey = c_custkey"""
)
def canonical_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, per_order, _ = _with_owner(spark, sf_dir)
    people, _, ids = canonical.load(per_order, canonical.empty_store(spark, canonical.CUSTOMERS), canonical.CUSTOMERS, demo.trust(spark))
    linked = canonical.link_orders(orders, ids)
    store, _, _ = canonical.load(linked, canonical.empty_store(spark, canonical.ORDERS), canonical.ORDERS, demo.trust(spark))
    named = store.join(people.select(F.col("entity_id").alias("customer_id"), F.col("name").alias("customer_name")), "customer_id")
    return named.select("ref", F.col("order_date").cast("string").alias("order_date"), F.round(F.col("total_amount") * 100).cast("bigint").alias("cents"), "ship_mode", "customer_name")


@query(
    """select 'O' || cast(l_orderkey as string) as ref, 'P' || cast(l_partkey as string) as sku, cast(l_quantity as int) as quantity, count(*) as n
    from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by all"""
)
def canonical_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their orders and products; each line is a record of its own."""
    lines = demo.table(spark, sf_dir, "lineitem")
    trust = demo.trust(spark)
    orders, _, order_ids = canonical.load(demo.records(spark, sf_dir, "store", "orders"), canonical.empty_store(spark, canonical.ORDERS), canonical.ORDERS, trust)
    products, _, product_ids = canonical.load(demo.records(spark, sf_dir, "store", "products"), canonical.empty_store(spark, canonical.PRODUCTS), canonical.PRODUCTS, trust)
    # what the result has of an order and of a product meets its record's number first: lines are moved with numbers and short texts, not with ids
    recs = lines.select("l_orderkey", "l_partkey", F.col("l_quantity").cast("int").alias("quantity"))
    o = order_ids.select(F.col("row_number").alias("l_orderkey"), "entity_id").join(orders.select("entity_id", "ref"), "entity_id").select("l_orderkey", "ref")
    p = product_ids.select(F.col("row_number").alias("l_partkey"), "entity_id").join(products.select("entity_id", "sku"), "entity_id").select("l_partkey", "sku")
    return recs.join(p, "l_partkey").join(o, "l_orderkey").groupBy("ref", "sku", "quantity").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_C} select w.k as row_number, s.k as stored from w join s on w.k = s.k")
def match_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _, ids = canonical.load(demo.records(spark, sf_dir, "store", "customers"), canonical.empty_store(spark, canonical.CUSTOMERS), canonical.CUSTOMERS, demo.trust(spark))
    hit = canonical.match(canonical.typed(demo.records(spark, sf_dir, "web", "customers"), canonical.CUSTOMERS), store, canonical.CUSTOMERS)
    return hit.join(ids.select(F.col("row_number").alias("stored"), "entity_id"), "entity_id").select("row_number", "stored")


@query("select o_orderkey as row_number, 'O' || cast(o_orderkey as string) as ref from orders")
def external_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.records(spark, sf_dir, "store", "orders").select("row_number", canonical.external_ref(F.col("fields"), None).alias("ref"))


_CONFLICTS = f"""{_C}, customer_conflicts as (
select 'customers' as entity, s.name as owner, 'segment' as field, s.segment as value_a, 'web' as source_b, w.segment as value_b, 'TRUST_HIERARCHY' as strategy from s join w on s.k = w.k where w.segment <> s.segment
union all select 'customers', s.name, 'segment', coalesce(w.segment, s.segment), 'partner', p.segment, 'FLAGGED_FOR_REVIEW' from s left join w on s.k = w.k join p on s.k = p.k where p.segment <> coalesce(w.segment, s.segment)),
{_P.replace('with s as', 'ps as').replace(', w as', ', pw as').replace(', p as', ', pp as')},
product_conflicts as (
select 'products' as entity, s.sku as owner, 'unit_price' as field, cast(cast(s.unit_price as decimal(12,4)) as string) as value_a, 'web' as source_b, cast(cast(w.unit_price as decimal(12,4)) as string) as value_b, 'TRUST_HIERARCHY' as strategy from ps s join pw w on s.k = w.k where {_PRICE_OFF}
union all select 'products', s.sku, 'category', s.category, 'partner', p.category, 'FLAGGED_FOR_REVIEW' from ps s join pp p on s.k = p.k where p.category <> s.category
union all select 'products', s.sku, 'sub_category', s.sub_category, 'partner', p.sub_category, 'LATEST_WINS' from ps s join pp p on s.k = p.k where p.sub_category <> s.sub_category),
conflicts as (select *, 'store' as source_a, case when strategy = 'FLAGGED_FOR_REVIEW' then 'OPEN' else 'RESOLVED' end as status from customer_conflicts union all select *, 'store', case when strategy = 'FLAGGED_FOR_REVIEW' then 'OPEN' else 'RESOLVED' end from product_conflicts)"""
_CONFLICT_COLS = ["entity", "owner", "field", "source_a", "value_a", "source_b", "value_b", "strategy", "status"]


def _conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    people, a = _loaded(spark, sf_dir, "customers", canonical.CUSTOMERS, _ALL)
    things, b = _loaded(spark, sf_dir, "products", canonical.PRODUCTS, _ALL)
    owners = people.select("entity_id", F.col("name").alias("owner")).unionByName(things.select("entity_id", F.col("sku").alias("owner")))
    return a.unionByName(b).join(owners, "entity_id")


@query(f"{_CONFLICTS} select {', '.join(_CONFLICT_COLS)} from conflicts")
def conflicts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conflicts(spark, sf_dir).select(*_CONFLICT_COLS)


@query(f"{_CONFLICTS} select strategy, status, count(*) as n from conflicts group by all")
def conflicts_by_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conflicts(spark, sf_dir).groupBy("strategy", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_CONFLICTS} select source_id, count(*) as open_conflicts from (select unnest([source_a, source_b]) as source_id from conflicts where status = 'OPEN') group by all")
def open_conflicts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict.open_by_source(_conflicts(spark, sf_dir))


@query(f"{_CONFLICTS} select owner, field, value_b from conflicts where (source_a = 'web' or source_b = 'web') and entity = 'customers' order by owner, field limit 20")
def conflicts_filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.page(reads.conflicts_of(_conflicts(spark, sf_dir), source="web", entity="customers"), ["owner", "field"]).select("owner", "field", "value_b")


@query(f"{_CONFLICTS} select owner, case when status = 'OPEN' then 'CHOSEN' else '' end as segment, case when status = 'OPEN' then 'RESOLVED' else status end as status from conflicts where entity = 'customers' and source_b = 'partner'")
def resolve_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    people, found = _loaded(spark, sf_dir, "customers", canonical.CUSTOMERS, _ALL)
    found = found.where("source_b = 'partner'")
    choices = found.where("status = 'OPEN'").select("entity_id", "field", F.lit("CHOSEN").alias("chosen"))
    after, settled = conflict.resolve(found, people, choices)
    return after.join(settled.select("entity_id", F.col("name").alias("owner"), "segment"), "entity_id").select("owner", "segment", "status")


@query(f"{_CONFLICTS} select owner, case when strategy = 'LATEST_WINS' then 'SUPPRESSED' else status end as status from conflicts where entity = 'products'")
def suppress_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _conflicts(spark, sf_dir).where("entity = 'products'")
    return conflict.suppress(found, found.where("strategy = 'LATEST_WINS'")).select("owner", "status")


@query(f"{SALES}, good as (select * from sales where sku is not null) select source_id, row_number, 'transform' as step, 'sku' as to_field, sku as output_value from good union all select source_id, row_number, 'transform', 'unit_price', unit_price from good")
def lineage_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = mapping.transform_long(demo.sales(spark, sf_dir).where("payload['sku'] IS NOT NULL"), _maps(spark))
    parts = mapping.entities(long.where("entity = 'product'")).select(F.col("source_id").alias("source"), "row_number", "fields")
    ids = None
    for s in ("store", "web"):
        _, _, own = canonical.load(parts.where(F.col("source") == s), canonical.empty_store(spark, canonical.PRODUCTS), canonical.PRODUCTS, demo.trust(spark))
        ids = own if ids is None else ids.unionByName(own)
    steps = canonical.lineage(long, ids, "product").select("source_id", "row_number", F.explode("transformations").alias("t"))
    return steps.select("source_id", "row_number", F.col("t.step").alias("step"), F.col("t.toField").alias("to_field"), F.col("t.outputValue").alias("output_value"))


def _attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    attrs = F.create_map(F.lit("tier"), F.expr("case when c_custkey % 4 = 0 then 'x' else cast(c_custkey % 5 as string) end"), F.lit("note"), F.lit("n"))
    return demo.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", attrs.alias("additional_attributes"))


@query("select c_custkey, case when c_custkey % 4 = 0 then null else cast(c_custkey % 5 as int) end as tier, 1 as n_attributes from customer")
def promote_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evolve.promote(_attributes(spark, sf_dir), "customers", "tier", "INTEGER")
    return out.select("c_custkey", "tier", F.size("additional_attributes").alias("n_attributes"))


@query("select c_custkey, c_mktsegment as segment, 3 as n_attributes from customer")
def demote_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evolve.demote(_attributes(spark, sf_dir), "customers", "c_mktsegment")
    return out.select("c_custkey", F.try_element_at("additional_attributes", F.lit("c_mktsegment")).alias("segment"), F.size("additional_attributes").alias("n_attributes"))


# ---- orders with all their links ----
@query(
    """select 'O' || cast(o_orderkey as string) as ref, case when o_orderkey % 4 <> 0 then s_name end as seller, case when o_orderkey % 3 <> 0 then r_name end as region
    from orders left join supplier on s_suppkey = o_orderkey % 10 + 1 left join region on r_regionkey = o_orderkey % 5"""
)
def orders_with_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the salesperson and the region of their records, where these name any."""
    trust, orders, per_order, _ = demo.trust(spark), *_with_owner(spark, sf_dir)
    _, _, customers = canonical.load(per_order, canonical.empty_store(spark, canonical.CUSTOMERS), canonical.CUSTOMERS, trust)
    key = demo.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_number"))
    loaded = {}
    for entity, kind, k, some in ((canonical.SALESPERSONS, "salespersons", F.col("row_number") % 10 + 1, "row_number % 4 <> 0"), (canonical.REGIONS, "regions", F.col("row_number") % 5, "row_number % 3 <> 0")):
        those = demo.records(spark, sf_dir, "store", kind).select(F.col("row_number").alias("k"), "fields")
        records = key.where(some).withColumn("k", k).join(those, "k").select(F.lit("store").alias("source"), "row_number", "fields")
        store, _, ids = canonical.load(records, canonical.empty_store(spark, entity), entity, trust)
        loaded[entity.table] = (store.select(F.col("entity_id").alias(f"{kind[:-1]}_id"), F.col("name").alias(kind[:-1])), ids)
    linked = canonical.link_orders(orders, customers, loaded["salespersons"][1], loaded["regions"][1])
    store, _, _ = canonical.load(linked, canonical.empty_store(spark, canonical.ORDERS), canonical.ORDERS, trust)
    named = store.join(loaded["salespersons"][0], "salesperson_id", "left").join(loaded["regions"][0], "region_id", "left")
    return named.select("ref", F.col("salesperson").alias("seller"), "region")


# ---- pages of the canonical tables, by key ----
_PAGES = {
    "customers": (canonical.CUSTOMERS, "customer", "c_custkey", {"name": "c_name", "segment": "c_mktsegment"}),
    "products": (canonical.PRODUCTS, "part", "p_partkey", {"name": "p_name", "category": "p_brand"}),
    "salespersons": (canonical.SALESPERSONS, "supplier", "s_suppkey", {"name": "s_name"}),
    "regions": (canonical.REGIONS, "region", "r_regionkey", {"name": "r_name"}),
    "orders": (canonical.ORDERS, "orders", "o_orderkey", {"ref": "'O' || cast(o_orderkey as string)"}),
}


def _page_query(kind: str) -> None:
    entity, table, key, columns = _PAGES[kind]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store, _, _ = canonical.load(demo.records(spark, sf_dir, "store", kind), canonical.empty_store(spark, entity), entity, demo.trust(spark))
        sought = reads.seekable(store, ["entity_id"], scratch(spark, kind))
        return reads.after(sought.select("entity_id", *columns), ["entity_id"], ["7"]).withColumn("total", F.lit(sought.count()).cast("long"))

    run.__name__ = f"{kind}_page"
    run.__doc__ = "The page of rows whose ids follow a given one, and how many rows there are."
    query(f"with t as (select sha256('{kind}/store/' || cast({key} as string)) as entity_id, {', '.join(f'{e} as {c}' for c, e in columns.items())}, count(*) over () as total from {table}) select * from t where entity_id > '7' order by entity_id limit 20")(run)


for _kind in _PAGES:
    _page_query(_kind)


@query(
    """with t as (select sha256('orders/store/' || cast(o_orderkey as string)) as order_id, sha256('products/store/' || cast(p_partkey as string)) as product_id, o_orderkey as row_number, cast(o_orderkey % 7 + 1 as int) as quantity, count(*) over () as total
    from orders join part on p_partkey = o_orderkey % 200 + 1) select * from t where order_id >= '7' and (order_id > '7' or row_number > 0) order by order_id, row_number limit 20"""
)
def order_line_items_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of line items that follow a given order and row: each record has one, with its order and its product."""
    orders = demo.records(spark, sf_dir, "store", "orders")
    trust = demo.trust(spark)
    _, _, order_ids = canonical.load(orders, canonical.empty_store(spark, canonical.ORDERS), canonical.ORDERS, trust)
    _, _, parts = canonical.load(demo.records(spark, sf_dir, "store", "products"), canonical.empty_store(spark, canonical.PRODUCTS), canonical.PRODUCTS, trust)
    product_ids = orders.select("source", "row_number", (F.col("row_number") % 200 + 1).alias("k")).join(parts.select(F.col("row_number").alias("k"), "entity_id"), "k").select("source", "row_number", "entity_id")
    records = orders.withColumn("fields", F.create_map(F.lit("quantity"), (F.col("row_number") % 7 + 1).cast("string")))
    items = canonical.line_items(records, order_ids, product_ids)
    sought = reads.seekable(items.select("order_id", "product_id", "row_number", "quantity"), ["order_id", "row_number"], scratch(spark, "items"))
    return reads.after(sought, ["order_id", "row_number"], ["7", 0]).withColumn("total", F.lit(sought.count()).cast("long"))


# ---- summaries that follow changes ----
@query(f"{_CONFLICTS} select source_id, 'open_conflicts' as kind, '' as key, count(*) as n from (select unnest([source_a, source_b]) as source_id from conflicts where status = 'OPEN' and entity = 'customers' and value_a <> 'BUILDING') group by all")
def maintained_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open conflicts of each source after three loads, each adding what it found, and after some were resolved."""
    summary = Summaries(spark, scratch(spark, "summaries"))
    store, found = canonical.empty_store(spark, canonical.CUSTOMERS), []
    for source in _ALL:
        store, conflicts, _ = canonical.load(demo.records(spark, sf_dir, source, "customers"), store, canonical.CUSTOMERS, demo.trust(spark))
        store, conflicts = cut(store), cut(conflicts)
        summary.apply(of_conflicts(conflicts))
        found.append(conflicts)
    settled = found[-1].where("value_a = 'BUILDING'")
    summary.apply(of_conflicts(settled, -1))
    return summary.read()


# ---- canonical tables in the catalog ----
@query(
    """with v as (select 'name' as field, false as extra, count(*) as n from customer union all select 'tier', true, count(*) from customer where c_custkey % 4 <> 0),
    phases as (select * from (values (0, false), (1, true), (2, false)) t(phase, has))
    select phase, field, extra and not has as extra, case when field = 'tier' and has then n else n end as n from v, phases"""
)
def promoted_in_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How values of two fields are taken while the catalog lacks a column for one, after it was promoted, and after it was demoted."""
    catalog = Catalog(spark, f"canonical_{uuid.uuid4().hex[:12]}", scratch(spark, "catalog"))
    catalog.create(canonical.CUSTOMERS)
    flat = demo.table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name as name", "case when c_custkey % 4 <> 0 then cast(c_custkey % 5 as string) end as tier")
    staged = stage(flat, ["name", "tier"], F.lit("crm"), F.lit("job-1"), F.col("c_custkey"))
    maps = spark.createDataFrame([("crm", f, "customers", f, "AUTO_CONFIRMED") for f in ("name", "tier")], "source_id string, field string, entity string, target string, status string")
    out = None
    for phase, step in enumerate((lambda: None, lambda: catalog.promote("customers", "tier", "INTEGER"), lambda: catalog.demote("customers", "tier"))):
        step()
        long = mapping.transform_long(staged, maps, catalog.known())
        told = cut(long.groupBy("field", "extra").agg(F.count("value").alias("n")).select(F.lit(phase).alias("phase"), "field", "extra", "n"))
        out = told if out is None else out.unionByName(told)
    spark.sql(f"DROP DATABASE {catalog.database} CASCADE")
    return out


# ---- the register of sources, the list of jobs ----
@query("select 'n' || cast(n_nationkey as string) as source_id, n_name as name, case n_nationkey % 3 when 0 then 'CSV_FILE' when 1 then 'JDBC_POSTGRES' else 'KAFKA_STREAM' end as source_type, cast(0.5 + n_nationkey % 5 / 10.0 as double) as trust from nation where n_regionkey = 1 order by n_nationkey limit 3")
def sources_of_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source for each nation, registered by the user with the region's number; the first page of one user's."""
    sources = Sources(spark, scratch(spark, "sources"))
    nations = demo.table(spark, sf_dir, "nation")
    kind = F.expr("case n_nationkey % 3 when 0 then 'CSV_FILE' when 1 then 'JDBC_POSTGRES' else 'KAFKA_STREAM' end")
    made = F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, n_nationkey)")
    rows = nations.select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("source_id"), F.col("n_name").alias("name"), kind.alias("source_type"), F.expr("0.5 + n_nationkey % 5 / 10.0").alias("trust"), F.lit(True).alias("active"), F.create_map(F.lit("query"), F.lit("select 1")).alias("config"), F.col("n_regionkey").alias("created_by"), made.alias("created_at")
    )
    sources.create(rows)
    return _doubles(reads.page(sources.of_user(1), ["created_at", "source_id"], size=3), "trust").select("source_id", "name", "source_type", "trust")


@query(f"{SCORES} select job_id, source_id, total_records as read_records, 'COMPLETED' as status, grade from scores order by job_id desc, source_id limit 5")
def jobs_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of all jobs, newest first."""
    judged = quality.judge(demo.sales(spark, sf_dir), demo.AS_OF)
    issues = quality.issues(judged)
    counted = quality.pass_fail(judged, issues).withColumnRenamed("total_records", "read_records")
    listed = jobs(counted, quality.scores(judged, issues))
    return reads.page(listed, [F.desc("job_id"), "source_id"], size=5).select("job_id", "source_id", "read_records", "status", "grade")


# ---- sources, samples, reviews ----
_CSV_JSON = """'{"key":"' || cast(c_custkey as string) || '","name":"' || c_name || ', of ' || cast(c_nationkey as string) || '","segment":' || case when c_custkey % 5 = 0 then 'null' else '"' || c_mktsegment || '"' end || '}'"""


@query(f"select 'upload' as source_id, 'job-1' as job_id, sha256({_CSV_JSON}) as record_hash, (select count(*) from customer) as numbers from customer")
def staged_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as CSV files, staged, appended to the staging table and read from there; how many row numbers there are."""
    flat = demo.table(spark, sf_dir, "customer").selectExpr("c_custkey as key", "c_name || ', of ' || cast(c_nationkey as string) as name", "case when c_custkey % 5 <> 0 then c_mktsegment end as segment")
    at = scratch(spark, "upload")
    flat.write.option("header", True).csv(f"{at}/customers.csv")
    write_staged(read_csv(spark, f"{at}/customers.csv", "upload", "job-1"), f"{at}/staging")
    staged = spark.read.parquet(f"{at}/staging")
    numbers = staged.agg(F.count_distinct("row_number").alias("numbers"))
    return staged.select("source_id", "job_id", "record_hash").crossJoin(F.broadcast(numbers))


_SYNCED = "case when n_nationkey % 4 <> 0 then timestamp '2024-01-09 20:15:00' + interval '1 hour' * n_nationkey end"
_CRON_BASE = f"coalesce({_SYNCED}, timestamp '2024-01-08 03:00:00')"


@query(
    f"""with wanted as (select 'n' || cast(n_nationkey as string) as source_id, n_nationkey as k, {_CRON_BASE} as base from nation where n_nationkey % 5 <> 0 and n_nationkey % 7 <> 0 and n_nationkey % 11 <> 0 and n_nationkey % 3 <> 2),
    runs as (select source_id, case when k % 3 = 0 then date_trunc('day', base) + interval '3 hours' + case when base >= date_trunc('day', base) + interval '3 hours' then interval '1 day' else interval '0 day' end
    else date_trunc('hour', base) + interval '30 minutes' + case when base >= date_trunc('hour', base) + interval '30 minutes' then interval '1 hour' else interval '0 hour' end end as next_run from wanted)
    select source_id, strftime(next_run, '%Y-%m-%d %H:%M:%S') as next_run from runs where next_run < timestamp '2024-01-10 12:00:00'"""
)
def due_jdbc_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source for each nation: daily at three, hourly at half past or a bad expression; some of another type, idle or running."""
    sources = demo.table(spark, sf_dir, "nation").selectExpr(
        "'n' || cast(n_nationkey as string) as source_id",
        "case when n_nationkey % 5 = 0 then 'CSV' else 'JDBC' end as source_type",
        "n_nationkey % 7 <> 0 as active",
        "n_nationkey % 11 = 0 as running",
        "case n_nationkey % 3 when 0 then '0 0 3 * * *' when 1 then '0 30 * * * *' else 'every hour' end as cron_expression",
        f"{_SYNCED} as last_sync_at",
        "timestamp '2024-01-08 03:00:00' as created_at",
    )
    return due_sources(sources, "2024-01-10 12:00:00").withColumn("next_run", F.date_format("next_run", "yyyy-MM-dd HH:mm:ss"))


_POSITIONS = ", ".join(f"('{f}', {i})" for i, f in enumerate(demo.FIELDS))


@query(
    f"""{_CELLS} select source_id, job_id, cells.field, count(*) as total, count(*) - count(v) as null_count, min(row_number) as first_row, any_value(pos) as first_pos
    from cells join (values {_POSITIONS}) t(field, pos) on cells.field = t.field where row_number <= 500 group by all"""
)
def sampled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields as inference by the first 500 rows of a job finds them, with where each was first seen."""
    found = profiling.null_rates(demo.sales(spark, sf_dir), 500)
    return found.select("source_id", "job_id", "field", "total", "null_count", F.col("seen.row_number").alias("first_row"), F.col("seen.pos").alias("first_pos"))


_FLAG = "case when event_type = 'error' and event_id % 10 = 0 then 'yes' when event_id % 2 = 0 then 'TRUE' else 'false' end"
_INSTANT = "cast(year(ts) as string) || '-' || lpad(cast(month(ts) as string), 2, '0') || '-' || lpad(cast(day(ts) as string), 2, '0') || 'T' || lpad(cast(hour(ts) as string), 2, '0') || ':30' || case event_type when 'click' then '' when 'view' then ':05Z' when 'purchase' then ':05.250+02:00' else ':05 UTC' end"


@query(
    f"""with v as (select event_type as source_id, 'flag' as field, {_FLAG} as v from events union all select event_type, 'at', {_INSTANT} from events)
    select source_id, field, count(distinct v) as distinct_count, case when bool_and(lower(v) in ('true', 'false')) then 'BOOLEAN' when bool_and(regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}(\\.[0-9]+)?)?(Z|[+-][0-9]{{2}}:[0-9]{{2}})?')) then 'DATETIME'
    when count(distinct v) < 20 then 'CATEGORY' else 'FREE_TEXT' end as inferred_type from v group by all"""
)
def flags_and_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.table(spark, sf_dir, "events").select("event_type", "event_id", F.expr(_FLAG).alias("flag"), F.expr(_INSTANT).alias("at"))
    staged = stage(rows, ["flag", "at"], F.col("event_type"), F.lit("job-1"), F.col("event_id"))
    return profiling.types(profiling.values(staged)).select("source_id", "field", "distinct_count", "inferred_type")


@query(f"{ISSUES}, bad as (select distinct {_K} from issues where severity = 'CRITICAL') select {_K}, record_hash from hashed anti join bad using ({_K})")
def accepted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(demo.sales(spark, sf_dir), demo.AS_OF, dimensions={"COMPLETENESS"})
    return quality.accepted(judged, quality.issues(judged, {"COMPLETENESS"})).select("source_id", "job_id", "row_number", "record_hash")


@query(f"{ISSUES} select {_K}, rule, case when source_id = 'web' and rule = 'VALIDITY_DATE_FORMAT' then 'ACKNOWLEDGED' else 'OPEN' end as status from issues")
def acknowledged_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, keys = _issues(spark, sf_dir), ["source_id", "job_id", "row_number", "rule"]
    return reads.acknowledge(found, found.where("source_id = 'web' AND rule = 'VALIDITY_DATE_FORMAT'"), keys).select(*keys, "status")


@query(f"{SCORES} select source_id, job_id, cast(overall as double) as overall from scores qualify row_number() over (partition by source_id order by job_id desc) <= 3")
def newest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(reads.latest(_scores(spark, sf_dir), ["source_id"], "job_id", 3).select("source_id", "job_id", "overall"), "overall")


@query(
    f"""{MAPPED} select source_id, field, case when field = 'City' then 'regions' else entity end as entity, case when field = 'City' then 'name' else target end as target, confidence,
    case when field in ('City', 'shipping_cost_fee') then 'AUTO_CONFIRMED' when field = 'State' then 'IGNORED' else status end as status from mapped"""
)
def mapping_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mapping confirmed, one redirected, one ignored by hand."""
    out = mapping.override(mapping.map_fields(_fields(spark, sf_dir), mapping.registry(spark)), "shop", "shipping_cost_fee")
    out = mapping.override(out, "crm", "City", "regions", "name")
    return _doubles(mapping.override(out, "crm", "State", status="IGNORED"), "confidence")


@query(
    f"""{MAPPED}, hints as (select * from (values ('Postal Code', 'customers', 'segment', 0.9), ('City', 'regions', 'nowhere', 0.99), ('Ship Mode', 'orders', 'status', 0.5)) t(field, he, ht, hc)),
    surer as (select m.field, he, ht, hc from mapped m join hints h on m.field = h.field and exists (select 1 from targets where entity = he and target = ht) and hc > m.confidence)
    select m.source_id, m.field, coalesce(he, entity) as entity, coalesce(ht, target) as target, cast(coalesce(hc, confidence) as double) as confidence, case when hc >= 0.8 then 'AUTO_CONFIRMED' when hc >= 0.55 then 'PENDING' else status end as status
    from mapped m left join surer s on m.field = s.field"""
)
def advised_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An advisor's suggestions: one surer than the heuristic, one without a target, one less sure. It fails once and is asked again."""
    failures = iter([True])

    def advise(fields: DataFrame) -> DataFrame:
        if next(failures, False):
            raise TimeoutError("no answer")
        hints = [("Postal Code", "customers", "segment", 0.9), ("City", "regions", "nowhere", 0.99), ("Ship Mode", "orders", "status", 0.5)]
        return fields.join(spark.createDataFrame(hints, "field string, entity string, target string, confidence double"), "field").select("source_id", "field", "entity", "target", "confidence")

    return _doubles(mapping.map_fields(_fields(spark, sf_dir), mapping.registry(spark), advisor=mapping.retried(advise)), "confidence")


_NARROW = {"customers": ["name", "email"], "orders": ["order_date"]}


@query(f"{SALES}, long as ({_LONG}) select entity, field, entity || 's.' || field not in ({_sql_list([f'{e}.{f}' for e, fs in _NARROW.items() for f in fs])}) as extra, count(value) as n from long group by all")
def attributes_without_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped values where the entities have few columns: the others become additional attributes."""
    return mapping.transform_long(demo.sales(spark, sf_dir), _maps(spark), _NARROW).groupBy("entity", "field", "extra").agg(F.count("value").alias("n"))


# ---- statistical drift: each day of events is a batch, each type a source ----
_NULLS = "case when value < 20 and day(ts) >= 28 and event_type = 'click' then null when value < 5 then null else value end"
_PROFILES = f"""with e as (select event_type as source_id, day(ts) as batch, {_NULLS} as v, cast(user_id % 20 + case when day(ts) >= 30 and event_type = 'view' then 1000 else 0 end as string) as u from events),
profiles as (select source_id, batch, 'value' as field, floor((count(*) - count(v)) * 10000.0 / count(*) + 0.5) / 10000.0 as null_rate, cast(cast(floor(min(v)) as bigint) as string) as min_value,
cast(cast(floor(max(v)) as bigint) * max(case when batch >= 30 and source_id = 'signup' then 50 else 1 end) as string) as max_value from e group by source_id, batch),
users as (select source_id, batch, u, count(*) as n from e group by all),
tops as (select source_id, batch, list(u) as top_values from (select *, row_number() over (partition by source_id, batch order by n desc, u) as r from users) where r <= 10 group by all),
aged as (select p.*, t.top_values, dense_rank() over (partition by p.source_id order by p.batch desc) as age from profiles p join tops t on p.source_id = t.source_id and p.batch = t.batch),
cur as (select * from aged where age = 1), past as (select * from aged where age in (2, 3)),
hist as (select source_id, floor(avg(null_rate) * 10000 + 0.5 + 1e-7) / 10000.0 as usual, list_distinct(flatten(list(top_values))) as known from past group by all having count(*) = 2),
spread as (select source_id, avg(x) as m, stddev_pop(x) as sd from (select source_id, cast(min_value as double) as x from past union all select source_id, cast(max_value as double) from past) group by all)"""


@query(
    f"""{_PROFILES} select source_id, field, 'COMPLETENESS_NULL_RATE_DRIFT' as rule from cur join hist using (source_id) where abs(null_rate - usual) > 0.20
    union all select source_id, field, 'VALIDITY_VALUE_DISTRIBUTION_DRIFT' from cur join hist using (source_id) where len(list_filter(top_values, lambda x: not list_contains(known, x))) > 0.5 * len(top_values)
    union all select source_id, field, 'ACCURACY_RANGE_EXPANSION_DRIFT' from cur join hist using (source_id) join spread using (source_id) where sd <> 0 and (cast(min_value as double) < m - 3 * sd or cast(max_value as double) > m + 3 * sd)"""
)
def profile_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = demo.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source_id"), F.dayofmonth("ts").alias("batch"), F.expr(_NULLS).alias("v"), F.expr("cast(user_id % 20 + case when day(ts) >= 30 and event_type = 'view' then 1000 else 0 end as string)").alias("u")
    )
    wide = F.when((F.col("batch") >= 30) & (F.col("source_id") == "signup"), 50).otherwise(1)
    base = e.groupBy("source_id", "batch").agg(
        F.round((F.count(F.lit(1)) - F.count("v")).cast("decimal(20,0)") / F.count(F.lit(1)).cast("decimal(20,0)"), 4).cast("decimal(5,4)").alias("null_rate"), F.floor(F.min("v")).cast("string").alias("min_value"), F.floor(F.max("v")).alias("top")
    )
    w = Window.partitionBy("source_id", "batch").orderBy(F.desc("n"), "u")
    tops = e.groupBy("source_id", "batch", "u").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(w)).where("r <= 10").groupBy("source_id", "batch").agg(F.collect_list("u").alias("top_values"))
    profiles = base.join(tops, ["source_id", "batch"]).select("source_id", "batch", F.lit("value").alias("field"), "null_rate", "min_value", (F.col("top") * wide).cast("string").alias("max_value"), "top_values")
    return profiling.profile_drift(profiles).select("source_id", "field", "rule")


# ---- live path ----
_E = demo.EVENT_FIELDS
_LIVE = f"""with raw as (select *, 0 as copy from events union all select *, 1 from events where event_id % 67 = 0),
live as (select event_id as id, ts, event_id % 71 = 0 as broken, {_E['event_id']} as event_id, {_E['source_system']} as source_system, {_E['event_time']} as event_time, event_type as kind from raw),
judged as (select *, case when broken then 'not a JSON object' when event_id is null then 'missing event_id' when event_time = 'not-a-date' then 'event_time is not an instant' when source_system = 'legacy' then 'unknown source system' end as error,
case when source_system = 'pos' then 'store' else 'web' end as source_id from live)"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.resolve_sources(live.parse(demo.live_values(spark, sf_dir)), demo.live_sources(spark))


@query(f"{_LIVE} select distinct source_id, event_id, sha256('{{\"event_id\":\"' || event_id || '\",\"source_system\":\"' || source_system || '\",\"event_time\":\"' || event_time || '\",\"kind\":\"' || kind || '\"}}') as record_hash from judged where error is null")
def stream_valid_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.fresh(live.valid(_resolved(spark, sf_dir)), None).select("source_id", F.col("payload")["event_id"].alias("event_id"), "record_hash")


@query(f"{_LIVE} select distinct source_id, event_id from judged where error is null and id % 4 = 3")
def unseen_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three quarters of the events are staged and in the index, in two windows; of all that come again, those that are new."""
    index = Seen(spark, scratch(spark, "seen"))
    rows = written(live.valid(_resolved(spark, sf_dir)).select("source_id", "record_hash", F.col("payload")["event_id"].alias("event_id")), "events")
    for batch, part in enumerate(("event_id % 4 < 2", "event_id % 4 <= 2")):
        index.add(index.fresh(rows.where(part), batch), batch)
        if batch == 0:
            index.compact(batch)
    return index.fresh(rows, 2).select("source_id", "event_id")


@query(f"{_LIVE}, kept as (select distinct source_id, event_id, event_time, kind, source_system from judged where error is null) select count(*) as read, (select count(*) from kept) as staged, count(*) filter (where error is null) - (select count(*) from kept) as repeated, count(error) as dead, count(*) filter (where error = 'unknown source system') as unknown from judged")
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = _resolved(spark, sf_dir)
    return live.metrics(resolved, live.fresh(live.valid(resolved), None)).select("read", "staged", "repeated", "dead", "unknown")


@query(f"{_LIVE} select error, count(*) as n from judged where error is not null group by all")
def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.dead_letters(_resolved(spark, sf_dir)).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_LIVE} select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as window_start, source_id, count(*) as n from (select distinct id, ts, source_id from judged where error is null) group by all")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live.fresh(live.valid(_resolved(spark, sf_dir)), None)
    counts = live.window_counts(rows, F.col("payload")["event_time"].cast("timestamp"))
    return counts.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(
    """select o_orderkey as order_id, count(*) as n_lines, cast(round(sum(l_extendedprice) * 100) as bigint) as lines_cents from orders join lineitem on o_orderkey = l_orderkey
    group by o_orderkey, o_totalprice having abs(cast(round(o_totalprice * 100) as bigint) - cast(round(sum(l_extendedprice) * 100) as bigint)) > 1"""
)
def order_total_vs_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = lambda c: F.round(c * 100).cast("bigint")
    orders = demo.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), (money(F.col("o_totalprice")) / 100).cast("decimal(20,2)").alias("total_amount"))
    lines = demo.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_extendedprice").cast("decimal(20,2)").alias("line_total"))
    out = reads.order_totals(orders, lines)
    return out.select("order_id", "n_lines", (F.col("lines_total") * 100).cast("bigint").alias("lines_cents"))
