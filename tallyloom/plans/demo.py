"""Messy multi-source sales data made from the clean test tables, in SQL that Spark and DuckDB read alike.

Values are damaged by rules on keys, so every run has the same rows on any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.staging import stage

AS_OF = "2001-08-01"
TRUST = {"store": "0.90", "web": "0.60", "partner": "0.80"}

_DAY = "lpad(cast(day(o_orderdate) as string), 2, '0')"
_MONTH = "lpad(cast(month(o_orderdate) as string), 2, '0')"
_YEAR = "cast(year(o_orderdate) as string)"
_CENTS = "cast(round(o_totalprice * 100) as bigint)"


ISO_DATE = f"({_YEAR} || '-' || {_MONTH} || '-' || {_DAY})"


def money(cents: str) -> str:
    return f"(cast(cast(floor(({cents}) / 100) as bigint) as string) || '.' || lpad(cast(({cents}) % 100 as string), 2, '0'))"


_UNIT = "((o_orderkey % 50 + 1) * 100 + 50)"
_LINE = f"({_UNIT} * (o_orderkey % 7 + 1) + case when o_orderkey % 13 = 0 then 500 else 0 end)"

#: Fields of a sales record in payload order.
FIELDS = {
    "customer_name": "case when o_orderkey % 17 = 0 then null else c_name end",
    "email": "case when o_orderkey % 19 = 0 then 'bad email' else 'c' || cast(c_custkey as string) || '@example.com' end",
    "segment": "c_mktsegment",
    "sku": "case when o_orderkey % 37 = 0 then null else 'P' || cast(o_orderkey % 200 as string) end",
    "order_date": f"case when o_orderkey % 41 = 0 then 'not-a-date' when o_orderkey % 43 = 0 then {_DAY} || '-' || {_MONTH} || '-' || {_YEAR} when o_orderkey % 47 = 0 then '2001-09-15' else {_YEAR} || '-' || {_MONTH} || '-' || {_DAY} end",
    "total_amount": f"case when o_orderkey % 23 = 0 then '-' || {money(_CENTS)} when o_orderkey % 29 = 0 then 'abc' else {money(_CENTS)} end",
    "quantity": "cast(o_orderkey % 7 + 1 as string)",
    "unit_price": money(_UNIT),
    "line_total": money(_LINE),
    "Ship Mode": "case o_orderkey % 3 when 0 then 'Standard Class' when 1 then 'First Class' else 'Second Class' end",
    "currency": "case when o_orderkey % 31 = 0 then 'XYZ' else 'USD' end",
    "country": "case when o_orderkey % 27 = 0 then 'Atlantis' else n_name end",
}
SOURCE = "case when o_orderkey % 2 = 0 then 'store' else 'web' end"
#: Some records come twice.
SALES_SQL = f"""
select {SOURCE} as source_id, 'job-' || {_YEAR} as job_id, o_orderkey + copy * 10000000000 as row_number,
{", ".join(f'{v} as "{k}"' for k, v in FIELDS.items())}
from (select *, 0 as copy from orders union all select *, 1 as copy from orders where o_orderkey % 101 = 0) o
join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messy sales records as a flat table."""
    orders = table(spark, sf_dir, "orders")
    copies = F.when(F.col("o_orderkey") % 101 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = orders.withColumn("copy", F.explode(copies))
    rows = rows.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.expr(SOURCE).alias("source_id"), F.expr(f"'job-' || {_YEAR}").alias("job_id"), F.expr("o_orderkey + copy * 10000000000").alias("row_number"), *[F.expr(v).alias(k) for k, v in FIELDS.items()]
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messy sales records, staged."""
    return stage(sales_flat(spark, sf_dir), list(FIELDS), F.col("source_id"), F.col("job_id"), F.col("row_number"))


def trust(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in TRUST.items()], "source_id string, trust string").withColumn("trust", F.col("trust").cast("decimal(3,2)"))


#: Three sources of customers: all from the store, some again from the others with changes.
CUSTOMER_FIELDS = {
    "store": ("true", {"name": "c_name", "email": "case when c_custkey % 9 = 0 then null else 'c' || cast(c_custkey as string) || '@example.com' end", "phone": "'555-' || cast(c_custkey as string)", "segment": "c_mktsegment"}),
    "web": ("c_custkey % 2 = 0", {"name": "c_name", "email": "case when c_custkey % 9 = 0 then null else 'c' || cast(c_custkey as string) || '@example.com' end", "phone": "case when c_custkey % 9 = 0 then '555-' || cast(c_custkey as string) end", "segment": "case when c_custkey % 5 = 0 then 'CORPORATE' else c_mktsegment end"}),
    "partner": ("c_custkey % 3 = 0", {"name": "c_name", "email": "case when c_custkey % 9 = 0 then null else 'c' || cast(c_custkey as string) || '@example.com' end", "phone": "'555-' || cast(c_custkey as string)", "segment": "case when c_custkey % 7 = 0 then null when c_custkey % 4 = 0 then 'PUBLIC' else c_mktsegment end"}),
}
#: Products: prices of the web 2 % or 0.5 % higher for some, categories of the partner unlike.
_PRICE = "cast(round(p_retailprice * 100) as bigint)"
PRODUCT_FIELDS = {
    "store": ("true", {"sku": "'P' || cast(p_partkey as string)", "name": "p_name", "category": "p_brand", "sub_category": "p_type", "unit_price": money(_PRICE)}),
    "web": ("true", {"sku": "'P' || cast(p_partkey as string)", "name": "p_name", "category": "p_brand", "sub_category": "p_type", "unit_price": money(f"case when p_partkey % 7 = 0 then cast(floor({_PRICE} * 102 / 100) as bigint) when p_partkey % 11 = 0 then cast(floor({_PRICE} * 1005 / 1000) as bigint) else {_PRICE} end")}),
    "partner": ("p_partkey % 2 = 0", {"sku": "'P' || cast(p_partkey as string)", "name": "p_name", "category": "case when p_partkey % 6 = 0 then 'OTHER' else p_brand end", "sub_category": "case when p_partkey % 10 = 0 then 'MISC' else p_type end", "unit_price": "null"}),
}
#: Orders: those of the web have no references, totals one cent or one unit off for some, and other ship modes.
ORDER_FIELDS = {
    "web": ("true", {"order_date": f"{_YEAR} || '-' || {_MONTH} || '-' || {_DAY}", "total_amount": money(f"{_CENTS} + case when o_orderkey % 7 = 0 then 100 when o_orderkey % 5 = 0 then 1 else 0 end"), "ship_mode": "case when o_orderkey % 11 = 0 then null when o_orderkey % 3 = 0 then 'RAIL' when o_orderkey % 2 = 0 then 'AIR' else 'SHIP' end"}),
    "store": ("true", {"external_ref": "'O' || cast(o_orderkey as string)", "order_date": f"{_YEAR} || '-' || {_MONTH} || '-' || {_DAY}", "total_amount": money(_CENTS), "ship_mode": "case when o_orderkey % 2 = 0 then 'AIR' else 'SHIP' end", "currency": "'USD'"}),
}


#: Salespersons and regions: all of the store, again from the web with some changes.
SELLER_FIELDS = {
    "store": ("true", {"name": "s_name", "email": "'s' || cast(s_suppkey as string) || '@example.com'", "territory": "'T' || cast(s_nationkey as string)", "grade": "cast(s_suppkey % 3 as string)"}),
    "web": ("s_suppkey % 2 = 0", {"name": "case when s_suppkey % 8 = 0 then null else s_name end", "email": "'s' || cast(s_suppkey as string) || '@example.com'", "territory": "case when s_suppkey % 6 = 0 then 'T99' else 'T' || cast(s_nationkey as string) end", "active": "case when s_suppkey % 10 = 0 then 'false' end"}),
}
REGION_FIELDS = {
    "store": ("true", {"name": "r_name", "country": "'C' || cast(r_regionkey as string)"}),
    "web": ("r_regionkey % 2 = 0", {"name": "r_name", "country": "case when r_regionkey = 0 then null else 'W' || cast(r_regionkey as string) end", "zone": "'Z'"}),
}
_KINDS = {"customers": ("customer", "c_custkey", CUSTOMER_FIELDS), "products": ("part", "p_partkey", PRODUCT_FIELDS), "orders": ("orders", "o_orderkey", ORDER_FIELDS), "salespersons": ("supplier", "s_suppkey", SELLER_FIELDS), "regions": ("region", "r_regionkey", REGION_FIELDS)}


def records(spark: SparkSession, sf_dir: str, source: str, kind: str) -> DataFrame:
    """Records (source, row_number, fields) of a source's entities of a kind."""
    name, key, spec = _KINDS[kind]
    where, fields = spec[source]
    payload = F.create_map(*[x for f, e in fields.items() for x in (F.lit(f), F.expr(e).cast("string"))])
    return table(spark, sf_dir, name).where(where).select(F.lit(source).alias("source"), F.col(key).alias("row_number"), payload.alias("fields"))


def flat_sql(source: str, kind: str) -> str:
    name, key, spec = _KINDS[kind]
    where, fields = spec[source]
    return f"(select {key} as k, {', '.join(f'{e} as {f}' for f, e in fields.items())} from {name} where {where})"


#: Live events from the events table: some broken, some repeated, some of an unknown system.
EVENT_FIELDS = {
    "event_id": "case when event_id % 53 = 0 then null else cast(event_id as string) end",
    "source_system": "case when event_id % 59 = 0 then 'legacy' when event_id % 2 = 0 then 'pos' else 'shop' end",
    "event_time": "case when event_id % 61 = 0 then 'not-a-date' else lpad(cast(year(ts) as string), 4, '0') || '-' || lpad(cast(month(ts) as string), 2, '0') || '-' || lpad(cast(day(ts) as string), 2, '0') || 'T' || lpad(cast(hour(ts) as string), 2, '0') || ':' || lpad(cast(minute(ts) as string), 2, '0') || ':00Z' end",
    "kind": "event_type",
}


def live_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as the topic would hold them; every 67th comes twice, every 71st is no JSON."""
    rows = table(spark, sf_dir, "events")
    copies = F.when(F.col("event_id") % 67 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    body = F.to_json(F.create_map(*[x for f, e in EVENT_FIELDS.items() for x in (F.lit(f), F.expr(e))]))
    return rows.withColumn("copy", F.explode(copies)).select(F.when(F.col("event_id") % 71 == 0, F.concat(F.lit("broken "), F.col("event_id").cast("string"))).otherwise(body).alias("value"))


def live_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("store", ["pos"]), ("web", ["shop", "app"])], "source_id string, source_systems array<string>")
