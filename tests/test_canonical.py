import random

from pyspark.sql import functions as F

from tallyloom.operators import canonical, conflict, evolve, mapping, reads
from tallyloom.plans.queries import QUERIES
from tests.conftest import SF
from tests.test_quality import payloads


def recs(spark, source, rows):
    df = spark.createDataFrame([(source, i, list(p.items())) for i, p in enumerate(rows, 1)], "source string, row_number long, e array<struct<k:string,v:string>>")
    return df.select("source", "row_number", F.map_from_entries("e").alias("fields"))


def trust(spark, **t):
    return spark.createDataFrame(list(t.items()), "source_id string, trust string").withColumn("trust", F.col("trust").cast("decimal(3,2)"))


def load(spark, entity, *jobs, **t):
    store, found = canonical.empty_store(spark, entity), None
    for source, rows in jobs:
        store, found, _ = canonical.load(recs(spark, source, rows), store, entity, trust(spark, **(t or {"A": "0.9", "B": "0.6"})))
        store = store.checkpoint()
    return store, found


def test_two_sources_conflict(spark):
    john = {"name": "John Doe", "email": "john@test.com", "segment": "Consumer"}
    store, found = load(spark, canonical.CUSTOMERS, ("A", [john]), ("B", [john | {"segment": "Corporate"}]))
    row = store.first()
    assert store.count() == 1 and row["segment"] == "Corporate" and row["has_conflicts"] and row["source"] == "A"
    c = found.first()
    assert (c["field"], c["value_a"], c["value_b"], c["strategy"], c["status"]) == ("segment", "Consumer", "Corporate", "TRUST_HIERARCHY", "RESOLVED")


def strategy(spark, entity, a, b, **t):
    _, found = load(spark, entity, ("A", [a]), ("B", [b]), **t)
    return [(r["field"], r["strategy"]) for r in found.collect()]


def test_conflict_thresholds(spark):
    p = canonical.PRODUCTS
    assert strategy(spark, p, {"sku": "1", "unit_price": "100"}, {"sku": "1", "unit_price": "101"}) == []
    assert strategy(spark, p, {"sku": "1", "unit_price": "100"}, {"sku": "1", "unit_price": "102"}, A="0.8", B="0.6") == [("unit_price", "FLAGGED_FOR_REVIEW")]
    assert strategy(spark, p, {"sku": "1", "sub_category": "x"}, {"sku": "1", "sub_category": "y"}, A="0.8", B="0.9") == [("sub_category", "LATEST_WINS")]
    assert strategy(spark, p, {"sku": "1", "sub_category": "x"}, {"sku": "1"}, A="0.8", B="0.9") == []
    sides = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([("10.00", "10.01"), ("10.00", "10.02"), ("10.00", "9.98"), ("x", "x"), ("1", None)])], "entity_id long, a string, b string")
    one, two = (sides.select("entity_id", F.lit(k.upper()).alias("source"), F.col(k).alias("total_amount")) for k in "ab")
    assert sorted(r["entity_id"] for r in conflict.detect("orders", one, two, trust(spark, A="0.9", B="0.6")).collect()) == [1, 2]


def test_null_never_erases(spark):
    store, _ = load(spark, canonical.CUSTOMERS, ("A", [{"name": "a", "email": "e", "phone": "1"}]), ("A", [{"name": "b", "email": "e"}]))
    assert [(r["name"], r["phone"]) for r in store.collect()] == [("b", "1")]


def test_rows_without_keys_stay_apart(spark):
    store, _ = load(spark, canonical.CUSTOMERS, ("A", [{"name": "a"}, {"name": "a"}]))
    assert store.count() == 2


def test_cluster_follows_first_shared_key(spark):
    rng = random.Random(5)
    rows = [{"email": rng.choice([None, "e1", "e2", "e3", "e4"]), "name": rng.choice(["n1", "n2"]), "phone": rng.choice([None, "p1", "p2", "p3"])} for _ in range(60)]
    first = {}
    parent = []
    for i, r in enumerate(rows):
        keys = [("e", r["email"]) if r["email"] else None, ("np", r["name"], r["phone"]) if r["phone"] else None]
        hit = next((first[k] for k in keys if k in first), i)
        parent.append(parent[hit] if hit != i else i)
        for k in keys:
            if k:
                first.setdefault(k, i)
    df = canonical.keys_of(canonical.typed(recs(spark, "A", rows), canonical.CUSTOMERS), canonical.CUSTOMERS)
    got = {r["row_number"] - 1: r["first"] - 1 for r in canonical.cluster(df, canonical.CUSTOMERS).collect()}
    assert got == dict(enumerate(parent))


def test_winner_by_trust(spark):
    john = {"email": "e", "segment": "x"}
    first, _, _ = canonical.load(recs(spark, "A", [john]), canonical.empty_store(spark, canonical.CUSTOMERS), canonical.CUSTOMERS, trust(spark, A="0.9", B="0.6"))
    kept, _, _ = canonical.load(recs(spark, "B", [john | {"segment": "y"}]), first.checkpoint(), canonical.CUSTOMERS, trust(spark, A="0.9", B="0.6"), winner="trust")
    assert kept.first()["segment"] == "x"


def test_resolution_refuses_blanks(spark):
    store, found = load(spark, canonical.PRODUCTS, ("A", [{"sku": "1", "category": "x"}]), ("B", [{"sku": "1", "category": "y"}]), A="0.8", B="0.7")
    pick = lambda v: found.select("entity_id", "field", F.lit(v).alias("chosen"))
    after, done = conflict.resolve(found, store, pick("z"))
    assert done.first()["category"] == "z" and after.first()["status"] == "RESOLVED"
    try:
        conflict.resolve(found, store, pick(" "))
    except ValueError:
        return
    raise AssertionError


def test_transform_fixture(spark):
    st = payloads(spark, [{"Row ID": "1", "Sales": "123.45", "IgnoredCol": "foo", "PendingCol": "bar"}])
    maps = spark.createDataFrame(
        [("s", "Sales", "orders", "total_amount", "AUTO_CONFIRMED"), ("s", "Row ID", "customers", "name", "AUTO_CONFIRMED"), ("s", "PendingCol", "products", "sku", "PENDING"), ("s", "IgnoredCol", "", "", "IGNORED")],
        "source_id string, field string, entity string, target string, status string",
    )
    got = {r["entity"]: (r["fields"], r["additional_attributes"]) for r in mapping.entities(mapping.transform_long(st, maps)).collect()}
    assert got == {"order": ({"total_amount": "123.45"}, {}), "customer": ({"name": "1"}, {}), "product": ({}, {"sku": "bar"})}


def test_advisor_must_be_surer(spark):
    fields = spark.createDataFrame([("s", "Random Date Column", "DATE"), ("s", "Order Date", "DATE")], "source_id string, field string, inferred_type string")
    say = lambda df: df.selectExpr("source_id", "field", "'orders' entity", "'ship_date' target", "0.9 confidence")
    got = {r["field"]: (r["target"], float(r["confidence"])) for r in mapping.map_fields(fields, mapping.registry(spark), advisor=say).collect()}
    assert got == {"Random Date Column": ("ship_date", 0.9), "Order Date": ("order_date", 1.0)}


def test_promote_and_demote_are_inverse(spark):
    df = spark.createDataFrame([(1, {"tier": "3", "x": "y"}), (2, {})], "id int, additional_attributes map<string,string>")
    up = evolve.promote(df, "customers", "tier", "INTEGER")
    assert [(r["tier"], r["additional_attributes"]) for r in up.orderBy("id").collect()] == [(3, {"x": "y"}), (None, {})]
    assert [r["additional_attributes"] for r in evolve.demote(up, "customers", "tier").orderBy("id").collect()] == [{"x": "y", "tier": "3"}, {}]
    for bad in (("customers", "drop table"), ("users", "x")):
        try:
            evolve.promote(df, *bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_pages(spark):
    df = spark.range(45)
    assert [r["id"] for r in reads.page(df, ["id"], 2).collect()] == list(range(40, 45))


def test_attributes_scores_and_defaults(spark):
    def job(source, i, fields, extra, score):
        df = spark.createDataFrame([(source, i, list(fields.items()), list(extra.items()), score)], "source string, row_number long, f array<struct<k:string,v:string>>, a array<struct<k:string,v:string>>, quality_score double")
        return df.select("source", "row_number", F.map_from_entries("f").alias("fields"), F.map_from_entries("a").alias("additional_attributes"), "quality_score")

    e, t = canonical.SALESPERSONS, trust(spark, A="0.9")
    store, _, _ = canonical.load(job("A", 1, {"name": "Ann", "email": "a@x"}, {"tier": "1", "note": "n"}, 0.9), canonical.empty_store(spark, e), e, t)
    row = store.first()
    assert (row["active"], row["additional_attributes"], float(row["quality_score"]), row["ref"]) == (True, {"tier": "1", "note": "n"}, 0.9, "a@x")
    store, _, _ = canonical.load(job("A", 1, {"email": "a@x", "active": "false"}, {"tier": "2"}, 0.8), store.checkpoint(), e, t)
    row = store.first()
    assert store.count() == 1 and (row["name"], row["active"], row["additional_attributes"], float(row["quality_score"])) == ("Ann", False, {"tier": "2", "note": "n"}, 0.8)


def test_references_come_before_business_keys(spark):
    store, _ = load(spark, canonical.CUSTOMERS, ("A", [{"customer_code": "7", "email": "old@x", "name": "n"}]), ("A", [{"customer_code": "7", "email": "new@x"}, {"customer_id": "ignored", "email": "new@x", "name": "other"}]))
    assert sorted((r["email"], r["name"], r["ref"]) for r in store.collect()) == [("new@x", "n", "7"), ("new@x", "other", "new@x")]


def test_failing_advisor_is_asked_again(spark):
    asked = []

    def advisor(df):
        asked.append(1)
        if len(asked) < 3:
            raise RuntimeError("not now")
        return df.selectExpr("source_id", "field", "'orders' entity", "'ship_date' target", "0.9 confidence")

    fields = spark.createDataFrame([("s", "Random Date Column", "DATE")], "source_id string, field string, inferred_type string")
    pick = lambda: mapping.map_fields(fields, mapping.registry(spark), advisor=mapping.retried(advisor)).first()["target"]
    assert pick() == "ship_date" and len(asked) == 3
    assert mapping.map_fields(fields, mapping.registry(spark), advisor=mapping.retried(lambda df: 1 / 0)).first()["target"] == "order_date"


def test_orders_with_unlike_references_stay_apart(spark):
    at = {"order_date": "2024-01-02", "total_amount": "5.00"}
    orders = [at, at | {"external_ref": "1"}, at | {"external_ref": "2"}, at, at | {"external_ref": "1"}]
    store, _ = load(spark, canonical.ORDERS, ("A", orders))
    assert sorted(r["ref"] for r in store.collect()) == ["1", "2"]
    store, _ = load(spark, canonical.ORDERS, ("A", [at]), ("A", orders[1:]), ("A", [at | {"external_ref": "2"}, at | {"external_ref": "3"}, at]))
    assert sorted(r["ref"] for r in store.collect()) == ["1", "2", "3"]


def test_seeking_hashes_find_what_can_match(spark):
    at = {"order_date": "2024-01-02", "total_amount": "5.00"}
    hashes = lambda fields, **how: {r["hash"] for r in canonical.key_hashes(canonical.typed(recs(spark, "A", [fields]), canonical.ORDERS), canonical.ORDERS, **how).collect()}
    one, two = at | {"external_ref": "1"}, at | {"external_ref": "2"}
    meets = lambda a, b: bool(hashes(a) & hashes(b, stored=True))
    assert [meets(a, b) for a, b in ((one, one), (one, two), (one, at), (at, one), (at, at))] == [True, False, True, True, True]


def test_entities_within_a_record_need_no_shuffle(spark):
    st = payloads(spark, [{"Sales": "1", "Amount": "2", "Name": "n", "Other": None}, {"Other": None}, {"sales": "3", "AMOUNT": None}])
    maps = spark.createDataFrame(
        [("s", "Sales", "orders", "total_amount", "AUTO_CONFIRMED"), ("s", "amount", "orders", "total_amount", "AUTO_CONFIRMED"), ("s", "name", "customers", "name", "AUTO_CONFIRMED"), ("s", "other", "products", "sku", "PENDING")],
        "source_id string, field string, entity string, target string, status string",
    )
    own = mapping.record_entities(st, maps)
    told = lambda df: sorted((r["row_number"], r["entity"], r["fields"], r["additional_attributes"]) for r in df.collect())
    assert told(own) == told(mapping.entities(mapping.transform_long(st, maps)))


def test_conflicts_are_judged_where_the_rows_meet(spark):
    """One join of the two sides by entity, none by field, and none that sends all conflicts of a source to one task."""
    sides = [spark.createDataFrame([(str(i), s, "x", str(i % k)) for i in range(20)], "entity_id string, source string, segment string, email string") for s, k in (("A", 2), ("B", 3))]
    found = conflict.detect("customers", *sides, trust(spark, A="0.9", B="0.6"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 3 and plan.count("rightHint=(strategy=broadcast)") == 2
    assert sorted((int(r["entity_id"]), r["field"], r["value_a"], r["value_b"]) for r in found.collect()) == [(i, "email", str(i % 2), str(i % 3)) for i in range(20) if i % 2 != i % 3]


def test_rows_that_share_no_key_have_no_pointers(spark):
    rows = lambda *p: canonical.keys_of(canonical.typed(recs(spark, "A", p), canonical.CUSTOMERS), canonical.CUSTOMERS)
    assert canonical.pointers(rows({"email": "a"}, {"email": "b"}, {"name": "n"}), canonical.CUSTOMERS) is None
    chain = rows({"email": "a"}, {"email": "a", "name": "n", "phone": "1"}, {"name": "n", "phone": "1"}, {"email": "b"})
    assert sorted((r["row_number"], r["first"]) for r in canonical.pointers(chain, canonical.CUSTOMERS).collect()) == [(2, 1), (3, 1)]


def test_orders_of_one_day_and_total_with_unlike_references_need_no_merge(spark):
    at = {"order_date": "2024-01-02", "total_amount": "5.00"}
    rows = canonical.keys_of(canonical.typed(recs(spark, "A", [at | {"external_ref": str(i)} for i in range(3)]), canonical.ORDERS), canonical.ORDERS)
    assert canonical.pointers(rows, canonical.ORDERS) is None


def test_lines_are_not_moved_with_ids(spark):
    plan = QUERIES["canonical_line_items"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.splitlines() if "quantity#" in line or "fields#" in line]
    assert lines and not any(f"{name}_id#" in line for line in lines for name in ("entity", "order", "product"))
