"""Tables that outlive a job: changes of entities, history, summaries, registers, catalog; and how they are read."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import canonical, history, mapping, profiling, quality, reads
from tallyloom.operators.catalog import Catalog
from tallyloom.operators.history import History, after_job
from tallyloom.operators.register import SOURCES, Sources
from tallyloom.operators.summaries import Summaries
from tallyloom.operators.versions import Versions
from tallyloom.plans.pipeline import assess, run_job, versioned
from tallyloom.sources import staging
from tests.test_quality import payloads


def entities(spark, **rows):
    return spark.createDataFrame(list(rows.items()), "entity_id string, v string")


def merged(table, before=1 << 62):
    return {r["entity_id"]: r["v"] for r in table.read(before).collect()}


def test_changes_are_merged(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"), "entity_id string, v string", buckets=4)
    assert merged(table) == {}
    table.write(entities(spark, a="1", b="1", c="1"), 0)
    table.write(entities(spark, b="2", d="2"), 1)
    assert merged(table) == {"a": "1", "b": "2", "c": "1", "d": "2"} and merged(table, 1) == {"a": "1", "b": "1", "c": "1"}
    table.compact(1)
    table.write(entities(spark, a=None, e="3"), 2)
    now = {"a": None, "b": "2", "c": "1", "d": "2", "e": "3"}
    assert merged(table) == now and table.base(2) == 1
    # a window that runs again replaces its rows
    table.write(entities(spark, e="4"), 2)
    assert merged(table) == now | {"a": "1", "e": "4"}
    # a base that was not finished does not count
    entities(spark, z="9").withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{tmp_path}/t/base/upto=2")
    assert "z" not in merged(table) and table.base(9) == 1
    table.compact(2)
    assert merged(table) == now | {"a": "1", "e": "4"}


@pytest.mark.parametrize("keys", [None, lambda df: df.withColumn("hash", F.xxhash64("entity_id"))])
def test_window_that_runs_again_after_its_compaction(spark, tmp_path, keys):
    table = Versions(spark, str(tmp_path / "t"), "entity_id string, v string", buckets=2, keys=keys, parts=2)
    table.write(entities(spark, a="1", b="1"), 0)
    table.compact(0)
    for v in "23":
        table.write(entities(spark, b=v, c=v), 1)
        table.compact(1)
        assert merged(table) == {"a": "1", "b": v, "c": v} and merged(table, 1) == {"a": "1", "b": "1"}


def test_written_files_grow_with_the_changes(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"), "entity_id string, v string", buckets=4)
    size = lambda w: sum(f.stat().st_size for f in (tmp_path / f"t/changes/window={w}").rglob("*.parquet"))
    many = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("entity_id"), F.lit("v").alias("v"))
    table.write(many, 0)
    table.write(many.limit(20), 1)
    assert size(1) < size(0) / 50 and table.read().count() == 20_000


def test_rows_are_looked_up_by_key(spark, tmp_path):
    """Loads that look up what they can match give what loads of the whole table give, whatever keys changed or were compacted since."""
    trust = spark.createDataFrame([("a", "0.50"), ("b", "0.90")], "source_id string, trust string").withColumn("trust", F.col("trust").cast("decimal(3,2)"))
    entity = canonical.CUSTOMERS
    table, plain = versioned(spark, str(tmp_path / "t"))["customers"], versioned(spark, str(tmp_path / "p"))["customers"]

    def records(source, *rows):
        fields = [(source, n, {k: v for k, v in r.items() if v is not None}) for n, r in enumerate(rows, 1)]
        return spark.createDataFrame(fields, "source string, row_number long, fields map<string,string>")

    def rows(df):
        return sorted((r["entity_id"], r["email"], r["name"], r["phone"], r["has_conflicts"]) for r in df.collect())

    person = lambda n, **more: {"email": f"e{n}@x.example", "name": f"n{n}", "phone": str(n)} | more
    windows = [
        records("a", *[person(n) for n in range(40)], {"segment": "none"}, {}),
        # one found by its name and phone gets another email, one found by its email another name
        records("b", person(3, email="new@x.example"), person(5, name="other"), person(50), person(50, phone=None)),
        records("a", person(3, name=None, phone=None), {"email": "new@x.example", "name": "n9"}, {"segment": "none"}),
        records("b"),
        records("b", person(5), person(3, email="new@x.example", name="again"), person(41)),
    ]
    for w, new in enumerate(windows):
        hashes = canonical.key_hashes(canonical.typed(new, entity), entity)
        found = table.sharing(hashes, w)
        assert found.count() <= 2 * new.count()
        one, clashes, _ = canonical.load(new, found, entity, trust, changed_only=True, job=f"j{w}")
        two, same, _ = canonical.load(new, plain.read(w), entity, trust, changed_only=True, job=f"j{w}")
        assert rows(one) == rows(two) and sorted(clashes.collect(), key=str) == sorted(same.collect(), key=str)
        table.write(one, w)
        plain.write(two, w)
        if w == 2:
            table.compact(w)
        assert rows(table.read()) == rows(plain.read())


def test_lookups_read_only_parts_that_hit(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"), "entity_id string, v string", keys=lambda df: df.withColumn("hash", F.xxhash64("v")))
    many = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("entity_id"), F.col("id").cast("string").alias("v"))
    table.write(many, 0)
    table.compact(0)
    found = table.sharing(many.where("v = '77'").select(F.xxhash64("v").alias("hash")), 1)
    assert [r["v"] for r in found.collect()] == ["77"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert any("PartitionFilters" in line and "bucket" in line and "upto" in line for line in plan.splitlines())
    assert table.sharing(many.where("false").select(F.lit(1).cast("long").alias("hash")), 1).count() == 0
    with pytest.raises(ValueError):
        Versions(spark, str(tmp_path / "u"), "entity_id string, v string").sharing(many.select(F.xxhash64("v").alias("hash")))


def sale(i, **more):
    return {"customer_name": f"n{i}", "email": f"e{i}@x.example", "total_amount": f"{i}.00", "sku": f"p{i % 3}", "order_date": "2024-01-02"} | more


def test_job_refuses_rows_of_two(spark):
    two = payloads(spark, [sale(1)], "a").unionByName(payloads(spark, [sale(2)], "b"))
    with pytest.raises(ValueError):
        run_job(two, {}, None, "2024-06-01", mapping.registry(spark))


def test_history_of_jobs(spark, tmp_path):
    kept = History(spark, str(tmp_path / "h"))

    def job(seq, rows):
        profiles = profiling.profile(payloads(spark, rows))
        return sorted(r["rule"] for r in after_job(kept, "s", f"job-{seq}", seq, profiles).collect())

    same = [sale(i) for i in range(30)]
    assert job(1, same) == job(2, same) == []
    gone = [{k: v for k, v in r.items() if k != "order_date"} | {"customer_name": None} for r in same]
    assert "COMPLETENESS_NULL_RATE_DRIFT" in job(3, gone)
    first = history.schema_versions(kept, "s").collect()
    assert [(r["version"], r["status"], r["job_id"]) for r in first] == [(2, "ACTIVE", "job-3"), (1, "SUPERSEDED", "job-1")]
    assert "COMPLETENESS_NULL_RATE_DRIFT" in job(3, gone)
    assert history.schema_versions(kept).collect() == first and kept.read("ledger").count() == 3
    assert [p["seq"] for p in kept.before("s", 3)] == [2, 1] and kept.before("other", 9) == []
    plan = kept.profiles("s", [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and {r["seq"] for r in kept.profiles("s", [1, 2]).collect()} == {1, 2}


def test_summaries_follow_changes(spark, tmp_path):
    table = Summaries(spark, str(tmp_path / "s"))
    change = lambda *rows: spark.createDataFrame(list(rows), "source_id string, kind string, key string, n long")
    table.apply(change(("a", "issues", "HIGH", 2), ("b", "issues", "LOW", 1), ("a", "issues", "HIGH", 1)))
    untouched = sorted((tmp_path / "s/source_id=b").glob("*.parquet"))
    table.apply(change(("a", "issues", "HIGH", -3), ("a", "open_conflicts", "", 4)))
    assert sorted(tuple(r) for r in table.read().collect()) == [("a", "open_conflicts", "", 4), ("b", "issues", "LOW", 1)]
    assert sorted((tmp_path / "s/source_id=b").glob("*.parquet")) == untouched and table.read("issues").count() == 1


def test_sources_are_registered(spark, tmp_path):
    register = Sources(spark, str(tmp_path / "sources"))
    row = lambda i="a", kind="CSV_FILE", trust="0.5", name="n": spark.createDataFrame([(i, name, kind, trust, True, {"k": "v"}, 7)], SOURCES.rsplit(",", 1)[0].replace("decimal(3,2)", "string"))
    register.create(row())
    assert register.get("a")["config"] == {"k": "v"} and register.of_user(7).count() == 1 and register.of_user(8).count() == 0
    for bad in (row(), row("b", kind="FAX"), row("b", trust="1.5"), row("b", trust=None), row("b", name=" "), row("c").unionByName(row("c"))):
        with pytest.raises(ValueError):
            register.create(bad)
    with pytest.raises(ValueError):
        register.get("b")
    staging.require_source(register.all(), "a", "CSV")
    with pytest.raises(ValueError):
        staging.read_csv(spark, str(tmp_path / "x.csv"), "b", "j", register.all())
    with pytest.raises(ValueError):
        staging.read_excel(spark, str(tmp_path / "x.xlsx"), "a", "j", register.all())


def test_catalog_changes_columns(spark, tmp_path):
    catalog = Catalog(spark, "canonical_test", str(tmp_path / "db"))
    try:
        catalog.create(canonical.CUSTOMERS)
        people = canonical.empty_store(spark, canonical.CUSTOMERS).select(*catalog.columns("customers"))
        row = spark.createDataFrame([("1", "ann", {"tier": "3", "x": "y"}), ("2", "bob", {"tier": "no"})], "entity_id string, name string, additional_attributes map<string,string>")
        catalog.put("customers", people.unionByName(row, allowMissingColumns=True))
        catalog.promote("customers", "tier", "INTEGER")
        assert catalog.columns("customers")[-1] == "tier" and sorted((r["name"], r["tier"], r["additional_attributes"]) for r in catalog.read("customers").collect()) == [("ann", 3, {"x": "y"}), ("bob", None, {})]
        with pytest.raises(ValueError):
            catalog.promote("customers", "tier")
        catalog.demote("customers", "tier")
        assert "tier" not in catalog.columns("customers") and {r["name"]: r["additional_attributes"] for r in catalog.read("customers").collect()} == {"ann": {"x": "y", "tier": "3"}, "bob": {}}
        for bad in (lambda: catalog.demote("customers", "tier"), lambda: catalog.name("users"), lambda: catalog.promote("customers", "x; drop")):
            with pytest.raises(ValueError):
                bad()
    finally:
        spark.sql("DROP DATABASE canonical_test CASCADE")


def test_pages_after_a_key(spark, tmp_path):
    rows = [(i // 3, i, "x") for i in range(100)]
    df = reads.seekable(spark.createDataFrame(rows, "a long, b long, c string").repartition(5), ["a", "b"], str(tmp_path / "t"))
    page = lambda last: [(r["a"], r["b"]) for r in reads.after(df, ["a", "b"], last, 7).collect()]
    assert page(None) == [(i // 3, i) for i in range(7)] and page([2, 6]) == [(i // 3, i) for i in range(7, 14)] and page([33, 99]) == []
    last, seen = None, []
    while got := page(last):
        seen += got
        last = list(got[-1])
    assert seen == [(i // 3, i) for i in range(100)]
    assert "PushedFilters: [IsNotNull(a), GreaterThanOrEqual(a,2)" in reads.after(df, ["a", "b"], [2, 6])._jdf.queryExecution().executedPlan().toString()


def test_jdbc_in_ranges(spark):
    url, driver = "jdbc:derby:memory:ranges;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(3 * i - 50, f"v{i}") for i in range(200)]
    spark.createDataFrame(rows, "id int, name string").orderBy(F.desc("id")).coalesce(1).write.jdbc(url, "things", "overwrite", driver | {"user": "u", "password": "p"})
    config = {"jdbcUrl": url, "user": "u", "password": "p", "driverClassName": driver["driver"], "query": "select * from things", "keyColumn": "ID", "partitions": "4"}
    read = lambda: staging.read_jdbc(spark, config, "s", "j")
    assert read().select(F.spark_partition_id().alias("p"), "payload")._jdf.queryExecution().toString().count("numPartitions=4") >= 1
    once, again = ({r["row_number"]: {k.lower(): v for k, v in r["payload"].items()} for r in read().collect()} for _ in range(2))
    assert once == again == {n: {"id": str(i), "name": v} for n, (i, v) in enumerate(rows, 1)}
    assert staging.read_jdbc(spark, config | {"query": "select * from things where \"id\" > 9999"}, "s", "j").collect() == []
    with pytest.raises(ValueError):
        staging.read_jdbc(spark, config | {"keyColumn": "id; drop"}, "s", "j")


def test_long_workbooks_come_in_chunks(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    line = lambda n, *cells: f'<row r="{n}">' + "".join(f'<c t="inlineStr"><is><t>{c}</t></is></c>' for c in cells) + "</row>"

    def book(name, *lines):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(lines)}</sheetData></worksheet>")
        return str(tmp_path / name)

    path = book("long.xlsx", line(1, "key", "name"), *[line(n, n, f"row {n}") for n in range(2, 2000)])
    flat = spark.createDataFrame([(str(n), f"row {n}", n - 1) for n in range(2, 2000)], "key string, name string, row long")
    want = staging.stage(flat, ["key", "name"], F.lit("s"), F.lit("j"), F.col("row"))
    for chunk in (7, 2000):
        got = staging.read_excel(spark, path, "s", "j", chunk=chunk)
        assert sorted((r["row_number"], r["record_hash"]) for r in got.collect()) == sorted((r["row_number"], r["record_hash"]) for r in want.collect())
    with pytest.raises(Exception, match="empty"):
        staging.read_excel(spark, book("none.xlsx"), "s", "j").collect()


def test_job_reads_its_staged_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    rows = payloads(spark, [{"customer_name": "a", "total_amount": str(i), "sku": None if i % 4 == 0 else "s"} for i in range(20)])
    done = assess(rows.mapInPandas(counted, rows.schema), "2024-06-01")
    assert read.value == 20
    bad = done["issues"].where("severity = 'CRITICAL'").select("row_number").distinct()
    assert sorted(r[0] for r in bad.collect()) == sorted(r[0] for r in done["judged"].where(quality.critical()).select("row_number").collect())
    assert done["profiles"].where("field = 'sku'").first()["null_count"] == 5


def test_profiles_do_not_sort_the_cells(spark):
    plan = profiling.null_rates(payloads(spark, [{"a": "1", "b": None}]))._jdf.queryExecution().executedPlan().toString().splitlines()
    cells = next(i for i, line in enumerate(plan) if "Generate" in line)
    assert "HashAggregate" in next(line for line in reversed(plan[:cells]) if "Aggregate" in line)
