import re

from collections import Counter

from pyspark.sql import functions as F

from tallyloom.operators import quality
from tallyloom.sources.staging import stage, with_hash


def payloads(spark, rows, source="s"):
    df = spark.createDataFrame([(i, list(p.items())) for i, p in enumerate(rows, 1)], "row_number long, e array<struct<k:string,v:string>>")
    return with_hash(df.select(F.lit(source).alias("source_id"), F.lit("j").alias("job_id"), "row_number", F.map_from_entries("e").alias("payload")))


def rules(spark, *rows, as_of="2026-06-01", **more):
    return Counter(r["rule"] for r in quality.check(payloads(spark, rows), as_of, **more).collect())


GOOD = {"customer_name": "a", "total_amount": "1", "sku": "s"}


def test_missing_fields_are_critical(spark):
    assert rules(spark, {"customer_name": "", "total_amount": None}) == Counter(COMPLETENESS_CUSTOMER_NAME=1, COMPLETENESS_TOTAL_AMOUNT=1, COMPLETENESS_SKU=1)


def test_validity(spark):
    bad = GOOD | {"order_date": "not-a-date", "total_amount": "-12.50", "quantity": "abc", "email": "bademail.com"}
    assert rules(spark, bad, dimensions={"VALIDITY"}) == Counter(VALIDITY_DATE_FORMAT=1, VALIDITY_NEGATIVE_NUMBER=1, VALIDITY_NON_NUMERIC=1, VALIDITY_EMAIL_FORMAT=1)
    assert not rules(spark, GOOD | {"order_date": "2024-02-31", "quantity": "1d"}, dimensions={"VALIDITY"})


def test_duplicates_flag_every_copy(spark):
    assert rules(spark, GOOD, GOOD, dimensions={"UNIQUENESS"}) == Counter(UNIQUENESS_DUPLICATE_HASH=2)


def test_consistency_and_dates(spark):
    bad = GOOD | {"quantity": "5", "unit_price": "10.00", "line_total": "45.00", "order_date": "2099-12-31"}
    assert rules(spark, bad) == Counter(CONSISTENCY_LINE_TOTAL=1, CONSISTENCY_FUTURE_ORDER_DATE=1, TIMELINESS_FUTURE_DATE=1)
    assert rules(spark, GOOD | {"order_date": "2020-01-01"}) == Counter(TIMELINESS_STALE_DATE=1)
    assert not rules(spark, GOOD | {"order_date": "2024-06-01"})


def test_accuracy(spark):
    assert rules(spark, GOOD | {"Currency": "XYZ", "country": "Atlantis"}) == Counter(ACCURACY_INVALID_CURRENCY=1, ACCURACY_INVALID_COUNTRY=1)
    assert not rules(spark, GOOD | {"currency": " usd", "country": "germany"})


def test_scores_of_csv_fixture(spark):
    cols = ["Row ID", "Customer Name", "Ship Mode", "Order Date", "Sales", "Country", "Currency"]
    rows = [
        ("1", "Acme Corp", "x", "2024-03-15", "100.00", "US", "USD"), ("2", "", "x", "2024-03-15", "200.00", "US", "USD"), ("3", "Globex", "x", "2024-03-15", "-50.00", "US", "USD"),
        ("4", "Initech", "x", "2010-01-01", "150.00", "US", "USD"), ("5", "Umbrella", "x", "2024-03-15", "300.00", "Atlantis", "XYZ"),
    ]
    st = stage(spark.createDataFrame(rows, cols), cols, F.lit("s"), F.lit("j"), F.col("`Row ID`").cast("long"))
    issues = quality.check(st, "2024-06-01")
    assert issues.count() == 10
    row = quality.scores(st, issues).first()
    assert [str(row[c]) for c in ("completeness", "validity", "uniqueness", "consistency", "timeliness", "accuracy", "overall")] == ["0.0000", "0.9000", "1.0000", "1.0000", "0.9600", "0.9800", "0.7700"]
    assert row["grade"] == "C"
    assert quality.accepted(st, issues).count() == 0


def test_golden_score(spark):
    st = payloads(spark, [GOOD] * 10)
    keys = "source_id string, job_id string, row_number long, dimension string, severity string"
    issues = spark.createDataFrame([("s", "j", 1, "COMPLETENESS", "CRITICAL"), ("s", "j", 1, "VALIDITY", "HIGH"), ("s", "j", 1, "CONSISTENCY", "MEDIUM"), ("s", "j", 1, "ACCURACY", "LOW")], keys)
    row = quality.scores(st, issues).first()
    assert (str(row["overall"]), row["grade"]) == ("0.9633", "A")


def test_rejects_say_why(spark):
    st = payloads(spark, [GOOD, {"total_amount": "1", "sku": "s"}])
    issues = quality.check(st, "2026-06-01")
    assert [(r["row_number"], r["reason"]) for r in quality.rejected(issues).collect()] == [(2, "Required field 'customer_name' is null or blank")]
    counts = quality.pass_fail(st, issues).first()
    assert (counts["total_records"], counts["passed_records"], counts["failed_records"]) == (2, 1, 1)


def test_user_rule(spark):
    rule = quality.user_rule("NEEDS_REF", "VALIDITY", "LOW", "ref", "payload['ref'] is not null")
    assert rules(spark, GOOD, GOOD | {"ref": "1"}, extra=[rule], dimensions={"VALIDITY"}) == Counter(NEEDS_REF=1)


def test_no_method_of_the_rules_is_too_large_to_be_compiled(spark, monkeypatch, capsys):
    seen = []
    monkeypatch.setattr(quality, "written", lambda df, *_: seen.append(df) or df)
    quality.judge(payloads(spark, [{"name": "a"}]), "2001-08-01", payloads=True)
    seen[0].explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert max(sizes, default=0) < 8000


def test_keys_in_any_spelling(spark):
    got = {(r["rule"], r["field"], r["row_number"]) for r in quality.check(payloads(spark, [{"Currency-Code": "XYZ"}, {"a\nb": "1", "CURRENCY code": "XYZ"}, {"curr": " ", "country": "\t"}, {"NATION": " atlantis"}]), "2001-08-01").where("dimension = 'ACCURACY'").collect()}
    assert got == {("ACCURACY_INVALID_CURRENCY", "currency_code", 1), ("ACCURACY_INVALID_CURRENCY", "currency_code", 2), ("ACCURACY_INVALID_COUNTRY", "nation", 4)}
