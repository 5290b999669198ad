import pytest
from hypothesis import given
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import profiling
from tallyloom.sources.staging import stage

CASES = [
    (["7", "-12", "0", None], "INTEGER", None),
    (["007", "12"], "CATEGORY", None),
    (["1.5", ".25", "3e4", "12"], "DECIMAL", None),
    (["99999999999", "1"], "DECIMAL", None),
    (["TRUE", "false"], "BOOLEAN", None),
    (["1999-02-28", "2031-10-05"], "DATE", "yyyy-MM-dd"),
    (["28/02/1999", "05/10/2031"], "DATE", "dd/MM/yyyy"),
    (["02/28/1999", "10/05/2031"], "DATE", "MM/dd/yyyy"),
    (["Feb 3, 1999", None], "DATE", "MMM d, yyyy"),
    (["1999-02-28T01:02:03", " "], "DATETIME", "yyyy-MM-dd'T'HH:mm:ss"),
    (["1999-02-28T01:02:03Z"], "DATETIME", None),
    (["ann@shop.example", "b_o-b@mail.shop.example"], "EMAIL", None),
    (["555 0100 22", "(0)40-555.0100"], "PHONE", None),
    (["$3", "4.50 €", "£ 12.0"], "CURRENCY_AMOUNT", None),
    (["north", "south", "north"], "CATEGORY", None),
    ([f"note {i * i}" for i in range(20)], "FREE_TEXT", None),
    (["", None, "  "], "FREE_TEXT", None),
]


def staged(spark, values, job="j"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values, 1)], "n long, v string")
    return stage(df, ["v"], F.lit("s"), F.lit(job), F.col("n"))


@pytest.mark.parametrize("values, kind, fmt", CASES)
def test_types(spark, values, kind, fmt):
    row = profiling.profile(staged(spark, values)).first()
    assert (row["inferred_type"], row["date_format"]) == (kind, fmt)


def test_profile_of_small_column(spark):
    row = profiling.profile(staged(spark, ["10", "9", None, "9", " ", "11"])).first()
    assert float(row["null_rate"]) == 0.3333 and row["distinct_count"] == 3
    assert list(row["top_values"]) == ["9", "10", "11"] and list(row["sample_values"]) == ["10", "9", "11"]
    assert (row["min_value"], row["max_value"]) == ("9", "11")


def test_extremes_of_any_size(spark):
    row = profiling.profile(staged(spark, ["2", "1e40", "-3E39", "0.00000000000000000001", "1e-30"])).first()
    assert (row["min_value"], row["max_value"]) == ("-3E39", "1e40")


def test_sample_takes_the_first_rows(spark):
    row = profiling.profile(staged(spark, ["1", "2", "x"]), sample_rows=2).first()
    assert row["inferred_type"] == "INTEGER" and row["total"] == 2


def test_empty_table_has_no_profile(spark):
    assert profiling.profile(staged(spark, ["1"]).where("false")).count() == 0


@settings(max_examples=25, deadline=None)
@given(values=st.lists(st.text(alphabet=" \t\n\x00ab ", max_size=6), min_size=1, max_size=5))
def test_trim_drops_control_characters(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    low = "".join(map(chr, range(33)))
    assert [r[0] for r in df.select(X.trim(F.col("v"))).collect()] == [v.strip(low) for v in values]


def test_full_match_sees_final_line_break(spark):
    df = spark.createDataFrame([("a@b.co\n",), ("a@b.co",)], "v string")
    assert [r[0] for r in df.select(X.is_rule_email(F.col("v"))).collect()] == [False, True]


def test_drift_rules(spark):
    schema = "source_id string, batch int, field string, null_rate string, top_values array<string>, min_value string, max_value string"
    ten = list("ABCDEFGHIJ")
    rows = [
        ("s", 3, "customer_name", "0.5000", None, None, None), ("s", 2, "customer_name", "0.0400", None, None, None), ("s", 1, "customer_name", "0.0600", None, None, None),
        ("s", 3, "category", "0", ten, None, None), ("s", 2, "category", "0", ["X", "Y", "Z"], None, None), ("s", 1, "category", "0", ["A"], None, None),
        ("s", 3, "unit_price", "0", None, "10", "1000"), ("s", 2, "unit_price", "0", None, "100", "200"), ("s", 1, "unit_price", "0", None, "120", "180"),
        ("few", 2, "a", "1.0000", None, None, None), ("few", 1, "a", "0", None, None, None),
    ]
    found = {(r["source_id"], r["field"], r["rule"]) for r in profiling.profile_drift(spark.createDataFrame(rows, schema)).collect()}
    assert found == {("s", "customer_name", "COMPLETENESS_NULL_RATE_DRIFT"), ("s", "category", "VALIDITY_VALUE_DISTRIBUTION_DRIFT"), ("s", "unit_price", "ACCURACY_RANGE_EXPANSION_DRIFT")}
