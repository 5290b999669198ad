import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyloom.plans import demo
from tallyloom.sources import staging
from tallyloom.sources.cron import next_after
from tallyloom.sources.excel import shown
from tallyloom.streaming import live


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("Row ID,Customer Name\n1, Ann \n2,\n3,Bob\n")
    rows = staging.read_csv(spark, str(path), "s", "j").orderBy("row_number").collect()
    assert [(r["row_number"], r["payload"]["Customer Name"]) for r in rows] == [(1, "Ann"), (2, None), (3, "Bob")]
    assert rows[1]["raw_payload"] == '{"Row ID":"2","Customer Name":null}'
    with pytest.raises(ValueError):
        staging.read_csv(spark, str(tmp_path / "a.txt"), "s", "j")


def test_csv_with_ragged_row_fails(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception):  # noqa: B017
        staging.read_csv(spark, str(path), "s", "j").collect()


def test_excel(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f"""<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Num</t></is></c><c r="D1" t="s"><v>1</v></c><c r="E1" t="s"><v>2</v></c></row>
    <row r="2"><c r="A2" t="s"><v>3</v></c><c r="B2"><v>7</v></c><c r="C2"><v>42.5</v></c><c r="D2" t="b"><v>1</v></c><c r="E2" t="e"><v>#DIV/0!</v></c></row></sheetData></worksheet>"""
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Str</t></si><si><t>Flag</t></si><si><t>Err</t></si><si><t>Hello</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    row = staging.read_excel(spark, str(tmp_path / "b.xlsx"), "s", "j").first()
    assert row["payload"] == {"Str": "Hello", "_c1": "7", "Num": "42.5", "Flag": "true", "Err": None}


def test_excel_shows_what_readers_see(spark, tmp_path):
    ns, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head = "".join(f'<c r="{c}1" t="inlineStr"><is><t>{t}</t></is></c>' for c, t in zip("ABCDEF", ["Day", "Price", " ", "Share", "Same", "Same"], strict=True))
    body = '<c r="A3" s="1"><v>45366</v></c><c r="B3" s="2"><v>1234.5</v></c><c r="C3"><v>0.1</v></c><c r="D3" s="3"><v>0.125</v></c><c r="E3"><v>1</v></c><c r="F3"><f>1+1</f><v>2</v></c>'
    sheets = {"sheet10": f'<worksheet {ns}><sheetData><row r="1">{head}</row><row r="3">{body}</row></sheetData></worksheet>', "sheet2": f"<worksheet {ns}><sheetData/></worksheet>"}
    with zipfile.ZipFile(tmp_path / "c.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="first" sheetId="9" r:id="r7"/><sheet name="second" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet2.xml"/><Relationship Id="r7" Target="worksheets/sheet10.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="4"/><xf numFmtId="9"/></cellXfs></styleSheet>')
        for name, xml in sheets.items():
            z.writestr(f"xl/worksheets/{name}.xml", xml)
    rows = staging.read_excel(spark, str(tmp_path / "c.xlsx"), "s", "j").collect()
    assert [(r["row_number"], r["payload"]) for r in rows] == [(1, {"Day": "2024-03-15", "Price": "1,234.50", "_c2": "0.1", "Share": "13%", "Same": "2"})]


@pytest.mark.parametrize(
    "value, code, text",
    [("45366.5625", "d-mmm-yy h:mm AM/PM", "15-Mar-24 1:30 PM"), ("0.75", "h:mm:ss", "18:00:00"), ("1.5", "[h]:mm", "36:00"), ("-2.345", "0.00", "-2.35"), ("1234567", "#,##0", "1,234,567"), ("0.5", '"$"0.00', "$0.50"), ("12345", "0.00E+00", "1.23E+04"), ("1e-7", "General", "1E-07"), ("3", "@", "3")],
)
def test_number_formats(value, code, text):
    assert shown(value, code) == text


def test_jdbc(spark):
    url = "jdbc:derby:memory:people;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.createDataFrame([(1, "Ann", 49.99), (2, None, 1.0), (3, " Bob ", None)], "id int, name string, price double").coalesce(1).write.jdbc(url, "people", "overwrite", driver | {"user": "u", "password": "p"})
    config = {"jdbcUrl": url, "user": "u", "password": "p", "driverClassName": driver["driver"], "query": "select * from people"}
    rows = {r["row_number"]: dict(r["payload"]) for r in staging.read_jdbc(spark, config, "s", "j").collect()}
    by = {k.lower(): k for k in rows[1]}
    assert sorted(rows) == [1, 2, 3] and sorted((r[by["id"]], r[by["name"]], r[by["price"]]) for r in rows.values()) == [("1", "Ann", "49.99"), ("2", None, "1.0"), ("3", "Bob", None)]


def test_sources_are_checked(spark):
    known = spark.createDataFrame([("a", "JDBC", True), ("b", "JDBC", False), ("c", "CSV", True)], "source_id string, source_type string, active boolean")
    staging.require_source(known, "a", "JDBC")
    for source, kind in (("b", "JDBC"), ("c", "JDBC"), ("d", "CSV")):
        with pytest.raises(ValueError):
            staging.require_source(known, source, kind)


def test_jdbc_options():
    good = {"jdbcUrl": "jdbc:x", "user": "u", "password": "p", "driverClassName": "d", "query": " select 1"}
    assert staging.jdbc_options(good)["fetchsize"] == "1000"
    for bad in (good | {"query": "delete from t"}, good | {"user": ""}):
        with pytest.raises(ValueError):
            staging.jdbc_options(bad)


def test_cron():
    base = datetime(2024, 2, 28, 23, 59, 30)
    assert next_after("0 0 * * * *", base) == datetime(2024, 2, 29)
    assert next_after("0 */15 9-17 * * MON-FRI", base) == datetime(2024, 2, 29, 9)
    assert next_after("0 0 0 31 2 *", base) is None and next_after("nonsense", base) is None


def test_due_sources(spark):
    rows = [("a", "JDBC", True, "0 0 * * * *", datetime(2024, 1, 1)), ("b", "JDBC", True, "bad", datetime(2024, 1, 1)), ("c", "CSV", True, "0 0 * * * *", None), ("d", "JDBC", True, "0 0 0 1 1 *", datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "source_id string, source_type string, active boolean, cron_expression string, last_sync_at timestamp").withColumn("created_at", F.lit(None).cast("timestamp"))
    assert [r["source_id"] for r in staging.due_sources(df, "2024-01-02 00:00:00").collect()] == ["a"]


def message(i, system="pos", time="2024-01-01T00:00:00+00:00"):
    return f'{{"event_id":"{i}","source_system":"{system}","event_time":"{time}"}}'


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [message(1), message(1), message(2, time="not-a-date"), "junk", message(3, "nowhere"), message(4, "shop", "2024-01-01T00:00:00Z"), '{"event_id":"5"}']
    (tmp_path / "in/a.txt").write_text("\n".join(lines))
    stream = spark.readStream.text(str(tmp_path / "in"))
    go = lambda: live.start(stream, lambda: demo.live_sources(spark), str(tmp_path / "staged"), str(tmp_path / "dead"), str(tmp_path / "check"), trigger={"availableNow": True}).awaitTermination()
    go()
    (tmp_path / "in/b.txt").write_text("\n".join([message(1), message(6)]))
    go()
    staged = spark.read.parquet(str(tmp_path / "staged"))
    assert sorted(r["payload"]["event_id"] for r in staged.collect()) == ["1", "4", "6"]
    dead = spark.read.parquet(str(tmp_path / "dead"))
    assert sorted(r["error"] for r in dead.collect()) == ["event_time is not an instant", "missing source_system", "not a JSON object", "unknown source system"]


def test_windows_become_jobs(spark, tmp_path):
    """Each window is a job: the first maps the fields, later ones keep the mappings, stores go on."""
    from tallyloom.operators import mapping
    from tallyloom.plans.pipeline import each_window, versioned

    def sale(i, name, amount, **more):
        fields = {"event_id": str(i), "source_system": "pos", "event_time": "2024-01-01T00:00:00Z", "customer_name": name, "email": f"{name}@x.example", "sku": f"p{i}", "total_amount": amount, **more}
        return json.dumps(fields)

    (tmp_path / "in").mkdir()
    root = str(tmp_path / "out")
    job = each_window(root, demo.trust(spark), mapping.registry(spark), lambda: "2024-06-01")
    stream = spark.readStream.text(str(tmp_path / "in"))
    go = lambda: live.start(stream, lambda: demo.live_sources(spark), str(tmp_path / "staged"), str(tmp_path / "dead"), str(tmp_path / "check"), job, {"availableNow": True}, metrics_path=str(tmp_path / "metrics")).awaitTermination()
    (tmp_path / "in/a.txt").write_text("\n".join([sale(1, "ann", "10.00"), sale(2, "bob", "5.00"), sale(2, "bob", "5.00"), sale(3, None, "7.00"), "junk"]))
    go()
    (tmp_path / "in/b.txt").write_text("\n".join([sale(4, "ann", "11.00", segment="new")]))
    go()
    window = lambda name, i: spark.read.parquet(f"{root}/{name}/window={i}")
    assert [(r["read_records"], r["passed_records"], r["loaded_records"]) for i in (0, 1) for r in window("counters", i).collect()] == [(3, 2, 2), (1, 1, 1)]
    tables = versioned(spark, root)
    assert sorted((r["name"], r["segment"]) for r in tables["customers"].read().collect()) == [("ann", "new"), ("bob", None)]
    assert tables["orders"].read(1).count() == 2 and tables["orders"].read().count() == 3
    changes = lambda name, i: spark.read.parquet(f"{root}/{name}/changes/window={i}").count()
    assert [changes("customers", i) for i in (0, 1)] == [2, 1] and [changes("orders", i) for i in (0, 1)] == [2, 1]
    first, later = ({r["field"]: r["status"] for r in window("mappings", i).collect()} for i in (0, 1))
    assert set(later) == {*first, "segment"} and first["email"] == later["email"] == "AUTO_CONFIRMED"
    told = spark.read.parquet(str(tmp_path / "metrics")).orderBy("batch").collect()
    assert [(r["read"], r["staged"], r["repeated"], r["dead"], r["unknown"]) for r in told] == [(5, 3, 1, 1, 0), (1, 1, 0, 0, 0)]
    assert all(r["duration_ms"] > 0 and str(r["first_event"]) == "2024-01-01 00:00:00" for r in told)


def test_event_time_windows_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join(message(i, time=f"2024-01-01T0{i}:00:00Z") for i in range(9)))
    resolved = live.resolve_sources(live.parse(spark.readStream.text(str(tmp_path / "in"))), demo.live_sources(spark))
    counts = live.window_counts(live.valid(resolved), F.to_timestamp(F.col("payload")["event_time"]))
    q = counts.writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("win").count() == 9
