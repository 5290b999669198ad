import hashlib
import time

from pyspark.sql import functions as F

from tallyloom.plans import demo
from tallyloom.streaming import live, windows
from tallyloom.streaming.seen import KEY, Seen


def events(spark, *numbers, source="s"):
    rows = [(source, hashlib.sha256(str(n).encode()).hexdigest(), n) for n in numbers]
    return spark.createDataFrame(rows, "source_id string, record_hash string, n long")


def numbers(df):
    return sorted(r["n"] for r in df.collect())


def test_index_finds_what_an_anti_join_finds(spark, tmp_path):
    seen = Seen(spark, str(tmp_path / "seen"))
    assert numbers(seen.fresh(events(spark, 1, 2, 2, 3), 0)) == [1, 2, 3]
    batches = [range(0, 2000), range(1500, 2500), range(2400, 2600)]
    for i, batch in enumerate(batches):
        new = seen.fresh(events(spark, *batch), i)
        assert numbers(new) == sorted(set(batch) - set().union(*batches[:i]))
        seen.add(new, i)
        if i < 2:
            seen.compact(i)
    assert numbers(seen.fresh(events(spark, 7, 2555, 9999), 3)) == [9999]
    # another source's events are its own, and a window that runs again does not see itself
    assert numbers(seen.fresh(events(spark, 7, source="t"), 3)) == [7]
    assert numbers(seen.fresh(events(spark, *range(2400, 2600)), 2)) == list(range(2500, 2600))


def test_index_reads_only_prefixes_that_hit(spark, tmp_path):
    seen = Seen(spark, str(tmp_path / "seen"))
    seen.add(events(spark, *range(3000)), 0)
    seen.compact(0)
    again = events(spark, 5)
    prefix = again.first()["record_hash"][:2]
    plan = seen.fresh(again, 1)._jdf.queryExecution().executedPlan().toString()
    assert any("PartitionFilters" in line and "prefix" in line and prefix in line for line in plan.splitlines())
    read = [r["f"] for r in seen.base([0], [prefix]).select(F.input_file_name().alias("f")).distinct().collect()]
    assert read and all(f"/prefix={prefix}/" in f for f in read)
    # new events mostly pass the filters, and then nothing is looked up
    fresh = events(spark, *range(10_000, 10_400))
    found = seen.fresh(fresh, 1)
    assert numbers(found) == list(range(10_000, 10_400))


def test_unfinished_compactions_do_not_count(spark, tmp_path):
    seen = Seen(spark, str(tmp_path / "seen"))
    seen.add(events(spark, 1, 2), 0)
    seen._gens(1)
    events(spark, 3).select(*KEY, F.substring("record_hash", 1, 2).alias("prefix")).write.partitionBy("prefix").parquet(f"{tmp_path}/seen/base/gen=0")
    assert numbers(seen.fresh(events(spark, 1, 3), 1)) == [3]
    seen.compact(0)
    assert numbers(seen.fresh(events(spark, 1, 2, 3), 1)) == [3]


def test_windows_of_each_source(spark, tmp_path):
    """Two sources of unlike pace: each window opens with its source's first event and ends by its own timer."""
    staged = str(tmp_path / "staged")

    def put(batch, *sources):
        spark.createDataFrame([(s, f"{s}{batch}{i}") for i, s in enumerate(sources)], "source_id string, record_hash string").write.parquet(f"{staged}/batch={batch}")

    done = []

    def pipeline(rows, batch_id):
        done.extend((r["job_id"], r["n"]) for r in rows.groupBy("job_id").agg(F.count("*").alias("n")).collect())

    put(0, "a", "a", "b")
    q = windows.start(spark, staged, str(tmp_path / "check"), pipeline, seconds=6, trigger={"processingTime": "500 milliseconds"}, states_path=str(tmp_path / "states"))

    def wait(until, most=120):
        end = time.time() + most
        while not until() and time.time() < end:
            assert q.isActive, q.exception()
            time.sleep(0.3)
        assert until(), done

    try:
        opened = lambda: q.lastProgress is not None and q.lastProgress.batchId >= 0 and any(p.numInputRows for p in q.recentProgress)
        wait(opened)
        put(1, "a")
        wait(lambda: len(done) >= 2)
        assert sorted(j for j, _ in done) == ["window-a-0", "window-b-0"] and dict(done)["window-b-0"] == 1
        put(2, "b", "b", "b")
        wait(lambda: "window-b-1" in dict(done))
        assert dict(done)["window-b-1"] == 3
    finally:
        q.stop()
    states = spark.read.parquet(str(tmp_path / "states"))
    first = states.where("source_id = 'a' AND number = 0")
    assert first.where("status = 'PENDING'").count() >= 1 and first.where("status = 'ELIGIBLE'").count() == 1
    ended = first.where("status = 'ELIGIBLE'").first()
    assert (ended["seen_at"] - ended["opened_at"]).total_seconds() >= 6


class FakeState:
    def __init__(self):
        self.value, self.now, self.hasTimedOut, self.timer = None, 0, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def setTimeoutDuration(self, ms):
        self.timer = ms

    def getCurrentProcessingTimeMs(self):
        return self.now


def test_window_states():
    import pandas as pd

    step, state = windows.advance(30), FakeState()

    def go(now, *batches, timed_out=False):
        state.now, state.hasTimedOut = now, timed_out
        return [(f["number"][0], f["status"][0], f["records"][0], f["batches"][0]) for f in step(("s",), iter([pd.DataFrame({"batch": list(batches)})]), state)]

    assert go(1000, 4, 4) == [(0, "PENDING", 2, [4])] and state.timer == 30_000
    assert go(11_000, 5) == [(0, "PENDING", 3, [4, 5])] and state.timer == 20_000
    assert go(31_000, timed_out=True) == [(0, "ELIGIBLE", 3, [4, 5])]
    assert go(40_000, 6) == [(1, "PENDING", 1, [6])]
    assert go(90_000, 7) == [(1, "ELIGIBLE", 2, [6, 7])]


def test_listener_and_observed_metrics(spark, tmp_path):
    """Metrics counted while a window is staged equal those of the batch query, and the listener tells each trigger's duration."""
    from tests.conftest import SF

    progress = live.Progress()
    spark.streams.addListener(progress)
    try:
        demo.live_values(spark, SF).write.text(str(tmp_path / "in"))
        stream = spark.readStream.text(str(tmp_path / "in"))
        live.start(stream, lambda: demo.live_sources(spark), str(tmp_path / "staged"), str(tmp_path / "dead"), str(tmp_path / "check"), trigger={"availableNow": True}, metrics_path=str(tmp_path / "metrics")).awaitTermination()
        deadline = time.time() + 20
        while not progress.rows and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(progress)
    resolved = live.resolve_sources(live.parse(demo.live_values(spark, SF)), demo.live_sources(spark))
    names = ["read", "staged", "repeated", "dead", "unknown"]
    want = live.metrics(resolved, live.fresh(live.valid(resolved), None)).first()
    got = spark.read.parquet(str(tmp_path / "metrics")).select(*[F.sum(c).alias(c) for c in names]).first()
    assert [got[c] for c in names] == [want[c] for c in names]
    assert sum(r["read"] for r in progress.rows) == want["read"] and all(r["duration_ms"] > 0 for r in progress.rows)
