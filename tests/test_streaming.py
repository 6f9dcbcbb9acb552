"""Streams fed in several micro-batches equal the batch operators; sinks survive a retry."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from convoy.functions.shard import md5_shard
from convoy.operators import dedup, pattern, rollup, rules, scan, twin
from convoy.sources import readers
from convoy.streaming import operators as so
from convoy.streaming import counters, pipeline, sinks, state

START = dt.datetime(2024, 1, 1)
SCHEMA = ("vin string, tenant string, msg_type string, seq long, event_time timestamp, arrival long, event_type string, dtc string, "
          "coolant_c double, trans_c double")


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", so.ROCKSDB)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def messages():
    """In event-time order but for a jitter below the watermark; the last row closes all windows."""
    rng = random.Random(11)
    rows, now = [], START
    for i in range(400):
        now += dt.timedelta(seconds=rng.choice([0, 1, 2, 4, 30]))
        vin = "hot" if rng.random() < 0.6 else f"v{rng.randrange(3)}"
        ts = now - dt.timedelta(seconds=rng.choice([0, 1, 3]))
        if rng.random() < 0.5:
            rows.append((vin, "t", "FAST", i, ts, i, None, None, float(rng.choice([100, 111, 115])), float(rng.choice([100, 131]))))
        else:
            code = rng.choice(["P0300", "P0308", "P0309", "P0300"])
            rows.append((vin, "t", "EVENT", i, ts, i, "DTC_SET", code, None, None))
    rows.append(("end", "t", "FAST", 999, now + dt.timedelta(hours=2), 999, None, None, 1.0, 1.0))
    return rows


def feed(spark, folder, rows, parts=4):
    """One file per micro-batch, in order, plus the whole table."""
    frame = spark.createDataFrame(rows, SCHEMA)
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return frame, stream


def collect(stream, folder, name):
    query = sinks.start_files(stream, f"{folder}/{name}", f"{folder}/_c_{name}", once=True)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{name}")


def alerts_of(df):
    return sorted((r.vin, r.failure_type, tuple(r.dtc_codes), r.detected_at) for r in df.collect())


def test_window_and_pattern_rules(spark, folder):
    rows = messages()
    frame, stream = feed(spark, folder, rows)
    timed = so.with_event_time(stream)
    final = max(r[4] for r in rows) - dt.timedelta(seconds=5)
    ours = alerts_of(collect(rules.sustained_alerts(timed, rules.SUSTAINED_RULES), folder, "hop"))
    batch = [a for a in alerts_of(rules.sustained_alerts(frame, rules.SUSTAINED_RULES)) if a[3] <= final]
    assert ours == batch and len(batch) > 20
    for skip in pattern.SKIP_POLICIES:
        found = alerts_of(collect(so.misfire_recurrence(timed, 60, skip), folder, f"pairs_{skip}"))
        chunk = scan.time_chunk(F.col("event_time"), "5 minutes")
        expected = alerts_of(pattern.misfire_recurrence(frame, chunk, within="60 SECONDS", skip=skip))
        assert found == expected and len(expected) > 10


def test_dedup(spark, folder):
    rows = messages()
    copies = rows[:50] + rows
    _, stream = feed(spark, folder, copies)
    kept = collect(so.drop_duplicates(stream, ["vin", "seq"]).select("vin", "seq"), folder, "dedup").collect()
    assert sorted((r.vin, r.seq) for r in kept) == sorted((r[0], r[3]) for r in rows)


def nested(df, fields):
    return df.select("vin", "tenant", "msg_type", "seq", "event_time", "arrival", F.struct(*fields).alias("payload"))


def as_rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).fillna("-").fillna(-1.0).fillna(-1).collect()), key=repr)


def test_twin_over_batches(spark, folder):
    """Keyed state over five batches equals the batch fold; a batch writes only the vehicles it names."""
    rng = random.Random(2)
    rows = [(*r[:3], max(0, r[3] + rng.randrange(-30, 3)), *r[4:]) for r in messages()]
    frame, stream = feed(spark, folder, rows, parts=5)
    fields = [("coolant_c", "double"), ("trans_c", "double"), ("dtc", "string")]
    names = [n for n, _ in fields]
    changes = state.twin_changes(nested(stream, names), ["arrival", "seq"], archive=True)
    writer = state.store_changes(f"{folder}/twin", fields, f"{folder}/archive", "vin string, msg_type string, seq bigint, event_time timestamp")
    sinks.start(changes, f"{folder}/_c", writer, once=True).awaitTermination()
    expected = twin.fold_twin(frame, names, ["arrival", "seq"], scan.number_chunk(F.col("arrival"), 50))
    assert as_rows(state.current_twin(spark, f"{folder}/twin"), expected.columns) == as_rows(expected, expected.columns)
    fresh = dedup.drop_stale(frame, ["vin", "msg_type"], "seq", [F.col("arrival"), F.col("seq")], scan.number_chunk(F.col("arrival"), 50))
    columns = ["vin", "msg_type", "seq", "event_time"]
    assert as_rows(spark.read.parquet(f"{folder}/archive"), columns) == as_rows(fresh, columns)
    per_batch = {r.batch: r.n for r in spark.read.parquet(f"{folder}/twin/changes").groupBy("batch").agg(F.count("*").alias("n")).collect()}
    size = -(-len(rows) // 5)
    for number, n in per_batch.items():
        assert n <= len({r[0] for r in rows[number * size:(number + 1) * size]})
    assert "end" not in {r.vin for r in spark.read.parquet(f"{folder}/twin/changes/batch=0").collect()}


def test_folding_the_view_removes_what_no_reader_needs(spark, folder):
    def change(batch, *rows):
        made = spark.createDataFrame(rows, "vin string, x int, revision long")
        sinks.write_batch(made, f"{folder}/changes", batch)

    now = lambda: {r.vin: r.x for r in state.current_twin(spark, folder).collect()}
    assert state.current_twin(spark, folder) is None and state.fold_changes(spark, folder) is None
    change(0, ("a", 1, 1), ("b", 1, 1))
    change(1, ("a", 2, 2))
    assert now() == {"a": 2, "b": 1}
    assert state.fold_changes(spark, folder) == 1 and now() == {"a": 2, "b": 1}
    assert state.fold_changes(spark, folder) == 1
    change(2, ("c", 5, 1))
    reader = state.current_twin(spark, folder)
    assert state.fold_changes(spark, folder) == 2 and now() == {"a": 2, "b": 1, "c": 5}
    assert {r.vin for r in reader.collect()} == {"a", "b", "c"}  # one that began before the fold
    assert sinks.batches(spark, f"{folder}/changes") == [2]
    change(3, ("b", 9, 2))
    change(4, ("c", 6, 2))
    assert state.fold_changes(spark, folder) == 4 and now() == {"a": 2, "b": 9, "c": 6}
    assert sinks.versions(spark, f"{folder}/view") == [2, 4] and sinks.batches(spark, f"{folder}/changes") == [3, 4]


def test_days_are_outermost_and_dropped(spark, folder):
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-09")], "x int, dt string")
    for batch in (0, 0, 1):
        sinks.write_days(rows, f"{folder}/t", batch)
    stored = spark.read.parquet(f"{folder}/t")
    assert stored.count() == 6
    plan = stored.filter("dt >= DATE '2024-01-05'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    assert sinks.drop_days(spark, f"{folder}/t", "2024-01-03") == ["2024-01-01", "2024-01-02"]
    assert {r.x for r in spark.read.parquet(f"{folder}/t").collect()} == {3}


def test_retry_replaces_its_own_output(spark, folder):
    first = spark.range(5).withColumn("dt", F.lit("d1"))
    sinks.write_batch(first, f"{folder}/t", 0, "dt")
    sinks.write_batch(spark.range(2).withColumn("dt", F.lit("d1")), f"{folder}/t", 1, "dt")
    sinks.write_batch(first, f"{folder}/t", 0, "dt")
    assert spark.read.parquet(f"{folder}/t").count() == 7


def test_publish_reads_old_version_while_writing(spark, folder):
    sinks.publish(spark.range(3), f"{folder}/v", 0)
    sinks.publish(sinks.current(spark, f"{folder}/v").union(spark.range(1)), f"{folder}/v", 1)
    assert sinks.current(spark, f"{folder}/v").count() == 4
    assert sinks.current(spark, f"{folder}/v", before=1).count() == 3
    assert sinks.current(spark, f"{folder}/missing") is None


def test_incremental_rollup_touches_only_due_days(spark, folder):
    rows = [("v", START + dt.timedelta(days=i), float(i)) for i in range(10)]
    columns = {c: F.col("x") for c in ("coolant_c", "ambient_c", "load_pct", "rpm", "oil_kpa", "trans_c", "speed_kmh", "fuel_rate_lph")}
    raw = spark.createDataFrame(rows, "vin string, event_time timestamp, x double").withColumns(columns)
    rollup.daily_rollup(raw).withColumn("max_coolant_c", F.lit(-1.0)).write.partitionBy("day").parquet(f"{folder}/r")
    rollup.write_refreshed(raw, f"{folder}/r", F.lit(START + dt.timedelta(days=9)))
    after = {r.day.day: r.max_coolant_c for r in spark.read.parquet(f"{folder}/r").collect()}
    assert after == {d: (float(d - 1) if d in (7, 8) else -1.0) for d in range(1, 11)}


def test_pipeline_end_to_end(spark, folder):
    vin = "1M8GDM9AXKP042788"
    shard = spark.range(1).select(md5_shard(F.lit(vin), 32).alias("s")).first()["s"]
    topic = f"fleet/demo/shard-{shard}/{vin}/telemetry"
    base = dict(lat=12.9, lon=77.6, heading=0.0, gps_hdop=1.0, speed_kmh=50.0, odo_km=10.0, accel_long_g=0.0, accel_lat_g=0.0, ambient_c=30.0, rpm=1500)
    lines = []
    for i in range(40):
        body = dict(vin=vin, msg_type="FAST", seq=i, ts=f"2024-01-01T00:00:{i:02d}Z", fw_version="1", payload=dict(base, coolant_c=115.0, oil_kpa=80.0 if i == 7 else 300.0))
        lines.append((topic, json.dumps(body), i))
    lines += [lines[3], (topic, "{", 50), ("x", "{}", 51)]
    late = dict(vin=vin, msg_type="FAST", seq=100, ts="2024-01-01T03:00:00Z", fw_version="1", payload=dict(base))
    lines.append((topic, json.dumps(late), 60))
    spark.createDataFrame(lines, "topic string, value string, arrival long").write.json(f"{folder}/raw")
    paths, seen = pipeline.Paths(f"{folder}/out"), counters.Counters()
    spark.createDataFrame([(vin, 7, "owner")], "vin string, vehicle_id long, tenant string").write.parquet(f"{folder}/vehicles")
    raw = readers.message_stream(spark, f"{folder}/raw", "topic string, value string, arrival long")
    spark.streams.addListener(seen)
    pipeline.start_routing(raw, paths, 32, once=True).awaitTermination()
    for query in pipeline.start_pipeline(pipeline.accepted_stream(spark, paths), paths, f"{folder}/vehicles", once=True):
        seen.wait(query)
    spark.streams.removeListener(seen)
    read = lambda name: spark.read.parquet(paths.data(name))
    assert {r.reason: r.messages for r in read("counters").collect()} == {"accepted": 42, "bad_json": 1, "bad_topic": 1}
    assert read("dead_letters").count() == 2
    assert read("telemetry_fast").count() == 41 and read("lake").count() == 41 and read("archive").count() == 41
    alerts = read("alerts")
    assert alerts.filter("failure_type = 'lubrication'").count() == 1 and alerts.filter("failure_type = 'cooling'").count() > 5
    assert {(r.vehicle_id, r.tenant) for r in alerts.collect()} == {(7, "owner")} and read("unknown_vins").count() == 0
    totals = seen.totals()
    assert (totals["store.received"], totals["kept.unique"], totals["twin.accepted"], totals["twin.stale"]) == (42, 41, 41, 1)
    assert totals["alerts.raised"] == alerts.count()
    now = state.current_twin(spark, paths.data("twin")).first()
    assert (now.vin, now.last_seq_fast, now.coolant_c, now.oil_kpa) == (vin, 100, 115.0, 300.0)


def test_topics_are_separated(spark):
    telemetry = json.dumps(dict(vin="v", msg_type="FAST", seq=1, ts="2024-01-01T00:00:00Z", payload={"lat": 1.5}))
    alert = json.dumps(dict(vin="v", tenant="t", failure_type="tyre", severity="critical", dtc_codes=["C0750"], detected_at="2024-01-01T00:00:00Z"))
    raw = spark.createDataFrame([("telemetry", telemetry), ("alerts", alert), ("telemetry", "{bad"), ("other", telemetry)], "topic string, value string")
    seen, raised = readers.by_topic(raw, "telemetry", "alerts")
    assert [(r.vin, r.payload.lat, r.payload.lon) for r in seen.collect()] == [("v", 1.5, None)]
    assert [(r.failure_type, r.dtc_codes) for r in raised.collect()] == [("tyre", ["C0750"])]


def test_label_file(spark, folder):
    with open(f"{folder}/labels.csv", "w") as out:
        out.write("vin,tenant,vehicle_type,failure_type,onset_at,failure_at\nA,demo,ICE,cooling,2024-01-01T00:00:00Z,2024-01-09T12:00:00Z\nB,demo,EV,,,\nC,demo,EV,tyre,soon,bad\n")
    rows = {r.vin: (r.failure_type, r.failure_at) for r in readers.failure_labels(spark, f"{folder}/labels.csv").collect()}
    assert rows == {"A": ("cooling", dt.datetime(2024, 1, 9, 12)), "B": (None, None), "C": ("tyre", None)}


def test_kept_rows_by_first_arrival_across_batches(spark):
    old = spark.createDataFrame([("a", 1, "old"), ("b", 5, "keep")], "vin string, at int, x string")
    new = spark.createDataFrame([("a", 2, "new"), ("c", 1, "add")], "vin string, at int, x string")
    merged = {r.vin: r.x for r in twin.merge_latest(old, new, "vin", "at").collect()}
    assert merged == {"a": "new", "b": "keep", "c": "add"}
    assert dedup.missing_keys(old, new, ["vin"]).collect()[0].vin == "b"


def test_feed_deals_more_files_for_more_rows(spark, folder):
    """Every part has as many files as the trigger reads, more than two where it has the rows; order keys may be null or times."""
    from convoy.plans import streams

    rows = spark.range(1000).selectExpr("id AS arrival", "id % 7 AS x").repartition(2)
    schema, files = streams._feed(rows, f"{folder}/many", file_rows=40)
    assert files == 5 and schema.names == rows.columns
    stored = spark.read.parquet(f"{folder}/many").select(F.input_file_name().alias("f"), F.floor(F.col("arrival") / 200).alias("part"))
    assert {r.part: r.n for r in stored.groupBy("part").agg(F.count_distinct("f").alias("n")).collect()} == {p: 5 for p in range(5)}
    assert streams._feed(rows.limit(20), f"{folder}/few", file_rows=1)[1] >= 2


def test_twin_hands_over_one_value_per_message(spark, folder):
    """Each value of a row costs the processor more than its message: all of a message is one text."""
    frame, stream = feed(spark, folder, messages())
    changes = state.twin_changes(nested(stream, ["coolant_c"]), ["event_time", "arrival", "seq"])
    assert re.search(r"transformWithStateUDF\(vin#\d+, entry#\d+\)", changes._jdf.queryExecution().analyzed().toString())
    writer = state.store_changes(f"{folder}/twin", [("coolant_c", "double")])
    sinks.start(changes, f"{folder}/_c", writer, once=True).awaitTermination()
    expected = twin.fold_twin(frame, ["coolant_c"], ["event_time", "arrival", "seq"], scan.time_chunk(F.col("event_time"), "5 minutes"))
    assert as_rows(state.current_twin(spark, f"{folder}/twin"), expected.columns) == as_rows(expected, expected.columns)


def test_state_partitions_follow_the_cores(spark, folder):
    """A state partition is a store of its own: many shuffle partitions, as large tables have, make no more of them."""
    import os

    _, stream = feed(spark, folder, messages()[:40], parts=1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    most = sinks.STATE_PER_CORE * spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.shuffle.partitions", most + 40)
    try:
        sinks.start(so.drop_duplicates(stream, ["vin", "seq"]), f"{folder}/_c", lambda batch, n: sinks.write_batch(batch, f"{folder}/out", n), once=True).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(most + 40)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len([n for n in os.listdir(f"{folder}/_c/state/0") if n.isdigit()]) == most
    assert spark.read.parquet(f"{folder}/out").count() == 40


def test_queries_run_one_after_another_once(spark, folder):
    rows = "SELECT 'v' AS vin, 'FAST' AS msg_type, id AS seq, timestamp_seconds(1700000000 + id) AS ts, 't' AS tenant, id AS arrival FROM range(9)"
    spark.sql(rows).write.parquet(f"{folder}/out/accepted")
    spark.createDataFrame([("v", 7, "owner")], "vin string, vehicle_id long, tenant string").write.parquet(f"{folder}/vehicles")
    paths = pipeline.Paths(f"{folder}/out")
    started = pipeline.start_pipeline(pipeline.accepted_stream(spark, paths), paths, f"{folder}/vehicles", once=True)
    assert [(q.name, q.isActive) for q in started] == [("alerts", False), ("store", False), ("twin", False)]
    begun = [dt.datetime.fromisoformat(q.recentProgress[0].timestamp) for q in started]
    ended = [dt.datetime.fromisoformat(q.recentProgress[-1].timestamp) for q in started]
    assert ended[0] <= begun[1] and ended[1] <= begun[2]
    assert spark.read.parquet(paths.data("telemetry_fast")).count() == 9


def test_routing_keeps_the_text_or_the_message(spark):
    """What routing keeps of a micro-batch has the text of a message once, and gives the same rows."""
    from convoy.operators import quality

    vin = "1M8GDM9AXKP042788"
    shard = spark.range(1).select(md5_shard(F.lit(vin), 32).alias("s")).first()["s"]
    body = dict(vin=vin, msg_type="EVENT", seq=1, ts="2024-01-01T00:00:00Z", fw_version="1", payload=dict(event_type="DTC_SET", dtc="P0300"))
    topic = f"fleet/t/shard-{shard}/{vin}/telemetry"
    lines = [(topic, json.dumps(body), 1), (topic, "{", 2), (topic, json.dumps(dict(body, vin="x")), 3), (topic, json.dumps(dict(body, seq=-1)), 4), ("x", None, 5)]
    judged = quality.judge(spark.createDataFrame(lines, "topic string, value string, arrival long"), 32)
    kept = quality.narrowed(judged)
    assert not {"value", "_vin", "_shard"} & set(kept.columns) and "payload" not in kept.select("_m.*").columns
    assert kept.filter("reason IS NULL AND _text IS NOT NULL OR reason IS NOT NULL AND _p IS NOT NULL").count() == 0
    for rows in (lambda j: quality.accepted(j, "arrival"), quality.quarantined, quality.reason_counts):
        assert sorted(rows(kept).collect(), key=repr) == sorted(rows(judged).collect(), key=repr)
    assert quality.accepted(kept).count() == 1 and quality.quarantined(kept).count() == 4


def test_feed_leaves_its_rows_once(spark, folder):
    import os

    from convoy.plans import streams

    streams._feed(spark.range(100).selectExpr("id AS arrival", "repeat('x', 5000) AS value"), f"{folder}/raw", "json")
    assert os.listdir(folder) == ["raw"]
    assert sum(os.path.getsize(f"{folder}/raw/{n}") for n in os.listdir(f"{folder}/raw")) < 100 * 5000 // 4
    assert spark.read.schema("arrival long, value string").json(f"{folder}/raw").filter("length(value) = 5000").count() == 100


def test_pairs_hand_over_rows_and_keep_one_value(spark, folder):
    """A frame and several store calls per vehicle cost more than its few events."""
    _, stream = feed(spark, folder, messages())
    pairs = so.misfire_recurrence(so.with_event_time(stream), 60)
    assert "transformWithStateUDF(vin" in pairs._jdf.queryExecution().analyzed().toString()

    class Handle:
        opened, timers = [], []

        def getValueState(self, name, schema):
            self.opened.append(name)
            return self

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        value, registerTimer = None, timers.append

    class Mark:
        getCurrentWatermarkInMs = staticmethod(lambda: 5)

    processor = so.PairProcessor(1_000_000, "past_last")
    processor.init(Handle())
    assert list(processor.handleInputRows(("v", "t"), iter([("v", "t", None, us, us, True, "P0300") for us in (4900, 1000, 5000)]), None)) == []
    found = list(processor.handleExpiredTimer(("v", "t"), Mark, None))
    assert [tuple(r) for r in found] == [("v", "t", "P0300", 4900)] and Handle.opened == ["known"] and Handle.timers == [2, 6]
    assert Handle.timers and json.loads(processor.known.value[2]) == [[5000, 5000, True, "P0300"]]


def test_alerts_out_of_state_are_not_broadcast(spark, folder, monkeypatch):
    """The batch that closes the windows has no input and so no size that Spark could go by; its alerts may be many."""
    plans, write = {}, sinks.write_batch

    def noted(df, path, number, *partitions):
        plans[path.rsplit("/", 1)[-1], number] = df._jdf.queryExecution().executedPlan().toString()
        write(df, path, number, *partitions)

    monkeypatch.setattr(sinks, "write_batch", noted)
    rows = "SELECT concat('v', id % 3) AS vin, 'FAST' AS msg_type, id AS seq, timestamp_seconds(1700000000 + id) AS ts, 't' AS tenant, id AS arrival, named_struct('coolant_c', 120D) AS payload FROM range(90)"
    spark.sql(rows).write.parquet(f"{folder}/out/accepted")
    spark.range(50000).selectExpr("concat('v', id) AS vin", "id AS vehicle_id", "'owner' AS tenant").write.parquet(f"{folder}/vehicles")
    paths = pipeline.Paths(f"{folder}/out")
    timed = so.with_event_time(pipeline.accepted_stream(spark, paths)).select("*", "payload.*").drop("payload")
    sinks.start(pipeline.alert_stream(timed), paths.checkpoint("alerts"), pipeline.alert_batch(paths, f"{folder}/vehicles"), once=True).awaitTermination()
    assert spark.read.parquet(paths.data("alerts")).filter("batch = 1").count() > 0
    assert "SortMergeJoin" in plans["alerts", 1] and "Broadcast" not in plans["alerts", 1]
