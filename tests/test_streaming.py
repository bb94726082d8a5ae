from pyspark.sql import functions as F

from dossier.operators.relational import pending
from dossier.plans.inputs import table, view
from dossier.streaming import operators as S

DIR = "/root/testdata/sf0.001"


def test_poll_processes_each_batch_once_over_restarts(spark, tmp_path):
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    evidence = view(spark, DIR, "evidence")
    evidence.where("id % 2 = 0").coalesce(1).write.parquet(src)
    done = view(spark, DIR, "normalizations")

    def work(df, batch):
        pending(df, done).select("id").write.mode("overwrite").parquet(f"{out}/batch={batch}")

    for part in (None, "id % 2 = 1"):
        if part:
            evidence.where(part).coalesce(1).write.mode("append").parquet(src)
        S.poll(S.evidence_stream(spark, src, evidence.schema), work, f"{tmp_path}/check", once=True).awaitTermination()
    got = sorted(r.id for r in spark.read.parquet(out).collect())
    assert got == sorted(r.id for r in pending(evidence, done).collect()) and got


def test_rate_limits_drop_late_rows(spark, tmp_path):
    src = f"{tmp_path}/src"
    rows = [("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 10:05:00"), ("b", "2024-01-01 10:05:00")]
    make = lambda r: spark.createDataFrame(r, "ip string, t string").select("ip", F.to_timestamp("t").alias("ts"))
    df = make(rows)
    for part in (rows, [("z", "2024-01-01 14:00:00")], [("a", "2024-01-01 10:06:00"), ("z", "2024-01-01 14:01:00")], [("z", "2024-01-01 18:00:00")]):
        make(part).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).parquet(src)
        q = S.rate_limits(stream, "ip", "ts", 1).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r.ip, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 2), ("z", 2)]
    assert [(r.ip, r.n) for r in S.rate_limits(df, "ip", "ts", 1).collect()] == [("a", 2)]


def test_lockout_steps_and_batch(spark):
    state, said = (0, 0.0), []
    for at, ok in [(0, False), (1, False), (2, True), (3, False), (4, False), (5, False), (6, False), (7, False), (8, True), (1807, True), (1808, False)]:
        *state, out = S.after_login(*state, float(at), ok)
        said.append(out)
    assert said == ["FAILED", "FAILED", "OK", "FAILED", "FAILED", "FAILED", "FAILED", "LOCKED_NOW", "LOCKED", "OK", "FAILED"]
    e = table(spark, DIR, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(False).alias("ok"))
    got = S.lockouts(e, "user_id", "ts", "event_id", "ok")
    assert got.count() == e.count() and got.where("outcome = 'LOCKED_NOW'").count() > 0


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(spark, tmp_path, name, parts, made):
    """Rows that a stream over ``parts`` (one file and batch each, in this order) has given by its end."""
    src = f"{tmp_path}/{name}"
    for i, df in enumerate(parts):
        df.coalesce(1).write.parquet(f"{src}/n={i:04d}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/n=*")
        q = made(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect(), q.lastProgress
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_shuffled_replay_of_logins_equals_the_batch_query(spark, tmp_path):
    """Logins in five batches, out of order over the whole span, several to a user and batch: the same as one ordered pass."""
    e = table(spark, DIR, "events").where("user_id < 12").select(F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("event"), (F.col("event_type") == "purchase").alias("ok"))
    parts = [e.where(F.pmod(F.xxhash64("event"), F.lit(5)) == i) for i in range(5)]
    end = spark.createDataFrame([(-1, "2025-06-01 00:00:00", -1, True)], "user long, t string, event long, ok boolean").select("user", F.to_timestamp("t").alias("ts"), "event", "ok")
    got, _ = replay(spark, tmp_path, "locks", [*parts, end], lambda df: S.lockout_stream(df, "60 days", 400))
    want = S.lockouts(e, "user", "ts", "event", "ok").collect()
    assert sorted((r.user, r.event, r.outcome, r.attempts) for r in got) == sorted((r.user, r.event, r.outcome, r.attempts) for r in want) and want
    assert any(r.outcome == "LOCKED" for r in want) and any(r.outcome == "LOCKED_NOW" for r in want)


def test_idle_users_are_forgotten(spark, tmp_path):
    """Four failures, then nothing for a month: the fifth is the first again, and no state is left of who stays away."""
    make = lambda rows: spark.createDataFrame(rows, "user long, t string, event long, ok boolean").select("user", F.to_timestamp("t").alias("ts"), "event", "ok")
    first = make([(1, f"2024-01-01 00:0{i}:00", i, False) for i in range(4)] + [(2, "2024-01-01 00:00:00", 50, False)])
    later = make([(1, "2024-03-01 00:00:00", 9, False)])
    parts = [first, make([(3, "2024-01-02 00:00:00", 60, True)]), make([(3, "2024-02-20 00:00:00", 61, True)]), later, make([(3, "2024-09-01 00:00:00", 62, True)]), make([(3, "2025-03-01 00:00:00", 63, True)])]
    got, progress = replay(spark, tmp_path, "idle", parts, lambda df: S.lockout_stream(df, "1 hour", 30))
    assert {(r.user, r.event): (r.outcome, r.attempts) for r in got if r.user == 1} == {(1, 0): ("FAILED", 1), (1, 1): ("FAILED", 2), (1, 2): ("FAILED", 3), (1, 3): ("FAILED", 4), (1, 9): ("FAILED", 1)}
    assert progress.stateOperators[0].numRowsTotal <= 8  # what is left is the last user's: state, waiting login, timers


def test_queue_replay_keeps_order_and_every_job(spark, tmp_path):
    """Jobs in three batches: one leaves every two seconds in order, unknown types and failures become dead letters."""
    rows = [("q", 1000 + 10 * (i // 4), i, ["text", "image", "odd", None][i % 4], f"p{i}") for i in range(24)] + [("r", 1005, 100, "text", "bad")]
    make = lambda x: spark.createDataFrame(x, "queue string, s long, job long, type string, payload string").select("queue", F.timestamp_seconds("s").alias("at"), "job", "type", "payload")
    parts = [make(rows[:9]), make(rows[9:20]), make(rows[20:]), make([("end", 10_000, -1, "text", "")])]

    def text(payload):
        if payload == "bad":
            raise ValueError("unreadable")
        return payload.upper()

    got, _ = replay(spark, tmp_path, "queue", parts, lambda df: S.analysis_stream(df, {"text": text, "image": lambda p: f"<{p}>"}))
    got = sorted((r for r in got if r.queue != "end"), key=lambda r: (r.queue, r.released_at))
    assert [r.job for r in got] == [*range(24), 100]
    assert {r.job: (r.status, r.detail) for r in got if r.job in (0, 1, 2, 3, 100)} == {0: ("DONE", "P0"), 1: ("DONE", "<p1>"), 2: ("DEAD_LETTER", "no handler for odd"), 3: ("DEAD_LETTER", "no handler for None"), 100: ("DEAD_LETTER", "ValueError: unreadable")}
    want, last = {}, None
    for _, s, job, _, _ in rows[:24]:
        last = s if last is None else max(s, last + 2)
        want[job] = last
    assert {r.job: int(r.released_at.timestamp()) for r in got if r.queue == "q"} == want
    batch = S.release_times(make(rows[:24]), ["queue"], "at", "job").collect()
    assert {r.job: int(r.released_at.timestamp()) for r in batch} == want


def test_routing_keeps_unknown_types_and_progress(spark):
    jobs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, type string")
    out, others = S.routed(jobs, {"a": lambda d: d.withColumn("r", F.lit("A")), "b": lambda d: d.withColumn("r", F.lit("B"))})
    assert sorted((r.id, r.r) for r in out.collect()) == [(1, "A"), (2, "B")] and sorted(r.id for r in others.collect()) == [3, 4]
    f = spark.createDataFrame([(1, "COMPLETED", 2), (1, "DUPLICATE", 2), (2, "FAILED", 2)], "s int, status string, total int")
    assert {r.s: r.is_complete for r in S.session_progress(f, "s", "status", "total").collect()} == {1: True, 2: False}


def test_progress_listener(spark, tmp_path):
    said = []
    listener = S.Progress(lambda i, batch, rows: said.append((batch, rows)))
    spark.streams.addListener(listener)
    try:
        spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/src")
        q = S.poll(spark.readStream.schema("id long").parquet(f"{tmp_path}/src"), lambda df, b: df.count(), f"{tmp_path}/check", once=True)
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert q.lastProgress.numInputRows == 5
