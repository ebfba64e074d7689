import pytest
from pyspark.sql import functions as F

from dataward import infra
from dataward.functions import stats, text
from dataward.ops import error_log, query_log
from dataward.streaming import logs


def test_retry():
    tries, waits = [], []

    def work():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError("reset")
        return "done"

    assert infra.with_retry(work, sleep=waits.append) == "done" and len(waits) == 2 and 0.75 <= waits[0] <= 1.25 and 1.5 <= waits[1] <= 2.5
    with pytest.raises(ValueError):
        infra.with_retry(lambda: (_ for _ in ()).throw(ValueError("no")), sleep=waits.append)


def test_circuit_breaker():
    now = [0.0]
    breaker = infra.CircuitBreaker(2, 10, lambda: now[0])
    fail = lambda: 1 / 0
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            breaker.call(fail)
        if breaker.state == "closed":
            breaker.call(lambda: 1)  # a success leaves failures counted
    assert breaker.state == "open"
    with pytest.raises(infra.CircuitOpenError):
        breaker.call(lambda: 1)
    now[0] = 11
    with pytest.raises(ZeroDivisionError):
        breaker.call(fail)
    assert breaker.state == "open"
    now[0] = 22
    assert breaker.call(lambda: 1) == 1 and breaker.state == "closed"


def test_health_and_shutdown(spark):
    assert infra.health(spark, 60, 120)["status"] == "healthy" and infra.executors(spark)["parallelism"] >= 1
    alerts, changes = [], []
    answers = iter(["healthy", "unhealthy", "unhealthy"])
    monitor = infra.HealthMonitor(lambda: {"status": next(answers)}, alert_after=2, on_change=lambda a, b: changes.append((a, b)), on_alert=alerts.append)
    for _ in range(3):
        monitor.once()
    assert changes == [("healthy", "unhealthy")] and alerts == [2]
    done, hooks = [], infra.Shutdown()
    hooks.add("a", lambda: done.append("a"))
    hooks.add("b", lambda: 1 / 0)
    with pytest.raises(ExceptionGroup):
        hooks.run()
    hooks.run()
    assert done == ["a"]


def test_timer(spark):
    clock = iter([0.0, 0.5, 1.0, 1.1])
    timer = infra.QueryTimer(clock=lambda: next(clock))
    timer.run("slow", lambda: 1)
    timer.run("fast", lambda: 2)
    assert [r["query_text"] for r in timer.slowest(1)] == ["slow"] and query_log.summary(timer.frame(spark)).first()["fastest"] == "fast"


def test_percentiles(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("v"))
    row = df.agg(stats.percentile_disc("v", 0.95).alias("a"), stats.floor_index(df, "v", 0.95).alias("b")).first()
    assert (row["a"], row["b"]) == (95.0, 96.0)
    assert stats.period("2w").days == 14
    from datetime import datetime

    assert stats.since("1m", datetime(2024, 3, 31)) == datetime(2024, 2, 29) and stats.since("24h", datetime(2024, 3, 2)) == datetime(2024, 3, 1)


def test_text(spark):
    df = spark.createDataFrame([("SELECT * FROM t  WHERE id = 42 AND n = 'x'", "dup 42 in 'k' (a 1)", "acme.app.example:80")], "q string, e string, h string")
    row = df.select(text.query_fingerprint(F.col("q")), text.error_fingerprint(F.col("e")), text.subdomain(F.col("h")), text.query_tables(F.col("q")), text.tenant_of(text.tenant_schema(F.lit("a")))).first()
    assert tuple(row) == ("SELECT * FROM t WHERE id = ? AND n = ?", "dup N in 'X' (...)", "acme", ["t"], "a")


def test_alerts_fire(spark):
    df = spark.createDataFrame([(i, "Connection refused") for i in range(12)], "id long, error string")
    assert error_log.alerts(df).first()["alert"] == "Connection Error: 12"


def test_streamed_counts_match_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", "a" if i % 2 else "b", i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, t string, event_type string, user_id int").withColumn("ts", F.to_timestamp_ntz("t")).drop("t")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = logs.events(spark, str(tmp_path / "in"), df.schema)
    q = logs.windowed_counts(stream, late="1 day").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got, want = spark.table("counts").collect(), logs.windowed_counts(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(r["n"] for r in got) == 300
    assert logs.sessions(df, gap="3 minutes").count() == 300 // 300 * 300 or logs.sessions(df, gap="4 minutes").count() == 3
    w = logs.append_to(logs.events(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "out"), str(tmp_path / "cp"))
    w.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 300
