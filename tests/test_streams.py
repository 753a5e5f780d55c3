import datetime as dt

from pyspark.sql import functions as F

from karst.streaming import streams as S


def files(spark, tmp_path, rows):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    for i, part in enumerate(rows):
        df = spark.createDataFrame([(k, t(m), u, e, 1.0, None) for k, m, u, e in part], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return S.event_stream(spark, str(tmp_path / "in"), 1)


def test_windows_and_sessions(spark, tmp_path):
    s = files(spark, tmp_path, [[(1, 0, 1, "a"), (2, 10, 1, "a"), (3, 70, 1, "a"), (4, 5, 2, "b")]])
    S.run_once(S.windowed(s, "1 hour"), "w1")
    assert sorted((r.event_type, r.n) for r in spark.table("w1").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    S.run_once(S.sessions(s, "30 minutes"), "s1")
    assert sorted((r.user_id, r.n) for r in spark.table("s1").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_second_delivery_is_dropped(spark, tmp_path):
    s = files(spark, tmp_path, [[(1, 0, 1, "a"), (1, 1, 1, "a"), (2, 2, 1, "a")]])
    S.run_once(S.first_deliveries(s, "event_id", "1 hour"), "d1", "append")
    assert spark.table("d1").count() == 2


def test_job_states_ignore_steps_back(spark, tmp_path):
    s = files(spark, tmp_path, [[(1, 0, 7, "queued"), (2, 5, 7, "completed"), (3, 9, 7, "processing"), (4, 1, 8, "odd")]])
    jobs = S.job_states(s.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("state"), "ts"), None)
    S.run_once(jobs, "j1", "update")
    assert [(r.job_id, r.state) for r in spark.table("j1").collect()] == [("7", "completed")]


def test_idempotent_sink(spark, tmp_path):
    s = files(spark, tmp_path, [[(1, 0, 1, "a")]])
    S.into(s, S.to_parquet(str(tmp_path / "out")), str(tmp_path / "log"))
    S.into(s, S.to_parquet(str(tmp_path / "out")), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
