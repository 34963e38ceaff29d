import datetime as dt

from lodestrata.streaming import tracking


def test_stream_equals_batch(spark, tmp_path):
    t = lambda m: dt.datetime(2031, 1, 1) + dt.timedelta(minutes=m)
    rows = [(1, t(0), "a"), (2, t(59), "a"), (3, t(60), "b"), (None, t(1), "a"), (4, None, "a"), (1, t(500), "b"), (1, t(10), None)]
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, "user long, at timestamp, kind string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    stream = lambda: tracking.stream_of(spark, str(tmp_path), "events", files_per_batch=1)
    batch = tracking.windowed_counts(spark.read.parquet(f"{tmp_path}/events.parquet"), "at", "kind")
    live = tracking.drained(spark, tracking.windowed_counts(stream(), "at", "kind", late="9 days"), ["start", "kind"], "n", "w")
    key = lambda r: (str(r[0]), r[1] or "", r[2])
    assert sorted(map(tuple, live.collect()), key=key) == sorted(map(tuple, batch.collect()), key=key)
    seen = tracking.drained(spark, tracking.sightings(stream(), "user", "at"), ["key"], "n", "s")
    assert {r.key: (r.first_seen, r.last_seen, r.n) for r in seen.collect()} == {"1": (t(0), t(500), 3), "2": (t(59), t(59), 1), "3": (t(60), t(60), 1)}
