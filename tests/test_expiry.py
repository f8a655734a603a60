import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from folioscope.streaming import expiry, sessions

T = dt.datetime
SCHEMA = "token_hash string, user_id long, ts timestamp, kind string"
HOUR = dt.timedelta(hours=1)


def stream(spark, batches, folder):
    """Each list of rows as one file, which one batch of the stream takes."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i}")
        time.sleep(0.02)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def outcomes(spark, batches, folder, **more):
    return expiry.run_sessions(stream(spark, batches, folder), f"{folder}/out", f"{folder}/state", **more)


def test_sessions_open_expire_and_are_purged_once(spark, tmp_path):
    t = T(2024, 1, 1, 12)
    got = outcomes(spark, [
        [("a", 1, t, "create"), ("a", 1, t + HOUR, "use"), ("b", 2, t + 5 * HOUR, "create"), ("z", 9, t, "use"), (None, 1, t, "create"), ("n", None, t, "create")],
        # No renewal: a second creation changes nothing, and the last moment is too late.
        [("a", 1, t + 7 * HOUR, "create"), ("a", 1, t + 8 * HOUR - dt.timedelta(microseconds=1), "use"), ("a", 1, t + 8 * HOUR, "use")],
        [("c", 3, t + 9 * HOUR, "create")],
        [("a", 1, t + 10 * HOUR, "use"), ("b", 2, t + 10 * HOUR, "use")],
    ], tmp_path)
    found = sorted((r.token_hash, r.ts, r.outcome) for r in got.collect())
    assert found == sorted([
        ("a", t, "opened"), ("a", t + HOUR, "live"), ("b", t + 5 * HOUR, "opened"), ("z", t, "unknown"), ("a", t + 7 * HOUR, "repeated"),
        ("a", t + 8 * HOUR - dt.timedelta(microseconds=1), "live"), ("a", t + 8 * HOUR, "expired"), ("a", t + 8 * HOUR, "purged"),
        ("c", t + 9 * HOUR, "opened"), ("a", t + 10 * HOUR, "unknown"), ("b", t + 10 * HOUR, "live"),
    ])
    assert sorted((r.token_hash, r.user_id, r.created_at) for r in expiry.still_open(got).collect()) == [("b", 2, t + 5 * HOUR), ("c", 3, t + 9 * HOUR)]


def test_what_is_left_equals_the_batch_filter(spark, tmp_path):
    rng, t = random.Random(2), T(2024, 1, 1)
    rows = [(f"t{i}", i % 7, t + dt.timedelta(milliseconds=rng.randrange(40 * 3_600_000)), rng.choice(["create", "create", "use"])) for i in range(300)]
    rows.sort(key=lambda r: r[2])
    got = outcomes(spark, [rows[:120], rows[120:130], rows[130:]], tmp_path)
    left = sorted((r.token_hash, r.user_id, r.created_at) for r in expiry.still_open(got).collect())
    created = spark.createDataFrame([r[:3] for r in rows if r[3] == "create"], "token_hash string, user_id long, created_at timestamp")
    users = spark.createDataFrame([(i, f"u{i}", "viewer", True) for i in range(7)], "user_id long, username string, role string, is_active boolean")
    live = sessions.live_sessions(created, users, F.lit(rows[-1][2]))
    assert left and {x[0] for x in left} == {r.token_hash for r in live.collect()}
    purged = got.where("outcome = 'purged'").collect()
    assert len({r.token_hash for r in purged}) == len(purged) == sum(r[3] == "create" for r in rows) - len(left)


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    t = T(2024, 1, 1)
    events = stream(spark, [[("a", 1, t, "create")]], tmp_path)
    expiry.run_sessions(events, f"{tmp_path}/out", f"{tmp_path}/state")
    spark.createDataFrame([("a", 1, t + HOUR, "use"), ("b", 1, t + 9 * HOUR, "create")], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/later")
    got = expiry.run_sessions(events, f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted((r.token_hash, r.outcome) for r in got.collect()) == [("a", "live"), ("a", "opened"), ("a", "purged"), ("b", "opened")]


def test_state_lapses_by_the_clock(spark, tmp_path):
    """In processing time the state's time to live ends a session, without a timer."""
    t = T(2024, 1, 1)
    events = stream(spark, [[("a", 1, t, "create"), ("a", 1, t, "use")]], tmp_path)

    def go(hours):
        got = expiry.run_lapsing_sessions(events, f"{tmp_path}/out", f"{tmp_path}/state", hours)
        return sorted((r.token_hash, r.outcome) for r in got.collect())

    assert go(2 / 3600) == [("a", "live"), ("a", "opened")]
    time.sleep(2.5)
    spark.createDataFrame([("a", 1, t + HOUR, "use")], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/later")
    assert go(2 / 3600) == [("a", "live"), ("a", "opened"), ("a", "unknown")]


def test_the_state_store_setting_is_put_back(spark):
    before = spark.conf.get(expiry._ROCKS), spark.conf.get(expiry._IDLE)
    with pytest.raises(ZeroDivisionError), expiry.state_store(spark, idle_batches=False):
        assert spark.conf.get(expiry._IDLE) == "false"
        1 / 0
    assert (spark.conf.get(expiry._ROCKS), spark.conf.get(expiry._IDLE)) == before


def test_many_tokens_share_a_bucket_of_state(spark, tmp_path, monkeypatch):
    """State is read for each bucket rather than for each token; one that ends just at the watermark is purged, and of the others only those that ended."""
    monkeypatch.setattr(expiry, "BUCKETS", 2)
    t, ms = T(2024, 1, 1), dt.timedelta(milliseconds=1)
    got = outcomes(spark, [
        [(f"t{i}", i, t + i * ms, "create") for i in range(50)] + [("early", 1, t, "use"), ("early", 7, t + ms, "create"), ("early", 8, t + ms, "create"), ("early", 1, t + 2 * ms, "use")],
        [("x", 1, t + 8 * HOUR + 20 * ms, "use"), ("t30", 1, t + 8 * HOUR + 20 * ms, "use")],
        [("t5", 5, t + 8 * HOUR + 21 * ms, "use"), ("t40", 1, t + 8 * HOUR + 21 * ms, "create")],
    ], tmp_path)
    found = [(r.token_hash, r.user_id, r.outcome) for r in got.collect()]
    assert sorted(x[0] for x in found if x[2] == "purged") == sorted([f"t{i}" for i in range(22)] + ["early"])
    assert {x for x in found if x[0] == "early"} == {("early", 7, "opened"), ("early", 7, "repeated"), ("early", 7, "live"), ("early", None, "unknown"), ("early", 7, "purged")}
    assert ("t30", 30, "live") in found and ("t5", 5, "expired") in found and ("t40", 40, "repeated") in found
    assert {r.token_hash for r in expiry.still_open(got).collect()} == {f"t{i}" for i in range(22, 50)}
