import datetime as dt
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.sources import store
from folioscope.streaming import sessions

T = dt.datetime


def test_upsert_keeps_ids_and_is_idempotent(spark):
    old = spark.createDataFrame([(1, "p", "a", 10), (2, "q", "b", 20)], "id long, k string, v string, made int")
    new = spark.createDataFrame([(9, "p", "c", 99), (8, "r", "d", 88), (7, None, "e", 77)], "id long, k string, v string, made int")
    once = store.upsert(old, new, ["k"], keep=["id", "made"])
    want = [(1, "p", "c", 10), (2, "q", "b", 20), (7, None, "e", 77), (8, "r", "d", 88)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, store.upsert(once, new, ["k"], keep=["id", "made"]).collect())) == want
    assert store.upsert(old, new.drop("made"), ["k"]).where("k = 'q'").first().made == 20


def test_children_are_replaced(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "eval_id int, v string")
    new = spark.createDataFrame([(1, "z")], "eval_id int, v string")
    assert sorted(map(tuple, store.replace_children(old, new, "eval_id").collect())) == [(1, "z"), (2, "c")]
    assert store.replace_children(old, new.where("false"), "eval_id", parents=new).collect()[0].v == "c"
    same = store.vector_rows(old.withColumnRenamed("eval_id", "doc_id"), new.withColumnRenamed("eval_id", "doc_id").where("false"))
    assert same.count() == 3


def test_logs_are_only_added_to(spark, tmp_path):
    log = store.AppendOnlyLog(spark, str(tmp_path / "log"), store.AUTH_LOG)
    row = lambda u: store.auth_events(spark.createDataFrame([("login", u)], "event string, username string"))
    log.append(row("x" * 100))
    before = {f: os.stat(tmp_path / "log" / f).st_mtime_ns for f in os.listdir(tmp_path / "log") if f.startswith("part")}
    log.append(row("y"))
    assert all(os.stat(tmp_path / "log" / f).st_mtime_ns == t for f, t in before.items())
    assert sorted(len(r.username) for r in log.read().collect()) == [1, 64] and not {m for m in dir(log) if not m.startswith("_")} - {"append", "read", "path", "schema", "spark"}


def test_copies_are_checked(spark, tmp_path):
    persons = spark.createDataFrame([("p",)], "person_id string")
    ev = spark.createDataFrame([("p", 1), (None, 2)], "person_id string, id int")
    ref = [("ev", "persons", "person_id")]
    assert store.copy_tables({"persons": persons, "ev": ev}, {"ev": ["id"]}, ref, str(tmp_path / "a")) == {"persons": 1, "ev": 2}
    with pytest.raises(Exception, match="(?i)exist"):
        store.copy_tables({"persons": persons, "ev": ev}, {}, ref, str(tmp_path / "a"))
    with pytest.raises(ValueError, match="lacks"):
        store.copy_tables({"persons": persons, "ev": ev}, {"ev": ["score"]}, ref, str(tmp_path / "b"))
    with pytest.raises(ValueError, match="refers"):
        store.copy_tables({"persons": persons.where("false"), "ev": ev}, {}, ref, str(tmp_path / "c"))
    assert not os.path.exists(tmp_path / "b") and not os.path.exists(tmp_path / "c")


def test_versions_and_migration(spark, tmp_path):
    for v in ("one", "two"):
        store.publish({"t": spark.createDataFrame([(v,)], "v string")}, str(tmp_path / "s"))
    assert store.current(spark, str(tmp_path / "s"), "t").first().v == "two"
    out = store.migrated(spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([], "id int, more string"))
    assert out.columns == ["id", "more"] and out.first().more is None
    lines = store.csv_lines(spark.createDataFrame([(1, 'a;"b"', None)], "a int, b string, c string")).first().line
    assert lines == '1;"a;""b""";'


def attempts():
    t0 = T(2024, 1, 1)
    seq = [(0, 0), (1, 0), (2, 1), (3, 0), (4, 0), (5, 0), (6, 0), (7, 0), (8, 1), (21, 0), (22, 1), (1000, 0)]
    return [(1, i, t0 + dt.timedelta(minutes=m), bool(ok)) for i, (m, ok) in enumerate(seq)]


WANT = ["failed", "failed", "ok", "failed", "failed", "failed", "failed", "locked", "refused", "refused", "ok", "failed"]


def test_lockout(spark):
    df = spark.createDataFrame(attempts() + [(2, 100, T(2024, 1, 1), True)], "user_id long, attempt_id long, ts timestamp, ok boolean").repartition(4)
    got = {r.attempt_id: r.outcome for r in sessions.lockouts(df).collect()}
    assert [got[i] for i in range(12)] == WANT and got[100] == "ok"


def test_lockout_as_a_stream(spark, tmp_path):
    for n, part in enumerate((attempts()[:6], attempts()[6:])):
        spark.createDataFrame(part, "user_id long, attempt_id long, ts timestamp, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema("user_id long, attempt_id long, ts timestamp, ok boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = sessions.stream_lockouts(stream).writeStream.format("memory").queryName("locks").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.attempt_id: r.outcome for r in spark.table("locks").collect()}
    assert [got[i] for i in range(12)] == WANT


def test_sessions_end_at_the_hour(spark):
    s = spark.createDataFrame([("a", 1, T(2024, 1, 1, 0)), ("b", 1, T(2024, 1, 1, 0, 0, 1)), ("c", 2, T(2024, 1, 1, 7)), ("d", 3, T(2024, 1, 1, 7))], "token_hash string, user_id int, created_at timestamp")
    users = spark.createDataFrame([(1, "u", "r", True, None), (2, "v", "r", False, T(2025, 1, 1))], "user_id int, username string, role string, is_active boolean, locked_until timestamp")
    now = F.lit(T(2024, 1, 1, 8))
    assert [r.token_hash for r in sessions.live_sessions(s, users, now).collect()] == ["b"]
    assert [r.locked for r in sessions.locked_users(users, now).orderBy("user_id").collect()] == [False, True]


def test_repeated_loads(spark, tmp_path):
    spark.createDataFrame([("d", 1, "x")], "doc_id string, page int, text string").write.parquet(str(tmp_path / "in"))
    pages = lambda: spark.readStream.schema("doc_id string, page int, text string").parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):
        sessions.stream_loads(pages(), lambda batch, n: seen.append(batch.count()), str(tmp_path / "cp")).awaitTermination(120)
    assert seen == [1]


def test_entry_points(spark):
    import __spark_entry__ as e

    queries, oracles = e.queries(), e.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 40
    assert e.entry(spark).columns == ["id", "person_id", "score", "delta"]
    assert json.dumps(sorted(queries))


@pytest.mark.parametrize("name", ["timeline_delta", "top_bottom", "score_records", "upsert_merge", "year_gate"])
def test_queries_equal_their_sql(spark, name):
    from folioscope.plans import registry

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("customer", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want, got = con.sql(registry.ORACLES[name]).df(), registry.QUERIES[name](spark, sf).toPandas()

    def plain(p):
        cell = lambda x: None if x is None or x != x else str(x)[:10] if hasattr(x, "year") else str(x).removesuffix(".0")
        p = p[sorted(p.columns)].astype(object)
        return sorted((tuple(map(cell, r)) for r in p.where(p.notna(), None).itertuples(index=False, name=None)), key=str)

    assert sorted(want.columns) == sorted(got.columns) and plain(want) == plain(got)
