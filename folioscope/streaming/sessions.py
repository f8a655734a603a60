"""Keyed state: login lockout, expiring sessions and repeated loads, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

FAILURES, LOCK_MINUTES, SESSION_HOURS = 5, 15, 8


def lockouts(attempts: DataFrame, failures: int = FAILURES, minutes: int = LOCK_MINUTES) -> DataFrame:
    """attempts (user_id, ts, attempt_id, ok) with outcome: ok, failed, locked (the attempt that locks) or refused (while locked).

    ``failures`` failed attempts without a success between lock for ``minutes``; the count starts anew on a lock and on a success, has no
    window of time, and nothing counts during a lock. What an attempt does depends on all before it, so a user's attempts are read in order
    in one task; what is carried from one to the next is a count and the end of a lock, however many there are. An attempt without a
    time comes first and locks for no time.
    """
    rows = attempts.select("user_id", "ts", "attempt_id", "ok").repartition("user_id").sortWithinPartitions("user_id", "ts", "attempt_id")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, count, until = object(), 0, None
        for batch in batches:
            out = []
            times = batch.column(1).cast(pa.int64()).to_pylist()
            for who, ts, ok in zip(batch.column(0).to_pylist(), times, batch.column(3).to_pylist(), strict=True):
                if who != user:
                    user, count, until = who, 0, None
                if until is not None and ts is not None and ts < until:
                    out.append("refused")
                    continue
                count = 0 if ok else count + 1
                if count >= failures:
                    count, until = 0, None if ts is None else ts + minutes * 60_000_000
                    out.append("locked")
                else:
                    out.append("ok" if ok else "failed")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "outcome"])

    schema = StructType([*rows.schema.fields, StructField("outcome", StringType())])
    return rows.mapInArrow(folded, schema).select("user_id", "attempt_id", "ts", "ok", "outcome")


def stream_lockouts(attempts: DataFrame, failures: int = FAILURES, minutes: int = LOCK_MINUTES) -> DataFrame:
    """The same as a stream: the state of a user is a count and the end of a lock."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, until = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "attempt_id"])
        out = []
        for ts, ok in zip(rows.ts, rows.ok, strict=True):
            now = int(ts.timestamp() * 1_000_000)
            if now < until:
                out.append("refused")
                continue
            count = 0 if ok else count + 1
            if count >= failures:
                count, until = 0, now + minutes * 60_000_000
                out.append("locked")
            else:
                out.append("ok" if ok else "failed")
        state.update((count, until))
        yield pd.DataFrame({"user_id": key[0], "attempt_id": rows.attempt_id, "outcome": out})

    return attempts.groupBy("user_id").applyInPandasWithState(fold, "user_id long, attempt_id long, outcome string", "count int, until long", "append", GroupStateTimeout.NoTimeout)


def live_sessions(sessions: DataFrame, users: DataFrame, now: Column, hours: int = SESSION_HOURS) -> DataFrame:
    """Sessions (token_hash, user_id, created_at) of active users that are younger than ``hours``; the last moment is already too late."""
    fresh = sessions.where(now < F.col("created_at") + F.expr(f"interval {hours} hours"))
    return fresh.join(users.where("is_active"), "user_id").select("token_hash", "user_id", "username", "role")


def locked_users(users: DataFrame, now: Column) -> DataFrame:
    return users.withColumn("locked", F.coalesce(F.col("locked_until") > now, F.lit(False)))


def stream_loads(pages: DataFrame, write, checkpoint: str):
    """Loads each batch of new pages by ``write(batch, batch_id)``; a batch that comes again must replace what it wrote before."""
    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
