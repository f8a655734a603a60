"""Sessions as keyed state of a stream: timers that end them in event time, or state that lapses by itself in processing time."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from folioscope.streaming.sessions import SESSION_HOURS

OUTCOMES = "token_hash string, user_id long, ts timestamp, expires_at timestamp, outcome string"
#: Keys of the state; a bucket holds the open sessions of its tokens.
BUCKETS = 4096
_ROCKS, _IDLE = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"


@contextlib.contextmanager
def state_store(spark: SparkSession, idle_batches: bool = True):
    """Inside, streams start with the state store that timers and lapsing state need, and run batches without rows for the sake of time or not."""
    wanted = {_ROCKS: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", _IDLE: str(idle_batches).lower()}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class ExpiringSessions(StatefulProcessor):
    """The open sessions of one bucket of tokens: their users, moments of creation and last milliseconds, until they end.

    Each batch reads and writes the state of a bucket once, and its rows are judged as whole columns, so the work goes by rows rather than by calls for each token.
    In event time one timer, at the first end of the bucket, purges what has ended and reports ``purged``. In processing time (``lapse_ms``) sessions
    have a time to live since their row was handled, and go without a row; there is no timer, and the state of a bucket that nothing comes to goes by itself.
    """

    def __init__(self, hours: float, lapse_ms: int | None = None):
        self.life, self.lapse_ms = int(hours * 3_600_000_000), lapse_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "token_hash array<string>, user_id array<long>, created array<long>, until array<long>", ttlDurationMs=self.lapse_ms)

    def _known(self) -> pd.DataFrame:
        found = self.open.get() if self.open.exists() else ([], [], [], [])
        return pd.DataFrame({"token_hash": pd.Series(found[0], dtype=object), **{n: np.array(v, dtype="int64") for n, v in zip(("user_id", "created", "until"), found[1:], strict=True)}})

    def _keep(self, known: pd.DataFrame) -> None:
        if known.empty:
            self.open.clear()
        else:
            self.open.update(tuple(known[n].tolist() for n in ("token_hash", "user_id", "created", "until")))

    def _set_timer(self, before: pd.DataFrame, after: pd.DataFrame) -> None:
        """The bucket's timer, moved to the first end of ``after``."""
        old, new = (None if x.empty else int(x.until.min()) for x in (before, after))
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)

    @staticmethod
    def _rows(token, user, now, ends, outcome) -> pd.DataFrame:
        moment = lambda x: pd.to_datetime(pd.array(x, dtype="Int64"), unit="us")
        return pd.DataFrame({"token_hash": token, "user_id": user, "ts": moment(now), "expires_at": moment(ends), "outcome": outcome})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self._known()
        known = before
        if self.lapse_ms is not None:
            clock = timerValues.getCurrentProcessingTimeInMs()
            known = known[known.until > clock]
        # Of a token's events at one moment the creation is first.
        events = pd.concat(list(rows))
        events = events.assign(now=events.ts.to_numpy("datetime64[us]").astype("int64")).sort_values(["token_hash", "now", "kind", "user_id"], ignore_index=True)
        at = pd.Index(known.token_hash).get_indexer(events.token_hash)
        creates = (events.kind == "create").to_numpy()
        first = events[creates & (at < 0)].drop_duplicates("token_hash")
        opened = pd.DataFrame({"token_hash": first.token_hash, "user_id": first.user_id.astype("int64"), "created": first.now})
        # A timer counts milliseconds, so it goes off up to one late, and never early. Where the end has passed already, it goes off with this batch's watermark.
        opened["until"] = -(-(opened.created + self.life) // 1000) if self.lapse_ms is None else clock + self.lapse_ms
        after = pd.concat([known, opened], ignore_index=True)
        # The session of a row: one that was open before, or the one that this row or an earlier one opens.
        place = pd.Index(opened.token_hash).get_indexer(events.token_hash)
        opens_at = np.append(opened.index.to_numpy(), len(events))[place]
        its = np.where(at >= 0, at, np.where((place >= 0) & (opens_at <= events.index), place + len(known), -1))
        user = pd.array(np.append(after.user_id.to_numpy(), 0)[its], dtype="Int64")
        ends = pd.array(np.append(after.created.to_numpy(), 0)[its] + self.life, dtype="Int64")
        user[its < 0], ends[its < 0] = pd.NA, pd.NA
        now = events.now.to_numpy()
        in_time = now < np.append(after.created.to_numpy(), 0)[its] + self.life
        opening = creates & (at < 0) & (opens_at == events.index)
        outcome = np.select([opening, creates, its < 0, in_time], ["opened", "repeated", "unknown", "live"], "expired")
        if len(opened) or len(known) < len(before):
            self._keep(after)
        if self.lapse_ms is None:
            self._set_timer(before, after)
        yield self._rows(events.token_hash, user, now, ends, outcome)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._known()
        # All that a timer of their own would have ended by now.
        over = known.until <= max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        gone, left = known[over], known[~over]
        if len(gone):
            self._keep(left)
            if len(left):
                self.handle.registerTimer(int(left.until.min()))
            ends = gone.created + self.life
            yield self._rows(gone.token_hash, gone.user_id.astype("Int64"), ends, ends, "purged")

    def close(self) -> None:
        pass


def _events(events: DataFrame) -> DataFrame:
    """The rows that have a part, with the bucket of their token."""
    rows = events.select(F.col("token_hash").cast("string"), F.col("user_id").cast("long"), F.col("ts").cast("timestamp"), F.col("kind").cast("string"))
    rows = rows.where("token_hash is not null and ts is not null and (kind = 'use' or kind = 'create' and user_id is not null)")
    return rows.withColumn("bucket", F.pmod(F.xxhash64("token_hash"), F.lit(BUCKETS)).cast("int"))


def stream_sessions(events: DataFrame, hours: float = SESSION_HOURS, delay: str = "0 seconds") -> DataFrame:
    """Outcomes of a stream of events (token_hash, user_id, ts, kind: create or use) in event time.

    ``create`` opens a session for ``hours``, once for each token (``repeated`` changes nothing: a session isn't made longer). A use is ``live``, ``expired``
    (also at the last moment) or ``unknown``. When the watermark, ``delay`` behind the latest event, reaches a session's end, a row ``purged`` with that
    moment leaves and the state is gone; later uses are unknown. Rows without a token, time or kind have no part.
    Tokens are dealt to buckets by hash, so a busy user is no hot key.
    """
    return _events(events).withWatermark("ts", delay).groupBy("bucket").transformWithStateInPandas(ExpiringSessions(hours), OUTCOMES, "append", "eventTime")


def stream_lapsing_sessions(events: DataFrame, hours: float = SESSION_HOURS) -> DataFrame:
    """The same by the clock: a session has a time to live of ``hours`` since its row was handled, after which its token is unknown."""
    return _events(events).groupBy("bucket").transformWithStateInPandas(ExpiringSessions(hours, int(hours * 3_600_000)), OUTCOMES, "append", "processingTime")


def still_open(outcomes: DataFrame) -> DataFrame:
    """(token_hash, user_id, created_at) of the sessions that were opened and not purged, from the rows that a stream has written."""
    ends = outcomes.where("outcome in ('opened', 'purged')").groupBy("token_hash")
    found = ends.agg(F.max(F.when(F.col("outcome") == "opened", F.struct("user_id", "ts"))).alias("o"), F.bool_or(F.col("outcome") == "purged").alias("purged"))
    return found.where("not purged and o is not null").select("token_hash", "o.user_id", F.col("o.ts").alias("created_at"))


def _run(outcomes: DataFrame, output: str, checkpoint: str, idle_batches: bool) -> DataFrame:
    spark = outcomes.sparkSession
    with state_store(spark, idle_batches):
        stream = outcomes.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        stream.awaitTermination()
    return spark.read.schema(OUTCOMES).parquet(output)


def run_sessions(events: DataFrame, output: str, checkpoint: str, hours: float = SESSION_HOURS, delay: str = "0 seconds") -> DataFrame:
    """All events that are there by now as a stream to the end, whose outcomes are added to Parquet files in ``output``; returns these."""
    return _run(stream_sessions(events, hours, delay), output, checkpoint, True)


def run_lapsing_sessions(events: DataFrame, output: str, checkpoint: str, hours: float = SESSION_HOURS) -> DataFrame:
    """The same by the clock. A stream that follows the clock never runs out of batches without rows, so it does without them."""
    return _run(stream_lapsing_sessions(events, hours), output, checkpoint, False)
