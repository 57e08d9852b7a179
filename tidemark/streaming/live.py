"""Sessions, duplicates, rates and late rows of live input. Event times are TIMESTAMP; cast other kinds with `event_time`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.states import batch_states
from tidemark.sources.sinks import KeptByKey


def event_time(df: DataFrame, at: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP; times without a zone are taken as the session's."""
    return df.withColumn(at, F.col(at).cast("timestamp"))


def quiet_sessions(df: DataFrame, key: list[str], at: str = "ts", quiet: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """One row for each session once nothing has come for `quiet` and the watermark has passed."""
    w = F.session_window(at, quiet)
    return df.withWatermark(at, late).groupBy(w, *key).agg(F.count(F.lit(1)).alias("rows")).select(*key, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("past"), "rows")


class Settled(StatefulProcessor):
    """For each key the ids that are there and were not sent yet. When that set has not changed for `quiet` milliseconds it is sent as one."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "id string", "since long")
        self.sent = handle.getMapState("sent", "id string", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        changed, now = False, timerValues.getCurrentProcessingTimeInMs()
        for some in rows:
            for ident, there in zip(some["id"], some["there"], strict=True):
                held = self.pending.containsKey((ident,))
                if there and not held and not self.sent.containsKey((ident,)):
                    self.pending.updateValue((ident,), (now,))
                    changed = True
                elif not there and held:
                    self.pending.removeKey((ident,))
                    changed = True
        if changed:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if any(True for _ in self.pending.keys()):  # noqa: SIM118
                self.handle.registerTimer(now + self.quiet)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        ids = sorted(k[0] for k in self.pending.keys())  # noqa: SIM118
        at = timerValues.getCurrentProcessingTimeInMs()
        for ident in ids:
            self.sent.updateValue((ident,), (at,))
            self.pending.removeKey((ident,))
        if ids:
            yield pd.DataFrame({"key": [key[0]], "ids": [ids], "at_ms": [at]})

    def close(self) -> None:
        pass


def settled_sets(df: DataFrame, key: str, ident: str, there: str, quiet_seconds: float = 120.0) -> DataFrame:
    """key, ids and at_ms: of each key the set of ids that are there (`there` true; false takes one out again) and were never sent, once it has stayed the
    same for `quiet_seconds` of processing time. A set that changes begins to wait anew; an id that was sent is never sent again.

    Needs the RocksDB state store and a processing-time trigger. State is an entry an id: what is pending, and what was sent.
    """
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(ident).cast("string").alias("id"), F.coalesce(F.col(there), F.lit(False)).alias("there")).where("id is not null")
    return rows.groupBy("key").transformWithStateInPandas(Settled(int(1000 * quiet_seconds)), "key string, ids array<string>, at_ms long", "append", "processingTime")


def once(df: DataFrame, ident: str, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each id once, as long as its repeats come within the watermark."""
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark([ident])


def tumbling_counts(df: DataFrame, key: list[str], at: str = "ts", width: str = "8 minutes", late: str = "10 minutes") -> DataFrame:
    return df.withWatermark(at, late).groupBy(F.window(at, width), *key).agg(F.count(F.lit(1)).alias("rows")).select(*key, F.col("window.start").alias("start"), "rows")


def sliding_counts(df: DataFrame, key: list[str], limit: int, at: str = "ts", width: str = "1 minute", slide: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    """Windows in which a key has more than `limit` rows."""
    out = df.withWatermark(at, late).groupBy(F.window(at, width, slide), *key).agg(F.count(F.lit(1)).alias("rows"))
    return out.where(F.col("rows") > limit).select(*key, F.col("window.start").alias("start"), "rows")


def allowed_events(df: DataFrame, kind: str, kinds: list[str]) -> DataFrame:
    return df.where(F.col(kind).isin(kinds))


def late_rows(df: DataFrame, at: str, low: str, high: str, tolerance: float = 1.0) -> DataFrame:
    """`place` of a time in seconds against its bounds: inside, clamped (over by at most the tolerance, the time moved), or out of bounds."""
    over = F.greatest(F.col(low) - F.col(at), F.col(at) - F.col(high), F.lit(0.0))
    place = F.when(over == 0, "inside").when(over <= tolerance, "clamped").otherwise("outside_chunk_bounds")
    return df.withColumn("place", place).withColumn(at, F.when(place == "clamped", F.greatest(F.col(low), F.least(F.col(high), F.col(at)))).otherwise(F.col(at)))


def upsert_sink(path: str, key: list[str], at: str):
    """For foreachBatch: each batch's latest row of a key, one folder for each batch so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        best = batch.groupBy(*key).agg(F.max_by(F.struct(*batch.columns), at).alias("r")).select("r.*")
        best.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def refresh_on_change(uploads: KeptByKey, kept_states: KeptByKey, batches: DataFrame):
    """For foreachBatch: changes of uploads (batch_id, upload_id, state, cleanup_pending, at, deleted) are taken over, the last one of an upload by `at`, and the states of
    their batches alone are made anew, those that `states.batch_states` gives. Both tables are kept by buckets of batch_id; other buckets aren't read.
    A batch of changes that comes again changes nothing. Uploads of batches that aren't in `batches` are kept, without a state."""

    def write(changes: DataFrame, number: int) -> None:
        touched = uploads.touched(changes)
        if not touched:
            return
        new = changes.select("batch_id", "upload_id", "state", "cleanup_pending", "at", "deleted")
        rows = uploads.read(touched).unionByName(new).groupBy("batch_id", "upload_id").agg(F.max_by(F.struct("state", "cleanup_pending", "at", "deleted"), F.struct("at", "state", "deleted")).alias("r"))
        uploads.put(rows.select("batch_id", "upload_id", "r.*"), touched)  # deleted ones stay, marked, so that an older change can't bring them back
        now = uploads.read(touched)
        ids = new.select("batch_id").distinct()
        made = batch_states(batches.join(ids, "batch_id", "left_semi"), now.where("not deleted").join(ids, "batch_id", "left_semi"))
        columns = [f.name for f in kept_states.read([]).schema]
        kept_states.put(kept_states.read(touched).join(ids, "batch_id", "left_anti").unionByName(made.select(*columns)), touched)

    return write


def latest_status(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """key, at_ns and value of every key's latest row (the first of equals), state held by Spark; keys and values keep their types."""
    kinds = dict(df.dtypes)

    def step(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        for r in rows:
            for a, v in zip(r[at], r[value], strict=True):
                if best is None or a.value > best[0]:
                    best = (a.value, v)
        if best is not None:
            state.update(best)
            yield pd.DataFrame({"key": [k[0]], "at_ns": [best[0]], "value": [best[1]]})

    return df.groupBy(key).applyInPandasWithState(step, f"key {kinds[key]}, at_ns long, value {kinds[value]}", f"at long, value {kinds[value]}", "update", GroupStateTimeout.NoTimeout)
