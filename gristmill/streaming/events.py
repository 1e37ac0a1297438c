"""Structured Streaming forms of event handling, and their batch equivalents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from gristmill.runtime import ship

ship(__name__)

# Fixed values.
PER_WINDOW, WINDOW_SECONDS = 60, 60
# End of fixed values.


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deliver_once(events: DataFrame, key: str = "delivery_id", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Each delivery id once, within the watermark; state is dropped after it."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def limit_rate(events: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "event_id", most: int = PER_WINDOW, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """`events` (key, ts, tie) with allowed and window_start: at most `most` per window, which starts at a key's first event after the last window.

    Windows of a key depend on those before, so a key is read in order by one task; it streams
    through sorted, and only one start and one count are held.
    """
    schema = f"{key} long, {tie} long, {ts} timestamp, window_start timestamp, allowed boolean"

    def run(frames):
        # rows come sorted by key and time within a partition; only the current key's state is held
        now, start, used = None, None, 0
        for p in frames:
            out = []
            for k, at, i in zip(p[key], p[ts], p[tie]):
                if k != now:
                    now, start, used = k, None, 0
                if start is None or (at - start).total_seconds() >= seconds:
                    start, used = at, 0
                used += 1
                out.append((k, i, at, start, used <= most))
            yield pd.DataFrame(out, columns=[key, tie, ts, "window_start", "allowed"])

    return events.select(key, tie, ts).where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, ts, tie).mapInPandas(run, schema)


def limit_rate_stream(events: DataFrame, key: str = "user_id", ts: str = "ts", most: int = PER_WINDOW, seconds: int = WINDOW_SECONDS, late: str = "1 hour") -> DataFrame:
    """The limiter as a stateful stream: (key, ts, allowed); a key's state times out one window after its last event."""

    def step(group, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(ts)
        out = []
        for at in rows[ts]:
            now = at.value // 1_000_000
            if start is None or now - start >= seconds * 1000:
                start, used = now, 0
            used += 1
            out.append((group[0], at, used <= most))
        state.update((start, used))
        state.setTimeoutTimestamp(max(start + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, ts, "allowed"])

    watched = events.select(key, ts).withWatermark(ts, late)
    return watched.groupBy(key).applyInPandasWithState(step, f"{key} long, {ts} timestamp, allowed boolean", "start long, used long", "append", GroupStateTimeout.EventTimeTimeout)


def stale_runs_stream(events: DataFrame, key: str = "run_id", ts: str = "ts", minutes: int = 10) -> DataFrame:
    """Runs without a final state `minutes` after their last event, as the watermark passes: (key, last, status)."""

    def step(group, frames, state):
        if state.hasTimedOut:
            last, status = state.get
            state.remove()
            yield pd.DataFrame([(group[0], pd.Timestamp(last, unit="ms"), status)], columns=[key, "last", "status"])
            return
        rows = pd.concat(list(frames)).sort_values(ts)
        last, status = int(rows[ts].iloc[-1].value // 1_000_000), str(rows["state"].iloc[-1])
        if status in ("pending", "running", "retrying"):
            state.update((last, status))
            state.setTimeoutTimestamp(max(last + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    watched = events.select(key, ts, "state").withWatermark(ts, "0 seconds")
    return watched.groupBy(key).applyInPandasWithState(step, f"{key} long, last timestamp, status string", "last long, status string", "append", GroupStateTimeout.EventTimeTimeout)


def weekly_stream(events: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """An extension: scans per tumbling week (from Monday), closed by the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "7 days", startTime="4 days")).agg(F.count("*").alias("scans")).select(F.col("window.start").alias("week"), "scans")


def drain(stream: DataFrame, name: str, checkpoint: str | None = None, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns the rows written: for tests and small replays."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def deadline_stream(events: DataFrame, deadline_s: int, grace_s: int, late: str = "0 seconds") -> DataFrame:
    """`accounts.deadline_outcomes` as a stream: (run_id, outcome, at), each as soon as an event or the watermark decides it.

    A started run holds a timer for its deadline, then one for its grace; settling cancels them. What is decided depends on event times
    only, to the millisecond, so an event that comes before a timer that lies before it has the timer's outcome first.
    """

    def step(group, frames, state):
        out = []
        start, phase = state.get if state.exists else (None, 0)  # phase: the next timer, 2 when all is decided

        def pass_timers(until: int) -> None:
            """Outcomes of the timers up to `until`, in milliseconds."""
            nonlocal phase
            for k, (name, at) in enumerate((("timed_out", start + deadline_s * 1000), ("leaked", start + (deadline_s + grace_s) * 1000))):
                if phase == k and until >= at:
                    out.append((name, at))
                    phase = k + 1

        if state.hasTimedOut:
            if start is not None:
                pass_timers(state.getCurrentWatermarkMs())
        else:
            rows = pd.concat(list(frames)).sort_values(["ts", "state"], ascending=[True, False])  # of one time, the start first
            for at, what in zip(rows["ts"], rows["state"]):
                now = at.value // 1_000_000
                if start is None and what == "started":
                    start = now
                elif start is not None and what == "settled" and phase < 2:
                    pass_timers(now)
                    if phase < 2:
                        out.append(("settled" if phase == 0 else "released", now))
                        phase = 2
        if start is not None:
            state.update((start, phase))
            due = start + (deadline_s + (grace_s if phase == 1 else 0)) * 1000
            if phase < 2:
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame([(group[0], name, pd.Timestamp(at, unit="ms")) for name, at in out], columns=["run_id", "outcome", "at"])

    watched = events.select("run_id", "ts", "state").withWatermark("ts", late)
    return watched.groupBy("run_id").applyInPandasWithState(step, "run_id long, outcome string, at timestamp", "start long, phase int", "append", GroupStateTimeout.EventTimeTimeout)


SPENT = "month string, month_spent long, day string, day_spent long, stopped string"


def _gate(spent: tuple, at: pd.Timestamp, scan: int, cost: int, recorded: bool, month_cap: int, day_cap: int) -> tuple[tuple, str]:
    """What has been spent after one call, and its decision: the cap that is reached, `unrecorded` in a scan that lost a write, else `allowed`."""
    month, month_spent, day, day_spent, stopped = spent
    if month != (this := at.strftime("%Y-%m")):
        month, month_spent, stopped = this, 0, ""
    if day != (this := at.strftime("%Y-%m-%d")):
        day, day_spent = this, 0
    decision = "monthly_exceeded" if month_spent >= month_cap else "daily_exceeded" if day_spent >= day_cap else "unrecorded" if f",{scan}," in stopped else "allowed"
    if decision == "allowed" and cost > 0:
        if recorded:
            month_spent, day_spent = month_spent + cost, day_spent + cost
        else:
            stopped = f"{stopped or ','}{scan},"
    return (month, month_spent, day, day_spent, stopped), decision


def spend_gate(calls: DataFrame, month_cap: int, day_cap: int) -> DataFrame:
    """org_id, seq, decision, month_spent (after the call) for calls (org_id, ts, seq, scan_id, cost, recorded), costs in millionths.

    A call is allowed while its org has spent less than both caps in the call's month and day (UTC); only allowed and recorded calls spend.
    After a call whose cost could not be recorded its scan makes no more. An org's decisions depend on those before: its calls stream through
    one task, sorted, and only sums are held.
    """

    def run(frames):
        now, spent = None, None
        for p in frames:
            out = []
            for org, at, seq, scan, cost, recorded in zip(p["org_id"], p["ts"], p["seq"], p["scan_id"], p["cost"], p["recorded"]):
                if org != now:
                    now, spent = org, ("", 0, "", 0, "")
                spent, decision = _gate(spent, at, scan, cost, recorded, month_cap, day_cap)
                out.append((org, seq, decision, spent[1]))
            yield pd.DataFrame(out, columns=["org_id", "seq", "decision", "month_spent"])

    rows = calls.select("org_id", "ts", "seq", "scan_id", "cost", "recorded").repartition("org_id").sortWithinPartitions("org_id", "ts", "seq")
    return rows.mapInPandas(run, "org_id long, seq long, decision string, month_spent long")


def spend_gate_stream(calls: DataFrame, month_cap: int, day_cap: int) -> DataFrame:
    """`spend_gate` as a stream over calls that come in time order: the sums live in keyed state, so a restart goes on where it stopped."""

    def step(group, frames, state):
        spent = state.get if state.exists else ("", 0, "", 0, "")
        out = []
        for r in pd.concat(list(frames)).sort_values(["ts", "seq"]).itertuples():
            spent, decision = _gate(spent, r.ts, r.scan_id, r.cost, r.recorded, month_cap, day_cap)
            out.append((group[0], r.seq, decision, spent[1]))
        state.update(spent)
        yield pd.DataFrame(out, columns=["org_id", "seq", "decision", "month_spent"])

    rows = calls.select("org_id", "ts", "seq", "scan_id", "cost", "recorded")
    return rows.groupBy("org_id").applyInPandasWithState(step, "org_id long, seq long, decision string, month_spent long", SPENT, "append", GroupStateTimeout.NoTimeout)
