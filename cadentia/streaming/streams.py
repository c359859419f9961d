"""Structured Streaming forms of scoring, sessions, checkpoints, dedup, adaptation, routing."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cadentia.functions.scalars import DAY_SECONDS
from cadentia.operators import profiles as P
from cadentia.operators.adaptation import (
    FULL_TRUST, MAX_ITERATIONS, RE_ANCHOR_DAYS, TOLERANCE, Settings, medians_of, within_budget,
)
from cadentia.sources import lake

# The four scoring points of a session; only the last may restrict or block.
CHECKPOINTS = ("login", "payee", "amount", "confirm")
FINAL_CHECKPOINT = "confirm"
SESSION_TTL_MS = 24 * 3600 * 1000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state on disk beside the executor, so that many keys do not fill the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_events(
    spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet", ts: str = "ts",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """File stream; a zone-less ``ts`` becomes a timestamp, as watermarks need one."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn(ts, F.col(ts).cast("timestamp"))


def run_to_table(stream: DataFrame, path: str, name: str, mode: str = "append") -> DataFrame:
    """Run everything available into a Parquet table and return that table."""
    spark = stream.sparkSession
    running = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{path}/{name}")
        .option("checkpointLocation", f"{path}/{name}-progress")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/{name}")


def stream_score(stream: DataFrame, profiles: DataFrame, subject, vector: str) -> DataFrame:
    """Stream-static join: the same columns as the batch score."""
    return P.anomaly_score(stream, profiles, subject, vector)


def stream_sessions(
    stream: DataFrame, user: str, ts: str, gap: str = "12 hours", late: str = "1 hour"
) -> DataFrame:
    """Sessions by inactivity, emitted once the watermark has passed their end."""
    window = F.session_window(ts, gap).alias("session")
    return stream.withWatermark(ts, late).groupBy(user, window).agg(
        F.count("*").alias("events"), F.max(ts).alias("last_event")
    ).select(user, F.col("session.start").alias("start"), "last_event", "events")


def stream_dedup(stream: DataFrame, keys: Sequence[str], ts: str, within: str) -> DataFrame:
    """Drop replays of the same keys that arrive within the watermark delay."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(list(keys))


NO_ID = -(2**63)


def _keyed(stream: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows with a time, one text ``_key`` for their key, and no null where pandas would turn whole numbers into floats."""
    key = F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"})
    timed = stream.where(F.col(ts).isNotNull()).withColumn("event_id", F.coalesce("event_id", F.lit(NO_ID)))
    return timed.withColumn("_key", key).drop(*keys)


def _unkeyed(out: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """The key columns back from ``_key``, in front."""
    key = F.from_json("_key", T.StructType([T.StructField(f.name, f.dataType) for f in fields]))
    rest = [F.when(F.col(c) != NO_ID, F.col(c)).alias(c) if c == "event_id" else F.col(c) for c in out.columns if c != "_key"]
    return out.withColumn("_fields", key).select(*[F.col("_fields")[f.name].alias(f.name) for f in fields], *rest)


class TakenInOrder(StatefulProcessor):
    """Rows of a key wait in list state until the watermark has passed them and are then taken by time.

    So the result does not depend on how rows are dealt to files and triggers. One timer per key is
    set, at the earliest moment at which something is due. Rows are tuples that begin with epoch seconds and an id.
    """

    row_schema = "at double, id long"
    columns: tuple[str, ...] = ("at", "event_id")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row_schema)
        self.wake = handle.getValueState("wake", "at long")

    def known(self, part: pd.DataFrame) -> pd.DataFrame:
        """The rows of a batch that count here."""
        return part

    def taken(self, key: tuple, rows: list[tuple], mark: int) -> pd.DataFrame | None:
        """Use rows that are older than the watermark, in order."""
        raise NotImplementedError

    def due(self) -> int | None:
        """When the state wants to be woken if no row comes."""
        return None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for part in map(self.known, rows):
            new += [tuple(plain(v) for v in row) for row in part[list(self.columns)].itertuples(index=False, name=None)]
        if new:
            self.waiting.appendList(new)
            self.set_timer(min(milliseconds(row[0]) for row in new) + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        self.wake.clear()
        rows = sorted(self.waiting.get(), key=lambda row: row[:2])
        ready = [row for row in rows if milliseconds(row[0]) < mark]
        rest = rows[len(ready):]
        if ready:
            self.waiting.clear()
            if rest:
                self.waiting.appendList(rest)
        self.rest = rest
        out = self.taken(key, ready, mark)
        moments = [m for m in (milliseconds(rest[0][0]) + 1 if rest else None, self.due()) if m is not None]
        if moments:
            self.set_timer(max(min(moments), mark + 1))
        if out is not None:
            yield out

    def set_timer(self, at: int) -> None:
        old = self.wake.get()[0] if self.wake.exists() else None
        if old is not None and old <= at:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.wake.update((at,))


def plain(value):
    """State takes Python values, not those of numpy."""
    return value.tolist() if isinstance(value, (np.ndarray, np.generic)) else value


# Sessions and keys share this many states: calls to the state store cost more than rows do.
BUCKETS = 4096
# Epochs whose candidates are solved together.
SOLVED = 4096


class Checkpoints(TakenInOrder):
    """Running sums of the open sessions of one bucket; a session lies in one bucket whole."""

    row_schema = "at double, id long, session string, step string, value double"
    # Names that begin with an underscore do not reach the state functions.
    columns = ("at", "event_id", "session_key", "step", "value")

    def __init__(self, steps: Mapping[str, str]) -> None:
        self.steps = dict(steps)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.sums = handle.getListState("sums", "session string, n long, total double, corrections long, since double, last double")

    def taken(self, key: tuple, rows: list[tuple], mark: int) -> pd.DataFrame | None:
        sums = {session: state for session, *state in self.sums.get()}
        # Sessions that have ended and wait for nothing are forgotten.
        busy = {row[2] for row in (*rows, *self.rest)}
        over = [s for s, (*_, last) in sums.items() if s not in busy and mark > milliseconds(last) + SESSION_TTL_MS]
        for session in over:
            del sums[session]
        out = []
        for at, event, session, step, value in rows:
            n, total, corrections, since, _ = sums.get(session, (0, 0.0, 0, at, None))
            n, total, corrections = n + 1, total + value, corrections + int(step == "correction")
            sums[session] = (n, total, corrections, since, at)
            name = self.steps.get(step)
            if name is not None:
                out.append((session, event, name, n, total / n, corrections / n, (at - since) / 3600))
        if sums:
            self.sums.put([(session, *state) for session, state in sums.items()])
        elif over:
            self.sums.clear()
        self.ends = min((milliseconds(last) + SESSION_TTL_MS + 1 for *_, last in sums.values()), default=None)
        names = ["_key", "event_id", "checkpoint", "events", "mean", "share", "hours"]
        return pd.DataFrame(out, columns=names) if out else None

    def due(self) -> int | None:
        return self.ends


def stream_checkpoints(
    stream: DataFrame, profiles: DataFrame, user: str, session: Sequence[str], steps: Mapping[str, str],
    step_up: float, restrict: float, block: float, ts: str = "ts", late: str = "1 hour", buckets: int = BUCKETS,
) -> DataFrame:
    """Score each session at its checkpoints with all evidence so far, against the user's own profile.

    Reads ``event_id``, ``ts``, ``at`` (the same in epoch seconds), ``step`` and ``value``; ``steps``
    maps a step to a checkpoint; ``profiles`` holds user, ``centre`` and ``dispersion``. Features are
    the mean value, the share of corrections and the hours since the start. Only at
    the last checkpoint may the action be restrict or block. A user without a profile
    has no score and is stepped up.

    Rows without a time, or later than ``late``, are dropped. Sessions are dealt to ``buckets`` states by a hash of
    their key. A session's state is five numbers and the rows of the last ``late`` span; an event-time timer
    clears it a day after its last event. (State with a time to live of its own expires by the wall clock,
    which a replay would not follow.) Features meet the profiles behind the state, which holds none.
    """
    use_rocksdb(stream.sparkSession)
    keys = list(dict.fromkeys([*session, user]))
    named = _keyed(stream, keys, ts).withColumnRenamed("_key", "session_key")
    dealt = named.withColumn("_bucket", F.pmod(F.xxhash64("session_key"), F.lit(buckets)))
    schema = "_key string, event_id long, checkpoint string, events long, mean double, share double, hours double"
    found = dealt.withWatermark(ts, late).groupBy("_bucket").transformWithStateInPandas(
        Checkpoints(steps), schema, "Append", "EventTime"
    )
    met = _unkeyed(found, [stream.schema[k] for k in keys]).join(profiles.select(user, "centre", "dispersion"), user, "left")
    score = P.score_of(F.array("mean", "share", "hours"), F.col("centre"), F.col("dispersion"))
    return met.withColumn("score", score).select(
        *session, "event_id", "checkpoint", "events", "score",
        action_at(F.col("checkpoint"), F.col("score"), step_up, restrict, block).alias("action"),
    )


def milliseconds(at: float) -> int:
    """Whole milliseconds of epoch seconds, as the watermark counts them."""
    return round(at * 1e6) // 1000


def action_at(checkpoint: Column, score: Column, step_up: float, restrict: float, block: float) -> Column:
    last = checkpoint == FINAL_CHECKPOINT
    return (
        F.when(score.isNull(), "step_up")
        .when(last & (score >= block), "block")
        .when(last & (score >= restrict), "restrict")
        .when(score >= step_up, "step_up")
        .otherwise("allow")
    )


class Adapting(TakenInOrder):
    """Buffers, anchors and open epochs of the keys of one bucket; their enrolment profiles are its initial state.

    What an epoch's candidate is depends on its buffer alone, so the epochs that a moment closes are solved together and
    only then bounded one after the other.
    """

    row_schema = "at double, id long, owner string, tau double, x array<double>"
    columns = ("at", "event_id", "owner", "tau", "x")

    def __init__(self, settings: Settings, life: int) -> None:
        self.settings, self.life = settings, life

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.anchors = handle.getListState("anchors", "owner string, centre array<double>, dispersion array<double>, calm_since long")
        self.open = handle.getListState("open", "owner string, epoch long, fresh int, vouched int, day long, last double")
        self.buffers = handle.getListState("buffers", "owner string, tau double, x array<double>")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        begun = initialState[["owner", "centre", "dispersion"]].itertuples(index=False, name=None)
        self.anchors.appendList([(*(plain(v) for v in row), None) for row in begun])

    def known(self, part: pd.DataFrame) -> pd.DataFrame:
        return part[part["owner"].isin({owner for owner, *_ in self.anchors.get()})]

    def taken(self, key: tuple, rows: list[tuple], mark: int) -> pd.DataFrame | None:
        settings, closed = self.settings, []
        opened = {owner: state for owner, *state in self.open.get()}
        buffers: dict[str, list[tuple]] = {}
        for owner, tau, x in self.buffers.get():
            buffers.setdefault(owner, []).append((tau, x))

        def close(owner: str, state: list, at: int) -> None:
            state[0] += 1
            closed.append((owner, state[0], at, bool(state[2]), list(buffers[owner])))
            state[1] = state[2] = 0

        for at, _, owner, tau, x in rows:
            state, buffer = opened.setdefault(owner, [0, 0, 0, None, None]), buffers.setdefault(owner, [])
            today = int(at // DAY_SECONDS)
            if settings.nightly and state[1] and today > state[3]:
                close(owner, state, (state[3] + 1) * DAY_SECONDS)
            buffer.append((tau, x))
            del buffer[: -settings.buffer]
            state[1:] = state[1] + 1, max(state[2], int(tau >= FULL_TRUST)), today, at
            if state[1] == settings.every:
                close(owner, state, int(at))  # whole seconds, as in the batch form
        busy, silent, moments = {row[2] for row in (*rows, *self.rest)}, False, []
        for owner, state in opened.items():
            _, fresh, _, day, last = state
            if settings.nightly and fresh and mark > (day + 1) * DAY_SECONDS * 1000:
                close(owner, state, (day + 1) * DAY_SECONDS)
            if owner in buffers and owner not in busy and mark > milliseconds(last) + self.life:
                del buffers[owner]
                silent = True
            if settings.nightly and state[1]:
                moments.append((day + 1) * DAY_SECONDS * 1000 + 1)
            elif owner in buffers:
                moments.append(milliseconds(last) + self.life + 1)
        self.ends = min(moments, default=None)
        out = self.recomputed(closed) if closed else None
        if rows or closed:
            self.open.put([(owner, *state) for owner, state in opened.items()])
        if buffers and (rows or silent):
            self.buffers.put([(owner, *row) for owner, buffer in buffers.items() for row in buffer])
        elif silent:
            self.buffers.clear()
        return out

    def recomputed(self, closed: list[tuple]) -> pd.DataFrame:
        """The profiles that epochs leave: candidates from their buffers, bounded by the budget around the anchors."""
        anchors, settings, out = {owner: state for owner, *state in self.anchors.get()}, self.settings, []
        for begin in range(0, len(closed), SOLVED):
            some = closed[begin : begin + SOLVED]
            clouds = [np.asarray([x for _, x in buffer], dtype=float) for *_, buffer in some]
            widths = np.asarray([cloud.shape[1] for cloud in clouds])
            found: list = [None] * len(some)
            for width in np.unique(widths):
                same = np.flatnonzero(widths == width)
                mass = np.asarray([tau for i in same for tau, _ in some[i][-1]], dtype=float)
                sizes = np.asarray([len(clouds[i]) for i in same])
                middles, wides = medians_of(np.concatenate([clouds[i] for i in same]), mass, sizes, TOLERANCE, MAX_ITERATIONS)
                for i, middle, wide in zip(same, middles, wides, strict=True):
                    found[i] = middle, wide
            for (owner, epoch, at, vouched, _), (middle, wide) in zip(some, found, strict=True):
                centre, spread, calm_since = anchors[owner]
                new, width, distance, _, over = within_budget(
                    middle, wide, np.asarray(centre), np.asarray(spread), settings.budget, settings.floor
                )
                if over or calm_since is None:
                    calm_since = at
                due = vouched or at - calm_since >= RE_ANCHOR_DAYS * DAY_SECONDS
                new, width = new.tolist(), width.tolist()
                anchors[owner] = (new, width, at) if due else (centre, spread, calm_since)
                out.append((owner, epoch, new, width, min(distance, settings.budget), int(over), int(due)))
        self.anchors.put([(owner, *state) for owner, state in anchors.items()])
        names = ["_key", "epoch", "centre", "dispersion", "displacement", "saturated", "re_anchored"]
        return pd.DataFrame(out, columns=names)

    def due(self) -> int | None:
        return self.ends


def stream_adapt(
    verified: DataFrame, start: DataFrame, keys: Sequence[str], settings: Settings, ts: str = "ts", late: str = "1 hour",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Robust adaptation as a stream: one row per recomputed profile.

    ``verified`` holds ``event_id``, ``ts``, ``at`` (the same in epoch seconds), ``x`` and ``tau``;
    ``start`` the published enrolment profiles, which become the initial state of their keys; other keys
    leave no state. Sessions without enough trust never reach the state. An epoch closes at every
    ``every``-th session and, where the settings say so, by a timer at midnight. Keys are dealt to ``buckets``
    states by a hash. A key takes one buffer, one anchor and the rows of the last ``late`` span there; a key that is
    silent for the life of a buffer keeps its anchor and the number of its epochs only.
    """
    use_rocksdb(verified.sparkSession)
    # Filtered first, so that the watermark follows the sessions that count.
    trusted = _keyed(verified.where(F.col("tau") >= settings.tau_min), keys, ts).withColumnRenamed("_key", "owner")
    bucket = F.pmod(F.xxhash64("owner"), F.lit(buckets))
    schema = (
        "_key string, epoch long, centre array<double>, dispersion array<double>, displacement double, saturated int, re_anchored int"
    )
    life = lake.RETENTION_DAYS["buffer"] * DAY_SECONDS * 1000
    begun = start.select(
        F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"}).alias("owner"), "centre", "dispersion"
    ).withColumn("_bucket", bucket).groupBy("_bucket")
    dealt = trusted.withColumn("_bucket", bucket).withWatermark(ts, late).groupBy("_bucket")
    found = dealt.transformWithStateInPandas(Adapting(settings, life), schema, "Append", "EventTime", begun)
    return _unkeyed(found, [verified.schema[k] for k in keys])


def append_closing(
    spark: SparkSession, path: str, schema: T.StructType, ts: str = "ts", days: int = 2, **values
) -> None:
    """Add a last file with one row whose time moves the watermark past all rows of the folder.

    The closing row has the given values (columns may use ``ts``) and else only nulls; it waits in the state of the
    null key and is never taken. File sources take files by their age, so it is read last.
    """
    newest = F.max(F.col(ts).cast("timestamp"))
    end = spark.read.schema(schema).parquet(path).agg((newest + F.expr(f"INTERVAL {days} DAYS")).alias(ts))
    closing = end.where(F.col(ts).isNotNull()).select(
        *[F.col(ts) if f.name == ts else F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in schema]
    )
    closing.write.mode("append").parquet(path)


def closed_table(rows: DataFrame, path: str, ts: str = "ts", days: int = 2, **values) -> str:
    """Write rows for a replay that is to return all of them: a table and its closing row."""
    rows.write.parquet(path)
    append_closing(rows.sparkSession, path, rows.schema, ts, days, **values)
    return path


def stream_route(decisions: DataFrame, root: str, progress: str):
    """Apply the three routing rules to every micro-batch; a replayed batch replaces itself."""

    def route(batch: DataFrame, number: int) -> None:
        lake.route_events(batch, root, number)

    return (
        decisions.writeStream.foreachBatch(route)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
