"""Streams return every row, however events are dealt to files and triggers, and agree with the batch."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadentia.operators import adaptation as A
from cadentia.streaming import streams as L

STEPS = {"open": "login", "name": "payee", "sum": "amount", "send": "confirm"}
SCHEMA = "event_id long, user long, at double, step string, value double"
NAMES = {"u": 1, "w": 2, "new": 3, "later": 4, None: None}
DAY = 1_700_000_000.0
EVENTS = [
    (1, "u", DAY, "open", 2.0), (2, "u", DAY + 60, "correction", 4.0), (3, "u", DAY + 120, "sum", 9.0),
    (4, "u", DAY + 180, "send", 30.0), (5, "w", DAY + 30, "open", 2.0), (6, "w", DAY + 90, "send", 2.0),
    (7, "new", DAY + 10, "open", 1.0), (8, "later", DAY + 90_000, "open", 1.0),
    (None, None, DAY + 50, "open", 1.0), (9, None, DAY + 55, "send", 1.0),
]


def played(spark, folder, files, per_trigger):
    for number, part in enumerate(files):
        rows = spark.createDataFrame([(i, NAMES[u], *rest) for i, u, *rest in part], SCHEMA).coalesce(1)
        rows.withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    L.append_closing(spark, folder, schema, at=F.unix_micros("ts") / 1e6, event_id=0, step="", value=0.0)
    stream = L.read_events(spark, folder, schema, files_per_trigger=per_trigger)
    profiles = spark.createDataFrame(
        [(NAMES[u], [2.0, 0.1, 0.1], [1.0, 0.1, 0.1]) for u in ("u", "w")], "user long, centre array<double>, dispersion array<double>"
    )
    found = L.stream_checkpoints(stream, profiles, "user", ["user"], STEPS, step_up=3.0, restrict=5.0, block=8.0)
    done = L.run_to_table(found, f"{folder}-out", "scores").collect()
    return {r.event_id: (r.checkpoint, r.events, None if r.score is None else round(r.score, 6), r.action) for r in done}


def test_same_rows_for_one_and_for_many_triggers(spark, tmp_path):
    together = played(spark, str(tmp_path / "one"), [EVENTS], None)
    # The last event comes first to nobody; the others arrive in reverse, one file a trigger.
    apart = played(spark, str(tmp_path / "many"), [[e] for e in reversed(EVENTS[:-3])] + [EVENTS[-2:], EVENTS[-3:-2]], 1)
    assert together == apart
    assert set(together) == {1, 3, 4, 5, 6, 7, 8, None, 9}
    mean, share, hours = (2 + 4 + 9 + 30) / 4, 1 / 4, 180 / 3600
    score = abs(mean - 2) + abs(share - 0.1) / 0.1 + abs(hours - 0.1) / 0.1
    assert together[4] == ("confirm", 4, pytest.approx(score, abs=1e-6), "block")
    assert together[6][3] == "allow" and together[7] == together[8] == together[None] == ("login", 1, None, "step_up")
    assert together[9] == ("confirm", 2, None, "step_up")


class Counted:
    """State of one bucket that counts the calls made to it."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def getListState(self, name, schema):
        return State(self, name)

    getValueState = getListState

    def registerTimer(self, at):
        self.calls += 1

    deleteTimer = registerTimer


class State:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def get(self):
        self.handle.calls += 1
        return self.handle.rows.get(self.name, [])

    def put(self, rows):
        self.handle.calls += 1
        self.handle.rows[self.name] = rows

    update = put

    def appendList(self, rows):
        self.put([*self.handle.rows.get(self.name, []), *rows])

    def exists(self):
        return bool(self.get())

    def clear(self):
        self.put([])


class Mark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return round(self.at * 1000)


def test_sessions_of_a_bucket_share_the_calls_to_the_state():
    calls = []
    for sessions in (3, 300):
        handle, each = Counted(), L.Checkpoints(STEPS)
        each.init(handle)
        rows = [(DAY + i, 2 * i, f"s{i}", "open", 1.0) for i in range(sessions)]
        rows += [(DAY + 400 + i, 2 * i + 1, f"s{i}", "send", 3.0) for i in range(sessions)]
        list(each.handleInputRows((0,), iter([pd.DataFrame(rows, columns=each.columns)]), None))
        (out,) = each.handleExpiredTimer((0,), Mark(DAY + 1000), None)
        assert out["mean"].tolist() == [1.0] * sessions + [2.0] * sessions and set(out["hours"]) == {0.0, 400 / 3600}
        calls.append(handle.calls)
        assert len(handle.rows["sums"]) == sessions
        list(each.handleExpiredTimer((0,), Mark(DAY + 100_000), None))
        assert handle.rows["sums"] == [] and each.due() is None
    assert calls[0] == calls[1] < 20


ADAPT = "user string, event_id long, at double, tau double, x array<double>"


def adapted(spark, folder, rows, start, settings, files, per_trigger):
    size = -(-len(rows) // files)
    for i in range(0, len(rows), size):
        part = spark.createDataFrame(rows[i : i + size], ADAPT).coalesce(1)
        part.withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    L.append_closing(spark, folder, schema, at=F.unix_micros("ts") / 1e6, event_id=0, tau=1.0)
    stream = L.read_events(spark, folder, schema, files_per_trigger=per_trigger)
    found = L.stream_adapt(stream, start, ["user"], settings)
    done = L.run_to_table(found, f"{folder}-out", "profiles").collect()
    return {(r.user, r.epoch): ([round(c, 6) for c in r.centre], round(r.displacement, 6), r.saturated, r.re_anchored) for r in done}


@pytest.mark.parametrize("nightly", [True, False])
def test_adaptation_agrees_with_the_batch_for_one_and_seven_triggers(spark, tmp_path, nightly):
    rnd = random.Random(2)
    settings = A.Settings(every=3, buffer=5, budget=0.8, nightly=nightly)
    midnight = 1_700_006_400.0
    rows = [("u", 0, midnight, 0.6, [1.0, 0.0]), ("u", 1, midnight + 86_399.5, 0.6, [1.1, 0.1])]
    for i in range(2, 60):
        user = rnd.choice(["u", "w", "nobody"])
        at = midnight + 3600 * (i * 6 + rnd.randint(0, 4)) + rnd.random()
        rows.append((user, i, at, rnd.choice([0.3, 0.6, 0.6, 1.0]), [rnd.gauss(i / 20, 1.0), rnd.gauss(0, 1)]))
    start = spark.createDataFrame(
        [(u, [0.0, 0.0], [1.0, 1.0]) for u in ("u", "w")], "user string, centre array<double>, dispersion array<double>"
    )
    stored = spark.createDataFrame(rows, ADAPT).withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")))
    known = stored.where("tau >= 0.5").join(start.select("user"), "user")
    epochs = A.re_anchor(A.epoch_candidates(known, ["user"], ["ts", "event_id"], "x", settings), ["user"], start, settings)
    batch = {
        (r.user, r.epoch): ([round(c, 6) for c in r.centre], round(r.displacement, 6), r.saturated, r.re_anchored)
        for r in epochs.collect()
    }
    one = adapted(spark, str(tmp_path / "one"), rows, start, settings, 1, None)
    seven = adapted(spark, str(tmp_path / "seven"), rows, start, settings, 7, 1)
    assert batch == one == seven
    assert len(batch) > (15 if nightly else 8) and {u for u, _ in batch} == {"u", "w"}


def test_keys_of_a_bucket_share_the_calls_to_the_state():
    calls = []
    for users in (3, 300):
        handle, each = Counted(), L.Adapting(A.Settings(every=2, buffer=3, budget=5.0), 10**9)
        each.init(handle)
        begun = pd.DataFrame({"owner": [f"u{i}" for i in range(users)], "centre": [[0.0]] * users, "dispersion": [[1.0]] * users})
        each.handleInitialState((0,), begun, None)
        rows = [(DAY + j, j, f"u{i}", 1.0, [float(i)]) for i in range(users) for j in range(4)]
        rows.append((DAY, 9, "nobody", 1.0, [1.0]))
        list(each.handleInputRows((0,), iter([pd.DataFrame(rows, columns=each.columns)]), None))
        (out,) = each.handleExpiredTimer((0,), Mark(DAY + 1000), None)
        assert sorted(zip(out["_key"], out["epoch"])) == sorted((f"u{i}", e) for i in range(users) for e in (1, 2))
        first = out[out["epoch"] == 1].set_index("_key")["centre"]
        assert [first[f"u{i}"] for i in range(3)] == [[0.0], [1.0], [2.0]]
        calls.append(handle.calls)
        assert len(handle.rows["buffers"]) == 3 * users
        list(each.handleExpiredTimer((0,), Mark(DAY + 2_000_000), None))
        assert handle.rows["buffers"] == [] and len(handle.rows["anchors"]) == users and each.due() is None
    assert calls[0] == calls[1] < 20
