"""Streaming queries: each runs the event file as a stream and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadentia.catalog import adapting
from cadentia.catalog.adapting_sql import KEY, WIDE, anchor_sql
from cadentia.catalog.deciding import ROUTED_TOTALS, routed_totals
from cadentia.catalog.registry import query
from cadentia.catalog.views import EVENTS, events, table
from cadentia.operators import profiles as P
from cadentia.operators.trust import VERIFY_STEP_UP
from cadentia.session import materialise, scratch_path
from cadentia.sources import lake
from cadentia.streaming import streams as L

STEPS = {"signup": "login", "view": "payee", "click": "amount", "purchase": "confirm"}


def stream(spark, folder):
    schema = table(spark, folder, "events").schema
    raw = L.read_events(spark, folder, schema, "events.parquet")
    return raw.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def measured(df):
    return df.withColumn("x", F.array("value", F.hour("ts").cast("double"))).select(
        "event_id", "user_id", "x"
    )


@query("stream_score", "WITH " + EVENTS + """,
m AS (SELECT user_id, avg(value) AS c0, avg(hour(ts)) AS c1 FROM ev GROUP BY 1 HAVING count(*) >= 2),
d AS (SELECT ev.user_id, any_value(c0) AS c0, any_value(c1) AS c1, greatest(avg(abs(value - c0)), 1e-4) AS d0, greatest(avg(abs(hour(ts) - c1)), 1e-4) AS d1
      FROM ev JOIN m ON ev.user_id = m.user_id GROUP BY 1)
SELECT event_id, round(abs(value - c0) / d0 + abs(hour(ts) - c1) / d1, 6) AS score FROM ev JOIN d ON ev.user_id = d.user_id""")
def _(spark, folder):
    # Stored once; a micro-batch joins the table and does not fit again.
    profiles = materialise(P.fit_profiles(measured(events(spark, folder)), "user_id", "x"), "profiles")
    scored = L.stream_score(measured(stream(spark, folder)), profiles, "user_id", "x")
    done = L.run_to_table(scored.select("event_id", "score"), scratch_path(spark, "scored"), "scores")
    return done.select("event_id", F.round("score", 6).alias("score"))


@query("stream_sessions", "WITH " + EVENTS + """,
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS opens FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g),
s AS (SELECT user_id, no, min(ts) AS a, max(ts) AS b, count(*) AS events FROM n GROUP BY 1, 2)
SELECT user_id, epoch_us(a) AS start, epoch_us(b) AS last_event, events FROM s
WHERE b + INTERVAL 12 HOUR <= (SELECT max(ts) FROM ev) - INTERVAL 1 HOUR""")
def _(spark, folder):
    found = L.stream_sessions(stream(spark, folder), "user_id", "ts")
    done = L.run_to_table(found, scratch_path(spark, "sessions"), "sessions")
    return done.withColumn("start", F.unix_micros("start")).withColumn("last_event", F.unix_micros("last_event"))


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, folder):
    kept = L.stream_dedup(stream(spark, folder), ["user_id", "event_type"], "ts", "60 days")
    done = L.run_to_table(kept, scratch_path(spark, "dedup"), "kept")
    return done.select("user_id", "event_type")


def step_profiles(spark, folder):
    """Per user: centre and spread of value, correction, and hours since the day's first event."""
    ev = events(spark, folder).withColumn("day", F.to_date("ts"))
    begins = ev.groupBy("user_id", "day").agg(F.min("ts").alias("begin"))
    hours = (F.unix_micros("ts") - F.unix_micros("begin")) / 3.6e9
    fix = (F.col("event_type") == "error").cast("double")
    rows = ev.join(begins, ["user_id", "day"]).select("user_id", F.array("value", fix, hours).alias("x"))
    return materialise(P.fit_profiles(rows, "user_id", "x"), "step-profiles")


@query("stream_checkpoints", "WITH " + EVENTS + """,
dy AS (SELECT *, CAST(ts AS DATE) AS day, (event_type = 'error')::INTEGER::DOUBLE AS fix FROM ev),
px AS (SELECT user_id, value, fix, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id, day))) / 3.6e9 AS hrs FROM dy),
pm AS (SELECT user_id, avg(value) AS m0, avg(fix) AS m1, avg(hrs) AS m2 FROM px GROUP BY 1 HAVING count(*) >= 2),
pf AS (SELECT user_id, any_value(m0) AS m0, any_value(m1) AS m1, any_value(m2) AS m2, greatest(avg(abs(value - m0)), 1e-4) AS s0,
         greatest(avg(abs(fix - m1)), 1e-4) AS s1, greatest(avg(abs(hrs - m2)), 1e-4) AS s2 FROM px JOIN pm USING (user_id) GROUP BY 1),
a AS (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS mv, avg(fix) OVER w AS cr,
        (epoch_us(ts) - epoch_us(first_value(ts) OVER w)) / 3.6e9 AS hrs
      FROM dy WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, abs(mv - m0) / s0 + abs(cr - m1) / s1 + abs(hrs - m2) / s2 AS score FROM a LEFT JOIN pf USING (user_id)
      WHERE event_type <> 'error')
SELECT event_id, CASE event_type WHEN 'signup' THEN 'login' WHEN 'view' THEN 'payee' WHEN 'click' THEN 'amount' ELSE 'confirm' END AS checkpoint, n AS events,
  round(score, 5) AS score, CASE WHEN score IS NULL THEN 'step_up' WHEN event_type = 'purchase' AND score >= 8 THEN 'block'
    WHEN event_type = 'purchase' AND score >= 5 THEN 'restrict' WHEN score >= 3 THEN 'step_up' ELSE 'allow' END AS action FROM s""")
def _(spark, folder):
    rows = events(spark, folder).select(
        "event_id", "user_id", "ts", F.to_date("ts").alias("day"), (F.unix_micros("ts") / 1e6).alias("at"),
        "value", F.when(F.col("event_type") == "error", "correction").otherwise(F.col("event_type")).alias("step"),
    )
    path = L.closed_table(rows, scratch_path(spark, "steps"), at=F.unix_micros("ts") / 1e6, event_id=0, value=0.0, step="")
    steps = L.read_events(spark, path, rows.schema)
    found = L.stream_checkpoints(
        steps, step_profiles(spark, folder), "user_id", ["user_id", "day"], STEPS, step_up=3.0, restrict=5.0, block=8.0
    )
    done = L.run_to_table(found, scratch_path(spark, "checkpoints"), "scores")
    return done.select("event_id", "checkpoint", "events", F.round("score", 5).alias("score"), "action")


# Only sessions with a completed step-up feed the learning.
VERIFIED = anchor_sql(adapting.NIGHTLY.every, adapting.NIGHTLY.buffer, "0.5", "c_verify >= 1", nightly=True)


@query("stream_adapt", "WITH RECURSIVE " + WIDE + VERIFIED + f"""
SELECT {KEY}, epoch, round(displacement, 5) AS displacement, saturated, re_anchored FROM ra WHERE epoch > 0""")
def _(spark, folder):
    rows = adapting.vectors(spark, folder)
    begun = adapting.start(rows)
    stepped_up = F.when(F.col("c_verify") >= VERIFY_STEP_UP, lake.ADAPTATION_EVENT).otherwise("session.ended")
    verified = rows.withColumn("event_type", stepped_up).where(lake.adaptation_rule()).select(
        *adapting.KEYS, "event_id", "ts", (F.unix_micros("ts") / 1e6).alias("at"), "x", "tau"
    )
    path = L.closed_table(verified, scratch_path(spark, "verified"), at=F.unix_micros("ts") / 1e6, event_id=0, tau=1.0)
    found = L.stream_adapt(L.read_events(spark, path, verified.schema), begun, adapting.KEYS, adapting.NIGHTLY)
    done = L.run_to_table(found, scratch_path(spark, "adapted"), "profiles")
    return done.select(
        *adapting.KEYS, "epoch", F.round("displacement", 5).alias("displacement"), "saturated", "re_anchored"
    )


@query("stream_route", ROUTED_TOTALS)
def _(spark, folder):
    k = F.col("k")
    action = F.when(k < 5, "block").when(k < 15, "restrict").when(k < 40, "step_up").otherwise("allow")
    verified = (F.col("event_type") == "purchase") & (k < 50)
    kind = F.when(verified, lake.ADAPTATION_EVENT).otherwise("decision.made")
    decisions = stream(spark, folder).select(
        "event_id", "user_id", "ts", "value", action.alias("action"), kind.alias("event_type")
    )
    root = scratch_path(spark, "live")
    L.stream_route(decisions, root, f"{root}/progress").awaitTermination()
    return routed_totals(spark, root)
