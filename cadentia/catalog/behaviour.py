"""Queries on the event view: sessions, timing, automation signs, trust."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadentia.catalog.registry import query
from cadentia.catalog.views import EVENTS, SESSIONS, events, sessions
from cadentia.functions.scalars import is_finite, risk_scale
from cadentia.operators import sessions as S
from cadentia.operators import trust as T
from cadentia.plans.ordered import running
from cadentia.plans.quantiles import exact_quantiles
from cadentia.session import materialise
from cadentia.sources import lake

ORDER = ["ts", "event_id"]
KEYS = ["user_id", "session_no"]


def r(name, digits=6):
    return F.round(name, digits).alias(name)


def numbered(spark, folder):
    """Session events with ``pos`` 1, 2, ... and whole-second gaps inside the session."""
    rows = running(
        sessions(spark, folder), KEYS, ORDER, S.day_slot(F.col("ts"), 1.0),
        totals={"pos": F.lit(1).cast("long")},
    )
    inside = F.when(F.col("pos") > 1, F.col("gap"))
    named = rows.withColumn("inner_gap", inside).withColumn(
        "interval", F.floor(inside / 3600).cast("long")
    )
    # Several passes read this view, as they would a stored session table.
    return materialise(named.drop("props"), "session-events")


NUMBERED = SESSIONS + """,
num AS (SELECT *, row_number() OVER w AS pos, CASE WHEN row_number() OVER w > 1 THEN gap END AS inner_gap,
           CASE WHEN row_number() OVER w > 1 THEN CAST(floor(gap / 3600) AS BIGINT) END AS interval
         FROM sess WINDOW w AS (PARTITION BY user_id, session_no ORDER BY ts, event_id))"""


@query("event_gaps", "WITH " + SESSIONS + " SELECT event_id, round(gap, 6) AS gap FROM sess")
def _(spark, folder):
    gaps = S.event_gaps(events(spark, folder), "user_id", "ts", ORDER)
    return gaps.select("event_id", r("gap"))


@query("sessionise", "WITH " + SESSIONS + " SELECT event_id, user_id, session_no FROM sess")
def _(spark, folder):
    return sessions(spark, folder).select("event_id", "user_id", "session_no")


@query("valid_timing", "WITH " + SESSIONS + " SELECT event_id, round(gap, 6) AS gap FROM sess WHERE gap >= 0 AND gap <= 43200 AND value >= 0")
def _(spark, folder):
    kept = S.valid_timing(sessions(spark, folder), ["gap"], ["value"], max_hold=43_200.0)
    return kept.select("event_id", r("gap"))


AGENTS = ("Mozilla (X11; Linux)", "Mozilla (iPhone; Mobile)", "Mozilla (iPad)")


def client_description():
    return F.get(F.array(*[F.lit(a) for a in AGENTS]), F.col("k") % 3)


@query("device_class", "WITH " + EVENTS + """
SELECT CASE k % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END AS device_class, count(*) AS n FROM ev GROUP BY 1""")
def _(spark, folder):
    classed = events(spark, folder).withColumn("device_class", S.device_class(client_description()))
    return classed.groupBy("device_class").agg(F.count("*").alias("n"))


@query("timing_features", "WITH " + NUMBERED + """
SELECT user_id, session_no, round(avg(value), 9) AS hold_mean, round(coalesce(stddev_samp(value), 0), 9) AS hold_sd, min(value) AS hold_min,
  round(quantile_cont(value, 0.5), 9) AS hold_median, max(value) AS hold_max, round(avg(inner_gap), 9) AS flight_mean,
  round(coalesce(stddev_samp(inner_gap), 0), 9) AS flight_sd, round(min(inner_gap), 9) AS flight_min,
  round(quantile_cont(inner_gap, 0.5), 9) AS flight_median, round(max(inner_gap), 9) AS flight_max,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 9) AS duration,
  round(avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END), 9) AS correction_rate FROM num GROUP BY 1, 2""")
def _(spark, folder):
    keyed = numbered(spark, folder).withColumn("fix", F.col("event_type") == "error")
    keyed = keyed.withColumn("fix", F.col("fix").cast("int"))
    found = S.timing_features(keyed, KEYS, "value", "inner_gap", "fix", "ts")
    return found.select(*KEYS, *[r(n, 9) for n in S.TIMING_FEATURES])


@query("session_aggregates", "WITH " + SESSIONS + """,
v AS (SELECT user_id, session_no, event_type, min(ts) AS f, max(ts) AS t, count(*) AS n, count_if(event_type = 'error') AS c FROM sess GROUP BY 1, 2, 3),
rp AS (SELECT user_id, session_no, sum(n - 1) AS x FROM (SELECT user_id, session_no, k, count(*) AS n FROM sess GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT v.user_id, v.session_no, round((epoch_us(max(t)) - epoch_us(min(f))) / 1e6, 6) AS duration, CAST(sum(n) AS BIGINT) AS events,
  CAST(sum(c) AS BIGINT) AS corrections, string_agg(event_type, '>' ORDER BY f, event_type) AS step_order, CAST(any_value(x) AS BIGINT) AS repeated_payees
FROM v JOIN rp ON v.user_id = rp.user_id AND v.session_no = rp.session_no GROUP BY 1, 2""")
def _(spark, folder):
    found = S.session_aggregates(
        sessions(spark, folder), KEYS, "ts", "event_type", F.col("event_type") == "error", "k"
    )
    return found.withColumn("duration", F.round("duration", 6))


@query("coefficient_of_variation", "WITH " + NUMBERED + """
SELECT user_id, session_no, count(inner_gap) AS gaps, CASE WHEN avg(inner_gap) <> 0 THEN round(stddev_samp(inner_gap) / avg(inner_gap), 6) END AS interval_cv
FROM num GROUP BY 1, 2""")
def _(spark, folder):
    found = S.interval_variation(numbered(spark, folder), KEYS, "inner_gap")
    return found.select(*KEYS, "gaps", r("interval_cv"))


FLAGS = "WITH " + NUMBERED + """,
s AS (SELECT user_id, session_no, count(interval) AS n, string_agg(interval, ',' ORDER BY pos) AS seq,
        CASE WHEN avg(inner_gap) <> 0 THEN stddev_samp(inner_gap) / avg(inner_gap) END AS cv FROM num GROUP BY 1, 2),
d AS (SELECT seq, count(*) AS copies FROM s WHERE n >= 2 GROUP BY 1)
"""


@query("automation_flags", FLAGS + """SELECT user_id, session_no, n AS gaps, round(cv, 6) AS interval_cv, coalesce(copies, 1) AS copies,
  CASE WHEN cv < 0.1 THEN 1 ELSE 0 END AS regular, CASE WHEN copies > 1 THEN 1 ELSE 0 END AS replayed
FROM s LEFT JOIN d ON s.seq = d.seq AND s.n >= 2""")
def _(spark, folder):
    found = S.automation_flags(numbered(spark, folder), KEYS, "pos", "inner_gap", "interval")
    return found.withColumn("interval_cv", F.round("interval_cv", 6))


@query("duplicate_sequences", FLAGS + "SELECT user_id, session_no, n AS intervals, copies FROM s JOIN d ON s.seq = d.seq WHERE n >= 2")
def _(spark, folder):
    prints = S.sequence_fingerprints(numbered(spark, folder), KEYS, "pos", "interval")
    return S.duplicate_sequences(prints, KEYS)


@query("rolling_interval_hash", "WITH " + NUMBERED + """,
u AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS upos, CAST(floor(gap / 3600) AS BIGINT) AS h FROM sess),
l AS (SELECT event_id, lag(h, 3) OVER w AS a, lag(h, 2) OVER w AS b, lag(h, 1) OVER w AS c, h FROM u WINDOW w AS (PARTITION BY user_id ORDER BY upos))
SELECT event_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND h IS NOT NULL THEN sha256(concat_ws(',', a, b, c, h)) END AS rolling_hash FROM l""")
def _(spark, folder):
    rows = running(
        sessions(spark, folder), ["user_id"], ORDER, S.day_slot(F.col("ts"), 1.0),
        totals={"pos": F.lit(1).cast("long")},
    ).withColumn("hours", F.floor(F.col("gap") / 3600).cast("long"))
    hashed = S.rolling_interval_hash(rows, ["user_id"], "pos", "hours", 4, stretch=16)
    return hashed.select("event_id", "rolling_hash")


@query("repeated_hashes", "WITH " + NUMBERED + """,
u AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS upos, CAST(floor(gap / 3600) AS BIGINT) AS h FROM sess),
l AS (SELECT user_id, lag(h, 3) OVER w AS a, lag(h, 2) OVER w AS b, lag(h, 1) OVER w AS c, h FROM u WINDOW w AS (PARTITION BY user_id ORDER BY upos)),
c AS (SELECT *, count(*) OVER (PARTITION BY a, b, c, h) AS n FROM l WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND h IS NOT NULL)
SELECT user_id, count(*) AS windows, CAST(count_if(n > 1) AS BIGINT) AS repeated_windows FROM c GROUP BY 1""")
def _(spark, folder):
    rows = running(
        sessions(spark, folder), ["user_id"], ORDER, S.day_slot(F.col("ts"), 1.0),
        totals={"pos": F.lit(1).cast("long")},
    ).withColumn("hours", F.floor(F.col("gap") / 3600).cast("long"))
    return S.repeated_hashes(S.rolling_interval_hash(rows, ["user_id"], "pos", "hours", 4), ["user_id"])


def each(template, separator=", "):
    return separator.join(template.replace("#", str(i)) for i in range(3))


def apart(a, b):
    return each(f"pow({a} - {b}, 2)", " + ")


@query("session_clusters", "WITH RECURSIVE " + SESSIONS + f""",
y AS (SELECT user_id, session_no, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS y0, count(*)::DOUBLE AS y1, count_if(event_type = 'error')::DOUBLE AS y2 FROM sess GROUP BY 1, 2),
z AS (SELECT user_id, session_no, {each("CASE WHEN stddev_pop(y#) OVER u > 1e-9 THEN (y# - avg(y#) OVER u) / stddev_pop(y#) OVER u ELSE 0.0 END AS z#")} FROM y WINDOW u AS (PARTITION BY user_id)),
fa AS (SELECT user_id, {each("z# AS a#")} FROM z QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round({apart("z#", "0")}, 9) DESC, session_no) = 1),
fb AS (SELECT user_id, {each("a#")}, {each("z# AS b#")} FROM z JOIN fa USING (user_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round({apart("z#", "a#")}, 9) DESC, session_no) = 1),
km AS (SELECT user_id, 0 AS it, {each("a#")}, {each("b#")} FROM fb
  UNION ALL
  SELECT user_id, it + 1, {each("coalesce(avg(z#) FILTER (NOT side), a#) AS a#")}, {each("coalesce(avg(z#) FILTER (side), b#) AS b#")}
  FROM (SELECT user_id, it, {each("a#")}, {each("b#")}, {each("z#")}, round(({apart("z#", "a#")}) - ({apart("z#", "b#")}), 9) > 0 AS side FROM km JOIN z USING (user_id) WHERE it < 6)
  GROUP BY user_id, it, {each("a#")}, {each("b#")}),
fin AS (SELECT user_id, {apart("a#", "b#")} AS ab, {apart("z#", "a#")} AS da, {apart("z#", "b#")} AS db FROM z JOIN km USING (user_id) WHERE it = 6)
SELECT user_id, count(*) AS sessions, round(least(avg((round(da - db, 9) > 0)::INTEGER), 1 - avg((round(da - db, 9) > 0)::INTEGER)), 6) AS minor_share,
  CASE WHEN round(avg(least(da, db)), 9) > 0 THEN round(sqrt(any_value(ab)) / sqrt(round(avg(least(da, db)), 9)), 5) END AS separation
FROM fin GROUP BY 1""")
def _(spark, folder):
    found = S.session_aggregates(
        sessions(spark, folder), KEYS, "ts", "event_type", F.col("event_type") == "error"
    )
    split = S.session_clusters(found, "user_id", "session_no", ["duration", "events", "corrections"])
    return split.select("user_id", "sessions", r("minor_share"), r("separation", 5))


def trust_events(spark, folder):
    """One session per event with the facts the gates ask for."""
    ev = events(spark, folder).withColumn("device", F.col("k") % 3)
    limit = exact_quantiles(ev.withColumn("all", F.lit(1)), ["all"], "value", {"medium_from": 0.9})
    facts = ev.join(F.broadcast(limit.drop("all"))).withColumns(  # one row
        {
            "step_up": ((F.col("event_type") == "purchase") & (F.col("k") < 50)).cast("int"),
            "passkey": (F.col("k") < 80).cast("int"),
            "enrolled": (F.col("device") != 2).cast("int"),
            "txn_medium": ((F.col("event_type") == "purchase") & (F.col("value") > F.col("medium_from"))).cast("int"),
            "txn_stopped": ((F.col("event_type") == "purchase") & (F.col("k") >= 95)).cast("int"),
        }
    )
    # Stored between the two ordered steps, as each of them reads its input twice.
    aged = materialise(
        S.prior_sessions(facts.drop("props"), "user_id", "device", ORDER, clean=F.col("event_type") != "error"), "aged"
    )
    change = (F.col("event_type") == "signup") & (F.col("k") < 5)
    return S.recent_change(aged, "user_id", "ts", change, ORDER, previous={"previous_ts": "ts"}).drop("medium_from")


TRUST = EVENTS + """,
facts AS (SELECT *, k % 3 AS device, row_number() OVER (PARTITION BY user_id, k % 3 ORDER BY ts, event_id) - 1 AS prior_sessions,
    count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id, k % 3 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_clean,
    max(CASE WHEN event_type = 'signup' AND k < 5 THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_change FROM ev),
tr AS (SELECT *, CASE WHEN event_type = 'purchase' AND k < 50 THEN 1.0::DOUBLE WHEN k < 80 AND k % 3 <> 2 THEN 0.6 ELSE 0.3 END AS c_verify,
    CASE WHEN k % 3 <> 2 AND prior_clean >= 10 THEN 1.0::DOUBLE WHEN prior_sessions > 0 THEN 0.5 ELSE 0.0 END AS c_device,
    CASE WHEN last_change IS NOT NULL AND epoch_us(ts) - epoch_us(last_change) <= 7 * 86400 * 1000000::BIGINT THEN 0.0::DOUBLE ELSE 1.0 END AS c_stability,
    CASE WHEN event_type = 'purchase' AND k >= 95 THEN 0.0::DOUBLE WHEN event_type = 'purchase' AND value > (SELECT quantile_cont(value, 0.9) FROM events) THEN 0.5::DOUBLE ELSE 1.0 END AS c_txn FROM facts),
tau AS (SELECT *, c_verify * c_device * c_stability * c_txn AS tau FROM tr)"""


@query("prior_sessions", "WITH " + TRUST + " SELECT event_id, prior_sessions FROM tau")
def _(spark, folder):
    return trust_events(spark, folder).select("event_id", "prior_sessions")


@query("recent_change", "WITH " + TRUST + " SELECT event_id, CAST(1 - c_stability AS INTEGER) AS recent_change FROM tau")
def _(spark, folder):
    return trust_events(spark, folder).select("event_id", "recent_change")


@query("device_history", "WITH " + EVENTS + """
SELECT user_id, k % 3 AS device, epoch_us(min(ts)) AS first_seen, count(*) AS session_count FROM ev GROUP BY 1, 2""")
def _(spark, folder):
    ev = events(spark, folder).withColumn("device", F.col("k") % 3)
    found = S.device_history(ev, "user_id", "device")
    return found.withColumn("first_seen", F.unix_micros("first_seen"))


@query("context_features", "WITH " + TRUST + """
SELECT event_id, CAST(date_diff('day', CAST(min(ts) OVER (PARTITION BY user_id, event_type) AS DATE), CAST(ts AS DATE)) AS INTEGER) AS payee_age_days,
  CAST(date_diff('day', CAST(min(ts) OVER (PARTITION BY user_id, device) AS DATE), CAST(ts AS DATE)) AS INTEGER) AS device_age_days,
  CAST(date_diff('day', CAST(last_change AS DATE), CAST(ts AS DATE)) AS DOUBLE) AS days_since_change, prior_sessions FROM tau""")
def _(spark, folder):
    ev = events(spark, folder).withColumn("device", F.col("k") % 3)
    change = (F.col("event_type") == "signup") & (F.col("k") < 5)
    found = S.context_features(ev, "user_id", "device", "event_type", "ts", change, ORDER)
    since = F.col("days_since_change").cast("double").alias("days_since_change")
    return found.select("event_id", "payee_age_days", "device_age_days", since, "prior_sessions")


@query("trust_gates", "WITH " + TRUST + " SELECT event_id, c_verify, c_device, c_stability, c_txn FROM tau")
def _(spark, folder):
    gated = T.trust_gates(trust_events(spark, folder))
    return gated.select("event_id", "c_verify", "c_device", "c_stability", "c_txn")


def trusted(spark, folder):
    return T.trust_score(trust_events(spark, folder))


@query("trust_score", "WITH " + TRUST + " SELECT event_id, round(tau, 6) AS tau FROM tau")
def _(spark, folder):
    return trusted(spark, folder).select("event_id", r("tau"))


BUFFER = TRUST + """,
buf AS (SELECT *, row_number() OVER (PARTITION BY user_id, device ORDER BY ts DESC, event_id DESC) AS buffer_rank FROM tau WHERE tau >= 0.5)"""


@query("admit_to_buffer", "WITH " + BUFFER + """
SELECT event_id, user_id, device, round(tau, 6) AS weight, CAST(buffer_rank AS INTEGER) AS buffer_rank FROM buf WHERE buffer_rank <= 200""")
def _(spark, folder):
    kept = T.admit_to_buffer(trusted(spark, folder), ["user_id", "device"], ORDER)
    return kept.select("event_id", "user_id", "device", r("weight"), "buffer_rank")


@query("buffer_evict", "WITH " + BUFFER + " SELECT event_id, user_id, device FROM buf WHERE buffer_rank <= 5")
def _(spark, folder):
    kept = T.admit_to_buffer(trusted(spark, folder), ["user_id", "device"], ORDER, m=5)
    return kept.select("event_id", "user_id", "device")


@query("rejected_updates", "WITH " + TRUST + """
SELECT user_id, CASE WHEN c_stability = 0 THEN 'recent change' WHEN c_device = 0 THEN 'new device' WHEN c_txn = 0 THEN 'transaction stopped'
  ELSE 'low trust' END AS reason, count(*) AS rejected FROM tau WHERE tau < 0.5 GROUP BY 1, 2""")
def _(spark, folder):
    return T.rejected_updates(trusted(spark, folder), "user_id")


@query("retention", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 1 DAY")
def _(spark, folder):
    return lake.retention(events(spark, folder), "session", "2024-01-31 00:00:00").select("event_id")


@query("scalar_functions", "WITH " + EVENTS + """
SELECT event_id, round(100 / (1 + exp(-(value - 50) / 25)), 6) AS risk, hour(ts)::INTEGER AS hour,
  isfinite(value) AS finite, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS days FROM ev""")
def _(spark, folder):
    return events(spark, folder).select(
        "event_id",
        F.round(risk_scale((F.col("value") - 50) / 25), 6).alias("risk"),
        F.hour("ts").alias("hour"),
        is_finite(F.col("value")).alias("finite"),
        S.days_between(F.col("ts"), F.lit("2024-01-01").cast("date")).alias("days"),
    )
