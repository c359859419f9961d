"""Queries on profile adaptation over the trusted event view."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadentia.catalog.adapting_sql import KEY, WIDE, anchor_sql, each, median_sql, played_sql, replay_sql
from cadentia.catalog.adapting_views import VECTORS
from cadentia.catalog.behaviour import trusted
from cadentia.catalog.registry import query
from cadentia.catalog.views import curve_sql
from cadentia.operators import adaptation as A
from cadentia.operators import evaluation as E
from cadentia.operators import profiles as P
from cadentia.operators import trust as T
from cadentia.session import materialise

ORDER = ["ts", "event_id"]
KEYS = ["user_id", "device"]
SETTINGS = A.Settings(alpha=0.1, theta=12.0, budget=0.5)


def vectors(spark, folder):
    """Trusted sessions with a feature vector: value, hours since the last event, hour of day."""
    return vectors_of(trusted(spark, folder))


def vectors_of(rows):
    """The vectors of a trusted view, which knows each event's predecessor."""
    hours = (F.unix_micros("ts") - F.unix_micros("previous_ts")) / 3.6e9
    vectors = rows.where(F.col("previous_ts").isNotNull()).withColumn(
        "x", F.array("value", hours, F.hour("ts").cast("double"))
    )
    return materialise(vectors.select(*KEYS, *ORDER, "x", "c_verify", "tau", "event_type"), "vectors")


def start(rows):
    return materialise(A.cold_start(rows, KEYS, ORDER, "x"), "start")


def buffer(rows):
    return materialise(T.admit_to_buffer(rows, KEYS, ORDER), "buffer")


def cells(df, *arrays, digits=6):
    """Arrays side by side to one row per position."""
    zipped = F.posexplode(F.arrays_zip(*arrays)).alias("pos", "c")
    return df.select(*KEYS, zipped).select(
        *KEYS, "pos", *[F.round(f"c.{a}", digits).alias(a) for a in arrays]
    )


@query("cold_start", "WITH " + VECTORS + " SELECT user_id, device, pos, round(c, 6) AS centre, round(d, 6) AS dispersion FROM st")
def _(spark, folder):
    return cells(start(vectors(spark, folder)), "centre", "dispersion")


HELD = "WITH RECURSIVE " + WIDE + median_sql("held")


@query("geometric_median", HELD + f"""
SELECT {KEY}, pos, round(CASE pos WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END, 5) AS centre, round(s, 5) AS spread
FROM mid_held JOIN mad_held USING ({KEY}, epoch)""")
def _(spark, folder):
    return cells(A.geometric_median(buffer(vectors(spark, folder)), KEYS, "x"), "centre", "spread", digits=5)


@query("weighted_mad", HELD + f" SELECT {KEY}, pos, round(s, 5) AS spread FROM mad_held")
def _(spark, folder):
    kept = buffer(vectors(spark, folder))
    centres = materialise(A.geometric_median(kept, KEYS, "x"), "centres")
    return A.weighted_mad(kept, KEYS, centres, "x").select(*KEYS, "pos", F.round("spread", 5).alias("spread"))


def against_anchor(spark, folder):
    """Buffer means and spreads beside the cold-start anchor."""
    rows = vectors(spark, folder)
    now = P.fit_profiles(buffer(rows), KEYS, "x").select(*KEYS, "centre", "dispersion")
    anchor = start(rows).select(
        *KEYS, F.col("centre").alias("anchor_centre"), F.col("dispersion").alias("anchor_dispersion")
    )
    return now.join(anchor, KEYS)


AGAINST = VECTORS + """,
nw0 AS (SELECT user_id, device, pos, avg(x) AS c FROM buf GROUP BY 1, 2, 3 HAVING count(*) >= 2),
nw AS (SELECT b.user_id, b.device, b.pos, any_value(c) AS c, greatest(avg(abs(x - c)), 1e-4) AS d
       FROM buf b JOIN nw0 n ON b.user_id = n.user_id AND b.device = n.device AND b.pos = n.pos GROUP BY 1, 2, 3),
ag AS (SELECT nw.user_id, nw.device, nw.pos, nw.c, nw.d, st.c AS ac, st.d AS ad,
         avg(abs(nw.c - st.c) / st.d) OVER w AS disp, avg(abs(nw.d - st.d) / st.d) OVER w AS sdisp
       FROM nw JOIN st ON nw.user_id = st.user_id AND nw.device = st.device AND nw.pos = st.pos
       WINDOW w AS (PARTITION BY nw.user_id, nw.device))"""


@query("displacement", "WITH " + AGAINST + " SELECT DISTINCT user_id, device, round(disp, 6) AS displacement FROM ag")
def _(spark, folder):
    moved = A.displacement(F.col("centre"), F.col("anchor_centre"), F.col("anchor_dispersion"))
    return against_anchor(spark, folder).select(*KEYS, F.round(moved, 6).alias("displacement"))


@query("budget_project", "WITH " + AGAINST + """
SELECT user_id, device, pos, round(CASE WHEN disp > 0.5 THEN ac + 0.5 / disp * (c - ac) ELSE c END, 6) AS new_centre, CAST(disp > 0.5 AS INTEGER) AS saturated FROM ag""")
def _(spark, folder):
    placed = A.budget_project(against_anchor(spark, folder), 0.5)
    return placed.select(*KEYS, F.posexplode("new_centre"), "saturated").select(
        *KEYS, "pos", F.round("col", 6).alias("new_centre"), "saturated"
    )


@query("sigma_bound", "WITH " + AGAINST + """
SELECT user_id, device, pos, round(CASE WHEN sdisp > 0.5 THEN ad + 0.5 / sdisp * (d - ad) ELSE d END, 8) AS new_dispersion FROM ag""")
def _(spark, folder):
    return cells(A.sigma_bound(against_anchor(spark, folder), 0.5), "new_dispersion", digits=8)


@query("ewma_profile", "WITH " + VECTORS + """,
ad AS (SELECT *, row_number() OVER (PARTITION BY user_id, device, pos ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id, device, pos) AS n
       FROM cells WHERE tau >= 0.5),
sm AS (SELECT user_id, device, pos, any_value(n) AS n, sum(0.1::DOUBLE * pow(0.9::DOUBLE, n - i) * x) AS s FROM ad GROUP BY 1, 2, 3)
SELECT st.user_id, st.device, st.pos, coalesce(n, 0) AS admitted, round(pow(0.9::DOUBLE, coalesce(n, 0)) * c + coalesce(s, 0), 6) AS centre
FROM st LEFT JOIN sm ON st.user_id = sm.user_id AND st.device = sm.device AND st.pos = sm.pos""")
def _(spark, folder):
    rows = vectors(spark, folder)
    admitted = rows.where(F.col("tau") >= T.TAU_MIN)
    found = A.ewma_profile(admitted, KEYS, ORDER, start(rows), "x", 0.1)
    return found.select(*KEYS, "admitted", F.posexplode("centre")).select(
        *KEYS, "pos", "admitted", F.round("col", 6).alias("centre")
    )


def epochs(rows):
    begun = start(rows)
    admitted = rows.where(F.col("tau") >= T.TAU_MIN).join(begun.select(*KEYS), KEYS, "left_semi")
    settings = A.Settings(budget=0.5, every=5, buffer=20)
    return A.re_anchor(A.epoch_candidates(admitted, KEYS, ORDER, "x", settings), KEYS, begun, settings)


ANCHORED = "WITH RECURSIVE " + WIDE + anchor_sql(5, 20, "0.5")
PLAYED = "WITH RECURSIVE " + played_sql(A.RECOMPUTE_EVERY, T.BUFFER_SIZE)


@query("re_anchor", ANCHORED + f"""
SELECT {KEY}, epoch, round(displacement, 5) AS displacement, saturated, re_anchored, round(budget_used, 5) AS budget_used FROM ra WHERE epoch > 0""")
def _(spark, folder):
    found = epochs(vectors(spark, folder))
    return found.select(
        *KEYS, "epoch", F.round("displacement", 5).alias("displacement"), "saturated", "re_anchored",
        F.round("budget_used", 5).alias("budget_used"),
    )


# As specified: every 20 admitted sessions or at night, over a buffer of 200.
NIGHTLY = A.Settings(theta=12.0, budget=0.5, nightly=True)
NIGHTS = "WITH RECURSIVE " + WIDE + anchor_sql(NIGHTLY.every, NIGHTLY.buffer, "0.5", nightly=True)


def nightly(rows):
    begun = start(rows)
    admitted = rows.where(F.col("tau") >= T.TAU_MIN).join(begun.select(*KEYS), KEYS, "left_semi")
    return A.re_anchor(A.epoch_candidates(admitted, KEYS, ORDER, "x", NIGHTLY), KEYS, begun, NIGHTLY)


@query("nightly_profiles", NIGHTS + f"""
SELECT {KEY}, epoch, round(p0, 4) AS c0, round(p1, 4) AS c1, round(p2, 4) AS c2, round(displacement, 5) AS displacement, saturated, re_anchored,
  round(budget_used, 5) AS budget_used FROM ra WHERE epoch > 0""")
def _(spark, folder):
    """Profiles as recomputed after every 20 admitted sessions and every night that follows an admitted one."""
    found = nightly(vectors(spark, folder))
    return found.select(
        *KEYS, "epoch", *[F.round(F.get("centre", F.lit(i)), 4).alias(f"c{i}") for i in range(3)],
        F.round("displacement", 5).alias("displacement"), "saturated", "re_anchored", F.round("budget_used", 5).alias("budget_used"),
    )


@query("nightly_replay", NIGHTS + """
SELECT event_id, epoch, round(score, 4) AS score, CAST(score < 12 AS INTEGER) AS accepted, round(moved, 5) AS displacement FROM p3""")
def _(spark, folder):
    """Every session against the profile that the last night or the last full epoch left."""
    rows = vectors(spark, folder)
    played = A.robust_replay(rows, KEYS, ORDER, start(rows), "x", NIGHTLY)
    return played.select(
        "event_id", "epoch", F.round("score", 4).alias("score"), "accepted", F.round("displacement", 5).alias("displacement")
    )


@query("replay_policies", PLAYED + """
SELECT policy, count(*) AS sessions, round(avg(accepted), 6) AS accept_rate, round(avg(updated), 6) AS update_rate,
  round(avg(displacement), 5) AS mean_displacement, round(max(displacement), 5) AS max_displacement FROM played GROUP BY 1""")
def _(spark, folder):
    rows = vectors(spark, folder)
    played = A.policy_summary(A.replay_policies(rows, KEYS, ORDER, start(rows), "x", SETTINGS))
    shown = {"accept_rate": 6, "update_rate": 6, "mean_displacement": 5, "max_displacement": 5}
    return played.select("policy", "sessions", *[F.round(c, n).alias(c) for c, n in shown.items()])


@query("ewma_replay", PLAYED + " SELECT event_id, round(score, 5) AS score, accepted, updated FROM played WHERE policy = 'P1'")
def _(spark, folder):
    rows = vectors(spark, folder)
    played = A.ewma_replay(rows, KEYS, ORDER, start(rows), "x", "P1", SETTINGS)
    return played.select("event_id", F.round("score", 5).alias("score"), "accepted", "updated")


@query("trusted_replay", PLAYED + """
SELECT event_id, round(score, 5) AS score, accepted, updated, round(displacement, 5) AS displacement FROM played WHERE policy = 'P2'""")
def _(spark, folder):
    rows = vectors(spark, folder)
    played = A.trusted_replay(rows, KEYS, ORDER, start(rows), "x", SETTINGS)
    return played.select(
        "event_id", F.round("score", 5).alias("score"), "accepted", "updated", F.round("displacement", 5).alias("displacement")
    )


@query("static_replay", "WITH " + VECTORS + """
SELECT l.event_id, round(sum(abs(x - c) / d), 5) AS score, CAST(sum(abs(x - c) / d) < 12 AS INTEGER) AS accepted
FROM cells l JOIN st ON l.user_id = st.user_id AND l.device = st.device AND l.pos = st.pos GROUP BY 1""")
def _(spark, folder):
    rows = vectors(spark, folder)
    played = A.static_replay(rows, KEYS, ORDER, start(rows), "x", SETTINGS)
    return played.select("event_id", F.round("score", 5).alias("score"), "accepted")


@query("sessions_to_impersonation", PLAYED + f""",
atk AS (SELECT event_id, row_number() OVER (PARTITION BY {KEY} ORDER BY ts, event_id) AS i FROM v WHERE event_type = 'error')
SELECT {KEY}, policy, count(*) AS attacks, CAST(min(CASE WHEN accepted = 1 THEN i END) AS DOUBLE) AS first_accepted
FROM played JOIN atk USING (event_id) GROUP BY 1, 2, 3""")
def _(spark, folder):
    rows = vectors(spark, folder)
    played = A.replay_policies(rows, KEYS, ORDER, start(rows), "x", SETTINGS)
    attacks = rows.where("event_type = 'error'")
    found = A.sessions_to_impersonation(played, attacks, KEYS, ORDER)
    return found.withColumn("first_accepted", F.col("first_accepted").cast("double"))


@query("calibrate_budget", "WITH " + VECTORS + """,
m AS (SELECT user_id, device, pos, avg(x) AS c FROM cells GROUP BY 1, 2, 3 HAVING count(*) >= 2),
sp AS (SELECT l.user_id, l.device, l.pos, greatest(avg(abs(x - c)), 1e-4) AS d FROM cells l
       JOIN m ON l.user_id = m.user_id AND l.device = m.device AND l.pos = m.pos GROUP BY 1, 2, 3),
wk AS (SELECT user_id, device, pos, floor(epoch(ts) / 604800) AS week, avg(x) AS c FROM cells GROUP BY 1, 2, 3, 4),
lg AS (SELECT *, c - lag(c) OVER o AS mv, week - lag(week) OVER o AS wd FROM wk WINDOW o AS (PARTITION BY user_id, device, pos ORDER BY week)),
pw AS (SELECT lg.user_id, lg.device, week, avg(abs(mv) / d) / any_value(wd) AS per_week FROM lg
       JOIN sp ON lg.user_id = sp.user_id AND lg.device = sp.device AND lg.pos = sp.pos WHERE mv IS NOT NULL GROUP BY 1, 2, 3)
SELECT round(quantile_cont(per_week, 0.95), 6) AS budget FROM pw""")
def _(spark, folder):
    found = A.calibrate_budget(vectors(spark, folder), KEYS, "ts", "x")
    return found.select(F.round("budget", 6).alias("budget"))


@query("budget_sweep", "WITH RECURSIVE " + WIDE + anchor_sql(5, 20, "0.25, 0.5, 1.0, 2.0") + """,
sat AS (SELECT budget, avg(saturated) AS saturation_rate FROM ra WHERE epoch > 0 GROUP BY 1)
SELECT budget, round(avg((score < 12)::INTEGER) FILTER (event_type = 'error'), 6) AS attack_accept_rate,
  round(avg(1 - (score < 12)::INTEGER) FILTER (event_type <> 'error'), 6) AS genuine_reject_rate,
  round(avg(moved), 5) AS mean_displacement, round(any_value(saturation_rate), 6) AS saturation_rate
FROM p3 LEFT JOIN sat USING (budget) GROUP BY 1""")
def _(spark, folder):
    settings = A.Settings(theta=12.0, every=5, buffer=20)
    rows = vectors(spark, folder)
    found = A.budget_sweep(
        rows, KEYS, ORDER, start(rows), "x",
        F.col("event_type") == "error", [0.25, 0.5, 1.0, 2.0], settings,
    )
    shown = {"attack_accept_rate": 6, "genuine_reject_rate": 6, "mean_displacement": 5, "saturation_rate": 6}
    return found.select("budget", *[F.round(c, n).alias(c) for c, n in shown.items()])


@query("saturation_detector", ANCHORED + f""",
hit AS (SELECT DISTINCT {KEY}, 1 AS label FROM v WHERE event_type = 'signup' AND tau >= 0.5),
scores AS (SELECT 'saturation' AS subject, coalesce(any_value(label), 0) AS label, avg(saturated) AS score
  FROM ra LEFT JOIN hit USING ({KEY}) WHERE epoch > 0 GROUP BY {KEY})""" + curve_sql("score", "sat") + """
SELECT subject, round(threshold, 6) AS threshold, round(far, 6) AS far, round(frr, 6) AS frr FROM curve_sat""")
def _(spark, folder):
    rows = vectors(spark, folder)
    rates = A.saturation_rates(epochs(rows), KEYS)
    attacked = rows.where("event_type = 'signup' AND tau >= 0.5")
    curve = A.saturation_detector(rates, attacked, KEYS)
    return curve.select("subject", *[F.round(c, 6).alias(c) for c in ("threshold", "far", "frr")])


@query("drift_frr", "WITH " + VECTORS + """,
sc AS (SELECT l.user_id, l.event_id, l.ts, sum(abs(x - c) / d) AS score FROM cells l
       JOIN st ON l.user_id = st.user_id AND l.device = st.device AND l.pos = st.pos GROUP BY 1, 2, 3),
th AS (SELECT user_id, quantile_cont(score, 0.95) AS t FROM sc WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1)
SELECT sc.user_id, round(any_value(t), 5) AS threshold, count(*) AS late, round(avg(CASE WHEN score > t THEN 1.0::DOUBLE ELSE 0 END), 6) AS drift_frr
FROM sc JOIN th ON sc.user_id = th.user_id WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1""")
def _(spark, folder):
    rows = vectors(spark, folder)
    scored = P.anomaly_score(rows, start(rows), KEYS, "x")
    found = A.drift_frr(scored, "user_id", F.col("ts") < F.lit("2024-01-16").cast("timestamp"))
    return found.select(
        "user_id", F.round("threshold", 5).alias("threshold"), "late", F.round("drift_frr", 6).alias("drift_frr")
    )


@query("eer_by_intensity", "WITH RECURSIVE " + WIDE + """,
mixed AS (SELECT * FROM (SELECT kv.*, unnest(['0.1', '0.5', '1.0']) AS grp FROM kv)
  WHERE event_type <> 'error' OR (('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 8))::BIGINT % 10000) / 10000 < CAST(grp AS DOUBLE))"""
+ replay_sql("mixed") + """,
scores AS (SELECT CAST(grp AS DOUBLE) AS subject, (event_type = 'error')::INTEGER AS label, score
  FROM ew_mixed e JOIN (SELECT event_id, event_type FROM v) USING (event_id))""" + curve_sql("score", "mix") + """
SELECT subject AS intensity, round(eer, 6) AS eer FROM eer_mix""")
def _(spark, folder):
    rows = vectors(spark, folder)
    found = A.eer_by_intensity(
        rows, KEYS, ORDER, start(rows), "x",
        F.col("event_type") == "error", [0.1, 0.5, 1.0], SETTINGS, draw=["event_id"],
    )
    return found.select("intensity", F.round("eer", 6).alias("eer"))
