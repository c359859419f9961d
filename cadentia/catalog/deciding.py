"""Queries on risk fusion, decisions and their outcomes.

The tables hold no channel scores, so columns of each order line stand in for
them; the operators see five raw scores and five confidences either way.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cadentia.catalog.behaviour import TRUST, trust_events
from cadentia.catalog.registry import query
from cadentia.catalog.views import EVENTS, events, table
from cadentia.operators import fusion as U
from cadentia.operators import outcomes as D
from cadentia.operators import transfers as T
from cadentia.session import materialise, scratch_path
from cadentia.sources import lake

WEIGHTS = {"behaviour": 0.8, "automation": 0.6, "transaction": 0.7, "context": 0.4, "payee": 0.9}
INTERCEPT = 0.5
LADDER = {
    "A": {"transaction": 0.7},
    "B": {"behaviour": 0.8},
    "C": {"behaviour": 0.8, "transaction": 0.7},
    "D": {"behaviour": 0.8, "transaction": 0.7, "automation": 0.6},
    "E": {"behaviour": 0.9, "transaction": 0.7, "automation": 0.6, "context": 0.4},
    "F": WEIGHTS,
}
LINE = ["order_id", "line_no", "part_id", "amount"]


def r(name, digits=6):
    return F.round(name, digits).alias(name)


def channels(spark, folder):
    """Order lines with raw scores, evidence counts, label and attack class."""
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderdate").cast("timestamp").alias("ts"),
        "o_orderpriority",
    )
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    joined = lines.join(orders, "l_orderkey").join(suppliers, "l_suppkey")
    rows = joined.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"), F.col("l_extendedprice").alias("amount"),
        F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("payee"), "ts",
        F.col("o_orderpriority").alias("device"),
        F.col("l_quantity").cast("double").alias("s_behaviour"), (F.col("l_discount") * 100).alias("s_automation"),
        F.col("l_extendedprice").alias("s_transaction"), (F.col("l_tax") * 100).alias("s_context"),
        (-F.col("s_acctbal")).alias("s_payee"),
        F.col("l_linenumber").alias("buffer"), (F.col("l_quantity") * 2).alias("keystrokes"),
        F.col("l_linenumber").alias("gaps"), F.col("l_quantity").alias("transfers"),
        F.col("l_linenumber").alias("device_sessions"),
        F.datediff(F.col("l_shipdate").cast("date"), F.col("ts").cast("date")).cast("double").alias("payee_age_days"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_returnflag").alias("attack_class"),
        F.col("l_linestatus").alias("kind"),
    )
    return rows


CHANNELS_SQL = """
ch AS (SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part_id, l_extendedprice AS amount, o_custkey AS "user", l_suppkey AS payee,
    o_orderdate AS ts, o_orderpriority AS device, l_quantity::DOUBLE AS s_behaviour, l_discount * 100 AS s_automation, l_extendedprice AS s_transaction,
    l_tax * 100 AS s_context, -s_acctbal AS s_payee,
    least(l_quantity * 2 / 50.0::DOUBLE, 1) * least(l_linenumber / 20.0::DOUBLE, 1) AS c_behaviour, least(l_linenumber / 20.0::DOUBLE, 1) AS c_automation,
    least(l_quantity / 10.0::DOUBLE, 1) AS c_transaction, least(l_linenumber / 10.0::DOUBLE, 1) AS c_context,
    exp(-greatest(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)), 0) / 7.0::DOUBLE) AS c_payee,
    CAST(l_returnflag = 'R' AS INTEGER) AS label, l_returnflag AS attack_class, l_linestatus AS kind
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey),
sc AS (SELECT avg(s_behaviour) AS m1, stddev_samp(s_behaviour) AS d1, avg(s_automation) AS m2, stddev_samp(s_automation) AS d2, avg(s_transaction) AS m3,
    stddev_samp(s_transaction) AS d3, avg(s_context) AS m4, stddev_samp(s_context) AS d4, avg(s_payee) AS m5, stddev_samp(s_payee) AS d5 FROM ch),
zz AS (SELECT ch.*, c_behaviour * (s_behaviour - m1) / d1 AS z1, c_automation * (s_automation - m2) / d2 AS z2, c_transaction * (s_transaction - m3) / d3 AS z3,
    c_context * (s_context - m4) / d4 AS z4, c_payee * (s_payee - m5) / d5 AS z5 FROM ch, sc),
fu AS (SELECT *, 100 / (1 + exp(-(0.5::DOUBLE + 0.8 * z1 + 0.6 * z2 + 0.7 * z3 + 0.4 * z4 + 0.9 * z5))) AS risk,
    (0.8 * c_behaviour + 0.6 * c_automation + 0.7 * c_transaction + 0.4 * c_context + 0.9 * c_payee) / 3.4::DOUBLE AS confidence,
    CAST(z1 > 1 AS INTEGER) AS o1, CAST(z2 > 1 AS INTEGER) + CAST(z3 > 1 AS INTEGER) + CAST(z4 > 1 AS INTEGER) + CAST(z5 > 1 AS INTEGER) AS o2 FROM zz),
de AS (SELECT *, CASE WHEN risk >= 90 AND o2 >= 1 AND o1 + o2 >= 2 THEN 'block' WHEN risk >= 75 AND o2 >= 1 THEN 'restrict'
    WHEN risk >= 50 THEN 'step_up' ELSE 'allow' END AS action FROM fu)"""


def standardised(spark, folder):
    # Scales and scores are two passes over a joined view; store it once.
    rows = materialise(U.channel_confidence(channels(spark, folder)), "channels")
    return U.standardise(rows, U.channel_scales(rows))


def fused(spark, folder):
    return U.risk_confidence(U.fuse_risk(standardised(spark, folder), WEIGHTS, INTERCEPT), WEIGHTS)


def decided(spark, folder):
    return U.decide_action(fused(spark, folder))


CONTEXT_SQL = CHANNELS_SQL + """,
pf AS (SELECT "user", device, avg(s_behaviour) AS centre FROM ch WHERE kind = 'O' GROUP BY 1, 2 HAVING count(*) >= 2),
dv AS (SELECT "user", device, count(*) AS session_count FROM ch GROUP BY 1, 2),
eg AS (SELECT "user", payee, count(*) AS txn_count FROM ch WHERE kind = 'O' GROUP BY 1, 2),
py AS (SELECT payee, count(DISTINCT "user") AS senders FROM ch GROUP BY 1),
us AS (SELECT "user", max(amount) AS largest FROM ch WHERE kind = 'O' GROUP BY 1)"""


def context(spark, folder):
    # Read by every table below: stored, so that lines meet their orders once.
    rows = materialise(channels(spark, folder).select(*LINE, "user", "device", "payee", "s_behaviour", "kind"), "sessions")
    opened = F.col("kind") == "O"
    # One pass for what is known by device; stored, as three tables come from it.
    by_device = materialise(rows.groupBy("user", "device").agg(
        F.avg(F.when(opened, F.col("s_behaviour"))).alias("centre"), F.count(F.when(opened, 1)).alias("n"),
        F.count("*").alias("session_count"), F.max(F.when(opened, F.col("amount"))).alias("largest"),
    ), "devices")
    profiles = by_device.where("n >= 2").select("user", "device", "centre")
    devices = by_device.select("user", "device", "session_count")
    users = by_device.where("n > 0").groupBy("user").agg(F.max("largest").alias("largest"))
    edges = rows.where(opened).groupBy("user", "payee").agg(F.count("*").alias("txn_count"))
    # Stored, so that its size is known when the sessions meet it.
    payees = materialise(rows.groupBy("payee", "user").agg(F.count("*").alias("n")).groupBy("payee").agg(
        F.count("*").alias("senders")
    ), "payees")
    return U.session_context(rows, profiles, devices, edges, payees, users)


@query("session_context", "WITH " + CONTEXT_SQL + """
SELECT order_id, line_no, part_id, ch.amount, round(centre, 6) AS centre, session_count, CAST(txn_count AS DOUBLE) AS txn_count, senders, largest,
  CAST(centre IS NOT NULL AS INTEGER) AS has_profile, CAST(txn_count IS NOT NULL AS INTEGER) AS has_edge, CAST(largest IS NOT NULL AS INTEGER) AS has_user
FROM ch LEFT JOIN pf ON ch."user" = pf."user" AND ch.device = pf.device LEFT JOIN dv ON ch."user" = dv."user" AND ch.device = dv.device
LEFT JOIN eg ON ch."user" = eg."user" AND ch.payee = eg.payee LEFT JOIN py ON ch.payee = py.payee LEFT JOIN us ON ch."user" = us."user" """)
def _(spark, folder):
    return context(spark, folder).select(
        *LINE, r("centre"), "session_count", F.col("txn_count").cast("double").alias("txn_count"),
        "senders", "largest", "has_profile", "has_edge", "has_user",
    )


@query("channel_scores", "WITH " + TRUST + """,
g AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM tau),
cv AS (SELECT user_id, stddev_samp(gap) / avg(gap) AS cv FROM g GROUP BY 1),
md AS (SELECT user_id, quantile_cont(value, 0.5) AS med FROM ev GROUP BY 1),
ad AS (SELECT ev.user_id, quantile_cont(abs(value - med), 0.5) AS mad FROM ev JOIN md ON ev.user_id = md.user_id GROUP BY 1)
SELECT event_id, value AS s_behaviour, round(greatest(1 - least(cv, 1), CAST(k < 5 AS DOUBLE)), 6) AS s_automation, round(abs((value - med) / mad), 6) AS s_transaction,
  round(1.0::DOUBLE / (1 + prior_sessions) + (1 - c_stability), 6) AS s_context, k / 100.0::DOUBLE AS s_payee
FROM tau JOIN cv ON tau.user_id = cv.user_id JOIN md ON tau.user_id = md.user_id JOIN ad ON tau.user_id = ad.user_id""")
def _(spark, folder):
    from cadentia.operators.sessions import event_gaps, interval_variation

    gaps = event_gaps(events(spark, folder), "user_id", "ts", ["ts", "event_id"])
    cvs = interval_variation(gaps, ["user_id"], "gap").drop("gaps")
    rows = T.robust_z(trust_events(spark, folder), "user_id", "value").join(cvs, "user_id")
    facts = rows.withColumns(
        {"anomaly": F.col("value"), "replayed": (F.col("k") < 5).cast("int"), "payee_risk": F.col("k") / 100.0}
    )
    scored = U.channel_scores(facts)
    return scored.select(
        "event_id", "s_behaviour", r("s_automation"), r("s_transaction"), r("s_context"), "s_payee"
    )


@query("channel_confidence", "WITH " + CHANNELS_SQL + """
SELECT order_id, line_no, part_id, amount, round(c_behaviour, 6) AS c_behaviour, round(c_automation, 6) AS c_automation,
  round(c_transaction, 6) AS c_transaction, round(c_context, 6) AS c_context, round(c_payee, 6) AS c_payee FROM ch""")
def _(spark, folder):
    rows = U.channel_confidence(channels(spark, folder))
    return rows.select(*LINE, *[r(f"c_{c}") for c in U.CHANNELS])


@query("fuse_risk", "WITH " + CHANNELS_SQL + " SELECT order_id, line_no, part_id, amount, round(risk, 5) AS risk FROM fu")
def _(spark, folder):
    return fused(spark, folder).select(*LINE, r("risk", 5))


@query("risk_contributions", "WITH " + CHANNELS_SQL + """,
co AS (SELECT order_id, line_no, part_id, amount, unnest([0, 1, 2, 3, 4]) AS pos, unnest(['behaviour', 'automation', 'transaction', 'context', 'payee']) AS channel,
         unnest([0.8 * z1, 0.6 * z2, 0.7 * z3, 0.4 * z4, 0.9 * z5]) AS v, payee FROM zz),
rk AS (SELECT *, row_number() OVER (PARTITION BY order_id, line_no, part_id, amount, payee ORDER BY abs(v) DESC, pos) AS rn FROM co)
SELECT order_id, line_no, part_id, amount, CAST(rn AS INTEGER) AS rank, channel, round(v, 5) AS contribution FROM rk WHERE rn <= 3""")
def _(spark, folder):
    top = U.risk_contributions(fused(spark, folder), WEIGHTS, LINE)
    return top.select(*LINE, "rank", "channel", r("contribution", 5))


@query("risk_confidence", "WITH " + CHANNELS_SQL + " SELECT order_id, line_no, part_id, amount, round(confidence, 6) AS confidence FROM fu")
def _(spark, folder):
    return fused(spark, folder).select(*LINE, r("confidence"))


@query("decide_action", "WITH " + CHANNELS_SQL + " SELECT order_id, line_no, part_id, amount, o1 + o2 AS channels_over, action FROM de")
def _(spark, folder):
    return decided(spark, folder).select(*LINE, "channels_over", "action")


@query("decision_filter", "WITH " + CHANNELS_SQL + " SELECT action, count(*) AS n, round(sum(amount), 2) AS amount FROM de WHERE action <> 'allow' GROUP BY 1")
def _(spark, folder):
    kept = D.decision_filter(decided(spark, folder))
    return kept.groupBy("action").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


@query("fail_open", "WITH " + CONTEXT_SQL + """
SELECT CASE WHEN centre IS NULL THEN 'monitor' ELSE action END AS action, count(*) AS n,
  round(avg(CASE WHEN centre IS NULL THEN 0 ELSE confidence END), 6) AS confidence
FROM de LEFT JOIN pf ON de."user" = pf."user" AND de.device = pf.device GROUP BY 1""")
def _(spark, folder):
    rows = decided(spark, folder)
    profiles = channels(spark, folder).where("kind = 'O'").groupBy("user", "device").agg(
        F.count("*").alias("n")
    ).where("n >= 2").select("user", "device", F.lit(1).alias("has_profile"))
    opened = U.fail_open(rows.join(profiles, ["user", "device"], "left"), ["has_profile"])
    return opened.groupBy("action").agg(
        F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence")
    )


def split_halves(rows):
    """Held-out and scored halves by a hash of the order."""
    side = F.pmod(F.xxhash64("order_id"), F.lit(2))
    return rows.where(side == 0), rows.where(side == 1)


@query("fit_fusion")
def _(spark, folder):
    training, rest = split_halves(standardised(spark, folder))
    weights, intercept = U.fit_fusion(training, "label")
    fitted = U.fuse_risk(rest, weights, intercept)
    return fitted.groupBy("label").agg(F.count("*").alias("n"), F.avg("risk").alias("mean_risk"))


@query("boosted_scores")
def _(spark, folder):
    rows = standardised(spark, folder).select(*LINE, "label", *[f"z_{c}" for c in U.CHANNELS])
    training, rest = split_halves(rows)
    found = U.boosted_scores(training, rest, "label")
    return found.groupBy("label").agg(F.count("*").alias("n"), F.avg("boosted").alias("mean_boosted"))


@query("calibrate")
def _(spark, folder):
    held, scored = split_halves(fused(spark, folder).select(*LINE, "label", "risk"))
    both = U.calibrate(held, scored, "risk", "label", "platt").withColumnRenamed("calibrated", "platt")
    both = U.calibrate(held, both, "risk", "label", "isotonic").withColumnRenamed("calibrated", "isotonic")
    return both.groupBy("label").agg(
        F.count("*").alias("n"), F.avg("platt").alias("platt"), F.avg("isotonic").alias("isotonic")
    )


@query("risk_tier", "WITH " + CHANNELS_SQL + """
SELECT CAST(1 + CAST(risk >= 25 AS INTEGER) + CAST(risk >= 50 AS INTEGER) + CAST(risk >= 75 AS INTEGER) AS INTEGER) AS tier, count(*) AS n, round(avg(risk), 5) AS risk_100
FROM fu GROUP BY 1""")
def _(spark, folder):
    tiers = U.risk_tier(fused(spark, folder).withColumn("calibrated", F.col("risk") / 100))
    return tiers.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("risk_100"), 5).alias("risk_100"))


# Fitted on orders with an even number and applied to the others; scores are tenths of a risk point.
ISOTONIC = CHANNELS_SQL + """,
ri AS (SELECT order_id, line_no, part_id, amount, label, round(risk, 1) AS x FROM fu),
ho AS (SELECT x, count(*) AS w, sum(label) AS y FROM ri WHERE order_id % 2 = 0 GROUP BY 1),
pt AS (SELECT x, w, y, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS cw, sum(y) OVER (ORDER BY x) AS cy FROM ho),
mm AS (SELECT b.x, min((b.cy - a.cy + a.y) / (b.cw - a.cw + a.w)::DOUBLE) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS low FROM pt a JOIN pt b ON b.i >= a.i),
iso AS (SELECT x, max(low) AS value FROM mm GROUP BY 1),
lw AS (SELECT ri.*, iso.x AS x0, iso.value AS v0 FROM ri ASOF LEFT JOIN iso ON ri.x >= iso.x WHERE order_id % 2 = 1),
cal AS (SELECT lw.order_id, lw.line_no, lw.part_id, lw.amount, CASE WHEN x0 IS NULL THEN iso.value WHEN iso.x IS NULL OR x0 = lw.x THEN v0
    ELSE v0 + (lw.x - x0) / (iso.x - x0) * (iso.value - v0) END AS calibrated FROM lw ASOF LEFT JOIN iso ON lw.x <= iso.x)"""


def isotonic(spark, folder):
    rows = fused(spark, folder).select(*LINE, "label", F.round("risk", 1).alias("x"))
    even = F.col("order_id") % 2 == 0
    return U.calibrate(rows.where(even), rows.where(~even), "x", "label", "isotonic")


@query("isotonic_calibration", "WITH " + ISOTONIC + " SELECT order_id, line_no, part_id, amount, round(calibrated, 6) AS calibrated FROM cal")
def _(spark, folder):
    return isotonic(spark, folder).select(*LINE, r("calibrated"))


@query("calibrated_tiers", "WITH " + ISOTONIC + """
SELECT CAST(1 + CAST(100 * calibrated >= 25 AS INTEGER) + CAST(100 * calibrated >= 50 AS INTEGER) + CAST(100 * calibrated >= 75 AS INTEGER) AS INTEGER) AS tier,
  count(*) AS n, round(avg(100 * calibrated), 4) AS risk_100 FROM cal GROUP BY 1""")
def _(spark, folder):
    """Tiers of calibrated probabilities, as the design asks for; ``risk_tier`` takes the uncalibrated risk."""
    tiers = U.risk_tier(isotonic(spark, folder))
    return tiers.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("risk_100"), 4).alias("risk_100"))


METRICS = """CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision,
  round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1, round(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS fpr"""
COUNTS = """count_if(flag AND label = 1) AS tp, count_if(flag AND label = 0) AS fp, count_if(NOT flag AND label = 1) AS fn, count_if(NOT flag AND label = 0) AS tn"""


def rounded_metrics(df, by=()):
    return df.select(*by, "tp", "fp", "fn", "tn", r("precision"), r("recall"), r("f1"), r("fpr"))


@query("ablation_table", "WITH " + CHANNELS_SQL + """,
lo AS (SELECT label, unnest(['A', 'B', 'C', 'D', 'E', 'F']) AS configuration, unnest([0.7 * z3, 0.8 * z1, 0.8 * z1 + 0.7 * z3, 0.8 * z1 + 0.7 * z3 + 0.6 * z2,
   0.9 * z1 + 0.7 * z3 + 0.6 * z2 + 0.4 * z4, 0.8 * z1 + 0.6 * z2 + 0.7 * z3 + 0.4 * z4 + 0.9 * z5]) >= 0 AS flag FROM zz),
c AS (SELECT configuration, """ + COUNTS + " FROM lo GROUP BY 1) SELECT configuration, " + METRICS + " FROM c")
def _(spark, folder):
    return rounded_metrics(U.ablation_table(standardised(spark, folder), "label", LADDER), ["configuration"])


@query("classification_metrics", "WITH " + CHANNELS_SQL + ", f AS (SELECT label, action <> 'allow' AS flag FROM de), c AS (SELECT " + COUNTS + " FROM f) SELECT " + METRICS + " FROM c")
def _(spark, folder):
    flagged = decided(spark, folder).withColumn("flag", (F.col("action") != "allow").cast("int"))
    return rounded_metrics(D.classification_metrics(flagged, "label", "flag"))


@query("detection_rate_by_class", "WITH " + CHANNELS_SQL + """
SELECT attack_class, count(*) AS sessions, round(avg(CASE WHEN action <> 'allow' THEN 1.0::DOUBLE ELSE 0 END), 6) AS detection_rate FROM de GROUP BY 1""")
def _(spark, folder):
    flagged = decided(spark, folder).withColumn("flag", (F.col("action") != "allow").cast("int"))
    rates = D.detection_rate_by_class(flagged, "attack_class", "flag")
    return rates.select("attack_class", "sessions", r("detection_rate"))


LOSS = "WITH " + CHANNELS_SQL + """,
fl AS (SELECT "user", min(ts) AS detected_at FROM de WHERE action IN ('restrict', 'block') GROUP BY 1),
lo AS (SELECT de."user", sum(CASE WHEN detected_at IS NULL OR ts < detected_at THEN amount ELSE 0 END) AS lost,
   CAST(count_if(detected_at IS NULL OR ts < detected_at) AS BIGINT) AS transfers_before, (epoch(max(detected_at)) - epoch(min(ts))) / 86400 AS days_to_detection,
   max(CASE WHEN detected_at IS NULL THEN 0 ELSE 1 END) AS detected FROM de LEFT JOIN fl ON de."user" = fl."user" GROUP BY 1)"""


def losses(spark, folder):
    stopped = F.col("action").isin("restrict", "block").cast("int")
    return D.loss_before_detection(decided(spark, folder).withColumn("flag", stopped), ["user"], "flag")


@query("loss_before_detection", LOSS + """ SELECT "user", round(lost, 2) AS lost, transfers_before, round(days_to_detection, 6) AS days_to_detection, detected FROM lo""")
def _(spark, folder):
    return losses(spark, folder).select(
        "user", r("lost", 2), "transfers_before", r("days_to_detection"), "detected"
    )


@query("loss_distribution", LOSS + """ SELECT detected, count(*) AS campaigns, round(quantile_cont(lost, 0.25), 3) AS p25, round(quantile_cont(lost, 0.5), 3) AS p50,
  round(quantile_cont(lost, 0.75), 3) AS p75, round(quantile_cont(lost, 0.95), 3) AS p95, round(max(lost), 3) AS largest FROM lo GROUP BY 1""")
def _(spark, folder):
    d = D.loss_distribution(losses(spark, folder))
    return d.select("detected", "campaigns", *[r(c, 3) for c in ("p25", "p50", "p75", "p95", "largest")])


@query("friction_rate", "WITH " + CHANNELS_SQL + """,
t AS (SELECT quantile_cont(risk, 0.2) AS lim FROM fu WHERE label = 1)
SELECT round(any_value(lim), 5) AS limit_risk, count(*) AS genuine, round(avg(CASE WHEN risk >= lim THEN 1.0::DOUBLE ELSE 0 END), 6) AS friction_rate FROM fu, t WHERE label = 0""")
def _(spark, folder):
    found = D.friction_rate(fused(spark, folder), "label", "risk", 0.8)
    return found.select(F.round("limit", 5).alias("limit_risk"), "genuine", r("friction_rate"))


@query("latency_percentiles", """
SELECT l_linestatus AS kind, count(*) AS calls, round(quantile_cont(l_quantity::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(l_quantity::DOUBLE, 0.95), 6) AS p95,
  round(1000 * avg(l_tax), 6) AS cost_per_thousand FROM lineitem GROUP BY 1""")
def _(spark, folder):
    log = table(spark, folder, "lineitem").select(
        F.col("l_linestatus").alias("kind"), F.col("l_quantity").alias("millis"), F.col("l_tax").alias("cost")
    )
    found = D.latency_percentiles(log, "kind", "millis", "cost")
    return found.select("kind", "calls", r("p50"), r("p95"), r("cost_per_thousand"))


@query("user_timeline", "WITH " + CHANNELS_SQL + """ SELECT "user", CAST(epoch(ts) AS BIGINT) AS ts, order_id, line_no, amount, action FROM de ORDER BY 1, 2, 3""")
def _(spark, folder):
    rows = decided(spark, folder).select("user", "ts", "order_id", "line_no", "amount", "action")
    timeline = D.user_timeline(rows, "user", "order_id")
    return timeline.withColumn("ts", F.unix_seconds("ts"))


@query("one_user_timeline", "WITH " + CHANNELS_SQL + """
SELECT "user", CAST(epoch(ts) AS BIGINT) AS ts, order_id, line_no, amount, action FROM de WHERE "user" = (SELECT min("user") FROM de)""")
def _(spark, folder):
    """The decisions of one user, read by key from decisions stored by user."""
    rows = decided(spark, folder).select("user", "ts", "order_id", "line_no", "amount", "action")
    path = lake.publish_features(rows, scratch_path(spark, "decisions"), "2000-01-01", ["user"])
    stored = spark.read.parquet(path)
    first = stored.agg(F.min("user")).first()[0]
    timeline = D.user_timeline(stored.drop("snapshot", "computed_at"), "user", "order_id", one=first)
    return timeline.withColumn("ts", F.unix_seconds("ts"))


def decision_events(spark, folder):
    """Decision events: the action follows the code of the event, purchases may verify."""
    k = F.col("k")
    action = F.when(k < 5, "block").when(k < 15, "restrict").when(k < 40, "step_up").otherwise("allow")
    verified = (F.col("event_type") == "purchase") & (k < 50)
    kind = F.when(verified, lake.ADAPTATION_EVENT).otherwise("decision.made")
    return events(spark, folder).select(
        "event_id", "user_id", "ts", "value", action.alias("action"), kind.alias("event_type")
    )


ROUTED = EVENTS + """,
de AS (SELECT event_id, ts, value, CASE WHEN k < 5 THEN 'block' WHEN k < 15 THEN 'restrict' WHEN k < 40 THEN 'step_up' ELSE 'allow' END AS action,
         event_type = 'purchase' AND k < 50 AS verified FROM ev),
routed AS (SELECT 'lake' AS target, * FROM de UNION ALL SELECT 'adaptation', * FROM de WHERE verified
           UNION ALL SELECT 'alerts', * FROM de WHERE action IN ('restrict', 'block'))"""
ROUTED_TOTALS = "WITH " + ROUTED + " SELECT target, count(*) AS n, round(sum(value), 2) AS value FROM routed GROUP BY 1"


def routed_totals(spark, root):
    out = None
    for target in ("lake", "adaptation", "alerts"):
        counted = spark.read.parquet(f"{root}/{target}").agg(
            F.lit(target).alias("target"), F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value")
        )
        out = counted if out is None else out.unionByName(counted)
    return out


@query("route_events", ROUTED_TOTALS)
def _(spark, folder):
    root = scratch_path(spark, "routed")
    lake.route_events(decision_events(spark, folder), root)
    return routed_totals(spark, root)


@query("scan_lake", "WITH " + ROUTED + """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, action, count(*) AS n FROM de WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2""")
def _(spark, folder):
    root = scratch_path(spark, "scanned")
    lake.route_events(decision_events(spark, folder), root)
    days = lake.scan_lake(spark, root, "2024-01-10", "2024-01-19")
    return days.groupBy(F.col("date").cast("string").alias("date"), "action").agg(F.count("*").alias("n"))
