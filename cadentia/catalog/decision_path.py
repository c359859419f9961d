"""The decision path end to end: what was published up to a day decides the transfers after it.

Every fact comes from the operator that computes it: profiles, device history, edges with their
regularity, payee risk and the user's amounts are published as snapshots and read back; a transfer meets
them by key, is scored in all five channels, fused and decided. The given tables name no devices, so
the order priority serves as one, and a device seen for the first time counts as a change.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cadentia.catalog.deciding import INTERCEPT, LINE, WEIGHTS, r
from cadentia.catalog.payments import AS_OF, PAYEE_RISK
from cadentia.catalog.registry import query
from cadentia.catalog.views import TRANSFER_ORDER, flagged, outflows, table
from cadentia.functions.scalars import day_slot, safe_ratio
from cadentia.operators import fusion as U
from cadentia.operators import outcomes as D
from cadentia.operators import profiles as P
from cadentia.operators import sessions as S
from cadentia.operators import transfers as T
from cadentia.plans.ordered import running
from cadentia.session import materialise, scratch_path
from cadentia.sources import lake

HALF_LIFE_DAYS = 90.0
NEEDED = ["has_profile", "has_user"]


def log(spark, folder):
    """Transfers with their device and a second measure, stored once."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("sender"),
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderpriority").alias("device"),
    )
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("payee"), F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"), F.col("l_extendedprice").alias("amount"),
        F.col("l_quantity").cast("double").alias("quantity"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )
    return materialise(lines.join(orders, "order_id"), "transfer-sessions")


def measures():
    """The vector of two measures, formed where it is read."""
    return F.array("amount", "quantity").alias("x")


def published(df, name, keys):
    """Publish a snapshot and read it back, as a later job would."""
    spark = df.sparkSession
    path = lake.publish_features(df, scratch_path(spark, name), AS_OF, keys)
    return spark.read.parquet(f"{path}/snapshot={AS_OF}")


def state(spark, folder, rows):
    """Snapshots of profiles, devices, edges, payees and users by all rows up to the day."""
    past = rows.where(F.col("ts") <= F.lit(AS_OF).cast("timestamp"))
    vectors = past.select("sender", "device", measures())
    profiles = P.fit_profiles(vectors, ["sender", "device"], "x").select("sender", "device", "centre", "dispersion")
    devices = S.device_history(past, "sender", "device").select("sender", "device", "session_count")
    edges = T.interval_regularity(past, TRANSFER_ORDER)
    risk = T.payee_risk(past, outflows(spark, folder), flagged(spark, folder), AS_OF).select("payee", "risk_score")
    marked = risk.join(flagged(spark, folder).withColumn("batch_flag", F.lit(1)), "payee", "left")
    counts = past.groupBy("sender").agg(F.count("*").alias("transfers"))
    users = T.robust_scale(past, "sender", "amount").join(counts, "sender")
    keyed = ((profiles, "profiles", ["sender", "device"]), (devices, "devices", ["sender", "device"]),
             (edges, "edges", ["sender", "payee"]), (marked, "payees", ["payee"]), (users, "users", ["sender"]))
    sides = {name: published(df, name, keys) for df, name, keys in keyed}
    # The age of the payee's snapshot is evidence; the other sides are read for their values.
    return [side if name == "payees" else side.drop("computed_at") for name, side in sides.items()]


def scored(spark, folder):
    """Transfers after the day with raw scores and confidences of all channels, stored once."""
    rows = log(spark, folder)
    # An ordered pass reads its input twice, so the later ones are stored. Past rows are passed along for their order only.
    # The first is not: rows that come twice tie, and a stored table would number them the other way round.
    later = F.col("ts") > F.lit(AS_OF).cast("timestamp")
    light = rows.withColumns({c: F.when(later, F.col(c)) for c in ("payee", "quantity", "label")})
    seen = S.prior_sessions(light, "sender", "device", TRANSFER_ORDER)
    changed = S.recent_change(seen, "sender", "ts", F.col("prior_sessions") == 0, TRANSFER_ORDER).drop("last_change")
    again = running(
        materialise(changed, "changed"), ["sender", "part_id", "amount"], TRANSFER_ORDER, day_slot(F.col("ts")),
        totals={"times": F.lit(1).cast("long")},
    )
    now = materialise(again.where(later).withColumn("x", measures()), "now")
    met = U.session_context(now, *state(spark, folder, rows), user="sender")
    facts = met.withColumns(
        {
            "anomaly": F.when(F.col("centre").isNotNull(), P.score_of(F.col("x"), F.col("centre"), F.col("dispersion"))),
            "replayed": (F.col("times") > 1).cast("int"),
            "robust_z": safe_ratio(F.col("amount") - F.col("median"), F.col("mad")),
            "payee_risk": F.col("risk_score"),
            "keystrokes": F.col("session_count") * 2,
            "buffer": F.col("session_count"),
            "gaps": F.col("txn_count") - 1,
            "device_sessions": F.col("session_count"),
            "payee_age_days": F.datediff("ts", "computed_at").cast("double"),
        }
    )
    sufficient = U.channel_confidence(U.channel_scores(facts), half_life_days=HALF_LIFE_DAYS)
    kept = [*[f"s_{c}" for c in U.CHANNELS], *[f"c_{c}" for c in U.CHANNELS], "batch_flag", *NEEDED]
    return materialise(sufficient.select(*LINE, "sender", "payee", "ts", "label", *kept), "scored")


def decided(spark, folder):
    rows = scored(spark, folder)
    z = U.standardise(rows, U.channel_scales(rows))
    fused = U.risk_confidence(U.fuse_risk(z, WEIGHTS, INTERCEPT), WEIGHTS)
    return U.fail_open(U.decide_action(fused, batch_flag="batch_flag"), NEEDED)


PATH_SQL = "WITH " + PAYEE_RISK + """,
tf AS (SELECT o_custkey AS sender, o_orderpriority AS device, l_suppkey AS payee, o_orderdate AS ts, l_extendedprice AS amount, l_quantity::DOUBLE AS qty,
    l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part_id, CAST(l_returnflag = 'R' AS INTEGER) AS label
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
past AS (SELECT * FROM tf WHERE ts <= TIMESTAMP '2000-01-01'),
dc AS (SELECT sender, device, count(*) AS session_count, avg(amount) AS c0, avg(qty) AS c1 FROM past GROUP BY 1, 2),
pf AS (SELECT past.sender, past.device, any_value(c0) AS c0, any_value(c1) AS c1, greatest(avg(abs(amount - c0)), 1e-4) AS d0,
    greatest(avg(abs(qty - c1)), 1e-4) AS d1 FROM past JOIN dc ON past.sender = dc.sender AND past.device = dc.device WHERE session_count >= 2 GROUP BY 1, 2),
gp AS (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY sender, payee ORDER BY ts, order_id, line_no, part_id, amount)) AS gap FROM past),
eg AS (SELECT sender, payee, count(*) AS txn_count, CASE WHEN avg(gap) <> 0 THEN stddev_samp(gap) / avg(gap) END AS cv FROM gp GROUP BY 1, 2),
md AS (SELECT sender, count(*) AS n, quantile_cont(amount, 0.5) AS med FROM past GROUP BY 1),
us AS (SELECT past.sender, any_value(n) AS n, any_value(med) AS med, quantile_cont(abs(amount - med), 0.5) AS mad FROM past JOIN md ON past.sender = md.sender GROUP BY 1),
pd AS (SELECT *, row_number() OVER (PARTITION BY sender, device ORDER BY ts, order_id, line_no, part_id, amount) - 1 AS prior,
    row_number() OVER (PARTITION BY sender, part_id, amount ORDER BY ts, order_id, line_no) AS times FROM tf),
lc AS (SELECT *, max(CASE WHEN prior = 0 THEN ts END) OVER (PARTITION BY sender ORDER BY ts, order_id, line_no, part_id, amount ROWS UNBOUNDED PRECEDING) AS changed FROM pd),
raw AS (SELECT lc.order_id, lc.line_no, lc.part_id, lc.amount, lc.sender, lc.payee, lc.ts, lc.label,
    abs(lc.amount - pf.c0) / d0 + abs(qty - pf.c1) / d1 AS s1, greatest(1 - least(coalesce(cv, 1), 1), CAST(times > 1 AS DOUBLE)) AS s2,
    abs((lc.amount - med) / nullif(mad, 0)) AS s3,
    1.0::DOUBLE / (1 + prior) + CASE WHEN epoch(lc.ts) - epoch(changed) <= 7 * 86400 THEN 1 ELSE 0 END AS s4, risk_score AS s5,
    least(coalesce(session_count, 0) * 2 / 50.0::DOUBLE, 1) * least(coalesce(session_count, 0) / 20.0::DOUBLE, 1) AS e1,
    least(coalesce(txn_count - 1, 0) / 20.0::DOUBLE, 1) AS e2, least(coalesce(us.n, 0) / 10.0::DOUBLE, 1) AS e3,
    least(coalesce(session_count, 0) / 10.0::DOUBLE, 1) AS e4,
    CASE WHEN pr.payee IS NULL THEN 0 ELSE exp(-date_diff('day', DATE '2000-01-01', CAST(lc.ts AS DATE)) / 90.0::DOUBLE) END AS e5,
    lc.payee IN (SELECT payee FROM flagged) AND pr.payee IS NOT NULL AS flag, pf.sender IS NOT NULL AND us.sender IS NOT NULL AS known
  FROM lc LEFT JOIN pf ON lc.sender = pf.sender AND lc.device = pf.device LEFT JOIN dc ON lc.sender = dc.sender AND lc.device = dc.device
    LEFT JOIN eg ON lc.sender = eg.sender AND lc.payee = eg.payee LEFT JOIN pr ON lc.payee = pr.payee LEFT JOIN us ON lc.sender = us.sender
  WHERE lc.ts > TIMESTAMP '2000-01-01'),
sc AS (SELECT avg(s1) AS m1, stddev_samp(s1) AS v1, avg(s2) AS m2, stddev_samp(s2) AS v2, avg(s3) AS m3, stddev_samp(s3) AS v3,
    avg(s4) AS m4, stddev_samp(s4) AS v4, avg(s5) AS m5, stddev_samp(s5) AS v5 FROM raw),
zz AS (SELECT raw.*, coalesce(e1 * (s1 - m1) / v1, 0) AS z1, coalesce(e2 * (s2 - m2) / v2, 0) AS z2, coalesce(e3 * (s3 - m3) / v3, 0) AS z3,
    coalesce(e4 * (s4 - m4) / v4, 0) AS z4, coalesce(e5 * (s5 - m5) / v5, 0) AS z5 FROM raw, sc),
fu AS (SELECT *, 100 / (1 + exp(-(0.5::DOUBLE + 0.8 * z1 + 0.6 * z2 + 0.7 * z3 + 0.4 * z4 + 0.9 * z5))) AS risk,
    CASE WHEN known THEN (0.8 * e1 + 0.6 * e2 + 0.7 * e3 + 0.4 * e4 + 0.9 * e5) / 3.4::DOUBLE ELSE 0 END AS confidence,
    CAST(z1 > 1 AS INTEGER) AS o1, CAST(z2 > 1 AS INTEGER) + CAST(z3 > 1 AS INTEGER) + CAST(z4 > 1 AS INTEGER) + CAST(z5 > 1 AS INTEGER) AS o2 FROM zz),
de AS (SELECT *, CASE WHEN NOT known THEN 'monitor' WHEN risk >= 90 AND o2 >= 1 AND (o1 + o2 >= 2 OR flag) THEN 'block'
    WHEN risk >= 75 AND o2 >= 1 THEN 'restrict' WHEN risk >= 50 THEN 'step_up' ELSE 'allow' END AS action FROM fu)"""


@query("decision_path", PATH_SQL + """
SELECT order_id, line_no, part_id, amount, round(risk, 4) AS risk, round(confidence, 6) AS confidence, o1 + o2 AS channels_over, action FROM de""")
def _(spark, folder):
    return decided(spark, folder).select(*LINE, r("risk", 4), r("confidence"), "channels_over", "action")


@query("decision_path_outcomes", PATH_SQL + """
SELECT action, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(sum(amount), 2) AS amount FROM de
WHERE action IN ('step_up', 'restrict', 'block') GROUP BY 1""")
def _(spark, folder):
    stopped = D.decision_filter(decided(spark, folder))
    return stopped.groupBy("action").agg(
        F.count("*").alias("n"), F.sum("label").alias("positives"), F.round(F.sum("amount"), 2).alias("amount")
    )
