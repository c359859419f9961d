"""The analytics inputs as views over the generic tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadentia.sources.observations import read_observations

WIDTH = 64
FEATURES = [f"f{i}" for i in range(WIDTH)]
N_ENROL, K_IMPOSTOR = 20, 5


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_observations(spark, f"{folder}/{name}.parquet", fmt="parquet")


def obs(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated vectors per subject: subject = label, order = vec_id."""
    return table(spark, folder, "embeddings").select(
        "vec_id", F.col("label").alias("subject"), F.col("embedding").cast("array<double>").alias("features")
    )


OBS = """
obs AS (SELECT label AS subject, vec_id,
               row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rr, embedding FROM embeddings),
cells AS (SELECT subject, vec_id, rr, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM obs),
centres AS (SELECT subject, pos, avg(x) AS c, stddev_samp(x) AS sd FROM cells WHERE rr <= 20 GROUP BY 1, 2),
prof AS (SELECT l.subject, l.pos, any_value(c) AS c, greatest(avg(abs(x - c)), 1e-4) AS mad,
                greatest(any_value(sd), 1e-4) AS sd, avg(abs(x - c)) AS raw_mad, count(*) AS n
         FROM cells l JOIN centres m ON l.subject = m.subject AND l.pos = m.pos WHERE rr <= 20 GROUP BY 1, 2)"""

SCORES = (
    OBS
    + """,
scores AS (
  SELECT l.subject, 0 AS label, vec_id, sum(abs(x - c) / mad) AS score, sum(abs(x - c) / sd) AS score_std
  FROM cells l JOIN prof p ON l.subject = p.subject AND l.pos = p.pos WHERE rr > 20 GROUP BY 1, 3
  UNION ALL
  SELECT p.subject, 1, vec_id, sum(abs(x - c) / mad), sum(abs(x - c) / sd)
  FROM cells l JOIN prof p ON l.subject <> p.subject AND l.pos = p.pos WHERE rr <= 5 GROUP BY 1, l.subject, vec_id)"""
)


def curve_sql(score: str, tag: str) -> str:
    """CTEs ``curve_<tag>(subject, threshold, far, frr, pf, pd, d)`` from ``scores``."""
    return f""",
cnt_{tag} AS (SELECT subject, {score} AS s, sum(1 - label) AS ng, sum(label) AS ni FROM scores GROUP BY 1, 2),
tot_{tag} AS (SELECT subject, sum(ng) AS g, sum(ni) AS i FROM cnt_{tag} GROUP BY 1),
pts_{tag} AS (SELECT * FROM cnt_{tag} UNION ALL SELECT subject, CAST('Infinity' AS DOUBLE), 0, 0 FROM tot_{tag}),
cum_{tag} AS (SELECT p.subject, s AS threshold,
    coalesce(sum(ni) OVER w, 0) / CAST(i AS DOUBLE) AS far, 1 - coalesce(sum(ng) OVER w, 0) / CAST(g AS DOUBLE) AS frr
  FROM pts_{tag} p JOIN tot_{tag} t ON p.subject = t.subject
  WINDOW w AS (PARTITION BY p.subject ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
curve_{tag} AS (SELECT *, far - frr AS d, lag(far) OVER o AS pf, lag(far - frr) OVER o AS pd
  FROM cum_{tag} WINDOW o AS (PARTITION BY subject ORDER BY threshold)),
eer_{tag} AS (SELECT subject, pf + (-pd / (d - pd)) * (far - pf) AS eer FROM curve_{tag} WHERE d >= 0 AND pd < 0)"""


def events(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "events")
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )


EVENTS = """
ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""

SESSION_GAP = 12 * 3600


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Events with ``gap`` to the previous event of the user and ``session_no``."""
    from cadentia.operators.sessions import sessionise

    return sessionise(events(spark, folder), "user_id", "ts", ["ts", "event_id"], SESSION_GAP)


SESSIONS = (
    EVENTS
    + """,
gaps AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS gap FROM ev
         WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
sess AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > 43200 THEN 1 ELSE 0 END) OVER (
           PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM gaps)"""
)

TRANSFER_ORDER = ["ts", "order_id", "line_no", "part_id", "amount"]


def transfers(spark: SparkSession, folder: str) -> DataFrame:
    """Transfers: customer to supplier at the order date, amount = extended price."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("sender"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
    )
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_suppkey").alias("payee"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_extendedprice").alias("amount"),
    )
    return lines.join(orders, "order_id")


TRANSFERS = """
transfers AS (SELECT o_custkey AS sender, l_suppkey AS payee, o_orderdate AS ts, l_extendedprice AS amount,
    l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part_id
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def outflows(spark: SparkSession, folder: str) -> DataFrame:
    """Returned lines as payments back from the payee at the ship date."""
    lines = table(spark, folder, "lineitem").where(F.col("l_returnflag") == "R")
    orders = table(spark, folder, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").alias("payee"),
        F.col("o_custkey").alias("recipient"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_extendedprice").alias("amount"),
    )


OUTFLOWS = (
    TRANSFERS
    + """,
outflows AS (SELECT l_suppkey AS payee, o_custkey AS recipient, l_shipdate AS ts, l_extendedprice AS amount
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R')"""
)


def flagged(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged accounts: suppliers at or below the lower decile of the balance."""
    from cadentia.plans.quantiles import exact_quantiles

    suppliers = table(spark, folder, "supplier")
    limit = exact_quantiles(suppliers.withColumn("all", F.lit(1)), ["all"], "s_acctbal", {"limit": 0.1})
    return (
        suppliers.join(F.broadcast(limit.drop("all")))  # one row
        .where(F.col("s_acctbal") <= F.col("limit"))
        .select(F.col("s_suppkey").alias("payee"))
    )


FLAGGED = """
flagged AS (SELECT s_suppkey AS payee FROM supplier
  WHERE s_acctbal <= (SELECT quantile_cont(s_acctbal, 0.1) FROM supplier))"""
