"""What decisions achieved: detection, losses, friction, latency, timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadentia.functions.scalars import q, safe_ratio
from cadentia.plans.quantiles import exact_quantiles


def classification_metrics(
    decisions: DataFrame, label: str, flag: str, by: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall, F1 and false-positive rate; null where undefined."""
    hit, positive = q(flag).cast("int") == 1, q(label).cast("int") == 1
    counts = decisions.groupBy(*by).agg(
        F.count_if(hit & positive).alias("tp"),
        F.count_if(hit & ~positive).alias("fp"),
        F.count_if(~hit & positive).alias("fn"),
        F.count_if(~hit & ~positive).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *by, "tp", "fp", "fn", "tn",
        safe_ratio(tp, tp + fp).alias("precision"),
        safe_ratio(tp, tp + fn).alias("recall"),
        safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        safe_ratio(fp, fp + tn).alias("fpr"),
    )


def detection_rate_by_class(decisions: DataFrame, attack_class: str, flag: str) -> DataFrame:
    return decisions.where(q(attack_class).isNotNull()).groupBy(attack_class).agg(
        F.count("*").alias("sessions"), F.avg(q(flag).cast("double")).alias("detection_rate")
    )


def decision_filter(decisions: DataFrame) -> DataFrame:
    """Decisions that ask for a response."""
    return decisions.where(F.col("action").isin("step_up", "restrict", "block"))


def loss_before_detection(
    transfers: DataFrame, campaign: Sequence[str], flag: str, ts: str = "ts", amount: str = "amount"
) -> DataFrame:
    """Per campaign: money, transfers and days before the first flagged transfer.

    A campaign never flagged loses everything and has no time to detection.
    """
    keys = list(campaign)
    first = transfers.where(q(flag).cast("int") == 1).groupBy(*keys).agg(F.min(ts).alias("detected_at"))
    before = F.col("detected_at").isNull() | (q(ts) < F.col("detected_at"))
    days = (F.unix_seconds(F.max("detected_at")) - F.unix_seconds(F.min(ts))) / 86_400
    return transfers.join(first, keys, "left").groupBy(*keys).agg(
        F.sum(F.when(before, q(amount)).otherwise(0.0)).alias("lost"),
        F.count_if(before).alias("transfers_before"),
        days.alias("days_to_detection"),
        F.max(F.when(F.col("detected_at").isNotNull(), 1).otherwise(0)).alias("detected"),
    )


def loss_distribution(losses: DataFrame) -> DataFrame:
    """Quartiles, 95th percentile and maximum of money lost; heavy tails defy a mean."""
    marked = losses.withColumn("detected", F.col("detected").cast("int"))
    spread = exact_quantiles(
        marked, ["detected"], "lost", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "largest": 1.0}
    )
    counts = marked.groupBy("detected").agg(F.count("*").alias("campaigns"))
    return counts.join(spread, "detected")


def friction_rate(
    decisions: DataFrame, label: str, score: str, catch_rate: float, by: Sequence[str] = ()
) -> DataFrame:
    """Share of genuine sessions bothered when ``catch_rate`` of the attacks are caught.

    The limit is the attack-score quantile that leaves the wanted share at or above it.
    """
    keys = list(by) or ["_all"]
    rows = decisions if by else decisions.withColumn("_all", F.lit(1))
    attacks = rows.where(q(label).cast("int") == 1)
    limits = exact_quantiles(attacks, keys, score, {"limit": 1 - catch_rate})
    genuine = rows.where(q(label).cast("int") == 0)
    # Without groups there is one limit: a row that every task can hold.
    genuine = genuine.join(limits, keys) if by else genuine.join(F.broadcast(limits.drop("_all")))
    bothered = F.when(q(score) >= F.col("limit"), 1.0).otherwise(0.0)
    return genuine.groupBy(*keys).agg(
        F.max("limit").alias("limit"), F.count("*").alias("genuine"), F.avg(bothered).alias("friction_rate")
    ).drop("_all")


def latency_percentiles(
    log: DataFrame, kind: str, millis: str, cost: str | None = None
) -> DataFrame:
    """Per kind (warm, cold): calls, p50, p95 and, with a cost column, cost per thousand."""
    spread = exact_quantiles(log, [kind], millis, {"p50": 0.5, "p95": 0.95})
    stats = [F.count("*").alias("calls")]
    if cost is not None:
        stats.append((1000 * F.avg(cost)).alias("cost_per_thousand"))
    return log.groupBy(kind).agg(*stats).join(spread, kind)


def user_timeline(decisions: DataFrame, user: str, decision: str, one: object = None) -> DataFrame:
    """Decisions in time order, of every user or of one."""
    rows = decisions if one is None else decisions.where(q(user) == F.lit(one))
    return rows.orderBy(q(user), q("ts"), q(decision))
