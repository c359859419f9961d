"""Payee and destination features over a log of transfers.

Everything that counts distinct parties starts from one row per (sender,
payee) edge, so no distinct set is ever built for a busy account.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadentia.functions.scalars import (
    DAY_SECONDS, coefficient_of_variation, day_slot, hour_of_day, magnitude_slot, q, safe_ratio,
)
from cadentia.plans.joins import null_safe_join
from cadentia.plans.ordered import running, trailing
from cadentia.plans.quantiles import exact_quantiles
from cadentia.session import materialise

# Default weights and full-scale values of the destination score; the reference
# design names its parts but fixes no numbers, so they are parameters.
RISK_WEIGHTS = {
    "distinct_senders_30d": 0.25,
    "new_sender_fraction": 0.25,
    "fan_ratio": 0.2,
    "quick_exit": 0.1,
    "flagged_overlap": 0.2,
}
RISK_SCALES = {"distinct_senders_30d": 50.0, "fan_ratio": 10.0, "pass_through_days": 3.0}


def _as_of(moment: str) -> Column:
    return F.lit(moment).cast("timestamp")


def payee_edge_features(transfers: DataFrame, as_of: str | None = None) -> DataFrame:
    """Per (sender, payee): first and last transfer, count, cumulative amount."""
    rows = transfers if as_of is None else transfers.where(F.col("ts") <= _as_of(as_of))
    return rows.groupBy("sender", "payee").agg(
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.count("*").alias("txn_count"),
        F.sum("amount").alias("cum_amount"),
    )


def first_seen(transfers: DataFrame) -> DataFrame:
    """Transfers plus the time of the first one on the same edge."""
    edges = transfers.groupBy("sender", "payee").agg(F.min("ts").alias("first_seen"))
    return transfers.join(edges, ["sender", "payee"])


def new_payee_volume(transfers: DataFrame, days: int = 30) -> DataFrame:
    """Per sender, the amount sent to payees within ``days`` of adding them."""
    fresh = F.unix_seconds("ts") <= F.unix_seconds("first_seen") + days * DAY_SECONDS
    return first_seen(transfers).groupBy("sender").agg(
        F.sum(F.when(fresh, F.col("amount")).otherwise(0.0)).alias("new_payee_volume")
    )


def interval_regularity(transfers: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per (sender, payee): count and variation of the gaps; near zero looks scripted."""
    before = running(
        transfers, ["sender", "payee"], order, day_slot(F.col("ts"), 30), previous={"_before": "ts"}
    )
    gap = (F.unix_seconds("ts") - F.unix_seconds("_before")).cast("double")
    return before.withColumn("_gap", gap).groupBy("sender", "payee").agg(
        F.count("*").alias("txn_count"), coefficient_of_variation(F.col("_gap")).alias("interval_cv")
    )


def near_threshold_share(transfers: DataFrame, threshold: float, band: float = 0.1) -> DataFrame:
    """Per sender, the share of amounts within ``band`` just below ``threshold``."""
    near = (F.col("amount") >= threshold * (1 - band)) & (F.col("amount") < threshold)
    return transfers.groupBy("sender").agg(
        F.avg(F.when(near, 1.0).otherwise(0.0)).alias("near_threshold_share")
    )


def _sender_counts(as_of: str, windows: Sequence[int] = (7, 30)) -> list[Column]:
    since = F.unix_seconds(_as_of(as_of))
    return [
        F.count_if(F.unix_seconds("last_seen") > since - days * DAY_SECONDS).alias(f"distinct_senders_{days}d")
        for days in windows
    ]


def distinct_senders(edges: DataFrame, as_of: str, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Per payee, senders seen in the last days, from edges up to ``as_of``."""
    return edges.groupBy("payee").agg(*_sender_counts(as_of, windows))


def _quick(first: Column, added: Column, hours: int = 72) -> Column:
    """1.0 where money went to a payee within so many hours of its being added."""
    wait = F.unix_seconds(first) - F.unix_seconds(added)
    return F.when(wait <= hours * 3600, 1.0).otherwise(0.0)


def new_sender_fraction(edges: DataFrame, hours: int = 72, added: DataFrame | None = None) -> DataFrame:
    """Per payee, the share of senders who added it within ``hours`` of first sending.

    ``added(sender, payee, added_at)`` may say when a payee was added. Without
    it the sender's first activity stands in, the earliest it can have been.
    """
    if added is None:
        begun = edges.groupBy("sender").agg(F.min("first_seen").alias("added_at"))
        dated = edges.join(begun, "sender")
    else:
        dated = edges.join(added, ["sender", "payee"], "left")
    quick = _quick(F.col("first_seen"), F.col("added_at"), hours)
    return dated.groupBy("payee").agg(F.avg(quick).alias("new_sender_fraction"))


def fan_ratio(transfers: DataFrame, outflows: DataFrame) -> DataFrame:
    """Per account: distinct senders, distinct recipients, and their ratio."""
    incoming = transfers.groupBy("payee", "sender").agg(F.count("*").alias("_n"))
    outgoing = outflows.groupBy("payee", "recipient").agg(F.count("*").alias("_n"))
    ins = incoming.groupBy("payee").agg(F.count("*").alias("fan_in"))
    outs = outgoing.groupBy("payee").agg(F.count("*").alias("fan_out"))
    both = ins.join(outs, "payee", "full_outer").na.fill(0, ["fan_in", "fan_out"])
    return both.withColumn("fan_ratio", safe_ratio(F.col("fan_in"), F.col("fan_out")))


def pass_through_delay(transfers: DataFrame, outflows: DataFrame) -> DataFrame:
    """Per account, days from the first inbound to the first outbound at or after it."""
    first = transfers.groupBy("payee").agg(F.min("ts").alias("first_in"))
    later = outflows.join(first, "payee").where(F.col("ts") >= F.col("first_in"))
    leaving = later.groupBy("payee").agg(F.min("ts").alias("first_out"))
    span = (F.unix_seconds("first_out") - F.unix_seconds("first_in")) / F.lit(DAY_SECONDS)
    return first.join(leaving, "payee", "left").withColumn("pass_through_days", span)


def amount_quantiles(transfers: DataFrame, user: str = "sender") -> DataFrame:
    """Per user, exact median and 95th percentile of the amounts."""
    return exact_quantiles(transfers, [user], "amount", {"amount_p50": 0.5, "amount_p95": 0.95})


def hour_counts(events: DataFrame, user: str, ts: str = "ts") -> DataFrame:
    return events.groupBy(user, hour_of_day(F.col(ts)).alias("hour")).agg(
        F.count("*").alias("n")
    )


def hour_histogram(events: DataFrame, user: str, ts: str = "ts") -> DataFrame:
    """Per user a map hour of day -> count; at most 24 entries are gathered."""
    entries = F.array_sort(F.collect_list(F.struct("hour", "n")))
    counted = hour_counts(events, user, ts)
    return counted.groupBy(user).agg(F.map_from_entries(entries).alias("hour_histogram"))


def robust_scale(df: DataFrame, user: str, value: str) -> DataFrame:
    """Per user: ``median`` and ``mad``, the median distance from it."""
    medians = exact_quantiles(df, [user], value, {"median": 0.5})
    off = df.select(user, value).join(medians, user).withColumn("_off", F.abs(q(value) - F.col("median")))
    return medians.join(exact_quantiles(off, [user], "_off", {"mad": 0.5}), user)


def robust_z(df: DataFrame, user: str, value: str, factor: float = 1.0) -> DataFrame:
    """Add ``robust_z``: distance to the user's median over their median deviation."""
    scales = robust_scale(df, user, value).withColumnsRenamed({"median": "_median", "mad": "_mad"})
    z = safe_ratio(q(value) - F.col("_median"), F.col("_mad") * factor)
    return df.join(scales, user).withColumn("robust_z", z).drop("_median", "_mad")


def empirical_rank(df: DataFrame, user: str, value: str) -> DataFrame:
    """Add ``cume_dist`` and ``percent_rank`` of a value among the user's own."""
    counts = df.groupBy(user, value).agg(F.count("*").alias("_n"))
    placed = running(
        counts, [user], [value], magnitude_slot(q(value)),
        totals={"_upto": "_n"}, whole={"_all": "_upto"},
    )
    below = (F.col("_upto") - F.col("_n")) / F.when(F.col("_all") > 1, F.col("_all") - 1)
    ranks = placed.select(
        user,
        value,
        (F.col("_upto") / F.col("_all")).alias("cume_dist"),
        F.coalesce(below, F.lit(0.0)).alias("percent_rank"),
    )
    return df.join(ranks, [user, value])


def rolling_volume(
    transfers: DataFrame, user: str = "sender", days: Sequence[int] = (7, 30)
) -> DataFrame:
    """Add count and amount over trailing windows ending at each transfer.

    Transfers of one second see the same windows, so they are summed before anything is copied for a window.
    """
    timed = transfers.withColumn("_sec", F.unix_seconds("ts"))
    summed = timed.groupBy(user, "_sec").agg(F.count("*").alias("_n"), F.sum("amount").alias("_amount"))
    lengths = {f"{n}d": n * DAY_SECONDS for n in days}
    rolled = trailing(summed, [user], "_sec", {"count": "_n", "volume": "_amount"}, lengths, DAY_SECONDS)
    return null_safe_join(timed, rolled.drop("_n", "_amount"), [user, "_sec"]).drop("_sec")


def snapshot_lookup(
    sessions: DataFrame,
    snapshots: DataFrame,
    key: str,
    values: Sequence[str],
    ts: str = "ts",
    computed_at: str = "computed_at",
    slot_days: float = 30.0,
) -> DataFrame:
    """As-of join: the newest snapshot of the key not after the session, with its age.

    Sessions and snapshots are laid on one time line per key and the last
    snapshot is carried forward, so no session meets more than one snapshot.
    """
    content = F.struct(q(computed_at).alias(computed_at), *[q(v) for v in values])
    marks = snapshots.select(
        q(key), q(computed_at).alias(ts), F.lit(0).alias("_kind"), content.alias("_mark")
    )
    line = sessions.withColumn("_kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    carried = running(
        line, [key], [ts, "_kind"], day_slot(q(ts), slot_days), previous={"_found": "_mark"}
    ).where(F.col("_kind") == 1)
    age = (F.unix_micros(q(ts)) - F.unix_micros(F.col(f"_found.{computed_at}"))) / F.lit(1e6)
    return carried.select(
        *[q(c) for c in sessions.columns],
        F.col(f"_found.{computed_at}").alias(computed_at),
        *[F.col(f"_found.{v}").alias(v) for v in values],
        age.alias("age_seconds"),
    )


def payee_identity_gap(sessions: DataFrame, user: str, payee: str, score: str) -> DataFrame:
    """Per (user, payee), the mean identity score against the user's overall mean."""
    pairs = sessions.groupBy(user, payee).agg(
        F.sum(score).alias("_sum"), F.count(score).alias("sessions")
    )
    users = pairs.groupBy(user).agg((F.sum("_sum") / F.sum("sessions")).alias("user_mean"))
    mean = F.col("_sum") / F.col("sessions")
    return pairs.join(users, user).select(
        user, payee, "sessions", mean.alias("payee_mean"), "user_mean",
        (mean - F.col("user_mean")).alias("identity_gap"),
    )


def flagged_overlap(edges: DataFrame, flagged: DataFrame) -> DataFrame:
    """Per payee, the share of its senders who also send to a flagged account."""
    tainted = (
        edges.join(flagged.select("payee").distinct(), "payee", "left_semi")
        .select("sender")
        .distinct()
        .withColumn("_tainted", F.lit(1.0))
    )
    return edges.join(tainted, "sender", "left").groupBy("payee").agg(
        F.avg(F.coalesce("_tainted", F.lit(0.0))).alias("flagged_overlap")
    )


def retroactive_review(transfers: DataFrame, flagged_edges: DataFrame) -> DataFrame:
    """Earlier transfers on edges the batch layer has flagged."""
    return transfers.join(
        flagged_edges.select("sender", "payee").distinct(), ["sender", "payee"], "left_semi"
    )


def payee_risk(
    transfers: DataFrame,
    outflows: DataFrame,
    flagged: DataFrame,
    as_of: str,
    weights: Mapping[str, float] | None = None,
    scales: Mapping[str, float] | None = None,
) -> DataFrame:
    """One destination score in [0, 1] with its parts, per payee."""
    weights = dict(weights or RISK_WEIGHTS)
    scales = {**RISK_SCALES, **(scales or {})}
    # Everything about incoming money follows from the edges: one pass over the log.
    edges = materialise(payee_edge_features(transfers, as_of), "edges")
    past_out = outflows.where(F.col("ts") <= _as_of(as_of))
    # What a payee's parts need to know of a sender: when it began, and whether it sends to a flagged account.
    marked = edges.join(flagged.select("payee").distinct().withColumn("_flag", F.lit(1.0)), "payee", "left")
    senders = marked.groupBy("sender").agg(F.min("first_seen").alias("_begun"), F.max("_flag").alias("_tainted"))
    incoming = edges.join(senders, "sender").groupBy("payee").agg(
        *_sender_counts(as_of),
        F.avg(_quick(F.col("first_seen"), F.col("_begun"))).alias("new_sender_fraction"),
        F.avg(F.coalesce("_tainted", F.lit(0.0))).alias("flagged_overlap"),
        F.count("*").alias("_fan_in"),
        F.min("first_seen").alias("_first_in"),
    )
    later = F.when(F.col("ts") >= F.col("_first_in"), F.col("ts"))
    outgoing = (
        past_out.join(incoming.select("payee", "_first_in"), "payee")
        .groupBy("payee", "recipient").agg(F.min(later).alias("_out"))
        .groupBy("payee").agg(F.count("*").alias("_fan_out"), F.min("_out").alias("_first_out"))
    )
    delay = (F.unix_seconds("_first_out") - F.unix_seconds("_first_in")) / F.lit(DAY_SECONDS)
    table = incoming.join(outgoing, "payee", "left").select(
        *[c for c in incoming.columns if not c.startswith("_")],
        safe_ratio(F.col("_fan_in"), F.coalesce("_fan_out", F.lit(0))).alias("fan_ratio"),
        delay.alias("pass_through_days"),
    )
    parts = {
        "distinct_senders_30d": F.col("distinct_senders_30d") / scales["distinct_senders_30d"],
        "new_sender_fraction": F.col("new_sender_fraction"),
        "fan_ratio": F.coalesce(F.col("fan_ratio"), F.lit(scales["fan_ratio"])) / scales["fan_ratio"],
        "quick_exit": F.exp(-F.col("pass_through_days") / scales["pass_through_days"]),
        "flagged_overlap": F.col("flagged_overlap"),
    }
    score = F.lit(0.0)
    for name, weight in weights.items():
        score = score + weight * F.coalesce(F.least(parts[name], F.lit(1.0)), F.lit(0.0))
    return table.withColumn("risk_score", score / sum(weights.values()))


def user_aggregates(transfers: DataFrame) -> DataFrame:
    """Per sender: amount quantiles, volume to new payees, hour histogram."""
    return (
        amount_quantiles(transfers)
        .join(new_payee_volume(transfers), "sender")
        .join(hour_histogram(transfers, "sender"), "sender")
    )
