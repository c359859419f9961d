"""Sessions from events: gaps, sessions, timing features, automation signs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadentia.functions.scalars import DAY_SECONDS, day_slot, days_between, q, safe_ratio, sha256_text
from cadentia.plans.joins import null_safe_join
from cadentia.plans.ordered import running, running_gaps
from cadentia.plans.quantiles import exact_quantiles
from cadentia.session import materialise


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def event_gaps(
    events: DataFrame, user: str, ts: str, order: Sequence[str], slot_days: float = 1.0
) -> DataFrame:
    """Add ``gap``: seconds since the user's previous event, null for the first."""
    previous = running(
        events, [user], order, day_slot(F.col(ts), slot_days), previous={"_previous": ts}
    )
    gap = seconds_between(F.col(ts), F.col("_previous"))
    return previous.withColumn("gap", gap).drop("_previous")


def sessionise(
    events: DataFrame,
    user: str,
    ts: str,
    order: Sequence[str],
    max_gap: float,
    slot_days: float = 1.0,
) -> DataFrame:
    """Add ``gap`` and ``session_no``; a gap above ``max_gap`` seconds opens a session.

    Both steps run inside (user, day) and share one table of what is carried across days, so a user with
    very many events is spread over their days. ``order`` begins with ``ts``; an event without a time opens a session.
    """

    def opens(now: Column, before: Column) -> Column:
        gap = seconds_between(now, before)
        return F.when(gap.isNull() | (gap > max_gap), 1).otherwise(0)

    if order[0] != ts:
        raise ValueError(f"events are ordered by {order[0]}, their time is {ts}")
    numbered = running_gaps(events, [user], order, day_slot(F.col(ts), slot_days), opens, "_previous", "session_no")
    gap = seconds_between(F.col(ts), F.col("_previous"))
    return numbered.withColumn("gap", gap).select(*[q(c) for c in events.columns], "gap", "session_no")


def valid_timing(
    df: DataFrame, hold: Sequence[str], down_down: Sequence[str] = (), max_hold: float = 5.0
) -> DataFrame:
    """Keep rows with plausible timing; up-down times may be negative and are not tested."""
    tests = [(q(c) >= 0) & (q(c) <= max_hold) for c in hold] + [q(c) >= 0 for c in down_down]
    return df.where(reduce(lambda a, b: a & b, tests))


def device_class(agent: Column) -> Column:
    """desktop, mobile or tablet from a client description."""
    text = F.lower(agent)
    tablet = text.contains("tablet") | text.contains("ipad")
    mobile = text.contains("mobile") | text.contains("iphone") | text.contains("android")
    return F.when(tablet, "tablet").when(mobile, "mobile").otherwise("desktop")


def timing_features(
    keystrokes: DataFrame, session: Sequence[str], hold: str, flight: str, correction: str, ts: str
) -> DataFrame:
    """The twelve features of a session, in the order of :data:`TIMING_FEATURES`.

    Mean, spread, minimum, median and maximum of hold and of flight times, total
    duration, and the share of corrections. Medians are exact and do not gather
    the session, so one endless session of a script does no harm.
    """
    keys = list(session)
    plain = keystrokes.groupBy(*keys).agg(
        *[
            part.alias(f"{name}_{stat}")
            for name, column in (("hold", hold), ("flight", flight))
            for stat, part in (
                ("mean", F.avg(column)),
                ("sd", F.coalesce(F.stddev_samp(column), F.lit(0.0))),
                ("min", F.min(column)),
                ("max", F.max(column)),
            )
        ],
        seconds_between(F.max(ts), F.min(ts)).alias("duration"),
        F.avg(q(correction).cast("double")).alias("correction_rate"),
    )
    # Both measures under one another, so that one pass finds both medians.
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("_of"), q(c).cast("double").alias("_x")) for n, c in (("hold", hold), ("flight", flight))]))
    middle = exact_quantiles(keystrokes.select(*keys, each), [*keys, "_of"], "_x", {"_median": 0.5})
    medians = middle.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_of") == n, F.col("_median"))).alias(f"{n}_median") for n in ("hold", "flight")]
    )
    return plain.join(medians, keys, "left").select(*keys, *TIMING_FEATURES)


TIMING_FEATURES = (
    *[f"hold_{s}" for s in ("mean", "sd", "min", "median", "max")],
    *[f"flight_{s}" for s in ("mean", "sd", "min", "median", "max")],
    "duration",
    "correction_rate",
)


def session_aggregates(
    steps: DataFrame, session: Sequence[str], ts: str, step: str, correction: Column,
    payee: str | None = None,
) -> DataFrame:
    """Per session: duration, events, corrections, first-visit order of steps, repeated payees.

    The order of steps lists each distinct step once, by its first visit, so it
    is as long as the set of step names and not as the session.
    """
    keys = list(session)
    visits = steps.groupBy(*keys, step).agg(
        F.min(ts).alias("_from"),
        F.max(ts).alias("_to"),
        F.count("*").alias("_n"),
        F.count_if(correction).alias("_corrections"),
    )
    path = F.array_sort(F.collect_list(F.struct("_from", step)))
    out = visits.groupBy(*keys).agg(
        seconds_between(F.max("_to"), F.min("_from")).alias("duration"),
        F.sum("_n").alias("events"),
        F.sum("_corrections").alias("corrections"),
        F.array_join(F.transform(path, lambda s: s[step]), ">").alias("step_order"),
    )
    if payee is None:
        return out
    entered = steps.where(q(payee).isNotNull()).groupBy(*keys, payee).agg(F.count("*").alias("_n"))
    repeated = entered.groupBy(*keys).agg(F.sum(F.col("_n") - 1).alias("repeated_payees"))
    return out.join(repeated, keys, "left").na.fill(0, ["repeated_payees"])


def device_history(sessions: DataFrame, user: str, device: str, ts: str = "ts") -> DataFrame:
    """Per (user, device): first seen and number of sessions."""
    return sessions.groupBy(user, device).agg(
        F.min(ts).alias("first_seen"), F.count("*").alias("session_count")
    )


def prior_sessions(
    sessions: DataFrame, user: str, device: str, order: Sequence[str], slot_days: float = 7.0, clean: Column | None = None
) -> DataFrame:
    """Add ``prior_sessions``: how many this device had before; with ``clean`` also ``prior_clean``, how many of them it holds for."""
    totals = {"_upto": F.lit(1).cast("long")}
    marked = sessions
    if clean is not None:
        marked = sessions.withColumn("_clean", F.coalesce(clean, F.lit(False)).cast("long"))
        totals["_clean_upto"] = F.col("_clean")
    upto = running(marked, [user, device], order, day_slot(q(order[0]), slot_days), totals=totals)
    counted = upto.withColumn("prior_sessions", F.col("_upto") - 1)
    if clean is not None:
        counted = counted.withColumn("prior_clean", F.col("_clean_upto") - F.col("_clean"))
    return counted.drop("_upto", "_clean", "_clean_upto")


def recent_change(
    sessions: DataFrame, user: str, ts: str, changed: Column, order: Sequence[str],
    days: float = 7, slot_days: float = 7.0, previous: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add ``last_change`` and ``recent_change`` (1 if at most ``days`` old, this row included).

    ``previous`` names further columns for the user's last value before the row, as in ``running``; one pass forms them all.
    """
    marked = sessions.withColumn("_change", F.when(changed, q(ts)))
    found = running(
        marked, [user], order, day_slot(q(ts), slot_days), previous={"_before": "_change", **(previous or {})}
    ).withColumn("last_change", F.coalesce("_change", "_before"))
    age = seconds_between(q(ts), F.col("last_change"))
    flag = F.when(age <= days * DAY_SECONDS, 1).otherwise(0)
    return found.withColumn("recent_change", flag).drop("_change", "_before")


def context_features(
    sessions: DataFrame, user: str, device: str, payee: str, ts: str, changed: Column,
    order: Sequence[str],
) -> DataFrame:
    """Add days since the payee and the device were first seen and since the last change."""
    payees = sessions.groupBy(user, payee).agg(F.min(ts).alias("_payee_from"))
    devices = sessions.groupBy(user, device).agg(F.min(ts).alias("_device_from"))
    ranked = prior_sessions(sessions, user, device, order)
    dated = recent_change(ranked, user, ts, changed, order)
    joined = dated.join(payees, [user, payee]).join(devices, [user, device])
    return joined.select(
        *[q(c) for c in sessions.columns],
        days_between(q(ts), F.col("_payee_from")).alias("payee_age_days"),
        days_between(q(ts), F.col("_device_from")).alias("device_age_days"),
        days_between(q(ts), F.col("last_change")).alias("days_since_change"),
        "prior_sessions",
    )


def interval_variation(events: DataFrame, session: Sequence[str], gap: str = "gap") -> DataFrame:
    """Per session: count and coefficient of variation of the gaps inside it."""
    spread = safe_ratio(F.stddev_samp(gap), F.avg(gap))
    return events.groupBy(*session).agg(F.count(gap).alias("gaps"), spread.alias("interval_cv"))


def sequence_fingerprints(
    events: DataFrame, session: Sequence[str], position: str, interval: str
) -> DataFrame:
    """Per session, its length and an order-aware 128-bit fingerprint of its intervals.

    Each (position, interval) is hashed and the hashes are combined by XOR. That
    depends on the order through the position, yet combines on the map side, so
    no sequence is ever gathered.
    """
    cell = (q(position), q(interval))
    return events.where(q(interval).isNotNull()).groupBy(*session).agg(
        F.count("*").alias("intervals"),
        F.bit_xor(F.xxhash64(F.lit("a"), *cell)).alias("hash_a"),
        F.bit_xor(F.xxhash64(F.lit("b"), *cell)).alias("hash_b"),
    )


def duplicate_sequences(prints: DataFrame, session: Sequence[str], at_least: int = 2) -> DataFrame:
    """Sessions plus ``copies``: how many sessions have the very same intervals.

    Sequences shorter than ``at_least`` intervals are not compared.
    """
    by = ["intervals", "hash_a", "hash_b"]
    long_enough = prints.where(F.col("intervals") >= at_least)
    copies = long_enough.groupBy(*by).agg(F.count("*").alias("copies"))
    return long_enough.join(copies, by).select(*session, "intervals", "copies")


def automation_flags(
    events: DataFrame, session: Sequence[str], position: str, gap: str, interval: str,
    cv_below: float = 0.1, at_least: int = 2,
) -> DataFrame:
    """Per session: interval variation, copies of its sequence, and a flag for either sign."""
    keys = list(session)
    regular = interval_variation(events, keys, gap)
    copies = duplicate_sequences(
        sequence_fingerprints(events, keys, position, interval), keys, at_least
    ).drop("intervals")
    joined = regular.join(copies, keys, "left").na.fill(1, ["copies"])
    steady = F.col("interval_cv") < cv_below
    return joined.withColumn("regular", F.coalesce(steady, F.lit(False)).cast("int")).withColumn(
        "replayed", (F.col("copies") > 1).cast("int")
    )


def rolling_interval_hash(
    events: DataFrame, keys: Sequence[str], position: str, interval: str, width: int = 4,
    stretch: int = 4096,
) -> DataFrame:
    """Add ``rolling_hash``: SHA-256 of the last ``width`` intervals, null before that many.

    The key is cut into stretches of positions; the ``width - 1`` rows before a
    stretch are copied into it, so no window spans a whole key. ``position`` must
    count 1, 2, 3, ... over the rows of a key.
    """
    part = F.floor((q(position) - 1) / stretch)
    own = events.withColumn("_part", part).withColumn("_own", F.lit(True))
    lead_in = F.pmod(q(position) - 1, F.lit(stretch)) >= stretch - (width - 1)
    copies = (
        events.where(lead_in)
        .select(*keys, position, interval, (part + 1).alias("_part"))
        .withColumn("_own", F.lit(False))
    )
    frame = Window.partitionBy(*keys, "_part").orderBy(position)
    recent = [F.lag(interval, i).over(frame) for i in range(width - 1, 0, -1)] + [q(interval)]
    both = own.unionByName(copies, allowMissingColumns=True)
    text = [value.cast("string") for value in recent]
    whole = reduce(lambda a, b: a & b, [value.isNotNull() for value in recent])
    hashed = both.withColumn("rolling_hash", F.when(whole, sha256_text(text)))
    return hashed.where("_own").drop("_own", "_part")


def repeated_hashes(hashed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key, how many of its windows also occur elsewhere."""
    seen = hashed.where(F.col("rolling_hash").isNotNull())
    counts = seen.groupBy("rolling_hash").agg(F.count("*").alias("_copies"))
    return seen.join(counts, "rolling_hash").groupBy(*keys).agg(
        F.count("*").alias("windows"), F.count_if(F.col("_copies") > 1).alias("repeated_windows")
    )


def session_clusters(
    vectors: DataFrame, user: str, session: str, names: Sequence[str], rounds: int = 6
) -> DataFrame:
    """Whether each user's sessions form one group or two.

    Two-means for all users at once. Features are standardised within the user; the first
    centre is the session furthest from the user's mean, the second the one furthest
    from the first. A round joins the two centres of each user, one row a user, to the
    sessions and averages both sides on the map side. Returns, per user, the number of sessions,
    the share of the smaller side and ``separation``: how far the two means lie apart,
    over the root mean square distance of sessions from their own mean (null if that is zero).
    Missing features count as the user's mean.
    """
    stats = vectors.groupBy(user).agg(
        *[F.avg(n).alias(f"_m_{n}") for n in names], *[F.stddev_pop(n).alias(f"_s_{n}") for n in names]
    )
    scaled = [
        F.coalesce(F.when(q(f"_s_{n}") > 1e-9, (q(n) - q(f"_m_{n}")) / q(f"_s_{n}")), F.lit(0.0)) for n in names
    ]
    rows = materialise(
        null_safe_join(vectors.select(user, session, *names), stats, [user]).select(user, session, F.array(*scaled).alias("_z")),
        "session-vectors",
    )
    width = len(names)

    def distance(a: str, b: str) -> Column:
        return reduce(lambda x, y: x + y, [F.pow(F.get(a, F.lit(i)) - F.get(b, F.lit(i)), F.lit(2)) for i in range(width)])

    def furthest(df: DataFrame, others: Sequence[str], origin: str) -> DataFrame:
        # Rounded, so that the smaller session wins ties whatever the order of a sum.
        by = F.struct(-F.round(distance("_z", origin), 9), q(session))
        return df.groupBy(user).agg(*[F.first(c).alias(c) for c in others], F.min_by("_z", by).alias("_far"))

    from_mean = rows.withColumn("_o", F.array(*[F.lit(0.0)] * width))
    first = furthest(from_mean, (), "_o").withColumnRenamed("_far", "_a")
    centres = furthest(null_safe_join(rows, first, [user]), ("_a",), "_a").withColumnRenamed("_far", "_b")
    second = F.round(distance("_z", "_a") - distance("_z", "_b"), 9) > 0

    def mean_of(side: Column, old: str) -> Column:
        parts = [F.coalesce(F.avg(F.when(side, F.get("_z", F.lit(i)))), F.first(F.get(old, F.lit(i)))) for i in range(width)]
        return F.array(*parts)

    for _ in range(rounds):
        centres = materialise(centres, "two-means")
        centres = null_safe_join(rows, centres, [user]).groupBy(user).agg(
            mean_of(~second, "_a").alias("_a"), mean_of(second, "_b").alias("_b")
        )
    placed = null_safe_join(rows, materialise(centres, "two-means"), [user])
    share = F.avg(second.cast("double"))
    own = F.avg(F.least(distance("_z", "_a"), distance("_z", "_b")))
    return placed.groupBy(user).agg(
        F.count("*").alias("sessions"),
        F.least(share, 1 - share).alias("minor_share"),
        safe_ratio(F.sqrt(F.first(distance("_a", "_b"))), F.sqrt(F.round(own, 9))).alias("separation"),
    )
