"""Nightly feature snapshots by increments: a night adds what its day brought, reading puts the increments together.

The state of a day holds, for all transfers up to that day, one row per (sender, payee) edge, and counts per
(sender, amount) and per (sender, hour). All of it is mergeable: counts and sums add up, and the gaps
between the transfers of an edge are kept as moments that stretches of time combine by, given
the gaps that lie between them. A night reads and writes one day only; every few nights it writes the whole state, so
that a reader meets a bounded number of increments.

States are versions in folders of their own. A version is the whole state or what came since the one it names as its
predecessor, the newest before its day. Running a night again changes nothing, and an older day can be
run again by running the days after it too.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadentia.functions.scalars import DAY_SECONDS, day_slot, q, safe_ratio
from cadentia.plans.joins import null_safe_join
from cadentia.plans.ordered import SLOT
from cadentia.plans.quantiles import exact_quantiles

EDGE, AMOUNT, HOUR = ["sender", "payee"], ["sender", "amount"], ["sender", "hour"]
TABLES = {"edges": EDGE, "amounts": AMOUNT, "hours": HOUR}
# The gaps of a stretch: how many, their mean, and the sum of their squared distances from it.
GAPS = "struct<n:bigint,mean:double,m2:double>"
# A version that would be the end of a longer chain is written whole.
CHAIN = 8


def _gaps(n: Column, mean: Column, m2: Column) -> Column:
    return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2")).cast(GAPS)


def together(stretches: DataFrame) -> DataFrame:
    """One row per edge from rows of stretches of time that do not overlap.

    The gaps of an edge are those inside its stretches and those between them; their mean is known before the squared
    distances from it are summed. A stretch without a time is in no gap.
    """
    edge = Window.partitionBy(*EDGE)
    earlier = edge.orderBy("first_seen").rowsBetween(Window.unboundedPreceding, -1)
    gaps = F.col("gaps")
    between = (F.unix_seconds("first_seen") - F.unix_seconds(F.max("last_seen").over(earlier))).cast("double")
    bridged = stretches.withColumn("_between", between)
    n = gaps["n"] + F.when(F.col("_between").isNull(), 0).otherwise(1)
    total = gaps["n"] * gaps["mean"] + F.coalesce("_between", F.lit(0.0))
    known = bridged.withColumn("_mean", F.coalesce(safe_ratio(F.sum(total).over(edge), F.sum(n).over(edge)), F.lit(0.0)))
    apart, off = gaps["mean"] - F.col("_mean"), F.coalesce(F.col("_between") - F.col("_mean"), F.lit(0.0))
    return known.groupBy(*EDGE).agg(
        F.sum("txn_count").alias("txn_count"), F.sum("cum_amount").alias("cum_amount"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        _gaps(F.sum(n), F.max("_mean"), F.sum(gaps["m2"] + gaps["n"] * apart * apart + off * off)).alias("gaps"),
    )


def _edges(transfers: DataFrame, ts: str) -> DataFrame:
    """Edges by stretches of 30 days. Transfers of one moment are a gap of 0 apart in any order."""
    inside = Window.partitionBy(*EDGE, SLOT).orderBy(ts)
    slotted = transfers.select(*EDGE, ts, "amount", day_slot(F.col(ts), 30).alias(SLOT))
    gap = (F.unix_seconds(ts) - F.unix_seconds(F.lag(ts).over(inside))).cast("double")
    n = F.count("_gap")
    spread = F.coalesce(F.var_pop("_gap") * n, F.lit(0.0))
    return together(slotted.withColumn("_gap", gap).groupBy(*EDGE, SLOT).agg(
        F.count("*").alias("txn_count"), F.sum("amount").alias("cum_amount"), F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"), _gaps(n, F.coalesce(F.avg("_gap"), F.lit(0.0)), spread).alias("gaps"),
    ))


def partial_states(transfers: DataFrame, order: Sequence[str], tables: Sequence[str] = tuple(TABLES)) -> dict[str, DataFrame]:
    """The tables of one stretch of time. ``order`` begins with the time."""
    timed = transfers.withColumn("hour", F.hour(order[0]))
    return {
        name: _edges(transfers, order[0]) if name == "edges" else timed.groupBy(*TABLES[name]).agg(F.count("*").alias("n"))
        for name in tables
    }


def versions(spark: SparkSession, root: str) -> list[str]:
    """The days that have a finished state, in order."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/version=*/done")
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop) or ()
    return sorted(s.getPath().getParent().getName().removeprefix("version=") for s in found)


def chain(spark: SparkSession, root: str, day: str) -> list[str]:
    """The versions that the state of ``day`` is made of, the whole one first."""
    done, found = set(versions(spark, root)), []
    while day is not None:
        if day not in done:
            raise ValueError(f"{root}: version {day} is not finished; run that day again")
        found.insert(0, day)
        day = spark.read.schema("follows string").parquet(f"{root}/version={day}/done").first()[0]
    return found


def read_state(spark: SparkSession, root: str, day: str, tables: Sequence[str] = tuple(TABLES)) -> dict[str, DataFrame]:
    """The state of a day: one row per edge, and the counts of every increment, which add up."""
    parts, state = chain(spark, root, day), {}
    for name in tables:
        union = reduce(DataFrame.unionByName, [spark.read.parquet(f"{root}/version={v}/{name}") for v in parts])
        state[name] = together(union) if name == "edges" and len(parts) > 1 else union
    return state


def advance(
    transfers: DataFrame, root: str, day: str, order: Sequence[str], tables: Sequence[str] = tuple(TABLES)
) -> dict[str, DataFrame]:
    """Write what the transfers since the newest version before ``day`` add to it; returns the state of ``day``.

    A version counts as there once its last file, a mark, is written; a night that broke off is simply run again.
    """
    spark = transfers.sparkSession
    earlier = [v for v in versions(spark, root) if v < day]
    end = F.lit(day).cast("date")
    date = F.to_date(order[0])
    rows = transfers.where(date <= end)
    if earlier:
        rows = rows.where(date > F.lit(earlier[-1]).cast("date"))
    else:
        # Transfers without a time belong to the first state.
        rows = transfers.where((date <= end) | F.col(order[0]).isNull())
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/version={day}/done")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).delete(mark, True)
    state, follows = partial_states(rows, order, tables), earlier[-1] if earlier else None
    if earlier and len(chain(spark, root, follows)) >= CHAIN:
        old, follows = read_state(spark, root, follows, tables), None
        for name in tables:
            both = old[name].unionByName(state[name])
            state[name] = together(both) if name == "edges" else both.groupBy(*TABLES[name]).agg(F.sum("n").alias("n"))
    for name, table in state.items():
        table.write.mode("overwrite").parquet(f"{root}/version={day}/{name}")
    spark.range(1).select(F.lit(follows).cast("string").alias("follows")).write.mode("overwrite").parquet(f"{root}/version={day}/done")
    return read_state(spark, root, day, tables)


def edge_features(state: Mapping[str, DataFrame]) -> DataFrame:
    """Per (sender, payee): count, cumulative amount, first and last transfer, variation of the gaps."""
    gaps = F.col("gaps")
    spread = F.sqrt(safe_ratio(gaps["m2"], gaps["n"] - 1))
    cv = F.when(gaps["n"] > 1, safe_ratio(spread, gaps["mean"]))
    return state["edges"].select(*EDGE, "txn_count", "cum_amount", "first_seen", "last_seen", cv.alias("interval_cv"))


def user_features(state: Mapping[str, DataFrame], probabilities: Mapping[str, float]) -> DataFrame:
    """Per sender: exact quantiles of the amounts, number of transfers, and transfers per hour of day as an array."""
    levels = exact_quantiles(state["amounts"], ["sender"], "amount", probabilities, count="n")
    each = [F.coalesce(F.sum(F.when(F.col("hour") == h, F.col("n"))), F.lit(0)) for h in range(24)]
    hours = state["hours"].groupBy("sender").agg(F.sum("n").alias("transfers"), F.array(*each).alias("hour_histogram"))
    return null_safe_join(levels, hours, ["sender"]).select("sender", *probabilities, "transfers", "hour_histogram")


def recent_senders(state: Mapping[str, DataFrame], day: str, days: int) -> DataFrame:
    """Per payee: senders whose last transfer lies within ``days`` before the end of ``day``."""
    end = F.unix_seconds(F.lit(day).cast("timestamp")) + DAY_SECONDS
    fresh = F.unix_seconds("last_seen") > end - days * DAY_SECONDS
    return state["edges"].groupBy(q("payee")).agg(F.count(F.when(fresh, 1)).alias(f"distinct_senders_{days}d"))
