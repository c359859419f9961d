"""Profile adaptation: robust candidates, displacement budget, update policies.

The expensive part of the robust policy, one geometric median per epoch, has no
memory and runs in parallel over (key, epoch). Only the projection onto the
budget depends on the step before; it sees one short row per epoch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadentia.functions.scalars import DAY_SECONDS, DISPERSION_FLOOR, day_slot, q, sha256_text
from cadentia.operators import evaluation as E
from cadentia.operators import profiles as P
from cadentia.operators.trust import BUFFER_SIZE, TAU_MIN, VERIFY_PASSKEY
from cadentia.plans.affine import affine_scan, applied
from cadentia.plans.fold import ordered_fold
from cadentia.plans.joins import null_safe_join
from cadentia.plans.ordered import head_per_key, running
from cadentia.plans.quantiles import exact_quantiles
from cadentia.session import materialise

# Fixed values of the update rule.
TOLERANCE, MAX_ITERATIONS = 1e-6, 100
RECOMPUTE_EVERY = 20
COLD_START_SESSIONS = 5
RE_ANCHOR_DAYS = 30
FULL_TRUST = 1.0
# Half the weight counts as reached despite the rounding of a sum.
ROUNDING = 1 - 1e-12
POLICIES = ("P0", "P1", "P2", "P3")

ARRAY = T.ArrayType(T.DoubleType())


@dataclass(frozen=True)
class Settings:
    """Parameters the policies leave open."""

    alpha: float = 0.1
    theta: float = 10.0
    budget: float = 1.0
    tau_min: float = TAU_MIN
    every: int = RECOMPUTE_EVERY
    buffer: int = BUFFER_SIZE
    floor: float = DISPERSION_FLOOR
    # Recompute at midnight too, where sessions were admitted since the last time.
    nightly: bool = False


def weiszfeld(points: np.ndarray, weights: np.ndarray, tol: float, max_iter: int) -> np.ndarray:
    """Weighted geometric median of a few points.

    Where the iterate meets a data point, the modified step of Vardi and Zhang
    (2000) either stops there or moves on by the pull of the other points.
    """
    current = np.average(points, axis=0, weights=weights)
    for _ in range(max_iter):
        gaps = np.linalg.norm(points - current, axis=1)
        away = gaps > 1e-12
        if not away.any():
            break
        pull = weights[away] / gaps[away]
        target = (points[away] * pull[:, None]).sum(axis=0) / pull.sum()
        here = weights[~away].sum()
        if here > 0:
            force = np.linalg.norm(((points[away] - current) * pull[:, None]).sum(axis=0))
            share = 1.0 if force == 0 else min(1.0, here / force)
            target = (1 - share) * target + share * current
        moved = np.linalg.norm(target - current)
        current = target
        if moved <= tol:
            break
    return current


def weighted_lower_median(values: np.ndarray, weights: np.ndarray) -> float:
    """Least value at which the running weight reaches half."""
    order = np.argsort(values, kind="stable")
    reached = np.cumsum(weights[order]) >= weights.sum() / 2 * ROUNDING
    return float(values[order][np.argmax(reached)])


def weiszfeld_groups(
    points: np.ndarray, weights: np.ndarray, inside: np.ndarray, tol: float, max_iter: int
) -> np.ndarray:
    """:func:`weiszfeld` for many groups at once; a group stops when its own step is small enough.

    ``points`` is (groups, places, features); places that are not ``inside`` only fill up and weigh nothing.
    """
    current = (points * weights[..., None]).sum(axis=1) / weights.sum(axis=1)[:, None]
    moving = np.arange(len(points))
    for _ in range(max_iter):
        if not len(moving):
            break
        cloud, mass, old = points[moving], weights[moving], current[moving]
        off = cloud - old[:, None, :]
        gaps = np.sqrt((off * off).sum(axis=2))
        away = (gaps > 1e-12) & inside[moving]
        some = away.any(axis=1)
        pull = np.where(away, mass, 0.0) / np.where(away, gaps, 1.0)
        total = np.where(some, pull.sum(axis=1), 1.0)
        target = (cloud * pull[..., None]).sum(axis=1) / total[:, None]
        here = np.where(away, 0.0, mass).sum(axis=1)
        force = np.sqrt(((off * pull[..., None]).sum(axis=1) ** 2).sum(axis=1))
        share = np.where(here > 0, np.where(force > 0, np.minimum(1.0, here / np.where(force > 0, force, 1.0)), 1.0), 0.0)
        target = (1 - share)[:, None] * target + share[:, None] * old
        target = np.where(some[:, None], target, old)
        current[moving] = target
        moving = moving[some & ~(np.sqrt(((target - old) ** 2).sum(axis=1)) <= tol)]
    return current


def weighted_lower_medians(values: np.ndarray, weights: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """:func:`weighted_lower_median` per group and feature of (groups, places, features)."""
    order = np.argsort(np.where(inside[..., None], values, np.inf), axis=1, kind="stable")
    mass = np.take_along_axis(np.broadcast_to(weights[..., None], values.shape), order, axis=1)
    reached = np.cumsum(mass, axis=1) >= weights.sum(axis=1)[:, None, None] / 2 * ROUNDING
    first = np.argmax(reached, axis=1)[:, None, :]
    return np.take_along_axis(np.take_along_axis(values, order, axis=1), first, axis=1)[:, 0, :]


# Numbers of one block of groups that are solved together.
BLOCK_CELLS = 1 << 19


def medians_of(
    points: np.ndarray, weights: np.ndarray, sizes: np.ndarray, tol: float, max_iter: int
) -> tuple[np.ndarray, np.ndarray]:
    """Geometric medians and weighted MADs of groups whose rows follow one another, ``sizes`` rows each.

    Groups of about the same size (up to the next power of two) are solved together in blocks of bounded size.
    """
    begins = np.cumsum(sizes) - sizes
    centres, spreads = np.empty((len(sizes), points.shape[1])), np.empty((len(sizes), points.shape[1]))
    places = 1 << np.ceil(np.log2(sizes)).astype(int)
    for wide in np.unique(places):
        same = np.flatnonzero(places == wide)
        step = max(1, BLOCK_CELLS // (int(wide) * max(1, points.shape[1])))
        for some in (same[i : i + step] for i in range(0, len(same), step)):
            inside = np.arange(wide) < sizes[some][:, None]
            rows = np.where(inside, begins[some][:, None] + np.arange(wide), begins[some][:, None])
            cloud, mass = points[rows], np.where(inside, weights[rows], 0.0)
            centres[some] = weiszfeld_groups(cloud, mass, inside, tol, max_iter)
            spreads[some] = weighted_lower_medians(np.abs(cloud - centres[some][:, None, :]), mass, inside)
    return centres, spreads


def _lists(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow column of lists."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), pa.float64()))


def geometric_median(
    buffer: DataFrame, keys: Sequence[str], vector: str, weight: str = "weight",
    tol: float = TOLERANCE, max_iter: int = MAX_ITERATIONS, largest: Sequence[str] = (),
) -> DataFrame:
    """Per key, the weighted geometric median ``centre`` and weighted MAD ``spread``.

    ``largest`` names columns whose maximum per key is wanted beside them.

    ``buffer`` must come from ``admit_to_buffer`` or ``epoch_members``, whose
    window bounds every group to the buffer size. A batch of groups is solved at once.
    """
    keys = list(keys)
    point = F.struct(q(vector).cast(ARRAY).alias("v"), q(weight).cast("double").alias("w"))
    clouds = buffer.groupBy(*[q(k) for k in keys]).agg(
        *[F.max(q(c)).alias(c) for c in largest], F.collect_list(point).alias("_cloud")
    )

    def solved(batch: pa.RecordBatch, sizes: np.ndarray) -> pa.RecordBatch:
        *head, lists = batch.columns
        rows = lists.flatten()
        points = rows.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        weights = rows.field("w").to_numpy(zero_copy_only=False)
        centres, spreads = medians_of(points, weights, sizes, tol, max_iter)
        return pa.RecordBatch.from_arrays(
            [*head, _lists(centres), _lists(spreads), pa.array(sizes, pa.int64())], names=out.names
        )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            lengths = lists.flatten().field("v").value_lengths().to_numpy(zero_copy_only=False)
            width = lengths[np.cumsum(sizes) - sizes]
            if not np.array_equal(np.repeat(width, sizes), lengths):
                raise ValueError(f"{vector}: vectors missing or of different lengths in one group")
            for w in np.unique(width):
                same = width == w
                yield solved(batch.filter(pa.array(same)), sizes[same])

    fields = [clouds.schema[k] for k in (*keys, *largest)]
    out = T.StructType(
        [*fields, T.StructField("centre", ARRAY), T.StructField("spread", ARRAY),
         T.StructField("members", T.LongType())]
    )
    return clouds.mapInArrow(solve, out)


def weighted_mad(
    buffer: DataFrame, keys: Sequence[str], centres: DataFrame, vector: str, weight: str = "weight"
) -> DataFrame:
    """Rows (keys, pos, spread): weighted lower median of absolute deviations, per feature.

    Equal distances are merged first; a group is at most one buffer long.
    """
    off = F.zip_with(q(vector), F.col("centre"), lambda x, c: F.abs(x - c))
    cells = buffer.join(centres.select(*keys, "centre"), list(keys)).select(
        *keys, q(weight).alias("_w"), F.posexplode(off).alias("pos", "_d")
    )
    merged = cells.groupBy(*keys, "pos", "_d").agg(F.sum("_w").alias("_w"))
    part = Window.partitionBy(*keys, "pos")
    upto = part.orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    placed = merged.withColumn("_cum", F.sum("_w").over(upto)).withColumn("_all", F.sum("_w").over(part))
    return placed.where(F.col("_cum") >= F.col("_all") / 2 * ROUNDING).groupBy(*keys, "pos").agg(
        F.min("_d").alias("spread")
    )


def displacement(candidate: Column, anchor: Column, anchor_spread: Column) -> Column:
    """Mean over features of the scaled distance; the score is the sum of the same terms."""
    return P.score_of(candidate, anchor, anchor_spread) / F.size(candidate)


def projected(candidate: Column, anchor: Column, distance: Column, budget: Column | float) -> Column:
    """The candidate, or the point at the budget on the way from the anchor to it."""
    limit = budget if isinstance(budget, Column) else F.lit(float(budget))
    share = F.when(distance > limit, limit / distance).otherwise(F.lit(1.0))
    return F.zip_with(candidate, anchor, lambda c, a: a + share * (c - a))


def budget_project(df: DataFrame, budget: float) -> DataFrame:
    """Bound ``centre`` around ``anchor_centre``; adds displacement, saturated, new_centre."""
    distance = displacement(F.col("centre"), F.col("anchor_centre"), F.col("anchor_dispersion"))
    placed = df.withColumn("displacement", distance)
    return placed.withColumn("saturated", (F.col("displacement") > budget).cast("int")).withColumn(
        "new_centre",
        projected(F.col("centre"), F.col("anchor_centre"), F.col("displacement"), budget),
    )


def sigma_bound(df: DataFrame, budget: float) -> DataFrame:
    """The same bound on ``dispersion``, as relative change over the anchor's."""
    distance = displacement(
        F.col("dispersion"), F.col("anchor_dispersion"), F.col("anchor_dispersion")
    )
    placed = df.withColumn("sigma_displacement", distance)
    return placed.withColumn(
        "new_dispersion",
        projected(
            F.col("dispersion"), F.col("anchor_dispersion"), F.col("sigma_displacement"), budget
        ),
    )


def cold_start_sessions(
    sessions: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = COLD_START_SESSIONS
) -> DataFrame:
    """The first ``n`` sessions per key that began with a passkey or better."""
    verified = sessions.where(F.col("c_verify") >= VERIFY_PASSKEY)
    return head_per_key(verified, keys, [q(c) for c in order], n, day_slot(q(order[0]), 7))


def cold_start(
    sessions: DataFrame, keys: Sequence[str], order: Sequence[str], vector: str,
    n: int = COLD_START_SESSIONS, scaling: str = "mad", floor: float = DISPERSION_FLOOR,
) -> DataFrame:
    """Bootstrap profiles; keys with fewer than ``n`` such sessions have none yet."""
    first = cold_start_sessions(sessions, keys, order, n)
    return P.fit_profiles(first, keys, vector, scaling, floor).where(F.col("n") >= n)


def _ranked(admitted: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Admitted sessions numbered 1, 2, ... per key, with the key's total."""
    return running(
        admitted, keys, order, day_slot(q(order[0]), 7),
        totals={"admitted_no": F.lit(1).cast("long")}, whole={"admitted_total": "admitted_no"},
    )


def ewma_profile(
    admitted: DataFrame, keys: Sequence[str], order: Sequence[str], start: DataFrame,
    vector: str, alpha: float,
) -> DataFrame:
    """Final exponentially weighted centre when admission does not depend on it.

    The recursion unrolls to fixed weights alpha (1 - alpha)^(n - i), so it is
    one weighted sum that combines on the map side; no key is walked in order.
    """
    age = F.col("admitted_total") - F.col("admitted_no")
    weighted = _ranked(admitted, keys, order).withColumn(
        "_w", F.lit(alpha) * F.pow(F.lit(1 - alpha), age)
    )
    cells = weighted.select(
        *keys, "admitted_total", "_w", F.posexplode(q(vector)).alias("_pos", "_x")
    )
    sums = cells.groupBy(*keys, "_pos").agg(
        F.sum(F.col("_w") * F.col("_x")).alias("_s"), F.max("admitted_total").alias("admitted")
    )
    packed = F.array_sort(F.collect_list(F.struct("_pos", "_s")))
    moved = sums.groupBy(*keys).agg(packed.alias("_cells"), F.max("admitted").alias("admitted"))
    left = F.pow(F.lit(1 - alpha), F.coalesce("admitted", F.lit(0)))
    old = F.transform("centre", lambda c: left * c)
    gained = F.coalesce(F.col("_cells._s"), F.transform("centre", lambda c: F.lit(0.0)))
    new = F.zip_with(old, gained, lambda c, s: c + s)
    return start.select(*keys, "centre").join(moved, list(keys), "left").select(
        *keys, F.coalesce("admitted", F.lit(0)).alias("admitted"), new.alias("centre")
    )


def trusted_replay(
    sessions: DataFrame, keys: Sequence[str], order: Sequence[str], start: DataFrame,
    vector: str, settings: Settings,
) -> DataFrame:
    """Policy P2 session by session: score, accepted, updated, displacement.

    Trust decides which sessions update, not the score, so the updates are known beforehand. Each is the step
    ``centre <- (1 - alpha) * centre + alpha * x`` and steps compose: no key is walked in order.
    """
    numbered = running(
        sessions.select(*keys, *order, "tau", q(vector).alias("x")), keys, order, day_slot(q(order[0]), 7),
        totals={"session_no": F.lit(1).cast("long")},
    )
    alpha, updates = settings.alpha, F.col("tau") >= settings.tau_min
    gain = F.when(updates, F.transform("x", lambda v: alpha * v))
    placed = affine_scan(numbered, keys, "session_no", F.when(updates, 1 - alpha).otherwise(1.0), gain)
    joined = placed.join(start.select(*keys, F.col("centre").alias("c0"), "dispersion"), list(keys))
    scored = joined.withColumn("centre", applied(F.col("before"), F.col("c0"))).withColumn(
        "score", P.checked_score(keys, "x", F.col("centre"), F.col("dispersion"))
    )
    after = F.when(updates, F.zip_with("centre", "x", lambda c, v: (1 - alpha) * c + alpha * v)).otherwise(F.col("centre"))
    return scored.select(
        *keys, *order, "score", (F.col("score") < settings.theta).cast("int").alias("accepted"),
        F.coalesce(updates, F.lit(False)).cast("int").alias("updated"),
        displacement(after, F.col("c0"), F.col("dispersion")).alias("displacement"),
    )


def ewma_replay(
    sessions: DataFrame, keys: Sequence[str], order: Sequence[str], start: DataFrame,
    vector: str, policy: str, settings: Settings,
) -> DataFrame:
    """Policies P1 and P2 session by session: score, accepted, updated, displacement.

    P1 updates when the score is below theta, P2 when tau reaches tau_min. A
    session is scored before it may move the profile. Only P1 decides its own next step and is walked in order.
    """
    if policy == "P2":
        return trusted_replay(sessions, keys, order, start, vector, settings)
    alpha, theta = settings.alpha, settings.theta
    rows = sessions.select(*keys, *order, q(vector).alias("x")).join(
        start.select(*keys, "centre", "dispersion"), list(keys)
    )

    def step(state, row):
        x, *profile = row[-3:]
        x = np.asarray(x, dtype=float)
        if state is None:
            centre, spread = (np.asarray(part, dtype=float) for part in profile)
            state = (centre, centre, spread)
        origin, centre, spread = state
        score = float(np.abs((x - centre) / spread).sum())
        update = score < theta
        if update:
            centre = (1 - alpha) * centre + alpha * x
        moved = float(np.abs((centre - origin) / spread).mean())
        return (origin, centre, spread), (score, int(score < theta), int(update), moved)

    schema = T.StructType(
        [*[rows.schema[c] for c in (*keys, *order)],
         T.StructField("score", T.DoubleType()), T.StructField("accepted", T.IntegerType()),
         T.StructField("updated", T.IntegerType()), T.StructField("displacement", T.DoubleType())]
    )
    return ordered_fold(rows, keys, order, step, schema)


def static_replay(
    sessions: DataFrame, keys: Sequence[str], order: Sequence[str], start: DataFrame,
    vector: str, settings: Settings,
) -> DataFrame:
    """Policy P0: every session against the enrolment profile."""
    scored = P.anomaly_score(sessions, start, list(keys), vector)
    return scored.select(
        *keys, *order, "score", (F.col("score") < settings.theta).cast("int").alias("accepted"),
        F.lit(0).alias("updated"), F.lit(0.0).alias("displacement"),
    )


def nightly_numbers(
    sessions: DataFrame, keys: Sequence[str], order: Sequence[str], settings: Settings
) -> DataFrame:
    """Sessions with their place among the admitted ones when nights end epochs too.

    Adds ``admitted``, ``day``, ``day_no`` (admitted ones of the day up to the row) and ``day_total``, and what
    earlier days hold: ``admitted_before`` sessions and ``epochs_before`` finished epochs. A day with n admitted
    sessions finishes ceil(n / every) epochs, the last one at midnight. A key has one row a day in the table
    of days; inside a day it is cut into quarters of an hour.
    """
    flag = F.when(F.col("tau") >= settings.tau_min, 1).otherwise(0).cast("long")
    dayed = sessions.withColumn("admitted", flag).withColumn("day", day_slot(q(order[0])))
    numbered = running(
        dayed, [*keys, "day"], order, day_slot(q(order[0]), 1 / 96),
        totals={"day_no": "admitted"}, whole={"day_total": "day_no"},
    )
    days = dayed.groupBy(*keys, "day").agg(F.sum("admitted").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda what: F.coalesce(F.sum(what).over(earlier), F.lit(0))
    before = days.select(
        *keys, "day", so_far(F.col("_n")).alias("admitted_before"),
        so_far(F.ceil(F.col("_n") / settings.every)).alias("epochs_before"),
    )
    return null_safe_join(numbered, before, [*keys, "day"])


def nightly_epochs(numbered: DataFrame, settings: Settings) -> DataFrame:
    """Admitted sessions with ``admitted_no``, the ``epoch`` they are new in, whether they close it and when it ends."""
    every, no = settings.every, F.col("day_no")
    closes_full = no % every == 0
    return numbered.where(F.col("admitted") == 1).withColumns(
        {
            "admitted_no": F.col("admitted_before") + no,
            "epoch": F.col("epochs_before") + F.ceil(no / every),
            "closes": closes_full | (no == F.col("day_total")),
            "fresh": (no - 1) % every + 1,
            "midnight": ~closes_full,
        }
    )


def _nightly_members(
    admitted: DataFrame, keys: Sequence[str], order: Sequence[str], vector: str, settings: Settings
) -> DataFrame:
    """Each epoch meets the sessions of its buffer in blocks of one buffer length, so of at most two blocks."""
    size, no = settings.buffer, F.col("admitted_no")
    known = nightly_epochs(nightly_numbers(admitted, keys, order, settings), settings).select(
        *keys, q(order[0]), "tau", q(vector), "day", "admitted_no", "epoch", "closes", "fresh", "midnight"
    )
    # Stored, as the sessions and the epochs that they close are read from it.
    known = materialise(known, "numbered")
    rows = known.select(
        *keys, q(order[0]).alias("_ts"), "admitted_no", F.col("tau").alias("weight"), q(vector).alias(vector),
        F.floor((no - 1) / size).alias("_block"),
    )
    ended = F.when(F.col("midnight"), (F.col("day") + 1) * DAY_SECONDS).otherwise(F.unix_seconds(q(order[0])))
    block = F.floor((no - 1) / size)
    closings = known.where("closes").select(
        *keys, "epoch", no.alias("_close"), "fresh", ended.alias("epoch_end"), F.explode(F.array(block, block - 1)).alias("_block")
    )
    inside = (F.col("admitted_no") <= F.col("_close")) & (F.col("admitted_no") > F.col("_close") - size)
    return null_safe_join(rows, closings, [*keys, "_block"]).where(inside).select(
        *keys, "_ts", "admitted_no", "weight", vector, "epoch", "epoch_end",
        (F.col("admitted_no") > F.col("_close") - F.col("fresh")).alias("newest"),
    )


def epoch_members(
    admitted: DataFrame, keys: Sequence[str], order: Sequence[str], vector: str, settings: Settings
) -> DataFrame:
    """Rows (keys, epoch, vector, weight): the buffer as it stands at each recomputation.

    Epoch e looks at the newest ``buffer`` of the sessions admitted when it closes. Without nights these are
    the first ``e * every``, so a session belongs to at most buffer / every epochs. ``newest`` marks those that no
    earlier epoch has, ``epoch_end`` is the second in which the epoch closes.
    """
    if settings.nightly:
        return _nightly_members(admitted, keys, order, vector, settings)
    every, size = settings.every, settings.buffer
    number = F.col("admitted_no")
    first = F.ceil(number / every)
    last = F.least(
        F.floor((number + size - 1) / every), F.floor(F.col("admitted_total") / every)
    )
    ranked = _ranked(admitted, keys, order)
    kept = ranked.where(last >= first)
    return kept.select(
        *keys, q(order[0]).alias("_ts"), "admitted_no", F.col("tau").alias("weight"),
        q(vector).alias(vector), F.explode(F.sequence(first, last)).alias("epoch"),
    ).withColumns({
        "epoch_end": F.unix_seconds("_ts"), "newest": F.col("admitted_no") > (F.col("epoch") - 1) * every,
    })


def epoch_candidates(
    admitted: DataFrame, keys: Sequence[str], order: Sequence[str], vector: str, settings: Settings
) -> DataFrame:
    """Per (key, epoch): candidate centre and spread, epoch end, whether full trust was seen."""
    members = epoch_members(admitted, keys, order, vector, settings)
    trusted = F.when(F.col("newest") & (F.col("weight") >= FULL_TRUST), 1).otherwise(0)
    marked = members.withColumn("full_trust", trusted)
    return geometric_median(marked, [*keys, "epoch"], vector, largest=["epoch_end", "full_trust"])


def bounded(candidate, anchor, spread, budget):
    """Candidate or its projection, its distance from the anchor, whether it was too far."""
    distance = float(np.mean(np.abs(candidate - anchor) / spread))
    if distance > budget:
        return anchor + budget / distance * (candidate - anchor), distance, True
    return candidate, distance, False


def within_budget(candidate, candidate_spread, anchor, spread, budget, floor):
    """Bound centre and spread alike: centre, spread, both distances, saturated."""
    centre, distance, over = bounded(candidate, anchor, spread, budget)
    wide = np.maximum(candidate_spread, floor)
    width, sigma_distance, sigma_over = bounded(wide, spread, spread, budget)
    return centre, np.maximum(width, floor), distance, sigma_distance, over or sigma_over


def re_anchor(
    candidates: DataFrame, keys: Sequence[str], start: DataFrame, settings: Settings,
    budget: str | None = None,
) -> DataFrame:
    """Walk the epochs: project centre and spread onto the budget, move the anchor when due.

    The anchor moves when a fully trusted session arrived in the epoch, or after
    30 days without saturation; the budget then starts afresh. ``budget`` may name
    a column, which must then be one of ``keys``; else the setting holds for all.
    """
    floor, fixed = settings.floor, settings.budget
    limit = F.lit(float(fixed)) if budget is None else q(budget)
    origin = start.select(*keys, F.col("centre").alias("c0"), F.col("dispersion").alias("d0"))
    rows = candidates.join(origin, list(keys))
    slim = rows.select(
        *keys, "epoch", F.col("epoch_end").alias("at"), "full_trust",
        F.col("centre").alias("cand"), F.col("spread").alias("cand_spread"), "c0", "d0",
        limit.alias("limit"),
    )

    def step(state, row):
        at, full, cand, cand_spread, c0, d0, limit = row[-7:]
        if state is None:
            state = (np.asarray(c0, float), np.asarray(d0, float), at, np.asarray(c0, float), np.asarray(d0, float))
        anchor, spread, calm_since, origin, origin_spread = state
        centre, width, distance, sigma_distance, saturated = within_budget(
            np.asarray(cand, float), np.asarray(cand_spread, float), anchor, spread, limit, floor
        )
        if saturated:
            calm_since = at
        due = full == 1 or at - calm_since >= RE_ANCHOR_DAYS * DAY_SECONDS
        # What the profile moved, which is less than the candidate asked for if it was projected.
        distance, sigma_distance = min(distance, limit), min(sigma_distance, limit)
        used = distance
        moved = float(np.mean(np.abs(centre - origin) / origin_spread))
        if due:
            anchor, spread, calm_since, used = centre, width, at, 0.0
        return (anchor, spread, calm_since, origin, origin_spread), (
            centre.tolist(), width.tolist(), distance, sigma_distance,
            int(saturated), int(due), float(used), moved,
        )

    fields = [slim.schema[c] for c in (*keys, "epoch")]
    schema = T.StructType(
        [*fields, T.StructField("centre", ARRAY), T.StructField("dispersion", ARRAY),
         T.StructField("displacement", T.DoubleType()), T.StructField("sigma_displacement", T.DoubleType()),
         T.StructField("saturated", T.IntegerType()), T.StructField("re_anchored", T.IntegerType()),
         T.StructField("budget_used", T.DoubleType()), T.StructField("moved", T.DoubleType())]
    )
    return ordered_fold(slim, keys, ["epoch"], step, schema)


def bounded_updates(
    admitted: DataFrame, epochs: DataFrame, keys: Sequence[str], order: Sequence[str], settings: Settings
) -> DataFrame:
    """Admitted sessions whose epoch was saturated: what they asked for was cut back to the budget.

    A session answers for the epoch in which it is new; sessions after the last closed epoch for none yet.
    """
    if settings.nightly:
        known = nightly_epochs(nightly_numbers(admitted, keys, order, settings), settings)
    else:
        known = _ranked(admitted, keys, order).withColumn("epoch", F.ceil(F.col("admitted_no") / settings.every))
    over = epochs.where(F.col("saturated") == 1).select(*keys, F.col("epoch").cast("long").alias("epoch"))
    return known.select(*keys, *order, F.col("epoch").cast("long").alias("epoch")).join(over, [*keys, "epoch"])


def profile_in_force(epochs: DataFrame, start: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Profiles per (key, epoch) and their distance from enrolment; epoch 0 is the enrolment profile."""
    origin = start.select(
        *keys, F.lit(0).cast("long").alias("epoch"), "centre", "dispersion", F.lit(0.0).alias("displacement")
    )
    return origin.unionByName(epochs.select(*keys, F.col("epoch").cast("long").alias("epoch"), "centre", "dispersion", F.col("moved").alias("displacement")))


def robust_replay(
    sessions: DataFrame, keys: Sequence[str], order: Sequence[str], start: DataFrame,
    vector: str, settings: Settings, epochs: DataFrame | None = None,
) -> DataFrame:
    """Policy P3: every session against the profile of the last finished epoch."""
    if epochs is None:
        known = sessions.join(start.select(*keys), list(keys), "left_semi")
        admitted = known.where(F.col("tau") >= settings.tau_min)
        epochs = re_anchor(
            epoch_candidates(admitted, keys, order, vector, settings), keys, start, settings
        )
    admitted_flag = F.when(F.col("tau") >= settings.tau_min, 1).otherwise(0)
    if settings.nightly:
        in_day = F.floor((F.col("day_no") - F.col("admitted")) / settings.every)
        placed = nightly_numbers(sessions, keys, order, settings).withColumn("epoch", F.col("epochs_before") + in_day)
    else:
        counted = running(
            sessions, keys, order, day_slot(q(order[0]), 7), totals={"_upto": admitted_flag.cast("long")}
        )
        before = F.col("_upto") - admitted_flag
        placed = counted.withColumn("epoch", F.floor(before / settings.every))
    joined = placed.join(profile_in_force(epochs, start, keys), [*keys, "epoch"])
    score = P.checked_score(keys, vector, F.col("centre"), F.col("dispersion"))
    return joined.withColumn("score", score).select(
        *keys, *order, "score", (F.col("score") < settings.theta).cast("int").alias("accepted"),
        admitted_flag.alias("updated"), "displacement", F.col("epoch").cast("long").alias("epoch"),
    )


def replay_policies(
    sessions: DataFrame, keys: Sequence[str], order: Sequence[str], start: DataFrame, vector: str,
    settings: Settings | None = None, policies: Sequence[str] = POLICIES,
) -> DataFrame:
    """All policies over the same sessions: keys, order, policy, score, accepted, updated, displacement."""
    settings = settings or Settings()
    start = materialise(start, "start")
    out = None
    for policy in policies:
        if policy == "P0":
            played = static_replay(sessions, keys, order, start, vector, settings)
        elif policy in ("P1", "P2"):
            played = ewma_replay(sessions, keys, order, start, vector, policy, settings)
        elif policy == "P3":
            played = robust_replay(sessions, keys, order, start, vector, settings).drop("epoch")
        else:
            raise ValueError(f"{policy!r} names no update policy; there are {', '.join(POLICIES)}")
        named = played.withColumn("policy", F.lit(policy))
        out = named if out is None else out.unionByName(named)
    return out


def policy_summary(played: DataFrame) -> DataFrame:
    """Per policy: sessions, accepted and updated shares, mean and largest displacement."""
    return played.groupBy("policy").agg(
        F.count("*").alias("sessions"),
        F.avg("accepted").alias("accept_rate"),
        F.avg("updated").alias("update_rate"),
        F.avg("displacement").alias("mean_displacement"),
        F.max("displacement").alias("max_displacement"),
    )


def sessions_to_impersonation(
    played: DataFrame, attacks: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Per (key, policy), which attack session was the first to be accepted (null if none).

    ``attacks`` holds the keys and order columns of the attacker's sessions.
    """
    numbered = running(
        attacks.select(*keys, *order), keys, order, day_slot(q(order[0]), 7),
        totals={"attack_no": F.lit(1).cast("long")},
    )
    return played.join(numbered, [*keys, *order]).groupBy(*keys, "policy").agg(
        F.count("*").alias("attacks"),
        F.min(F.when(F.col("accepted") == 1, F.col("attack_no"))).alias("first_accepted"),
    )


def weekly_displacement(
    sessions: DataFrame, keys: Sequence[str], ts: str, vector: str, floor: float = DISPERSION_FLOOR
) -> DataFrame:
    """Rows (keys, week, per_week): scaled move of the weekly centre since the week before it.

    Weeks are summed up first, so no pair of sessions is formed; a key has one row a week.
    """
    spreads = P.fit_profiles(sessions, list(keys), vector, "mad", floor)
    weeks = P.fit_centres(
        sessions.withColumn("week", day_slot(q(ts), 7)), [*keys, "week"], vector
    )
    along = Window.partitionBy(*keys).orderBy("week")
    pairs = weeks.withColumns(
        {"_before": F.lag("centre").over(along), "_week_before": F.lag("week").over(along)}
    ).where(F.col("_before").isNotNull())
    joined = pairs.join(spreads.select(*keys, "dispersion"), list(keys))
    moved = displacement(F.col("centre"), F.col("_before"), F.col("dispersion"))
    return joined.select(
        *keys, "week", (moved / (F.col("week") - F.col("_week_before"))).alias("per_week")
    )


def calibrate_budget(
    sessions: DataFrame, keys: Sequence[str], ts: str, vector: str, quantile: float = 0.95
) -> DataFrame:
    """One row ``budget``: a high quantile of genuine weekly displacement."""
    moves = weekly_displacement(sessions, keys, ts, vector).withColumn("_all", F.lit(1))
    return exact_quantiles(moves, ["_all"], "per_week", {"budget": quantile}).select("budget")


def budget_sweep(
    sessions: DataFrame, keys: Sequence[str], order: Sequence[str], start: DataFrame, vector: str,
    attack: Column, budgets: Sequence[float], settings: Settings | None = None,
) -> DataFrame:
    """Per budget: attacker acceptance, genuine rejection, mean displacement, saturation.

    Candidates do not depend on the budget and are computed once for all of them.
    """
    settings = settings or Settings()
    known = sessions.join(start.select(*keys), list(keys), "left_semi")
    admitted = known.where(F.col("tau") >= settings.tau_min)
    every = F.explode(F.array(*[F.lit(float(b)) for b in budgets])).alias("budget")
    candidates = epoch_candidates(admitted, keys, order, vector, settings).select("*", every)
    wide = [*keys, "budget"]
    starts = start.select("*", every)
    epochs = materialise(
        re_anchor(candidates, wide, starts, settings, budget="budget"), "epochs"
    )
    marked = known.withColumn("_attack", attack.cast("int")).select("*", every)
    played = robust_replay(marked, wide, order, starts, vector, settings, epochs)
    labels = known.select(*keys, *order, attack.cast("int").alias("attack"))
    joined = played.join(labels, [*keys, *order])
    rates = joined.groupBy("budget").agg(
        F.avg(F.when(F.col("attack") == 1, F.col("accepted"))).alias("attack_accept_rate"),
        F.avg(F.when(F.col("attack") == 0, 1 - F.col("accepted"))).alias("genuine_reject_rate"),
        F.avg("displacement").alias("mean_displacement"),
    )
    saturation = epochs.groupBy("budget").agg(F.avg("saturated").alias("saturation_rate"))
    return rates.join(saturation, "budget", "left")


def saturation_rates(epochs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return epochs.groupBy(*keys).agg(F.avg("saturated").alias("score"), F.count("*").alias("epochs"))


def saturation_detector(rates: DataFrame, attacked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Error curve of the saturation rate as a score; ``attacked`` lists the poisoned keys."""
    marks = attacked.select(*keys).distinct().withColumn("_hit", F.lit(1))
    labelled = rates.join(marks, list(keys), "left").select(
        F.lit("saturation").alias("subject"),
        F.coalesce("_hit", F.lit(0)).alias("label"),
        "score",
    )
    return E.error_curve(materialise(labelled, "saturation"))


def drift_frr(
    scored: DataFrame, subject: str, early: Column, quantile: float = 0.95
) -> DataFrame:
    """Per subject: threshold from early scores and the rejection rate of late ones."""
    marked = scored.withColumn("_early", early)
    limits = exact_quantiles(marked.where("_early"), [subject], "score", {"threshold": quantile})
    late = marked.where(~F.col("_early")).join(limits, subject)
    rejected = F.when(F.col("score") > F.col("threshold"), 1.0).otherwise(0.0)
    return late.groupBy(subject).agg(
        F.max("threshold").alias("threshold"), F.count("*").alias("late"), F.avg(rejected).alias("drift_frr")
    )


def eer_by_intensity(
    sessions: DataFrame, keys: Sequence[str], order: Sequence[str], start: DataFrame, vector: str,
    attack: Column, intensities: Sequence[float], settings: Settings | None = None,
    policy: str = "P1", draw: Sequence[str] | None = None,
) -> DataFrame:
    """Per share of attacker sessions let in: the EER of sessions scored while adapting.

    Which attacker sessions take part is drawn by a digest of the ``draw`` columns
    (keys and order unless named), so a higher intensity contains the lower ones.
    """
    settings = settings or Settings()
    drawn = sha256_text([q(c).cast("string") for c in draw or (*keys, *order)])
    share = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("long") % 10_000 / 10_000
    every = F.explode(F.array(*[F.lit(float(i)) for i in intensities])).alias("intensity")
    mixed = (
        sessions.withColumn("_attack", attack.cast("int"))
        .withColumn("_draw", share)
        .select("*", every)
        .where((F.col("_attack") == 0) | (F.col("_draw") < F.col("intensity")))
    )
    wide = [*keys, "intensity"]
    starts = start.select("*", every)
    if policy == "P0":
        played = static_replay(mixed, wide, order, starts, vector, settings)
    elif policy in ("P1", "P2"):
        played = ewma_replay(mixed, wide, order, starts, vector, policy, settings)
    elif policy == "P3":
        played = robust_replay(mixed, wide, order, starts, vector, settings)
    else:
        raise ValueError(f"{policy!r} names no update policy; there are {', '.join(POLICIES)}")
    labels = mixed.select(*wide, *order, F.col("_attack").alias("label"))
    scores = played.join(labels, [*wide, *order]).select(
        F.col("intensity").alias("subject"), "label", "score"
    )
    stored = materialise(scores, "intensity-scores")
    return E.equal_error_rate(stored).withColumnRenamed("subject", "intensity")
