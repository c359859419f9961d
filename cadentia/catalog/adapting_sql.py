"""SQL of the adaptation queries: medians, anchors and replays as recursive queries.

``#`` in a template stands for a feature's number.
"""

from __future__ import annotations

from cadentia.catalog.adapting_views import VECTORS

KEY = "user_id, device"


def each(template: str, separator: str = ", ") -> str:
    return separator.join(template.replace("#", str(i)) for i in range(3))


WIDE = VECTORS + f""",
enr AS (SELECT {KEY}, {each('max(c) FILTER (pos = #) AS c#')}, {each('max(d) FILTER (pos = #) AS d#')} FROM st GROUP BY 1, 2),
kv AS (SELECT v.*, {each('c#')}, {each('d#')} FROM v JOIN enr USING ({KEY})),
newest AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY ts DESC, event_id DESC) AS r FROM v WHERE tau >= 0.5),
held AS (SELECT {KEY}, 0 AS epoch, tau AS w, {each('x#')} FROM newest WHERE r <= 200)"""


def median_sql(members: str) -> str:
    """CTEs ``mid_<members>(key, epoch, c#)`` and ``mad_<members>(key, epoch, pos, s)``."""
    key = f"{KEY}, epoch"
    far = "FILTER (gap > 1e-12)"
    return f""",
walk_{members} AS (
  SELECT {key}, 0 AS it, false AS done, {each('sum(w * x#) / sum(w) AS c#')} FROM {members} GROUP BY 1, 2, 3
  UNION ALL
  SELECT {key}, it + 1, away = 0 OR sqrt({each('(t# - c#) * (t# - c#)', ' + ')}) <= 1e-6, {each('t#')} FROM (
    SELECT {key}, it, away, {each('c#')}, {each('CASE WHEN away = 0 THEN c# ELSE (1 - share) * m# + share * c# END AS t#')} FROM (
      SELECT *, CASE WHEN here = 0 THEN 0.0::DOUBLE WHEN force = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, here / force) END AS share FROM (
        SELECT *, sqrt({each('f# * f#', ' + ')}) AS force FROM (
          SELECT {key}, it, {each('c#')}, count(*) {far} AS away, coalesce(sum(w) FILTER (gap <= 1e-12), 0) AS here,
            {each(f'sum(w * x# / gap) {far} / sum(w / gap) {far} AS m#')}, {each(f'sum(w * (x# - c#) / gap) {far} AS f#')}
          FROM (SELECT {key}, it, w, {each('c#')}, {each('x#')}, sqrt({each('(x# - c#) * (x# - c#)', ' + ')}) AS gap
                FROM walk_{members} JOIN {members} USING ({key}) WHERE NOT done AND it < 100)
          GROUP BY {key}, it, {each('c#')}))))),
mid_{members} AS (SELECT * FROM walk_{members} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY it DESC) = 1),
off_{members} AS (SELECT {key}, pos, w, abs(CASE pos WHEN 0 THEN x0 - c0 WHEN 1 THEN x1 - c1 ELSE x2 - c2 END) AS d
  FROM {members} JOIN mid_{members} USING ({key}), (SELECT unnest([0, 1, 2]) AS pos)),
cum_{members} AS (SELECT *, sum(w) OVER (PARTITION BY {key}, pos ORDER BY d ROWS UNBOUNDED PRECEDING) AS cw,
  sum(w) OVER (PARTITION BY {key}, pos) AS tw FROM off_{members}),
mad_{members} AS (SELECT {key}, pos, min(d) AS s FROM cum_{members} WHERE cw >= tw / 2 * (1 - 1e-12) GROUP BY {key}, pos)"""


def counted_epochs(every: int, size: int, only: str) -> str:
    """CTEs ``em`` (members), ``ends`` and ``inforce(event_id, epoch)``: an epoch closes at every ``every``-th admission."""
    return f""",
adm AS (SELECT {KEY}, ts, tau AS w, {each('x#')}, row_number() OVER (PARTITION BY {KEY} ORDER BY ts, event_id) AS no FROM kv WHERE tau >= 0.5 AND {only}),
due AS (SELECT {KEY}, unnest(range(1, n // {every} + 1)) AS epoch FROM (SELECT {KEY}, max(no) AS n FROM adm GROUP BY 1, 2)),
em AS (SELECT adm.*, epoch FROM adm JOIN due USING ({KEY}) WHERE no <= epoch * {every} AND no > epoch * {every} - {size}),
ends AS (SELECT {KEY}, epoch, CAST(floor(epoch(max(ts))) AS BIGINT) AS ended,
  max(CASE WHEN no > (epoch - 1) * {every} AND w >= 1 THEN 1 ELSE 0 END) AS full_trust FROM em GROUP BY {KEY}, epoch),
inforce AS (SELECT event_id, (count(*) FILTER (tau >= 0.5) OVER (PARTITION BY {KEY} ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) // {every} AS epoch FROM kv)"""


def nightly_epochs(every: int, size: int, only: str) -> str:
    """The same where an epoch also closes at midnight, if sessions were admitted since the last one closed."""
    return f""",
adm AS (SELECT {KEY}, event_id, ts, CAST(ts AS DATE) AS day, tau AS w, {each('x#')}, row_number() OVER (PARTITION BY {KEY} ORDER BY ts, event_id) AS no,
  row_number() OVER (PARTITION BY {KEY}, CAST(ts AS DATE) ORDER BY ts, event_id) AS dn, count(*) OVER (PARTITION BY {KEY}, CAST(ts AS DATE)) AS dt
  FROM kv WHERE tau >= 0.5 AND {only}),
due AS (SELECT {KEY}, day, ts, event_id, dn % {every} = 0 AS filled, row_number() OVER (PARTITION BY {KEY} ORDER BY no) AS epoch, no AS close_no,
  (dn - 1) % {every} + 1 AS fresh, CAST(CASE WHEN dn % {every} = 0 THEN floor(epoch(ts)) ELSE epoch(day + INTERVAL 1 DAY) END AS BIGINT) AS ended
  FROM adm WHERE dn % {every} = 0 OR dn = dt),
em AS (SELECT adm.user_id, adm.device, no, w, {each('x#')}, epoch, close_no, fresh, ended FROM adm JOIN due USING ({KEY})
  WHERE no <= close_no AND no > close_no - {size}),
ends AS (SELECT {KEY}, epoch, any_value(ended) AS ended, max(CASE WHEN no > close_no - fresh AND w >= 1 THEN 1 ELSE 0 END) AS full_trust
  FROM em GROUP BY {KEY}, epoch),
inforce AS (SELECT kv.event_id, count(due.epoch) AS epoch FROM kv LEFT JOIN due ON kv.user_id = due.user_id AND kv.device = due.device
  AND (due.day < CAST(kv.ts AS DATE) OR (due.filled AND due.day = CAST(kv.ts AS DATE) AND (due.ts, due.event_id) < (kv.ts, kv.event_id)))
  GROUP BY kv.event_id)"""


def anchor_sql(every: int, size: int, budgets: str, only: str = "true", nightly: bool = False) -> str:
    """CTE ``ra``: one row per key, budget and epoch, epoch 0 being the enrolment profile; ``only`` limits the admitted."""
    return (nightly_epochs if nightly else counted_epochs)(every, size, only) + f"""
{median_sql('em')},
wid AS (SELECT {KEY}, epoch, {each('greatest(max(s) FILTER (pos = #), 1e-4) AS v#')} FROM mad_em GROUP BY {KEY}, epoch),
cand AS (SELECT {KEY}, epoch, {each('c# AS k#')}, {each('v#')}, ended, full_trust
  FROM mid_em JOIN wid USING ({KEY}, epoch) JOIN ends USING ({KEY}, epoch)),
lim AS (SELECT unnest([{budgets}]::DOUBLE[]) AS budget),
ra AS (
  SELECT {KEY}, budget, 0::BIGINT AS epoch, {each('c# AS o#')}, {each('d# AS e#')}, {each('c# AS a#')}, {each('d# AS s#')},
    {each('c# AS p#')}, {each('d# AS q#')}, NULL::BIGINT AS calm, 0.0::DOUBLE AS displacement, 0.0::DOUBLE AS budget_used,
    0.0::DOUBLE AS moved, 0 AS saturated, 0 AS re_anchored FROM enr, lim
  UNION ALL
  SELECT {KEY}, budget, epoch, {each('o#')}, {each('e#')}, {each('CASE WHEN moves THEN n# ELSE a# END')},
    {each('CASE WHEN moves THEN z# ELSE s# END')}, {each('n#')}, {each('z#')}, CASE WHEN moves THEN ended ELSE calm END,
    least(dist, budget), CASE WHEN moves THEN 0.0::DOUBLE ELSE least(dist, budget) END,
    ({each('abs(n# - o#) / e#', ' + ')}) / 3, sat::INTEGER, moves::INTEGER FROM (
    SELECT *, full_trust = 1 OR ended - calm >= 30 * 86400 AS moves FROM (
      SELECT *, CASE WHEN sat OR calm_before IS NULL THEN ended ELSE calm_before END AS calm FROM (
        SELECT *, dist > budget OR sdist > budget AS sat,
          {each('CASE WHEN dist > budget THEN a# + budget / dist * (k# - a#) ELSE k# END AS n#')},
          {each('greatest(CASE WHEN sdist > budget THEN s# + budget / sdist * (v# - s#) ELSE v# END, 1e-4) AS z#')} FROM (
          SELECT *, ({each('abs(k# - a#) / s#', ' + ')}) / 3 AS dist, ({each('abs(v# - s#) / s#', ' + ')}) / 3 AS sdist FROM (
            SELECT ra.user_id, ra.device, budget, cand.epoch, {each('o#')}, {each('e#')}, {each('a#')}, {each('s#')},
              calm AS calm_before, {each('k#')}, {each('v#')}, ended, full_trust
            FROM ra JOIN cand ON ra.user_id = cand.user_id AND ra.device = cand.device AND cand.epoch = ra.epoch + 1)))))),
p3 AS (SELECT f.*, budget, {each('abs(x# - p#) / q#', ' + ')} AS score, moved
  FROM (SELECT kv.*, epoch FROM kv JOIN inforce USING (event_id)) f JOIN ra USING ({KEY}, epoch))"""


def replay_sql(sessions: str) -> str:
    """CTE ``ew_<sessions>``: sessions of one ``grp`` after another; P2 gates on trust, every other group on the score."""
    return f""",
seq_{sessions} AS (SELECT *, row_number() OVER (PARTITION BY {KEY}, grp ORDER BY ts, event_id) AS no FROM {sessions}),
ew_{sessions} AS (
  SELECT DISTINCT {KEY}, grp, 0::BIGINT AS no, NULL::BIGINT AS event_id, {each('c#')}, 0.0::DOUBLE AS score, false AS updated, 0.0::DOUBLE AS moved FROM {sessions}
  UNION ALL
  SELECT {KEY}, grp, no, event_id, {each('n#')}, score, updated, ({each('abs(n# - o#) / d#', ' + ')}) / 3 FROM (
    SELECT *, {each('CASE WHEN updated THEN 0.9 * c# + 0.1 * x# ELSE c# END AS n#')} FROM (
      SELECT *, CASE WHEN grp = 'P2' THEN tau >= 0.5 ELSE score < 12 END AS updated FROM (
        SELECT s.user_id, s.device, s.grp, s.no, s.event_id, {each('e.c#')}, {each('s.c# AS o#')}, {each('d#')}, {each('x#')}, tau,
          {each('abs(x# - e.c#) / d#', ' + ')} AS score
        FROM ew_{sessions} e JOIN seq_{sessions} s ON s.user_id = e.user_id AND s.device = e.device AND s.grp = e.grp AND s.no = e.no + 1))))"""


def played_sql(every: int, size: int) -> str:
    """CTE ``played(key, policy, event_id, score, accepted, updated, displacement)`` of all four policies."""
    return (
        WIDE
        + anchor_sql(every, size, "0.5")
        + ", twice AS (SELECT kv.*, unnest(['P1', 'P2']) AS grp FROM kv)"
        + replay_sql("twice")
        + f""",
runs AS (
  SELECT 'P0' AS policy, {KEY}, event_id, {each('abs(x# - c#) / d#', ' + ')} AS score, 0 AS updated, 0.0::DOUBLE AS displacement FROM kv
  UNION ALL SELECT grp, {KEY}, event_id, score, updated::INTEGER, moved FROM ew_twice WHERE no > 0
  UNION ALL SELECT 'P3', {KEY}, event_id, score, (tau >= 0.5)::INTEGER, moved FROM p3),
played AS (SELECT *, (score < 12)::INTEGER AS accepted FROM runs)"""
    )
