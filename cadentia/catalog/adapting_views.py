"""SQL of the vectors, enrolment profiles and buffers that adaptation reads."""

from __future__ import annotations

from cadentia.catalog.behaviour import TRUST

VECTORS = TRUST + """,
vx AS (SELECT user_id, device, ts, event_id, c_verify, tau, event_type, value AS x0,
         (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 3.6e9 AS x1, hour(ts)::DOUBLE AS x2 FROM tau),
v AS (SELECT * FROM vx WHERE x1 IS NOT NULL),
cells AS (SELECT user_id, device, ts, event_id, c_verify, tau, pos, CASE pos WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END AS x
          FROM v, (SELECT unnest([0, 1, 2]) AS pos)),
cs AS (SELECT *, row_number() OVER (PARTITION BY user_id, device, pos ORDER BY ts, event_id) AS n FROM cells WHERE c_verify >= 0.6),
st0 AS (SELECT user_id, device, pos, avg(x) AS c FROM cs WHERE n <= 5 GROUP BY 1, 2, 3 HAVING count(*) >= 5),
st AS (SELECT s.user_id, s.device, s.pos, any_value(c) AS c, greatest(avg(abs(x - c)), 1e-4) AS d
       FROM cs JOIN st0 s ON cs.user_id = s.user_id AND cs.device = s.device AND cs.pos = s.pos WHERE n <= 5 GROUP BY 1, 2, 3),
bufr AS (SELECT *, row_number() OVER (PARTITION BY user_id, device, pos ORDER BY ts DESC, event_id DESC) AS br FROM cells WHERE tau >= 0.5),
buf AS (SELECT * FROM bufr WHERE br <= 200)"""
