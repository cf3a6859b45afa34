"""Queries whose Spark plan and oracle are written apart: each rule twice, once for scale and once plainly.

Spark bodies reduce before they sort (histograms, minima of structs), split long sequences by day with what
the days before carry over, and give band joins a time bucket as an equality key. The oracle states the
same rule as a self join, a correlated subquery or one long window.
"""

from __future__ import annotations

_ORDER = "PARTITION BY game, category ORDER BY started_at_ms, id"
_NEAR = "a.game = b.game AND a.category = b.category"

SPARK: dict[str, str] = {
    "golds": """
WITH s AS (SELECT o.game, s.act, s.segment_ms, s.run_id, o.started_at_ms, o.status = 'F' AS finished FROM splits s JOIN ord o ON s.run_id = o.id),
h AS (SELECT game, act, segment_ms, count(*) AS n FROM s GROUP BY game, act, segment_ms),
c AS (SELECT *, sum(n) OVER (PARTITION BY game, act ORDER BY segment_ms) AS upto, sum(n) OVER (PARTITION BY game, act) AS samples FROM h),
m AS (SELECT game, act, min(segment_ms) AS med, min(samples) AS samples FROM c WHERE upto >= (samples + 1) DIV 2 GROUP BY game, act),
l AS (SELECT game, max(act) AS last FROM m GROUP BY game)
SELECT game, act, g.segment_ms AS gold_ms, g.started_at_ms AS set_at_ms, g.run_id AS run_id, samples FROM (
  SELECT s.game, s.act, min(struct(s.segment_ms, s.started_at_ms, s.run_id)) AS g, min(m.samples) AS samples
  FROM s JOIN m ON s.game = m.game AND s.act = m.act JOIN l ON s.game = l.game
  WHERE s.segment_ms >= 0.85D * m.med AND (s.act < l.last OR s.finished) GROUP BY s.game, s.act) x""",
    "death_chart_acts": """
WITH d AS (SELECT CASE WHEN last_ms < 10000 THEN 0 WHEN last_ms < 30000 THEN 1 WHEN last_ms < 60000 THEN 2 ELSE 3 END AS act, count(*) AS n FROM runs WHERE outcome = 'reset' AND last_ms IS NOT NULL GROUP BY 1)
SELECT a.act, coalesce(d.n, 0) AS deaths, coalesce(d.n, 0) * 100D / t.total AS pct FROM (SELECT explode(sequence(0, 3)) AS act) a LEFT JOIN d ON a.act = d.act
CROSS JOIN (SELECT sum(n) AS total, max(act) AS top FROM d) t WHERE a.act <= t.top""",
    "death_chart_minutes": """
WITH d AS (SELECT last_ms DIV 60000 AS minute, count(*) AS n FROM runs WHERE outcome = 'reset' AND last_ms IS NOT NULL GROUP BY 1),
t AS (SELECT sum(n) AS total, max(minute) AS top FROM d)
SELECT concat(a.minute, '-', a.minute + 1, 'm') AS label, coalesce(d.n, 0) AS deaths, coalesce(d.n, 0) * 100D / a.total AS pct
FROM (SELECT total, explode(sequence(0L, top)) AS minute FROM t) a LEFT JOIN d ON a.minute = d.minute""",
    "survival": """
SELECT act, n AS survived, n * 100D / total AS pct FROM (
  SELECT total, posexplode(array(a, b, c, f)) AS (act, n) FROM (SELECT count(*) AS total, count_if(outcome = 'finished') AS f,
    count_if(outcome = 'finished' OR last_ms >= 10000) AS a, count_if(outcome = 'finished' OR last_ms >= 30000) AS b, count_if(outcome = 'finished' OR last_ms >= 60000) AS c FROM runs) r) x""",
    "fill_numbers": f"""
WITH read AS (SELECT id, ls, lag(ls) OVER ({_ORDER}) AS p, lead(ls) OVER ({_ORDER}) AS n FROM runs WHERE ls IS NOT NULL),
kept AS (SELECT id AS kid, ls AS good FROM read WHERE NOT coalesce(p < n AND NOT (p < ls AND ls < n), false)),
o AS (SELECT r.id, r.game, r.category, k.good, row_number() OVER ({_ORDER}) AS rn FROM runs r LEFT JOIN kept k ON r.id = k.kid),
f AS (SELECT *, last_value(CASE WHEN good IS NOT NULL THEN struct(good, rn) END) IGNORE NULLS OVER (PARTITION BY game, category ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
  last_value(CASE WHEN good IS NOT NULL THEN struct(good, rn) END) IGNORE NULLS OVER (PARTITION BY game, category ORDER BY rn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM o)
SELECT id, p.good + rn - p.rn AS filled FROM f WHERE good IS NULL AND n.good - p.good = n.rn - p.rn""",
    "pb_history": """
WITH f AS (SELECT game, day, id, started_at_ms, final_ms FROM runs WHERE final_ms IS NOT NULL),
d AS (SELECT game, day, min(least) OVER (PARTITION BY game ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT game, day, min(final_ms) AS least FROM f GROUP BY game, day) x)
SELECT game, id, final_ms FROM (SELECT f.game, f.id, f.final_ms, least(d.before, min(f.final_ms) OVER (PARTITION BY f.game, f.day ORDER BY f.started_at_ms, f.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS prev
  FROM f JOIN d ON f.game = d.game AND f.day = d.day) y WHERE prev IS NULL OR final_ms < prev""",
    "reset_streaks": """
WITH o AS (SELECT game, day, outcome, count_if(outcome = 'finished') OVER (PARTITION BY game, day ORDER BY started_at_ms, id) AS island FROM runs),
i AS (SELECT game, day, island, count_if(outcome = 'reset') AS n FROM o GROUP BY game, day, island),
d AS (SELECT game, day, max(island) AS fin, coalesce(max(CASE WHEN island = 0 THEN n END), 0) AS head, max_by(n, island) AS tail, max(n) AS best, sum(n) AS resets FROM i GROUP BY game, day),
g AS (SELECT *, sum(fin) OVER (PARTITION BY game ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM d),
parts AS (SELECT game, coalesce(done, 0) AS island, head AS n FROM g UNION ALL SELECT game, coalesce(done, 0) + fin, tail FROM g WHERE fin > 0)
SELECT game, cast(max(n) AS bigint) AS longest FROM (SELECT game, n FROM (SELECT game, island, sum(n) AS n FROM parts GROUP BY game, island) p UNION ALL SELECT game, best FROM d) x GROUP BY game""",
    "streaks": """
WITH f AS (SELECT game, max(struct(started_at_ms, id)) AS at FROM runs WHERE outcome = 'finished' GROUP BY game)
SELECT r.game, count(*) AS attempts, count_if(r.outcome = 'finished') AS finished, count_if(f.at IS NULL OR struct(r.started_at_ms, r.id) > f.at) AS current_streak,
  CASE WHEN count_if(r.outcome = 'finished') > 0 THEN count(*) * 1D / count_if(r.outcome = 'finished') END AS attempts_per_finish FROM runs r LEFT JOIN f ON r.game = f.game GROUP BY r.game""",
    "echo_rows": """
SELECT id, time, prev.time AS prev_time FROM (SELECT id, price DIV 50000 AS time, max(struct(started_at_ms AS t, id, price DIV 50000 AS time)) OVER (PARTITION BY session_id, status ORDER BY started_at_ms RANGE BETWEEN UNBOUNDED PRECEDING AND 3600001 PRECEDING) AS prev FROM ord) x
WHERE prev.time = time""",
    "clock_cluster": """
SELECT game, day, max(n) AS agreeing FROM (SELECT game, day, count(*) OVER (PARTITION BY game, day ORDER BY last_ms - started_at_ms % 300000 RANGE BETWEEN 2000 PRECEDING AND 2000 FOLLOWING) AS n FROM runs WHERE last_ms IS NOT NULL) x GROUP BY game, day""",
    "run_throughs": """
SELECT session_id, thread, count(*) AS runs, min(started_at_ms) AS started_at_ms, max(last_ms) AS reached_ms FROM (
  SELECT *, count_if(fresh) OVER (PARTITION BY session_id ORDER BY started_at_ms, last_ms NULLS FIRST, id) AS thread FROM (
    SELECT *, at IS NULL OR started_at_ms - at > 7200000 OR coalesce(last_ms - coalesce(final_ms, 0) < 60000, false) AS fresh FROM (
      SELECT *, lag(started_at_ms) OVER (PARTITION BY session_id ORDER BY started_at_ms, last_ms NULLS FIRST, id) AS at FROM runs) a) b) c GROUP BY session_id, thread""",
    "live_replay_unmatched": f"""
WITH a AS (SELECT id, id % 2 AS side, game, category, outcome, final_ms, started_at_ms FROM runs),
near AS (SELECT DISTINCT a.id FROM (SELECT *, explode(array(started_at_ms DIV 30000 - 1, started_at_ms DIV 30000, started_at_ms DIV 30000 + 1)) AS k FROM a) a
  JOIN (SELECT *, started_at_ms DIV 30000 AS k FROM a) b ON a.k = b.k AND {_NEAR} AND a.side <> b.side AND abs(a.started_at_ms - b.started_at_ms) < 30000),
same AS (SELECT DISTINCT a.id FROM (SELECT *, explode(array(started_at_ms DIV 3600000 - 1, started_at_ms DIV 3600000, started_at_ms DIV 3600000 + 1)) AS k FROM a) a
  JOIN (SELECT *, started_at_ms DIV 3600000 AS k FROM a WHERE outcome = 'finished') b ON a.k = b.k AND {_NEAR} AND a.side <> b.side AND coalesce(a.final_ms, 0) = b.final_ms AND abs(a.started_at_ms - b.started_at_ms) < 3600000)
SELECT CASE WHEN side = 0 THEN 'LIVE-ONLY' ELSE 'REPLAY-ONLY' END AS verdict, id FROM a LEFT ANTI JOIN (SELECT id AS k FROM near UNION SELECT id FROM same) m ON a.id = m.k""",
    "band_join": f"""
SELECT a.id AS a_id, b.id AS b_id FROM (SELECT *, explode(array(started_at_ms DIV 30000 - 1, started_at_ms DIV 30000, started_at_ms DIV 30000 + 1)) AS k FROM runs WHERE kind = 'view') a
JOIN (SELECT *, started_at_ms DIV 30000 AS k FROM runs WHERE kind = 'click') b ON a.k = b.k AND {_NEAR} AND abs(a.started_at_ms - b.started_at_ms) < 30000""",
    "band_anti": """
SELECT id FROM runs LEFT ANTI JOIN (SELECT a.id AS k FROM (SELECT *, explode(array(started_at_ms DIV 300000 - 1, started_at_ms DIV 300000, started_at_ms DIV 300000 + 1)) AS k FROM runs WHERE outcome = 'finished') a
  JOIN (SELECT *, started_at_ms DIV 300000 AS k FROM runs WHERE kind = 'click') b ON a.k = b.k AND a.game = b.game AND abs(a.started_at_ms - b.started_at_ms) < 300000) m ON id = m.k WHERE outcome = 'finished'""",
    "overlap_anti": """
WITH e AS (SELECT id, game, kind, started_at_ms, started_at_ms + 600000 AS t, cast(NULL AS bigint) AS until FROM runs WHERE kind = 'signup'
  UNION ALL SELECT id, game, kind, started_at_ms, started_at_ms, started_at_ms + coalesce(last_ms, 0) FROM runs WHERE kind = 'error' AND game IS NOT NULL AND started_at_ms IS NOT NULL),
h AS (SELECT *, t DIV 3600000 AS hour FROM e),
c AS (SELECT game, hour, max(top) OVER (PARTITION BY game ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT game, hour, max(until) AS top FROM h GROUP BY game, hour) x),
w AS (SELECT id, game, kind, hour, started_at_ms, max(until) OVER (PARTITION BY game, hour ORDER BY t, until NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM h)
SELECT w.id FROM w LEFT JOIN c ON w.game = c.game AND w.hour = c.hour WHERE w.kind = 'signup' AND NOT coalesce(greatest(w.top, c.before) > w.started_at_ms, false)""",
    "overlap_semi": """
SELECT DISTINCT a.id FROM (SELECT *, explode(sequence(started_at_ms DIV 600000, (started_at_ms + 600000) DIV 600000)) AS k FROM runs WHERE kind = 'signup') a
JOIN (SELECT *, explode(sequence(started_at_ms DIV 600000, (started_at_ms + coalesce(last_ms, 0)) DIV 600000)) AS k FROM runs WHERE kind = 'error') b
ON a.k = b.k AND a.game = b.game AND b.started_at_ms < a.started_at_ms + 600000 AND b.started_at_ms + coalesce(b.last_ms, 0) > a.started_at_ms""",
    "mutual_nearest": """
SELECT a_id, b_id FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY far, b_id) AS ra, row_number() OVER (PARTITION BY b_id ORDER BY far, a_id) AS rb FROM (
  SELECT a.id AS a_id, b.id AS b_id, abs(a.started_at_ms - b.started_at_ms) AS far FROM (SELECT *, explode(array(started_at_ms DIV 36000000 - 1, started_at_ms DIV 36000000, started_at_ms DIV 36000000 + 1)) AS k FROM runs WHERE outcome = 'finished') a
  JOIN (SELECT *, started_at_ms DIV 36000000 AS k FROM runs WHERE kind = 'click') b ON a.k = b.k AND a.session_id = b.session_id AND abs(a.started_at_ms - b.started_at_ms) < 36000000) x) y WHERE ra = 1 AND rb = 1""",
}

_READ = "SELECT id, game, category, started_at_ms, ls, lag(ls) OVER w AS p, lead(ls) OVER w AS n FROM runs WHERE ls IS NOT NULL WINDOW w AS (PARTITION BY game, category ORDER BY started_at_ms, id)"
DUCK: dict[str, str] = {
    "golds": """
seg AS (SELECT o.game, s.act, s.segment_ms, s.run_id, o.started_at_ms, o.status, row_number() OVER (PARTITION BY o.game, s.act ORDER BY s.segment_ms) AS rk, count(*) OVER (PARTITION BY o.game, s.act) AS cnt FROM splits s JOIN ord o ON o.id = s.run_id),
med AS (SELECT game, act, segment_ms AS m FROM seg WHERE rk = (cnt + 1) // 2),
ok AS (SELECT seg.*, row_number() OVER (PARTITION BY seg.game, seg.act ORDER BY seg.segment_ms, seg.started_at_ms, seg.run_id) AS rn FROM seg JOIN med USING (game, act)
  WHERE seg.segment_ms >= 0.85::DOUBLE * med.m AND (seg.act < (SELECT max(act) FROM seg z WHERE z.game = seg.game) OR seg.status = 'F'))
SELECT game, act, segment_ms AS gold_ms, started_at_ms AS set_at_ms, run_id, cnt AS samples FROM ok WHERE rn = 1""",
    "death_chart_acts": """
acts AS (SELECT * FROM (VALUES (0, 0, 10000), (1, 10000, 30000), (2, 30000, 60000), (3, 60000, 9000000000000)) v(act, lo, hi)),
died AS (SELECT last_ms FROM runs WHERE outcome <> 'finished' AND last_ms IS NOT NULL),
c AS (SELECT act, (SELECT count(*) FROM died WHERE last_ms < hi AND (last_ms >= lo OR act = 0)) AS deaths FROM acts)
SELECT act, deaths, deaths * 100::DOUBLE / (SELECT count(*) FROM died) AS pct FROM c WHERE act <= (SELECT max(act) FROM c WHERE deaths > 0)""",
    "death_chart_minutes": """
died AS (SELECT last_ms // 60000 AS minute FROM runs WHERE outcome <> 'finished' AND last_ms IS NOT NULL),
m AS (SELECT unnest(range(0, (SELECT max(minute) + 1 FROM died))) AS minute)
SELECT minute || '-' || (minute + 1) || 'm' AS label, (SELECT count(*) FROM died d WHERE d.minute = m.minute) AS deaths, (SELECT count(*) FROM died d WHERE d.minute = m.minute) * 100::DOUBLE / (SELECT count(*) FROM died) AS pct FROM m""",
    "survival": """
acts AS (SELECT * FROM (VALUES (0, 10000), (1, 30000), (2, 60000), (3, NULL)) v(act, hi))
SELECT act, count(*) FILTER (r.outcome = 'finished' OR r.last_ms >= hi) AS survived, count(*) FILTER (r.outcome = 'finished' OR r.last_ms >= hi) * 100::DOUBLE / count(*) AS pct FROM acts CROSS JOIN runs r GROUP BY act""",
    "fill_numbers": f"""
bad AS (SELECT id FROM ({_READ}) r WHERE p IS NOT NULL AND n IS NOT NULL AND p < n AND NOT (p < ls AND ls < n)),
o AS (SELECT id, game, category, CASE WHEN id NOT IN (SELECT id FROM bad) THEN ls END AS ls, row_number() OVER (PARTITION BY game, category ORDER BY started_at_ms, id) AS rn FROM runs),
w AS (SELECT o.*, (SELECT max(x.rn) FROM o x WHERE x.game = o.game AND x.category = o.category AND x.ls IS NOT NULL AND x.rn < o.rn) AS prn, (SELECT min(x.rn) FROM o x WHERE x.game = o.game AND x.category = o.category AND x.ls IS NOT NULL AND x.rn > o.rn) AS nrn FROM o WHERE ls IS NULL)
SELECT w.id, p.ls + w.rn - w.prn AS filled FROM w JOIN o p ON p.game = w.game AND p.category = w.category AND p.rn = w.prn JOIN o n ON n.game = w.game AND n.category = w.category AND n.rn = w.nrn WHERE n.ls - p.ls = w.nrn - w.prn""",
    "pb_history": """
f AS (SELECT * FROM runs WHERE final_ms IS NOT NULL)
SELECT game, id, final_ms FROM f WHERE NOT EXISTS (SELECT 1 FROM f e WHERE e.game = f.game AND e.final_ms <= f.final_ms AND (e.started_at_ms < f.started_at_ms OR e.started_at_ms = f.started_at_ms AND e.id < f.id))""",
    "reset_streaks": """
o AS (SELECT game, outcome, row_number() OVER (PARTITION BY game ORDER BY started_at_ms, id) - row_number() OVER (PARTITION BY game, outcome ORDER BY started_at_ms, id) AS island FROM runs),
c AS (SELECT game, island, count(*) AS n FROM o WHERE outcome = 'reset' GROUP BY game, island)
SELECT g.game, coalesce((SELECT max(n) FROM c WHERE c.game = g.game), 0)::BIGINT AS longest FROM (SELECT DISTINCT game FROM runs) g""",
    "streaks": """
r AS (SELECT *, sum((outcome = 'finished')::INT) OVER (PARTITION BY game ORDER BY started_at_ms DESC, id DESC) AS ahead FROM runs)
SELECT game, count(*) AS attempts, count(*) FILTER (outcome = 'finished') AS finished, count(*) FILTER (ahead = 0) AS current_streak, count(*)::DOUBLE / nullif(count(*) FILTER (outcome = 'finished'), 0) AS attempts_per_finish FROM r GROUP BY game""",
    "echo_rows": """
o AS (SELECT *, price // 50000 AS time FROM ord),
p AS (SELECT a.id, a.time, b.time AS prev_time, row_number() OVER (PARTITION BY a.id ORDER BY b.started_at_ms DESC, b.id DESC) AS k FROM o a JOIN o b ON a.session_id = b.session_id AND a.status = b.status AND b.started_at_ms < a.started_at_ms - 3600000)
SELECT id, time, prev_time FROM p WHERE k = 1 AND time = prev_time""",
    "clock_cluster": """
o AS (SELECT id, game, day, last_ms - started_at_ms % 300000 AS off FROM runs WHERE last_ms IS NOT NULL),
c AS (SELECT a.id, a.game, a.day, count(*) AS n FROM o a JOIN o b ON a.game = b.game AND a.day = b.day AND b.off - a.off <= 2000 AND a.off - b.off <= 2000 GROUP BY ALL)
SELECT game, day, max(n) AS agreeing FROM c GROUP BY game, day""",
    "run_throughs": """
o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY started_at_ms, last_ms NULLS FIRST, id) AS k FROM runs),
f AS (SELECT b.*, (a.id IS NULL OR b.started_at_ms > a.started_at_ms + 7200000 OR (b.last_ms IS NOT NULL AND b.last_ms < coalesce(b.final_ms, 0) + 60000)) AS fresh FROM o b LEFT JOIN o a ON a.session_id = b.session_id AND a.k = b.k - 1),
t AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY session_id ORDER BY k) AS thread FROM f)
SELECT session_id, thread::BIGINT AS thread, count(*) AS runs, min(started_at_ms) AS started_at_ms, max(last_ms) AS reached_ms FROM t GROUP BY session_id, thread""",
    "live_replay_unmatched": """
r AS (SELECT *, id % 2 AS side FROM runs)
SELECT CASE side WHEN 0 THEN 'LIVE-ONLY' ELSE 'REPLAY-ONLY' END AS verdict, id FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.side <> a.side AND b.game = a.game AND b.category = a.category
  AND (abs(a.started_at_ms - b.started_at_ms) < 30000 OR (b.outcome = 'finished' AND b.final_ms = coalesce(a.final_ms, 0) AND abs(a.started_at_ms - b.started_at_ms) < 3600000)))""",
    "band_join": "one AS (SELECT 1) SELECT a.id AS a_id, b.id AS b_id FROM runs a JOIN runs b ON a.game = b.game AND a.category = b.category AND a.kind = 'view' AND b.kind = 'click' AND abs(a.started_at_ms - b.started_at_ms) < 30000",
    "band_anti": "one AS (SELECT 1) SELECT a.id FROM runs a WHERE a.outcome = 'finished' AND NOT EXISTS (SELECT 1 FROM runs b WHERE b.game = a.game AND b.kind = 'click' AND abs(a.started_at_ms - b.started_at_ms) < 300000)",
    "overlap_semi": "one AS (SELECT 1) SELECT a.id FROM runs a WHERE a.kind = 'signup' AND EXISTS (SELECT 1 FROM runs b WHERE b.kind = 'error' AND b.game = a.game AND b.started_at_ms < a.started_at_ms + 600000 AND b.started_at_ms + coalesce(b.last_ms, 0) > a.started_at_ms)",
    "mutual_nearest": """
p AS (SELECT a.id AS a_id, b.id AS b_id, abs(a.started_at_ms - b.started_at_ms) AS far FROM runs a JOIN runs b ON a.session_id = b.session_id AND a.outcome = 'finished' AND b.kind = 'click' AND abs(a.started_at_ms - b.started_at_ms) < 36000000)
SELECT a_id, b_id FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.a_id = p.a_id AND (q.far, q.b_id) < (p.far, p.b_id)) AND NOT EXISTS (SELECT 1 FROM p q WHERE q.b_id = p.b_id AND (q.far, q.a_id) < (p.far, p.a_id))""",
}
