"""Further queries of the catalogue: scans, predicates, page statistics, merges and checks.

SAME holds statements that read the same in both engines; APART those whose oracle is written another way.
"""

from __future__ import annotations

_THREADS = """SELECT *, count_if(fresh) OVER (PARTITION BY session_id ORDER BY started_at_ms, last_ms NULLS FIRST, id) AS thread FROM (
  SELECT *, earlier IS NULL OR started_at_ms - earlier > 7200000 OR coalesce(last_ms - coalesce(final_ms, 0) < 60000, false) AS fresh FROM (
    SELECT *, lag(started_at_ms) OVER (PARTITION BY session_id ORDER BY started_at_ms, last_ms NULLS FIRST, id) AS earlier FROM runs) a) b"""

SAME: dict[str, str] = {
    # scans
    "runs_since": "SELECT id, game, category, outcome, final_ms FROM runs WHERE game = 'game1' AND category = 'cat1' AND started_at_ms >= (SELECT min(started_at_ms) + 864000000 FROM runs) ORDER BY id",
    "runs_brief": "SELECT id, started_at_ms, outcome, final_ms, last_ms, ls FROM runs WHERE game = 'game1' AND category = 'cat1' ORDER BY started_at_ms, id",
    "session_days": "SELECT id AS session_id, day FROM ord",
    "run_by_id": "SELECT o.id, o.price, s.act, s.segment_ms FROM ord o LEFT JOIN splits s ON s.run_id = o.id WHERE o.id = 7",
    # predicates
    "time_range": "SELECT id, outcome FROM runs WHERE started_at_ms >= (SELECT min(started_at_ms) + 86400000 FROM runs) AND started_at_ms < (SELECT min(started_at_ms) + 259200000 FROM runs)",
    "privacy_view": "SELECT c_custkey AS session_id, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS vod_id, c_mktsegment AS source FROM customer",
    "page_diet": "SELECT id, session_id, outcome, final_ms, last_ms FROM runs WHERE kind <> 'view'",
    "dangling_session": "SELECT o.id, c.c_custkey AS session_id FROM ord o LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON o.session_id = c.c_custkey",
    "category_prefix": "SELECT p_partkey FROM part WHERE length(p_type) > 5 AND lower(substr(p_type, 1, 5)) = lower('ECONO')",
    "run_name": "SELECT id, coalesce('run ' || cast(ls AS string), 'tracked #' || cast(row_number() OVER (PARTITION BY game, category ORDER BY started_at_ms, id) AS string)) AS name FROM runs",
    "impossible_time": "SELECT id, value_ms, elapsed_ms, value_ms - elapsed_ms > 30000 AS refused FROM (SELECT id, coalesce(last_ms, final_ms) AS value_ms, started_at_ms - lag(started_at_ms) OVER (PARTITION BY session_id ORDER BY started_at_ms, id) AS elapsed_ms FROM runs) x WHERE value_ms IS NOT NULL AND elapsed_ms IS NOT NULL",
    "reference_sane": "SELECT session_id, wr, pb, season, sob, coalesce(wr <= pb, true) AND coalesce(pb <= season, true) AND coalesce(wr <= season, true) AND coalesce(sob < pb AND sob < season AND sob * 2 >= least(pb, season), true) AS sane FROM (SELECT session_id, min(CASE WHEN status = 'F' THEN price END) AS wr, min(CASE WHEN status = 'O' THEN price END) AS pb, max(CASE WHEN status = 'O' THEN price END) AS season, min(CASE WHEN status = 'P' THEN price END) AS sob FROM ord GROUP BY session_id) x",
    # joins
    "owned_sessions": "SELECT c.c_custkey AS session_id FROM customer c WHERE c.c_mktsegment = 'BUILDING' AND NOT EXISTS (SELECT 1 FROM ord o WHERE o.session_id = c.c_custkey AND o.status <> 'F')",
    # aggregations
    "published_day_stats": "SELECT day, count(*) AS attempts, count_if(outcome = 'finished') AS finished, min(final_ms) AS best_ms, min(ls) AS first_no, max(ls) AS last_no FROM runs WHERE game = 'game2' GROUP BY day",
    "day_span": "SELECT day, max(coalesce(started_at_ms + last_ms, 1800000000000)) - min(started_at_ms) AS span_ms FROM runs GROUP BY day",
    "run_through_totals": f"SELECT session_id, thread, count(DISTINCT game) AS games, max(last_ms) AS reached_ms, cast(sum(final_ms) AS bigint) AS segments_ms, count_if(outcome = 'finished') = count(*) AS complete FROM ({_THREADS}) t GROUP BY session_id, thread",
    "game_page": "SELECT game, category, count(*) AS pool, min(final_ms) AS best_ms, cast(sum(final_ms) AS bigint) DIV greatest(count(final_ms), 1) AS average_ms, count_if(outcome = 'finished') * 100 DIV count(*) AS rate_pct, max(ls) - min(ls) + 1 AS span FROM runs GROUP BY game, category",
    "run_vs_bests": "SELECT s.run_id, cast(sum(s.segment_ms) AS bigint) AS segments_ms, cast(sum(b.best_ms) AS bigint) AS bests_ms, max(o.price) - cast(sum(s.segment_ms) AS bigint) AS between_ms FROM splits s JOIN ord o ON o.id = s.run_id JOIN (SELECT act, min(segment_ms) AS best_ms FROM splits GROUP BY act) b ON b.act = s.act GROUP BY s.run_id",
    "shape_histogram": "SELECT concat(kind, CASE WHEN last_ms IS NULL THEN '/unread' ELSE '/read' END) AS shape, count(*) AS n FROM runs GROUP BY 1",
    "tracked_game": "SELECT game, count(*) AS n FROM runs GROUP BY game ORDER BY n DESC, game LIMIT 1",
    "audit_totals": "SELECT status, count(*) AS passes, count(DISTINCT session_id) AS broadcasts, count_if(price > 200000) AS wrong, cast(sum(price) AS bigint) AS total FROM ord GROUP BY status",
    "page_pb": "SELECT game, id, final_ms, final_ms < coalesce(prev, final_ms + 1) AND category <> 'cat2' AS is_pb FROM (SELECT *, min(CASE WHEN category <> 'cat2' THEN final_ms END) OVER (PARTITION BY game ORDER BY started_at_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM runs WHERE final_ms IS NOT NULL) x",
    # top-k
    "recent_sessions": "SELECT session_id, max(started_at_ms) AS last_ms, count(*) AS runs FROM runs GROUP BY session_id ORDER BY last_ms DESC, session_id DESC LIMIT 10",
    "title_walk": "SELECT r.session_id, r.id, r.ls FROM runs r JOIN (SELECT session_id, max(started_at_ms) AS moment FROM runs GROUP BY session_id ORDER BY moment DESC, session_id DESC LIMIT 40) s ON r.session_id = s.session_id WHERE r.kind = 'error' ORDER BY s.moment DESC, s.session_id DESC, r.started_at_ms DESC, r.id DESC LIMIT 1",
    "last_transition": "SELECT id, started_at_ms, kind, game FROM runs WHERE kind IN ('signup', 'purchase') ORDER BY started_at_ms DESC, id DESC LIMIT 1",
    "vote_winner": "SELECT game, ls, votes FROM (SELECT game, ls, votes, row_number() OVER (PARTITION BY game ORDER BY votes DESC, vouched DESC, ls DESC) AS k FROM (SELECT game, ls, count(*) AS votes, max(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) AS vouched FROM runs WHERE ls IS NOT NULL GROUP BY game, ls) a) b WHERE k = 1",
    "longest_of_third": "SELECT p_brand, p_name FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, n DESC, p_name) AS k FROM (SELECT p_brand, p_name, n, max(n) OVER (PARTITION BY p_brand) AS top FROM (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY p_brand, p_name) a) b WHERE n * 3 >= top) c WHERE k = 1",
    "worst_misreads": "SELECT id, error_ms FROM (SELECT id, (last_ms - p) - (started_at_ms - t) AS error_ms FROM (SELECT id, last_ms, started_at_ms, lag(last_ms) OVER (PARTITION BY session_id ORDER BY started_at_ms, id) AS p, lag(started_at_ms) OVER (PARTITION BY session_id ORDER BY started_at_ms, id) AS t FROM runs) x) y WHERE error_ms IS NOT NULL ORDER BY abs(error_ms) DESC, id LIMIT 10",
    "newest_events": "SELECT day, game, count(*) AS runs, min(started_at_ms) AS started_at_ms FROM runs GROUP BY day, game ORDER BY started_at_ms DESC",
    # set operations
    "reference_override": "SELECT label, value FROM (SELECT label, value, row_number() OVER (PARTITION BY label ORDER BY src DESC) AS k FROM (SELECT r_name AS label, r_regionkey AS value, 1 AS src FROM region UNION ALL SELECT r_name, r_regionkey + 100, 2 FROM region WHERE r_regionkey % 2 = 0) u) x WHERE k = 1",
    "practice_pool": "SELECT id, final_ms FROM runs WHERE category = 'cat0' AND final_ms IS NOT NULL UNION ALL SELECT id, final_ms FROM runs WHERE category = 'cat1' AND kind = 'purchase'",
    # scalars
    "format_pct": "SELECT id, cast(last_ms AS bigint) DIV 3600000 AS hours, ls * 100 DIV greatest(coalesce(ls, 1), 1) AS pct, concat(cast(last_ms DIV 60000 AS string), 'm') AS shown FROM runs WHERE last_ms IS NOT NULL",
    # merges
    "replace_pairs": "SELECT id, game, category, 'old' AS src FROM runs r WHERE id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT game, category, day FROM runs WHERE id % 2 = 1 AND kind = 'purchase') n WHERE n.game = r.game AND n.category = r.category AND n.day = r.day) UNION ALL SELECT id, game, category, 'new' FROM runs WHERE id % 2 = 1 AND kind = 'purchase'",
    "rebuild": "SELECT id, row_number() OVER (PARTITION BY game, category ORDER BY started_at_ms, id) AS attempt_number FROM (SELECT id, game, category, started_at_ms FROM runs WHERE id % 3 = 0 UNION ALL SELECT id, game, category, started_at_ms FROM runs r WHERE id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM runs v WHERE v.id % 30 = 0 AND v.day = r.day)) u",
    "import_numbered_gate": "SELECT day, count_if(id % 2 = 0) * 10 < count(*) * 9 OR count_if(id % 2 = 0 AND ls IS NOT NULL) * 10 < count(ls) * 9 AS refused FROM runs GROUP BY day",
    "void_latest": "SELECT id, outcome FROM runs WHERE id <> (SELECT max(id) FROM runs WHERE started_at_ms = (SELECT max(started_at_ms) FROM runs))",
    "correct_latest": "SELECT id, CASE WHEN id = (SELECT max(id) FROM runs WHERE started_at_ms = (SELECT max(started_at_ms) FROM runs)) THEN 'finished' ELSE outcome END AS outcome FROM runs",
    "upsert_setting": "SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY moment DESC) AS n FROM (SELECT n_name AS k, n_regionkey AS v, n_nationkey AS moment FROM nation UNION ALL SELECT n_name, n_regionkey + 10, n_nationkey + 1000 FROM nation WHERE n_nationkey % 2 = 0) u) x WHERE n = 1",
    "session_health": "SELECT c.c_custkey AS session_id, coalesce(h.frames, 0) AS frames FROM customer c LEFT JOIN (SELECT session_id, count(*) AS frames FROM ord GROUP BY session_id) h ON h.session_id = c.c_custkey",
    # supporting operators
    "roster_lookup": "SELECT n_name AS game, n_nationkey AS position, r_name AS event FROM (SELECT n.n_name, n.n_nationkey, r.r_name, row_number() OVER (PARTITION BY n.n_name ORDER BY r.r_regionkey) AS k FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey) x WHERE k = 1",
    "practice_categories": "SELECT r_name AS category FROM region UNION SELECT 'Practice' ORDER BY category",
    "race_goals": "SELECT n_name AS game, CASE WHEN n_regionkey = 1 THEN 'Any%' WHEN n_regionkey = 2 THEN '100%' END AS goal FROM nation WHERE n_regionkey IN (1, 2)",
    "number_for_key": "SELECT id, CASE WHEN game = p THEN ls END AS ls FROM (SELECT id, game, ls, lag(game) OVER (PARTITION BY session_id ORDER BY started_at_ms, id) AS p FROM runs) x",
    "dropped_closes": "SELECT id, CASE WHEN p IS NULL THEN 'orphaned' ELSE 'foreign' END AS reason FROM (SELECT id, kind, lag(kind) OVER (PARTITION BY session_id ORDER BY started_at_ms, id) AS p FROM runs) x WHERE kind = 'purchase' AND (p IS NULL OR p = 'error')",
    "total_refused": "SELECT id, last_ms, last_ms > top + 3600000 AS refused FROM (SELECT id, last_ms, max(last_ms) OVER (PARTITION BY game, day ORDER BY started_at_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM runs WHERE last_ms IS NOT NULL) x WHERE top IS NOT NULL",
    "board_completeness": "SELECT n_regionkey AS event, count_if(n_nationkey % 3 <> 0) AS done, count(*) AS size FROM nation GROUP BY n_regionkey",
    "stall_signals": "SELECT session_id, id, started_at_ms - p > 3600000 AS stalled, started_at_ms - p > 2700000 AND coalesce(last_ms = q, false) AS unmoved FROM (SELECT session_id, id, started_at_ms, last_ms, lag(started_at_ms) OVER (PARTITION BY session_id ORDER BY started_at_ms, id) AS p, lag(last_ms) OVER (PARTITION BY session_id ORDER BY started_at_ms, id) AS q FROM runs) x WHERE p IS NOT NULL",
    "live_flags": "SELECT count_if(kind = 'signup') > 0 AS capturing, min(CASE WHEN kind = 'signup' THEN started_at_ms END) AS session_started_at_ms, max(started_at_ms) AS last_started_at_ms FROM runs WHERE day = (SELECT max(day) FROM runs)",
    "never_cleared": "SELECT r.session_id, count(*) AS runs FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs c WHERE c.session_id = r.session_id AND c.kind = 'purchase') GROUP BY r.session_id",
    "distinct_pages": "SELECT DISTINCT game AS label, day FROM runs",
    "daily_digest": "SELECT day, count(*) AS attempts, count_if(outcome = 'finished') AS finished, min(final_ms) AS best_ms, count_if(outcome = 'reset' AND last_ms < 10000) AS act1, count_if(outcome = 'reset' AND last_ms >= 10000 AND last_ms < 30000) AS act2, max(ls) - min(ls) + 1 AS span, count(DISTINCT session_id) AS sessions FROM runs GROUP BY day",
    "compare_pass": "SELECT day, CASE WHEN new_finished < old_finished THEN 'lost' WHEN new_finished > old_finished THEN 'gain' ELSE 'none' END AS verdict FROM (SELECT day, count_if(outcome = 'finished' AND id % 2 = 0) AS old_finished, count_if(outcome = 'finished' AND id % 2 = 1) AS new_finished FROM runs GROUP BY day) x",
    "race_over": "SELECT id, started_at_ms >= 1704153600000 AS over_ FROM runs",
    "day_signature_diff": "SELECT coalesce(a.day, b.day) AS day, coalesce(a.game, b.game) AS game, a.n AS before_n, b.n AS after_n FROM (SELECT day, game, count(*) AS n FROM runs WHERE id % 7 <> 0 GROUP BY day, game) a FULL OUTER JOIN (SELECT day, game, count(*) AS n FROM runs WHERE id % 11 <> 0 GROUP BY day, game) b ON a.day = b.day AND a.game = b.game WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)",
}

_ENDS = "CASE act WHEN 0 THEN 30000 WHEN 1 THEN 60000 WHEN 2 THEN 90000 WHEN 3 THEN 120000 WHEN 4 THEN 150000 WHEN 5 THEN 180000 END"
APART: dict[str, tuple[str, str]] = {
    "touched_runs": (
        "SELECT r.id FROM runs r LEFT SEMI JOIN (SELECT game, category FROM runs WHERE kind = 'error' AND session_id < 20) t ON r.game = t.game AND r.category = t.category",
        "one AS (SELECT 1) SELECT id FROM runs WHERE (game, category) IN (SELECT game, category FROM runs WHERE kind = 'error' AND session_id < 20)",
    ),
    "closed_days": (
        "SELECT d.day, d.day < t.today AND d.open = 0 AS closed FROM (SELECT day, count_if(status = 'P') AS open FROM ord GROUP BY day) d CROSS JOIN (SELECT max(day) AS today FROM ord) t",
        "one AS (SELECT 1) SELECT DISTINCT day, day < (SELECT max(day) FROM ord) AND NOT EXISTS (SELECT 1 FROM ord o WHERE o.day = x.day AND o.status = 'P') AS closed FROM ord x",
    ),
    "split_plausible": (
        f"""SELECT run_id, act, cum FROM (SELECT *, max(act) OVER (PARTITION BY run_id) AS last, lag(cum) OVER (PARTITION BY run_id ORDER BY act) AS prev FROM (SELECT run_id, act, cast(sum(segment_ms) OVER (PARTITION BY run_id ORDER BY act) AS bigint) AS cum FROM splits) c) x
WHERE act < last AND cum <= 100000 + 5000 AND (prev IS NULL OR cum > prev) AND cum * 10 >= CASE WHEN act = 0 THEN 6 * {_ENDS} ELSE 9 * ({_ENDS.replace("CASE act", "CASE act - 1")}) END""",
        """acts AS (SELECT unnest(range(0, 6)) AS act, unnest(range(30000, 180001, 30000)) AS ending),
c AS (SELECT a.run_id, a.act, sum(b.segment_ms)::BIGINT AS cum FROM splits a JOIN splits b ON a.run_id = b.run_id AND b.act <= a.act GROUP BY a.run_id, a.act)
SELECT c.run_id, c.act, c.cum FROM c WHERE c.act < (SELECT max(act) FROM splits z WHERE z.run_id = c.run_id) AND c.cum <= 105000 AND NOT EXISTS (SELECT 1 FROM c p WHERE p.run_id = c.run_id AND p.act < c.act AND p.cum >= c.cum)
AND c.cum >= CASE WHEN c.act = 0 THEN 18000 ELSE (SELECT ending FROM acts WHERE acts.act = c.act - 1) * 0.9 END""",
    ),
    "now_playing_runs": (
        "SELECT DISTINCT session_id, id FROM (SELECT s.c_custkey AS session_id, o.id FROM customer s JOIN ord o ON o.session_id = s.c_custkey UNION ALL SELECT s.c_custkey, o.id FROM customer s JOIN ord o ON o.id % 1000 = s.c_custkey WHERE s.c_nationkey = 1) u",
        "one AS (SELECT 1) SELECT s.c_custkey AS session_id, o.id FROM customer s JOIN ord o ON o.session_id = s.c_custkey OR (o.id % 1000 = s.c_custkey AND s.c_nationkey = 1)",
    ),
    "splits_by_run": (
        "SELECT run_id, array_join(transform(array_sort(collect_list(struct(act, segment_ms))), x -> concat(x.act, ':', x.segment_ms)), ' ') AS splits FROM splits GROUP BY run_id",
        "one AS (SELECT 1) SELECT run_id, string_agg(act || ':' || segment_ms, ' ' ORDER BY act) AS splits FROM splits GROUP BY run_id",
    ),
    "nearest_completion": (
        "SELECT a.id, min(struct(abs(a.price - b.price) AS far, b.id)).id AS key_id FROM (SELECT *, explode(array(price DIV 2000 - 1, price DIV 2000, price DIV 2000 + 1)) AS k FROM ord WHERE status = 'F') a JOIN (SELECT *, price DIV 2000 AS k FROM ord WHERE status = 'O') b ON a.k = b.k AND a.day = b.day AND abs(a.price - b.price) <= 2000 GROUP BY a.id",
        "p AS (SELECT a.id, b.id AS key_id, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.price - b.price), b.id) AS k FROM ord a JOIN ord b ON a.status = 'F' AND b.status = 'O' AND a.day = b.day AND abs(a.price - b.price) <= 2000) SELECT id, key_id FROM p WHERE k = 1",
    ),
    "shown_elsewhere": (
        "SELECT id FROM runs LEFT SEMI JOIN (SELECT a.id AS k FROM (SELECT *, explode(array(last_ms DIV 2000 - 1, last_ms DIV 2000, last_ms DIV 2000 + 1)) AS b2 FROM runs WHERE last_ms IS NOT NULL) a JOIN (SELECT *, last_ms DIV 2000 AS b2 FROM runs WHERE last_ms IS NOT NULL) b ON a.b2 = b.b2 AND a.game = b.game AND a.day = b.day AND a.session_id <> b.session_id AND abs(a.last_ms - b.last_ms) <= 2000) m ON id = m.k",
        "one AS (SELECT 1) SELECT id FROM runs a WHERE EXISTS (SELECT 1 FROM runs b WHERE a.game = b.game AND a.day = b.day AND a.session_id <> b.session_id AND abs(a.last_ms - b.last_ms) <= 2000)",
    ),
    "days_listed": (
        "SELECT game, category, array_join(sort_array(collect_set(concat('''', day, ''''))), ',') AS days FROM runs WHERE kind = 'purchase' GROUP BY game, category",
        "one AS (SELECT 1) SELECT game, category, string_agg(DISTINCT '''' || day || '''', ',' ORDER BY '''' || day || '''') AS days FROM runs WHERE kind = 'purchase' GROUP BY game, category",
    ),
    "frame_interval": (
        "SELECT session_id, min_by(dt, struct(-n, dt)) AS interval_ms FROM (SELECT session_id, dt, count(*) AS n FROM (SELECT session_id, (started_at_ms - lag(started_at_ms) OVER (PARTITION BY session_id ORDER BY started_at_ms, id)) DIV 3600000 * 3600000 AS dt FROM runs) a WHERE dt IS NOT NULL GROUP BY session_id, dt) b GROUP BY session_id",
        "d AS (SELECT session_id, (started_at_ms - lag(started_at_ms) OVER (PARTITION BY session_id ORDER BY started_at_ms, id)) // 3600000 * 3600000 AS dt FROM runs), c AS (SELECT session_id, dt, count(*) AS n FROM d WHERE dt IS NOT NULL GROUP BY ALL) SELECT session_id, min(dt) AS interval_ms FROM c WHERE n = (SELECT max(n) FROM c z WHERE z.session_id = c.session_id) GROUP BY session_id",
    ),
    "source_union": (
        "SELECT id, 'live' AS src, price, cast(null AS bigint) AS probing FROM ord WHERE status = 'O' UNION ALL SELECT id, 'vod', price, id % 5 FROM ord WHERE status = 'F'",
        "a AS (SELECT id, 'live' AS src, price FROM ord WHERE status = 'O'), b AS (SELECT id, 'vod' AS src, price, id % 5 AS probing FROM ord WHERE status = 'F') SELECT * FROM a UNION ALL BY NAME SELECT * FROM b",
    ),
    "event_titles": (
        "SELECT session_id, element_at(ks, -1) AS last_kind, size(array_distinct(ks)) AS kinds, array_join(slice(ks, 1, 6), ',') AS first_six FROM (SELECT session_id, transform(array_sort(collect_list(struct(started_at_ms, id, kind))), x -> x.kind) AS ks FROM runs GROUP BY session_id) x",
        "k AS (SELECT session_id, list(kind ORDER BY started_at_ms, id) AS ks FROM runs GROUP BY session_id) SELECT session_id, ks[-1] AS last_kind, len(list_distinct(ks))::INT AS kinds, array_to_string(ks[1:6], ',') AS first_six FROM k",
    ),
    "live_run": (
        f"SELECT session_id, max(thread) AS thread, max_by(began, thread) AS started_at_ms, max_by(reached, thread) AS reached_ms, max_by(began, thread) >= max(first) OR coalesce(max_by(reached, thread) = max(board), false) AS live FROM (SELECT session_id, thread, min(started_at_ms) AS began, max(last_ms) AS reached FROM ({_THREADS}) t GROUP BY session_id, thread) g JOIN (SELECT session_id AS sid, min(started_at_ms) AS first, max(final_ms) AS board FROM runs WHERE kind = 'purchase' GROUP BY session_id) b ON g.session_id = b.sid GROUP BY session_id",
        f"t AS ({_THREADS}), g AS (SELECT session_id, thread::BIGINT AS thread, min(started_at_ms) AS began, max(last_ms) AS reached, row_number() OVER (PARTITION BY session_id ORDER BY thread DESC) AS k FROM t GROUP BY session_id, thread), b AS (SELECT session_id, min(started_at_ms) AS first, max(final_ms) AS board FROM runs WHERE kind = 'purchase' GROUP BY session_id) SELECT g.session_id, g.thread, g.began AS started_at_ms, g.reached AS reached_ms, g.began >= b.first OR coalesce(g.reached = b.board, false) AS live FROM g JOIN b USING (session_id) WHERE k = 1",
    ),
}
