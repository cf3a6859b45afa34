"""The catalogue of attempt-log queries over the driver's tables, with oracle SQL.

`events` stand in for runs: a user is a game and session, a purchase is a finish, the value is the
timer and props.k the counter. `lineitem` stands for splits (act = line number, segment = quantity).
A body is one statement for both engines; DIV is Spark's integer division and becomes // for DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolap.functions import names, text
from chronolap.plans import more, records
from chronolap.session import table
from chronolap.streaming import batch, runs, trackers

_RUNS = """SELECT event_id AS id, concat('game', cast(user_id % 7 AS string)) AS game, concat('cat', cast(user_id % 3 AS string)) AS category,
  user_id AS session_id, {ms} AS started_at_ms, {day} AS day, event_type AS kind,
  CASE WHEN event_type = 'purchase' THEN 'finished' ELSE 'reset' END AS outcome,
  CASE WHEN event_type = 'purchase' THEN cast(round(value * 1000) AS bigint) END AS final_ms,
  CASE WHEN event_type <> 'purchase' AND event_id % 11 <> 0 THEN cast(round(value * 1000) AS bigint) END AS last_ms,
  CASE WHEN event_id % 4 <> 0 THEN cast({k} AS bigint) END AS ls FROM {src}"""
_SPLITS = """SELECT l_orderkey AS run_id, cast(l_linenumber AS bigint) - 1 AS act, min(cast(l_quantity AS bigint)) * 1000 AS segment_ms FROM {src} GROUP BY l_orderkey, l_linenumber"""
_ORDERS = """SELECT o_orderkey AS id, o_custkey AS session_id, o_orderpriority AS game, o_orderstatus AS status, cast(round(o_totalprice) AS bigint) AS price, {ms2} AS started_at_ms, {day2} AS day FROM {src}"""

_SPARK = {"ms": "unix_millis(cast(ts AS timestamp))", "day": "date_format(ts, 'yyyy-MM-dd')", "k": "get_json_object(props, '$.k')", "ms2": "unix_millis(cast(o_orderdate AS timestamp))", "day2": "date_format(o_orderdate, 'yyyy-MM-dd')"}
_DUCK = {"ms": "(epoch_us(ts) // 1000)", "day": "strftime(ts, '%Y-%m-%d')", "k": "json_extract_string(props, '$.k')", "ms2": "(epoch_us(o_orderdate) // 1000)", "day2": "strftime(o_orderdate, '%Y-%m-%d')"}
_VIEWS = {"runs": (_RUNS, "events"), "splits": (_SPLITS, "lineitem"), "ord": (_ORDERS, "orders")}
_PLAIN = ("customer", "nation", "region", "supplier", "part")

BODIES: dict[str, str] = {
    "daily_stats": "SELECT day, count(*) AS attempts, count_if(outcome = 'finished') AS finished, count_if(outcome = 'reset') AS resets, min(final_ms) AS best_ms, min(id) AS first_no, max(id) AS last_no FROM runs WHERE game = 'game1' GROUP BY day",
    "today_stats": "SELECT count(*) AS attempts, count_if(outcome = 'finished') AS finished, count_if(outcome = 'reset') AS resets, min(final_ms) AS best_ms FROM runs WHERE day = (SELECT max(day) FROM runs)",
    "summaries": "SELECT game, category, count(*) AS attempts, count_if(outcome = 'finished') AS finished, min(final_ms) AS best_ms, min(started_at_ms) AS first_ms, max(started_at_ms) AS last_ms FROM runs GROUP BY game, category",
    "total_attempts": "SELECT count(*) AS attempts, count(*) + 1 AS next_ordinal, max(ls) AS max_counter FROM runs WHERE game = 'game2' AND category = 'cat1'",
    "next_ordinal": "SELECT game, category, count(*) + 1 AS next_ordinal, max(ls) AS max_counter FROM runs GROUP BY game, category",
    "known_categories": "SELECT category, count(*) AS n FROM runs GROUP BY category",
    "other_names": "SELECT DISTINCT game FROM runs WHERE NOT (game = 'game1' AND category = 'cat1')",
    "having_min3": "SELECT session_id, day, count(*) AS n FROM runs GROUP BY session_id, day HAVING count(*) >= 3",
    "distinct_games": "SELECT day, count(DISTINCT game) AS games, count(DISTINCT session_id) AS sessions FROM runs GROUP BY day",
    "session_summary": "SELECT c.c_custkey AS session_id, coalesce(o.runs, 0) AS runs, coalesce(o.finished, 0) AS finished, o.best AS best FROM customer c LEFT JOIN (SELECT session_id, count(*) AS runs, count_if(status = 'F') AS finished, min(CASE WHEN status = 'F' THEN price END) AS best FROM ord WHERE price > 1000 GROUP BY session_id) o ON c.c_custkey = o.session_id",
    "splits_with_run": "SELECT s.run_id, s.act, s.segment_ms, o.session_id, o.day FROM splits s JOIN ord o ON s.run_id = o.id WHERE o.status = 'F'",
    "other_runs_left": "SELECT o.id, o.day, c.c_mktsegment AS tag FROM ord o LEFT JOIN customer c ON o.session_id = c.c_custkey AND c.c_acctbal > 0 WHERE NOT (o.status = 'F')",
    "close_stale": "SELECT c.c_custkey AS session_id, coalesce(max(o.started_at_ms), 0) AS ended_at_ms FROM customer c LEFT JOIN ord o ON c.c_custkey = o.session_id GROUP BY c.c_custkey",
    "personal_best": "SELECT id, final_ms FROM runs WHERE final_ms IS NOT NULL AND game = 'game1' ORDER BY final_ms, id LIMIT 1",
    "last_run": "SELECT id, outcome, started_at_ms FROM runs ORDER BY started_at_ms DESC, id DESC LIMIT 1",
    "previous_time": "SELECT id, final_ms FROM runs WHERE final_ms IS NOT NULL AND started_at_ms < (SELECT max(started_at_ms) FROM runs) ORDER BY started_at_ms DESC, id DESC LIMIT 1",
    "recent_15": "SELECT id, game, category, outcome FROM runs ORDER BY started_at_ms DESC, id DESC LIMIT 15",
    "top_day_best": "SELECT day, id, final_ms FROM (SELECT day, id, final_ms, row_number() OVER (PARTITION BY day ORDER BY final_ms, id) AS rn FROM runs WHERE final_ms IS NOT NULL) x WHERE rn <= 12",
    "sum_of_best": "SELECT count(*) AS acts, CASE WHEN count(*) = 7 THEN cast(sum(gold) AS bigint) END AS sum_of_best FROM (SELECT act, min(segment_ms) AS gold FROM splits GROUP BY act) x",
    "segment_from_cumulative": "SELECT run_id, act, CASE WHEN act = 0 THEN cum WHEN prev_act = act - 1 THEN cum - prev_cum END AS segment_ms FROM (SELECT run_id, act, cum, lag(act) OVER (PARTITION BY run_id ORDER BY act) AS prev_act, lag(cum) OVER (PARTITION BY run_id ORDER BY act) AS prev_cum FROM (SELECT run_id, act, cast(sum(segment_ms) OVER (PARTITION BY run_id ORDER BY act) AS bigint) AS cum FROM splits) c WHERE (run_id + act) % 5 <> 0) x",
    "renumber": "SELECT id, game, category, row_number() OVER (PARTITION BY game, category ORDER BY started_at_ms, id) AS attempt_number FROM runs",
    "collision_ids": "SELECT id, started_at_ms DIV 60000 * 60000 + row_number() OVER (PARTITION BY started_at_ms DIV 60000 ORDER BY id) - 1 AS published_id FROM runs",
    "day_slug": "SELECT id, CASE WHEN n = 1 THEN day ELSE concat(day, '-', cast(n AS string)) END AS slug FROM (SELECT id, day, row_number() OVER (PARTITION BY game, day ORDER BY started_at_ms, id) AS n FROM runs) x",
    "counter_outliers": "SELECT id, ls FROM (SELECT id, ls, lag(ls) OVER (PARTITION BY game, category ORDER BY started_at_ms, id) AS p, lead(ls) OVER (PARTITION BY game, category ORDER BY started_at_ms, id) AS n FROM runs WHERE ls IS NOT NULL) x WHERE p < n AND NOT (p < ls AND ls < n)",
    "coverage": "SELECT day, count(*) AS attempts, max(ls) - min(ls) + 1 AS span FROM runs GROUP BY day",
    "overlap_anti": "SELECT a.id FROM runs a WHERE a.kind = 'signup' AND NOT EXISTS (SELECT 1 FROM runs b WHERE b.kind = 'error' AND b.game = a.game AND b.started_at_ms < a.started_at_ms + 600000 AND b.started_at_ms + coalesce(b.last_ms, 0) > a.started_at_ms)",
    "session_runs": "SELECT game, cast(max(grp) AS bigint) AS groups FROM (SELECT game, sum(edge) OVER (PARTITION BY game ORDER BY started_at_ms, id ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT *, CASE WHEN session_id = lag(session_id) OVER (PARTITION BY game ORDER BY started_at_ms, id) THEN 0 ELSE 1 END AS edge FROM runs) a) b GROUP BY game",
    "event_matrix": "SELECT game, min(CASE WHEN category = 'cat0' THEN final_ms END) AS c0, min(CASE WHEN category = 'cat1' THEN final_ms END) AS c1, min(CASE WHEN category = 'cat2' THEN final_ms END) AS c2 FROM runs GROUP BY game",
    "row_best": "SELECT game, CASE WHEN count(final_ms) >= 2 THEN min(final_ms) END AS best, cast(sum(CASE WHEN final_ms IS NULL THEN 1 ELSE 0 END) AS bigint) AS gaps FROM runs GROUP BY game",
    "staircase": "SELECT act, best, CASE WHEN holes = 0 THEN total END AS stair FROM (SELECT act, best, cast(sum(best) OVER (ORDER BY act) AS bigint) AS total, cast(sum(CASE WHEN best IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY act) AS bigint) AS holes FROM (SELECT act, min(CASE WHEN segment_ms > 1000 THEN segment_ms END) AS best FROM splits GROUP BY act) a) b",
    "transition_gap": "SELECT run_id, act, cum - segment_ms - lag(cum) OVER (PARTITION BY run_id ORDER BY act) AS gap_ms FROM (SELECT run_id, act, segment_ms, cast(sum(segment_ms + 500) OVER (PARTITION BY run_id ORDER BY act) AS bigint) AS cum FROM splits) x",
    "final_act_normalise": "SELECT s.run_id, s.act, CASE WHEN s.act = s.top THEN o.price ELSE s.segment_ms END AS segment_ms FROM (SELECT *, max(act) OVER (PARTITION BY run_id) AS top FROM splits) s JOIN ord o ON o.id = s.run_id WHERE o.status = 'F' OR s.act < s.top",
    "replace_day": "SELECT id, day, price FROM ord o WHERE NOT EXISTS (SELECT 1 FROM ord n WHERE n.status = 'F' AND n.day = o.day) UNION ALL SELECT id, day, price FROM ord WHERE status = 'F'",
    "merge_splits_gain": "SELECT o.id, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS splits, coalesce(b.n, 0) > coalesce(a.n, 0) AS gained FROM ord o LEFT JOIN (SELECT run_id, count(*) AS n FROM splits WHERE act % 2 = 0 GROUP BY run_id) a ON a.run_id = o.id LEFT JOIN (SELECT run_id, count(*) AS n FROM splits WHERE act % 2 = 1 OR segment_ms > 20000 GROUP BY run_id) b ON b.run_id = o.id",
    "import_gate": "SELECT day, count_if(outcome = 'finished') AS new_runs, count(*) AS old_runs, count_if(outcome = 'finished') * 10 < count(*) * 9 AS refused FROM runs GROUP BY day",
    "ref_merge": "SELECT label, value FROM (SELECT label, value, row_number() OVER (PARTITION BY label ORDER BY src) AS rn FROM (SELECT n_name AS label, n_nationkey AS value, 1 AS src FROM nation WHERE n_regionkey < 3 UNION ALL SELECT n_name, n_nationkey + 100, 2 FROM nation) u) x WHERE rn = 1",
    "touched_pairs": "SELECT game, category FROM runs WHERE kind = 'error' UNION SELECT game, category FROM runs WHERE kind = 'click'",
    "json_events": "SELECT ls AS k, count(*) AS n FROM runs WHERE ls IS NOT NULL GROUP BY ls",
    "asof_clock": "SELECT id, CASE WHEN started_at_ms - seen <= 3600000 THEN timer END AS total_ms FROM (SELECT id, kind, started_at_ms, last_value(CASE WHEN kind = 'view' THEN started_at_ms END) IGNORE NULLS OVER (PARTITION BY game ORDER BY started_at_ms, CASE WHEN kind = 'view' THEN 0 ELSE 1 END, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen, last_value(CASE WHEN kind = 'view' THEN coalesce(last_ms, -1) END) IGNORE NULLS OVER (PARTITION BY game ORDER BY started_at_ms, CASE WHEN kind = 'view' THEN 0 ELSE 1 END, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS timer FROM runs) x WHERE kind = 'click'",
    "log_diff": "SELECT count_if(b.id IS NULL) AS only_a, count_if(a.id IS NULL) AS only_b, count_if(a.last_ms <> b.last_ms) AS differ FROM (SELECT id, last_ms FROM runs WHERE id % 3 <> 0) a FULL OUTER JOIN (SELECT id, last_ms + id % 2 AS last_ms FROM runs WHERE id % 5 <> 0) b ON a.id = b.id",
    "misread_rate": "SELECT kind, count(*) AS pairs, count_if(abs((last_ms - p) - (started_at_ms - t)) > 60) AS misread FROM (SELECT kind, last_ms, started_at_ms, lag(last_ms) OVER (PARTITION BY session_id ORDER BY started_at_ms, id) AS p, lag(started_at_ms) OVER (PARTITION BY session_id ORDER BY started_at_ms, id) AS t FROM runs) x WHERE last_ms IS NOT NULL AND p IS NOT NULL GROUP BY kind",
    "settled_values": "SELECT game, ls, count(*) AS votes, max(started_at_ms) - min(started_at_ms) AS span_ms FROM runs WHERE ls IS NOT NULL GROUP BY game, ls HAVING count(*) >= 2 AND max(started_at_ms) - min(started_at_ms) >= 45000",
    "name_consensus": "SELECT game, kind FROM (SELECT game, kind, row_number() OVER (PARTITION BY game ORDER BY n DESC, kind) AS rn FROM (SELECT game, kind, count(*) AS n FROM runs GROUP BY game, kind) a) b WHERE rn = 1",
    "identity_tally": "SELECT session_id, count_if(kind = 'error') AS convicting, count_if(kind = 'purchase') AS clear_reads, count_if(kind NOT IN ('error', 'purchase')) AS silent FROM runs GROUP BY session_id",
    "plausibility_floor": "SELECT game, min(best DIV 2) AS floor_ms FROM (SELECT game, category, min(final_ms) AS best FROM runs GROUP BY game, category) x WHERE best IS NOT NULL GROUP BY game",
    "capture_health": "SELECT day, cast(sum(ls) AS bigint) AS frames, cast(sum(CASE WHEN last_ms IS NOT NULL THEN ls ELSE 0 END) AS bigint) AS parsed, cast(sum(CASE WHEN last_ms IS NOT NULL THEN ls ELSE 0 END) * 100 AS bigint) DIV cast(sum(ls) AS bigint) AS pct FROM runs GROUP BY day",
    "roster_region": "SELECT r.r_name AS event, count(*) AS games, min(n.n_name) AS first_game FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
    "restart_keep": "SELECT game, id FROM (SELECT game, id, started_at_ms - coalesce(last_ms, 0) AS base, max(started_at_ms - coalesce(last_ms, 0)) OVER (PARTITION BY game) AS top FROM runs) x WHERE base >= top - 1800000",
}


def _relational(body: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        args = {v: spark.sql(sql.format(src="{t}", **_SPARK), t=table(spark, sf_dir, name)) for v, (sql, name) in _VIEWS.items() if re.search(rf"\b{v}\b", body)}
        args |= {t: table(spark, sf_dir, t) for t in _PLAIN if f" {t} " in f"{body} "}
        out = body
        for v in args:
            out = re.sub(rf"\b(FROM|JOIN) {v}\b", rf"\1 {{{v}}}", out)
        return spark.sql(out, **args)

    return run


def _oracle(body: str) -> str:
    views = ", ".join(f"{v} AS ({sql.format(src=name, **_DUCK)})" for v, (sql, name) in _VIEWS.items() if f" {v}" in body)
    body = re.sub(r"_value\((ls|mark|CASE.*?END)\) IGNORE NULLS", r"_value(\1 IGNORE NULLS)", body)
    return ((f"WITH {views} " if views else "") + body).replace(" DIV ", " // ").replace("AS string)", "AS varchar)")


def _apart(body: str) -> str:
    """An oracle of its own, with the views it reads in front."""
    views = ", ".join(f"{v} AS ({sql.format(src=name, **_DUCK)})" for v, (sql, name) in _VIEWS.items() if re.search(rf"\b{v}\b", body))
    return f"WITH {views}, {body}" if views else f"WITH {body}"


BODIES |= more.SAME
QUERIES = {k: _relational(b) for k, b in (BODIES | records.SPARK | {k: b for k, (b, _) in more.APART.items()}).items()}
ORACLE = {k: _oracle(b) for k, b in BODIES.items()} | {k: _apart(b) for k, b in (records.DUCK | {k: b for k, (_, b) in more.APART.items()}).items()}


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 7919 % 9000000).alias("ms"))
    return p.select("p_partkey", "ms", text.format_ms(F.col("ms")).alias("shown"))


QUERIES |= {
    "format_ms": _timed,
    "parse_time": lambda s, d: _timed(s, d).select("p_partkey", text.parse_time(F.col("shown")).alias("ms")),
    "slug": lambda s, d: table(s, d, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug")),
    "normalise_title": lambda s, d: table(s, d, "documents").select("doc_id", text.normalise_title(F.col("text")).alias("title")),
    "edit_close": lambda s, d: table(s, d, "part").select("p_partkey", text.edit_close(F.col("p_brand"), F.lit("Brand#23")).alias("near")),
    "day_feed_hash": lambda s, d: _relational("SELECT day, id, outcome, final_ms FROM runs")(s, d).groupBy("day").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("id", "outcome", "final_ms")))), 256).alias("sha256"), F.count("*").alias("runs")),
    "monotone_gate": lambda s, d: batch.clock_gate(_relational("SELECT session_id, started_at_ms AS t_ms, id, last_ms AS value FROM runs")(s, d)),
    "smoother": lambda s, d: batch.smoother(_relational("SELECT session_id, started_at_ms AS t_ms, id, last_ms AS value FROM runs")(s, d)),
    "identity_gate": lambda s, d: batch.identity_gate(_relational("SELECT session_id, started_at_ms AS t_ms, id, CASE WHEN kind = 'error' THEN 'convicting' WHEN kind = 'purchase' THEN 'clear' ELSE 'silent' END AS verdict FROM runs")(s, d)),
    "counter_fold": lambda s, d: trackers.attempt_counter(_relational("SELECT session_id, started_at_ms AS t_ms, id, 100 + count_if(kind = 'purchase') OVER (PARTITION BY session_id ORDER BY started_at_ms, id) AS value, kind = 'purchase' AS started FROM runs")(s, d)),
    "confirmed_reference": lambda s, d: batch.confirmed(_relational("SELECT session_id, started_at_ms AS t_ms, id, ls % 3 AS value FROM runs")(s, d)),
}
ORACLE |= {
    "format_ms": "SELECT p_partkey, ms, (CASE WHEN ms >= 3600000 THEN printf('%d:%02d:', ms // 3600000, ms // 60000 % 60) ELSE printf('%d:', ms // 60000) END) || printf('%02d.%d', ms // 1000 % 60, ms // 100 % 10) AS shown FROM (SELECT p_partkey, p_partkey * 7919 % 9000000 AS ms FROM part)",
    "parse_time": "SELECT p_partkey, p_partkey * 7919 % 9000000 // 100 * 100 AS ms FROM part",
    "slug": "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part",
    "normalise_title": "SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS title FROM documents",
    "edit_close": "SELECT p_partkey, levenshtein(p_brand, 'Brand#23') * 5 <= greatest(length(p_brand), 8) AS near FROM part",
}


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timer for each session, made of the order of its events: up to 70 s, standing, then from zero again; errors are unread."""
    body = "SELECT session_id, id, 1000 * row_number() OVER (PARTITION BY session_id ORDER BY started_at_ms, id) AS t_ms, kind FROM runs"
    r = _relational(body)(spark, sf_dir)
    return r.select("session_id", "t_ms", "id", F.when(F.col("kind") != "error", F.least(F.expr("t_ms div 1000 % 97"), F.lit(70)) * 1000).alias("value"))


def _boards(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows of boards with damaged nation names, and the nations of each region as a roster."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    roster = nation.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("event"), F.col("n_nationkey").alias("position"), F.col("n_name").alias("game"), F.lit(None).cast("string").alias("board"))
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    board = F.expr("s_suppkey div 8").alias("board")
    return s.select(board, (F.col("s_suppkey") % 8).alias("position"), F.when(F.col("s_suppkey") % 3 == 0, F.expr("substr(n_name, 2)")).otherwise(F.col("n_name")).alias("name")), roster


def _formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.col("ms")
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 7919 % 9000000).alias("ms"))
    return p.select("p_partkey", text.format_seconds(ms).alias("whole"), text.format_rounded(ms).alias("rounded"), text.format_tenths(ms).alias("tenths"), text.format_feed(ms).alias("feed"), text.build_stamp(ms * 1000).alias("stamp"), text.local_day(ms * 10000).alias("day"))


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times without their point, with a stray digit, or with the point for the colon."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 7919 % 3600000).alias("ms"))
    m, s, c = (F.expr(x) for x in ("ms div 60000", "ms div 1000 % 60", "ms div 10 % 100"))
    joined, gap, point = F.format_string("%d:%02d%02d", m, s, c), F.format_string("%d:%02d %02d", m, s, c), F.format_string("%d.%02d", m, s)
    return p.select("p_partkey", text.parse_timer(joined).alias("joined_ms"), text.parse_timer(gap).alias("gap_ms"), text.parse_total(point).alias("total_ms"), text.time_shaped(point).alias("shaped"), text.has_fraction(joined).alias("fraction"), text.parse_counter(F.concat(F.col("p_partkey").cast("string"), F.lit("."))).alias("counter"))


QUERIES |= {
    "formats": _formats,
    "repaired_times": _damaged,
    "game_matches": lambda s, d: table(s, d, "part").select("p_partkey", text.game_matches(F.col("p_name"), F.col("p_type")).alias("same"), text.game_matches(F.col("p_brand"), F.lit("brand-32")).alias("near")),
    "run_tracker": lambda s, d: runs.run_events(_readings(s, d)),
    "tracked_runs": lambda s, d: runs.run_rows(runs.run_events(_readings(s, d)), _readings(s, d)),
    "split_tracker": lambda s, d: trackers.split_passes(_relational("SELECT run_id, act, segment_ms FROM splits")(s, d)),
    "roster_assign": lambda s, d: names.resolve_boards(*_boards(s, d)),
    "resolve_names": lambda s, d: names.resolve(*_boards(s, d)),
}
_HMS = "CASE WHEN {s} >= 3600 THEN printf('%d:%02d:%02d', {s} // 3600, {s} // 60 % 60, {s} % 60) ELSE printf('%d:%02d', {s} // 60, {s} % 60) END"
_FOLD = "lower(regexp_replace({c}, '[^A-Za-z0-9]', '', 'g'))"
_LIKE = "{a} <> '' AND {b} <> '' AND (contains({a}, {b}) OR contains({b}, {a}) OR levenshtein({a}, {b}) * 5 <= greatest(length({a}), length({b})))"
ORACLE |= {
    "formats": f"SELECT p_partkey, {_HMS.format(s='(ms // 1000)')} AS whole, {_HMS.format(s='((ms + 500) // 1000)')} AS rounded, ({_HMS.format(s='(ms // 1000)')}) || '.' || (ms // 100 % 10) AS tenths, CASE WHEN (ms + 50) // 100 >= 600 THEN printf('%d:%02d.%d', (ms + 50) // 60000, (ms + 50) // 1000 % 60, (ms + 50) // 100 % 10) ELSE printf('%d.%d', (ms + 50) // 1000, (ms + 50) // 100 % 10) END AS feed, strftime(make_timestamp(ms * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp, strftime(make_timestamp(ms * 10000000), '%Y-%m-%d') AS day FROM (SELECT p_partkey, p_partkey * 7919 % 9000000 AS ms FROM part)",
    "repaired_times": "SELECT p_partkey, ms // 10 * 10 AS joined_ms, ms // 10 * 10 AS gap_ms, CASE WHEN ms >= 60000 THEN ms // 1000 * 1000 END AS total_ms, ms // 60000 < 60 AS shaped, false AS fraction, p_partkey AS counter FROM (SELECT p_partkey, p_partkey * 7919 % 3600000 AS ms FROM part)",
    "game_matches": f"SELECT p_partkey, {_LIKE.format(a=_FOLD.format(c='p_name'), b=_FOLD.format(c='p_type'))} AS same, {_LIKE.format(a=_FOLD.format(c='p_brand'), b=chr(39) + 'brand32' + chr(39))} AS near FROM part",
}
