"""Statistics, filters and limits over reports and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from passgrid.operators import rows, stats
from passgrid.plans.base import Book
from passgrid.sources import views
from passgrid.sources.views import with_views

BOOK = Book()
R, S = views.reports, views.sessions
add = BOOK.add

BUCKET = "CASE WHEN risk_score IS NULL THEN 'Unknown' WHEN risk_score <= 25 THEN '0-25 (low)' WHEN risk_score <= 55 THEN '26-55 (watch)' ELSE '56-100 (critical)' END"
PUBLIC = "CASE WHEN adjudication = 'CONFIRMED_FRAUD' THEN 'PROVEN_FAKE' WHEN adjudication = 'CLEARED' THEN 'AUTHENTIC' WHEN verdict = 'CLEAR' THEN 'AUTHENTIC' WHEN verdict = 'FLAGGED' OR adjudication = 'INCONCLUSIVE' THEN 'PROVEN_FAKE' ELSE 'UNSIGNED' END"
MODULE = "CASE WHEN NOT json_valid(modules) THEN 'N/A' ELSE coalesce(nullif(coalesce(json_extract_string(modules, '$.{m}.verdict'), json_extract_string(modules, '$.{m}')), ''), 'N/A') END"
HOUR = "hour(created_at + INTERVAL 330 MINUTE)"

add("a1_newest_reports", lambda s, d: rows.newest(R(s, d), 200, ["created_at", "id"]).select("id", "created_at", "verdict"),
    with_views("SELECT id, created_at, verdict FROM reports ORDER BY created_at DESC, id DESC LIMIT 200", "reports"))
add("a2_tolerant_json",
    lambda s, d: R(s, d).select("id", F.try_variant_get(F.try_parse_json("ai_detection"), "$.ai_score", "int").alias("ai_score"), F.try_parse_json("ai_detection").isNotNull().alias("readable")),
    with_views("SELECT id, CASE WHEN json_valid(ai_detection) THEN CAST(json_extract_string(ai_detection, '$.ai_score') AS INTEGER) END AS ai_score, json_valid(ai_detection) AS readable FROM reports", "reports"))
add("a3_module_verdicts", lambda s, d: R(s, d).select("id", *[stats.module_verdict(F.col("modules"), m).alias(m) for m in ("validation", "tampering", "face")]),
    with_views("SELECT id, " + ", ".join(f"{MODULE.format(m=m)} AS {m}" for m in ("validation", "tampering", "face")) + " FROM reports", "reports"))
add("b4_risk_grade", lambda s, d: R(s, d).select("id", views.grade(F.col("risk_score"), F.col("id") % 50 == 0, F.col("id") % 3 != 0).alias("grade")),
    with_views("SELECT id, CASE WHEN id % 50 = 0 OR risk_score > 55 THEN 'FLAGGED' WHEN id % 3 = 0 OR risk_score > 25 THEN 'REVIEW' ELSE 'CLEAR' END AS grade FROM reports", "reports"))
add("b5_risk_bucket", lambda s, d: R(s, d).select("id", stats.risk_bucket(F.col("risk_score")).alias("bucket")), with_views(f"SELECT id, {BUCKET} AS bucket FROM reports", "reports"))
add("b20_row_scope", lambda s, d: rows.visible_to(R(s, d), "officer7", "officer").select("id", "screener"), with_views("SELECT id, screener FROM reports WHERE screener = 'officer7'", "reports"))
add("b21_pending_review", lambda s, d: rows.pending(R(s, d)).select("id", "verdict"), with_views("SELECT id, verdict FROM reports WHERE adjudication IS NULL AND verdict <> 'CLEAR'", "reports"))
add("b22_soft_delete",
    lambda s, d: rows.not_removed(R(s, d)).groupBy("session_id").agg(F.count("*").alias("n")),
    with_views("SELECT session_id, count(*) AS n FROM reports WHERE removed = 0 GROUP BY 1", "reports"))
add("b23_public_verdict",
    lambda s, d: R(s, d).select("id", stats.public_verdict(F.col("verdict"), F.col("adjudication")).alias("kind")),
    with_views(f"SELECT id, {PUBLIC} AS kind FROM reports", "reports"))
add("b24_ledger_search",
    lambda s, d: rows.search(R(s, d), ["name", "checkpoint", "screener"], "r1", {"verdict": "FLAGGED"}, "HIGH").select("id", "name", "risk_score"),
    with_views("SELECT id, name, risk_score FROM reports WHERE (contains(lower(name), 'r1') OR contains(lower(checkpoint), 'r1') OR contains(lower(screener), 'r1')) AND verdict = 'FLAGGED' AND risk_score >= 60", "reports"))
add("g1_verdict_funnel", lambda s, d: stats.verdict_funnel(R(s, d)), with_views("SELECT upper(coalesce(verdict, 'UNKNOWN')) AS verdict, count(*) AS n FROM reports GROUP BY 1", "reports"))
add("g2_risk_histogram", lambda s, d: stats.risk_histogram(R(s, d)), with_views(f"SELECT {BUCKET} AS bucket, count(*) AS n FROM reports GROUP BY 1", "reports"))
add("g3_by_doc_type",
    lambda s, d: stats.by_doc_type(R(s, d)),
    with_views("SELECT doc_type, count(*) AS n, count(*) FILTER (verdict = 'FLAGGED') AS flagged, round(avg(risk_score), 1) AS avg_risk FROM reports GROUP BY 1", "reports"))
add("g4_by_checkpoint_officer",
    lambda s, d: stats.by_checkpoint_and_officer(R(s, d)),
    with_views("SELECT checkpoint, screener, count(*) AS n, count(*) FILTER (verdict = 'FLAGGED') AS flagged FROM reports GROUP BY GROUPING SETS ((checkpoint), (screener), ())", "reports"))
add("g5_module_counts", lambda s, d: stats.module_counts(R(s, d)),
    with_views(" UNION ALL ".join(f"SELECT '{m}' AS module, {MODULE.format(m=m)} AS verdict, count(*) AS n FROM reports GROUP BY 2" for m in ("validation", "tampering", "face")), "reports"))
AI_SQL = """WITH a AS (SELECT CASE WHEN json_valid(ai_detection) THEN ai_detection ELSE '{}' END AS j FROM reports), b AS (SELECT coalesce(CAST(json_extract_string(j, '$.ran') AS BOOLEAN), false) AS ran, coalesce(CAST(json_extract_string(j, '$.ai_suspected') AS BOOLEAN), false) AS sus, coalesce(CAST(json_extract_string(j, '$.ai_score') AS DOUBLE), 0) AS sc FROM a)
        SELECT count(*) FILTER (ran) AS ran, count(*) FILTER (ran AND sus) AS suspected, sum(sc) FILTER (ran) AS score_sum, round(count(*) FILTER (ran AND sus) / greatest(1, count(*) FILTER (ran)), 3) AS suspicion_rate FROM b"""
LATENCY_SQL = """WITH l AS (SELECT list_sort(list(latency_ms)) AS v, count(*) AS n, sum(latency_ms) AS s FROM reports WHERE latency_ms > 0)
        SELECT CAST(v[1] AS BIGINT) AS min, CAST(v[n] AS BIGINT) AS max, CAST(s AS BIGINT) AS sum, CAST(floor(s / n) AS BIGINT) AS avg, CAST(v[n // 2 + 1] AS BIGINT) AS p50, CAST(v[CAST(floor(n * 0.95::DOUBLE) AS BIGINT)] AS BIGINT) AS p95 FROM l"""
THROUGHPUT_SQL = """SELECT 1440 AS window_minutes, (SELECT count(*) FROM reports WHERE epoch(created_at) >= (SELECT max(epoch(created_at)) FROM reports) - 86400) AS screens,
        (SELECT count(*) FROM sessions WHERE epoch(closed_at) >= (SELECT max(epoch(created_at)) FROM reports) - 86400) AS sessions_closed,
        round((SELECT count(*) FROM reports WHERE epoch(created_at) >= (SELECT max(epoch(created_at)) FROM reports) - 86400) / 1440, 3) AS per_minute"""
add("g6_ai_summary", lambda s, d: stats.ai_summary(R(s, d)),
    with_views(AI_SQL, "reports"))
add("g7_latency_summary", lambda s, d: stats.latency_summary(R(s, d)),
    with_views(LATENCY_SQL, "reports"))
add("g8_hourly_local",
    lambda s, d: stats.hourly_local(R(s, d)),
    with_views(f"SELECT CAST(h AS INTEGER) AS hour, coalesce(n, 0) AS n FROM range(24) t(h) LEFT JOIN (SELECT {HOUR} AS hh, count(*) AS n FROM reports GROUP BY 1) ON hh = h", "reports"))
add("g9_daily", lambda s, d: stats.daily(R(s, d)), with_views("SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM reports GROUP BY 1", "reports"))
SESSION_SUMMARY = """SELECT 'status' AS metric, status AS key, CAST(count(*) AS DOUBLE) AS value FROM sessions GROUP BY 2
    UNION ALL SELECT 'verdict', upper(coalesce(verdict, 'PENDING')), count(*) FROM sessions GROUP BY 2 UNION ALL SELECT 'checkpoint', checkpoint, count(*) FROM sessions GROUP BY 2
    UNION ALL SELECT 'total', 'cleared', count(*) FILTER (verdict = 'CLEAR') FROM sessions UNION ALL SELECT 'total', 'flagged', count(*) FILTER (verdict IN ('FLAGGED', 'REVIEW')) FROM sessions
    UNION ALL SELECT 'total', 'avg_session_risk', round(avg(risk_score), 1) FROM sessions UNION ALL SELECT 'total', 'total_sessions', count(*) FROM sessions"""
add("g10_session_summary", lambda s, d: stats.session_summary(S(s, d)), with_views(SESSION_SUMMARY, "sessions"))
add("g11_throughput", lambda s, d: stats.throughput(R(s, d), S(s, d), 60 * 24),
    with_views(THROUGHPUT_SQL, "sessions"))
_unpivoted = lambda metric, sql, names: " UNION ALL ".join(f"SELECT '{metric}', '{n}', CAST({n} AS DOUBLE) FROM ({sql})" for n in names)
_MODULES = " UNION ALL ".join(f"SELECT 'module_{m}', {MODULE.format(m=m)}, count(*) FROM reports GROUP BY 2" for m in ("validation", "tampering", "face"))
add("g12_overview", lambda s, d: stats.overview(R(s, d), S(s, d), 60 * 24),
    with_views(f"""SELECT 'verdict' AS metric, verdict AS key, CAST(count(*) AS DOUBLE) AS value FROM reports GROUP BY 2 UNION ALL SELECT 'risk', {BUCKET}, count(*) FROM reports GROUP BY 2
        UNION ALL SELECT 'doc_type', doc_type, count(*) FROM reports GROUP BY 2 UNION ALL SELECT 'day', strftime(created_at, '%Y-%m-%d'), count(*) FROM reports GROUP BY 2
        UNION ALL SELECT 'hour', CAST(h AS VARCHAR), coalesce(n, 0) FROM range(24) t(h) LEFT JOIN (SELECT {HOUR} AS hh, count(*) AS n FROM reports GROUP BY 1) ON hh = h
        UNION ALL SELECT 'checkpoint', checkpoint, count(*) FROM reports GROUP BY 2 UNION ALL SELECT 'officer', screener, count(*) FROM reports GROUP BY 2 UNION ALL {_MODULES}
        UNION ALL SELECT 'total', 'total_screens', count(*) FROM reports UNION ALL SELECT 'total', 'flagged_count', count(*) FROM reports WHERE verdict = 'FLAGGED'
        UNION ALL {_unpivoted('ai', AI_SQL, ['ran', 'suspected', 'score_sum', 'suspicion_rate'])} UNION ALL {_unpivoted('latency', LATENCY_SQL, ['min', 'max', 'sum', 'avg', 'p50', 'p95'])}
        UNION ALL {_unpivoted('throughput', THROUGHPUT_SQL, ['window_minutes', 'screens', 'sessions_closed', 'per_minute'])}
        UNION ALL SELECT 'session_' || metric, key, value FROM ({SESSION_SUMMARY})""", "sessions"))
NOTICES_SQL = "SELECT DISTINCT 'Notice ' || (item_id % 30) AS title, unnest(['HIGH','LOW']) AS urgency, text AS content FROM benchmark"
add("g13_public_summary",
    lambda s, d: stats.public_summary(R(s, d), views.notices(s, d)),
    with_views(f"""SELECT {PUBLIC} AS kind, count(*) AS n, count(nullif(latency_ms, 0)) AS samples, min(nullif(latency_ms, 0)) AS lat_min, max(nullif(latency_ms, 0)) AS lat_max, CAST(floor(avg(nullif(latency_ms, 0))) AS BIGINT) AS lat_avg FROM reports GROUP BY 1
        UNION ALL SELECT 'REVOKED', count(*), 0, NULL, NULL, NULL FROM ({NOTICES_SQL}) WHERE title LIKE '%7'""", "reports"))
add("l1_recent_sessions", lambda s, d: rows.newest(S(s, d), 120, ["created_at", "session_id"]).select("session_id", "status", "created_at"),
    with_views("SELECT session_id, status, created_at FROM sessions ORDER BY created_at DESC, session_id DESC LIMIT 120", "sessions"))
add("l3_ledger_sort", lambda s, d: rows.ledger_order(S(s, d).withColumn("label", F.concat(F.lit("Session "), F.col("session_id") % 50)), "label").select("session_id", "label"),
    with_views("SELECT session_id, 'Session ' || (session_id % 50) AS label FROM sessions ORDER BY session_id % 50, session_id", "sessions"))
add("w10_day_labels", lambda s, d: rows.day_labels(S(s, d)).select("session_id", "label"),
    with_views("SELECT session_id, 'Session ' || row_number() OVER (PARTITION BY CAST(created_at + INTERVAL 330 MINUTE AS DATE) ORDER BY created_at, session_id) AS label FROM sessions", "sessions"))
add("w11_lowest_free_label",
    lambda s, d: rows.lowest_free_label(rows.day_labels(S(s, d))),
    with_views("""WITH l AS (SELECT *, strftime(created_at + INTERVAL 330 MINUTE, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY CAST(created_at + INTERVAL 330 MINUTE AS DATE) ORDER BY created_at, session_id) AS k FROM sessions),
        o AS (SELECT day, k, row_number() OVER (PARTITION BY day ORDER BY k) AS r FROM l WHERE status = 'open')
        SELECT day, coalesce(min(r) FILTER (k <> r), count(k) + 1) AS next_number FROM (SELECT DISTINCT day FROM l) LEFT JOIN o USING (day) GROUP BY day""", "sessions"))
add("w13_latest_per_key", lambda s, d: rows.latest_per_key(R(s, d), ["doc_no"], ["created_at", "id"]).select("doc_no", "id"),
    with_views("SELECT doc_no, arg_max(id, (created_at, id)) AS id FROM reports GROUP BY 1", "reports"))
add("u4_checkpoint_list", lambda s, d: R(s, d).select("checkpoint").union(S(s, d).select("checkpoint")).distinct().orderBy("checkpoint"),
    with_views("SELECT checkpoint FROM reports UNION SELECT checkpoint FROM sessions", "sessions"))
