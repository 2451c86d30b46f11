"""Batch forms of the streaming rules over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from passgrid.operators import sessions
from passgrid.plans.base import Book
from passgrid.plans.links import with_hits
from passgrid.sources import views
from passgrid.sources.views import with_views
from passgrid.streaming import jobs

BOOK = Book()
add = BOOK.add
EV, R, S = views.event_reports, views.reports, views.sessions

# A key's next row that passes is its first one more than a minute after: followed from row to row.
INTAKE = """WITH RECURSIVE e AS (SELECT user_id AS k, event_type AS et, CAST(floor(epoch(created_at) / 100) AS BIGINT) AS t, arg_min(id, id) AS id FROM event_reports GROUP BY 1, 2, 3),
        far AS (SELECT k, et, t, min(t) OVER (PARTITION BY k, et ORDER BY t RANGE BETWEEN 61 FOLLOWING AND UNBOUNDED FOLLOWING) AS t2 FROM e),
        nxt AS (SELECT f.*, e.id AS id2 FROM far f JOIN e ON e.k = f.k AND e.et = f.et AND e.t = f.t2),
        kept AS (SELECT k, et, min(t) AS t, arg_min(id, t) AS id FROM e GROUP BY 1, 2 UNION ALL SELECT n.k, n.et, n.t2, n.id2 FROM kept JOIN nxt n ON n.k = kept.k AND n.et = kept.et AND n.t = kept.t)
        SELECT id FROM kept"""
# A hundred seconds count as one, so that a user's events of a kind are often within a minute.
add("t1_intake", lambda s, d: jobs.intake_batch(EV(s, d).withColumn("created_at", F.timestamp_seconds(F.floor(F.unix_timestamp("created_at") / 100))), ["user_id", "event_type"], "created_at", "id", 60).select("id"),
    with_views(INTAKE, "event_reports").replace("WITH ", "WITH RECURSIVE ", 1).replace(", RECURSIVE ", ", ", 1))
add("t2_throughput",
    lambda s, d: jobs.throughput(EV(s, d), "created_at"),
    with_views("SELECT time_bucket(INTERVAL 1 HOUR, created_at) AS start, count(*) AS n FROM event_reports GROUP BY 1", "event_reports"))
add("t3_bursts",
    lambda s, d: jobs.bursts(EV(s, d), "created_at", "checkpoint", F.col("suspicious")),
    with_views((
        "SELECT b - to_minutes(CAST(10 * i AS BIGINT)) AS start, checkpoint, count(*) AS n FROM (SELECT *, time_bucket(INTERVAL 10 MINUTE, created_at) AS b FROM event_reports WHERE "
        "suspicious), range(6) r(i) GROUP BY 1, 2 HAVING count(*) >= 3"
    ), "event_reports"))
add("t4_recidivism",
    lambda s, d: jobs.recidivism_batch(EV(s, d)).select("id", "prior_checkpoint", "prior_id"),
    with_views("""WITH r AS (SELECT identifier_hash AS h, checkpoint AS c, id, created_at AS t FROM event_reports)
        SELECT r.id, p.c AS prior_checkpoint, arg_max(p.id, (p.t, p.id)) AS prior_id FROM r JOIN r p ON r.h = p.h AND r.c <> p.c AND (p.t < r.t OR (p.t = r.t AND p.id < r.id)) GROUP BY 1, 2""", "event_reports"))
add("t5_watchlist",
    lambda s, d: jobs.watchlist_hits(EV(s, d), EV(s, d).where("id % 50 = 0").select("identifier_hash", F.lit("alert").alias("category")).distinct()).groupBy("checkpoint").agg(F.count("*").alias("n")),
    with_views("SELECT checkpoint, count(*) AS n FROM event_reports WHERE identifier_hash IN (SELECT identifier_hash FROM event_reports WHERE id % 50 = 0) GROUP BY 1", "event_reports"))
add("t6_idle_sweep",
    lambda s, d: jobs.idle_sweep(S(s, d).select("session_id", "status", F.col("closed_at").alias("updated_at"), F.lit("x").alias("raw")), F.lit("1996-01-01").cast("timestamp")).select("session_id", "raw", "note"),
    with_views((
        "SELECT session_id, CASE WHEN i THEN NULL ELSE 'x' END AS raw, CASE WHEN i THEN 'raw fields removed after inactivity' END AS note FROM (SELECT session_id, status = 'open' AND "
        "epoch(closed_at) < epoch(TIMESTAMP '1996-01-01') - 14400 AS i FROM sessions)"
    ), "sessions"))
ACTIONS = ["approve", "flag", "clear", "reject", "close"]


def session_events(s, d):
    return views.table(s, d, "events").select(F.floor(F.col("event_id") / 40).alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), (F.col("user_id") % 5 + 1).cast("int")).alias("action"))


add("t7_lifecycle",
    lambda s, d: jobs.lifecycle_batch(session_events(s, d)),
    """WITH e AS (SELECT event_id // 40 AS session_id, ['approve','flag','clear','reject','close'][CAST(user_id % 5 AS INTEGER) + 1] AS a, ts, event_id FROM events), f AS (SELECT session_id, list(a ORDER BY ts, event_id) AS a FROM e GROUP BY 1)
        SELECT session_id, list_reduce(list_prepend('open', a), lambda s, x: CASE s || '/' || x WHEN 'open/approve' THEN 'approved' WHEN 'open/flag' THEN 'flagged' WHEN 'open/close' THEN 'closed' WHEN 'flagged/clear' THEN 'approved' WHEN 'flagged/reject' THEN 'rejected' ELSE s END) AS status, len(a) AS events FROM f""")
add("t9_activity",
    lambda s, d: jobs.activity(EV(s, d), "created_at", "user_id"),
    with_views("""WITH g AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER w >= INTERVAL 240 MINUTE THEN 1 ELSE 0 END AS b FROM event_reports WINDOW w AS (PARTITION BY user_id ORDER BY created_at, id)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, min(created_at) AS start, max(created_at) + INTERVAL 240 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""", "event_reports"))
add("t10_wiped_fields",
    lambda s, d: sessions.wiped(views.doc_fields(s, d), S(s, d)).select("id", "field", "value"),
    with_views("SELECT id, field, CASE WHEN session_id % 10 = 0 THEN value END AS value FROM doc_fields", "doc_fields"))
add("t5_report_hits",
    lambda s, d: with_hits(s, d).groupBy("category").agg(F.count("*").alias("n")),
    with_views("SELECT category, count(*) AS n FROM reports r JOIN watchlist w ON sha256(r.doc_no) = w.identifier_hash GROUP BY 1", "reports", "watchlist"))
