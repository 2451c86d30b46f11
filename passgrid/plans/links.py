"""Links, sessions and ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from passgrid.functions import seals
from passgrid.operators import ledger, links, rows, sessions
from passgrid.plans.base import Book
from passgrid.sources import views
from passgrid.sources.views import with_views

BOOK = Book()
add = BOOK.add
R, S, DF, WL, EV, T = views.reports, views.sessions, views.doc_fields, views.watchlist, views.event_reports, views.table
KEY = b"demonstration key"
IPAD, OPAD = (p.hex() for p in seals.pads(KEY))


def hmac_sql(message: str) -> str:
    return f"sha256(from_hex('{OPAD}') || from_hex(sha256(from_hex('{IPAD}') || encode({message}))))"


UTC = "strftime(created_at, '%Y-%m-%d %H:%M:%S') || ' UTC'"
PRIORS = """priors AS (SELECT r.id, r.checkpoint, p.id AS prior_id, r.name, r.dob, p.name AS prior_name, p.dob AS prior_dob, p.checkpoint AS prior_checkpoint, p.verdict AS prior_verdict FROM reports r JOIN reports p ON r.doc_no = p.doc_no AND p.file_hash <> r.file_hash AND (p.created_at < r.created_at OR (p.created_at = r.created_at AND p.id < r.id)))"""
ALERTS = PRIORS + """, alerts AS (SELECT id, prior_id, checkpoint, 'NAME_CLASH' AS kind, 35 AS bump FROM priors WHERE name <> prior_name UNION ALL SELECT id, prior_id, checkpoint, 'DOB_CLASH', 35 FROM priors WHERE dob <> prior_dob
    UNION ALL SELECT id, prior_id, checkpoint, 'CROSS_CHECKPOINT', 25 FROM priors WHERE checkpoint <> prior_checkpoint UNION ALL SELECT id, prior_id, checkpoint, 'PREVIOUSLY_FLAGGED', 20 FROM priors WHERE checkpoint = prior_checkpoint AND prior_verdict IN ('FLAGGED', 'REVIEW'))"""
COMPARED = """digests AS (SELECT session_id, id, field, sha256(upper(trim(translate(value, ' -/\\._:()', '')))) AS h, script FROM doc_fields),
    compared AS (SELECT session_id, field, count(*) AS n, count(DISTINCT h) AS "values", count(DISTINCT script) AS scripts, CASE WHEN count(*) < 2 THEN 'single' WHEN count(DISTINCT h) = 1 THEN 'agree' WHEN count(DISTINCT script) > 1 THEN 'cross-script' ELSE 'disagree' END AS status FROM digests GROUP BY 1, 2),
    verdicts AS (SELECT session_id, CASE WHEN bool_or(status = 'disagree') THEN 'DISCREPANCY' ELSE 'CONSISTENT' END AS comparison_verdict, sum(CASE WHEN status <> 'disagree' THEN 0 WHEN field IN ('pan','aadhaar','passport','driving_licence','voter_id') THEN 35 ELSE 30 END) AS risk_bump FROM compared GROUP BY 1)"""
HITS = "SELECT r.id, w.mask, w.category FROM reports r JOIN watchlist w ON sha256(r.doc_no) = w.identifier_hash"


def with_hits(s, d):
    return links.watchlist_hits(links.identifier_rows(R(s, d), "id", ["doc_no"]), WL(s, d))


add("j1_watchlist_hits", lambda s, d: with_hits(s, d).select("id", "mask", "category"), with_views(HITS, "reports", "watchlist"))
add("u5_watchlist_misses", lambda s, d: links.watchlist_misses(links.identifier_rows(R(s, d), "id", ["doc_no"]), WL(s, d)).groupBy("field").agg(F.count("*").alias("n")),
    with_views("SELECT 'doc_no' AS field, count(*) AS n FROM reports WHERE sha256(doc_no) NOT IN (SELECT identifier_hash FROM watchlist)", "reports", "watchlist"))
add("j2_watchlist_edit",
    lambda s, d: links.watchlist_remove(links.watchlist_add(WL(s, d), WL(s, d).where("category = 'alert'").unionByName(R(s, d).where("custkey % 67 = 0").select(F.sha2("doc_no", 256).alias("identifier_hash"), F.lit("new").alias("mask"), F.lit("new").alias("category")))), WL(s, d).where("category = 'fraud'").select("identifier_hash")).select("identifier_hash", "category"),
    with_views("""WITH new AS (SELECT DISTINCT sha256(doc_no) AS identifier_hash FROM reports WHERE custkey % 67 = 0 AND sha256(doc_no) NOT IN (SELECT identifier_hash FROM watchlist))
        SELECT * FROM (SELECT identifier_hash, category FROM watchlist UNION ALL SELECT identifier_hash, 'new' FROM new) WHERE identifier_hash NOT IN (SELECT identifier_hash FROM watchlist WHERE category = 'fraud')""", "reports", "watchlist"))
add("j3_prior_matches",
    lambda s, d: links.prior_figures(R(s, d)),
    with_views(f"WITH {PRIORS} SELECT id, count(*) AS n_prior, max(prior_id) AS max_prior FROM priors GROUP BY 1", "reports"))
add("w1_recidivism_alerts",
    lambda s, d: links.alert_counts(R(s, d)).select("id", "kind", "n", "bump"),
    with_views(f"WITH {ALERTS} SELECT id, kind, count(*) AS n, sum(bump) AS bump FROM alerts GROUP BY 1, 2", "reports"))
add("w1_alert_pairs", lambda s, d: links.recidivism_alerts(R(s, d)), with_views(f"WITH {ALERTS} SELECT id, prior_id, checkpoint, kind, bump FROM alerts", "reports"))
add("g39_distinct_alerts",
    lambda s, d: links.first_alerts(R(s, d)),
    with_views(f"WITH {ALERTS} SELECT checkpoint, kind, unnest(min({{'id': id, 'prior_id': prior_id}})) FROM alerts GROUP BY 1, 2", "reports"))
BURST = """c AS (SELECT *, CAST(suspicious AS INTEGER) AS s1, CAST(floor(epoch(created_at)) AS BIGINT) AS t FROM event_reports),
    w AS (SELECT id, checkpoint, s1, sum(s1) OVER (PARTITION BY checkpoint ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) - coalesce(sum(s1) OVER (PARTITION BY checkpoint, t ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS recent FROM c)"""
add("w2_burst_alerts",
    lambda s, d: links.burst_alerts(EV(s, d), F.col("suspicious")).select("id", "checkpoint", "recent", "bump"),
    with_views(f"WITH {BURST} SELECT id, checkpoint, CAST(recent AS BIGINT) AS recent, 10 AS bump FROM w WHERE s1 = 1 AND recent >= 3", "event_reports"))
add("g36_threat_matrix",
    lambda s, d: links.threat_matrix(R(s, d), links.alert_counts(R(s, d))),
    with_views(f"""WITH {ALERTS}, a AS (SELECT checkpoint, count(*) AS n_alerts FROM alerts GROUP BY 1), b AS (SELECT checkpoint, count(*) AS n, round(avg(risk_score), 2) AS mean_risk, round(avg(CASE WHEN verdict = 'FLAGGED' THEN 1.0::DOUBLE ELSE 0 END), 4) AS flagged_share FROM reports GROUP BY 1)
        SELECT checkpoint, n, mean_risk, flagged_share, coalesce(n_alerts, 0) AS n_alerts, CASE WHEN flagged_share > 0.45 OR coalesce(n_alerts, 0) / n > 20 THEN 'CRITICAL' WHEN flagged_share > 0.43 OR coalesce(n_alerts, 0) / n > 10 THEN 'ELEVATED' ELSE 'NORMAL' END AS level FROM b LEFT JOIN a USING (checkpoint)""", "reports"))


def with_empty_sessions(s, d):
    """All sessions, and for every ninth one that was opened and has no document."""
    own = S(s, d).select("session_id")
    return own.unionByName(own.where("session_id % 9 = 0").select((F.col("session_id") + 1_000_000_000).alias("session_id")))


WITH_EMPTY = "opened AS (SELECT session_id FROM sessions UNION ALL SELECT session_id + 1000000000 FROM sessions WHERE session_id % 9 = 0)"
add("j4_session_counts", lambda s, d: sessions.with_document_counts(with_empty_sessions(s, d), rows.not_removed(R(s, d))),
    with_views(f"WITH {WITH_EMPTY} SELECT o.session_id, count(id) AS n_documents FROM opened o LEFT JOIN reports r ON r.session_id = o.session_id AND removed = 0 GROUP BY 1", "sessions"))
add("j5_session_documents", lambda s, d: sessions.session_documents(R(s, d)).select("session_id", F.array_join("documents", ",").alias("documents")),
    with_views("SELECT session_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY created_at, id) AS documents FROM reports WHERE removed = 0 GROUP BY 1", "reports"))
add("j6_latest_by_digest", lambda s, d: rows.latest_per_key(R(s, d), ["file_hash"], ["created_at", "id"]).select("file_hash", "id"),
    with_views("SELECT file_hash, arg_max(id, (created_at, id)) AS id FROM reports GROUP BY 1", "reports"))
NAT = "['IN','NP','BT','US'][CAST(session_id % 4 AS INTEGER) + 1]"
add("j15_missing_documents",
    lambda s, d: links.missing_documents(R(s, d).groupBy("session_id").agg(F.collect_set("doc_type").alias("presented")).withColumn("nationality", F.element_at(F.array(*[F.lit(x) for x in ("IN", "NP", "BT", "US")]), (F.col("session_id") % 4 + 1).cast("int")))).select("session_id", "nationality", F.array_join(F.array_sort("missing"), ",").alias("missing")),
    with_views(f"""SELECT session_id, {NAT} AS nationality, array_to_string(list_sort(list_filter(CASE {NAT} WHEN 'IN' THEN ['passport','aadhaar','driving_licence','voter_id','pan'] WHEN 'NP' THEN ['passport','nepali_citizenship'] WHEN 'BT' THEN ['passport','bhutan_citizenship'] ELSE ['passport','visa'] END, lambda x: NOT list_contains(p, x))), ',') AS missing
        FROM (SELECT session_id, list(DISTINCT doc_type) AS p FROM reports GROUP BY 1)""", "reports"))
PORTS = ["Sunauli", "Jaigaon", "IGI Delhi", "Haldia", "Raxaul Rail", "Elsewhere"]
add("j15_checkpoint_modes",
    lambda s, d: links.with_mode(S(s, d).select("session_id", F.element_at(F.array(*[F.lit(x) for x in PORTS]), (F.col("session_id") % 6 + 1).cast("int")).alias("port")), "port"),
    with_views(f"""SELECT session_id, {PORTS}[CAST(session_id % 6 AS INTEGER) + 1] AS port, ['LAND_NEPAL','LAND_BHUTAN','AIR','SEA','RAIL','LAND_NEPAL'][CAST(session_id % 6 AS INTEGER) + 1] AS cluster,
        ['land','land','air','sea','rail','land'][CAST(session_id % 6 AS INTEGER) + 1] AS mode FROM sessions""", "sessions"))
add("j16_officers",
    lambda s, d: R(s, d).join(T(s, d, "supplier").where("s_suppkey <= 20").select(F.concat(F.lit("officer"), F.col("s_suppkey") - 1).alias("screener"), F.when(F.col("s_suppkey") % 5 == 0, "  ").otherwise(F.col("s_name")).alias("institution")).where(F.trim("institution") != ""), "screener").groupBy("screener", "institution").agg(F.count("*").alias("n")),
    with_views("SELECT screener, s_name AS institution, count(*) AS n FROM reports JOIN supplier ON screener = 'officer' || (s_suppkey - 1) AND s_suppkey <= 20 AND s_suppkey % 5 <> 0 GROUP BY 1, 2", "reports"))
add("j22_notice_feed",
    lambda s, d: rows.newest(views.notices(s, d).where("NOT revoked"), 500, ["file_hash"], 500).select("title", "urgency", "file_hash"),
    (
        "WITH b AS (SELECT DISTINCT 'Notice ' || (item_id % 30) AS title, unnest(['HIGH','LOW']) AS urgency, text AS content FROM benchmark) SELECT title, urgency, sha256(title || "
        "':' || urgency || ':' || content) AS file_hash FROM b WHERE title NOT LIKE '%7' ORDER BY 3 DESC LIMIT 500"
    ))

add("n6_field_digests",
    lambda s, d: sessions.digest_map(sessions.field_digests(DF(s, d))).select("session_id", "id", F.col("digests.name.h").alias("name_h"), F.col("digests.name.s").alias("name_s"), F.col("digests.pan.h").alias("pan_h")),
    with_views(f"WITH {COMPARED} SELECT session_id, id, max(h) FILTER (field = 'name') AS name_h, max(script) FILTER (field = 'name') AS name_s, max(h) FILTER (field = 'pan') AS pan_h FROM digests GROUP BY 1, 2", "doc_fields"))
add("g14_compare_fields", lambda s, d: sessions.compare_fields(sessions.field_digests(DF(s, d))), with_views(f"WITH {COMPARED} SELECT * FROM compared", "doc_fields"))
RESCUED = COMPARED + """,
    near AS (SELECT session_id, field FROM compared JOIN doc_fields USING (session_id, field) WHERE status = 'disagree' AND field = 'dob' GROUP BY 1, 2 HAVING count(DISTINCT regexp_extract(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) = 1 OR count(DISTINCT left(value, 4)) = 1
        UNION ALL SELECT a.session_id, 'name' FROM doc_fields a JOIN doc_fields b ON a.session_id = b.session_id AND a.field = 'name' AND b.field = 'name' AND a.id < b.id GROUP BY 1
            HAVING bool_and(len(list_filter(regexp_extract_all(upper(a.value), '[A-Z]+'), lambda x: NOT list_contains(regexp_extract_all(upper(b.value), '[A-Z]+'), x))) = 0 OR len(list_filter(regexp_extract_all(upper(b.value), '[A-Z]+'), lambda x: NOT list_contains(regexp_extract_all(upper(a.value), '[A-Z]+'), x))) = 0)),
    rescued AS (SELECT c.session_id, c.field, CASE WHEN c.status = 'disagree' AND n.field IS NOT NULL THEN 'agree' ELSE c.status END AS status FROM compared c LEFT JOIN near n ON n.session_id = c.session_id AND n.field = c.field
        UNION ALL SELECT session_id, f, 'none' FROM (SELECT DISTINCT session_id FROM compared) s, (SELECT unnest(['name', 'dob', 'gender', 'passport', 'state', 'pincode', 'address']) AS f) x WHERE NOT EXISTS (SELECT 1 FROM compared c WHERE c.session_id = s.session_id AND c.field = f))"""


def compared_again(s, d):
    return sessions.rescued(sessions.field_status(sessions.field_digests(DF(s, d))), DF(s, d))


add("g14_rescued_fields", compared_again, with_views(f"WITH {RESCUED} SELECT * FROM rescued", "doc_fields"))
add("g14_rescued_sessions",
    lambda s, d: sessions.compare_sessions(compared_again(s, d)),
    with_views(f"""WITH {RESCUED} SELECT session_id, CASE WHEN bool_or(status = 'disagree') THEN 'DISCREPANCY' WHEN bool_or(status <> 'none') THEN 'CONSISTENT' ELSE 'INCOMPLETE' END AS comparison_verdict,
        CAST(sum(CASE WHEN status <> 'disagree' THEN 0 WHEN field IN ('pan','aadhaar','passport','driving_licence','voter_id') THEN 35 ELSE 30 END) AS BIGINT) AS risk_bump FROM rescued GROUP BY 1""", "doc_fields"))
add("g14_compare_sessions",
    lambda s, d: sessions.compare_sessions(sessions.field_status(sessions.field_digests(DF(s, d)))),
    with_views(f"WITH {COMPARED} SELECT session_id, comparison_verdict, CAST(risk_bump AS BIGINT) AS risk_bump FROM verdicts", "doc_fields"))
add("g15_primary_ids_agree",
    lambda s, d: sessions.primary_ids_agree(DF(s, d)),
    with_views((
        "SELECT session_id, bool_or(same) AS ids_agree FROM (SELECT session_id, field, count(*) >= 2 AND count(DISTINCT upper(value)) = 1 AS same FROM doc_fields WHERE field IN ('pan', "
        "'passport') GROUP BY 1, 2) GROUP BY 1"
    ), "doc_fields"))
add("g16_session_risk",
    lambda s, d: sessions.session_risk(R(s, d), sessions.compare_sessions(sessions.field_status(sessions.field_digests(DF(s, d))))),
    with_views((
        f"WITH {COMPARED}, t AS (SELECT session_id, max(risk_score) AS m FROM reports WHERE removed = 0 GROUP BY 1) SELECT session_id, comparison_verdict, CAST(least(100, greatest(0, "
        f"m + coalesce(risk_bump, 0))) AS INTEGER) AS session_risk FROM t LEFT JOIN verdicts USING (session_id)"
    ), "doc_fields"))


def settlement(s, d):
    compared = sessions.compare_sessions(sessions.field_status(sessions.field_digests(DF(s, d))))
    hit = with_hits(s, d).join(R(s, d).select("id", "session_id"), "id").select("session_id").distinct().withColumn("hit", F.lit(True))
    actions = F.array(*[F.lit(x) for x in ("approve", "flag", "adjudicate", "close")])
    decisions = F.array(*[F.lit(x) for x in ("CLEARED", "CONFIRMED_FRAUD", "INCONCLUSIVE")])
    counted = sessions.with_document_counts(with_empty_sessions(s, d), rows.not_removed(R(s, d)))
    cases = counted.join(compared, "session_id", "left").join(hit, "session_id", "left").select("session_id", "n_documents", "comparison_verdict", F.coalesce("hit", F.lit(False)).alias("watchlisted"), F.element_at(actions, (F.col("session_id") % 4 + 1).cast("int")).alias("action"), F.element_at(decisions, (F.col("session_id") % 3 + 1).cast("int")).alias("decision"))
    return sessions.settle(cases).select("session_id", "action", "status", "verdict")


add("g17_settlement",
    settlement,
    with_views(f"""WITH {COMPARED}, hits AS (SELECT DISTINCT session_id FROM reports r JOIN watchlist w ON sha256(r.doc_no) = w.identifier_hash),
    {WITH_EMPTY}, n AS (SELECT o.session_id, count(id) AS k FROM opened o LEFT JOIN reports r ON r.session_id = o.session_id AND removed = 0 GROUP BY 1),
    c AS (SELECT session_id, k, comparison_verdict AS cv, session_id IN (SELECT session_id FROM hits) AS wl, ['approve','flag','adjudicate','close'][CAST(session_id % 4 AS INTEGER) + 1] AS action, ['CLEARED','CONFIRMED_FRAUD','INCONCLUSIVE'][CAST(session_id % 3 AS INTEGER) + 1] AS decision FROM n LEFT JOIN verdicts USING (session_id))
    SELECT session_id, action, CASE WHEN action = 'close' OR (k = 0 AND action IN ('approve', 'flag')) THEN 'closed' WHEN action = 'flag' THEN 'flagged' WHEN action = 'approve' AND (wl OR coalesce(cv, '') = 'DISCREPANCY') THEN 'open' WHEN action = 'approve' OR decision = 'CLEARED' THEN 'approved' ELSE 'rejected' END AS status,
        CASE WHEN action = 'close' OR (k = 0 AND action IN ('approve', 'flag')) THEN 'CLOSED' WHEN action = 'flag' THEN 'REVIEW' WHEN action = 'approve' AND wl THEN 'BLOCKED_WATCHLIST' WHEN action = 'approve' AND cv = 'DISCREPANCY' THEN 'BLOCKED_DISCREPANCY' WHEN action = 'approve' OR decision = 'CLEARED' THEN 'CLEAR' WHEN decision = 'CONFIRMED_FRAUD' THEN 'FLAGGED' ELSE 'REVIEW' END AS verdict FROM c""", "doc_fields", "watchlist", "sessions"))

# Ledger: a chain per checkpoint and month.
CHAIN = ["checkpoint", "month"]


def blocks(s, d):
    r = R(s, d).withColumn("month", F.date_format("created_at", "yyyy-MM"))
    return ledger.build_chain(r, CHAIN, ["created_at", "seq"], ledger.report_payload())


CHAIN_SQL = f"""p AS (SELECT checkpoint, strftime(created_at, '%Y-%m') AS month, created_at, seq, file_hash || ':' || verdict || ':' || risk_score || ':' || {UTC} || ':' || screener AS payload,
        CAST(row_number() OVER (PARTITION BY checkpoint, strftime(created_at, '%Y-%m') ORDER BY created_at, seq) - 1 AS INTEGER) AS position FROM reports),
    chain AS (SELECT *, 'GENESIS' AS previous_hash, sha256('GENESIS:' || payload) AS ledger_hash FROM p WHERE position = 0
        UNION ALL SELECT p.*, c.ledger_hash, sha256(c.ledger_hash || ':' || p.payload) FROM chain c JOIN p ON p.checkpoint = c.checkpoint AND p.month = c.month AND p.position = c.position + 1)"""


def recursive(body: str, *names: str) -> str:
    return with_views(body, *names).replace("WITH ", "WITH RECURSIVE ", 1)


add("w5_chain_build",
    lambda s, d: blocks(s, d).select("checkpoint", "month", "position", "seq", "previous_hash", "ledger_hash"),
    recursive(f"WITH {CHAIN_SQL} SELECT checkpoint, month, position, seq, previous_hash, ledger_hash FROM chain", "reports"))
add("w3_chain_verify",
    lambda s, d: ledger.verify_chain(blocks(s, d).withColumn("payload", F.when(F.col("seq") % 997 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))).withColumn("previous_hash", F.when(F.col("seq") % 499 == 1, "X").otherwise(F.col("previous_hash"))), CHAIN).drop("head"),
    recursive(f"""WITH {CHAIN_SQL}, t AS (SELECT checkpoint, month, position, CASE WHEN seq % 997 = 0 THEN payload || '!' ELSE payload END AS payload, CASE WHEN seq % 499 = 1 THEN 'X' ELSE previous_hash END AS previous_hash, ledger_hash FROM chain),
        v AS (SELECT *, CASE WHEN previous_hash <> coalesce(lag(ledger_hash) OVER (PARTITION BY checkpoint, month ORDER BY position), 'GENESIS') THEN 'PARENT_MISMATCH' WHEN ledger_hash <> sha256(previous_hash || ':' || payload) THEN 'PAYLOAD_MISMATCH' END AS reason FROM t)
        SELECT checkpoint, month, count(*) AS blocks, min(position) FILTER (reason IS NOT NULL) AS broken_at, arg_min(reason, position) FILTER (reason IS NOT NULL) AS reason, CASE WHEN bool_or(reason IS NOT NULL) THEN 'BROKEN' ELSE 'INTACT' END AS status FROM v GROUP BY 1, 2""", "reports"))


def session_blocks(s, d):
    docs = blocks(s, d).select("seq", "ledger_hash").join(R(s, d).where("removed = 0").select("seq", "session_id"), "seq").groupBy("session_id").agg(F.collect_list("ledger_hash").alias("doc_blocks"))
    closed = S(s, d).where("status <> 'open'").join(docs, "session_id").withColumn("comparison_verdict", F.lit("CONSISTENT")).withColumn("year", F.date_format("closed_at", "yyyy"))
    return ledger.build_chain(closed, ["checkpoint", "year"], ["closed_at", "session_id"], ledger.session_payload(F.col("doc_blocks")))


def tampered(blocks):
    """Some payloads changed and some parents lost."""
    bad = F.when(F.col("session_id") % 97 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))
    return blocks.withColumn("payload", bad).withColumn("previous_hash", F.when(F.col("session_id") % 89 == 1, "X").otherwise(F.col("previous_hash")))


add("w4_session_chain_verify",
    lambda s, d: ledger.verify_chain(tampered(session_blocks(s, d)), ["checkpoint", "year"]),
    recursive(f"""WITH {CHAIN_SQL}, docs AS (SELECT session_id, array_to_string(list_sort(list(ledger_hash)), ':') AS b FROM chain JOIN (SELECT seq, session_id FROM reports WHERE removed = 0) USING (seq) GROUP BY 1),
        sp AS (SELECT checkpoint, strftime(closed_at, '%Y') AS year, session_id, CAST(row_number() OVER (PARTITION BY checkpoint, strftime(closed_at, '%Y') ORDER BY closed_at, session_id) - 1 AS INTEGER) AS position,
            session_id || '|' || checkpoint || '|' || screener || '|' || verdict || '|' || risk_score || '|' || b || '|CONSISTENT|' || strftime(closed_at, '%Y-%m-%d %H:%M:%S') || ' UTC' AS payload FROM sessions JOIN docs USING (session_id) WHERE status <> 'open'),
        sc AS (SELECT *, 'GENESIS' AS previous, sha256('GENESIS:' || payload) AS h FROM sp WHERE position = 0 UNION ALL SELECT sp.*, sc.h, sha256(sc.h || ':' || sp.payload) FROM sc JOIN sp ON sp.checkpoint = sc.checkpoint AND sp.year = sc.year AND sp.position = sc.position + 1),
        t AS (SELECT checkpoint, year, position, CASE WHEN session_id % 97 = 0 THEN payload || '!' ELSE payload END AS payload, CASE WHEN session_id % 89 = 1 THEN 'X' ELSE previous END AS previous, h FROM sc),
        v AS (SELECT *, CASE WHEN previous <> coalesce(lag(h) OVER (PARTITION BY checkpoint, year ORDER BY position), 'GENESIS') THEN 'PARENT_MISMATCH' WHEN h <> sha256(previous || ':' || payload) THEN 'PAYLOAD_MISMATCH' END AS reason FROM t)
        SELECT checkpoint, year, count(*) AS blocks, min(position) FILTER (reason IS NOT NULL) AS broken_at, arg_min(reason, position) FILTER (reason IS NOT NULL) AS reason, CASE WHEN bool_or(reason IS NOT NULL) THEN 'BROKEN' ELSE 'INTACT' END AS status, arg_max(h, position) AS head FROM v GROUP BY 1, 2""", "sessions"))
add("g18_merkle_roots",
    lambda s, d: ledger.merkle_roots(R(s, d), ["checkpoint"], "file_hash", ["created_at", "seq"], F.to_date("created_at")),
    recursive("""WITH t AS (SELECT checkpoint, file_hash AS h, row_number() OVER (PARTITION BY checkpoint ORDER BY created_at, seq) - 1 AS i, count(*) OVER (PARTITION BY checkpoint) AS n FROM reports),
        up AS (SELECT checkpoint, i, h, n FROM t UNION ALL SELECT a.checkpoint, a.i // 2, sha256(a.h || ':' || coalesce(b.h, a.h)), (a.n + 1) // 2 FROM up a LEFT JOIN up b ON b.checkpoint = a.checkpoint AND b.i = a.i + 1 WHERE a.i % 2 = 0 AND a.n > 1)
        SELECT checkpoint, h AS root FROM up WHERE n = 1""", "reports"))
add("a16_anchor_drift",
    lambda s, d: ledger.anchor_drift(ledger.anchor(blocks(s, d), CHAIN, KEY), ledger.anchor(blocks(s, d), CHAIN, KEY).where("month < '1998'").withColumn("head", F.when(F.col("month").endswith("-03"), "stale").otherwise(F.col("head"))), CHAIN).select("checkpoint", "month", "n_blocks", "seal", "state"),
    recursive(f"""WITH {CHAIN_SQL}, h AS (SELECT checkpoint, month, arg_max(ledger_hash, position) AS head, count(*) AS n_blocks FROM chain GROUP BY 1, 2)
        SELECT checkpoint, month, n_blocks, {hmac_sql("head || '|' || n_blocks")} AS seal, CASE WHEN month >= '1998' THEN 'UNANCHORED' WHEN month LIKE '%-03' THEN 'DRIFT_DETECTED' ELSE 'IN_SYNC' END AS state FROM h""", "reports"))
add("a14_seals",
    lambda s, d: R(s, d).select("id", seals.hmac_sha256(KEY, F.concat_ws("|", "doc_no", "verdict")).alias("seal")),
    with_views(f"SELECT id, {hmac_sql(chr(39).join(['doc_no || ', '|', ' || verdict']))} AS seal FROM reports", "reports"))
add("a15_handover",
    lambda s, d: ledger.handover_packets(R(s, d), ["session_id"], KEY),
    with_views(f"""SELECT session_id, '["' || array_to_string(h, '","') || '"]' AS hashes, {hmac_sql("session_id || '|' || array_to_string(h, ',')")} AS seal FROM (SELECT session_id, list_sort(list(file_hash)) AS h FROM reports GROUP BY 1)""", "reports"))
COLUMNS = ["id", "doc_type", "checkpoint", "screener", "verdict", "risk_score", "doc_no", "name", "dob", "adjudication", "file_hash"]
add("a10_export_digests",
    lambda s, d: ledger.export_digests(R(s, d).where("checkpoint LIKE '%A%' AND created_at >= '1995-01-01' AND created_at < '1997-01-01'"), F.date_format("created_at", "yyyy-MM-dd"), COLUMNS, ["created_at", "id"]),
    with_views(f"""SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n_lines, sha256(string_agg({" || ',' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in COLUMNS)}, chr(10) ORDER BY created_at, id)) AS digest FROM reports WHERE checkpoint LIKE '%A%' AND created_at >= '1995-01-01' AND created_at < '1997-01-01' GROUP BY 1""", "reports"))
HOSTILE = ["=HYPERLINK(1)", "+123", "-Gate", "@boss", "\tTab", "plain"]
add("a11_safe_cells",
    lambda s, d: R(s, d).select("id", seals.safe_cell(F.concat(F.element_at(F.array(*[F.lit(x) for x in HOSTILE]), (F.col("id") % 6 + 1).cast("int")), F.col("doc_no"))).alias("cell")),
    with_views("SELECT id, CASE WHEN id % 6 < 5 THEN '''' ELSE '' END || ['=HYPERLINK(1)', '+123', '-Gate', '@boss', chr(9) || 'Tab', 'plain'][CAST(id % 6 AS INTEGER) + 1] || doc_no AS cell FROM reports", "reports"))
add("a12_ledger_export",
    lambda s, d: ledger.running_index(S(s, d).withColumn("day", F.date_format("created_at", "yyyy-MM-dd")), "day", ["created_at", "session_id"]).select("index", seals.csv_line([F.concat(F.lit('a "q", '), F.col("checkpoint")), F.col("session_id"), F.col("verdict")]).alias("line")),
    with_views("""SELECT row_number() OVER (ORDER BY created_at, session_id) AS index, '"a ""q"", ' || checkpoint || '",' || session_id || ',' || coalesce(verdict, '') AS line FROM sessions""", "sessions"))
add("w12_monotone_close",
    lambda s, d: ledger.monotone_close(R(s, d).withColumn("t", F.date_trunc("day", "created_at")), ["checkpoint"], ["t", "id"], "t").select("id", "closed_monotone"),
    with_views("""WITH n AS (SELECT id, checkpoint, CAST(epoch(date_trunc('day', created_at)) AS BIGINT) AS t, row_number() OVER (PARTITION BY checkpoint ORDER BY date_trunc('day', created_at), id) AS n FROM reports)
        SELECT id, make_timestamp(CAST((max(t - n) OVER (PARTITION BY checkpoint ORDER BY n) + n) * 1000000 AS BIGINT)) AS closed_monotone FROM n""", "reports"))
add("flagship_alerts",
    lambda s, d: flagship(s, d),
    with_views(f"""WITH {ALERTS}, a AS (SELECT checkpoint, count(*) AS n_alerts, sum(bump) AS bump, count(DISTINCT id) AS n_reports FROM alerts GROUP BY 1) SELECT checkpoint, n_alerts, CAST(bump AS BIGINT) AS bump, n_reports FROM a""", "reports"))


def flagship(s, d):
    """Recidivism alerts per checkpoint."""
    return links.alert_counts(R(s, d)).groupBy("id", "checkpoint").agg(F.sum("n").alias("n"), F.sum("bump").alias("bump")).groupBy("checkpoint").agg(F.sum("n").alias("n_alerts"), F.sum("bump").alias("bump"), F.count("*").alias("n_reports"))

