"""Risk rules and verdicts over reports and holder texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from passgrid.functions import identifiers as I
from passgrid.operators import risk as K
from passgrid.plans.base import Book
from passgrid.plans.identifiers import as_of
from passgrid.sources import views
from passgrid.sources.identifiers import identifiers
from passgrid.sources.views import with_views

BOOK = Book()
add = BOOK.add
R, T = views.reports, views.table
ids = lambda body: with_views(body, "ids")

add("b6_decisions",
    lambda s, d: R(s, d).select("id", K.decision(F.col("id") % 50 == 0, F.col("risk_score"), F.col("id") % 3 != 0, (F.col("id") % 100) / 100, F.col("verdict")).alias("decision")),
    with_views((
        "SELECT id, CASE WHEN id % 50 = 0 OR risk_score >= 55 OR verdict = 'FLAGGED' THEN 'REJECT_LIKELY' WHEN id % 3 = 0 OR risk_score > 25 OR (id % 100) / 100 < 0.75 OR verdict = "
        "'REVIEW' THEN 'REVIEW' ELSE 'GENUINE_LIKELY' END AS decision FROM reports"
    ), "reports"))
add("b7_evidence_confidence",
    lambda s, d: R(s, d).select("id", K.evidence_confidence([F.when(F.col("id") % k == 0, F.col("name")) for k in (1, 2, 3, 4, 5)] + [F.col("dob")], F.col("id") % 2 == 0, F.col("removed")).alias("confidence")),
    with_views("SELECT id, CAST(round(CAST(least(0.98::DOUBLE, 0.45::DOUBLE + least(2 + " + " + ".join(f"CASE WHEN id % {k} = 0 THEN 1 ELSE 0 END" for k in (2, 3, 4, 5, 2)) + " + removed, 8) / 8 * 0.5::DOUBLE) AS DECIMAL(12, 6)), 2) AS DOUBLE) AS confidence FROM reports", "reports"))
add("b8_unmeasurable",
    lambda s, d: R(s, d).select("id", F.array_join(K.unmeasurable(F.col("doc_type"), F.col("id") % 2 == 0, F.col("id") % 3 == 0, F.col("id") % 5 == 0, F.col("id") % 7 == 0), ";").alias("signals")),
    with_views((
        "SELECT id, array_to_string(list_filter([CASE WHEN doc_type <> 'passport' THEN 'no zone on this type' WHEN id % 2 <> 0 THEN 'zone unreadable' END, CASE WHEN id % 3 <> 0 THEN "
        "'no live capture' END, CASE WHEN id % 5 <> 0 THEN 'no reverse side' END, CASE WHEN id % 7 <> 0 THEN 'no code' END], lambda x: x IS NOT NULL), ';') AS signals FROM reports"
    ), "reports"))
add("b9_travel_validity",
    lambda s, d: identifiers(s, d).select("k", K.travel_validity(F.col("expiry"), F.col("dob"), F.date_add(as_of(), (F.col("k") % 2000).cast("int"))).alias("x")).select("k", "x.*"),
    ids((
        "SELECT k, CAST(e AS INTEGER) AS days_to_expiry, e >= 180 AS six_month_rule, CAST(floor((a - dob) / 365) AS INTEGER) AS age, CASE WHEN e < 0 THEN 'EXPIRED' WHEN e < 180 THEN "
        "'EXPIRING_SOON' ELSE 'VALID' END AS status FROM (SELECT k, dob, DATE '2026-01-01' + CAST(k % 2000 AS INTEGER) AS a, expiry - (DATE '2026-01-01' + CAST(k % 2000 AS INTEGER)) AS e FROM ids)"
    )))
add("b10_validation_verdicts",
    lambda s, d: identifiers(s, d).select("k", I.checks_verdict(F.concat(F.array(*I.pan_checks(F.col("pan"))), F.when(F.col("k") % 5 == 0, F.array(*I.aadhaar_checks(F.col("aadhaar")))).otherwise(F.array().cast("array<struct<label:string,ok:boolean>>")))).alias("verdict")),
    ids("SELECT k, CASE WHEN pan[4] <> 'P' OR k % 5 = 0 THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM ids"))
LABELS = ["ela", "sensor-noise", "focus", "liveness-blink", "unknown", "dual-stream-forgery"]


def forensic_rows(s, d):
    names = F.array(*[F.lit(x) for x in LABELS])
    return R(s, d).select("id", F.posexplode(names).alias("i", "label")).where("(id + i) % 4 <> 0").select("id", "label", ((F.col("id") * 7 + F.col("i") * 3) % 5 > 0).alias("ok"))


W_SQL = "CASE label WHEN 'ela' THEN 1.0 WHEN 'sensor-noise' THEN 0.8 WHEN 'focus' THEN 0.2 WHEN 'liveness-blink' THEN 0.2 WHEN 'dual-stream-forgery' THEN 1.0 ELSE 0.5 END::DOUBLE"
add("b11_weighted_verdicts",
    lambda s, d: K.weighted_verdict(forensic_rows(s, d), "id"),
    with_views(f"""WITH c AS (SELECT id, l.label, (id * 7 + l.i * 3) % 5 > 0 AS ok FROM reports, (VALUES {', '.join(f"({i}, '{x}')" for i, x in enumerate(LABELS))}) l(i, label) WHERE (id + l.i) % 4 <> 0),
        s AS (SELECT id, round(sum(CASE WHEN NOT ok THEN {W_SQL} ELSE 0 END), 6) AS fail, round(sum(CASE WHEN ok THEN {W_SQL} ELSE 0 END), 6) AS passed FROM c GROUP BY 1) SELECT id, fail, passed, CASE WHEN fail >= 1.3 THEN 'FAIL' WHEN fail > 0 OR passed < 1.0 THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM s""", "reports"))
add("b12_cross_fields",
    lambda s, d: identifiers(s, d).select("k", F.explode(K.cross_field_checks(F.date_add("expiry", (F.col("k") % 3 - 1).cast("int")), F.col("expiry"), F.when(F.col("k") % 4 > 0, F.col("dob")), F.lit("Given Name"), F.when(F.col("k") % 2 == 0, "SURNAME GIVEN").otherwise("OTHER PERSON"), as_of())).alias("c")).select("k", "c.*"),
    ids((
        "SELECT k, 'cross-field-temporal' AS label, k % 3 = 0 AS ok FROM ids UNION ALL SELECT k, 'cross-field-dob', dob <= DATE '2026-01-01' FROM ids WHERE k % 4 > 0 UNION ALL SELECT "
        "k, 'cross-field-name-mrz', k % 2 = 0 FROM ids"
    )))
add("b13_expiry_checks",
    lambda s, d: identifiers(s, d).select("k", K.expiry_check(F.lit("x"), F.when(F.col("k") % 5 > 0, F.col("expiry")), F.when(F.col("k") % 2 == 0, "passport").otherwise("pan"), as_of()).alias("c")).where("c IS NOT NULL").select("k", "c.*"),
    ids("SELECT k, 'expiry' AS label, CASE WHEN k % 5 > 0 THEN expiry >= DATE '2026-01-01' END AS ok FROM ids WHERE k % 5 > 0 OR k % 2 = 0"))
add("b14_inferred_types",
    lambda s, d: identifiers(s, d).select("k", K.inferred_type(F.when(F.col("k") % 3 == 0, "visa").otherwise("other"), {"pan": F.when(F.col("k") % 2 == 0, F.col("pan")), "voter_id": F.when(F.col("k") % 4 > 0, F.col("voter"))}, F.lit("passport"), F.col("k") % 10 / 10).alias("kind")),
    ids("SELECT k, CASE WHEN k % 3 = 0 THEN 'visa' WHEN k % 10 / 10 >= 0.6 THEN 'passport' WHEN k % 2 = 0 THEN 'pan' WHEN k % 4 > 0 THEN 'voter_id' ELSE 'other' END AS kind FROM ids"))
NATIONS = ["in", "Nepal", "BTN", "usa", "Mars"]


def cases(s, d):
    k = F.col("k")
    kinds = F.array(*[F.lit(x) for x in ("aadhaar", "pan", "passport", "voter_id", "nepali_citizenship", "student_card")])
    return identifiers(s, d).select(
        "k", F.element_at(kinds, (k % 6 + 1).cast("int")).alias("doc_type"), K.nation(F.element_at(F.array(*[F.lit(x) for x in NATIONS]), (k % 5 + 1).cast("int"))).alias("nation"), (k % 3 > 0).alias("pan"), (k % 4 == 0).alias("aadhaar"), I.verhoeff(F.col("aadhaar")).alias("aadhaar_valid"), (k % 8 == 0).alias("aadhaar_from_ocr"),
        (k % 7 == 0).alias("passport"), F.when(k % 14 == 0, k % 28 == 0).alias("zone_valid"), "dob", "expiry", as_of().alias("as_of"), (k % 3 > 0).alias("identified"), F.when(k % 9 == 0, "FAIL").otherwise("PASS").alias("validation"), F.when(k % 11 == 0, "REVIEW").otherwise("PASS").alias("tampering"),
        (k % 13 == 0).alias("degraded"), F.when(k % 17 == 0, 1).otherwise(0).alias("hits"), F.lower(F.col("text")).rlike(K.SPECIMEN).alias("specimen"),
    )


def fold_sql(rules: list[K.Rule], evidence: dict[str, str]) -> str:
    """The same fold as nested SQL: one layer a rule."""
    inner = "SELECT *, 20 AS r, false AS h, true AS c, CAST([] AS VARCHAR[]) AS q FROM e"
    for rule in rules:
        inner = f"SELECT * REPLACE (CASE WHEN f THEN greatest(r + {rule.add}, {rule.floor}) ELSE r END AS r, h OR (f AND {str(rule.hard).lower()}) AS h, c AND NOT (f AND {str(rule.holds).lower()}) AS c, CASE WHEN f THEN list_append(q, '{rule.name}') ELSE q END AS q) FROM (SELECT * EXCLUDE (f), coalesce({rule.fires.replace('datediff(expiry, as_of)', '(expiry - as_of)')}, false) AS f FROM (SELECT *, false AS f FROM ({inner})))"
        inner = f"SELECT * EXCLUDE (f) FROM ({inner})"
    return inner


EV_SQL = "e AS (SELECT k, " + ", ".join(f"{v.replace('STRING', 'VARCHAR')} AS {n}" for n, v in K.EVIDENCE.items() if n not in ("doc_type", "nation", "pan", "aadhaar", "aadhaar_valid", "aadhaar_from_ocr", "passport", "zone_valid", "dob", "expiry", "as_of", "identified", "validation", "tampering", "degraded", "hits")) + """, ['aadhaar','pan','passport','voter_id','nepali_citizenship','student_card'][CAST(k % 6 AS INTEGER) + 1] AS doc_type, ['IND','NPL','BTN','USA','MAR'][CAST(k % 5 AS INTEGER) + 1] AS nation,
    k % 3 > 0 AS pan, k % 4 = 0 AS aadhaar, k % 5 <> 0 AS aadhaar_valid, k % 8 = 0 AS aadhaar_from_ocr, k % 7 = 0 AS passport, CASE WHEN k % 14 = 0 THEN k % 28 = 0 END AS zone_valid, dob, expiry, DATE '2026-01-01' AS as_of, k % 3 > 0 AS identified, CASE WHEN k % 9 = 0 THEN 'FAIL' ELSE 'PASS' END AS validation, CASE WHEN k % 11 = 0 THEN 'REVIEW' ELSE 'PASS' END AS tampering, k % 13 = 0 AS degraded, CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END AS hits FROM ids)"""


def scored_sql(rules):
    return ids(f"WITH {EV_SQL} SELECT k, CAST(least(100, greatest(0, r)) AS INTEGER) AS risk, h AS hard_flag, c AS can_clear, array_to_string(q, ',') AS reasons, CASE WHEN h OR least(100, greatest(0, r)) > 55 THEN 'FLAGGED' WHEN NOT c OR least(100, greatest(0, r)) > 25 THEN 'REVIEW' ELSE 'CLEAR' END AS grade FROM ({fold_sql(rules, K.EVIDENCE)})")


def part(*names):
    return [r for r in K.RULES if r.name in names]


B15 = part("domestic_foreign", "nepal_foreign", "bhutan_foreign", "third_country", "zone_nation")
B18 = part("validation_failed", "unvalidated", "tampered", "soft_tamper", "tamper_review", "face_differs")
B19 = part("fallback_detector", "degraded_stage", "degraded_face", "face_review")


def scored(rules):
    return lambda s, d: K.score(cases(s, d), rules).select("k", "risk", "hard_flag", "can_clear", F.array_join("reasons", ",").alias("reasons"), "grade")


for name, rules in (("b15_nationality_rules", B15), ("b17_risk_rules", K.RULES), ("b18_module_rules", B18), ("b19_degraded_rules", B19)):
    add(name, scored(rules), scored_sql(rules))
add("b16_keyword_flags",
    lambda s, d: T(s, d, "pages").select("page_id", F.concat(F.element_at(F.array(*[F.lit(x) for x in ("a SPECIMEN card", "sampler", "not a real id", "Elon Musk")]), (F.col("page_id") % 4 + 1).cast("int")), F.lit(".")).alias("t")).select("page_id", F.col("t").rlike(K.SPECIMEN).alias("specimen"), F.exists(F.array(*[F.lit(p) for p in K.PUBLIC_FIGURES]), lambda p: F.contains(F.upper("t"), p)).alias("public_figure")),
    "SELECT page_id, page_id % 4 IN (0, 2) AS specimen, page_id % 4 = 3 AS public_figure FROM pages")
add("b25_face_decisions",
    lambda s, d: T(s, d, "part").select("p_partkey", K.face_decision(F.col("p_size") / 60, F.col("p_partkey") % 9, F.col("p_partkey") % 10 > 0).alias("x")).select("p_partkey", "x.*"),
    (
        "SELECT p_partkey, o AS decision, o = 'MATCH' AND p_size / 60 < 0.60 AS review FROM (SELECT *, CASE WHEN p_partkey % 10 = 0 THEN 'INCONCLUSIVE' WHEN p_size / 60 >= CASE WHEN "
        "p_partkey % 9 >= 5 THEN 0.52::DOUBLE ELSE 0.60::DOUBLE END THEN 'MATCH' WHEN p_size / 60 <= 0.40::DOUBLE THEN 'MISMATCH' ELSE 'INCONCLUSIVE' END AS o FROM part)"
    ))
add("b26_aged_thresholds",
    lambda s, d: T(s, d, "part").select("p_partkey", K.aged_threshold(F.col("p_size") / 4).alias("threshold")),
    "SELECT p_partkey, round(greatest(0.50::DOUBLE, 0.65::DOUBLE - least(p_size / 4 * 0.015::DOUBLE, 0.15::DOUBLE)), 3) AS threshold FROM part")
add("b28_class_filter",
    lambda s, d: K.class_filter(views.det_boxes(s, d), s.createDataFrame([("A", 0.7), ("R", 0.2)], "label string, threshold double"), 0.5).groupBy("label").agg(F.count("*").alias("n")),
    with_views("SELECT label, count(*) AS n FROM det_boxes WHERE confidence >= CASE label WHEN 'A' THEN 0.7::DOUBLE WHEN 'R' THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END GROUP BY 1", "det_boxes"))
add("b29_class_scores",
    lambda s, d: T(s, d, "part").select("p_partkey", K.tempered_softmax(F.array(*[(F.col("p_partkey") * m % 17 / 4.0) for m in (3, 5, 7)])).alias("x")).select("p_partkey", F.col("x.class").alias("class"), F.round("x.probability", 5).alias("probability"), "x.review"),
    (
        "SELECT p_partkey, CAST(list_position(v, m) - 1 AS INTEGER) AS class, round(round(1 / s, 6), 5) AS probability, 1 / s < 0.75 AS review FROM (SELECT *, list_sum(list_transform(v, "
        "lambda x: exp((x - m) / 1.35::DOUBLE))) AS s FROM (SELECT p_partkey, v, list_max(v) AS m FROM (SELECT p_partkey, [p_partkey * 3 % 17 / 4, p_partkey * 5 % 17 / 4, p_partkey "
        "* 7 % 17 / 4] AS v FROM part)))"
    ))
