"""Risk scoring: ordered rules as data, and the verdicts around them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of forensic checks, nationality names, words that mark a specimen, public figures.
WEIGHTS = {
    "onnx-classifier": 1.2, "dual-stream-forgery": 1.0, "dual-stream-localized": 0.6, "ela": 1.0, "sensor-noise": 0.8, "copy-move-cloning": 0.9,
    "ai-generated-or-edited": 0.5, "spectral-analysis": 0.4, "focus": 0.2, "liveness": 0.2, "card-localization": 0.1, "medium": 0.1,
}
NATIONS = {
    "IN": "IND", "IND": "IND", "INDIA": "IND", "NP": "NPL", "NPL": "NPL", "NEPAL": "NPL", "BT": "BTN", "BTN": "BTN", "BHUTAN": "BTN",
    "BD": "BGD", "BGD": "BGD", "BANGLADESH": "BGD", "PK": "PAK", "PAK": "PAK", "PAKISTAN": "PAK", "CN": "CHN", "CHN": "CHN", "CHINA": "CHN",
    "US": "USA", "USA": "USA", "GB": "GBR", "UK": "GBR", "GBR": "GBR",
}
SPECIMEN = r"(?i)\b(?:fake|sample|specimen|dummy|chatgpt|dall-?e|midjourney|photoshop|counterfeit|meme|parody|not a real id|not a valid id|not for official use|stay alert)\b"
PUBLIC_FIGURES = ["CRISTIANO RONALDO", "LIONEL MESSI", "DONALD TRUMP", "BARACK OBAMA", "ELON MUSK"]
#: Verdict thresholds: rejection from 55, genuine up to 25, confidence from .75.
REJECT, GENUINE, CONFIDENT = 55, 25, 0.75


def decision(hard: Column, risk: Column, can_clear: Column, confidence: Column, verdict: Column) -> Column:
    reject = hard | (risk >= REJECT) | (verdict == "FLAGGED")
    review = ~can_clear | (risk > GENUINE) | F.coalesce(confidence < CONFIDENT, F.lit(False)) | (verdict == "REVIEW")
    return F.when(reject, "REJECT_LIKELY").when(review, "REVIEW").otherwise("GENUINE_LIKELY")


def evidence_confidence(fields: list[Column], declared: Column, hits: Column) -> Column:
    """.45 and up to .5 more with eight pieces of evidence, at most .98."""
    n = sum((F.when(F.coalesce(f.cast("string"), F.lit("")) != "", 1).otherwise(0) for f in fields), F.lit(0)) + declared.cast("int") + hits
    return F.round(F.least(F.lit(0.98), 0.45 + F.least(n, F.lit(8)) / 8 * 0.5), 2)


def unmeasurable(kind: Column, has_zone: Column, has_live: Column, has_back: Column, has_code: Column) -> Column:
    travel = kind.isin("passport", "visa")
    return F.array_compact(F.array(
        F.when(~travel, "no zone on this type").when(~has_zone, "zone unreadable"), F.when(~has_live, "no live capture"), F.when(~has_back, "no reverse side"), F.when(~has_code, "no code"),
    ))


def travel_validity(expiry: Column, dob: Column, as_of: Column) -> Column:
    """Days to expiry, the six-month rule, age in years of 365 days, and a status; against ``as_of``, never the clock."""
    days = F.datediff(expiry, as_of)
    status = F.when(days.isNull(), "UNKNOWN").when(days < 0, "EXPIRED").when(days < 180, "EXPIRING_SOON").otherwise("VALID")
    return F.struct(days.alias("days_to_expiry"), (days >= 180).alias("six_month_rule"), F.floor(F.datediff(as_of, dob) / 365).cast("int").alias("age"), status.alias("status"))


def weighted_verdict(df: DataFrame, key: str) -> DataFrame:
    """From rows (key, label, ok): FAIL at failing weight 1.3, REVIEW with any failure or passing weight under 1, else PASS."""
    table = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    name = F.when(F.col("label").startswith("liveness-"), "liveness").otherwise(F.col("label"))
    weighed = df.withColumn("w", F.coalesce(F.try_element_at(table, name), F.lit(0.5)))
    s = weighed.groupBy(key).agg(F.round(F.sum(F.when(~F.col("ok"), F.col("w")).otherwise(0.0)), 6).alias("fail"), F.round(F.sum(F.when(F.col("ok"), F.col("w")).otherwise(0.0)), 6).alias("passed"))
    return s.withColumn("verdict", F.when(F.col("fail") >= 1.3, "FAIL").when((F.col("fail") > 0) | (F.col("passed") < 1.0), "REVIEW").otherwise("PASS"))


def cross_field_checks(issue: Column, expiry: Column, dob: Column, name: Column, zone_name: Column, as_of: Column) -> Column:
    """Issue before expiry, a possible birth date, and names that share a word; absent parts give no check."""
    words = lambda c: F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit("[A-Z]{2,}"), F.lit(0))
    age = F.year(as_of) - F.year(dob)
    check = lambda cond, label, ok: F.when(cond, F.struct(F.lit(label).alias("label"), ok.alias("ok")))
    return F.array_compact(F.array(
        check(issue.isNotNull() & expiry.isNotNull(), "cross-field-temporal", issue < expiry),
        check(dob.isNotNull(), "cross-field-dob", (dob <= as_of) & age.between(0, 125)),
        check((F.size(words(name)) > 0) & (F.size(words(zone_name)) > 0), "cross-field-name-mrz", F.arrays_overlap(words(name), words(zone_name))),
    ))


def expiry_check(raw: Column, parsed: Column, kind: Column, as_of: Column) -> Column:
    """True or false for a readable date; undecided where one is needed and unreadable; null where nothing is said."""
    ok = F.when(parsed.isNotNull(), parsed >= as_of)
    return F.when(parsed.isNotNull() | (kind.isin("driving_licence", "passport") & (F.trim(raw) != "")), F.struct(F.lit("expiry").alias("label"), ok.alias("ok")))


def inferred_type(declared: Column, fields: dict[str, Column], predicted: Column, confidence: Column) -> Column:
    """The declared type; if generic, what the classifier is sure of, else what the numbers found say."""
    order = ["aadhaar", "pan", "driving_licence", "voter_id", "passport"]
    from_fields = F.coalesce(*[F.when(fields[k].isNotNull() & (fields[k] != ""), k) for k in order if k in fields])
    return F.when(~F.coalesce(F.lower(F.trim(declared)), F.lit("")).isin("", "other", "unknown"), declared).otherwise(F.coalesce(F.when(confidence >= 0.6, predicted), from_fields, F.lit("other")))


def nation(c: Column) -> Column:
    up = F.upper(F.trim(c))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in NATIONS.items() for x in kv]), up), F.left(up, F.lit(3)))


def face_decision(similarity: Column, age_years: Column, embedded: Column) -> Column:
    """MATCH from .60 (.52 for photographs of five years and more), MISMATCH up to .40, else undecided; hashes never decide.
    A match below .60 is for review."""
    least = F.when(age_years >= 5, 0.52).otherwise(0.60)
    out = F.when(~embedded, "INCONCLUSIVE").when(similarity >= least, "MATCH").when(similarity <= 0.40, "MISMATCH").otherwise("INCONCLUSIVE")
    return F.struct(out.alias("decision"), ((out == "MATCH") & (similarity < 0.60)).alias("review"))


def aged_threshold(years: Column) -> Column:
    return F.round(F.greatest(F.lit(0.50), 0.65 - F.least(years * 0.015, F.lit(0.15))), 3)


def class_filter(dets: DataFrame, thresholds: DataFrame, default: float) -> DataFrame:
    """Detections at or above their class's confidence, or the default."""
    own = thresholds.select("label", F.col("threshold").alias("__t"))
    return dets.join(own, "label", "left").where(F.col("confidence") >= F.coalesce("__t", F.lit(default))).drop("__t")


def tempered_softmax(scores: Column, temperature: float = 1.35, review: float = 0.75) -> Column:
    """Class (from 0), its probability, and whether it needs review."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp((x - top) / temperature))
    p = 1 / F.aggregate(e, F.lit(0.0), lambda s, x: s + x)  # the top's exponential is 1
    return F.struct((F.array_position(scores, top) - 1).cast("int").alias("class"), F.round(p, 6).alias("probability"), (p < review).alias("review"))


@dataclass(frozen=True)
class Rule:
    """``fires`` over the evidence; then risk = max(risk + add, floor), and the marks."""

    name: str
    fires: str
    add: int = 0
    floor: int = 0
    hard: bool = False
    holds: bool = False


CRITICAL = {"hard": True, "holds": True}
#: The rules in order; max-then-add does not commute.  Conditions are SQL over the evidence columns of ``score``.
RULES = [
    Rule("manual_entry", "NOT identified AND NOT ocr_ran", floor=40, holds=True),
    Rule("unrecognised", "NOT identified AND ocr_ran", floor=80, **CRITICAL),
    Rule("pan_read", "pan", add=-3),
    Rule("pan_unread", "NOT pan AND doc_type LIKE '%pan%'", floor=30, holds=True),
    Rule("licence_read", "licence", add=-3),
    Rule("licence_unread", "NOT licence AND doc_type LIKE '%driving%'", floor=30, holds=True),
    Rule("aadhaar_misread", "aadhaar AND NOT aadhaar_valid AND aadhaar_from_ocr", floor=45, holds=True),
    Rule("aadhaar_forged", "aadhaar AND NOT aadhaar_valid AND NOT aadhaar_from_ocr", add=65, floor=90, **CRITICAL),
    Rule("aadhaar_read", "aadhaar AND aadhaar_valid", add=-3),
    Rule("aadhaar_unread", "NOT aadhaar AND doc_type LIKE '%aadhaar%'", floor=30, holds=True),
    Rule("specimen", "specimen", add=70, floor=95, **CRITICAL),
    Rule("public_figure", "public_figure", add=70, floor=95, **CRITICAL),
    Rule("voter_read", "voter", add=-3),
    Rule("voter_unread", "NOT voter AND doc_type LIKE '%voter%'", floor=30, holds=True),
    Rule("zone_valid", "passport AND zone_valid", add=-6),
    Rule("zone_blurred", "passport AND NOT zone_valid AND is_photo", floor=50, holds=True),
    Rule("zone_forged", "passport AND NOT zone_valid AND NOT is_photo", add=45, floor=75, **CRITICAL),
    Rule("zone_absent", "passport AND zone_valid IS NULL", add=10, holds=True),
    Rule("passport_unread", "NOT passport AND (doc_type LIKE '%passport%' OR doc_type LIKE '%visa%')", floor=35, holds=True),
    Rule("born_later", "dob > as_of", add=40, floor=70, **CRITICAL),
    Rule("child_passport", "dob <= as_of AND year(dob) >= 2000 AND passport", add=6),
    Rule("expired", "expiry < as_of", add=45, floor=80, **CRITICAL),
    Rule("expires_soon", "datediff(expiry, as_of) BETWEEN 0 AND 179", add=6),
    Rule("domestic_foreign", "doc_type IN ('aadhaar', 'pan', 'voter_id', 'driving_licence') AND nation NOT IN ('IND', 'UNKNOWN', '')", add=55, floor=85, **CRITICAL),
    Rule("nepal_foreign", "doc_type = 'nepali_citizenship' AND nation NOT IN ('NPL', 'UNKNOWN', '')", add=55, floor=85, **CRITICAL),
    Rule("bhutan_foreign", "doc_type = 'bhutan_citizenship' AND nation NOT IN ('BTN', 'UNKNOWN', '')", add=55, floor=85, **CRITICAL),
    Rule("third_country", "doc_type NOT IN ('aadhaar', 'pan', 'voter_id', 'driving_licence', 'nepali_citizenship', 'bhutan_citizenship', 'passport', 'visa') AND nation NOT IN ('IND', 'NPL', 'BTN', 'UNKNOWN', '')", add=60, floor=88, **CRITICAL),
    Rule("zone_nation", "doc_type = 'passport' AND zone_nation <> '' AND nation NOT IN ('UNKNOWN', '') AND zone_nation <> nation", add=55, floor=85, **CRITICAL),
    Rule("no_text_layer", "no_text_layer", add=8, holds=True),
    Rule("validation_failed", "validation = 'FAIL'", add=35, floor=70, **CRITICAL),
    Rule("unvalidated", "validation = 'UNVERIFIED'", floor=30, holds=True),
    Rule("tampered", "tampering = 'FAIL' AND real_tamper", add=55, floor=82, **CRITICAL),
    Rule("soft_tamper", "tampering = 'FAIL' AND NOT real_tamper", floor=25),
    Rule("tamper_review", "tampering = 'REVIEW'", floor=25),
    Rule("face_differs", "face = 'FAIL'", add=55, floor=82, **CRITICAL),
    Rule("fallback_detector", "fallback", floor=30, holds=True),
    Rule("degraded_stage", "degraded", floor=30, holds=True),
    Rule("degraded_face", "live AND face_mode IS NOT NULL AND face_mode <> 'embedding'", floor=30, holds=True),
    Rule("face_review", "live AND (face_mode IS NULL OR face_mode = 'embedding') AND face = 'REVIEW'", floor=30, holds=True),
    Rule("watchlisted", "hits > 0", add=60, floor=90, **CRITICAL),
    Rule("nothing_read", "NOT identified", floor=40, holds=True),
    Rule("name_differs", "same_name = false", add=18, holds=True),
]
#: Evidence columns and what stands for a missing one.
EVIDENCE = {
    "identified": "false", "ocr_ran": "true", "doc_type": "''", "pan": "false", "licence": "false", "aadhaar": "false", "aadhaar_valid": "false", "aadhaar_from_ocr": "false", "specimen": "false", "public_figure": "false",
    "voter": "false", "passport": "false", "zone_valid": "CAST(NULL AS BOOLEAN)", "is_photo": "false", "dob": "CAST(NULL AS DATE)", "expiry": "CAST(NULL AS DATE)", "as_of": "CAST(NULL AS DATE)", "nation": "''", "zone_nation": "''",
    "no_text_layer": "false", "validation": "'PASS'", "tampering": "'PASS'", "real_tamper": "false", "face": "'PASS'", "fallback": "false", "degraded": "false", "live": "false", "face_mode": "CAST(NULL AS STRING)", "hits": "0", "same_name": "CAST(NULL AS BOOLEAN)",
}


def score(df: DataFrame, rules: list[Rule] | None = None, start: int = 20) -> DataFrame:
    """Fold the rules over each row's evidence: ``risk`` (0 to 100), ``hard_flag``, ``can_clear``, ``reasons`` in order, ``grade``.

    Missing evidence columns take their neutral value; one expression, no shuffle, whatever the number of rules.
    """
    from passgrid.sources.views import grade

    rules = RULES if rules is None else rules
    full = df.withColumns({k: F.expr(v) for k, v in EVIDENCE.items() if k not in df.columns})
    fired = F.array_compact(F.array(*[
        F.when(F.expr(r.fires), F.struct(F.lit(r.name).alias("name"), F.lit(r.add).alias("add"), F.lit(r.floor).alias("floor"), F.lit(r.hard).alias("hard"), F.lit(r.holds).alias("holds"))) for r in rules
    ]))
    full = full.withColumn("__f", fired)
    risk = F.aggregate("__f", F.lit(start), lambda s, r: F.greatest(s + r["add"], r["floor"]))
    out = full.withColumn("risk", F.least(F.lit(100), F.greatest(F.lit(0), risk))).withColumn("hard_flag", F.exists("__f", lambda r: r["hard"])).withColumn("can_clear", ~F.exists("__f", lambda r: r["holds"]))
    out = out.withColumn("reasons", F.transform("__f", lambda r: r["name"])).withColumn("grade", grade(F.col("risk"), F.col("hard_flag"), F.col("can_clear")))
    return out.select(*df.columns, "risk", "hard_flag", "can_clear", "reasons", "grade")
