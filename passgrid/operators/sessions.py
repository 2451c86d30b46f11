"""Sessions: document counts, cross-document comparison, settlement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifiers whose disagreement weighs more than that of a plain field.
PRIMARY = ["pan", "aadhaar", "passport", "driving_licence", "voter_id"]


def with_document_counts(sessions: DataFrame, reports: DataFrame) -> DataFrame:
    counts = reports.groupBy("session_id").agg(F.count("*").alias("n_documents"))
    return sessions.join(counts, "session_id", "left").withColumn("n_documents", F.coalesce("n_documents", F.lit(0)))


def session_documents(reports: DataFrame) -> DataFrame:
    """Documents of each session that are not removed, oldest first."""
    kept = reports.where(F.coalesce("removed", F.lit(0)) == 0)
    return kept.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id"))), lambda x: x["id"]).alias("documents"))


def field_digests(fields: DataFrame) -> DataFrame:
    """(session, document, field) with the value's digest and script; raw values do not go on."""
    from passgrid.functions.identifiers import norm

    return fields.select("session_id", "id", "field", F.sha2(norm(F.col("value")), 256).alias("h"), "script")


def digest_map(digests: DataFrame) -> DataFrame:
    """Per document a map of field to digest and script."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("field").alias("key"), F.struct("h", F.col("script").alias("s")).alias("value"))))
    return digests.groupBy("session_id", "id").agg(F.map_from_entries(entries).alias("digests"))


def compare_fields(digests: DataFrame) -> DataFrame:
    """Status of each field of a session over its documents, with the numbers of documents, values and scripts."""
    one = digests.groupBy("session_id", "field").agg(F.count("*").alias("n"), F.count_distinct("h").alias("values"), F.count_distinct("script").alias("scripts"))
    status = F.when(F.col("n") < 2, "single").when(F.col("values") == 1, "agree").when(F.col("scripts") > 1, "cross-script").otherwise("disagree")
    return one.withColumn("status", status)


# The fields that a session's documents are compared by.
COMPARED = ["name", "dob", "gender", "passport", "state", "pincode", "address"]


def rescued(compared: DataFrame, fields: DataFrame, bikram: Column | None = None) -> DataFrame:
    """Statuses after a second look at fields that differ within one script, and "none" for those on no document.

    Birth dates agree if they are one date in another writing, or one year; names if every two of them
    are one person's (by sound alone: phonetic-match); addresses if the session's pin codes agree.  Only
    fields that differ are looked at, and pairs are those of one session's documents.
    """
    from passgrid.functions import names as N
    from passgrid.operators.extraction import name_pairs

    open_ = compared.where("status = 'disagree'").select("session_id", "field")
    values = fields.join(open_, ["session_id", "field"]).select("session_id", "field", "id", "value")
    born = N.birth_text(F.col("value"), F.lit(False) if bikram is None else bikram)
    dates = values.where("field = 'dob'").groupBy("session_id", "field").agg(F.count_distinct(born).alias("dates"), F.count_distinct(F.left(born, F.lit(4))).alias("years"), F.min(F.length(born)).alias("least"))
    dates = dates.where("(dates = 1 AND least > 0) OR (years = 1 AND least >= 4)").select("session_id", "field", F.lit("agree").alias("better"))
    own = values.where("field = 'name'").select("session_id", "id", "value")
    pairs = own.join(own.select("session_id", F.col("id").alias("other"), F.col("value").alias("second")), "session_id").where("id < other").join(primary_ids_agree(fields), "session_id", "left")
    judged = name_pairs(pairs, "value", "second", F.coalesce("ids_agree", F.lit(False))).groupBy("session_id").agg(F.min("same").alias("same"), F.max((F.col("reason") == "sound").cast("int")).alias("sound"))
    named = judged.where("same").select("session_id", F.lit("name").alias("field"), F.when(F.col("sound") == 1, "phonetic-match").otherwise("agree").alias("better"))
    zoned = compared.where("field = 'pincode' AND status = 'agree'").select("session_id", F.lit("address").alias("field"), F.lit("agree").alias("better"))
    better = dates.unionByName(named).unionByName(zoned)
    seen = compared.join(better, ["session_id", "field"], "left").withColumn("status", F.when(F.col("status") == "disagree", F.coalesce("better", "status")).otherwise(F.col("status"))).select("session_id", "field", "status")
    absent = compared.groupBy("session_id").agg(F.array_except(F.array(*[F.lit(c) for c in COMPARED]), F.collect_set("field")).alias("f")).select("session_id", F.explode("f").alias("field"), F.lit("none").alias("status"))
    return seen.unionByName(absent)


def field_status(digests: DataFrame) -> DataFrame:
    """The statuses alone: least and greatest tell one value from several, in one partial aggregation."""
    several = lambda c: F.min(c) != F.max(c)
    status = F.when(F.count("*") < 2, "single").when(~several("h"), "agree").when(several("script"), "cross-script").otherwise("disagree")
    return digests.groupBy("session_id", "field").agg(status.alias("status"))


def bump(field: Column, status: Column) -> Column:
    return F.when(status != "disagree", 0).when(field.isin(*PRIMARY), 35).otherwise(30)


def compare_sessions(compared: DataFrame) -> DataFrame:
    """Verdict and addition to the risk of each session."""
    seen = lambda *s: F.max(F.col("status").isin(*s))
    out = compared.groupBy("session_id").agg(seen("disagree").alias("differs"), seen("agree", "single", "cross-script", "phonetic-match").alias("something"), F.sum(bump(F.col("field"), F.col("status"))).alias("risk_bump"))
    verdict = F.when(F.col("differs"), "DISCREPANCY").when(F.col("something"), "CONSISTENT").otherwise("INCOMPLETE")
    return out.select("session_id", verdict.alias("comparison_verdict"), "risk_bump")


def primary_ids_agree(fields: DataFrame) -> DataFrame:
    """Sessions in which some primary identifier is on two documents at least and equal on all."""
    from passgrid.functions.identifiers import norm

    v = fields.where(F.col("field").isin(*PRIMARY) & (F.length(F.trim("value")) >= 5)).select("session_id", "field", norm(F.col("value")).alias("v"))
    each = v.groupBy("session_id", "field").agg(((F.count("*") >= 2) & (F.count_distinct("v") == 1)).alias("same"))
    return each.groupBy("session_id").agg(F.max("same").alias("ids_agree"))


def session_risk(reports: DataFrame, compared: DataFrame) -> DataFrame:
    """The highest document risk and the comparison's addition, held between 0 and 100."""
    top = reports.where(F.coalesce("removed", F.lit(0)) == 0).groupBy("session_id").agg(F.max("risk_score").alias("max_risk"))
    risk = F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce("max_risk", F.lit(0)) + F.coalesce("risk_bump", F.lit(0))))
    return top.join(compared, "session_id", "left").select("session_id", "comparison_verdict", risk.cast("int").alias("session_risk"))


def settle(cases: DataFrame) -> DataFrame:
    """Decision table over ``action``, ``n_documents``, ``watchlisted``, ``comparison_verdict`` and ``decision``.

    Without documents a session is closed.  Flagging keeps it for review; approval is refused with a
    watchlist hit or a discrepancy; adjudication approves, or rejects with or without proof of fraud.
    """
    a = F.col("action")
    blocked = F.when(F.col("watchlisted"), "BLOCKED_WATCHLIST").when(F.col("comparison_verdict") == "DISCREPANCY", "BLOCKED_DISCREPANCY")
    closing = a.isin("close", "cancel", "dismiss") | ((F.col("n_documents") == 0) & a.isin("approve", "flag"))
    outcome = (
        F.when(closing, F.struct(F.lit("closed").alias("status"), F.lit("CLOSED").alias("verdict")))
        .when(a == "flag", F.struct(F.lit("flagged").alias("status"), F.lit("REVIEW").alias("verdict")))
        .when((a == "approve") & blocked.isNotNull(), F.struct(F.lit("open").alias("status"), blocked.alias("verdict")))
        .when(a == "approve", F.struct(F.lit("approved").alias("status"), F.lit("CLEAR").alias("verdict")))
        .when((a == "adjudicate") & (F.col("decision") == "CLEARED"), F.struct(F.lit("approved").alias("status"), F.lit("CLEAR").alias("verdict")))
        .when((a == "adjudicate") & (F.col("decision") == "CONFIRMED_FRAUD"), F.struct(F.lit("rejected").alias("status"), F.lit("FLAGGED").alias("verdict")))
        .when((a == "adjudicate") & (F.col("decision") == "INCONCLUSIVE"), F.struct(F.lit("rejected").alias("status"), F.lit("REVIEW").alias("verdict")))
        .otherwise(F.struct(F.lit("open").alias("status"), F.lit("INVALID").alias("verdict")))
    )
    return cases.withColumn("__o", outcome).withColumn("status", F.col("__o.status")).withColumn("verdict", F.col("__o.verdict")).drop("__o")


def wiped(fields: DataFrame, states: DataFrame) -> DataFrame:
    """Raw values only while their session is open."""
    return fields.join(states.select("session_id", "status"), "session_id").withColumn("value", F.when(F.col("status") == "open", F.col("value")))
