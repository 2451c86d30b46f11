"""Operational statistics over reports and sessions; every function is DataFrame -> DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passgrid.sources.shared import written


def label(c: str, default: str) -> Column:
    """A trimmed text, or the default where it is null or blank."""
    t = F.trim(F.col(c))
    return F.when(t != "", t).otherwise(default)


def risk_bucket(risk: Column) -> Column:
    return F.when(risk.isNull(), "Unknown").when(risk <= 25, "0-25 (low)").when(risk <= 55, "26-55 (watch)").otherwise("56-100 (critical)")


def public_verdict(verdict: Column, adjudication: Column) -> Column:
    """Adjudication first; an inconclusive one does not change a clear report."""
    return (
        F.when(adjudication == "CONFIRMED_FRAUD", "PROVEN_FAKE")
        .when(adjudication == "CLEARED", "AUTHENTIC")
        .when(verdict == "CLEAR", "AUTHENTIC")
        .when((verdict == "FLAGGED") | (adjudication == "INCONCLUSIVE"), "PROVEN_FAKE")
        .otherwise("UNSIGNED")
    )


def module_verdict(json: Column, module: str) -> Column:
    """A module's verdict from either stored shape (text or object); N/A for none and for bad JSON."""
    parsed = F.try_parse_json(json)
    leaf = F.try_variant_get(parsed, f"$.{module}.verdict", "string")
    text = F.try_variant_get(parsed, f"$.{module}", "string")
    return F.when(F.coalesce(leaf, F.when(~text.startswith("{"), text), F.lit("")) == "", "N/A").otherwise(F.coalesce(leaf, text))


def flagged(c: str = "verdict") -> Column:
    return F.sum((F.upper(F.coalesce(F.col(c), F.lit("UNKNOWN"))) == "FLAGGED").cast("long"))


def verdict_funnel(reports: DataFrame) -> DataFrame:
    return reports.groupBy(F.upper(F.coalesce("verdict", F.lit("UNKNOWN"))).alias("verdict")).agg(F.count("*").alias("n"))


def risk_histogram(reports: DataFrame) -> DataFrame:
    return reports.groupBy(risk_bucket(F.col("risk_score")).alias("bucket")).agg(F.count("*").alias("n"))


def by_doc_type(reports: DataFrame) -> DataFrame:
    return reports.groupBy(label("doc_type", "other").alias("doc_type")).agg(F.count("*").alias("n"), flagged().alias("flagged"), F.round(F.avg(F.coalesce("risk_score", F.lit(0))), 1).alias("avg_risk"))


def by_checkpoint_and_officer(reports: DataFrame) -> DataFrame:
    """Counts per checkpoint, per officer and in all, in one pass."""
    named = reports.select(label("checkpoint", "unspecified").alias("checkpoint"), label("screener", "unknown").alias("screener"), "verdict")
    sets = named.groupingSets([["checkpoint"], ["screener"], []], "checkpoint", "screener")
    return sets.agg(F.count("*").alias("n"), flagged().alias("flagged"))


def module_counts(reports: DataFrame, modules: tuple[str, ...] = ("validation", "tampering", "face")) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("module"), module_verdict(F.col("modules"), m).alias("verdict")) for m in modules]))
    return reports.select(each.alias("m")).groupBy("m.module", "m.verdict").agg(F.count("*").alias("n"))


def _ai() -> tuple[Column, Column, Column]:
    """Whether the detector ran, whether it suspects, and its score."""
    ai = F.try_parse_json("ai_detection")
    ran = F.coalesce(F.try_variant_get(ai, "$.ran", "boolean"), F.lit(False))
    return ran, ran & F.coalesce(F.try_variant_get(ai, "$.ai_suspected", "boolean"), F.lit(False)), F.coalesce(F.try_variant_get(ai, "$.ai_score", "double"), F.lit(0.0))


def ai_summary(reports: DataFrame) -> DataFrame:
    ran, suspected, score = _ai()
    one = reports.agg(F.sum(ran.cast("long")).alias("ran"), F.sum(suspected.cast("long")).alias("suspected"), F.sum(F.when(ran, score).otherwise(0.0)).alias("score_sum"))
    return one.withColumn("suspicion_rate", F.round(F.col("suspected") / F.greatest(F.lit(1), F.col("ran")), 3))


def latency_summary(reports: DataFrame) -> DataFrame:
    """Truncated figures over positive latencies; p50 is the value at n//2, p95 that at int(.95 n)-1, from 0.

    Values (whole milliseconds) are counted first, so that the ordered part is the distinct values and not the rows.
    """
    return _latency(reports.where("latency_ms > 0").groupBy("latency_ms").agg(F.count("*").alias("n")))


def _latency(counted: DataFrame) -> DataFrame:
    total = counted.agg(F.sum("n").alias("total"), F.min("latency_ms").alias("min"), F.max("latency_ms").alias("max"), F.sum(F.col("n") * F.col("latency_ms")).alias("sum"))
    placed = counted.withColumn("upto", F.sum("n").over(W.orderBy("latency_ms").rowsBetween(W.unboundedPreceding, 0))).crossJoin(F.broadcast(total))  # one row
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("latency_ms")))
    return placed.groupBy("total", "min", "max", "sum").agg(
        F.floor(F.col("sum") / F.col("total")).alias("avg"), at(F.floor(F.col("total") / 2)).alias("p50"), at(F.floor(F.col("total") * 0.95) - 1).alias("p95")
    ).select(F.col("min").cast("long"), F.col("max").cast("long"), "sum", "avg", F.col("p50").cast("long"), F.col("p95").cast("long"))


def hourly_local(reports: DataFrame, zone: str = "Asia/Kolkata") -> DataFrame:
    """Reports per local hour, all 24 hours."""
    spark = reports.sparkSession
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    counted = reports.groupBy(F.hour(F.from_utc_timestamp("created_at", zone)).alias("hour")).agg(F.count("*").alias("n"))
    return hours.join(counted, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def daily(reports: DataFrame) -> DataFrame:
    return reports.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def session_summary(sessions: DataFrame) -> DataFrame:
    """Counts by status, verdict and checkpoint, and one row of totals, as (metric, key, value)."""
    verdict = F.upper(F.coalesce("verdict", F.lit("PENDING")))
    keyed = sessions.select(F.lower(F.coalesce("status", F.lit("unknown"))).alias("status"), verdict.alias("verdict"), label("checkpoint", "unspecified").alias("checkpoint"), F.coalesce("risk_score", F.lit(0)).alias("risk"))
    counts = keyed.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("key")) for c in ("status", "verdict", "checkpoint")])).alias("x")).groupBy("x.metric", "x.key").agg(F.count("*").cast("double").alias("value"))
    total = keyed.agg(
        F.sum(F.when(F.col("verdict") == "CLEAR", 1).otherwise(0)).cast("double").alias("cleared"), F.sum(F.when(F.col("verdict").isin("FLAGGED", "REVIEW"), 1).otherwise(0)).cast("double").alias("flagged"),
        F.round(F.avg("risk"), 1).alias("avg_session_risk"), F.count("*").cast("double").alias("total_sessions"),
    )
    return counts.unionByName(total.unpivot([], ["cleared", "flagged", "avg_session_risk", "total_sessions"], "key", "value").select(F.lit("total").alias("metric"), "key", "value"))


def throughput(reports: DataFrame, sessions: DataFrame, minutes: int = 60) -> DataFrame:
    """Screens and closed sessions in the last minutes before the newest report."""
    as_of = reports.agg(F.max("created_at").alias("as_of"))  # one row
    recent = lambda df, c: df.crossJoin(F.broadcast(as_of)).where(F.unix_timestamp(c) >= F.unix_timestamp("as_of") - minutes * 60)
    screens = recent(reports, "created_at").agg(F.count("*").alias("screens"))
    closed = recent(sessions, "closed_at").agg(F.count("*").alias("sessions_closed"))
    return screens.crossJoin(closed).select(F.lit(minutes).alias("window_minutes"), "screens", "sessions_closed", F.round(F.col("screens") / minutes, 3).alias("per_minute"))


def overview(reports: DataFrame, sessions: DataFrame, minutes: int = 60) -> DataFrame:
    """All statistics above as long rows (metric, key, value).

    Reports are read once for all their counts: each row gives its keys, which are counted where it
    lies; the counted table (kinds, days, whole milliseconds) is written, and what follows reads it.  A
    second pass, over times alone, counts the screens of the last minutes; sessions are read once.
    """
    modules = ("validation", "tampering", "face")
    ran, suspected, score = _ai()
    keys = {
        "verdict": F.upper(F.coalesce("verdict", F.lit("UNKNOWN"))), "risk": risk_bucket(F.col("risk_score")), "doc_type": label("doc_type", "other"), "day": F.date_format("created_at", "yyyy-MM-dd"),
        "hour": F.hour(F.from_utc_timestamp("created_at", "Asia/Kolkata")).cast("string"), "checkpoint": label("checkpoint", "unspecified"), "officer": label("screener", "unknown"),
        **{f"module_{m}": module_verdict(F.col("modules"), m) for m in modules}, "latency": F.when(F.col("latency_ms") > 0, F.col("latency_ms").cast("string")),
    }
    entry = lambda metric, key, value: F.struct(F.lit(metric).alias("metric"), key.alias("key"), value.cast("double").alias("value"))
    one, flag = F.lit(1), lambda of: F.when(of, 1)
    flags = [entry("ai", F.lit("ran"), flag(ran)), entry("ai", F.lit("suspected"), flag(suspected)), entry("ai", F.lit("score_sum"), F.when(ran, score)), entry("total", F.lit("total_screens"), one), entry("total", F.lit("flagged_count"), flag(F.col("verdict") == "FLAGGED"))]
    newest = entry("newest", F.lit("newest"), F.unix_timestamp("created_at"))

    def counts(df: DataFrame, entries: list[Column]) -> DataFrame:
        each = df.select(F.explode(F.array(*entries)).alias("x")).where("x.key IS NOT NULL AND x.value IS NOT NULL")
        return each.groupBy("x.metric", "x.key").agg(F.when(F.col("metric") == "newest", F.max("x.value")).otherwise(F.sum("x.value")).alias("value"))

    counted = written(counts(reports, [*[entry(m, k, one) for m, k in keys.items()], *flags, newest]), "overview")
    as_of = counted.where("metric = 'newest'").select("value").first()
    recent = lambda c: F.unix_timestamp(c) >= F.lit((as_of[0] if as_of else 0) - minutes * 60)
    verdict = F.upper(F.coalesce("verdict", F.lit("PENDING")))
    total = lambda key, value: entry("session_total", F.lit(key), value)
    kinds = {"status": F.lower(F.coalesce("status", F.lit("unknown"))), "verdict": verdict, "checkpoint": label("checkpoint", "unspecified")}
    totals = [total("cleared", (verdict == "CLEAR").cast("int")), total("flagged", verdict.isin("FLAGGED", "REVIEW").cast("int")), total("risk", F.coalesce("risk_score", F.lit(0))), total("total_sessions", one), entry("throughput", F.lit("sessions_closed"), F.coalesce(recent("closed_at"), F.lit(False)).cast("int"))]
    of_sessions = written(counts(sessions, [*[entry(f"session_{m}", k, one) for m, k in kinds.items()], *totals]), "overview-sessions")
    screens = reports.where(recent("created_at")).agg(F.count("*").cast("double").alias("screens"), F.lit(float(minutes)).alias("window_minutes"), F.round(F.count("*") / minutes, 3).alias("per_minute"))
    long = lambda df, metric: df.select(*[F.col(c).cast("double").alias(c) for c in df.columns]).unpivot([], df.columns, "key", "value").select(F.lit(metric).alias("metric"), "key", "value")
    hours = reports.sparkSession.range(24).select(F.lit("hour").alias("metric"), F.col("id").cast("string").alias("key")).join(counted.where("metric = 'hour'"), ["metric", "key"], "left").select("metric", "key", F.coalesce("value", F.lit(0.0)).alias("value"))
    of = lambda key: F.coalesce(F.max(F.when(F.col("key") == key, F.col("value"))), F.lit(0.0))
    rate = counted.where("metric = 'ai'").agg(F.round(of("suspected") / F.greatest(F.lit(1.0), of("ran")), 3).alias("value")).select(F.lit("ai").alias("metric"), F.lit("suspicion_rate").alias("key"), "value")
    risk = of_sessions.where("metric = 'session_total'").agg(F.round(of("risk") / of("total_sessions"), 1).alias("value")).select(F.lit("session_total").alias("metric"), F.lit("avg_session_risk").alias("key"), "value")
    rows = [
        counted.where("metric NOT IN ('hour', 'latency', 'newest')"), hours, rate,
        long(_latency(counted.where("metric = 'latency'").select(F.col("key").cast("int").alias("latency_ms"), F.col("value").cast("long").alias("n"))), "latency"),
        of_sessions.where("key <> 'risk' OR metric <> 'session_total'"), risk, long(screens, "throughput"),
    ]
    return reduce(DataFrame.unionByName, rows)


def public_summary(reports: DataFrame, notices: DataFrame) -> DataFrame:
    """Public verdict mix with latency figures (positive ones only), and how many notices are revoked."""
    lat = F.when(F.col("latency_ms") > 0, F.col("latency_ms"))
    mix = reports.groupBy(public_verdict(F.col("verdict"), F.col("adjudication")).alias("kind")).agg(F.count("*").alias("n"), F.count(lat).alias("samples"), F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"), F.floor(F.avg(lat)).alias("lat_avg"))
    revoked = notices.where("revoked").agg(F.count("*").alias("n")).select(F.lit("REVOKED").alias("kind"), "n", F.lit(0).cast("long").alias("samples"))
    return mix.unionByName(revoked, allowMissingColumns=True)