"""Row filters, limits, labels and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newest(df: DataFrame, limit: int, order: list[str], most: int | None = None) -> DataFrame:
    """The first rows by falling order; the limit is at least 1 and at most ``most``."""
    n = max(1, limit if most is None else min(limit, most))
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def visible_to(df: DataFrame, who: str, role: str) -> DataFrame:
    """A supervisor sees all rows, an officer their own."""
    return df if role == "supervisor" else df.where(F.col("screener") == who)


def pending(df: DataFrame) -> DataFrame:
    return df.where(F.col("adjudication").isNull() & (F.col("verdict") != "CLEAR"))


def not_removed(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce("removed", F.lit(0)) == 0)


def restore(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Undo the removal of the ids given."""
    back = ids.select("id").distinct().withColumn("__back", F.lit(True))
    return df.join(back, "id", "left").withColumn("removed", F.when(F.col("__back"), 0).otherwise(F.col("removed"))).drop("__back")


def search(df: DataFrame, columns: list[str], query: str, equal: dict[str, str] | None = None, band: str | None = None) -> DataFrame:
    """Rows with the query in any column (case ignored), equal filters and a risk band (HIGH from 60, MED from 30)."""
    hit = reduce(lambda a, b: a | b, [F.lower(F.col(c).cast("string")).contains(query.lower()) for c in columns])
    out = df.where(hit)
    for c, v in (equal or {}).items():
        out = out.where(F.col(c) == v)
    risk = F.col("risk_score")
    bands = {"HIGH": risk >= 60, "MED": (risk >= 30) & (risk < 60), "LOW": risk < 30}
    return out.where(bands[band]) if band else out


def ledger_order(df: DataFrame, mode: str) -> DataFrame:
    """Sort by time, risk, natural label (its number) or number of documents."""
    keys = {"time": [F.col("created_at").desc()], "risk": [F.col("risk_score").desc()], "label": [F.regexp_extract("label", "[0-9]+", 0).try_cast("int")], "documents": [F.col("n_documents").desc()]}
    return df.orderBy(*keys[mode], F.col("session_id"))


def local_day(c: str = "created_at", zone: str = "Asia/Kolkata"):
    return F.date_format(F.from_utc_timestamp(c, zone), "yyyy-MM-dd")


def day_labels(sessions: DataFrame) -> DataFrame:
    """Number sessions within their local day, oldest first."""
    number = F.row_number().over(W.partitionBy("day").orderBy("created_at", "session_id"))
    return sessions.withColumn("day", local_day()).withColumn("number", number).withColumn("label", F.concat(F.lit("Session "), F.col("number").cast("string")))


def lowest_free_label(labelled: DataFrame) -> DataFrame:
    """Per day the lowest number that no open session holds: where the k-th number in use is not k."""
    used = labelled.where("status = 'open'").select("day", "number").distinct()
    placed = used.withColumn("place", F.row_number().over(W.partitionBy("day").orderBy("number")))
    gap = placed.groupBy("day").agg(F.min(F.when(F.col("number") != F.col("place"), F.col("place"))).alias("gap"), F.count("*").alias("n"))
    return labelled.select("day").distinct().join(gap, "day", "left").select("day", F.coalesce(F.col("gap").cast("long"), F.col("n") + 1, F.lit(1)).alias("next_number"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key: a maximum with partial sums, no sort of whole groups."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("row"))
    return best.select("row.*")


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__rank") <= k).drop("__rank")
