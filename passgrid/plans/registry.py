"""All registered queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passgrid.plans import evalkit, identifiers, links, risk, stats, streams

BOOKS = [stats.BOOK, links.BOOK, identifiers.BOOK, evalkit.BOOK, risk.BOOK, streams.BOOK]
QUERIES = {k: v for b in BOOKS for k, v in b.queries.items()}
ORACLE_SQL = {k: v for b in BOOKS for k, v in b.sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_alerts"](spark, sf_dir)
