"""Links between records: watchlist, recidivism, bursts, catalogs, notices."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passgrid.sources.shared import written

# What travellers of a nationality are expected to present.
EXPECTED = {
    "IN": ["passport", "aadhaar", "driving_licence", "voter_id", "pan"],
    "NP": ["passport", "nepali_citizenship"],
    "BT": ["passport", "bhutan_citizenship"],
    "UNKNOWN": ["passport", "visa"],
}
# Clusters of checkpoints, their mode and places.
CLUSTERS = {
    ("LAND_NEPAL", "land"): [
        "Sunauli", "Raxaul", "Jogbani", "Rupaidiha", "Banbasa", "Barhni", "Gauriphanta", "Panitanki", "Galgalia", "Raniganj", "Bhitthamore",
        "Nautanwa", "Katauna", "Rajganj", "Bhimnagar", "Thakurganj", "Sanauli", "Laukaha", "Bathnaha", "Sursand",
    ],
    ("LAND_BHUTAN", "land"): ["Jaigaon", "Uttarkanya", "Samdrup Jongkhar (Darranga)", "Gelephu", "Sarbhang", "Rangla", "Chakung", "Kakarbhitta (Panitanki)"],
    ("AIR", "air"): ["IGI Delhi", "Kolkata Netaji", "Patna Jay Prakash", "Varanasi", "Guwahati", "Bagdogra", "Gaya", "Lucknow", "Mumbai T2", "Hyderabad"],
    ("SEA", "sea"): ["Kolkata Port", "Haldia", "Paradip"],
    ("RAIL", "rail"): ["Raxaul Rail", "Jogbani Rail", "Nautanwa Rail", "Bathnaha Rail"],
}
#: Additions to the risk score by kind of alert.
BUMPS = {"NAME_CLASH": 35, "DOB_CLASH": 35, "CROSS_CHECKPOINT": 25, "PREVIOUSLY_FLAGGED": 20, "SECTOR_BURST": 10}


def identifier_rows(df: DataFrame, key: str, identifiers: list[str]) -> DataFrame:
    """(key, field, value, identifier_hash) for every non-empty identifier; hashes are of the normalised value."""
    from passgrid.functions.identifiers import norm

    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in identifiers]))
    rows = df.select(key, each.alias("i")).select(key, "i.field", "i.value").where(norm(F.col("value")) != "")
    return rows.withColumn("identifier_hash", F.sha2(norm(F.col("value")), 256))


def watchlist_hits(identifiers: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Identifiers on the list; Spark broadcasts the list if it is small enough, else it joins by hash."""
    return identifiers.join(watchlist.select("identifier_hash", "mask", "category"), "identifier_hash")


def watchlist_misses(identifiers: DataFrame, watchlist: DataFrame) -> DataFrame:
    return identifiers.join(watchlist, "identifier_hash", "left_anti")


def watchlist_add(watchlist: DataFrame, new: DataFrame) -> DataFrame:
    """Entries whose hash is not there yet are appended, each hash once."""
    fresh = new.dropDuplicates(["identifier_hash"]).join(watchlist, "identifier_hash", "left_anti")
    return watchlist.unionByName(fresh.select(*watchlist.columns))


def watchlist_remove(watchlist: DataFrame, hashes: DataFrame) -> DataFrame:
    return watchlist.join(hashes, "identifier_hash", "left_anti")


def prior_matches(reports: DataFrame) -> DataFrame:
    """Pairs of a report and an earlier one (time, then id) of the same document number and another file.

    Joined on the hash of the number, never on masks.
    """
    cols = ["id", "created_at", "file_hash", "checkpoint", "name", "dob", "verdict"]
    keyed = reports.where(F.length("doc_no") >= 5).select(*cols, F.sha2("doc_no", 256).alias("k"))
    prior = keyed.select("k", *[F.col(c).alias(f"prior_{c}") for c in cols])
    earlier = (F.col("prior_created_at") < F.col("created_at")) | ((F.col("prior_created_at") == F.col("created_at")) & (F.col("prior_id") < F.col("id")))
    return keyed.join(prior, "k").where(earlier & (F.col("prior_file_hash") != F.col("file_hash")))


def recidivism_alerts(reports: DataFrame) -> DataFrame:
    """One row per alert: id, prior_id, checkpoint, kind, bump."""
    m = prior_matches(reports)
    crossing = F.col("checkpoint") != F.col("prior_checkpoint")
    kinds = F.array_compact(F.array(
        F.when(F.col("name") != F.col("prior_name"), "NAME_CLASH"),
        F.when(F.col("dob") != F.col("prior_dob"), "DOB_CLASH"),
        F.when(crossing, "CROSS_CHECKPOINT").when(F.col("prior_verdict").isin("FLAGGED", "REVIEW"), "PREVIOUSLY_FLAGGED"),
    ))
    return m.select("id", "prior_id", "checkpoint", F.explode(kinds).alias("kind")).withColumn("bump", bump_of("kind"))


def bump_of(kind: str):
    out = F.lit(0)
    for k, v in BUMPS.items():
        out = F.when(F.col(kind) == k, v).otherwise(out)
    return out


#: Reports of a number from which it is hot.
HOT = 50_000


def running_counts(rows: DataFrame, key: str, order: list[str], day: Column, sets: dict[str, tuple[Column, list[str]]], hot: int = HOT) -> DataFrame:
    """Rows with a column per set: the sum of its figure over the key's earlier rows that agree in its columns.

    All sets share one shuffle.  A key of more than ``hot`` rows is banded by ``day`` (which rises with
    ``order``): what the days before come to is carried in as a row at the head of each day and
    group, so that such a key is as many tasks as it has days, and no task holds more of it than one.
    """
    many = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > hot).select(F.col(key).alias("__hot"))
    keyed = rows.join(many, rows[key] == many["__hot"], "left").withColumn("__band", F.when(F.col("__hot").isNotNull(), day)).withColumns({f"__w_{name}": figure for name, (figure, _) in sets.items()}).withColumn("__head", F.lit(False))
    fields = sorted({c for _, same in sets.values() for c in same})
    heads = []
    for name, (_, same) in sets.items():
        days = keyed.where(F.col("__hot").isNotNull()).groupBy(key, "__band", *same).agg(F.sum(f"__w_{name}").alias("__sum"))
        carried = F.sum("__sum").over(W.partitionBy(key, *same).orderBy("__band").rowsBetween(W.unboundedPreceding, -1))
        weights = [(F.col("__c") if other == name else F.lit(0)).cast("long").alias(f"__w_{other}") for other in sets]
        own = [F.col(c) if c in same else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in fields]
        heads.append(days.withColumn("__c", carried).where("__c > 0").select(key, "__band", F.lit(True).alias("__head"), *own, *weights))
    met = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [keyed.drop("__hot"), *heads])
    figures = {}
    for name, (_, same) in sets.items():
        earlier = W.partitionBy(key, "__band", *same).orderBy(F.col("__head").desc(), *order).rowsBetween(W.unboundedPreceding, -1)
        figures[name] = F.coalesce(F.sum(F.col(f"__w_{name}").cast("long")).over(earlier), F.lit(0))
    return met.withColumns(figures).where("NOT __head").drop("__head", "__band", *[f"__w_{name}" for name in sets])


def _numbered_reports(reports: DataFrame) -> DataFrame:
    """Reports with a number and a time: none without a time is earlier or later than another."""
    cols = ["id", "created_at", "file_hash", "checkpoint", "name", "dob"]
    return reports.where((F.length("doc_no") >= 5) & F.col("created_at").isNotNull()).select(*cols, F.col("verdict").isin("FLAGGED", "REVIEW").cast("long").alias("bad"), F.sha2("doc_no", 256).alias("k"))


#: Figures of ``_earlier_figures``: how many earlier reports of a number give an alert of the kind.
KINDS = ["NAME_CLASH", "DOB_CLASH", "CROSS_CHECKPOINT", "PREVIOUSLY_FLAGGED"]


def _running(codes: list[np.ndarray], figure: np.ndarray) -> np.ndarray:
    """The sum of the figure over earlier rows that agree in all codes."""
    key = codes[0].astype(np.int64)
    for c in codes[1:]:
        key = key * (int(c.max(initial=0)) + 2) + c + 1
    order = np.argsort(key, kind="stable")
    sums = np.cumsum(figure[order]) - figure[order]
    heads = np.nonzero(np.append(True, np.diff(key[order]) != 0))[0]
    out = np.empty(len(key), np.int64)
    out[order] = sums - np.repeat(sums[heads], np.diff(np.append(heads, len(key))))
    return out


def _earlier_figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by number, time and id, as id, checkpoint and a figure a kind; whole numbers, many at a time."""

    def figures(t: pa.Table) -> pa.RecordBatch:
        code = {c: t.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "file_hash", "name", "dob", "checkpoint")}
        k, file, filed = code["k"], code["file_hash"], code["file_hash"] >= 0
        found = []
        for c in ("name", "dob", "checkpoint"):  # earlier ones of another file less those of them that agree
            one = ((code[c] >= 0) & filed).astype(np.int64)
            differing = _running([k], one) - _running([k, file], one) - _running([k, code[c]], one) + _running([k, code[c], file], one)
            found.append(np.where(code[c] >= 0, differing, 0))
        bad = np.where(filed, t.column("bad").combine_chunks().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
        found.append(np.where(code["checkpoint"] >= 0, _running([k, code["checkpoint"]], bad) - _running([k, code["checkpoint"], file], bad), 0))
        keep = pa.array(filed & (np.stack(found).max(0) > 0))
        out = pa.table([t.column("id"), t.column("checkpoint"), *[pa.array(f) for f in found]], names=["id", "checkpoint", *KINDS]).filter(keep)
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in out.columns], names=out.column_names)

    left = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if left is None else pa.concat_tables([left, t])
        if len(t):
            k = t.column("k").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            last = int(np.argmax(k == k[-1]))
            if last:
                yield figures(t.slice(0, last))
            left = t.slice(last)
    if left is not None and len(left):
        yield figures(left)


def alert_counts(reports: DataFrame, hot: int = HOT) -> DataFrame:
    """How many alerts of each kind a report has: id, checkpoint, kind, n, bump.  The pairs are never made.

    Earlier reports of the number that differ from this one are all of them less those that agree, and
    of both those of the same file are taken off; each is a running count over one sort by number and time.
    Numbers of more than ``hot`` reports, if there are any, are counted in bands instead.
    """
    rows = _numbered_reports(reports)
    many = rows.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("k")
    some = bool(many.take(1))
    cold = rows.join(many, "k", "left_anti") if some else rows
    sizes = ", ".join(f"{kind} long" for kind in KINDS)
    counted = cold.repartition("k").sortWithinPartitions("k", "created_at", "id").mapInArrow(_earlier_figures, f"id long, checkpoint string, {sizes}")
    if some:
        counted = counted.unionByName(_hot_figures(rows.join(many, "k", "left_semi"), hot))
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("n")) for kind in KINDS])
    alerts = counted.select("id", "checkpoint", F.explode(each).alias("x")).select("id", "checkpoint", "x.kind", "x.n").where("n > 0")
    return alerts.withColumn("bump", F.col("n") * bump_of("kind"))


def _hot_figures(numbered: DataFrame, hot: int) -> DataFrame:
    """The figures of ``_earlier_figures`` as windows, which cut a number of very many reports by day."""
    one = lambda c: F.when(F.col(c).isNotNull() & F.col("file_hash").isNotNull(), 1).otherwise(0)
    fields = ["name", "dob", "checkpoint"]
    sets = {"bad": (F.when(F.col("file_hash").isNotNull(), F.coalesce("bad", F.lit(0))).otherwise(0), ["checkpoint"])}
    for c in fields:  # nulls agree with nothing and differ from nothing, as in the comparison of a pair
        sets |= {f"any_{c}": (one(c), []), f"same_{c}": (one(c), [c])}
    sets |= {f"{name}_file": (figure, [*same, "file_hash"]) for name, (figure, same) in sets.items()}
    rows = running_counts(numbered, "k", ["created_at", "id"], F.to_date("created_at"), sets, hot)
    others = lambda name: F.col(name) - F.col(f"{name}_file")
    differing = lambda c: F.when(F.col(c).isNotNull(), others(f"any_{c}") - others(f"same_{c}")).otherwise(0)
    kinds = {
        "NAME_CLASH": differing("name"), "DOB_CLASH": differing("dob"), "CROSS_CHECKPOINT": differing("checkpoint"),
        "PREVIOUSLY_FLAGGED": F.when(F.col("checkpoint").isNotNull(), others("bad")).otherwise(0),
    }
    return rows.where(F.col("file_hash").isNotNull()).select("id", "checkpoint", *[n.cast("long").alias(kind) for kind, n in kinds.items()])


def prior_figures(reports: DataFrame, hot: int = HOT) -> DataFrame:
    """How many earlier reports of its number and another file a report has, and their largest id; the pairs are never made.

    Counts are running ones.  The largest id runs along as sorted partitions pass: of a number only the
    best id and the best one of another file are held, so whichever file a report is of, one of them answers.
    """
    there = F.when(F.col("file_hash").isNotNull(), 1).otherwise(0)
    rows = _numbered_reports(reports).select("id", "created_at", "file_hash", "k")
    counted = running_counts(rows, "k", ["created_at", "id"], F.to_date("created_at"), {"any": (there, []), "same": (there, ["file_hash"])}, hot)
    ready = counted.where(F.col("file_hash").isNotNull()).select("k", "created_at", "id", "file_hash", (F.col("any") - F.col("same")).alias("n_prior"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, best, other = None, None, None  # (id, file) of the best report, and of the best one of another file
        for batch in batches:
            found = []
            for k, id_, file in zip(*[batch.column(c).to_pylist() for c in ("k", "id", "file_hash")], strict=True):
                if k != number:
                    number, best, other = k, None, None
                prior = other if best and best[1] == file else best
                found.append(prior and prior[0])
                if best is None or file == best[1]:
                    best = max(best or (id_, file), (id_, file))
                elif id_ > best[0]:
                    best, other = (id_, file), best
                elif other is None or id_ > other[0]:
                    other = id_, file
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_prior"), pa.array(found, pa.int64())], names=["id", "n_prior", "max_prior"])

    return ready.repartition("k").sortWithinPartitions("k", "created_at", "id").mapInArrow(run, "id long, n_prior long, max_prior long").where("n_prior > 0")


def burst_counts(reports: DataFrame, suspicious, minutes: int = 60) -> DataFrame:
    """Reports with ``recent``: suspicious ones at the checkpoint up to this one, within the window.

    Counts rows up to the report itself in (time, id); later rows of the same second are taken off.
    A window reaches into one stretch of its own length before: suspicious rows are lent to the next
    stretch, and a stretch of a checkpoint is the largest group there is.
    """
    width = minutes * 60
    keyed = reports.where(F.col("created_at").isNotNull()).withColumn("__s", suspicious.cast("int")).withColumn("__t", F.unix_timestamp("created_at"))
    own = keyed.withColumn("__b", F.floor(F.col("__t") / width)).withColumn("__own", F.lit(True))
    lent = own.where("__s = 1").withColumn("__b", F.col("__b") + 1).withColumn("__own", F.lit(False))
    window = W.partitionBy("checkpoint", "__b").orderBy("__t").rangeBetween(-width, 0)
    later = W.partitionBy("checkpoint", "__t").orderBy("id").rowsBetween(1, W.unboundedFollowing)
    met = own.unionByName(lent).withColumn("__sum", F.sum("__s").over(window)).where("__own")
    return met.withColumn("recent", F.col("__sum") - F.coalesce(F.sum("__s").over(later), F.lit(0))).drop("__t", "__b", "__own", "__sum")


def burst_alerts(reports: DataFrame, suspicious, minutes: int = 60, least: int = 3) -> DataFrame:
    counted = burst_counts(reports, suspicious, minutes)
    return counted.where((F.col("__s") == 1) & (F.col("recent") >= least)).drop("__s").withColumn("bump", F.lit(BUMPS["SECTOR_BURST"]))


def undated(reports: DataFrame) -> DataFrame:
    """Rows without a time: neither in nor out of any window, so counted apart."""
    return reports.where(F.col("created_at").isNull()).agg(F.count("*").alias("n"))


def distinct_alerts(alerts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each alert once, with the place of its first sight."""
    return alerts.groupBy(*keys).agg(F.min(F.struct(*order)).alias("first_seen")).select(*keys, "first_seen.*")


def first_alerts(reports: DataFrame) -> DataFrame:
    """Each kind of alert of a checkpoint once, with its first report and that one's first partner.

    Only the first reports, of which there is one a kind and checkpoint, are paired with earlier ones.
    """
    first = written(alert_counts(reports).groupBy("checkpoint", "kind").agg(F.min("id").alias("id")), "first-alerts")
    numbers = reports.join(first.select("id").distinct(), "id").select("doc_no").distinct()
    pairs = recidivism_alerts(reports.join(numbers, "doc_no", "left_semi"))
    return distinct_alerts(pairs.join(first, ["id", "checkpoint", "kind"], "left_semi"), ["checkpoint", "kind"], ["id", "prior_id"])


def threat_matrix(reports: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per checkpoint: reports, mean risk, share flagged, alerts (from ``alert_counts``), and a level by what they come to."""
    base = reports.groupBy("checkpoint").agg(F.count("*").alias("n"), F.round(F.avg("risk_score"), 2).alias("mean_risk"), F.round(F.avg((F.col("verdict") == "FLAGGED").cast("double")), 4).alias("flagged_share"))
    seen = alerts.groupBy("checkpoint").agg(F.sum("n").alias("n_alerts"))
    density = F.col("n_alerts") / F.col("n")
    level = F.when((F.col("flagged_share") > 0.45) | (density > 20), "CRITICAL").when((F.col("flagged_share") > 0.43) | (density > 10), "ELEVATED").otherwise("NORMAL")
    return base.join(seen, "checkpoint", "left").withColumn("n_alerts", F.coalesce("n_alerts", F.lit(0))).withColumn("level", level)


def expected_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in EXPECTED.items()], "nationality string, expected array<string>")


def with_mode(df: DataFrame, place: str) -> DataFrame:
    """Rows with the cluster and mode of their checkpoint; places of no cluster count to the first."""
    rows = [(p, c, m) for (c, m), places in CLUSTERS.items() for p in places]
    catalog = F.broadcast(df.sparkSession.createDataFrame(rows, f"{place} string, cluster string, mode string"))  # a fixed catalog of 45 rows
    first = next(iter(CLUSTERS))
    return df.join(catalog, place, "left").withColumn("cluster", F.coalesce("cluster", F.lit(first[0]))).withColumn("mode", F.coalesce("mode", F.lit(first[1])))


def missing_documents(presented: DataFrame) -> DataFrame:
    """(key, nationality, presented) -> what is expected of the nationality (or of unknown ones) and not presented."""
    catalog = F.broadcast(expected_documents(presented.sparkSession))  # a fixed catalog of four rows
    known = F.when(F.col("nationality").isin(*EXPECTED), F.col("nationality")).otherwise("UNKNOWN")
    joined = presented.withColumn("__n", known).join(catalog.withColumnRenamed("nationality", "__n"), "__n")
    return joined.withColumn("missing", F.array_except("expected", "presented")).drop("__n")


def publish_notices(feed: DataFrame, new: DataFrame) -> DataFrame:
    """Append notices whose content digest is not in the feed."""
    keyed = new.withColumn("file_hash", F.sha2(F.concat_ws(":", "title", "urgency", "content"), 256)).dropDuplicates(["file_hash"])
    return feed.unionByName(keyed.join(feed, "file_hash", "left_anti").withColumn("revoked", F.lit(False)).select(*feed.columns))


def retract_notices(feed: DataFrame, hashes: DataFrame) -> DataFrame:
    """The row stays and is marked."""
    gone = hashes.select("file_hash").distinct().withColumn("__gone", F.lit(True))
    return feed.join(gone, "file_hash", "left").withColumn("revoked", F.col("revoked") | F.coalesce("__gone", F.lit(False))).drop("__gone")
