"""Screening views over the star-schema tables, as DataFrames and as SQL for the oracle.

The tables have no identity documents, so reports, sessions, watchlist and so on are derived
from orders, customers and events by integer arithmetic and ISO text that both engines evaluate
alike.  Nothing is generated beside the tables and nothing depends on the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_TYPES = ["passport", "pan", "aadhaar", "driving_licence", "voter_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grade(risk: Column, hard: Column | None = None, can_clear: Column | None = None) -> Column:
    """FLAGGED above 55 or by a hard flag, REVIEW above 25 or if it may not be cleared, else CLEAR."""
    hard = F.lit(False) if hard is None else hard
    can_clear = F.lit(True) if can_clear is None else can_clear
    return F.when(hard | (risk > 55), "FLAGGED").when(~can_clear | (risk > 25), "REVIEW").otherwise("CLEAR")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One screening report per order."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    risk = (key * 7919 % 101).cast("int")
    file_key = F.when(key % 50 <= 1, key - key % 2).otherwise(key)
    kinds = F.array(*[F.lit(x) for x in DOC_TYPES])
    status = F.col("o_orderstatus")
    verdict = grade(risk)
    module = F.when(key % 3 == 0, "PASS").when(key % 3 == 1, "REVIEW").otherwise("FAIL")
    modules = (
        F.when(key % 40 == 0, F.lit("{not json"))
        .when(key % 40 == 1, F.concat(F.lit('{"validation":"'), module, F.lit('","tampering":"PASS"}')))
        .otherwise(F.concat(F.lit('{"validation":{"verdict":"'), module, F.lit('"},"tampering":{"verdict":"'), F.when(key % 7 == 0, "FAIL").otherwise("PASS"), F.lit('"},"face":{"verdict":"'), F.when(key % 5 == 0, "REVIEW").otherwise("PASS"), F.lit('"}}')))
    )
    ai = F.when(key % 40 == 2, F.lit("oops")).otherwise(
        F.concat(F.lit('{"ran":'), F.when(key % 4 == 0, "false").otherwise("true"), F.lit(',"ai_suspected":'), F.when(key % 11 == 0, "true").otherwise("false"), F.lit(',"ai_score":'), (key % 100).cast("string"), F.lit("}"))
    )
    return (
        o.join(c, cust == F.col("c_custkey"))
        .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # a fixed dimension of 25 rows
        .select(
            key.alias("id"),
            key.alias("seq"),
            F.timestamp_seconds(F.unix_timestamp("o_orderdate") + key % 86400).alias("created_at"),
            F.col("n_name").alias("checkpoint"),
            F.concat(F.lit("officer"), (key % 20).cast("string")).alias("screener"),
            F.element_at(kinds, F.substring("o_orderpriority", 1, 1).cast("int")).alias("doc_type"),
            F.sha2(file_key.cast("string"), 256).alias("file_hash"),
            F.concat(F.lit("P"), F.lpad(F.floor(cust / 4).cast("string"), 7, "0")).alias("doc_no"),
            F.upper("c_name").alias("name"),
            F.date_add(F.lit("1950-01-01").cast("date"), (cust * 37 % 20000).cast("int")).cast("string").alias("dob"),
            risk.alias("risk_score"),
            verdict.alias("verdict"),
            F.when(key % 97 == 0, 0).otherwise(200 + key * 31 % 3000).cast("int").alias("latency_ms"),
            F.when(status == "F", "CONFIRMED_FRAUD").when((status == "O") & (key % 3 == 0), "CLEARED").when(status == "P", "INCONCLUSIVE").alias("adjudication"),
            modules.alias("modules"),
            ai.alias("ai_detection"),
            F.floor(key / 3).cast("bigint").alias("session_id"),
            F.when(key % 31 == 0, 1).otherwise(0).alias("removed"),
            cust.alias("custkey"),
        )
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three reports of consecutive keys at most; their state follows from the highest risk."""
    r = reports(spark, sf_dir)
    return r.groupBy("session_id").agg(
        F.max("risk_score").alias("risk_score"),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("closed_at"),
        F.min("checkpoint").alias("checkpoint"),
        F.min("screener").alias("screener"),
    ).withColumn("verdict", F.when(F.col("session_id") % 10 == 0, F.lit(None)).otherwise(grade(F.col("risk_score")))).withColumn(
        "status", F.when(F.col("session_id") % 10 == 0, "open").when(F.col("risk_score") > 55, "flagged").when(F.col("risk_score") > 25, "rejected").otherwise("approved")
    )


def doc_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and field: value and script; every 7th differs in a field, every 11th lacks one."""
    r = reports(spark, sf_dir).where("removed = 0")
    key = F.col("id")
    base = {
        "name": F.concat(F.lit("HOLDER "), F.col("session_id").cast("string")),
        "dob": F.concat(F.lit("19"), F.lpad((F.col("session_id") % 90 + 10).cast("string"), 2, "0"), F.lit("-01-15")),
        "passport": F.concat(F.lit("K"), F.lpad(F.col("session_id").cast("string"), 7, "0")),
        "pincode": F.concat(F.lit("7"), F.lpad((F.col("session_id") % 90000).cast("string"), 5, "0")),
        "pan": F.concat(F.lit("ABCPD"), F.lpad((F.col("session_id") % 10000).cast("string"), 4, "0"), F.lit("F")),
    }
    names = list(base)
    rows = []
    for i, (field, value) in enumerate(base.items()):
        changed = F.when((key % 7 == 0) & (F.floor(key / 7) % len(names) == i), F.concat(value, F.lit("X"))).otherwise(value)
        gone = (key % 11 == 0) & (F.floor(key / 11) % len(names) == i)
        rows.append(F.struct(F.lit(field).alias("field"), F.when(~gone, changed).alias("value"), F.when((key % 13 == 0) & F.lit(field == "name"), "deva").otherwise("latin").alias("script")))
    return r.select("session_id", "id", "doc_type", F.explode(F.array(*rows)).alias("f")).select("session_id", "id", "doc_type", "f.field", "f.value", "f.script").where("value IS NOT NULL")


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_custkey % 61 = 0")
    doc_no = F.concat(F.lit("P"), F.lpad(F.floor(F.col("c_custkey") / 4).cast("string"), 7, "0"))
    return c.select(F.sha2(doc_no, 256).alias("identifier_hash"), F.concat(F.lit("****"), F.right(doc_no, F.lit(4))).alias("mask"), F.when(F.col("c_custkey") % 2 == 0, "fraud").otherwise("alert").alias("category")).distinct()


def event_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"), F.concat(F.lit("CP"), (F.col("user_id") % 12).cast("string")).alias("checkpoint"),
        (F.col("event_type") == "error").alias("suspicious"), F.col("user_id"), F.sha2(F.get_json_object("props", "$.k"), 256).alias("identifier_hash"), "event_type",
    )


def gt_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground-truth boxes of images: an image per order, a box per line (numbered by part, supplier and line, which is unique in an order)."""
    x = F.col("l_quantity") / 100
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("img_id"), F.col("l_returnflag").alias("label"), ((F.col("l_partkey") * 100003 + F.col("l_suppkey")) * 8 + F.col("l_linenumber")).cast("long").alias("gt_idx"),
        x.alias("x1"), F.col("l_discount").alias("y1"), (x + 0.2 + F.col("l_tax")).alias("x2"), (F.col("l_discount") + 0.3).alias("y2"),
    )


def det_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections: the truth shifted on odd lines, missing for line 4, doubled (elsewhere) for line 1."""
    line = F.col("l_linenumber")
    x = F.col("l_quantity") / 100 + F.when(line % 2 == 1, F.col("l_tax") / 2).otherwise(0.0)
    conf = F.floor("l_extendedprice") % 1000 / 1000
    base = table(spark, sf_dir, "lineitem").where(line != 4)
    number = (((F.col("l_partkey") * 100003 + F.col("l_suppkey")) * 8 + line) * 2).cast("long")
    make = lambda df, idx, dx: df.select(
        F.col("l_orderkey").alias("img_id"), F.col("l_returnflag").alias("label"), idx.alias("det_idx"), conf.alias("confidence"),
        (x + dx).alias("x1"), F.col("l_discount").alias("y1"), (x + dx + 0.2 + F.col("l_tax")).alias("x2"), (F.col("l_discount") + 0.3).alias("y2"),
    )
    return make(base, number, F.lit(0.0)).unionByName(make(base.where(line == 1), number + 1, F.lit(3.0)))


def emb_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors, and of every 10th a copy with the first three components negated, under the number -1 - vec_id."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    copy = e.where("vec_id % 10 = 0").select((-1 - F.col("vec_id")).alias("vec_id"), F.transform("v", lambda x, i: F.when(i < 3, -x).otherwise(x)).alias("v"))
    return e.unionByName(copy)


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of notices: published, published again with others, and those of some titles retracted."""
    from passgrid.operators import links

    base = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("Notice "), F.col("item_id") % 30).alias("title"), F.lit("HIGH").alias("urgency"), F.col("text").alias("content"))
    empty = base.where("false").select(*base.columns, F.lit("").alias("file_hash"), F.lit(False).alias("revoked"))
    feed = links.publish_notices(empty, base)
    feed = links.publish_notices(feed, base.unionByName(base.withColumn("urgency", F.lit("LOW"))))
    return links.retract_notices(feed, feed.where("title LIKE '%7'").select("file_hash"))


SQL: dict[str, str] = {
    "reports": """
        SELECT o_orderkey AS id, o_orderkey AS seq,
               CAST(o_orderdate AS TIMESTAMP) + to_seconds(CAST(o_orderkey % 86400 AS BIGINT)) AS created_at,
               n_name AS checkpoint, 'officer' || (o_orderkey % 20) AS screener,
               ['passport','pan','aadhaar','driving_licence','voter_id'][CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS doc_type,
               sha256(CAST(CASE WHEN o_orderkey % 50 <= 1 THEN o_orderkey - o_orderkey % 2 ELSE o_orderkey END AS VARCHAR)) AS file_hash,
               'P' || lpad(CAST(o_custkey // 4 AS VARCHAR), 7, '0') AS doc_no, upper(c_name) AS name,
               strftime(DATE '1950-01-01' + CAST(o_custkey * 37 % 20000 AS INTEGER), '%Y-%m-%d') AS dob,
               CAST(o_orderkey * 7919 % 101 AS INTEGER) AS risk_score,
               CASE WHEN o_orderkey * 7919 % 101 > 55 THEN 'FLAGGED' WHEN o_orderkey * 7919 % 101 > 25 THEN 'REVIEW' ELSE 'CLEAR' END AS verdict,
               CAST(CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE 200 + o_orderkey * 31 % 3000 END AS INTEGER) AS latency_ms,
               CASE WHEN o_orderstatus = 'F' THEN 'CONFIRMED_FRAUD' WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 'CLEARED' WHEN o_orderstatus = 'P' THEN 'INCONCLUSIVE' END AS adjudication,
               CASE WHEN o_orderkey % 40 = 0 THEN '{not json'
                    WHEN o_orderkey % 40 = 1 THEN '{"validation":"' || CASE o_orderkey % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'REVIEW' ELSE 'FAIL' END || '","tampering":"PASS"}'
                    ELSE '{"validation":{"verdict":"' || CASE o_orderkey % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'REVIEW' ELSE 'FAIL' END || '"},"tampering":{"verdict":"' || CASE WHEN o_orderkey % 7 = 0 THEN 'FAIL' ELSE 'PASS' END || '"},"face":{"verdict":"' || CASE WHEN o_orderkey % 5 = 0 THEN 'REVIEW' ELSE 'PASS' END || '"}}' END AS modules,
               CASE WHEN o_orderkey % 40 = 2 THEN 'oops' ELSE '{"ran":' || CASE WHEN o_orderkey % 4 = 0 THEN 'false' ELSE 'true' END || ',"ai_suspected":' || CASE WHEN o_orderkey % 11 = 0 THEN 'true' ELSE 'false' END || ',"ai_score":' || (o_orderkey % 100) || '}' END AS ai_detection,
               o_orderkey // 3 AS session_id, CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END AS removed, o_custkey AS custkey
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "sessions": """
        SELECT session_id, max(risk_score) AS risk_score, min(created_at) AS created_at, max(created_at) AS closed_at, min(checkpoint) AS checkpoint, min(screener) AS screener,
               CASE WHEN session_id % 10 = 0 THEN NULL WHEN max(risk_score) > 55 THEN 'FLAGGED' WHEN max(risk_score) > 25 THEN 'REVIEW' ELSE 'CLEAR' END AS verdict,
               CASE WHEN session_id % 10 = 0 THEN 'open' WHEN max(risk_score) > 55 THEN 'flagged' WHEN max(risk_score) > 25 THEN 'rejected' ELSE 'approved' END AS status
        FROM reports GROUP BY session_id""",
    "doc_fields": """
        SELECT * FROM (
            SELECT session_id, id, doc_type, f.field AS field,
                   CASE WHEN id % 11 = 0 AND (id // 11) % 5 = f.i THEN NULL WHEN id % 7 = 0 AND (id // 7) % 5 = f.i THEN f.value || 'X' ELSE f.value END AS value,
                   CASE WHEN id % 13 = 0 AND f.field = 'name' THEN 'deva' ELSE 'latin' END AS script
            FROM (SELECT *, unnest([{'field': 'name', 'i': 0, 'value': 'HOLDER ' || session_id},
                    {'field': 'dob', 'i': 1, 'value': '19' || lpad(CAST(session_id % 90 + 10 AS VARCHAR), 2, '0') || '-01-15'},
                    {'field': 'passport', 'i': 2, 'value': 'K' || lpad(CAST(session_id AS VARCHAR), 7, '0')},
                    {'field': 'pincode', 'i': 3, 'value': '7' || lpad(CAST(session_id % 90000 AS VARCHAR), 5, '0')},
                    {'field': 'pan', 'i': 4, 'value': 'ABCPD' || lpad(CAST(session_id % 10000 AS VARCHAR), 4, '0') || 'F'}]) AS f FROM reports WHERE removed = 0)
        ) WHERE value IS NOT NULL""",
    "watchlist": """
        SELECT DISTINCT sha256('P' || lpad(CAST(c_custkey // 4 AS VARCHAR), 7, '0')) AS identifier_hash, '****' || right('P' || lpad(CAST(c_custkey // 4 AS VARCHAR), 7, '0'), 4) AS mask,
               CASE WHEN c_custkey % 2 = 0 THEN 'fraud' ELSE 'alert' END AS category FROM customer WHERE c_custkey % 61 = 0""",
    "event_reports": """
        SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS created_at, 'CP' || (user_id % 12) AS checkpoint, event_type = 'error' AS suspicious, user_id,
               sha256(json_extract_string(props, '$.k')) AS identifier_hash, event_type FROM events""",
    "gt_boxes": """
        SELECT l_orderkey AS img_id, l_returnflag AS label, CAST((l_partkey * 100003 + l_suppkey) * 8 + l_linenumber AS BIGINT) AS gt_idx, l_quantity / 100 AS x1, l_discount AS y1,
               l_quantity / 100 + 0.2::DOUBLE + l_tax AS x2, l_discount + 0.3::DOUBLE AS y2 FROM lineitem""",
    "det_boxes": """
        SELECT l_orderkey AS img_id, l_returnflag AS label, CAST(((l_partkey * 100003 + l_suppkey) * 8 + l_linenumber) * 2 + extra AS BIGINT) AS det_idx, CAST(floor(l_extendedprice) AS BIGINT) % 1000 / 1000 AS confidence,
               x + dx AS x1, l_discount AS y1, x + dx + 0.2::DOUBLE + l_tax AS x2, l_discount + 0.3::DOUBLE AS y2
        FROM (SELECT *, l_quantity / 100 + CASE WHEN l_linenumber % 2 = 1 THEN l_tax / 2 ELSE 0.0::DOUBLE END AS x, CASE WHEN extra = 1 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS dx
              FROM (SELECT *, unnest(CASE WHEN l_linenumber = 1 THEN [0, 1] ELSE [0] END) AS extra FROM lineitem WHERE l_linenumber <> 4))""",
    "emb_plus": """
        SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
        UNION ALL SELECT -1 - vec_id, list_transform(embedding, lambda x, i: CASE WHEN i <= 3 THEN -CAST(x AS DOUBLE) ELSE CAST(x AS DOUBLE) END) FROM embeddings WHERE vec_id % 10 = 0""",
}
NEEDS = {"sessions": ["reports"], "doc_fields": ["reports"]}


def with_views(body: str, *names: str) -> str:
    """SQL with the views it names (and those they need) in front."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in [*NEEDS.get(n, []), n] if x not in wanted]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in wanted) + (", " + body.strip()[5:] if body.strip().upper().startswith("WITH ") else " " + body)
