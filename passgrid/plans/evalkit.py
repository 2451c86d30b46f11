"""Evaluation kit and dataset jobs over boxes, vectors, scores and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from passgrid.operators import datasets as D
from passgrid.operators import evalkit as E
from passgrid.operators import rows
from passgrid.plans.base import Book
from passgrid.sources import views
from passgrid.sources.views import with_views

BOOK = Book()
add = BOOK.add
GT, DET, EMB, T = views.gt_boxes, views.det_boxes, views.emb_plus, views.table
THRESHOLDS = [round(0.5 + 0.05 * i, 2) for i in range(10)]

IOU = "CASE WHEN (d.x2 - d.x1) * (d.y2 - d.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) - {i} > 0 THEN {i} / ((d.x2 - d.x1) * (d.y2 - d.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) - {i}) ELSE 0.0::DOUBLE END".format(i="(greatest(0.0::DOUBLE, least(d.x2, g.x2) - greatest(d.x1, g.x1)) * greatest(0.0::DOUBLE, least(d.y2, g.y2) - greatest(d.y1, g.y1)))")
MATCHED = f"""pairs AS (SELECT d.img_id, d.label, d.det_idx, g.gt_idx, {IOU} AS iou FROM det_boxes d JOIN gt_boxes g ON d.img_id = g.img_id AND d.label = g.label),
    best AS (SELECT img_id, label, det_idx, arg_max(gt_idx, (iou, -gt_idx)) AS gt_idx, max(iou) AS iou FROM pairs WHERE iou > 0 GROUP BY 1, 2, 3),
    matched AS (SELECT d.*, b.gt_idx, b.iou FROM det_boxes d LEFT JOIN best b USING (img_id, label, det_idx))"""
TPS = MATCHED + f""", ts AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in THRESHOLDS)}]) AS t), tps AS (SELECT m.*, t, CASE WHEN coalesce(iou >= t, false) AND row_number() OVER (PARTITION BY img_id, label, t, CASE WHEN coalesce(iou >= t, false) THEN gt_idx END ORDER BY confidence DESC, det_idx) = 1 THEN 1 ELSE 0 END AS tp FROM matched m, ts)"""
POINTS = TPS + """, ngt AS (SELECT label, count(*) AS n_gt FROM gt_boxes GROUP BY 1), points AS (SELECT label, t, img_id, det_idx, tp, sum(tp) OVER w / n_gt AS recall, sum(tp) OVER w / count(*) OVER w AS "precision" FROM tps JOIN ngt USING (label) WINDOW w AS (PARTITION BY label, t ORDER BY confidence DESC, img_id, det_idx ROWS UNBOUNDED PRECEDING))"""
APS = POINTS + """, lv AS (SELECT label, t, r FROM (SELECT DISTINCT label, t FROM points), range(101) x(r)), aps AS (SELECT label, t, sum(p) / 101 AS ap FROM (SELECT l.label, l.t, l.r, coalesce(max(p."precision"), 0) AS p FROM lv l LEFT JOIN points p ON p.label = l.label AND p.t = l.t AND floor(p.recall * 100 + 1e-9) >= l.r GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


def matched(s, d):
    return E.best_truth(DET(s, d), GT(s, d))


def bins(s, d):
    return E.recall_bins(matched(s, d), GT(s, d), THRESHOLDS)


add("j7_box_pairs",
    lambda s, d: DET(s, d).join(GT(s, d).select("img_id", "label", "gt_idx", *[F.col(c).alias(f"g_{c}") for c in E.BOX]), ["img_id", "label"]).select("img_id", "det_idx", "gt_idx", F.round(E.iou(), 6).alias("iou")).where("iou >= 0.5"),
    with_views(f"WITH {MATCHED} SELECT img_id, det_idx, gt_idx, round(iou, 6) AS iou FROM pairs WHERE round(iou, 6) >= 0.5", "gt_boxes", "det_boxes"))
add("j8_iou_figures",
    lambda s, d: DET(s, d).join(GT(s, d).select("img_id", "label", "gt_idx", *[F.col(c).alias(f"g_{c}") for c in E.BOX]), ["img_id", "label"]).groupBy("label").agg(F.round(F.avg(E.iou()), 6).alias("mean_iou"), F.count("*").alias("n")),
    with_views(f"WITH {MATCHED} SELECT label, round(avg(iou), 6) AS mean_iou, count(*) AS n FROM pairs GROUP BY 1", "gt_boxes", "det_boxes"))
add("w6_best_truth",
    lambda s, d: matched(s, d).select("img_id", "label", "det_idx", "gt_idx", F.round("iou", 6).alias("iou")),
    with_views(f"WITH {MATCHED} SELECT img_id, label, det_idx, gt_idx, round(iou, 6) AS iou FROM matched", "gt_boxes", "det_boxes"))
add("w7_true_positives",
    lambda s, d: E.true_positive_counts(matched(s, d), THRESHOLDS),
    with_views(f"WITH {TPS} SELECT label, t, CAST(sum(tp) AS BIGINT) AS tp, count(*) AS n FROM tps GROUP BY 1, 2", "gt_boxes", "det_boxes"))
add("w8_precision_recall",
    lambda s, d: E.precision_recall(E.true_positives(matched(s, d), [0.5]), GT(s, d)).select("label", "img_id", "det_idx", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision")),
    with_views(f'WITH {POINTS} SELECT label, img_id, det_idx, round(recall, 6) AS recall, round("precision", 6) AS "precision" FROM points WHERE t = 0.5', "gt_boxes", "det_boxes"))
add("g19_average_precision",
    lambda s, d: E.average_precision(bins(s, d)).select("label", "t", F.round("ap", 6).alias("ap")),
    with_views(f"WITH {APS} SELECT label, t, round(ap, 6) AS ap FROM aps", "gt_boxes", "det_boxes"))
add("g20_mean_ap",
    lambda s, d: E.mean_average_precision(E.average_precision(bins(s, d))),
    with_views((
        f"WITH {APS}, per AS (SELECT label, max(ap) FILTER (t = 0.5) AS a, avg(ap) AS b FROM aps GROUP BY 1) SELECT label, round(a, 4) AS ap50, round(b, 4) AS ap50_95 FROM per UNION "
        f"ALL SELECT '(all)', round(avg(a), 4), round(avg(b), 4) FROM per"
    ), "gt_boxes", "det_boxes"))
SWEEP = [round(0.15 + 0.05 * i, 2) for i in range(14)]


def greedy_sql(confidences: list[float], keys: list[str]) -> str:
    """Each detection in order takes the first free truth: followed from detection to detection of an image and label."""
    columns = {"label": "label", "conf": "conf", "condition": "img_id % 5 AS condition"}
    names = ", ".join(keys)
    return f"""WITH RECURSIVE fits AS (SELECT d.img_id, d.label, d.det_idx, d.confidence, list(g.gt_idx ORDER BY g.gt_idx) FILTER (g.gt_idx IS NOT NULL AND {IOU} >= 0.5) AS f FROM det_boxes d LEFT JOIN gt_boxes g ON d.img_id = g.img_id AND d.label = g.label GROUP BY 1, 2, 3, 4),
        c AS (SELECT unnest([{', '.join(f'{c}::DOUBLE' for c in confidences)}]) AS conf),
        o AS (SELECT conf, img_id, label, coalesce(f, []) AS f, row_number() OVER (PARTITION BY conf, img_id, label ORDER BY det_idx) AS r FROM fits JOIN c ON confidence >= conf),
        taken AS (SELECT DISTINCT conf, img_id, label, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS t FROM o
            UNION ALL SELECT conf, img_id, label, r, CASE WHEN len(free) > 0 THEN list_append(t, free[1]) ELSE t END FROM (SELECT o.*, t, CAST(list_filter(f, lambda x: NOT list_contains(t, x)) AS BIGINT[]) AS free FROM taken JOIN o ON o.conf = taken.conf AND o.img_id = taken.img_id AND o.label = taken.label AND o.r = taken.r + 1)),
        each AS (SELECT conf, img_id, label, count(*) AS n_det, 0 AS n_gt, 0 AS n_tp FROM o GROUP BY 1, 2, 3 UNION ALL SELECT conf, img_id, label, 0, 0, max(len(t)) FROM taken GROUP BY 1, 2, 3 UNION ALL SELECT conf, img_id, label, 0, 1, 0 FROM gt_boxes, c),
        s AS (SELECT {', '.join(columns[k] for k in keys)}, CAST(sum(n_det) AS BIGINT) AS n_det, CAST(sum(n_gt) AS BIGINT) AS n_gt, CAST(sum(n_tp) AS BIGINT) AS n_tp FROM each GROUP BY {', '.join(str(i + 1) for i in range(len(keys)))}),
        pr AS (SELECT *, n_tp / greatest(1, n_det) AS p, n_tp / greatest(1, n_gt) AS q FROM s),
        rates AS (SELECT {names}, n_det, n_gt, n_tp, round(p, 4) AS "precision", round(q, 4) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0::DOUBLE END, 4) AS f1 FROM pr)"""


def greedy_views(body: str, confidences: list[float], keys: list[str]) -> str:
    return with_views(greedy_sql(confidences, keys).replace("WITH RECURSIVE", "WITH", 1) + " " + body, "gt_boxes", "det_boxes").replace("WITH ", "WITH RECURSIVE ", 1)


add("g21_greedy_rates", lambda s, d: E.rates(E.greedy_counts(DET(s, d), GT(s, d), [0.35], per_image=False), ["label"]), greedy_views("SELECT * FROM rates", [0.35], ["label"]))
add("g22_threshold_sweep", lambda s, d: E.best_threshold(E.rates(E.greedy_counts(DET(s, d), GT(s, d), SWEEP, per_image=False), ["label", "conf"])),
    greedy_views("SELECT label, CASE WHEN max(n_gt) > 0 THEN arg_max(conf, (f1, -conf)) ELSE 0.35::DOUBLE END AS conf, max(f1) AS f1 FROM rates GROUP BY 1", SWEEP, ["label", "conf"]))
add("g23_breakdown",
    lambda s, d: E.rates(E.greedy_counts(DET(s, d), GT(s, d), [0.35]).withColumn("condition", F.col("img_id") % 5), ["label", "condition"]),
    greedy_views("SELECT * FROM rates", [0.35], ["label", "condition"]))
add("g24_class_recall",
    lambda s, d: E.rates(E.greedy_counts(DET(s, d), GT(s, d), [0.35], per_image=False), ["label"]).where("n_gt > 0").agg(F.round(F.avg("recall"), 4).alias("mean_recall"), F.count("*").alias("classes")),
    greedy_views("SELECT round(avg(recall), 4) AS mean_recall, count(*) AS classes FROM rates WHERE n_gt > 0", [0.35], ["label"]))
add("w9_suppression",
    lambda s, d: E.suppress(DET(s, d).unionByName(DET(s, d).where("det_idx % 3 = 0").withColumn("det_idx", -F.col("det_idx")).withColumn("x1", F.col("x1") + 0.01)), 0.45).select("img_id", "label", "det_idx"),
    with_views(f"""WITH x AS (SELECT * FROM det_boxes UNION ALL SELECT img_id, label, -det_idx, confidence, x1 + 0.01::DOUBLE, y1, x2, y2 FROM det_boxes WHERE det_idx % 3 = 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY img_id, label ORDER BY confidence DESC, det_idx) AS r FROM x),
        h AS (SELECT d.img_id, d.label, d.det_idx, d.r, coalesce(list(g.r) FILTER (g.r IS NOT NULL AND {IOU} > 0.45), []) AS over FROM o d LEFT JOIN o g ON d.img_id = g.img_id AND d.label = g.label AND g.r < d.r GROUP BY 1, 2, 3, 4),
        kept AS (SELECT DISTINCT img_id, label, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS k FROM o
            UNION ALL SELECT h.img_id, h.label, h.r, CASE WHEN len(list_intersect(h.over, kept.k)) = 0 THEN list_append(kept.k, h.r) ELSE kept.k END FROM kept JOIN h ON h.img_id = kept.img_id AND h.label = kept.label AND h.r = kept.r + 1)
        SELECT h.img_id, h.label, h.det_idx FROM h JOIN kept ON h.img_id = kept.img_id AND h.label = kept.label AND h.r = kept.r WHERE list_contains(kept.k, h.r)""", "det_boxes").replace("WITH ", "WITH RECURSIVE ", 1))
add("w14_top_boxes",
    lambda s, d: rows.top_k(DET(s, d), ["img_id"], [F.col("confidence").desc(), "label", "det_idx"], 2).select("img_id", "label", "det_idx"),
    with_views("SELECT img_id, label, det_idx FROM (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY confidence DESC, label, det_idx) AS r FROM det_boxes) WHERE r <= 2", "det_boxes"))
SCORES = "SELECT (n_chars % 1000) / 1000 AS score, quality = 1 AS positive FROM documents JOIN labels USING (doc_id)"


def scores(s, d):
    return T(s, d, "documents").join(T(s, d, "labels"), "doc_id").select((F.col("n_chars") % 1000 / 1000).alias("score"), (F.col("quality") == 1).alias("positive"))


ROC = f"""sc AS ({SCORES}), th AS (SELECT DISTINCT score FROM sc UNION SELECT 0.0::DOUBLE UNION SELECT 1.0::DOUBLE), tot AS (SELECT count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM sc),
    roc AS (SELECT round(th.score, 4) AS threshold, round((SELECT count(*) FROM sc WHERE NOT positive AND sc.score >= th.score) / (SELECT n FROM tot), 4) AS fpr, round((SELECT count(*) FROM sc WHERE positive AND sc.score >= th.score) / (SELECT p FROM tot), 4) AS tpr FROM th)"""
add("g25_roc_points", lambda s, d: E.roc(scores(s, d)), f"WITH {ROC} SELECT * FROM roc")
add("g25_auc",
    lambda s, d: E.auc(E.roc(scores(s, d))),
    (
        f"WITH {ROC}, st AS (SELECT fpr, tpr, lag(fpr) OVER (ORDER BY fpr, tpr) AS f0, lag(tpr) OVER (ORDER BY fpr, tpr) AS t0 FROM roc) SELECT round(sum((fpr - f0) * (tpr + t0) / 2), "
        f"4) AS auc, coalesce(max(tpr) FILTER (fpr <= 0.05001), 0) AS tpr_at FROM st"
    ))
COS = "list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v))"


def similar(s, d, least=0.5):
    return E.all_pairs(EMB(s, d), "vec_id", "v", least)


add("j13_similar_pairs",
    lambda s, d: similar(s, d)[1].select("a", "b", F.round("sim", 6).alias("sim")),
    with_views(f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 6) AS sim FROM emb_plus a JOIN emb_plus b ON a.vec_id < b.vec_id WHERE {COS} >= 0.5", "emb_plus"))
add("g27_false_accepts",
    lambda s, d: similar(s, d)[0].agg(F.sum("n_pairs").alias("pairs"), F.sum("n_above").alias("accepted")).withColumn("rate", F.round(F.col("accepted") / F.col("pairs"), 8)),
    with_views(f"SELECT count(*) AS pairs, count(*) FILTER (s >= 0.5) AS accepted, round(count(*) FILTER (s >= 0.5) / count(*), 8) AS rate FROM (SELECT {COS} AS s FROM emb_plus a JOIN emb_plus b ON a.vec_id < b.vec_id)", "emb_plus"))
PORTRAITS = "SELECT a.vec_id, " + COS + " AS sim FROM emb_plus a JOIN emb_plus b ON b.vec_id = -1 - a.vec_id AND a.vec_id >= 0"


def portraits(s, d):
    e = EMB(s, d)
    other = e.where("vec_id < 0").select((-1 - F.col("vec_id")).alias("vec_id"), F.col("v").alias("w"))
    return e.join(other, "vec_id").select("vec_id", E.cosine("v", "w").alias("sim"))


add("j14_portrait_similarity", lambda s, d: portraits(s, d).select("vec_id", F.round("sim", 6).alias("sim")), with_views(f"SELECT vec_id, round(sim, 6) AS sim FROM ({PORTRAITS})", "emb_plus"))
add("g26_distribution",
    lambda s, d: E.distribution(portraits(s, d), "sim"),
    with_views("SELECT count(sim) AS n, round(min(sim), 4) AS min, " + ", ".join(f"round(quantile_cont(sim, {p / 100}), 4) AS p{p}" for p in (10, 25, 50, 75, 90, 95, 99)) + f", round(max(sim), 4) AS max, round(avg(sim), 4) AS mean, round(stddev_pop(sim), 4) AS std FROM ({PORTRAITS})", "emb_plus"))
HASH = "bit_count(xor(a.h, b.h))"
HASHES = "h AS (SELECT vec_id, list_reduce(list_transform(v, lambda x, i: CASE WHEN x > 0 THEN (1::HUGEINT << CAST(i - 1 AS INTEGER)) ELSE 0::HUGEINT END), lambda p, q: p + q) AS u FROM emb_plus), hh AS (SELECT vec_id, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS h FROM h)"
add("j11_near_hashes",
    lambda s, d: (lambda h: E.near_hashes(h.where("vec_id >= 0"), h.where("vec_id < 0"), "vec_id", "h"))(EMB(s, d).select("vec_id", E.sign_hash(F.col("v")).alias("h"))),
    with_views(f"WITH {HASHES} SELECT a.vec_id AS a, b.vec_id AS b, CAST({HASH} AS INTEGER) AS bits FROM hh a JOIN hh b ON a.vec_id >= 0 AND b.vec_id < 0 AND {HASH} <= 6", "emb_plus"))


def split(s, d, n):
    return T(s, d, "documents").withColumn("split", F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "valid").otherwise("train")).where(F.col("split") == n)


HELD_SOURCES = ["src18", "src19"]


def leaks(s, d):
    """What the test split shares with the two others; near copies of vectors; sources in training that are held out."""
    test, others = split(s, d, "test"), split(s, d, "train").unionByName(split(s, d, "valid"))
    name = F.concat("lang", F.col("n_chars").cast("string")).alias("n")
    digest = F.sha2("text", 256).alias("h")
    hashes = EMB(s, d).select("vec_id", F.pmod("vec_id", F.lit(10)).alias("m"), E.sign_hash(F.col("v")).alias("h"))
    named = hashes.where("m > 0").select("vec_id", F.when(F.col("m") == 1, "valid").otherwise("train").alias("split"))
    near = E.near_hashes(hashes.where("m = 0"), hashes.where("m > 0"), "vec_id", "h")
    return {
        "names": others.select("split", name).distinct().join(test.select(name).distinct(), "n").select("split", "n"),
        "content": test.select(digest, "doc_id").join(others.groupBy("split", digest).agg(F.min("doc_id").alias("other_id")), "h").select("split", "h", "doc_id", "other_id"),
        "types": others.select("split", "lang").intersect(test.select("lang").crossJoin(F.broadcast(s.createDataFrame([("train",), ("valid",)], "split string"))).select("split", "lang")),
        "near": near.join(named, near["b"] == named["vec_id"]).select("split", "a", "b", "bits"),
        "sources": split(s, d, "train").where(F.col("source").isin(*HELD_SOURCES)).select("split", "doc_id", "source"),
    }


SPLITS = "p AS (SELECT *, CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END AS split FROM documents)"
TR, TE = "SELECT * FROM documents WHERE doc_id % 10 > 1", "SELECT * FROM documents WHERE doc_id % 10 = 0"
HASHES_OF = with_views(f"WITH {HASHES} SELECT vec_id, h, ((vec_id % 10) + 10) % 10 AS m FROM hh", "emb_plus")
LEAK = {
    "names": f"WITH {SPLITS} SELECT DISTINCT split, lang || n_chars AS n FROM p WHERE split <> 'test' AND lang || n_chars IN (SELECT lang || n_chars FROM p WHERE split = 'test')",
    "content": f"WITH {SPLITS} SELECT b.split, sha256(a.text) AS h, a.doc_id, other_id FROM p a JOIN (SELECT split, sha256(text) AS h, min(doc_id) AS other_id FROM p WHERE split <> 'test' GROUP BY 1, 2) b ON sha256(a.text) = b.h WHERE a.split = 'test'",
    "types": f"WITH {SPLITS} SELECT DISTINCT split, lang FROM p WHERE split <> 'test' AND lang IN (SELECT lang FROM p WHERE split = 'test')",
    "near": f"SELECT CASE b.m WHEN 1 THEN 'valid' ELSE 'train' END AS split, a.vec_id AS a, b.vec_id AS b, CAST({HASH} AS INTEGER) AS bits FROM ({HASHES_OF}) a JOIN ({HASHES_OF}) b ON a.m = 0 AND b.m > 0 AND {HASH} <= 6",
    "sources": f"WITH {SPLITS} SELECT split, doc_id, source FROM p WHERE split = 'train' AND source IN ('src18', 'src19')",
}
add("j9_name_leaks", lambda s, d: leaks(s, d)["names"], LEAK["names"])
add("j10_content_leaks", lambda s, d: leaks(s, d)["content"], LEAK["content"])
add("u1_split_overlap", lambda s, d: leaks(s, d)["types"], LEAK["types"])
add("j11_near_leaks", lambda s, d: leaks(s, d)["near"], LEAK["near"])
add("g31_leak_verdict",
    lambda s, d: E.leak_verdict(leaks(s, d)),
    "WITH c AS (" + " UNION ALL ".join(f"SELECT '{k}' AS \"check\", (SELECT count(*) FROM ({q})) AS found" for k, q in LEAK.items()) + ") SELECT \"check\", CAST(found AS BIGINT) AS found, found = 0 AS passes FROM c UNION ALL SELECT '(all)', CAST(sum(found) AS BIGINT), sum(found) = 0 FROM c")
add("g32_type_in_two_splits",
    lambda s, d: T(s, d, "documents").select(F.concat("lang", F.col("n_chars").cast("string")).alias("kind"), (F.col("doc_id") % 10 == 0).alias("test")).groupBy("kind").agg(F.count_distinct("test").alias("splits")).where("splits > 1"),
    "SELECT lang || n_chars AS kind, count(DISTINCT doc_id % 10 = 0) AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 10 = 0) > 1")
add("u3_disjoint_types",
    lambda s, d: split(s, d, "test").select("source").distinct().join(split(s, d, "train").select("source").distinct(), "source", "left_anti").agg(F.count("*").alias("only_test")),
    f"SELECT count(DISTINCT source) AS only_test FROM ({TE}) WHERE source NOT IN (SELECT source FROM ({TR}))")
add("j12_held_out_types",
    lambda s, d: D.split_by_type(T(s, d, "part"), "p_brand", [], []).select("p_partkey", F.explode(F.filter(F.array(F.lit("STEEL"), F.lit("BRASS"), F.lit("#1")), lambda t: F.contains(F.concat_ws("+", "p_type", "p_brand"), t))).alias("held_out")),
    "SELECT p_partkey, h AS held_out FROM part, (SELECT unnest(['STEEL', 'BRASS', '#1']) AS h) WHERE contains(p_type || '+' || p_brand, h)")
add("j17_negatives",
    lambda s, d: T(s, d, "orders").select(F.col("o_orderkey").alias("img_id")).join(DET(s, d).where("confidence >= 0.8").groupBy("img_id").agg(F.count("*").alias("n")), "img_id", "left").select("img_id", F.coalesce("n", F.lit(0)).alias("n_boxes")),
    with_views("SELECT o_orderkey AS img_id, (SELECT count(*) FROM det_boxes d WHERE d.img_id = o_orderkey AND confidence >= 0.8) AS n_boxes FROM orders", "det_boxes"))
COND = "CASE WHEN {n} BETWEEN 0 AND 9 THEN 'table' WHEN {n} BETWEEN 10 AND 19 THEN 'keyboard' WHEN {n} BETWEEN 20 AND 29 THEN 'hand' WHEN {n} BETWEEN 30 AND 39 THEN 'partial' WHEN {n} BETWEEN 40 AND 49 THEN 'clutter' ELSE 'unknown' END"
add("j18_conditions",
    lambda s, d: D.capture_condition(T(s, d, "part").select("p_partkey", (F.col("p_partkey") % 60).cast("int").alias("number")), "number"),
    f"SELECT p_partkey, CAST(p_partkey % 60 AS INTEGER) AS number, {COND.format(n='(p_partkey % 60)')} AS condition FROM part")
PAR = """o AS (SELECT img_id, arg_max({'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}, (confidence, -det_idx)) AS d FROM det_boxes WHERE img_id % 7 <> 0 GROUP BY 1), n AS (SELECT img_id, arg_max({'x1': x1 + CASE WHEN img_id % 3 = 0 THEN 0.05 ELSE 0.0 END, 'y1': y1, 'x2': x2, 'y2': y2}, (confidence, -det_idx)) AS g FROM det_boxes WHERE img_id % 11 <> 0 GROUP BY 1)"""
add("j19_model_parity",
    lambda s, d: E.model_parity(DET(s, d).where("img_id % 7 <> 0"), DET(s, d).where("img_id % 11 <> 0").withColumn("x1", F.col("x1") + F.when(F.col("img_id") % 3 == 0, 0.05).otherwise(0.0))),
    with_views(f"WITH {PAR}, j AS (SELECT img_id, CASE WHEN d IS NOT NULL AND g IS NOT NULL THEN {IOU} END AS v FROM o FULL JOIN n USING (img_id)) SELECT img_id, round(v, 6) AS overlap, coalesce(v >= 0.95, false) AS same FROM j", "det_boxes"))


def metrics(s, d):
    return T(s, d, "lineitem").groupBy(F.concat(F.lit("rate_"), "l_returnflag").alias("metric")).agg(F.round(F.avg("l_discount"), 4).alias("value"))


GATES = [("rate_A", ">=", 0.01), ("rate_N", "<=", 0.01), ("rate_R", ">=", 0.2), ("missing", ">=", 0.5), ("missing_zero", ">=", 0.0)]
METRICS_SQL = "m AS (SELECT 'rate_' || l_returnflag AS metric, round(avg(l_discount), 4) AS value FROM lineitem GROUP BY 1), t AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in GATES) + ") x(metric, comparator, threshold)), g AS (SELECT metric, comparator, threshold, value, CASE WHEN value IS NULL AND threshold = 0 THEN 'UNMEASURED' WHEN value IS NULL THEN 'FAIL' WHEN (comparator = '>=' AND value >= threshold) OR (comparator = '<=' AND value <= threshold) THEN 'PASS' ELSE 'FAIL' END AS state FROM t LEFT JOIN m USING (metric))"
gate_rows = lambda s, d: E.gates(metrics(s, d), s.createDataFrame(GATES, "metric string, comparator string, threshold double"))
add("j20_gates", gate_rows, f"WITH {METRICS_SQL} SELECT * FROM g")
add("g35_gate_verdict",
    lambda s, d: E.verdict(gate_rows(s, d), gate_rows(s, d).where("comparator = '<='")),
    (
        f"WITH {METRICS_SQL}, f AS (SELECT state FROM g UNION ALL SELECT state FROM g WHERE comparator = '<=') SELECT count(*) FILTER (state = 'FAIL') AS blocking, CASE WHEN count(*) "
        f"FILTER (state = 'FAIL') = 0 THEN 'GO' ELSE 'NO_GO' END AS verdict FROM f"
    ))
CLAIMS = [("rate_A", 0.05, "pct_point", 0.02), ("rate_N", 0.5, "rel_pct", 5.0), ("rate_X", 1.0, "exact", 0.0)]
add("j21_reconcile",
    lambda s, d: E.reconcile(s.createDataFrame(CLAIMS, "metric string, claimed double, kind string, tolerance double"), metrics(s, d).withColumnRenamed("value", "measured")).select("metric", "claimed", "measured", "state"),
    f"WITH {METRICS_SQL}, c AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}::DOUBLE, '{k}', {t}::DOUBLE)" for a, b, k, t in CLAIMS) + (
        ") x(metric, claimed, kind, tolerance)) SELECT metric, claimed, value AS measured, CASE WHEN claimed IS NULL THEN 'UNCLAIMED' WHEN value IS NULL THEN 'UNMEASURED' WHEN (kind "
        "= 'pct_point' AND abs(claimed - value) <= tolerance) OR (kind = 'rel_pct' AND abs(claimed - value) <= abs(claimed) * tolerance / 100) OR (kind = 'exact' AND claimed = value) "
        "THEN 'MATCH' ELSE 'MISMATCH' END AS state FROM c FULL JOIN m USING (metric)"
    ))
add("g28_confusion_rates",
    lambda s, d: E.confusion_rates(T(s, d, "documents").select(F.col("lang").alias("truth"), F.when(F.col("n_chars") % 5 == 0, "en").otherwise(F.col("lang")).alias("predicted"))).select("class", "support", "predicted", "hits", "precision", "recall", "f1", "accuracy", "macro_f1", "status"),
    """WITH x AS (SELECT lang AS t, CASE WHEN n_chars % 5 = 0 THEN 'en' ELSE lang END AS p FROM documents), c AS (SELECT DISTINCT t AS class FROM x UNION SELECT DISTINCT p FROM x),
        y AS (SELECT class, (SELECT count(*) FROM x WHERE t = class) AS support, (SELECT count(*) FROM x WHERE p = class) AS predicted, (SELECT count(*) FROM x WHERE p = class AND t = class) AS hits FROM c)
        SELECT *, round(avg(f1) OVER (), 4) AS macro_f1 FROM (SELECT class, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, CAST(hits AS BIGINT) AS hits, round(hits / greatest(1, predicted), 4) AS "precision", round(hits / greatest(1, support), 4) AS recall,
            round(CASE WHEN hits > 0 THEN 2 * (hits / greatest(1, predicted)) * (hits / greatest(1, support)) / (hits / greatest(1, predicted) + hits / greatest(1, support)) ELSE 0.0 END, 4) AS f1, round(sum(hits) OVER () / sum(support) OVER (), 4) AS accuracy, CASE WHEN support >= 30 THEN 'MEASURED' ELSE 'TOO_FEW' END AS status FROM y)""")
add("g29_negative_rates",
    lambda s, d: E.false_positive_rates(T(s, d, "documents"), "source", F.col("n_chars") % 23 == 0),
    (
        "SELECT source, count(*) AS n, count(*) FILTER (n_chars % 23 = 0) AS fired, round(count(*) FILTER (n_chars % 23 = 0) / count(*), 4) AS rate, count(*) FILTER (n_chars % 23 = "
        "0) <= 0.05::DOUBLE * count(*) AS passes FROM documents GROUP BY ROLLUP (source)"
    ))
add("g30_dataset_counts",
    lambda s, d: T(s, d, "documents").withColumn("split", F.col("doc_id") % 10 == 0).cube("split", "lang").agg(F.count("*").alias("n")),
    "SELECT doc_id % 10 = 0 AS split, lang, count(*) AS n FROM documents GROUP BY CUBE (split, lang)")
add("g33_latency_figures",
    lambda s, d: E.latency_figures(views.reports(s, d), "latency_ms"),
    with_views("SELECT " + ", ".join(f"round(quantile_cont(latency_ms, {p / 100}), 4) AS p{p}" for p in (50, 95, 99)) + ", round(avg(latency_ms), 4) AS mean, (SELECT CAST(v[CAST(floor(len(v) * 0.95::DOUBLE) AS BIGINT) + 1] AS DOUBLE) FROM (SELECT list_sort(list(latency_ms)) AS v FROM reports)) AS p95_placed FROM reports", "reports"))
add("g37_field_robustness",
    lambda s, d: E.field_robustness(matched(s, d).withColumn("ms", F.floor(F.col("confidence") * 400 + F.col("det_idx") % 7)).withColumn("condition", F.col("img_id") % 4), "condition", "ms"),
    with_views(f"""WITH {MATCHED}, m AS (SELECT *, img_id % 4 AS condition, CAST(floor(confidence * 400 + det_idx % 7) AS BIGINT) AS ms FROM matched), v AS (SELECT condition, l[CAST(floor(len(l) * 0.95::DOUBLE) AS BIGINT) + 1] AS p95_ms FROM (SELECT condition, list_sort(list(ms)) AS l FROM m GROUP BY 1))
        SELECT condition, count(*) AS n, round(count(iou) / count(*), 4) AS detect_rate, round(avg(iou), 4) AS mean_iou, round(count(*) FILTER (iou >= 0.5) / count(*), 4) AS id_recall, max(p95_ms) AS p95_ms FROM m JOIN v USING (condition) GROUP BY 1""", "gt_boxes", "det_boxes"))
add("g38_liveness",
    lambda s, d: E.liveness(T(s, d, "lineitem").select(F.col("l_orderkey").alias("capture"), (F.col("l_discount") * 4).alias("ear"), F.col("l_quantity").alias("px"), (F.col("l_tax") * 100).alias("py"))).select("capture", "frames", "dips", "alive", F.round("min_ear", 6).alias("min_ear"), F.round("travel_x", 6).alias("travel_x"), F.round("travel_y", 6).alias("travel_y")),
    (
        "SELECT l_orderkey AS capture, round(min(l_discount * 4), 6) AS min_ear, round(max(l_quantity) - min(l_quantity), 6) AS travel_x, round(max(l_tax * 100) - min(l_tax * 100), "
        "6) AS travel_y, count(*) AS frames, count(*) FILTER (l_discount * 4 < 0.2::DOUBLE) AS dips, CASE WHEN count(*) >= 3 THEN count(*) FILTER (l_discount * 4 < 0.2::DOUBLE) > 0 "
        "OR max(l_quantity) - min(l_quantity) >= 20 OR max(l_tax * 100) - min(l_tax * 100) >= 20 END AS alive FROM lineitem GROUP BY 1"
    ))
# Dataset jobs.
add("p1_type_split",
    lambda s, d: D.split_by_type(T(s, d, "part"), "p_brand", ["Brand#11"], ["Brand#12"]).groupBy("split").agg(F.count("*").alias("n")),
    "SELECT CASE p_brand WHEN 'Brand#11' THEN 'test' WHEN 'Brand#12' THEN 'valid' ELSE 'train' END AS split, count(*) AS n FROM part GROUP BY 1")
add("p2_number_split",
    lambda s, d: D.split_by_number(T(s, d, "part"), F.col("p_size")).select("p_partkey", "split"),
    "SELECT p_partkey, CASE WHEN p_size < 32 THEN 'train' WHEN p_size < 36 THEN 'valid' ELSE 'test' END AS split FROM part")
add("p2_group_split", lambda s, d: D.split_by_group(T(s, d, "documents"), "source").select("doc_id", "split"),
    "SELECT doc_id, CASE WHEN h < 10 THEN 'test' WHEN h < 20 THEN 'valid' ELSE 'train' END AS split FROM (SELECT doc_id, CAST('0x' || left(sha256(source), 8) AS BIGINT) % 100 AS h FROM documents)")
BX = "greatest(0.0::DOUBLE, least(640.0::DOUBLE, {}))"
add("p3_box_conversion",
    lambda s, d: T(s, d, "lineitem").select("l_orderkey", "l_linenumber", D.yolo_to_coco(F.col("l_quantity") / 50, F.col("l_discount") * 5, F.col("l_tax") + 0.1, F.lit(0.3), 640, 640).alias("b")).select("l_orderkey", "l_linenumber", F.round("b.x", 1).alias("x"), F.round("b.w", 1).alias("w")),
    (
        f"SELECT l_orderkey, l_linenumber, round(round(a, 2), 1) AS x, round(round(b - a, 2), 1) AS w FROM (SELECT l_orderkey, l_linenumber, {BX.format('l_quantity / 50 * 640 - (l_tax + 0.1::DOUBLE) * 640 / 2')} "
        f"AS a, {BX.format('l_quantity / 50 * 640 - (l_tax + 0.1::DOUBLE) * 640 / 2 + (l_tax + 0.1::DOUBLE) * 640')} AS b FROM lineitem)"
    ))
add("p4_quads",
    lambda s, d: T(s, d, "part").select("p_partkey", D.quad_to_box(F.array(*[F.array(F.col("p_size") * a * 1.0 - 20, F.col("p_size") * b * 1.0 - 60) for a, b in ((1, 1), (9, 2), (8, 9), (2, 8))]), 300, 200).alias("b")).select("p_partkey", "b.*"),
    "SELECT p_partkey, " + ", ".join(f"CASE WHEN ok THEN {e} END AS {n}" for n, e in (("x", "x1"), ("y", "y1"), ("w", "x2 - x1"), ("h", "y2 - y1"))) + (
        " FROM (SELECT *, NOT (9 * p_size - 20 <= 0 OR p_size - 20 >= 300 OR 9 * p_size - 60 <= 0 OR p_size - 60 >= 200) AND x2 - x1 > 1 AND y2 - y1 > 1 AS ok FROM (SELECT p_partkey, "
        "p_size, greatest(0.0::DOUBLE, least(300.0::DOUBLE, p_size - 20)) AS x1, greatest(0.0::DOUBLE, least(200.0::DOUBLE, p_size - 60)) AS y1, greatest(0.0::DOUBLE, least(300.0::DOUBLE, "
        "9 * p_size - 20)) AS x2, greatest(0.0::DOUBLE, least(200.0::DOUBLE, 9 * p_size - 60)) AS y2 FROM part))"
    ))
add("p5_long_side",
    lambda s, d: T(s, d, "part").select("p_partkey", D.long_side(F.col("p_size") * 100, F.col("p_size") * 50 + 1).alias("b")).select("p_partkey", "b.width", "b.height"),
    (
        "SELECT p_partkey, CAST(round(p_size * 100 * least(1.0::DOUBLE, 1280 / (p_size * 100)), 0) AS INTEGER) AS width, CAST(round((p_size * 50 + 1) * least(1.0::DOUBLE, 1280 / (p_size "
        "* 100)), 0) AS INTEGER) AS height FROM part"
    ))
add("p6_sampled", lambda s, d: D.sampled(T(s, d, "documents"), "source", "doc_id", 20, 7).select("source", "doc_id"),
    "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id || ':7'), doc_id) AS r FROM documents) WHERE r <= 20")
add("p7_mrz_strips",
    lambda s, d: D.mrz_strips(GT(s, d).select("img_id", "label", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h")), "label", ["A", "R"]).select("label", "strip.*").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("h"), 4).alias("mean_h")),
    with_views("SELECT label, count(*) AS n, round(avg(0.25 * (y2 - y1)), 4) AS mean_h FROM gt_boxes WHERE label IN ('A', 'R') GROUP BY 1", "gt_boxes"))
add("p11_background_zones",
    lambda s, d: T(s, d, "part").select("p_partkey", F.explode(D.background_zones(F.col("p_size") * 4, F.col("p_size") * 2, F.lit(100), F.lit(80), 400, 300)).alias("z")).select("p_partkey", "z.*"),
    (
        "SELECT p_partkey, z.zone, z.x::DOUBLE AS x, z.y::DOUBLE AS y, z.w::DOUBLE AS w, z.h::DOUBLE AS h FROM (SELECT p_partkey, unnest([{'zone': 'above', 'x': 0, 'y': 0, 'w': 400, "
        "'h': p_size * 2, 's': p_size * 2}, {'zone': 'below', 'x': 0, 'y': p_size * 2 + 80, 'w': 400, 'h': 220 - p_size * 2, 's': 220 - p_size * 2}, {'zone': 'left', 'x': 0, 'y': 0, "
        "'w': p_size * 4, 'h': 300, 's': p_size * 4}, {'zone': 'right', 'x': p_size * 4 + 100, 'y': 0, 'w': 300 - p_size * 4, 'h': 300, 's': 300 - p_size * 4}]) AS z FROM part) WHERE z.s >= 64"
    ))
add("p12_letterbox",
    lambda s, d: T(s, d, "part").select("p_partkey", D.letterbox_to_image(F.col("p_size") * 5.0, F.lit(100.0), F.col("p_size") * 5.0 + 200, F.lit(400.0), F.lit(1280.0), F.lit(960.0)).alias("b")).select("p_partkey", F.round("b.x1", 4).alias("x1"), F.round("b.y2", 4).alias("y2")),
    "SELECT p_partkey, round(greatest(0.0::DOUBLE, least(1280.0::DOUBLE, p_size * 5 / 0.5)), 4) AS x1, round(greatest(0.0::DOUBLE, least(960.0::DOUBLE, (400 - 80) / 0.5)), 4) AS y2 FROM part")
add("u2_dense_ids",
    lambda s, d: D.merged_sources({"a": (T(s, d, "orders").select(F.col("o_orderkey").alias("image_id")), GT(s, d).select(F.col("img_id").alias("image_id"))), "b": (T(s, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("image_id")), DET(s, d).select(F.col("img_id").alias("image_id")))})[0].agg(F.count("*").alias("images"), F.count_distinct("new_id").alias("ids"), F.min("new_id").alias("low"), F.max("new_id").alias("high")),
    "SELECT n AS images, n AS ids, CAST(1 AS BIGINT) AS low, n AS high FROM (SELECT count(*) + count(*) FILTER (o_orderkey % 2 = 0) AS n FROM orders)")
add("u2_merged_sources",
    lambda s, d: (lambda m: m[1].groupBy("source").agg(F.count("*").alias("annotations"), F.count_distinct("new_id").alias("images"), F.max("new_id").alias("max_id")).drop("max_id"))(D.merged_sources({"a": (T(s, d, "orders").select(F.col("o_orderkey").alias("image_id")), GT(s, d).select(F.col("img_id").alias("image_id"), "label")), "b": (T(s, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("image_id"), F.lit(1).alias("extra")), DET(s, d).where("img_id % 2 = 0").select(F.col("img_id").alias("image_id"), "label"))})),
    with_views((
        "SELECT 'a' AS source, count(*) AS annotations, count(DISTINCT img_id) AS images FROM gt_boxes WHERE img_id IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'b', count(*), "
        "count(DISTINCT img_id) FROM det_boxes WHERE img_id % 2 = 0 AND img_id IN (SELECT o_orderkey FROM orders)"
    ), "gt_boxes", "det_boxes"))
