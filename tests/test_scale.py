"""What must not grow with the tables: work on one task, expressions reckoned over and over, filters moved below dealt rows."""

import datetime
import random

from pyspark.sql import functions as F

from passgrid.functions import text as X
from passgrid.operators import evalkit, extraction, links
from passgrid.plans import registry
from passgrid.sources.identifiers import identifiers
from passgrid.streaming import jobs


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_holders_are_dealt(spark, small):
    """One row group of customers is not one task."""
    assert identifiers(spark, small).rdd.getNumPartitions() >= 8


def test_each_check_digit_once(spark, small):
    """Both readings of a line share one expression, with four digits; a line is made with four."""
    df = spark.createDataFrame([("x", "y")], "a string, b string")
    for z in (X.parse_td1(F.col("a"), F.col("b"), F.col("a")), X.parse_td2(F.col("a"), F.col("b")), X.parse_line2(F.col("b")), X.repaired_line2(F.col("b"))):
        assert plan(df.select(z.alias("z"))).count("aggregate(") <= 4
    assert plan(identifiers(spark, small).select("mrz2")).count("aggregate(") <= 4
    assert plan(df.select(X.find_passport(F.col("a")).alias("p"))).count("aggregate(") <= 3


def test_found_rows_above_dealt_ones(spark, small):
    """The search for a name or a pair of lines is reckoned once and above the dealing, not in a filter at the scan."""
    for name in ("d14_holder_names", "d11_mrz_candidates"):
        below = plan(registry.QUERIES[name](spark, small)).split("RepartitionByExpression")[-1]
        assert "transform(" not in below, name


def test_holder_layouts(spark):
    """A glued surname, a guardian by a label, a name on the label's line, and a null text."""
    rows = [(1, "XXXX\nLEENAPATIL"), (2, "Asha Rao\nS/O Ram Rao"), (3, "Name: Sita Verma"), (4, None), (5, "12")]
    got = {r.k: r.name for r in extraction.holder_names(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()}
    assert got == {1: "LEENA PATIL", 2: "Asha Rao", 3: "Sita Verma"}


def test_pairs_of_lines(spark):
    """A text of one line, none, and two pairs that differ by their digits."""
    first, good = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"
    rows = [(1, first), (2, None), (3, f"{first}\n{'P' * 44}\nx\n{first}\n{good}")]
    got = [tuple(r) for r in extraction.mrz_pairs(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()]
    assert got == [(3, 3, first, good, 4)]


BOXES = "img_id long, label string, {} x1 double, y1 double, x2 double, y2 double"


def overlap(a, b):
    i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
    return i / union if union > 0 else 0


def test_boxes_of_images_cut_by_batches(spark, monkeypatch):
    """Images of many boxes in small batches and few pairs at a time, null labels and surenesses: as one after the other, and no image is packed as a row."""
    rng = random.Random(5)
    corner = lambda: (x := rng.random() * 3, y := rng.random() * 3, x + 1 + rng.random(), y + 1 + rng.random())
    place = lambda i: (i % 7, "ab"[i % 2] if i % 11 else None)
    d = [(*place(i), i, rng.randint(0, 9) / 10 if i % 13 else None, *corner()) for i in range(150)]
    g = [(*place(i), i, *corner()) for i in range(90)]
    dets, truths = spark.createDataFrame(d, BOXES.format("det_idx long, confidence double,")), spark.createDataFrame(g, BOXES.format("gt_idx long,"))
    monkeypatch.setattr(evalkit, "PAIRS", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        counts = evalkit.greedy_counts(dets, truths, [0.2, 0.6], 0.3)
        got = {(r.img_id, r.label, r.conf): (r.n_det, r.n_gt, r.n_tp) for r in counts.collect()}
        sums = evalkit.greedy_counts(dets, truths, [0.2, 0.6], 0.3, per_image=False).groupBy("label", "conf").agg(F.sum("n_tp").alias("n")).collect()
        kept = evalkit.suppress(dets, 0.3)
        left = sorted(r.det_idx for r in kept.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for p in {x[:2] for x in d + g}:
        for c in (0.2, 0.6):
            sure, taken = [x for x in d if x[:2] == p and x[3] is not None and x[3] >= c], set()
            for x in sure if p[1] else []:
                taken.update([y[2] for y in g if y[:2] == p and y[2] not in taken and overlap(x[4:], y[3:]) >= 0.3][:1])
            want[(*p, c)] = len(sure), sum(y[:2] == p for y in g), len(taken)
    assert got == want
    assert {(r.label, r.conf): r.n for r in sums} == {(l, c): sum(v[2] for k, v in want.items() if k[1:] == (l, c)) for l in ("a", "b", None) for c in (0.2, 0.6)}
    alive = []
    for x in sorted((x for x in d if x[1]), key=lambda x: (0, 0, x[2]) if x[3] is None else (1, -x[3], x[2])):
        if all(y[:2] != x[:2] or overlap(x[4:], y[4:]) <= 0.3 for y in alive):
            alive.append(x)
    assert left == sorted(x[2] for x in alive)
    for df in (counts, kept):
        assert "collect_list" not in plan(df)
    matched = evalkit.best_truth(dets, truths)
    tps = evalkit.true_positive_counts(matched, [0.3, 0.5])
    assert "Generate" not in plan(tps).split("Window")[-1]
    slow = {(r.label, r.t): (r.tp, r.n) for r in evalkit.true_positives(matched, [0.3, 0.5]).groupBy("label", "t").agg(F.sum("tp").alias("tp"), F.count("*").alias("n")).collect()}
    assert {(r.label, r.t): (r.tp, r.n) for r in tps.collect()} == slow
    assert plan(registry.QUERIES["w7_true_positives"](spark, "/root/testdata/sf0.001")).split("Window")[-1].count("Generate") == 0


def test_alerts_by_one_sort(spark, small):
    """Running counts of the alerts share one sort: no window, and no scan for hot numbers if there are none."""
    df = registry.QUERIES["w1_recidivism_alerts"](spark, small)
    assert plan(df).count("Sort ") == 1 and "Window" not in plan(df)
    assert plan(df).count("o_orderkey") and plan(df).count("Relation") == 3


def test_alerts_of_numbers_cut_by_batches(spark, small):
    reports = registry.links.R(spark, small)
    want = sorted(map(tuple, links.alert_counts(reports, 0).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert sorted(map(tuple, links.alert_counts(reports).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_priors_by_one_sort_of_the_reports(spark, small):
    """No report is multiplied by places before it is sorted, and last ones of a day need no sort of the reports."""
    df = registry.QUERIES["t4_recidivism"](spark, small)
    assert "Join" not in plan(df) and "Window" not in plan(df)
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_priors_of_identifiers_cut_by_days_and_batches(spark, monkeypatch):
    """Nulls, equal times, equal ids, times before 1970, ids below 0 and over 2 ** 53: as one after the other, in small batches too."""
    rng, start = random.Random(20), datetime.datetime(1969, 12, 30)
    big = lambda i: (i - 60) * 2**56 + i
    rows = [(rng.choice(["h", "h", "g", None]), big(i), rng.choice(["A", "B", "C", None]), start + datetime.timedelta(hours=rng.randrange(100)) if i % 9 else None) for i in range(120)]
    rows += [(h, 7, p, start) for h in "hk" for p in "AB"] + [("h", None, "D", start + datetime.timedelta(hours=90)), ("one", 1, "A", start), ("two", 2, "A", start), ("two", 3, "B", start + datetime.timedelta(days=4000))]
    reports = spark.createDataFrame(rows, "identifier_hash string, id long, checkpoint string, created_at timestamp")
    whole = [r for r in rows if r[0] and r[2] and r[3]]
    order = lambda r: (r[3], r[1] is not None, r[1] or 0)
    want = []
    for h, i, place, t in whole:
        earlier = [p for p in whole if p[0] == h and p[1] is not None and p[2] != place and order(p) < order((h, i, place, t))]
        for other in {p[2] for p in earlier}:
            want.append((h, i, place, other, max((p for p in earlier if p[2] == other), key=order)[1]))
    key = lambda r: tuple(map(str, r))
    got = lambda: sorted(map(tuple, jobs.recidivism_batch(reports).collect()), key=key)
    assert want and got() == sorted(want, key=key)
    monkeypatch.setattr(jobs, "PRIORS", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert got() == sorted(want, key=key)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_priors_of_columns_without_nulls(spark):
    """Times declared without nulls, over two days: heads have none."""
    t = datetime.datetime(2024, 1, 1)
    schema = "identifier_hash string NOT NULL, id long NOT NULL, checkpoint string NOT NULL, created_at timestamp NOT NULL"
    reports = spark.createDataFrame([("h", 1, "A", t), ("h", 2, "B", t + datetime.timedelta(days=1)), ("h", 3, "B", t + datetime.timedelta(days=2))], schema)
    assert sorted(map(tuple, jobs.recidivism_batch(reports).collect())) == [("h", 2, "B", "A", 1), ("h", 3, "B", "A", 1)]
    assert jobs.recidivism_batch(reports.limit(0)).collect() == []


def test_priors_of_times_without_a_zone(spark):
    """An hour that the session's zone skips is not laid on the next one."""
    t = datetime.datetime(2024, 3, 10, 2, 50)
    reports = spark.createDataFrame([("h", 2, "A", t), ("h", 1, "B", t + datetime.timedelta(minutes=20))], "identifier_hash string, id long, checkpoint string, created_at timestamp_ntz")
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert [tuple(r) for r in jobs.recidivism_batch(reports).collect()] == [("h", 1, "B", "A", 2)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
