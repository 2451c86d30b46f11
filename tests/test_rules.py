"""Hand cases of rules, links, ledger and evaluation."""

import datetime
import hashlib
import hmac
import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from passgrid.functions import identifiers as I
from passgrid.functions import names as N
from passgrid.functions import seals
from passgrid.functions import text as X
from passgrid.operators import evalkit, extraction, ledger, links, risk, rows

T = datetime.datetime


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_check_digits(spark):
    lit = F.lit
    assert [one(spark, I.check_digit(lit(s))) for s in ("L898902C3", "740812", "120415")] == [6, 2, 9]
    assert one(spark, I.verhoeff(lit("234123412346"))) and not one(spark, I.verhoeff(lit("234123412345"))) and not one(spark, I.verhoeff(lit("12")))
    assert one(spark, I.mask(lit("ab-1234567"))) == "*****4567" and one(spark, I.norm(lit(" ka-01/2020 "))) == "KA012020"


def test_soundex_resets_at_vowels_and_h(spark):
    assert [one(spark, N.soundex(F.lit(s))) for s in ("ASHCRAFT", "Robert", "RUPERT", "", "Tymczak")] == ["A226", "R163", "R163", "0000", "T522"]


def test_seal_is_hmac(spark):
    for key in (b"k", b"x" * 100):
        assert one(spark, seals.hmac_sha256(key, F.lit("payload é"))) == hmac.new(key, "payload é".encode(), hashlib.sha256).hexdigest()


@pytest.mark.parametrize("cell", ["=A1", "+1", "-1", "@x", "\tq", "\rq"])
def test_hostile_cells(spark, cell):
    assert one(spark, seals.safe_cell(F.lit(cell))) == "'" + cell


def merkle(leaves):
    while len(leaves) > 1:
        leaves = [hashlib.sha256(f"{leaves[i]}:{leaves[min(i + 1, len(leaves) - 1)]}".encode()).hexdigest() for i in range(0, len(leaves), 2)]
    return leaves[0]


def test_merkle_roots(spark):
    want, data = {}, []
    for n in (1, 2, 3, 4, 5, 7, 8, 1024, 1025, 2050):
        leaves = [hashlib.sha256(f"{n}/{i}".encode()).hexdigest() for i in range(n)]
        want[n] = merkle(leaves)
        data += [(n, i, h) for i, h in enumerate(leaves)]
    random.Random(1).shuffle(data)
    got = ledger.merkle_roots(spark.createDataFrame(data, "n int, i int, h string"), ["n"], "h", ["i"])
    assert {r.n: r.root for r in got.collect()} == want


def reports(spark, *rows_):
    return spark.createDataFrame(list(rows_), "id long, created_at timestamp, file_hash string, checkpoint string, doc_no string, name string, dob string, verdict string, risk_score int")


def test_recidivism_and_burst(spark):
    t = lambda m: T(2024, 1, 1, 0, m)
    r = reports(spark, (1, t(0), "a", "X", "P12345", "ANA", "1990-01-01", "FLAGGED", 80), (2, t(1), "b", "Y", "P12345", "BOB", "1991-01-01", "CLEAR", 10), (3, t(2), "c", "X", "P12345", "ANA", "1990-01-01", "REVIEW", 40), (4, t(3), "a", "X", "P12345", "ANA", "1990-01-01", "REVIEW", 40), (5, t(4), "z", "X", "P1", "ANA", None, "FLAGGED", 90))
    bumps = {x.id: x.b for x in links.recidivism_alerts(r).groupBy("id").agg(F.sum("bump").alias("b")).collect()}
    assert bumps == {2: 95, 3: 20 + 95, 4: 95 + 20}
    burst = {x.id: x.recent for x in links.burst_alerts(r, F.col("verdict") != "CLEAR").collect()}
    assert burst == {4: 3, 5: 4}
    assert links.undated(r.withColumn("created_at", F.lit(None).cast("timestamp"))).first()[0] == 5


def test_overlap_of_a_third(spark):
    box = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 0.0, 15.0, 10.0)], "x1 double, y1 double, x2 double, y2 double, g_x1 double, g_y1 double, g_x2 double, g_y2 double")
    assert abs(box.select(evalkit.iou()).first()[0] - 1 / 3) < 1e-12


def test_greedy_and_suppression(spark):
    box = "img_id long, label string, {} x1 double, y1 double, x2 double, y2 double"
    truths = spark.createDataFrame([(1, "a", 0, 0.0, 0.0, 10.0, 10.0), (1, "a", 1, 1.0, 0.0, 11.0, 10.0), (2, "a", 0, 0.0, 0.0, 1.0, 1.0)], box.format("gt_idx int,"))
    dets = spark.createDataFrame([(1, "a", 0, 0.9, 0.5, 0.0, 10.5, 10.0), (1, "a", 1, 0.8, 0.0, 0.0, 10.0, 10.0), (1, "a", 2, 0.2, 50.0, 0.0, 60.0, 10.0)], box.format("det_idx int, confidence double,"))
    got = {(r.img_id, r.conf): (r.n_det, r.n_gt, r.n_tp) for r in evalkit.greedy_counts(dets, truths, [0.1, 0.85]).collect()}
    assert got == {(1, 0.1): (3, 2, 2), (1, 0.85): (1, 2, 1), (2, 0.1): (0, 1, 0), (2, 0.85): (0, 1, 0)}
    assert sorted(r.det_idx for r in evalkit.suppress(dets).collect()) == [0, 2]


def test_near_hashes_lose_none(spark):
    rng = random.Random(2)
    a = [(i, rng.getrandbits(63)) for i in range(300)]
    b = [(1000 + i, h ^ sum(1 << k for k in rng.sample(range(63), rng.randint(0, 9)))) for i, h in a]
    want = {(i, j) for i, x in a for j, y in b if (x ^ y).bit_count() <= 6}
    df = lambda x: spark.createDataFrame(x, "k long, h long")
    assert {(r.a, r.b) for r in evalkit.near_hashes(df(a), df(b), "k", "h").collect()} == want


def test_rules_fold_in_order(spark):
    df = spark.createDataFrame([(1, True, False), (2, False, False), (3, True, True)], "k int, identified boolean, specimen boolean").withColumn("pan", F.col("identified"))
    got = {r.k: (r.risk, r.hard_flag, r.can_clear, r.grade, r.reasons) for r in risk.score(df).collect()}
    assert got[1] == (17, False, True, "CLEAR", ["pan_read"])
    assert got[2] == (80, True, False, "FLAGGED", ["unrecognised", "nothing_read"])
    assert got[3][0] == 95 and got[3][4] == ["pan_read", "specimen"]


def test_dates_and_names(spark):
    d = datetime.date
    assert [one(spark, X.parse_date(F.lit(s))) for s in ("31-12-2031", "1990/8/5", "510101", "31-02-2001", "x", "")] == [d(2031, 12, 31), d(1990, 8, 5), d(1951, 1, 1), None, None, None]
    assert one(spark, X.birth_date(F.lit("VALID TILL: 31-12-2031 Born 15-08-1990"), F.lit("2026-01-01").cast("date"))) == d(1990, 8, 15)
    pairs = spark.createDataFrame([("MR A SHARMA", "ASHA SHARMA"), ("Ram Das", "Das Ram"), ("JOHN DOE", "MARY MAJOR")], "a string, b string")
    assert [r.same for r in extraction.name_pairs(pairs, "a", "b").collect()] == [True, True, False]


def test_secrets(spark):
    t = one(spark, X.redacted(F.lit("db postgres://u:hunter2@h/x key sk-abcdefghijklmnopqrst at 10.0.0.1 auth_token = \"deadbeef99\"")))
    assert "hunter2" not in t and "sk-abc" not in t and "10.0.0.1" not in t and "deadbeef99" not in t


def test_restore(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "id int, removed int")
    assert {r.id for r in rows.not_removed(rows.restore(df, df.where("id = 1"))).collect()} == {1, 3}


def test_redaction_query_digests_every_document(spark, tmp_path):
    import hashlib

    from passgrid.plans.identifiers import BOOK

    texts = {1: ("plain", "plain"), 2: ("mail a@b.cz", "mail [REDACTED_MAIL]"), 3: ("at 10.0.0.1", "at [REDACTED_IP]"), 4: ("key sk-abcdefghijklmnopqrst 1234567812345678", "key [REDACTED_AI_API_KEY] [REDACTED_NUMBER]")}
    spark.createDataFrame([(k, a) for k, (a, _) in texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.digest for r in BOOK.queries["d20_redaction"](spark, str(tmp_path)).collect()}
    assert got == {k: hashlib.sha256(b.encode()).hexdigest() for k, (_, b) in texts.items()}


def test_running_counts_of_a_hot_number(spark):
    """One number holds half of all reports: banded by days it gives the same counts, and no task has more of it than a day."""
    rng = random.Random(2)
    rows = [(i, T(2024, 1, 1) + datetime.timedelta(hours=rng.randint(0, 700)), f"f{rng.randint(0, 40)}" if i % 9 else None, rng.choice("AB"), rng.choice(["x", "y", None]), rng.choice(["d", None]), rng.choice(["FLAGGED", "CLEAR", None]), "hot45" if i % 2 else f"num{i % 17:02d}") for i in range(600)]
    reports = spark.createDataFrame(rows, "id long, created_at timestamp, file_hash string, checkpoint string, name string, dob string, verdict string, doc_no string")
    want = sorted(map(tuple, reports_brute(rows)))
    for hot in (10**6, 100, 0):
        assert sorted(map(tuple, links.alert_counts(reports, hot).select("id", "checkpoint", "kind", "n").collect())) == want
        priors = {r[0]: [p[0] for p in rows if p[7] == r[7] and (p[1], p[0]) < (r[1], r[0]) and p[2] and r[2] and p[2] != r[2]] for r in rows}
        assert sorted(map(tuple, links.prior_figures(reports, hot).collect())) == sorted((i, len(p), max(p)) for i, p in priors.items() if p)
    assert links.alert_counts(reports).where("kind = 'NAME_CLASH'").count() > 0
    days = reports.where("doc_no = 'hot45'").groupBy(F.to_date("created_at")).count().agg(F.max("count")).first()[0]
    assert days < 30


def reports_brute(rows):
    out = Counter()
    for r in rows:
        for p in rows:
            if p[7] == r[7] and (p[1], p[0]) < (r[1], r[0]) and p[2] is not None and r[2] is not None and p[2] != r[2]:
                kinds = [k for k, i in (("NAME_CLASH", 4), ("DOB_CLASH", 5), ("CROSS_CHECKPOINT", 3)) if None not in (r[i], p[i]) and r[i] != p[i]]
                kinds += ["PREVIOUSLY_FLAGGED"] if r[3] == p[3] and p[6] in ("FLAGGED", "REVIEW") else []
                out.update((r[0], r[3], k) for k in kinds)
    return [(*k, n) for k, n in out.items()]


@pytest.mark.parametrize("block,tile,least", [(1024, 32, 0.9), (20, 2, 0.9), (7, 3, 0.5), (50, 1, -0.5), (30, 4, -1.0)])
def test_all_pairs_by_blocks(spark, block, tile, least):
    rng = np.random.default_rng(0)
    points = np.concatenate([c + 0.1 * rng.normal(size=(30, 5)) for c in rng.normal(size=(8, 5))]).tolist()
    points += [points[3]] * 40 + [[0.0] * 5, [0.0, 0.0]] + [[1.0, 2.0]]
    rows = [(i, p) for i, p in enumerate(points)]
    table = spark.createDataFrame([*rows, (900, None), (901, [1.0, None]), (902, [float("nan")] * 5)], "k long, v array<double>")
    counts, pairs = evalkit.all_pairs(table, "k", "v", least, block, tile)
    m = np.array([p + [0.0] * (5 - len(p)) for p in points])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    i, j = np.nonzero(np.triu(m @ m.T >= least, 1))
    got = sorted((r.a, r.b) for r in pairs.collect())
    assert got == sorted(zip(i.tolist(), j.tolist(), strict=True))
    assert tuple(counts.agg(F.sum("n_pairs"), F.sum("n_above")).first()) == (len(points) * (len(points) - 1) // 2, len(got))
    if block < 100 and least > 0:
        assert evalkit.pair_plan(table, "k", "v", least, block, tile)[1].skipped() > 0.3


def test_no_vectors_no_pairs(spark):
    counts, pairs = evalkit.all_pairs(spark.createDataFrame([], "k long, v array<double>"), "k", "v", 0.5)
    assert pairs.collect() == [] and tuple(counts.agg(F.sum("n_pairs"), F.sum("n_above")).first()) == (0, 0)


def test_zones_by_hand(spark):
    td3 = ["P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"]
    td1 = ["I<UTOD231458907<<<<<<<<<<<<<<<", "7408122F1204159UTO<<<<<<<<<<<6", "ERIKSSON<<ANNA<MARIA<<<<<<<<<<"]
    td2 = ["I<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<", "D231458907UTO7408122F1204159<<<<<<<6"]
    texts = {
        "passport": ["REPUBLIC OF UTOPIA", *td3, "page 1"], "card": ["IDENTITY", *td1], "small": [*td2], "broken order": [td3[1], td3[0]], "misread": [td3[0], td3[1].replace("7408122", "74O8I22")],
        "lone": ["x", td3[1]], "wrong": [td3[0], td3[1].replace("7408122", "7408129")], "lone and wrong": [td3[1].replace("7408122", "7408129")], "none": ["hello", "A" * 50], "long": [f"{td3[0]}<<", f"{td3[1]}<"],
    }
    df = spark.createDataFrame([(k, "\n".join(v)) for k, v in texts.items()] + [("null", None), ("empty", "")], "k string, text string")
    got = {r.k: (r.format, r.checked, r.corrected, r.number, r.surname, r.given_names, r.birth, r.issuer) for r in extraction.zone_search(df, "k", "text").collect()}
    whole = ("L898902C3", "ERIKSSON", "ANNA MARIA", "740812", "UTO")
    assert got["passport"] == got["long"] == ("TD3", True, False, *whole) and got["misread"] == ("TD3", True, True, *whole)
    assert got["card"] == ("TD1", True, False, "D23145890", *whole[1:]) and got["small"] == ("TD2", True, False, "D23145890", *whole[1:])
    assert got["broken order"][:4] == ("TD3", True, False, "L898902C3") and got["broken order"][6] == "740812"
    assert got["lone"] == ("TD3", True, False, "L898902C3", "", "", "740812", "UTO")
    assert got["wrong"][:4] == ("TD3", False, False, "L898902C3") and got["wrong"][4] == "ERIKSSON" and got["lone and wrong"][:2] == ("TD3", False)
    assert not {"none", "null", "empty"} & set(got)


def test_block_ratio_is_the_gestalt_one():
    rng = random.Random(4)
    pools = ["AB", "ABCDE ", "ASHARMKUN ", "é日x\x00"]
    pairs = [("", ""), ("", "A"), ("A", ""), ("ABAB", "BABA"), ("ASHA SHARMA", "SHARMA ASHA")]
    pairs += [("".join(rng.choice(pool) for _ in range(rng.randint(0, 30))), "".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))) for pool in pools for _ in range(150)]
    long = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(150)) + "AB" * 40
    pairs += [(long, long[:90] + "zz" + long[95:]), (long[5:], long + "A"), ("ABABAB" + long[10:60], long), ("AB" * 110, "BA" * 110)]
    got = N.block_ratio([a for a, _ in pairs], [b for _, b in pairs]).tolist()
    assert got == pytest.approx([SequenceMatcher(None, a, b).ratio() for a, b in pairs], abs=1e-12)
    assert N.block_ratio([], []).tolist() == []


def test_every_rule_of_name_pairs(spark, small):
    """The whole table against the rules by hand; each of the six decides some pairs."""
    from passgrid.plans.identifiers import name_pair_texts

    def code(name):
        groups = {c: d for d, cs in N.SOUNDEX.items() for c in cs}
        letters = [c for c in name if "A" <= c <= "Z"]
        codes = [groups.get(c, "0") for c in letters]
        return (letters[0] + "".join(c for p, c in zip(codes, codes[1:], strict=False) if c != "0" and c != p) + "0000")[:4]

    def rule(a, b):
        x, y = ([t for t in n.split() if t not in N.HONORIFICS] for n in (a, b))
        ratio = lambda p, q: SequenceMatcher(None, p, q).ratio()
        if set(x) <= set(y) or set(y) <= set(x):
            return "tokens"
        if len(x) == len(y) and all(p == q or len(p) == 1 and q.startswith(p) or len(q) == 1 and p.startswith(q) for p, q in zip(x, y, strict=True)):
            return "initials"
        if ratio(" ".join(x), " ".join(y)) >= 0.8:
            return "similar"
        if min(len(x), len(y)) >= 2 and x[-1] == y[-1] and ratio(x[0], y[0]) >= 0.7:
            return "surname"
        return "sound" if code("".join(x)) == code("".join(y)) else "none"

    rows_ = extraction.name_pairs(name_pair_texts(spark, small), "a", "b").collect()
    assert [r.reason for r in rows_] == [rule(r.a, r.b) for r in rows_]
    assert {r.reason for r in rows_} == {"tokens", "initials", "similar", "surname", "sound", "none"} and len(rows_) == 150
