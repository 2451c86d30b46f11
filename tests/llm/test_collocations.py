"""Phrase collocations against a count of everything."""

import random
from collections import Counter
from fractions import Fraction

import pytest

from passgrid.llm import collocations as mined
from passgrid.llm.collocations import collocations, score
from tests.llm.test_operators import ROWS, SCHEMA


def brute(rows, least, absorbed=100, most=2000):
    """The definition, by counting every phrase."""
    lower = {c: c + 32 for c in range(65, 91)}
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        pieces = [[]]
        for c in (text or "").translate(lower):
            if c in ".,;:!?\n\x0b\x0c\r":
                pieces.append([])
            else:
                pieces[-1].append(c)
        for piece in pieces:
            words = [w for w in "".join(piece).replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for k in range(1, 12):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {(lang, p): a for (lang, p), a in f.items() if 2 <= len(p) <= 5 and a >= least}
    gone = set()
    for (lang, p), a in candidates.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                if 100 * a >= absorbed * candidates.get((lang, p[i : i + size]), 10**9):
                    gone.add((lang, p[i : i + size]))
    found = {}
    for (lang, p), a in candidates.items():
        if (lang, p) not in gone:
            low, _, left, right = min((int(Fraction(1000 * a * n[lang], f[lang, p[:k]] * f[lang, p[k:]])), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found.setdefault(lang, []).append((-low, -a, " ".join(p).encode(), left, right))
    return [(lang, rank, p.decode(), -a, left, right, n[lang], -low) for lang, own in sorted(found.items()) for rank, (low, a, p, left, right) in enumerate(sorted(own)[:most], 1)]


def random_rows():
    rng = random.Random(3)
    words = ["The", "of", "a", "b", "a\x01", "ab", "é", "日本", "😀", "x\xa0y", "Ofé", "z\x1f", "in"]
    passage = "once more unto the breach dear friends"
    out = []
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "\r", ",", "! "]) for _ in range(rng.randint(0, 40)))
        out.append((rng.choice(["en", "en", "fr", None, "und"]), text + (passage if i % 3 == 0 else "")))
    return [*out, ("en", None), (None, ""), ("", " . "), ("de", "a b a b a b a b")]


@pytest.mark.parametrize("windows,phrases,block", [(2_000_000, 200_000, 2_000_000), (150, 20, 400), (1000, 7, 90)])
def test_all_phrases(spark, monkeypatch, windows, phrases, block):
    monkeypatch.setattr(mined, "RANGE_WINDOWS", windows)
    monkeypatch.setattr(mined, "RANGE_PHRASES", phrases)
    monkeypatch.setattr(mined, "BLOCK_WORDS", block)
    rows = random_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = sorted(map(tuple, collocations(docs, least=3).collect()))
    assert got == sorted(brute(rows, 3))
    assert any(" friends" in r[2] for r in got)
    assert sorted(map(tuple, collocations(docs, least=2, absorbed=60, most=9).collect())) == sorted(brute(rows, 2, 60, 9))


def test_hard_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    assert sorted(map(tuple, collocations(docs, least=2).collect())) == sorted(brute([(r[2], r[1]) for r in ROWS], 2))
    assert collocations(docs.limit(0)).collect() == []


def test_one_very_long_text(spark):
    text = " ".join(f"w{i % 5003} x{i % 7}" for i in range(400_000))
    docs = spark.createDataFrame([("en", text), ("en", "w1 x1.")], "lang string, text string")
    assert sorted(map(tuple, collocations(docs, least=160, most=50).collect())) == sorted(brute([("en", text), ("en", "w1 x1.")], 160, most=50))


def test_products_beyond_64_bits(spark):
    a, n, left, right = 4 * 10**14, 9 * 10**15, 5 * 10**14, 7 * 10**14
    row = spark.sql(f"SELECT {score(f'{a}L', f'{n}L', f'{left}L', f'{right}L')} AS s").first()
    assert row.s == 1000 * a * n // (left * right)
