"""Every operator against brute force, on the smallest tables and on hard rows.

The hard rows hold nulls in all columns, empty and very long texts, ties, repeated rows and
columns whose names clash with the operators' own.
"""

import hashlib
import json
import math
import re
import shutil
import struct
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from passgrid.llm import common
from passgrid.llm import jaccard_join as jaccard
from passgrid.llm import topk_search as topk
from passgrid.llm.jaccard_join import Shingles, jaccard_join, keep_representatives
from passgrid.llm.license_scan import BASE_PHRASES, TEMPLATES, Automaton, scan_licenses, split_words
from passgrid.llm.materialise import feistel, materialise, read_slots
from passgrid.llm.media import decode_png, encode_png, media_columns, payload_of
from passgrid.llm.mixing import mixture, rake, sample_mixture
from passgrid.llm.packing import fullest, minimum_bin_slack, pack
from passgrid.llm.pii import Boosted, find_pii, redact
from passgrid.llm.quality import Machine, keep_good, score_quality, train
from passgrid.llm.token_counts import count_tokens
from passgrid.llm.topk_search import top_k
from passgrid.llm.wordpieces import word_tokenizer

#: Columns beside those of documents: names with dots, and the names that operators use or return themselves.
EXTRA = ["node", "tile", "row", "length", "a.b", "mix_weight", "MIX_probability", "__gone", "__text", "__spans", "__base", "__topic", "c0", "c1", "cell_0", "n_tokens", "topic", "key", "class_id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
LONG = " ".join(f"word{i % 977} and{i % 31}," for i in range(9000))
NEAR = " ".join(f"tok{i}" for i in range(60))
TEXTS = [
    None, "", " \n\t ", "!!! ???", "one", "One two three four", NEAR, NEAR, NEAR.replace("tok7", "tok7x"), NEAR + " tail", LONG, LONG + " more",
    "Don't we'll İstanbul ǅ é́ <|endoftext|> <|startoftext|>x 12½ \x1c 日本語 😀", "Released under the MIT License. GNU general-public LICENSE; cc by Apache License!",
    "mail a@b.c, b@c.d.e@f.g ip 1.2.3.4 999.1.1.1 card 4111 1111 1111 1111, 4111111111111112 call +1 (743) 555-3824 +12 token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" é 7@x.yz", "tok0",
]
ROWS = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 2}", None, *EXTRA) for i, t in enumerate(TEXTS)]
ROWS += [(None, "a null id", *[None] * (3 + len(EXTRA))), ROWS[6], ROWS[14], (None, None, *[None] * (3 + len(EXTRA)))]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return common.documents(spark, small)


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# 1 ----------------------------------------------------------------------------------------------------------------------
def test_token_counts(hard, docs, none):
    library = word_tokenizer("word_bpe_49k.json").library
    for df in (hard, docs):
        want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts(df))
        got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in count_tokens(df).collect())
        assert got == want
    assert count_tokens(hard).where("over_limit <> (n_tokens > 2048)").count() == 0
    assert count_tokens(none).count() == 0


def test_chunks_are_the_library():
    own = word_tokenizer("word_bpe_49k.json")
    assert own.by_chunk
    rng = np.random.default_rng(3)
    parts = ["abc", " ", "'s", "ÉÀ", "́", "ß", "\x85", "\xa0", "Ⱥ", "12", "½", "!?", "<|endoftext|>", "<|", "‍", "日", "Σ", "\x1d", "　", "İ"]
    for _ in range(2000):
        s = "".join(rng.choice(parts, rng.integers(0, 12)))
        ids = own.library.encode(s, add_special_tokens=False).ids
        assert own.ids(s) == struct.pack(f"<{len(ids)}I", *ids), repr(s)


# 2 ----------------------------------------------------------------------------------------------------------------------
def brute_links(rows):
    shingles = Shingles(5)
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = frozenset(shingles(t).tolist()), t or ""
    key = {i: s if s else "text:" + t for i, (s, t) in sets.items()}
    links, parent = defaultdict(set), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i][0], sets[j][0]
            same = key[i] == key[j]
            if same or (a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9):
                parent[max(root(i), root(j))] = min(root(i), root(j))
                if not same:
                    links[i].add(key[j])
                    links[j].add(key[i])
    return {i: (root(i), len(links[i])) for i in ids}


def test_jaccard_join(hard, docs, none):
    for df in (hard, docs):
        want = brute_links(texts(df))
        got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(df).collect()}
        assert got == want
    assert jaccard_join(hard).where("doc_id = 6").select("n_copies").first()[0] == 2
    assert jaccard_join(none).count() == 0


def test_representatives(hard, none):
    """One row a group: repeated rows once, an id's texts one by one, null ids after all others."""
    rows = texts(hard)
    want = brute_links([(n, t) for n, (_, t) in enumerate(rows)])  # by row
    best = {}
    for n, (i, _) in enumerate(rows):
        root = want[n][0]
        best[root] = min(best.get(root, (True, 0)), (i is None, i or 0))
    kept = keep_representatives(hard)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(None if null else i for null, i in best.values())
    assert kept.columns == hard.columns and keep_representatives(none).count() == 0
    two = hard.sparkSession.createDataFrame([(1, NEAR, "a"), (2, NEAR + " z", "b"), (2, "another text", "c"), (None, NEAR, "d")], "doc_id long, text string, row string")
    assert sorted(r.row for r in keep_representatives(two).collect()) == ["a", "c"]


def by_matrix(rows):
    """Classes and links by the product of the sets' incidence matrix with itself, in blocks."""
    shingles, sets = Shingles(5), {}
    for i, t in sorted(rows):
        sets.setdefault(tuple(shingles(t).tolist()), i)
    keys = [s for s in sets if s]
    places = {x: k for k, x in enumerate(sorted({x for s in keys for x in s}))}
    m = np.zeros((len(keys), len(places)), np.float32)
    for r, s in enumerate(keys):
        m[r, [places[x] for x in s]] = 1
    sizes = m.sum(1)
    common = m @ m.T
    linked = (common >= 0.8 * (sizes[:, None] + sizes[None, :] - common) - 1e-6) & ~np.eye(len(keys), dtype=bool)
    root = np.arange(len(keys))
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], len(keys)).min(1, initial=len(keys)))
        if (least == root).all():
            break
        root = least
    ids = np.array([sets[s] for s in keys])
    first = {r: int(ids[root == r].min()) for r in set(root.tolist())}
    return {int(i): (first[r], int(n)) for i, r, n in zip(ids, root.tolist(), linked.sum(1), strict=True)}


@pytest.mark.parametrize("small, tile", [(128, 2048), (40, 150)])
def test_pairs_near_the_threshold_in_split_buckets(spark, monkeypatch, small, tile):
    """700 texts of 100 words with one or two words changed: over 100,000 pairs between 0.75 and 0.85, in buckets that are
    split and in one component above a tile; every document's class and number of links against all pairs."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "TILE", tile)
    rng = np.random.default_rng(11)
    rows = []
    for i in range(700):
        words = [f"base{k}" for k in range(100)]
        for _ in range(1 + i % 2):
            words[rng.integers(100)] = f"new{i}"
        rows.append((i, " ".join(words)))
    rows += [(800 + i, " ".join(f"x{i}y{k % 40}" for k in range(60))) for i in range(20)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = by_matrix(rows)
    assert sum(n for _, n in want.values()) > 100_000 and len({n for _, n in want.values()}) > 50
    assert {i: got[i] for i in want} == want


def test_recall_on_documents(spark):
    """No link of the 1,000 documents is missed: links and classes are those of all pairs."""
    docs = common.documents(spark, "/root/testdata/sf0.01")
    want = by_matrix([(i, t or "") for i, t in texts(docs)])
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(docs).collect()}
    assert {i: got[i] for i in want} == want


def test_hot_group_of_near_copies(spark):
    """A group larger than a tile, all linked, is one class and counts every link."""
    rows = [(i, NEAR + f" end{i}") for i in range(700)] + [(1000 + i, f"w{i} x{i} y{i} z{i} q{i} r{i}") for i in range(50)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (0, 699) for i in range(700)) and all(got[1000 + i] == (1000 + i, 0) for i in range(50))


# 3 ----------------------------------------------------------------------------------------------------------------------
def brute_top_k(rows, k=20, every=20):
    vectors = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(64 * x) for x in v)]
    out = []
    for q in {i for i, _ in vectors if i % every == 0}:
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for p, a in vectors if p == q for i, b in vectors if i != q)[:k]
        out += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def test_top_k(spark, small):
    table = common.documents(spark, small, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert sorted(map(tuple, top_k(table).collect())) == brute_top_k(rows)
    ties = [(i, [1.0, 0.5]) for i in range(60)] + [(60, None), (61, [None, 1.0]), (62, [float("nan"), 1.0]), (63, [float("inf"), 0.0]), (None, [1.0, 1.0]), (3, [1.0, 0.5]), (80, [-2.0, 0.25]), (100, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in ties], "vec_id long, embedding array<double>, node string")
    assert sorted(map(tuple, top_k(df).collect())) == brute_top_k(ties)
    assert top_k(df.limit(0)).count() == 0
    repeated = [(i, [float(i), 1.0]) for i in (0, 1, 1, 2, 20, 20)] + [(20, [-3.0, 2.0]), (40, [1e307, 0.0])]
    df = spark.createDataFrame(repeated, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, top_k(df).collect()))
    assert got == brute_top_k(repeated) and sum(q == 0 for q, *_ in got) == 6


def test_top_k_down_a_tree(spark, monkeypatch):
    """Small chunks, so that nodes are split over several levels; equal vectors that no centre parts; SQL says the same."""
    import duckdb

    from passgrid.llm.registry import ORACLE_SQL

    monkeypatch.setattr(topk, "CHUNK", 64)
    monkeypatch.setattr(topk, "GROUP", 8)
    rng = np.random.default_rng(2)
    middles = rng.normal(0, 3, (12, 6))
    points = middles[rng.integers(0, 12, 1500)] + rng.normal(0, 0.3, (1500, 6))
    points[:300] = points[0]
    embeddings = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>").toPandas()
    got = top_k(spark.createDataFrame(embeddings), batch=4).collect()
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(ORACLE_SQL["op3_exact_top_k"]).fetchall())


# 4 ----------------------------------------------------------------------------------------------------------------------
def test_licenses(hard, docs, none):
    for df in (hard, docs):
        got = {(r.doc_id, r.n_words): r for r in scan_licenses(df).collect()}
        for i, t in texts(df):
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            places = sorted((a, label) for phrase, label in BASE_PHRASES.items() for p in [phrase.split()] for a in range(len(words)) if words[a : a + len(p)] == p)
            r = got[i, len(words)]
            assert (r.n_base, r.first_word, r.last_word) == (len(places), places[0][0] if places else None, places[-1][0] if places else None)
            assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
            assert 0 <= r.score <= 1
    assert scan_licenses(none).count() == 0


def test_matching_statistics():
    """The longest stretch that ends at a word and occurs in a template, against trying all."""
    own = Automaton(TEMPLATES, BASE_PHRASES)
    known = [split_words(t) for _, t in TEMPLATES]
    rng = np.random.default_rng(5)
    pool = sorted({w for t in known for w in t}) + [b"zzz"]
    for _ in range(60):
        words = []
        for _ in range(6):
            a = rng.integers(0, 6)
            words += known[rng.integers(len(known))][a : a + rng.integers(1, 9)] if rng.random() < 0.7 else [pool[rng.integers(len(pool))]]
        _, stretches = own.scan(words)
        for end, length, state in stretches:
            stretch = words[end - length : end]
            for template, at in own.places[state]:
                assert known[template][at - length : at] == stretch
            if end < len(words):
                longer = words[end - length : end + 1]
                assert not any(longer == t[a : a + length + 1] for t in known for a in range(len(t)))


@lru_cache(None)
def telling(k):
    """Places of the words of a template outside its longest stretch in one of another label that does not hold it whole."""
    words = split_words(TEMPLATES[k][1])
    joined = lambda w: b" " + b" ".join(w) + b" "
    for size in range(len(words) - 1, 0, -1):
        for a in range(len(words) - size + 1):
            for label, text in TEMPLATES:
                theirs = joined(split_words(text))
                if label != TEMPLATES[k][0] and joined(words) not in theirs and joined(words[a : a + size]) in theirs:
                    return set(range(len(words))) - set(range(a, a + size))
    return set(range(len(words)))


def test_versions_are_told_apart(spark):
    lines = {
        "under the GNU General Public License, version 3": {"gpl", "gpl-3"}, "under the GNU General Public License, version 2.": {"gpl", "gpl-2"}, "the GNU General Public License, version 1": {"gpl"},
        "under the terms of the GNU General Public License as published by the Free Software Foundation": {"gpl"}, "the GNU Lesser General Public License as published by the Free Software Foundation": {"lgpl"},
        "Licensed under CC BY-NC 4.0.": {"cc-by", "cc-by-nc"}, "Licensed under CC BY-SA 4.0.": {"cc-by", "cc-by-sa"}, "Licensed under the Apache License, Version 2.0.": {"apache", "apache-2.0"},
    }
    got = {r.text: set(r.labels.split(",")) for r in scan_licenses(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).join(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), "doc_id").collect()}
    assert got == lines


def test_contained_templates(spark):
    """Templates inside others, cut short or run together: every label whose template is covered, by brute force."""
    lines = ["This work is licensed under the GNU General Public License, version 3.", "the GNU General Public License, version 3", *[t for _, t in TEMPLATES]]
    lines += [f"{a} {b}" for _, a in TEMPLATES[:6] for _, b in TEMPLATES[:6]]
    rows = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert all("gpl-3" in rows[i].labels.split(",") for i in (0, 1))
    own = Automaton(TEMPLATES, BASE_PHRASES)
    for i, line in enumerate(lines):
        words = split_words(line)
        want, sure = {}, set()
        for k, (_, text) in enumerate(TEMPLATES):
            known = split_words(text)
            size = [[0] * (len(known) + 1) for _ in range(len(words) + 1)]
            for e in range(1, len(words) + 1):
                for a in range(1, len(known) + 1):
                    size[e][a] = size[e - 1][a - 1] + 1 if words[e - 1] == known[a - 1] else 0
            ends = [(e, a, size[e][a]) for e in range(len(words) + 1) for a in range(len(known) + 1) if size[e][a] >= 3 and not (e < len(words) and a < len(known) and words[e] == known[a])]
            best = {}
            for e, a, n in ends:
                told = sum(i in telling(k) for i in range(a - n, a))
                before = max((best[x, y] for x, y in best if 0 <= e - n - x <= 8 and 0 <= a - n - y <= 8), default=(0, 0))
                best[e, a] = n + before[0], told + before[1]
            if best:
                want[k] = max(best.values())[0] / len(known)
                if any(n >= 0.75 * len(known) and m >= 0.75 * len(telling(k)) for n, m in best.values()):
                    sure.add(TEMPLATES[k][0])
        got = {}
        for k, _, _, share, _ in own.spans(own.scan(words)[1], 3, 8):
            got[k] = max(share, got.get(k, 0))
        assert got == want, line
        covered = sure
        assert set(filter(None, rows[i].labels.split(","))) == covered | set(filter(None, rows[i].base_labels.split(",")))
        spans = [x.split(":") for x in filter(None, rows[i].spans.split(","))]
        assert {x[0] for x in spans} == covered
        assert all(0 <= int(a) < int(b) <= len(words) for _, a, b in spans)


def test_every_covered_span(spark):
    """Two notices with prose between them are two spans; a body with a cut in its middle is chained to one."""
    body = next(t for label, t in TEMPLATES if label == "bsd-3-clause")
    words = body.split()
    cut = " ".join(words[:40] + ["altered"] * 4 + words[43:])
    text = f"Released under the MIT License. {'prose ' * 30}Released under the MIT License. {cut}"
    row = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    spans = [x for x in row.spans.split(",")]
    assert spans[:2] == ["mit:0:5", "mit:35:40"] and spans[-1].startswith("bsd-3-clause:40:")
    assert int(spans[-1].split(":")[2]) - 40 == len(split_words(cut))


# 5 ----------------------------------------------------------------------------------------------------------------------
def test_quality(spark, hard, none):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.documents(spark, sf), common.documents(spark, sf, "labels")
    model = train(docs, labels)
    rows = score_quality(docs, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.9
    assert score_quality(hard, model).count() == len(ROWS) and score_quality(none, model).count() == 0
    assert keep_good(hard, model).columns == hard.columns
    assert score_quality(hard, train(none, labels)).count() == len(ROWS)


def test_machine_is_the_sum_over_pairs():
    """Scores against every pair's interaction, and the gradient against differences of the loss."""
    rng = np.random.default_rng(4)
    w, v = rng.normal(0, 0.3, 40), rng.normal(0, 0.3, (40, 3))
    ids = [rng.choice(40, n, replace=False) for n in (7, 1, 12)]
    values = [rng.random(len(i)) for i in ids]
    labels = np.array([1.0, 0.0, 1.0])

    def plain(w0, w, v, i, x):
        z = w0 + sum(w[a] * y for a, y in zip(i, x)) + sum(float(v[i[a]] @ v[i[b]]) * x[a] * x[b] for a in range(len(i)) for b in range(a + 1, len(i)))
        return 1 / (1 + math.exp(-z))

    def loss(w, v):
        return -np.mean([y * math.log(p) + (1 - y) * math.log(1 - p) for y, p in zip(labels, (plain(0.2, w, v, i, x) for i, x in zip(ids, values)))])

    model = Machine(0.2, w, v)
    assert np.allclose([model.score(i, x) for i, x in zip(ids, values)], [plain(0.2, w, v, i, x) for i, x in zip(ids, values)], atol=1e-12)
    _, unique, dw, dv = model.gradient(ids, values, labels)
    for k, a in enumerate(unique):
        step = np.zeros(40)
        step[a] = 1e-5
        assert abs((loss(w + step, v) - loss(w - step, v)) / 2e-5 - dw[k]) < 1e-5
        for f in range(3):
            step = np.zeros((40, 3))
            step[a, f] = 1e-5
            assert abs((loss(w, v + step) - loss(w, v - step)) / 2e-5 - dv[k, f]) < 1e-5


# 6 ----------------------------------------------------------------------------------------------------------------------
def test_fullest_is_the_fullest():
    rng = np.random.default_rng(7)
    for _ in range(50):
        have = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 30, 5)}
        room = int(rng.integers(1, 60))
        sums = {0}
        for k, n in have.items():
            sums = {s + k * m for s in sums for m in range(n + 1) if s + k * m <= room}
        used = fullest(have, room)
        assert sum(k * n for k, n in used.items()) == max(sums) and all(n <= have[k] for k, n in used.items())


def test_packing(hard, docs, none):
    library = word_tokenizer("word_bpe_49k.json").library
    for df in (hard, docs):
        rows = pack(df).collect()
        want = Counter()
        for i, t in texts(df):
            ids = library.encode(t or "", add_special_tokens=False).ids + [1]
            for piece, a in enumerate(range(0, len(ids), 4096)):
                part = ids[a : a + 4096]
                want[i, piece, a, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        bins = defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= 4096
        assert len(bins) <= math.ceil(sum(r.length for r in rows) / 4096) + 1
    assert pack(none).count() == 0
    assert sum(t for t, _ in minimum_bin_slack({4096: 3, 2048: 4}, 4096)) == 5


# 7 ----------------------------------------------------------------------------------------------------------------------
def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        assert sorted(feistel(np.arange(n), n, 9).tolist()) == list(range(n))
    assert feistel(np.arange(1000), 1000, 9).tolist() != feistel(np.arange(1000), 1000, 10).tolist()


def test_shards_round_trip(spark, hard, docs, none):
    library = word_tokenizer("word_bpe_49k.json").library
    for df in (hard, docs):
        path = common.run_dir(spark, "test-shards")
        rows = {r.slot: r for r in materialise(df, path, length=256, per_shard=16).collect()}
        got = dict(read_slots(spark, path))
        assert sorted(rows) == sorted(got) == list(range(len(rows)))
        assert all(zlib.crc32(got[s][: r.n_tokens].tobytes()) == r.ids_crc32 and r.shard == s // 16 and r.byte_offset == s % 16 * 512 for s, r in rows.items())
        tokens = Counter(int(x) for s, r in rows.items() for x in got[s][: r.n_tokens])
        assert tokens == Counter(i for _, t in texts(df) for i in [*library.encode(t or "", add_special_tokens=False).ids, 1])
        late = dict(read_slots(spark, path, len(rows) // 2, 3))
        assert all((got[s] == a).all() for s, a in late.items())
    assert materialise(none).count() == 0
    with pytest.raises(ValueError):
        materialise(none, dtype="<u1")
    shutil.rmtree(path.removeprefix("file://") + "/manifest")
    again = materialise(docs, path, length=256, per_shard=16).collect()
    assert {r.slot: r.ids_crc32 for r in again} == {s: r.ids_crc32 for s, r in rows.items()}  # over shards that are there


# 8 ----------------------------------------------------------------------------------------------------------------------
def test_raking_meets_marginals():
    rng = np.random.default_rng(1)
    codes = [np.repeat(np.arange(4), 6), np.tile(np.repeat(np.arange(2), 3), 4), np.tile(np.arange(3), 8)]
    cells = rng.random(24) + 0.1
    targets = [rng.dirichlet(np.ones(k)) for k in (4, 2, 3)]
    w = rake(cells, codes, targets)
    for code, t in zip(codes, targets, strict=True):
        assert np.allclose(np.bincount(code, w), t, atol=1e-8)


def test_mixing_table_and_driver_agree(spark, docs, hard, none):
    words = docs.withColumn("w", F.size(F.split("text", " ")))
    one = mixture(words, ["source", "lang"], "w", {"lang": {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}})
    two = mixture(words, ["source", "lang"], "w", {"lang": {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}}, driver_cells=0)
    a, b = ({r.doc_id: (r.mix_weight, r.mix_probability) for r in x.collect()} for x in (one, two))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], rtol=1e-4) for k in a)
    total = sum(r.w for r in words.collect())
    assert abs(sum(r.w * r.mix_probability for r in one.collect()) - 0.6 * total) < 1e-6 * total
    assert sample_mixture(hard).count() <= len(ROWS) and sample_mixture(hard, whole_rows=True).columns == hard.columns
    assert sample_mixture(none).count() == 0


def test_sample_meets_marginals(spark):
    """Expected shares of the sample, where single cells are smaller than their raked weight asks for."""
    sizes = {("a", "x"): 40, ("a", "y"): 400, ("b", "x"): 160, ("b", "y"): 100, ("c", "x"): 300}
    rows = spark.createDataFrame([(*k, 1) for k, n in sizes.items() for _ in range(n)], "s string, l string, w long")
    for targets in ({"s": {"a": 0.25, "b": 0.4, "c": 0.35}, "l": {"x": 0.65, "y": 0.35}}, {"s": {"a": 0.3, "b": 0.6, "c": 0.1}, "l": {"x": 0.45, "y": 0.55}}):
        for cells in (50_000, 0) if targets["s"]["b"] == 0.6 else (50_000,):
            got = mixture(rows, ["s", "l"], "w", targets, share=0.6, driver_cells=cells).collect()
            assert abs(sum(r.mix_probability for r in got) - 600) < 1e-5 and all(0 <= r.mix_probability <= 1 for r in got)
            want = {"s": dict(targets["s"]), "l": targets["l"]}
            if targets["s"]["b"] == 0.6:  # 360 are asked for and 260 are there: the others share the rest
                want["s"] = {"a": (340 * 3 / 4) / 600, "b": 260 / 600, "c": (340 / 4) / 600}
            for d, shares in want.items():
                for v, x in shares.items():
                    assert abs(sum(r.mix_probability for r in got if r[d] == v) / 600 - x) < 1e-6, (targets, cells, d, v)


def test_mixing_weighs_tokens(spark, docs):
    """Every sampled row has op1's tokens, and the expected tokens of the sample are the share of all."""
    tokens = {r.doc_id: r.n_tokens for r in count_tokens(docs).collect()}
    rows = sample_mixture(docs).collect()
    assert rows and all(r.n_tokens == tokens[r.doc_id] for r in rows)
    one = spark.createDataFrame([(1, "0123456789abcdef" * 400, "x", "en"), (2, "a b c d", "y", "en")], "doc_id long, text string, source string, lang string")
    long, short = sorted(sample_mixture(one, share=1.0).collect(), key=lambda r: r.doc_id)
    assert long.n_words == 1 and long.n_tokens > 1000 and long.mix_weight < short.mix_weight
    assert {r.doc_id for r in sample_mixture(docs, whole_rows=True).collect()} == {r.doc_id for r in rows}


def brute_mixture(rows, power=0.7, share=0.6):
    """Plain dictionaries: rake cells to the tempered marginals, then find the sample's probabilities where no cell is capped."""
    cells = Counter()
    for *cell, n in rows:
        cells[tuple(cell)] += n
    cells = {c: n for c, n in cells.items() if n}
    total = sum(cells.values())
    targets = []
    for d in range(3):
        have = Counter()
        for c, n in cells.items():
            have[c[d]] += n
        lifted = {v: n**power for v, n in have.items()}
        targets.append({v: x / sum(lifted.values()) for v, x in lifted.items()})
    w = {c: n / total for c, n in cells.items()}
    for _ in range(300):
        for d, target in enumerate(targets):
            have = Counter()
            for c, x in w.items():
                have[c[d]] += x
            w = {c: x * target[c[d]] / have[c[d]] for c, x in w.items()}
    factor = {c: w[c] * total / cells[c] for c in cells}
    return factor, {c: share * factor[c] for c in cells}


def test_sample_is_the_brute_force_sample(spark):
    """The very documents: cells large enough to be drawn at their raked rate, and Spark's hash of the id computed apart."""
    rng = np.random.default_rng(6)
    kinds = ["plain words here ", "a | b ", "### x "]
    rows = [(i, kinds[rng.choice(3, p=[0.5, 0.3, 0.2])] * int(rng.integers(1, 9)), f"s{rng.choice(3, p=[0.5, 0.3, 0.2])}", "en" if rng.random() < 0.6 else "de") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    library = word_tokenizer("word_bpe_49k.json").library
    topic = lambda t: "table" if " | " in t else "markup" if "###" in t else "prose"
    about = {i: (s, g, topic(t), len(library.encode(t, add_special_tokens=False).ids)) for i, t, s, g in rows}
    factor, chance = brute_mixture(about.values(), share=0.4)
    assert max(chance.values()) < 1
    hashed = lambda i: xxhash.xxh64_intdigest(struct.pack("<i", 11), xxhash.xxh64_intdigest(struct.pack("<q", i), 42)) % (1 << 40) / (1 << 40)
    near = {i for i in about if abs(hashed(i) - chance[about[i][:3]]) < 1e-7}
    want = {i for i in about if hashed(i) < chance[about[i][:3]]}
    for cells in (50_000, 0):
        got = {r.doc_id: r for r in sample_mixture(df, share=0.4, driver_cells=cells).collect()}
        assert set(got) ^ want <= near and len(got) > 300
        assert all((r.source, r.lang, r.topic, r.n_tokens) == about[i] and abs(r.mix_weight - factor[about[i][:3]]) < 1e-5 for i, r in got.items())
    read = sample_mixture(df.withColumn("subject", F.lit("one")), topic_col="subject")
    assert {r.topic for r in read.collect()} == {"one"}


# 9 ----------------------------------------------------------------------------------------------------------------------
def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m, d: 16 <= len(d) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 8 <= len(d) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0], re.sub("[^0-9]", "", m[0]))]


def test_pii(spark, hard, none):
    docs = common.documents(spark, "/root/testdata/sf0.01")
    many = spark.createDataFrame([(1, "1.2.3.4 é x@y.zz, " * 700), (2, "a@b.c%x@d.e a@b.c@d.e .@x.y 1.2.3.4.5.6.7.8 4" + "1" * 5000)], "doc_id long, text string")
    for df in (hard, docs, many):
        want = Counter()
        for i, t in texts(df):
            spans = brute_pii(t or "")
            n = Counter(k for k, _, _ in spans)
            line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            want[i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(line.encode()).hexdigest(), line] += 1
        rows = find_pii(df).collect()
        assert all(r.n_spans == len(list(filter(None, r.spans.split(",")))) and [r.n_secret, r.n_number, r.n_contact] == [sum(x.startswith(k) for x in r.spans.split(",")) for k in ("secret", "number", "contact")] for r in rows)
        base = lambda s: ",".join(x for x in s.split(",") if x.split(":")[0] in ("email", "ip", "card", "phone"))
        assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, base(r.spans)) for r in rows) == want
    assert any("secret" in r.spans for r in find_pii(docs).collect())
    assert find_pii(none).count() == 0
    plan = find_pii(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_redaction(hard, none):
    got = {r.doc_id: r.text for r in redact(hard).collect()}
    assert got[14].startswith("mail [EMAIL], [EMAIL]@f.g ip [IP] 999.1.1.1 card [CARD], ") and "[PHONE]" in got[14] and got[0] is None and got[10] == LONG
    assert redact(hard).columns == hard.columns and redact(none).count() == 0


def test_added_spans_by_hand(spark):
    """Lines with known spans among prose: keys, spelt-out addresses and phone numbers are added, harmless numbers are not."""
    rng = np.random.default_rng(8)
    hexes = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    rows, want = [], {}
    for i in range(600):
        kind = i % 6
        key, phone = hexes(32), f"({rng.integers(200, 999)}) {rng.integers(200, 999)}-{rng.integers(1000, 9999)}"
        text = [f"the token = {key} was used", f"call {phone} today", f"write to jo{i} [at] mail [dot] org please", f"chapter{i} of section 12 had 3 parts", f"in {1900 + i % 100} and {i} more", "plain prose without any of it"][kind]
        rows.append((i, text))
        want[i] = {0: ("secret", text.find(key), len(key)), 1: ("number", text.find("("), len(phone)), 2: ("contact", 9, 22 + len(str(i)))}.get(kind)
    got = {r.doc_id: r.spans for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = sum(f"{w[0]}:{w[1]}:{w[1] + w[2]}" == got[i] for i, w in want.items() if w)
    assert hit > 0.9 * sum(w is not None for w in want.values())
    assert not any(got[i] for i, w in want.items() if w is None)


def test_boosting_learns():
    cells = [((g, s, 0, c, 0, 0, 0, 0), int(c == 1 and s > 2), 10) for g in range(2) for s in range(5) for c in range(2)]
    model = Boosted.fit(cells, 30, 0.4, 0.9, cells)
    assert all((model.raw(row) >= model.thresholds[row[0]]) == bool(y) for row, y, _ in cells)


# 10 ---------------------------------------------------------------------------------------------------------------------
def test_media(hard, docs, none):
    for df in (hard, docs):
        want = Counter()
        for i, t in texts(df):
            data = (t or "").encode()
            payload = data + b" " * (-len(data) % 192 if data else 192)
            assert payload == payload_of(t) and decode_png(encode_png(payload)) == payload
            image = encode_png(payload)
            want[i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest()] += 1
        rows = media_columns(df).collect()
        assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in rows) == want
        assert all(r.width == 64 and r.height * 192 == r.payload_bytes for r in rows)
        assert len({(r.digest, r.shard, r.offset, r.feature) for r in rows}) == len({r.digest for r in rows})
    assert media_columns(none).count() == 0


# The pipeline -----------------------------------------------------------------------------------------------------------
def test_pipeline(spark, small, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "PII", "mixing sources to target weights", "best-fit packing"]
    now, kept = docs, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.staged(stage(spark, now, small), "test-stage")
        assert now.columns == docs.columns
        after = {r.doc_id: r.text for r in now.collect()}
        assert set(after) <= set(kept)
        if name == "n-gram Jaccard join":
            want = brute_links(kept.items())
            assert set(after) == {i for i in kept if want[i][0] == i}
        if name == "PII":
            assert set(after) == set(kept) and not any(brute_pii(t) for t in after.values())
        kept = after
    packed = corpus_pipeline.STAGES[-1][1](spark, now, small)
    assert {r.doc_id for r in packed.collect()} == set(kept)
    assert json.dumps(sorted(packed.columns)) == json.dumps(sorted(["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]))


def test_pipeline_on_hard_rows(spark, small, hard, none):
    """run() over nulls, repeated rows and clashing names, and over no rows: every stage's columns and row rules."""
    import corpus_pipeline

    for df in (hard, none):
        now = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = common.staged(stage(spark, now, small), "test-stage")
            assert after.columns == df.columns and after.dtypes == df.dtypes
            if name in ("PII",):
                assert after.count() == now.count()
            now = after
        packed = corpus_pipeline.STAGES[-1][1](spark, now, small)
        assert packed.where("piece = 0").count() == now.count()
        made = common.clear_staged(spark)
        assert made > 0 and common.clear_staged(spark) == 0


def test_run(spark, tmp_path, small):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in common.documents(spark, small).select("doc_id").collect()}
    bins = Counter()
    for r in rows:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 4096
    again = corpus_pipeline.run(spark, small).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in again) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in rows)
