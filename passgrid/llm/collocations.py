"""Phrase collocations by streams of counts in prefix and suffix order (operator 11).

Every word begins one window: itself and up to four words after it in its piece.  A block of texts
is a sorted stream of distinct windows with counts; the blocks' streams are cut at the same bounds,
and the streams of a range are merged.  In a sorted stream the windows of any prefix stand together,
so one pass over it counts the phrases of all lengths.  Frequent phrases are then kept twice, in
prefix order and in suffix order.  Walking the first in order, a phrase's beginnings are the last
phrases of each shorter length and its extensions to the right follow it; the second says the same of
endings and extensions to the left.  The two are merge-joined, and no table of phrases is hashed.
A range holds what lies below a phrase but may begin within it; the phrases a bound lies within are
copied to the ranges behind it, so a walk always meets all beginnings of what it sees.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passgrid.llm.common import col, staged
from passgrid.llm.wordpieces import _Filled

ORDER = 5
#: Words of a block, windows of a merged range, frequent phrases of a walked range (both on average).
BLOCK_WORDS, RANGE_WINDOWS, RANGE_PHRASES = 2_000_000, 2_000_000, 200_000
#: Texts, and windows of each, whose windows the bounds are taken from; phrases likewise.  Bounds steer sizes, not results.
SAMPLE_TEXTS, SAMPLE_WINDOWS, SAMPLE_PHRASES = 2000, 32, 20_000
BREAK = b"\xff"  # in no UTF-8 text
FOLD = bytes(0x0A if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
Bound = tuple[str, tuple[bytes, ...]]


def words_of(text: str | None) -> list[bytes]:
    """Words in order, with BREAK between pieces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).replace(b"\n", b" \xff ").split()


def windows_of(ids: np.ndarray) -> list[np.ndarray]:
    """The ORDER words from every word on, as columns; 0 after the end of its piece.  ``ids`` ends with ORDER - 1 words of context."""
    end = len(ids) - ORDER + 1
    at = np.nonzero(ids[:end])[0]
    columns = [ids[at]]
    for k in range(1, ORDER):
        columns.append(np.where(columns[-1] > 0, ids[at + k], np.int32(0)))
    return columns


def sorted_counts(columns: list[np.ndarray], counts: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, with the sum of their counts (1 each, if none are given)."""
    top = max(int(c.max(initial=0)) for c in columns)
    if top < 1 << 21:
        keys = [np.zeros(len(columns[0]), np.uint64), np.zeros(len(columns[0]), np.uint64)]
        for k, c in enumerate(columns):
            keys[k // 3] <<= np.uint64(21)
            keys[k // 3] |= c.astype(np.uint64)
    else:
        keys = columns
    order = np.lexsort(keys[::-1])
    changed = np.zeros(len(order), bool)
    changed[:1] = True
    for key in keys:
        key = key[order]
        changed[1:] |= key[1:] != key[:-1]
    starts = np.nonzero(changed)[0]
    if counts is None:
        total = np.diff(np.append(starts, len(order)))
    else:
        total = np.add.reduceat(counts[order], starts) if len(starts) else counts
    rows = order[starts]
    return [c[rows] for c in columns], total.astype(np.int64)


def _packed(a: np.ndarray) -> bytes:
    """Non-negative numbers below 2^32, byte plane by byte plane."""
    width = 1 if a.max(initial=0) < 256 else 2 if a.max(initial=0) < 65536 else 4
    return bytes([width]) + np.ascontiguousarray(a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def _framed(parts: list[bytes]) -> bytes:
    return zstandard.compress(b"".join(len(p).to_bytes(8, "little") + p for p in parts), 6)


def _unframed(data: bytes) -> list[bytes]:
    data, at, out = zstandard.decompress(data), 0, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def pack_stream(columns: list[np.ndarray], counts: np.ndarray, words: list[bytes]) -> bytes:
    """A sorted stream: each row's words after those it shares with the row before, counts (less one, large ones in two halves), own words.

    ``words`` are in order; word i of a column is words[i - 1].
    """
    used = np.zeros(len(words) + 1, bool)
    for c in columns:
        used[c] = True
    used[0] = False
    rank = np.cumsum(used)
    rank[~used] = 0
    parts, new = [b" ".join([words[i - 1] for i in np.nonzero(used)[0].tolist()])], np.zeros(len(counts), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
        parts += [np.packbits(new).tobytes(), _packed(rank[c[new]])]
    return _framed([*parts, _packed(counts & 0xFFFFFFFF), _packed(counts >> 32)])


def unpack_stream(data: bytes) -> tuple[list[np.ndarray], np.ndarray, list[bytes]]:
    parts = _unframed(data)
    counts = _unpacked(parts[-2]).astype(np.int64) + (_unpacked(parts[-1]).astype(np.int64) << 32)
    columns = []
    for k in range(ORDER):
        new = np.unpackbits(np.frombuffer(parts[1 + 2 * k], np.uint8), count=len(counts)).astype(bool)
        columns.append(_unpacked(parts[2 + 2 * k])[np.cumsum(new) - 1])
    return columns, counts, parts[0].split(b" ")


def place(columns: list[np.ndarray], words: list[bytes], bound: tuple[bytes, ...]) -> int:
    """The first row of a sorted stream that is not before ``bound``."""
    low, high = 0, len(columns[0])
    for column, word in zip(columns, bound, strict=False):
        rank = bisect_left(words, word)
        own = column[low:high]
        if rank == len(words) or words[rank] != word:
            return low + int(np.searchsorted(own, rank + 1, "left"))
        low, high = low + int(np.searchsorted(own, rank + 1, "left")), low + int(np.searchsorted(own, rank + 1, "right"))
    return low


def _streams(bounds: list[Bound], block_words: int):
    """Blocks of texts as sorted streams of windows, cut at the bounds: (part, lang, stream)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        vocabulary: dict[bytes, int] = _Filled(lambda _: len(vocabulary))
        vocabulary[BREAK] = 0
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(vocabulary)[1:]
            order = sorted(range(len(words)), key=words.__getitem__)
            rank = np.zeros(len(words) + 1, np.int32)
            rank[np.array(order, np.int64) + 1] = np.arange(1, len(words) + 1, dtype=np.int32)
            words = [words[i] for i in order]
            for lang, arrays in held.items():
                ids = np.concatenate([*arrays, np.zeros(ORDER - 1, np.int32)])
                for at in range(0, len(ids) - ORDER + 1, block_words):
                    columns, counts = sorted_counts(windows_of(rank[ids[at : at + block_words + ORDER - 1]]), None)
                    first = bisect_left(bounds, (lang, ()))  # part first begins before the language or with it
                    own = [b for b in bounds[first:] if b[0] == lang]
                    cuts = [0, *[place(columns, words, b[1]) for b in own], len(counts)]
                    found = [(first + i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                    for part, a, b in found:
                        stream = pack_stream([c[a:b] for c in columns], counts[a:b], words)
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([lang]), pa.array([stream], pa.binary())], names=["part", "lang", "stream"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = words_of(text)
                if not tokens:
                    continue
                ids = np.fromiter(map(vocabulary.__getitem__, tokens), np.int32, len(tokens))
                held.setdefault(lang, []).extend([ids, np.zeros(1, np.int32)])
                size += len(ids)
                if size >= block_words:
                    yield from flush()
                    held.clear()
                    vocabulary.clear()
                    vocabulary[BREAK] = size = 0
        yield from flush()

    return run


def _merged(least: int):
    """Counts of the phrases of a range that are frequent in it, and of those that may go on in the next range or begin in the last one."""

    def run(table: pa.Table) -> pa.Table:
        lang, streams = table.column("lang")[0].as_py(), [unpack_stream(s) for s in table.column("stream").to_pylist()]
        words = sorted({w for s in streams for w in s[2]})
        rank_of = {w: i + 1 for i, w in enumerate(words)}
        ranks = [np.array([0] + [rank_of[w] for w in s[2]], np.int32) for s in streams]
        columns = [np.concatenate([r[s[0][k]] for r, s in zip(ranks, streams, strict=True)]) for k in range(ORDER)]
        counts = np.concatenate([s[1] for s in streams])
        del streams
        columns, counts = sorted_counts(columns, counts)
        phrases, orders, totals = [""], [0], [int(counts.sum())]  # all words of the range
        new = np.zeros(len(counts), bool)
        new[0] = True
        for k, column in enumerate(columns):
            new[1:] |= column[1:] != column[:-1]
            starts = np.nonzero(new)[0]
            total = np.add.reduceat(counts, starts)
            whole = column[starts] > 0
            starts, total = starts[whole], total[whole]
            kept = total >= least
            kept[:1] = kept[-1:] = True
            for row, n in zip(starts[kept].tolist(), total[kept].tolist(), strict=True):
                phrases.append(b" ".join([words[c[row] - 1] for c in columns[: k + 1]]).decode("utf-8", "replace"))
                orders.append(k + 1)
                totals.append(n)
        return pa.table({"lang": pa.array([lang] * len(phrases)), "phrase": pa.array(phrases), "words": pa.array(orders, pa.int32()), "n": pa.array(totals, pa.int64())})

    return run


def _even_bounds(sample: list[tuple[Bound, float]], parts: int) -> list[Bound]:
    """``parts`` - 1 places (fewer, where places coincide) that cut the weighted sample evenly."""
    sample = sorted(sample)
    weights = np.cumsum([w for _, w in sample])
    at = np.searchsorted(weights, np.arange(1, parts) / parts * (weights[-1] if len(weights) else 0))
    return sorted({sample[i][0] for i in at.tolist()}) if sample else []


def _some_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to SAMPLE_WINDOWS windows of every text, evenly spread, each with the words it stands for."""
    for batch in batches:
        out = []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens = words_of(text)
            at = [i for i, t in enumerate(tokens) if t != BREAK]
            step = max(1, -(-len(at) // SAMPLE_WINDOWS))
            for i in at[::step]:
                window = tokens[i : i + ORDER]
                out.append((lang, b" ".join(window[: window.index(BREAK)] if BREAK in window else window), float(min(step, len(at)))))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.binary(), pa.float64()))], names=["lang", "window", "weight"])


def _window_bounds(texts: DataFrame) -> list[Bound]:
    total = texts.count()
    share = min(1.0, SAMPLE_TEXTS / max(1, total))
    some = texts.sample(share, seed=1) if share < 1 else texts
    rows = some.mapInArrow(_some_windows, "lang string, window binary, weight double").collect()
    sample = [((r["lang"], tuple(bytes(r["window"]).split(b" "))), r["weight"]) for r in rows]
    return _even_bounds(sample, int(sum(w for _, w in sample) / share / RANGE_WINDOWS) + 1)


def _ordered(bounds: list[Bound], backwards: bool):
    """Phrases with the range they lie in, and copies in the ranges that begin within them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, phrase, n in zip(*[batch.column(c).to_pylist() for c in ("lang", "phrase", "n")], strict=True):
                own = tuple(phrase.encode().split(b" "))[:: -1 if backwards else 1]
                part = bisect_right(bounds, (lang, own))
                out.append((part, lang, phrase, n, False))
                while part < len(bounds) and bounds[part][0] == lang and bounds[part][1][: len(own)] == own:
                    part += 1
                    out.append((part, lang, phrase, n, True))
            types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["part", "lang", "phrase", "n", "copied"])

    return run


def _walked(backwards: bool):
    """A range in order: every phrase's beginnings (endings, backwards) and the most frequent of its extensions seen here."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted((lang, tuple(phrase.encode().split(b" "))[:: -1 if backwards else 1], phrase, n, copied) for lang, phrase, n, copied in zip(*[table.column(c).to_pylist() for c in ("lang", "phrase", "n", "copied")], strict=True))
        path: list[tuple[tuple[bytes, ...], int]] = []  # the phrase before and its beginnings, by rising length
        place_of: list[int] = []
        before, longest = [], [0] * len(rows)
        for i, (_, own, _, n, _) in enumerate(rows):
            del path[len(own) - 1 :], place_of[len(own) - 1 :]
            before.append([m for _, m in path])
            if place_of:
                longest[place_of[-1]] = max(longest[place_of[-1]], n)
            path.append((own, n))
            place_of.append(i)
        own_n = [None if copied else n for *_, n, copied in rows]
        own_before = [None if r[4] else b for r, b in zip(rows, before, strict=True)]
        return pa.table({"lang": pa.array([r[0] for r in rows]), "phrase": pa.array([r[2] for r in rows]), "a": pa.array(own_n, pa.int64()), "parts": pa.array(own_before, pa.list_(pa.int64())), "longer": pa.array(longest, pa.int64())})

    return run


def _walk(frequent: DataFrame, total: int, backwards: bool) -> DataFrame:
    """Frequent phrases (staged) with ``parts``, the counts of their beginnings (endings) by length, and ``longer``, that of the commonest extension."""
    every = max(1, total // SAMPLE_PHRASES)
    rows = frequent.where(F.pmod(F.xxhash64("lang", "phrase"), F.lit(every)) == 0).select("lang", "phrase").collect()
    sample = [((r["lang"], tuple(r["phrase"].encode().split(b" "))[:: -1 if backwards else 1]), 1.0) for r in rows]
    bounds = _even_bounds(sample, total // RANGE_PHRASES + 1)
    dealt = frequent.select("lang", "phrase", "n").mapInArrow(_ordered(bounds, backwards), "part int, lang string, phrase string, n long, copied boolean")
    walked = dealt.groupBy("part").applyInArrow(_walked(backwards), "lang string, phrase string, a long, parts array<long>, longer long")
    return walked.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("parts").alias("parts"), F.max("longer").alias("longer"))


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to ORDER words with at least ``least`` places (lang, phrase, words, n; staged) and all words per language (lang, total)."""
    texts = docs.select(F.coalesce(col(lang_col).cast("string"), F.lit("und")).alias("lang"), col(text_col).cast("string").alias("text"))
    bounds = _window_bounds(texts)
    streams = texts.mapInArrow(_streams(bounds, BLOCK_WORDS), "part int, lang string, stream binary")
    merged = streams.groupBy("part", "lang").applyInArrow(_merged(least), "lang string, phrase string, words int, n long")
    counted = staged(merged.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("words") == 0)), "phrases")
    return counted.where("words > 0"), counted.where("words = 0").select("lang", F.col("n").alias("total"))


def score(a: str, n: str, left: str, right: str) -> str:
    """floor(1000 * a * n / (left * right)) in exact decimals; the quotient is at most 1000 * n and fits a long."""
    wide = lambda c, digits: f"CAST({c} AS DECIMAL({digits}, 0))"
    return f"(1000 * {wide(a, 16)} * {wide(n, 16)}) DIV ({wide(left, 18)} * {wide(right, 18)})"


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, absorbed: int = 100, most: int = 2000) -> DataFrame:
    """The ``most`` highest-scoring phrases of 2 to ORDER words of every language: lang, rank, phrase, a, l, r, n, score.

    A-Z is lower-cased, pieces end at any of ``.,;:!?`` and line ends, words at blanks and tabs.  ``a``
    counts all places of the phrase within pieces, at least ``least``; ``l`` and ``r`` those of its two
    parts at the lowest-scoring cut (ties: the shortest left part), ``n`` all words of the language;
    score is floor(1000 * a * n / (l * r)), exact up to 10^16 words.  A phrase is dropped if one word more on a side is a
    phrase with 100 * count >= ``absorbed`` * a (any longer phrase around it has no more places than
    that one).  Ties in score go to the larger a, then to the phrase in byte order.  A null language is ``und``; null
    and empty texts have no words; rows are counted one by one, repeated ones too; an empty table
    gives no rows; other columns are ignored.  Texts are read whole; a long one spans several blocks.
    """
    frequent, totals = phrase_counts(docs, lang_col, text_col, least)
    size = frequent.count()
    forwards = _walk(frequent, size, False).select("lang", "phrase", "a", F.col("parts").alias("l"), F.col("longer").alias("right_longer"))
    backwards = _walk(frequent, size, True).select("lang", "phrase", F.col("parts").alias("r"), F.col("longer").alias("left_longer"))
    met = forwards.join(backwards.hint("merge"), ["lang", "phrase"]).where("size(l) > 0").join(totals, "lang")
    met = met.where(F.lit(100) * F.greatest("right_longer", "left_longer") < F.lit(absorbed) * F.col("a"))
    cuts = f"transform(sequence(1, size(l)), k -> struct({score('a', 'total', 'l[k - 1]', 'r[size(r) - k]')} AS score, k AS k, l[k - 1] AS l, r[size(r) - k] AS r))"
    best = met.withColumn("cut", F.array_min(F.expr(cuts)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase"))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("total").alias("n"), F.col("cut.score").alias("score"))
