"""Names and birth dates across scripts and calendars; Column expressions but for one ratio."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passgrid.functions.identifiers import characters, norm

# Devanagari letters and signs in Latin, as names are commonly written.
DEVANAGARI = {
    "अ": "a", "आ": "aa", "इ": "i", "ई": "ii", "उ": "u", "ऊ": "uu", "ऋ": "ri", "ऌ": "e", "ए": "e", "ऐ": "ai", "ऑ": "o", "ओ": "o", "औ": "au",
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ng", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "ny",
    "ट": "tt", "ठ": "tth", "ड": "dd", "ढ": "ddh", "ण": "nn", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n", "ऩ": "nn",
    "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ऱ": "l", "ल": "l", "ळ": "ll", "ऴ": "ll", "व": "v", "श": "sh", "ष": "shh", "स": "s", "ह": "h",
    "ा": "aa", "ि": "i", "ी": "ii", "ु": "u", "ू": "uu", "ृ": "ri", "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "ँ": "n", "ं": "n", "ः": "h", "़": "", "्": "",
}
DIGITS = "०१२३४५६७८९"
HONORIFICS = ["MR", "MS", "MRS", "SHRI", "SMT", "DR", "KUMAR"]
SOUNDEX = {"1": "BFPV", "2": "CGJKQSXZ", "3": "DT", "4": "L", "5": "MN", "6": "R"}


def latin(c: Column) -> Column:
    """Devanagari in Latin letters, long vowels shortened; other characters as they are."""
    table = F.create_map(*[F.lit(x) for kv in DEVANAGARI.items() for x in kv])
    out = F.array_join(F.transform(characters(c), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    for long, short in (("aa", "a"), ("ii", "i"), ("uu", "u")):
        out = F.replace(out, F.lit(long), F.lit(short))
    return F.when(c.rlike("[\\u0900-\\u097F]"), out).otherwise(c)


def name_digest(c: Column) -> Column:
    return F.sha2(norm(latin(c)), 256)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / length of the longer; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def names_match(a: Column, b: Column) -> Column:
    """True from .72 on, false below .62, between them undecided."""
    s = similarity(F.upper(latin(a)), F.upper(latin(b)))
    return F.when(s >= 0.72, True).when(s < 0.62, False)


def soundex(c: Column) -> Column:
    """First letter and the codes that differ from the code before; vowels, H and W end a run."""
    letters = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z]", "")
    source = "".join(SOUNDEX.values()) + "AEIOUYHW"
    target = "".join(d * len(v) for d, v in SOUNDEX.items()) + "0" * 8
    codes = characters(F.translate(letters, source, target))
    kept = F.filter(F.transform(codes, lambda x, i: F.when((i > 0) & (x != "0") & (x != F.get(codes, i - 1)), x)), lambda x: x.isNotNull())
    return F.when(letters == "", "0000").otherwise(F.left(F.concat(F.left(letters, F.lit(1)), F.array_join(kept, ""), F.lit("0000")), F.lit(4)))


def name_tokens(c: Column) -> Column:
    all_ = F.filter(F.split(F.trim(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z ]", " ")), " +"), lambda x: x != "")
    plain = F.filter(all_, lambda x: ~x.isin(*HONORIFICS))
    return F.when(F.size(plain) > 0, plain).otherwise(all_)


def same_tokens(a: Column, b: Column) -> Column:
    """Equal sets of tokens, or one within the other."""
    return (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)


def same_initials(a: Column, b: Column) -> Column:
    """Token by token equal, or one the initial of the other."""
    fits = lambda x, y: (x == y) | ((F.length(x) == 1) & y.startswith(x)) | ((F.length(y) == 1) & x.startswith(y))
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, fits), lambda x: F.coalesce(x, F.lit(False)))


def _code_points(texts: list[str]) -> np.ndarray:
    """Texts as rows of code points, filled up by zeros (a code point is one more than its number)."""
    width = max(1, *map(len, texts)) if texts else 1
    out = np.zeros((len(texts), width), np.int32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32) + 1
    return out


def _longest_blocks(eq: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every table of equal places the longest diagonal run between the corners low and high: (length, its two starts).

    The earliest start in the first text wins, then the earliest in the second.
    """
    n, rows, columns = eq.shape
    best, at = np.zeros(n, np.int64), low.copy()
    j = np.arange(columns)
    inside = (j >= low[:, 1:]) & (j < high[:, 1:])
    run = np.zeros((n, columns + 1), np.int64)
    for i in range(rows):
        row = eq[:, i] & inside & (i >= low[:, :1]) & (i < high[:, :1])
        run[:, 1:] = np.where(row, run[:, :-1] + 1, 0)
        end = run[:, 1:].argmax(1)
        size = run[np.arange(n), end + 1]
        more = size > best
        best[more] = size[more]
        at[more] = np.stack([i + 1 - size, end + 1 - size], 1)[more]
    return best, at


def block_ratio(a: list[str], b: list[str]) -> np.ndarray:
    """Twice the characters in common blocks over all characters, 1 for two empty texts.

    The longest common block comes first, then those on both its sides.  All pairs of a batch go together: a
    round finds a block in every stretch that is left.  In a second text of 200 characters or more those
    that make up over a hundredth of it start no block, they only make one longer.
    """
    x, y = _code_points(a), _code_points(b)
    sizes = np.array([[len(p), len(q)] for p, q in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    matched = np.zeros(len(a), np.int64)
    common = np.array([[q.count(c) > len(q) // 100 + 1 for c in q] + [False] * (y.shape[1] - len(q)) if len(q) >= 200 else [False] * y.shape[1] for q in b], bool).reshape(len(b), y.shape[1])
    step = max(1, (8 << 20) // max(1, x.shape[1] * y.shape[1]))
    for first in range(0, len(a), step):
        own = slice(first, first + step)
        same = (x[own, :, None] == y[own, None, :]) & (x[own, :, None] > 0)
        starts = same & ~common[own, None, :]
        pair = np.arange(len(same))
        low, high = np.zeros((len(same), 2), np.int64), sizes[own].copy()
        while len(pair):
            size, at = _longest_blocks(starts[pair], low, high)
            for step_, edge in ((-1, low), (1, high)):  # blocks grow over what starts none
                while True:
                    to = at + step_ if step_ < 0 else at + size[:, None]
                    free = (to >= low).all(1) & (to < high).all(1)
                    grows = np.zeros(len(pair), bool)
                    grows[free] = same[pair[free], to[free, 0], to[free, 1]]
                    if not grows.any():
                        break
                    size = size + grows
                    at = at - grows[:, None] if step_ < 0 else at
            found = size > 0
            np.add.at(matched, first + pair[found], size[found])
            pair, low, high, at, size = (v[found] for v in (pair, low, high, at, size))
            low, high, pair = np.concatenate([low, at + size[:, None]]), np.concatenate([at, high]), np.concatenate([pair, pair])
            left = (low < high).all(1)
            pair, low, high = pair[left], low[left], high[left]
    total = sizes.sum(1)
    return np.where(total > 0, 2 * matched / np.maximum(total, 1), 1.0)


@F.pandas_udf(T.DoubleType())
def gestalt_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over all of them, matches by longest common blocks; nulls are empty."""
    return pd.Series(block_ratio([x or "" for x in a], [y or "" for y in b]))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; for columns that may hold non-ASCII forms."""
    return s.str.normalize("NFKC")


def norm_any(c: Column) -> Column:
    """Normalised as identifiers are, wide and composed forms first brought to their plain ones (only such rows carry text to Python)."""
    return norm(F.coalesce(nfkc(F.when(c.rlike("[^\\x00-\\x7F]"), c)), c))


def birth_text(c: Column, bikram: Column) -> Column:
    """A birth date as YYYY-MM-DD (or a year), native digits read, Bikram Sambat years moved where the document is of that calendar."""
    s = F.translate(F.trim(F.coalesce(c, F.lit(""))), DIGITS, "0123456789")
    iso, local = r"([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})", r"([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})"
    g = lambda p, i: F.regexp_extract(s, p, i)
    shift = F.when((bikram | c.rlike(f"[{DIGITS}]")) & g(iso, 1).try_cast("int").between(1970, 2120), 57).otherwise(0)
    two = lambda x: F.lpad(x, 2, "0")
    return (
        F.when(s.rlike(iso), F.concat_ws("-", F.lpad((g(iso, 1).try_cast("int") - shift).cast("string"), 4, "0"), two(g(iso, 2)), two(g(iso, 3))))
        .when(s.rlike(local), F.concat_ws("-", g(local, 3), two(g(local, 2)), two(g(local, 1))))
        .when(s.rlike(r"\b(19[0-9]{2}|20[0-9]{2})\b"), F.regexp_extract(s, r"\b(19[0-9]{2}|20[0-9]{2})\b", 1))
        .otherwise(s)
    )
