"""Operator 8's words and tokens: counted by columns, each distinct stretch once."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passgrid.llm import mixing, wordpieces
from passgrid.llm.token_counts import _cut
from passgrid.llm.wordpieces import WordTokenizer, resolved, word_tokenizer

PARTS = ["abc", "Abc", " ", "\n", "'s", "ÉÀ", "H̱", "́", "ß", "\x85", "\xa0", "Ⱥ", "12", "½", "!?", "<|endoftext|>", "<|", "‍", "日", "Σ", "\x1d", "　", "İ"]


def odd_texts():
    rng = np.random.default_rng(8)
    return [None, "", " ", " \t\n\v\f\r ", "x" * 50_000, "A b " * 20_000, *("".join(rng.choice(PARTS, rng.integers(0, 12))) for _ in range(2000))]


def test_counts_are_the_librarys():
    own, rows = word_tokenizer("word_bpe_49k.json"), odd_texts()
    words, tokens = mixing.counts(own, pa.array(["cut off", *rows, None]).slice(1, len(rows)))
    assert words.tolist() == [len(re.findall(r"[^ \t\n\v\f\r]+", t or "")) for t in rows]
    assert tokens.tolist() == [len(own.library.encode(t or "", add_special_tokens=False).ids) for t in rows]
    slices = [mixing.counts(own, b.column(0)) for b in _cut([pa.record_batch([pa.array(rows)], ["text"])], 300, 0)]
    assert len(slices) > 50 and np.concatenate([n for _, n in slices]).tolist() == tokens.tolist()
    own = WordTokenizer(resolved("word_bpe_49k.json"))
    own.by_chunk = False  # as a file of another kind
    assert [x.tolist() for x in mixing.counts(own, pa.array(rows))] == [words.tolist(), tokens.tolist()]


def test_words_are_looked_up_once(monkeypatch):
    """No ids are made, and words that come back are not encoded again where new ones fill the cache."""
    monkeypatch.setattr(wordpieces, "CACHE_ENTRIES", 40)
    own = WordTokenizer(resolved("word_bpe_49k.json"))
    plain, asked = own.tokens_of_pretoken, Counter()
    monkeypatch.setattr(own, "tokens_of_pretoken", lambda w: asked.update([w]) or plain(w))
    monkeypatch.setattr(own, "ids", lambda text: pytest.fail("encoded"))
    letters = lambda n: "q" + "".join(chr(97 + int(d)) for d in str(n))
    for k in range(20):
        rows = [f"Common words, common {letters(30 * k + i)} here." for i in range(30)]
        assert mixing.counts(own, pa.array(rows))[1].tolist() == [len(own.library.encode(t, add_special_tokens=False).ids) for t in rows]
    assert len(asked) == 600 + 5 and set(asked.values()) == {1}
    assert len(own._word_lengths) + len(own._word_lengths.older) < 200


def test_counts_of_rows(spark):
    """The words are Spark's own count of them, and other columns stay by their row."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd_texts())], "n long, text string").repartition(3)
    got = mixing.with_counts(df, "text", "word_bpe_49k.json")
    assert got.columns == ["n", "n_words", "n_tokens"]
    want = df.select("n", F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long").alias("n_words"))
    assert sorted(got.select("n", "n_words").collect()) == sorted(want.collect())
    assert mixing.with_counts(df.limit(0), "text", "word_bpe_49k.json").count() == 0
