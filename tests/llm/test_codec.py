"""The BPE codec against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from passgrid.llm.bpe_codec import BoundaryTokenizer, decode, encode, round_trip
from passgrid.llm.common import documents
from passgrid.llm.token_counts import count_tokens
from tests.llm.test_operators import ROWS, SCHEMA

LONG = "a" * 3000 + "lol" * 900 + "é" * 500 + "!?" * 700 + "日本" * 400


def texts():
    rng = random.Random(5)
    pools = ["abcdefghij thelo", "aA'sét ing the of", "0123456789 .,;", "日本語한국어 ", "😀👍🏽 ‍", "\x00\x01\x1c\x85\xa0 ab", "ßİıǅﬁ ŀ'ŒŸé́ab", "<|endoftext|> <|START", "xqzjvkwq"]
    out = ["", LONG, "Don't we'll <|endoftext|>x <|startoftext|> <|ENDOFTEXT|> </w> &amp;</w>"]
    return out + ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 300))) for _ in range(400)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_fragments_give_the_library_s_ids(name):
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), BoundaryTokenizer(path)
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.ids(text), "<u4").tolist() == ids, text
        assert own.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_cuts_are_certain_and_met():
    own = BoundaryTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    words = [w.encode() for t in texts() for w in t.split()]
    cut = [own.cuts(w) for w in words]
    assert any(len(w) > 64 and c for w, c in zip(words, cut, strict=True)) and any(len(w) < 64 and c for w, c in zip(words, cut, strict=True))
    # No token of the vocabulary holds a pair that is cut; a pre-token's last byte is another symbol than the same byte within.
    inside = set()
    for token in own.strings[:49406]:
        body = token.removesuffix("</w>")
        symbols = [(c, token != body and i == len(body) - 1) for i, c in enumerate(body)]
        inside |= set(zip(symbols, symbols[1:], strict=False))
    chars = {b: c for c, b in own.byte_of.items()}
    for word, places in zip(words, cut, strict=True):
        symbols = [(chars[b], i == len(word) - 1) for i, b in enumerate(word)]
        assert [i for i in range(1, len(word)) if (symbols[i - 1], symbols[i]) not in inside or i in places] == places


def test_round_trip_over_the_table_and_hard_rows(spark, small):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))

    def expected(doc_id, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())

    docs = documents(spark, small)
    want = sorted(expected(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert sorted(map(tuple, round_trip(docs).collect())) == want
    hard = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    assert sorted(map(tuple, round_trip(hard).collect()), key=key) == sorted((expected(r[0], r[1]) for r in ROWS), key=key)
    assert round_trip(hard.limit(0)).collect() == []


def test_decode_keeps_other_columns_and_nulls(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, "")], "doc_id long, text string")
    ids = encode(docs).selectExpr("doc_id AS `a.b`", "'x' AS decoded", "CASE WHEN doc_id = 1 THEN ids END AS ids")
    assert sorted(map(tuple, decode(ids).select("`a.b`", "decoded").collect())) == [(1, "hello</w> world</w>"), (2, None)]
    assert [r.decoded for r in decode(encode(docs.where("doc_id = 2"))).collect()] == [""]
    with pytest.raises(Exception, match="No such file"):
        encode(docs, tokenizer="/nowhere.json").collect()


def test_token_counts_of_a_sentencepiece_file(spark, small):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = [(i, t) for i, t in enumerate([None, "", "Hello <s> </s> world", *texts()[:60]])] + [tuple(r) for r in documents(spark, small).select("doc_id", "text").limit(40).collect()]
    got = sorted((r.doc_id, r.n_tokens) for r in count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer="piece_bpe_32k.model").collect())
    assert got == sorted((i, len(library.encode(t or ""))) for i, t in rows)
    with pytest.raises(Exception, match="byte-level BPE"):
        encode(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer="piece_bpe_32k.model").collect()
