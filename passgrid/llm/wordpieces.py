"""Token ids of whole texts by a public tokenizer file, one lookup per distinct word.

The tokenizers served here normalise with NFC, white space and lower case, and pre-tokenise
by a pattern whose pieces hold no white space.  White space is then a hard boundary of both
steps, so a text's ids are the joined ids of its white-space-separated chunks and every chunk
needs the tokenizer only once.  Chunks of plain Latin letters are split into pre-tokens by an
equal pattern here; all others go through the library itself.  Strings of added tokens inside
a text are handled as the library does by default: they become their single id.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

# The tokenizer file's own pre-token pattern, normaliser kinds and pre-tokeniser kinds.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD_PRETOKENIZERS = ["Split", "ByteLevel"]

#: Entries that one worker keeps in each cache before it starts afresh.
CACHE_ENTRIES = 250_000


def _plain_pattern() -> tuple[re.Pattern, re.Pattern]:
    """The pre-token pattern over code points below 0x180 and the test for such chunks.

    Below 0x180 NFC changes nothing and categories and case are settled; the dotted capital I
    (0x130) is left out because its lower case is two characters.
    """
    chars = [chr(i) for i in range(0x180)]
    letters = "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == "L")
    numbers = "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == "N")
    space = "\t-\r \x85\xa0"
    words = f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+"
    return re.compile(words), re.compile("[\x00-įı-ſ]*")


class WordTokenizer:
    """Chunk-wise encoder; one instance per Python worker and file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        added = spec.get("added_tokens") or []
        plain_added = all(not (a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"]) for a in added)
        self.by_chunk = (
            norm == WORD_NORMALIZERS
            and [p["type"] for p in pre] == WORD_PRETOKENIZERS
            and pre[0]["pattern"].get("Regex") == WORD_PATTERN
            and plain_added
        )
        self.added = {a["content"]: a["id"] for a in added}
        self.added_split = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        # What every added token begins with, up to its first letter: a text without it holds none, in any case of letters.
        self.opening = re.match(r"[\W\d_]*", os.path.commonprefix(list(self.added)))[0]
        self.words, self.plain = _plain_pattern()
        self.model = self.library.model
        self.packed = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        # The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from 256 on.
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = [b for b in range(256) if b not in shown]
        self.byte_chars = {b: chr(256 + i) for i, b in enumerate(hidden)}
        self._chunks: dict[str, bytes] = _Filled(self._chunk_ids)
        self._words: dict[str, bytes] = _Filled(self._word_ids)
        self._chunk_lengths: dict[str, int] = _Recent(self._chunk_length)
        self._word_lengths: dict[str, int] = _Recent(lambda w: len(self.tokens_of_pretoken(w)))

    # one chunk or word ------------------------------------------------------------------
    def tokens_of_pretoken(self, word: str) -> list:
        """The model's tokens of one (normalised) pre-token."""
        if not (word.isascii() and word.isprintable()):
            word = word.encode("utf-8", "replace").decode("latin-1").translate(self.byte_chars)
        return self.model.tokenize(word)

    def _word_ids(self, word: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokens_of_pretoken(word)])

    def chunk_pretokens(self, chunk: str) -> tuple[str, ...]:
        if chunk.isascii() or self.plain.fullmatch(chunk):
            if chunk.isalpha():
                return (chunk.lower(),)
            return tuple(self.words.findall(chunk.lower()))
        normal = self.library.normalizer.normalize_str(chunk)
        return tuple(normal[a:b] for _, (a, b) in self._split().pre_tokenize_str(normal))

    @lru_cache(1)
    def _split(self):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        return Split(Regex(WORD_PATTERN), "removed", invert=True)

    def _chunk_ids(self, chunk: str) -> bytes:
        words = self._words
        return b"".join([words[w] for w in self.chunk_pretokens(chunk)])

    def _chunk_length(self, chunk: str) -> int:
        lengths = self._word_lengths
        return sum([lengths[w] for w in self.chunk_pretokens(chunk)])

    def lengths(self, chunks: Iterable[str]) -> list[int]:
        """Tokens of every chunk, where none holds an added token; no ids are made or kept."""
        for cache in (self._chunk_lengths, self._word_lengths):
            if len(cache) > CACHE_ENTRIES // 2:
                cache.turn()
        return list(map(self._chunk_lengths.__getitem__, chunks))

    # whole texts ------------------------------------------------------------------------
    def segments(self, text: str):
        """(chunks, None) for stretches of ordinary text, (None, id) for added tokens."""
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            cut = lambda s: re.split("[\t-\r \x85\xa0  -     　]+", s)
        else:
            cut = str.split
        if self.added_split is None or self.opening not in text:
            yield cut(text), None
            return
        for part in self.added_split.split(text):
            if part in self.added:
                yield None, self.added[part]
            elif part:
                yield cut(part), None

    def ids(self, text: str) -> bytes:
        """Ids of the text, packed as little-endian unsigned 32-bit numbers."""
        if not self.by_chunk:
            return b"".join(i.to_bytes(4, "little") for i in self.library.encode(text, add_special_tokens=False).ids)
        self.trim()
        if _in_latin1(text):
            text = text.lower() if self.opening not in text else text
        out = []
        for chunks, one in self.segments(text):
            out.append(one.to_bytes(4, "little") if chunks is None else b"".join(map(self._chunks.__getitem__, chunks)))
        return b"".join(out)

    def trim(self) -> None:
        for cache in (self._chunks, self._words):
            if len(cache) > CACHE_ENTRIES:
                cache.clear()


def _in_latin1(text: str) -> bool:
    """Whether lower case can be taken before NFC and chunking (it is per character and composes nothing)."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Filled(dict):
    """A dict that fills a missing key by a function of it."""

    def __init__(self, fill):
        super().__init__()
        self.fill = fill

    def __missing__(self, key):
        value = self[key] = self.fill(key)
        return value


class _Recent(_Filled):
    """The same, which forgets at a turn what was not asked for since the turn before."""

    def __init__(self, fill):
        super().__init__(fill)
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key)
        value = self[key] = self.fill(key) if value is None else value
        return value

    def turn(self) -> None:
        self.older = dict(self)
        self.clear()


class PieceTokenizer:
    """Encoder of a sentencepiece file; whole texts go through the library."""

    by_chunk = False

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.library.encode(text, num_threads=1))


@lru_cache(4)
def _by_path(path: str) -> WordTokenizer | PieceTokenizer:
    return PieceTokenizer(path) if path.endswith(".model") else WordTokenizer(path)


def resolved(name_or_path: str) -> str:
    """An absolute path as it is, a name as its place in the installed public set."""
    if os.path.isabs(name_or_path):
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def word_tokenizer(name_or_path: str) -> WordTokenizer | PieceTokenizer:
    """The worker's encoder for a .json or .model file: an absolute path, or a name in the installed public set."""
    return _by_path(resolved(name_or_path))
