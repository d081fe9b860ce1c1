"""Whole-text byte-level BPE ids from the tokenizers library, with a bounded cache.

In a byte-level vocabulary no token crosses a place where a single space
stands between two non-space characters, because the splitting pattern starts a
new pre-token at that space. A text is therefore cut at these places, and each
chunk (a space and the word behind it) is encoded once and remembered. A chunk
of Latin letters and closing marks is two pre-tokens, which go to the library's BPE
model straight; any other chunk goes through the whole tokenizer. The ids equal
those of encoding the text in one call (tests/llm/test_token_outputs.py).

Texts that come as an Arrow array are cut together: each different chunk of a run of
texts is looked up once, and the ids of all its places are gathered by numpy. There
newlines are cut out too. In a run of one or two white-space characters that does not
end the text, each is a pre-token or the start of one; a text with other runs is
encoded by itself.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: white space on both sides of a space: such a run can hold tokens across the cut
_LOOSE = re.compile(r"\s \s")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_MARKS = "!\"#$%&()*+,./:;<=>?@[]|-"
#: what any library takes for white space, in the words of Arrow's regular expressions
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LONG_RUN = rf"{_WHITE}{_WHITE}(?:{_WHITE}|\z)"
#: stands between the chunks of a text; texts that hold it are encoded by themselves
_BETWEEN = "\x00"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: visible Latin-1 characters as they are, the others from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = (b for b in range(256) if b not in seen)
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Cache(dict):
    """text -> its ids as little-endian unsigned 32-bit bytes, for ``lead`` + text.

    When ``limit`` texts are held, they become the old generation and the one before them
    is let go; what is asked for again returns to the new one. So frequent texts stay."""

    def __init__(self, encode, lead: str, limit: int):
        super().__init__()
        self.encode, self.lead, self.limit = encode, lead, limit
        self.old: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        ids = self.old.get(text)
        if ids is None:
            ids = self.encode(self.lead + text)
        if len(text) <= 48:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[text] = ids
        return ids


class Encoder:
    """Texts of an array are cut together up to ``run_bytes`` of UTF-8; a longer text is encoded by itself."""

    def __init__(self, path: str, cache_entries: int = 400_000, run_bytes: int = 4 << 20):
        self.run_bytes = run_bytes
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        # cutting is right only for this kind of tokenizer; others get whole texts
        self.cuts = (spec.get("normalizer") is None and split.get("type") == "ByteLevel"
                     and split.get("use_regex", True) and not split.get("add_prefix_space", True))
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.letters = _byte_letters()
        self.id_bytes = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values(), default=0) + 1)]
        self.model = self.tokenizer.model
        self.marks = _Cache(self._pre_token, "", 10_000)
        self.first = _Cache(self._chunk, "", max(10_000, cache_entries // 10))
        self.rest = _Cache(self._chunk, " ", cache_entries)

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _pre_token(self, part: str) -> bytes:
        if part.isascii():  # a space is the only ASCII character of these that is written as another
            letters = part.replace(" ", self.letters[32])
        else:
            letters = part.encode().decode("latin-1").translate(self.letters)
        id_bytes = self.id_bytes
        return b"".join([id_bytes[t.id] for t in self.model.tokenize(letters)])

    def _chunk(self, chunk: str) -> bytes:
        word = chunk.rstrip(_MARKS)
        letters = word.removeprefix(" ")
        # Latin letters, which every version of Unicode has as letters
        if not (letters.isalpha() and (letters.isascii() or max(letters) <= "\u024f")):
            return self._direct(chunk)
        if word == chunk:
            return self._pre_token(word)
        return (self.rest[letters] if word[0] == " " else self._pre_token(word)) + self.marks[chunk[len(word):]]

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers; null counts as empty."""
        if not text:
            return b""
        if not self.cuts or any(t in text for t in self.added):
            return self._direct(text)
        first, *rest = _CUT.split(text) if _LOOSE.search(text) else text.split(" ")
        return self.first[first] + b"".join(map(self.rest.__getitem__, rest))

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """The pieces of all texts as numbers, where each text's begin, and the ids of each numbered piece."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.cuts:
            return np.arange(len(texts)), np.arange(len(texts)), [self._direct(t) if t else b"" for t in texts.to_pylist()]
        alone = pc.or_(pc.match_substring_regex(texts, _LONG_RUN), pc.greater(pc.binary_length(texts), self.run_bytes))
        for part in (_BETWEEN, *self.added):
            alone = pc.or_(alone, pc.match_substring(texts, part))
        marked = pc.if_else(alone, "", texts)
        for old, new in ((" ", f"{_BETWEEN} "), ("\n", f"{_BETWEEN}\n{_BETWEEN}")):
            marked = pc.replace_substring(marked, old, new)
        cut = pc.split_pattern(marked, _BETWEEN)
        pieces = cut.flatten().dictionary_encode()
        numbers, begins = pieces.indices.to_numpy(), cut.offsets.to_numpy()[:-1]
        ids = [self.rest[piece[1:]] if piece.startswith(" ") else self.first[piece]
               for piece in pieces.dictionary.to_numpy(zero_copy_only=False)]
        if pc.any(alone).as_py():
            numbers = numbers.copy()
            for i in np.flatnonzero(alone.to_numpy(zero_copy_only=False)):
                numbers[begins[i]] = len(ids)  # its one piece
                ids.append(self.encode(texts[i].as_py()))
        return numbers, begins, ids

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        found = [np.empty(0, np.int64)]
        for run in runs(texts, self.run_bytes):
            numbers, begins, ids = self._cut(run)
            found.append(np.add.reduceat(_lengths(ids)[numbers], begins))
        return np.concatenate(found)

    def encode_all(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of texts, in their order: all ids in a row, and the number of ids of each text."""
        for run in runs(texts, self.run_bytes):
            numbers, begins, ids = self._cut(run)
            lengths = _lengths(ids)
            held = np.frombuffer(b"".join(ids), "<u4")
            n = lengths[numbers]
            ends = np.cumsum(n)
            # the places of the row's ids among the held ones
            at = np.repeat((np.cumsum(lengths) - lengths)[numbers] - (ends - n), n)
            at += np.arange(len(at))
            yield held[at], np.add.reduceat(n, begins)


def _lengths(ids: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, ids), np.int64, len(ids)) // 4


def runs(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """``texts`` in runs of about ``size`` bytes, so that memory does not grow with an Arrow batch."""
    if len(texts):
        before = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = np.flatnonzero(np.diff(before // size)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True):
            yield texts.slice(a, b - a)


@lru_cache(maxsize=2)
def encoder(path: str, cache_entries: int = 400_000, run_bytes: int = 4 << 20) -> Encoder:
    """One encoder per Python worker; an entry of the cache takes about 200 bytes."""
    return Encoder(path, cache_entries, run_bytes)
