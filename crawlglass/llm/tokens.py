"""Encoding texts with a public tokenizer inside tasks.

Words repeat far more often than texts, so a worker process remembers the ids of the words it has met.  The texts are
cut only where the tokenizer itself always starts anew (beside a space or line feed), so the ids are exactly those of
the whole text; texts for which that does not hold are encoded whole.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

REMEMBERED = 1_200_000  # words a worker keeps; then it starts afresh
LONG = 8_000_000  # characters of a text that are looked at together
# White space other than space and line feed, and the first characters of added tokens.
_ODD = re.compile(r"[^\S \n]|<\|")
_SPACED = re.compile(r" ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]+")
_BLANKS = re.compile(r"[ \n]")
_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
# Bytes: space and line feed, ASCII letters, other ASCII, and those whose words are not cut further.
_BLANK, _LETTER, _OTHER, _UNCUT = range(4)
_KIND = bytes(
    _BLANK if b in b" \n" else _UNCUT if b > 127 or b == ord("'") else _LETTER if chr(b).isalpha() else _OTHER for b in range(256)
)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# In a text of other bytes only (the others begin white space or end "<|"), _ODD finds nothing.
_NEVER_ODD = bytes(b for b in range(256) if b not in b"|\xc2\xe1\xe2\xe3" and (not chr(b).isspace() or b > 127 or b in b" \n"))


def _printable_bytes() -> dict[int, str]:
    """Byte-level tokenizers write printable bytes as themselves and the others as the characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _is_odd(text: str, data: bytes) -> bool:
    """Whether ``_ODD`` finds something in the text, which ``data`` holds as UTF-8."""
    return bool(data.translate(None, _NEVER_ODD)) and _ODD.search(text) is not None


class Encoder:
    """Ids of texts by the tokenizer in ``path``, without special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self.vocabulary = self._tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._map = str.maketrans({chr(b): c for b, c in _printable_bytes().items()})
        self._space = chr(256 + 32)
        self._known: dict[str, bytes] = {}
        before, pieces = config.get("normalizer"), config.get("pre_tokenizer") or {}
        steps = [s["type"] for s in pieces.get("pretokenizers", [])]
        odd = any("<|" not in t["content"] for t in config.get("added_tokens", []))
        # Two kinds can be cut at white space; others are encoded whole.
        self._keeps_space = before is None and pieces.get("type") == "ByteLevel" and not pieces["add_prefix_space"] and not odd
        self._drops_space = (
            [s["type"] for s in (before or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and steps == ["Split", "ByteLevel"]
            and not odd
        )

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype.itemsize == 2 else 'I'}", *ids)

    def _whole(self, text: str) -> bytes:
        return self._pack(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def _letters(self, word: str) -> bytes:
        """One run of Latin letters (perhaps after a space), which the tokenizer does not cut further."""
        if word.isascii():
            written = word.replace(" ", self._space)
        else:
            written = word.encode("utf-8").decode("latin-1").translate(self._map)
        return self._pack([token.id for token in self._model.tokenize(written)])

    def _chunk(self, chunk: str) -> bytes:
        space = chunk[:1] == " "
        letters = _WORD.match(chunk, space)
        if letters is None or (self._drops_space and space):
            return self._whole(chunk)
        head, tail = chunk[: letters.end()], chunk[letters.end() :]
        if tail and (tail[0].isalpha() or tail[0] == "'" or unicodedata.combining(tail[0])):
            return self._whole(chunk)
        if tail:
            return self._remembered(head) + self._remembered(tail)
        return self._letters(head.lower() if self._drops_space else head)

    def _remembered(self, chunk: str) -> bytes:
        ids = self._known.get(chunk)
        if ids is None:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            ids = self._known[chunk] = self._chunk(chunk)
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not (self._keeps_space or self._drops_space) or _ODD.search(text):
            return np.frombuffer(self._whole(text), dtype=self.dtype)
        chunks = _SPACED.findall(text) if self._keeps_space else text.split()
        known = self._known
        try:
            ids = b"".join([known[c] for c in chunks])
        except KeyError:
            remembered = self._remembered
            ids = b"".join([known.get(c) or remembered(c) for c in chunks])
        return np.frombuffer(ids, dtype=self.dtype)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as :meth:`encode` gives them; equal words of the texts are looked up once."""
        if not self._drops_space:
            return [self.encode(text) for text in texts]
        raw = [text.encode("utf-8") for text in texts]
        apart = [len(text) > LONG or _is_odd(text, data) for text, data in zip(texts, raw)]
        raw = [b"" if alone else data for data, alone in zip(raw, apart)]
        joined = b"\n".join([b"", *raw])
        data, kind, lower = (np.frombuffer(d, np.uint8) for d in (joined, joined.translate(_KIND), joined.translate(_LOWER)))
        begins = np.cumsum([1, *(len(r) + 1 for r in raw)])  # of each text, and of one more
        if not joined.isascii():
            kind, lower = kind.copy(), lower.copy()
            latin = np.flatnonzero(data == 0xC3)  # with the next byte À to ÿ; letters but × and ÷
            latin = latin[(data[latin + 1] | 0x20) != 0xB7]
            kind[latin] = kind[latin + 1] = _LETTER
            lower[latin[data[latin + 1] < 0x9F] + 1] += 32
        if (kind == _UNCUT).any():
            # Case is kept beside combining marks, and a word with such a byte stays in one piece.
            blank = kind == _BLANK
            word = np.cumsum(blank) - 1
            uncut = np.zeros(word[-1] + 1, bool)
            uncut[word[kind == _UNCUT]] = True
            uncut = uncut[word] & ~blank
            kind, lower = np.where(uncut, np.uint8(_UNCUT), kind), np.where(uncut, data, lower)
        filled = kind != _BLANK
        cut = np.zeros(len(data), bool)
        cut[1:] = filled[1:] & (kind[1:] != kind[:-1])
        ids, ends = self._ids_of(lower[filled], np.flatnonzero(cut[filled]))
        first = np.searchsorted(np.flatnonzero(cut), begins)
        at = np.concatenate([[0], ends])[first]
        return [self._apart(t) if alone else ids[i:j] for t, alone, i, j in zip(texts, apart, at, at[1:])]

    def _apart(self, text: str) -> np.ndarray:
        """The ids of a text that is odd or long; a long one is cut before a blank, where the tokenizer starts anew."""
        if len(text) <= LONG or _ODD.search(text):
            return self.encode(text)
        ids, begin = [], 0
        while begin < len(text):
            blank = _BLANKS.search(text, begin + LONG // 2)
            end = blank.start() if blank else len(text)
            part = text[begin:end]
            ids.append(self.encode_all([part])[0] if len(part) <= LONG else self.encode(part))
            begin = end
        return np.concatenate(ids)

    def _learned(self, chunk: str) -> bytes:
        """As ``_remembered``, for a new chunk in lower case unless it is not cut."""
        if not _WORD.fullmatch(chunk):
            return self._remembered(chunk)
        if len(self._known) >= REMEMBERED:
            self._known.clear()
        ids = self._known[chunk] = self._letters(chunk)
        return ids

    def _ids_of(self, letters: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks of ``letters`` (UTF-8) that begin at ``begins``, and where each chunk's ids end."""
        if not len(begins):
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        offsets = np.append(begins, len(letters)).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.utf8(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        chunks = chunks.dictionary_encode()
        get, learned = self._known.get, self._learned
        own = [get(c) or learned(c) for c in chunks.dictionary.to_pylist()]
        sizes = np.array([len(i) for i in own]) // self.dtype.itemsize
        places = np.cumsum(sizes) - sizes
        which = chunks.indices.to_numpy()
        size = sizes[which]
        ends = np.cumsum(size)
        at = np.repeat(places[which] - (ends - size), size)
        at += np.arange(len(at))
        return np.frombuffer(b"".join(own), self.dtype)[at], ends


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and tokenizer file."""
    return Encoder(path)
