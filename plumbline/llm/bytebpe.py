"""Token ids of whole texts by the tokenizers library, with each distinct unit encoded once.

Byte-level BPE works within pre-tokens, and a pre-token never goes on over a white-space character
that stands alone (a single space begins one, a single line feed is one), nor from a letter to a
sign. So texts are cut into units there, on the bytes of many texts at once, and
their ids are those of their units in order. Arrow numbers a block's distinct units, the library
encodes each new one, and a bounded cache keeps its ids. Texts with other white space, with two
white-space characters in a row, or with the start of a special token go to the library whole.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa

from plumbline.llm.common import slices

#: Units whose ids a Python worker keeps, some 200 bytes each; beyond, it starts anew.
CACHE = 700_000
#: Characters of the texts that are cut at a time.
BLOCK_CHARS = 1_000_000
#: Marks of an ASCII byte: a letter, a space or line feed, the latter alone, a sign (no letter or digit), other white space.
_LETTER, _SPACE, _FEED, _SIGN, _ODD = 1, 2, 4, 8, 16
_MARKS = np.zeros(256, np.uint8)
_MARKS[:128] = [_LETTER if chr(b).isalpha() else 0 if chr(b).isdigit() else _ODD if chr(b).isspace() else _SIGN for b in range(128)]
_MARKS[[ord(" "), ord("\n")]] = _SPACE, _SPACE | _FEED
#: Words whose bytes as UTF-8 stand for printable characters of the byte alphabet.
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ſ]+")
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]
_encoders: dict[tuple[str, int], ByteBpe] = {}


def pack_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return _PACK[len(ids)](*ids) if len(ids) < 16 else struct.pack(f"<{len(ids)}I", *ids)


class _Units(dict):
    """Ids by unit, which has the space that it begins with; None stands for one that isn't plain."""

    def __init__(self, library, tokenize, cache: int):
        super().__init__()
        self.library, self.tokenize, self.cache = library, tokenize, cache

    def __missing__(self, key: bytes) -> bytes | None:
        word = key[1:] if key[:1] == b" " else key
        if word.isalpha():
            chars = word.decode() if word is key else "Ġ" + word.decode()
            ids = pack_ids([t.id for t in self.tokenize(chars)])
        elif _LATIN.fullmatch(body := word.decode()):
            ids = pack_ids([t.id for t in self.tokenize(key.decode("latin-1").translate(_BYTE_CHARS))])
        else:
            plain = key == b"\n" or "<|" not in body and body.split() == [body]
            ids = self.library([key.decode()])[0] if plain else None
        if len(self) >= self.cache:
            self.clear()
        self[key] = ids
        return ids


def _cut(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units begin in the bytes `raw` of texts that lie between `bounds`; where white space stands oddly."""
    marks = _MARKS[raw]
    letter = marks & _LETTER
    two = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC5))  # first bytes of À to ſ: all letters but × and ÷
    letter[two + 1] = (raw[two] != 0xC3) | (raw[two + 1] != 0x97) & (raw[two + 1] != 0xB7)
    begins = marks & _SPACE
    begins[1:] |= marks[:-1] & _FEED | letter[:-1] & (marks[1:] // _SIGN)
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[first] = 1
    odd = marks & _ODD
    pairs = marks[1:] & marks[:-1] & _SPACE
    pairs[first[1:] - 1] = 0
    odd[1:] |= pairs
    return np.flatnonzero(begins), np.flatnonzero(odd)


class ByteBpe:
    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.units = _Units(self._library, self.tokenizer.model.tokenize, cache)
        parts = ["a", " bé", ",", "\n", "c", ".5", " (d", ")"]
        self.splits = self._library(["".join(parts)])[0] == b"".join(self._library(parts))

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [pack_ids(e.ids) for e in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for i, j in slices(texts, BLOCK_CHARS):
            out += self._block(texts[i:j])
        return out

    def _block(self, texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        rest = [i for i, t in enumerate(texts) if t]
        if self.splits and rest:
            column = pa.array([t or "" for t in texts], pa.large_string())
            bounds = np.frombuffer(column.buffers()[1], np.int64)[: len(texts) + 1]
            begins, odd = _cut(np.frombuffer(column.buffers()[2], np.uint8)[: bounds[-1]], bounds)
            ends = pa.py_buffer(np.append(begins, bounds[-1]))
            units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, ends, column.buffers()[2]]).dictionary_encode()
            found = list(map(self.units.__getitem__, units.dictionary.to_numpy(zero_copy_only=False).tolist()))
            ids = pa.array([x or b"" for x in found], pa.large_binary()).take(units.indices)
            at = np.frombuffer(ids.buffers()[1], np.int64)[np.searchsorted(begins, bounds)].tolist()
            data = memoryview(ids.buffers()[2] or b"")
            out = [bytes(data[a:b]) for a, b in zip(at, at[1:], strict=False)]
            if None in found:
                unplain = np.array([x is None for x in found])[units.indices.to_numpy()]
                odd = np.append(odd, begins[unplain])
            rest = (np.unique(np.searchsorted(bounds, odd, side="right")) - 1).tolist()
        for i, ids in zip(rest, self._library([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out


def byte_bpe(path: str, cache: int = CACHE) -> ByteBpe:
    """The worker's encoder for the tokenizer file at `path`, which keeps the ids of at most `cache` units."""
    if (path, cache) not in _encoders:
        _encoders[path, cache] = ByteBpe(path, cache)
    return _encoders[path, cache]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
