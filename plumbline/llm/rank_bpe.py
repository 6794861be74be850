"""Word-level BPE by contiguous rank arrays, for many short words at once."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import slices, table

#: Words whose encoding a Python worker keeps; beyond, it starts anew.
CACHE = 400_000
#: Bytes up to which a word is short (longer ones are merged one by one and not kept), rows and cells
#: (rows times width) of a matrix of short words.
SHORT, ROWS, CELLS = 512, 4096, 1 << 18
_NONE = np.iinfo(np.int32).max
_encoders: dict[str, RankBpe] = {}


class RankBpe:
    """The encoder and decoder of a tokenizer file of the kind BPE with word ends.

    A text is cut at special tokens; the rest is normalised (NFC, white space to one space, lower
    case) and split into words, whose UTF-8 bytes are the first parts; the last carries the word
    end. Each word is a row of two arrays, part ids and the ranks of adjacent parts. The least rank
    (the leftmost, if equal) is looked for, its right boundary deleted, and the two ranks beside it
    are refreshed, until no adjacent parts have a rank. A word of over SHORT bytes, whose array would be
    scanned too often, keeps its ranks in a heap and its parts in a linked list; the choice is the same.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split)
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        char = _byte_chars()
        self.byte_id = np.array([vocab[c] for c in char], dtype=np.int64)
        self.last_id = np.array([vocab[c + self.end] for c in char], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.width = max(self.tokens) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made[order]
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.passing: list[str] = []
        self.pairs: dict[int, tuple[int, int]] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each adjacent pair (the largest integer if none) and what it merges to."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.rank[at], _NONE), self.made[at]

    def merge(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        data = [w.encode() for w in words]
        out: list[list[int]] = [[] for _ in words]
        by_length = sorted((i for i in range(len(words)) if data[i]), key=lambda i: len(data[i]))
        while by_length and len(data[by_length[-1]]) > SHORT:
            i = by_length.pop()
            out[i] = self._merge_long(data[i])
        a = 0
        while a < len(by_length):
            b = min(a + ROWS, len(by_length))
            while b > a + 1 and (b - a) * len(data[by_length[b - 1]]) > CELLS:
                b = a + max(1, (b - a) // 2)
            for i, ids in zip(by_length[a:b], self._merge_rows([data[i] for i in by_length[a:b]]), strict=True):
                out[i] = ids
            a = b
        return out

    def _merge_long(self, data: bytes) -> list[int]:
        """The ids of one word: a heap of (rank, place) and the places before and after each part."""
        if not self.pairs:
            self.pairs = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.made.tolist(), strict=True), strict=True))
        n, pairs, width = len(data), self.pairs, self.width
        part = self.byte_id[np.frombuffer(data, np.uint8)]
        part[-1] = self.last_id[data[-1]]
        ranks, _ = self._ranks(part[:-1], part[1:])
        known = np.flatnonzero(ranks != _NONE)
        heap = (ranks[known].astype(np.int64) * (1 << 32) + known).tolist()
        heapq.heapify(heap)
        part, after, before = part.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, i = divmod(heapq.heappop(heap), 1 << 32)
            j = after[i]
            if part[i] < 0 or j >= n:
                continue
            found = pairs.get(part[i] * width + part[j])
            if found is None or found[0] != rank:
                continue  # the parts have changed since
            part[i], part[j] = found[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n:
                    found = pairs.get(part[left] * width + part[right])
                    if found is not None:
                        heapq.heappush(heap, found[0] * (1 << 32) + left)
        return [p for p in part if p >= 0]

    def _merge_rows(self, data: list[bytes]) -> list[list[int]]:
        """Words of about equal length; -1 in a row of parts stands after its last part."""
        size = np.array([len(d) for d in data])
        width = int(size.max())
        parts = np.full((len(data), width + 1), -1, dtype=np.int64)
        flat = np.frombuffer(b"".join(data), dtype=np.uint8)
        row = np.repeat(np.arange(len(data)), size)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        parts[row, col] = self.byte_id[flat]
        parts[np.arange(len(data)), size - 1] = self.last_id[[d[-1] for d in data]]
        ranks, made = self._ranks(parts[:, :-1], parts[:, 1:])
        done: list[np.ndarray | None] = [None] * len(data)
        alive = np.arange(len(data))
        while len(alive):
            at = ranks.argmin(axis=1)
            here = np.arange(len(alive))
            over = ranks[here, at] == _NONE
            if over.any():
                for k in np.flatnonzero(over):
                    done[alive[k]] = parts[k]
                keep = ~over
                alive, parts, ranks, made, at = alive[keep], parts[keep], ranks[keep], made[keep], at[keep]
                here = np.arange(len(alive))
                if not len(alive):
                    break
            parts[here, at] = made[here, at]
            column = np.arange(parts.shape[1] - 1)
            moved = column[None, :] > at[:, None]  # the boundary right of `at` goes
            parts[:, :-1] = np.where(moved, parts[:, 1:], parts[:, :-1])
            ranks[:, :-1] = np.where(moved[:, :-1], ranks[:, 1:], ranks[:, :-1])
            made[:, :-1] = np.where(moved[:, :-1], made[:, 1:], made[:, :-1])
            parts[:, -1], ranks[:, -1] = -1, _NONE
            ranks[here, at], made[here, at] = self._ranks(parts[here, at], parts[here, at + 1])
            left = at > 0
            i, j = here[left], at[left] - 1
            ranks[i, j], made[i, j] = self._ranks(parts[i, j], parts[i, j + 1])
        return [[x for x in p.tolist() if x >= 0] for p in done]

    def words(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        text = regex.sub(r"\s+", " ", text)
        text = text.lower() if text.isascii() else "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return self.word.findall(text)

    def encode(self, texts: list[str]) -> list[list[str]]:
        """The words of each text, special tokens among them; the cache has an entry for each."""
        found = []
        for text in texts:
            if "<|" in text:
                parts = self.special_at.split(text)
                found.append([w for k, p in enumerate(parts) for w in ([p] if k % 2 else self.words(p))])
            else:
                found.append(self.words(text))
        for w in self.passing:
            self.cache.pop(w, None)
        if len(self.cache) > CACHE:
            self.cache = {}
        new = list(set().union(*found).difference(self.cache))
        self.passing = [w for w in new if len(w) > SHORT]
        for w, ids in zip(new, self.merge(new), strict=True):
            ids = [self.special[w]] if w in self.special else ids
            self.cache[w] = (len(ids), " ".join(map(str, ids)), " ".join(self.tokens[i] for i in ids))
        return found

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder: tokens are joined by spaces, special ones too."""
        return " ".join(self.tokens[i] for i in ids)


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself, or one from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def rank_bpe(path: str) -> RankBpe:
    """The worker's encoder for the tokenizer file at `path`."""
    if path not in _encoders:
        _encoders[path] = RankBpe(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encode_step(path: str, full: bool):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = rank_bpe(path)
        for batch in batches:
            doc_id, texts = batch.column(0), batch.column(1).to_pylist()
            for i, j in slices(texts):
                n, ids, decoded = [], [], []
                for words in bpe.encode(texts[i:j]):
                    entries = list(map(bpe.cache.__getitem__, words))
                    n.append(sum(e[0] for e in entries))
                    ids.append(" ".join([e[1] for e in entries]))
                    decoded.append(" ".join([e[2] for e in entries]))
                head = [doc_id.slice(i, j - i), pa.array(n, pa.int64())]
                if full:
                    yield pa.RecordBatch.from_arrays([*head, pa.array([[int(x) for x in s.split()] for s in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])
                else:
                    digest = [pa.array([hashlib.sha256(s.encode()).hexdigest() for s in x]) for x in (ids, decoded)]
                    yield pa.RecordBatch.from_arrays([*head, *digest], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return step


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def encode_decode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of each whole text.

    Null text is empty: no ids, and the empty string decoded. Null doc_ids and repeated rows stay;
    further columns, of whatever name, aren't read; an empty table gives no rows. No row needs
    another, so nothing is shuffled.
    """
    return _texts(docs).mapInArrow(_encode_step(tokenizer or default_path(), True), "doc_id long, n_tokens long, ids array<int>, decoded string")


def op4_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of encode_decode(), taken where the ids are made."""
    return _texts(table(spark, sf_dir, "documents")).mapInArrow(_encode_step(default_path(), False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
