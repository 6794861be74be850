"""AVI files of motion JPEG with lossless intra frames, and clips between detected shots."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import slices, table

WIDTH, HEIGHT, FPS = 64, 16, 25
#: Bits of the Huffman codes of difference categories 0 to 8; with the extra bits, 13 at most.
LENGTHS = (5, 4, 3, 3, 3, 3, 3, 3, 3)
WINDOW = 13
#: A shot begins where a difference exceeds the local mean by so many deviations, and this share.
DEVIATIONS, LEAST_CHANGE, AROUND = 2.5, 0.15, 8


def _codes(lengths: tuple[int, ...]) -> list[int]:
    """Canonical Huffman codes: shorter first, then by category."""
    codes, code, last = [0] * len(lengths), 0, 0
    for k in sorted(range(len(lengths)), key=lambda k: (lengths[k], k)):
        code <<= lengths[k] - last
        codes[k], last = code, lengths[k]
        code += 1
    return codes


def _encode_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bits (13 columns, the first ones used) and their number for each difference -255 to 255."""
    codes = _codes(LENGTHS)
    bits, n = np.zeros((511, WINDOW), bool), np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        value = (codes[s] << s) | (d if d >= 0 else d + (1 << s) - 1)
        n[d + 255] = LENGTHS[s] + s
        bits[d + 255, : n[d + 255]] = [int(x) for x in f"{value:0{n[d + 255]}b}"]
    return bits, n


_BITS, _SIZE = _encode_tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_head() -> bytes:
    by_length = [sum(x == n for x in LENGTHS) for n in range(1, 17)]
    order = sorted(range(len(LENGTHS)), key=lambda k: (LENGTHS[k], k))
    return b"\xff\xd8" + _segment(0xC4, bytes([0, *by_length, *order])) + _segment(0xC3, struct.pack(">BHHBBBB", 8, HEIGHT, WIDTH, 1, 1, 0x11, 0)) + _segment(0xDD, struct.pack(">H", WIDTH)) + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))


HEAD = _frame_head()


def jpeg_frames(frames: np.ndarray) -> list[bytes]:
    """Lossless JPEG (process 14, predictor left) of each of the (n, HEIGHT, WIDTH) samples.

    Every row is a restart interval, so rows are coded, and later decoded, side by side.
    """
    n = len(frames)
    rows = frames.reshape(n * HEIGHT, WIDTH).astype(np.int64)
    d = np.diff(rows, axis=1, prepend=128) + 255
    size = _SIZE[d]
    used = size.sum(axis=1)
    fill = -used % 8
    mask = np.arange(WINDOW)[None, None, :] < size[:, :, None]
    bits = np.concatenate((_BITS[d].reshape(len(rows), -1), np.ones((len(rows), 7), bool)), axis=1)
    mask = np.concatenate((mask.reshape(len(rows), -1), np.arange(7)[None, :] < fill[:, None]), axis=1)
    data = np.packbits(bits[mask])
    ends = np.cumsum((used + fill) // 8)
    stuffed = data == 0xFF  # each 255 is followed by a 0
    marker = np.zeros(len(data), np.int64)
    marker[ends - 1] = 2  # and each row by a restart marker, a frame by its end
    room = 1 + stuffed + marker
    at = np.cumsum(room) - room
    out = np.zeros(int(room.sum()), np.uint8)
    out[at] = data
    last = at[ends - 1] + 1 + stuffed[ends - 1]
    out[last] = 0xFF
    code = 0xD0 + np.arange(len(rows)) % HEIGHT % 8
    code[HEIGHT - 1 :: HEIGHT] = 0xD9
    out[last + 1] = code
    cuts = np.concatenate(([0], last[HEIGHT - 1 :: HEIGHT] + 2))
    raw = out.tobytes()
    return [HEAD + raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi(frames: list[bytes], payload_bytes: int) -> bytes:
    """An AVI file with an index; its comment keeps the number of payload samples."""
    largest = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, WIDTH, HEIGHT, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", WIDTH * HEIGHT, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form))
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + strl) + _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d\0" % payload_bytes))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def parse_avi(media: bytes) -> tuple[list[bytes], int]:
    """The frames, by the file's index, and the number of payload samples."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end, movi, index, payload = 12, 8 + struct.unpack_from("<I", media, 4)[0], None, b"", None
    while at + 8 <= end:
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        kind = media[at + 8 : at + 12] if name == b"LIST" else b""
        if kind == b"movi":
            movi = at + 8
        elif kind == b"INFO":
            text = media[at + 12 : at + 8 + size]
            payload = int(text[text.index(b"payload=") + 8 :].split(b"\0")[0])
        elif name == b"idx1":
            index = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if movi is None or payload is None:
        raise ValueError("no movi list or no payload comment")
    frames = [media[movi + o + 8 : movi + o + 8 + n] for tag, _, o, n in struct.iter_unpack("<4sIII", index) if tag == b"00dc"]
    return frames, payload


def _decode_table(head: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Bits used and difference for each window of 13 bits, and the length of the frame's head."""
    at, lengths, found = 2, {}, None
    while head[at + 1] != 0xDA:
        marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        if marker == 0xC4:
            symbols = iter(body[17:])
            lengths = {next(symbols): n + 1 for n in range(16) for _ in range(body[1 + n])}
        elif marker == 0xC3:
            found = struct.unpack(">BHH", body[:5])
        elif marker == 0xDD and struct.unpack(">H", body)[0] != WIDTH:
            raise ValueError("not a restart at every row")
        at += 2 + size
    if found != (8, HEIGHT, WIDTH) or not lengths:
        raise ValueError("not a lossless frame of the expected size")
    at += 2 + struct.unpack_from(">H", head, at + 2)[0]
    order = tuple(lengths[k] for k in range(len(lengths)))
    used, diff = np.zeros(1 << WINDOW, np.int64), np.zeros(1 << WINDOW, np.int64)
    for s, code in enumerate(_codes(order)):
        for extra in range(1 << s):
            n = order[s] + s
            a = ((code << s) | extra) << (WINDOW - n)
            used[a : a + (1 << (WINDOW - n))] = n
            diff[a : a + (1 << (WINDOW - n))] = extra if s == 0 or extra >> (s - 1) else extra - (1 << s) + 1
    return used, diff, at


_tables: dict[bytes, tuple[np.ndarray, np.ndarray, int]] = {}


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """The (n, HEIGHT, WIDTH) samples of the frames; all rows are decoded side by side."""
    if not frames:
        return np.zeros((0, HEIGHT, WIDTH), np.uint8)
    head = frames[0][: frames[0].index(b"\xff\xda") + 10]
    if head not in _tables:
        _tables[head] = _decode_table(head)
    used, diff, skip = _tables[head]
    if any(f[:skip] != head[:skip] or f[-2:] != b"\xff\xd9" for f in frames):
        raise ValueError("a frame with another head, or cut short")
    raw = np.frombuffer(b"".join([f[skip:] for f in frames]), np.uint8)
    after = np.concatenate((raw[1:], [0]))
    zero = np.concatenate(([False], (raw == 0xFF)[:-1] & (raw[1:] == 0)))
    mark = (raw == 0xFF) & (after >= 0xD0)
    gone = zero | mark | np.concatenate(([False], mark[:-1]))
    data = np.concatenate((raw[~gone], np.zeros(4, np.uint8))).astype(np.int64)
    ends = (np.cumsum(~gone))[mark]
    bit = np.concatenate(([0], ends[:-1])) * 8
    word = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    out = np.empty((WIDTH, len(bit)), np.int64)
    for k in range(WIDTH):
        v = (word[bit >> 3] >> (24 - WINDOW - (bit & 7))) & ((1 << WINDOW) - 1)
        out[k] = diff[v]
        bit = bit + used[v]
    samples = (128 + np.cumsum(out, axis=0)) & 0xFF
    return np.ascontiguousarray(samples.T).astype(np.uint8).reshape(len(frames), HEIGHT, WIDTH)


def clips(frames: np.ndarray) -> list[tuple[int, int]]:
    """First and last frame of each shot.

    The difference of two neighbouring frames is half the sum of absolute differences of their
    16-bin histograms, as a share of the samples. A shot begins where it exceeds LEAST_CHANGE and
    the mean plus DEVIATIONS deviations of the AROUND differences before it. The first difference
    has none before it and is judged by LEAST_CHANGE alone; if it is a cut, later means leave it
    out, and so the second is judged like the first.
    """
    n = len(frames)
    bins = np.bincount((np.arange(n)[:, None] * 16 + (frames.reshape(n, -1) >> 4)).ravel(), minlength=n * 16).reshape(n, 16)
    change = np.abs(np.diff(bins, axis=0)).sum(axis=1) / (2 * WIDTH * HEIGHT)
    c1, c2 = np.concatenate(([0], np.cumsum(change))), np.concatenate(([0], np.cumsum(change**2)))
    i = np.arange(len(change))
    a = np.maximum(int(n > 1 and change[0] > LEAST_CHANGE), i - AROUND)
    before = np.maximum(1, i - a)
    mean = (c1[i] - c1[a]) / before
    sd = np.sqrt(np.maximum(0, (c2[i] - c2[a]) / before - mean**2))
    limit = np.where(i > a, mean + DEVIATIONS * sd + 1e-9, LEAST_CHANGE)
    starts = [0, *(np.flatnonzero((change > LEAST_CHANGE) & (change > limit)) + 1).tolist()]
    return [(x, y - 1) for x, y in zip(starts, [*starts[1:], n], strict=True)]


def _encode_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc_id, texts = batch.column(0), batch.column(1).to_pylist()
        for i, j in slices(texts, 250_000):
            raw = [t.encode() for t in texts[i:j]]
            size = [len(r) + (-len(r) % 64 or (0 if r else 64)) for r in raw]
            per = [-(-s // (WIDTH * HEIGHT)) for s in size]
            joined = b"".join(r.ljust(p * WIDTH * HEIGHT, b"\0") for r, p in zip(raw, per, strict=True))
            frames = jpeg_frames(np.frombuffer(joined, np.uint8).reshape(-1, HEIGHT, WIDTH))
            ends = np.cumsum(per).tolist()
            media = [avi(frames[e - p : e], s) for e, p, s in zip(ends, per, size, strict=True)]
            yield pa.RecordBatch.from_arrays([doc_id.slice(i, j - i), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _decoded(media: list[bytes]) -> Iterator[tuple[bytes, bytes, list[tuple[int, int]]]]:
    """Each file with its payload and its clips."""
    parsed = [parse_avi(m) for m in media]
    samples = decode_frames([f for frames, _ in parsed for f in frames])
    at = 0
    for m, (frames, payload) in zip(media, parsed, strict=True):
        own = samples[at : at + len(frames)]
        at += len(frames)
        yield m, own.tobytes()[:payload], clips(own)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        media = batch.column("media").to_pylist()
        for i, j in slices(media, 400_000):
            yield batch.slice(i, j - i), media[i:j]


def _feature_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch, media in _small(batches):
        rows = [(len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), f"{WIDTH}x{HEIGHT}@{FPS};frames={c[-1][1] + 1};clips=" + ",".join(f"{a / FPS:.2f}-{(b + 1) / FPS:.2f}" for a, b in c)) for m, p, c in _decoded(media)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(list(x)) for x in zip(*rows, strict=True))], ["doc_id", "n_bytes", *names])


def _clip_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, media in _small(batches):
        rows = [(d, k, a, b, a / FPS, (b + 1) / FPS) for d, (_, _, c) in zip(batch.column("doc_id").to_pylist(), _decoded(media), strict=True) for k, (a, b) in enumerate(c)]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "clip", "first_frame", "last_frame", "start_s", "end_s"])


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the UTF-8 bytes of each whole text as an AVI file.

    The bytes are padded with 0 to a positive multiple of 64, and to whole frames in the file. Null
    text is empty; null doc_ids and repeated rows stay; an empty table gives no rows. A text of a
    few MB takes some ten times its size in memory.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(_encode_step, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Digests of the payload that is read back, of the file, and the timed clips as `feature`."""
    return media.mapInArrow(_feature_step, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def clip_rows(media: DataFrame) -> DataFrame:
    """A row for each shot: doc_id, clip, first_frame, last_frame, start_s, end_s."""
    return media.mapInArrow(_clip_step, "doc_id long, clip int, first_frame int, last_frame int, start_s double, end_s double")


def op8_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_features() of store_media() of all documents; see there for awkward rows."""
    return media_features(store_media(table(spark, sf_dir, "documents")))
