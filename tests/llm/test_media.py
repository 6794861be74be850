import hashlib
import zlib

import numpy as np
import pytest

from plumbline.llm import media as M


def test_lossless_frames():
    rng = np.random.default_rng(0)
    for frames in (rng.integers(0, 256, (7, 16, 64)), np.full((3, 16, 64), 255), rng.choice([0, 255], (4, 16, 64)), np.zeros((1, 16, 64))):
        frames = frames.astype(np.uint8)
        assert (M.decode_frames(M.jpeg_frames(frames)) == frames).all()


def test_container():
    frames = M.jpeg_frames(np.arange(4 * 1024, dtype=np.uint8).reshape(4, 16, 64))
    found, payload = M.parse_avi(M.avi(frames, 3904))
    assert found == frames and payload == 3904
    with pytest.raises(ValueError):
        M.parse_avi(b"RIFF....WAVE")


def test_shots_are_found():
    dark, light = np.zeros((6, 16, 64), np.uint8), np.full((5, 16, 64), 200, np.uint8)
    assert M.clips(np.concatenate((dark, light, dark))) == [(0, 5), (6, 10), (11, 16)]
    assert M.clips(dark) == [(0, 5)] and M.clips(dark[:1]) == [(0, 0)]


def test_query_and_awkward(spark, awkward, nothing, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    for df, got in ((docs, M.op8_avi_mjpeg(spark, small)), (awkward, M.media_features(M.store_media(awkward)))):
        rows = got.collect()
        assert len(rows) == df.count()
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        for r in rows:
            raw = texts[r.doc_id].encode()
            padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    same = [r for r in M.media_features(M.store_media(awkward)).collect() if r.doc_id in (0, 3, None)]
    assert len({(r.media_sha256, r.feature) for r in same}) == 1
    clips = M.clip_rows(M.store_media(docs)).collect()
    assert {c.doc_id for c in clips} == set(r.doc_id for r in docs.collect()) and all(c.end_s > c.start_s for c in clips)
    assert M.media_features(M.store_media(nothing)).count() == 0


def test_cuts_after_the_first_frame():
    dark, light = (np.full((1, M.HEIGHT, M.WIDTH), v, np.uint8) for v in (10, 200))
    assert M.clips(np.concatenate((dark, light))) == [(0, 0), (1, 1)]
    assert M.clips(np.concatenate((dark, dark))) == [(0, 1)]
    assert M.clips(np.concatenate((dark, light, light))) == [(0, 0), (1, 2)]
    assert M.clips(np.concatenate((dark, *[light] * 4, *[dark] * 4))) == [(0, 0), (1, 4), (5, 8)]
    assert M.clips(dark) == [(0, 0)]


def plain_decode(frame):
    """A lossless JPEG (process 14) read bit by bit, from the format's description alone."""
    at, table, interval, lines, across = 2, {}, 0, 0, 0
    while True:
        marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            code, symbols = 0, iter(body[17:])
            for length in range(1, 17):
                for _ in range(body[length]):
                    table[f"{code:0{length}b}"] = next(symbols)
                    code += 1
                code <<= 1
        elif marker == 0xC3:
            assert body[0] == 8 and body[5] == 1
            lines, across = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xDA:
            assert body[3] == 1  # the left sample predicts
            break
    out, row, bits = [], [], ""
    assert interval == across
    while frame[at : at + 2] != b"\xff\xd9":
        bits, start = "", at
        while not (frame[at] == 0xFF and frame[at + 1] != 0):
            bits += f"{frame[at]:08b}"
            at += 2 if frame[at] == 0xFF else 1
        assert at > start
        if frame[at + 1] != 0xD9:
            at += 2
        row, place, before = [], 0, 128
        while len(row) < across:
            length = next(n for n in range(1, 17) if bits[place : place + n] in table)
            category = table[bits[place : place + length]]
            place += length
            extra = int(bits[place : place + category] or "0", 2)
            if category and bits[place] == "0":
                extra -= (1 << category) - 1
            place += category
            before = (before + extra) % 256
            row.append(before)
        assert set(bits[place:]) <= {"1"} and len(bits) - place < 8
        out.append(row)
    assert len(out) == lines
    return out


def plain_file(media):
    """Frames (in file order) and comment of an AVI, walking its chunks and not its index."""
    frames, comment = [], b""

    def walk(at, end):
        nonlocal comment
        while at < end:
            name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
            if name in (b"RIFF", b"LIST"):
                walk(at + 12, at + 8 + size)
            elif name == b"00dc":
                frames.append(media[at + 8 : at + 8 + size])
            elif name == b"ICMT":
                comment = media[at + 8 : at + 8 + size]
            at += 8 + size + size % 2

    walk(0, len(media))
    return frames, int(comment.rstrip(b"\0").split(b"=")[1])


def plain_clips(frames):
    hist = [[sum(v >> 4 == k for v in f) for k in range(16)] for f in frames]
    change = [sum(abs(x - y) for x, y in zip(a, b, strict=True)) / (2 * len(frames[0])) for a, b in zip(hist, hist[1:], strict=False)]
    starts, skip = [0], bool(change) and change[0] > M.LEAST_CHANGE
    for i, c in enumerate(change):
        before = change[max(int(skip), i - M.AROUND) : i]
        if before:
            mean = sum(before) / len(before)
            limit = mean + M.DEVIATIONS * max(0.0, sum(x * x for x in before) / len(before) - mean**2) ** 0.5 + 1e-9
        else:
            limit = M.LEAST_CHANGE
        if c > M.LEAST_CHANGE and c > limit:
            starts.append(i + 1)
    return [(a, b - 1) for a, b in zip(starts, [*starts[1:], len(frames)], strict=True)]


def test_an_independent_decoder_agrees(spark):
    texts = ["", "short", "é" * 700, "plain words " * 400, "~" * 2048 + " " * 3000 + "aZ" * 900, "\u0000\uffff" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    media = {r.doc_id: bytes(r.media) for r in M.store_media(df).collect()}
    for r in M.media_features(M.store_media(df)).collect():
        frames, size = plain_file(media[r.doc_id])
        samples = [sum(plain_decode(f), []) for f in frames]
        raw = texts[r.doc_id].encode()
        assert bytes(sum(samples, []))[:size] == raw + b"\0" * (size - len(raw)) and size % 64 == 0 and 0 <= size - len(raw) <= 64
        shots = ",".join(f"{a / 25:.2f}-{(b + 1) / 25:.2f}" for a, b in plain_clips(samples))
        assert r.feature == f"64x16@25;frames={len(frames)};clips={shots}"
        assert (r.media_bytes, r.media_sha256) == (len(media[r.doc_id]), hashlib.sha256(media[r.doc_id]).hexdigest())
