import hashlib
import struct
import zlib

import numpy as np

from tracewright.llm import media


def bits_to_scan(bits: str) -> bytes:
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def dc_frame(levels: list[int], side: int, quant: int = 8) -> bytes:
    """A baseline frame of flat blocks by an ordinary Huffman table, without restarts."""
    table = b"\x00" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))
    bits, last = "", 0
    for v in levels:
        d, last = v - last, v
        size = abs(d).bit_length()
        bits += f"{size:04b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "") + "0"
    return (
        b"\xff\xd8" + media._segment(0xDB, b"\x00" + bytes([quant] * 64)) + media._segment(0xC0, struct.pack(">BHHB", 8, side, side, 1) + b"\x01\x11\x00")
        + media._segment(0xC4, table) + media._segment(0xC4, b"\x10" + b"\x01" + b"\x00" * 15 + b"\x00")
        + media._segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + bits_to_scan(bits) + b"\xff\xd9"
    )


def test_payloads_come_back():
    rng = np.random.default_rng(1)
    payloads = [bytes(64), b"\xff" * 640, rng.integers(0, 256, 64 * 50, np.uint8).tobytes()]
    for p, f in zip(payloads, media.store(payloads), strict=True):
        video = media.read_avi(f)
        assert (video.width, video.height, video.fps) == (32, 32, 25.0)
        got = b"".join(media._one_code_bytes(np.frombuffer(x, np.uint8)[media.split_frame(x)[1] :]).tobytes() for x in video.frames)
        assert got[: struct.unpack("<Q", video.extra)[0]] == p


def test_fast_and_general_decoders_agree():
    p = np.random.default_rng(2).integers(0, 256, 2048, np.uint8).tobytes()
    frame = media.read_avi(media.store([p])[0]).frames[0]
    head, fast = media.coefficients(frame)
    general = frame.replace(media._segment(0xC4, b"\x10\x01" + b"\x00" * 15 + b"\x08"), media._segment(0xC4, b"\x10\x01\x01" + b"\x00" * 14 + b"\x08\x00"))
    other, slow = media.coefficients(general)
    assert head.one_code and not other.one_code
    assert (fast[0] == slow[0]).all()


def test_transform_against_the_definition():
    rng = np.random.default_rng(3)
    zig = rng.integers(-60, 60, (5, 64))
    natural = np.zeros((5, 64))
    natural[:, media.ZIGZAG] = zig
    k = np.arange(8)
    c = np.where(k == 0, np.sqrt(0.125), 0.5)
    want = np.einsum("nuv,u,v,ux,vy->nxy", natural.reshape(5, 8, 8), c, c, np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16), np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16)).reshape(5, 64)
    assert abs(media.luma(media.read_head(media.FRAME_HEAD), zig).astype(int) - np.clip(np.rint(want + 128), 0, 255)).max() <= 1


def test_shots_of_flat_frames(spark):
    dark, light = [-60] * 16, [60] * 16
    file = media.write_avi([dc_frame(dark, 32)] * 5 + [dc_frame(light, 32)] * 7 + [dc_frame(dark, 32)] * 4, 32, 32, fps=10)
    video = media.read_avi(file)
    assert len(video.frames) == 16 and video.fps == 10
    assert media.shots(media.histograms(video)) == [(0, 4), (5, 11), (12, 15)]
    walked = media.read_avi(file[: file.rindex(b"idx1")])
    assert walked.frames == video.frames
    df = spark.createDataFrame([(1, file), (2, None), (3, b"")], "doc_id long, media binary")
    got = media.clip_rows(df).orderBy("clip").collect()
    assert [(r.id, r.first_frame, r.last_frame, r.start_s, r.end_s) for r in got] == [(1, 0, 4, 0.0, 0.5), (1, 5, 11, 0.5, 1.2), (1, 12, 15, 1.2, 1.6)]


def test_query_rows(spark):
    rows = [(1, "the cat"), (2, None), (3, ""), (4, "é" * 20000), (5, "the cat"), (None, "x" * 64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS media", "2 AS n_bytes")
    got = {r.doc_id: r for r in media.text_media(docs).collect()}
    for key, text in rows:
        raw = (text or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got[key]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:]) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
    assert got[1].feature == got[5].feature and got[1].media == got[5].media
    assert media.text_media(docs.limit(0)).count() == 0


def test_feature_equals_frames_one_by_one(spark):
    """The feature of many files decoded at once against each file's frames decoded alone, and pixel by pixel."""
    texts = ["", "short", "word " * 3000, "\x00\x7fé" * 900]
    for r in media.text_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        video = media.read_avi(r.media)
        hist = np.zeros((len(video.frames), media.BINS), int)
        for i, frame in enumerate(video.frames):
            head, parts = media.coefficients(frame)
            for value in media.luma(head, parts[0]).ravel().tolist():
                hist[i, value * media.BINS // 256] += 1
        clips = ",".join(f"{a / video.fps:.2f}-{(b + 1) / video.fps:.2f}" for a, b in media.shots(hist))
        assert r.feature == f"{video.width}x{video.height}@{video.fps:g};frames={len(hist)};clips={clips};luma={'.'.join(str(int(x)) for x in hist.sum(axis=0))}"
