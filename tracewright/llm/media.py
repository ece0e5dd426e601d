"""AVI motion-JPEG columns: storing bytes as frames, reading RIFF indexes, decoding intra frames and
cutting shots where the luma histogram changes more than its recent history explains.

Payload bytes are stored losslessly as the format's own unit, the quantised DCT coefficient.  A
byte v becomes a coefficient of size category 8 (v itself from 128 on, v - 255 below), whose
additional bits are exactly v's eight bits.  With a Huffman table of one code (``0`` for run 0 and
size 8), a restart after every block and no quantisation, a block of 64 bytes takes 72 bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.arrow import map_pieces

FPS = 25
SIDE = 32
BLOCKS = (SIDE // 8) ** 2
FRAME_BYTES = BLOCKS * 64
BINS = 16


def _zigzag() -> np.ndarray:
    """Natural (row-major) index of each zigzag position."""
    order = sorted(((u, v) for u in range(8) for v in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([u * 8 + v for u, v in order])


ZIGZAG = _zigzag()


def _basis() -> np.ndarray:
    """Inverse DCT of zigzag coefficients to row-major pixels, scaled by 4096 and rounded to
    integers: sums of 64 products of up to 8 + 10 bits stay below 2^24, so that single precision
    holds them exactly in any order of summation."""
    k = np.arange(8)
    c = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)
    full = np.einsum("xu,yv->uvxy", c, c).reshape(64, 64)
    return np.rint(full[ZIGZAG] * 4096)


BASIS = _basis()


# --- writing ---------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


FRAME_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\x00" + b"\x01" * 64)
    + _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\x01\x11\x00")
    + _segment(0xC4, b"\x00" + b"\x01" + b"\x00" * 15 + b"\x08")
    + _segment(0xC4, b"\x10" + b"\x01" + b"\x00" * 15 + b"\x08")
    + _segment(0xDD, struct.pack(">H", 1))
    + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS, extra: bytes = b"") -> bytes:
    """An AVI file with one motion-JPEG stream; ``extra`` is kept as the stream's data chunk."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + (_chunk(b"strd", extra) if extra else b""))
    movi, index, at = [], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    body = b"AVI " + _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl) + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def store(payloads: list[bytes]) -> list[bytes]:
    """One AVI file per payload; its length goes to the stream's data chunk, the last frame is
    filled with zeros."""
    n_frames = [-(-len(p) // FRAME_BYTES) for p in payloads]
    raw = np.frombuffer(b"".join(p.ljust(n * FRAME_BYTES, b"\x00") for p, n in zip(payloads, n_frames, strict=True)), np.uint8).reshape(-1, 64)
    bits = np.zeros((len(raw), 64, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(raw, axis=1).reshape(len(raw), 64, 8)
    coded = np.empty((len(raw), 74), np.uint8)
    coded[:, :72] = np.packbits(bits.reshape(len(raw), 576), axis=1)
    in_frame = np.arange(len(raw)) % BLOCKS
    coded[:, 72] = 0xFF
    coded[:, 73] = np.where(in_frame == BLOCKS - 1, 0xD9, 0xD0 + in_frame % 8)
    stuffed = coded == 0xFF
    stuffed[:, 72] = False
    times = stuffed.ravel() + 1
    flat = np.repeat(coded.ravel(), times)
    ends = np.cumsum(times)
    flat[ends[stuffed.ravel()] - 1] = 0
    cuts = ends[np.arange(1, len(raw) // BLOCKS + 1) * BLOCKS * 74 - 1].tolist()
    scans, out, frame, start = flat.tobytes(), [], 0, 0
    for p, n in zip(payloads, n_frames, strict=True):
        frames = []
        for _ in range(n):
            frames.append(FRAME_HEAD + scans[start : cuts[frame]])
            start, frame = cuts[frame], frame + 1
        out.append(write_avi(frames, SIDE, SIDE, extra=struct.pack("<Q", len(p))))
    return out


# --- reading ---------------------------------------------------------------------------------------


@dataclass
class Video:
    width: int
    height: int
    fps: float
    frames: list[bytes]
    extra: bytes


def read_avi(data: bytes) -> Video:
    """Frames of the first video stream, found through the legacy index (positions from the start
    of the frame list or of the file), else through an OpenDML super index, else by walking the
    frame list."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict[str, object] = {"frames": [], "extra": b"", "fps": float(FPS), "w": 0, "h": 0, "movi": None, "idx": None, "ix": []}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            body = at + 8
            if name in (b"LIST", b"RIFF"):
                kind = data[body : body + 4]
                if kind == b"movi":
                    found["movi"] = found["movi"] or (body, min(end, body + size))
                else:
                    walk(body + 4, min(end, body + size))
            elif name == b"avih":
                found["w"], found["h"] = struct.unpack_from("<II", data, body + 32)
            elif name == b"strh" and data[body : body + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", data, body + 20)
                found["fps"] = rate / scale if scale else float(FPS)
            elif name == b"strd":
                found["extra"] = data[body : body + size]
            elif name == b"indx":
                count = int.from_bytes(data[body + 4 : body + 8], "little")
                found["ix"] = [struct.unpack_from("<Q", data, body + 24 + 16 * i)[0] for i in range(count)]
            elif name == b"idx1":
                found["idx"] = (body, size)
            at = body + size + (size & 1)

    walk(0, len(data))
    frames = []
    if found["idx"]:
        at, size = found["idx"]
        base = found["movi"][0] if found["movi"] else 0
        for i in range(size // 16):
            name, _, offset, length = struct.unpack_from("<4sIII", data, at + 16 * i)
            if name[2:] in (b"dc", b"db"):
                start = base + offset
                if data[start : start + 4] != name:
                    start = offset
                frames.append(data[start + 8 : start + 8 + length])
    elif found["ix"]:
        for at in found["ix"]:
            count = int.from_bytes(data[at + 12 : at + 16], "little")
            base = int.from_bytes(data[at + 20 : at + 28], "little")
            for i in range(count):
                offset, length = struct.unpack_from("<II", data, at + 32 + 8 * i)
                frames.append(data[base + offset : base + offset + (length & 0x7FFFFFFF)])
    elif found["movi"]:
        at, end = found["movi"][0] + 4, found["movi"][1]
        while at + 8 <= end:
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if name[2:] in (b"dc", b"db"):
                frames.append(data[at + 8 : at + 8 + size])
            at += 8 + size + (size & 1)
    return Video(found["w"], found["h"], found["fps"], frames, found["extra"])


@dataclass(frozen=True)
class Head:
    """What the segments before a scan say."""

    width: int
    height: int
    parts: tuple[tuple[int, int, int, int, int, int], ...]  # id, h, v, quantiser, dc table, ac table
    quant: tuple[tuple[int, tuple[int, ...]], ...]
    tables: tuple[tuple[int, tuple[tuple[int, int, int], ...]], ...]  # class and id -> (length, code, symbol)
    restart: int

    @property
    def one_code(self) -> bool:
        """Whether every coefficient takes nine bits: one component, one code, size 8 in both tables."""
        return len(self.parts) == 1 and self.restart == 1 and len(self.tables) > 0 and all(t == ((1, 0, 8),) for _, t in self.tables)


@lru_cache(maxsize=256)
def read_head(head: bytes) -> Head:
    at, width, height, parts, quant, tables, restart, scan = 2, 0, 0, [], {}, {}, 0, {}
    while at < len(head):
        marker, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        body = head[at + 4 : at + 2 + size]
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide, k = body[i] >> 4, body[i] & 15
                step = 2 if wide else 1
                quant[k] = tuple(int.from_bytes(body[i + 1 + step * j : i + 1 + step * (j + 1)], "big") for j in range(64))
                i += 1 + 64 * step
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("only 8-bit frames are supported")
            height, width = struct.unpack(">HH", body[1:5])
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are supported")
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                key, counts = body[i], body[i + 1 : i + 17]
                symbols, code, rows, j = body[i + 17 : i + 17 + sum(counts)], 0, [], 0
                for length, n in enumerate(counts, 1):
                    for _ in range(n):
                        rows.append((length, code, symbols[j]))
                        code, j = code + 1, j + 1
                    code <<= 1
                tables[key] = tuple(rows)
                i += 17 + sum(counts)
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            scan = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
        at += 2 + size
    return Head(width, height, tuple((*p, *scan[p[0]]) for p in parts), tuple(sorted(quant.items())), tuple(sorted(tables.items())), restart)


def split_frame(frame: bytes) -> tuple[Head, int]:
    """A frame's head and where its entropy-coded data begin."""
    if frame.startswith(FRAME_HEAD):
        return read_head(FRAME_HEAD), len(FRAME_HEAD)
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at = 2
    while True:
        marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        at += 2 + size
        if marker == 0xDA:
            return read_head(frame[:at]), at


def _unstuff(scan: np.ndarray) -> np.ndarray:
    """Entropy-coded bytes without stuffing and markers."""
    escape = scan[:-1] == 0xFF
    keep = np.ones(len(scan), bool)
    keep[1:][escape] = False
    keep[:-1][escape & (scan[1:] != 0)] = False
    return scan[keep]


def coefficients(frame: bytes) -> tuple[Head, list[np.ndarray]]:
    """Quantised coefficients of any baseline frame: per component an array of its blocks (in scan
    order) by 64 zigzag positions."""
    head, at = split_frame(frame)
    if head.one_code:
        return head, [_one_code(np.frombuffer(frame, np.uint8)[at:])]
    look = {k: {(n, c): s for n, c, s in rows} for k, rows in head.tables}
    h_max, v_max = max(p[1] for p in head.parts), max(p[2] for p in head.parts)
    mcus = -(-head.width // (8 * h_max)) * -(-head.height // (8 * v_max))
    if len(head.parts) == 1:
        mcus = -(-head.width // 8) * -(-head.height // 8)
    out: list[list[list[int]]] = [[] for _ in head.parts]
    segments = _segments(frame[at:])
    done = 0
    for raw in segments:
        bits, pos = np.unpackbits(np.frombuffer(raw, np.uint8)).tolist(), 0

        def symbol(table: dict, bits=bits) -> int:
            nonlocal pos
            code = 0
            for n in range(1, 17):
                code = code << 1 | bits[pos]
                pos += 1
                if (n, code) in table:
                    return table[n, code]
            raise ValueError("bad Huffman code")

        def value(size: int, bits=bits) -> int:
            nonlocal pos
            v = 0
            for b in bits[pos : pos + size]:
                v = v << 1 | b
            pos += size
            return v if size == 0 or v >> (size - 1) else v - (1 << size) + 1

        predicted = [0] * len(head.parts)
        for _ in range(min(head.restart or mcus, mcus - done)):
            done += 1
            for c, (_, h, v, _, dc, ac) in enumerate(head.parts):
                for _ in range(1 if len(head.parts) == 1 else h * v):
                    block = [0] * 64
                    predicted[c] += value(symbol(look[dc]))
                    block[0], k = predicted[c], 1
                    while k < 64:
                        s = symbol(look[0x10 | ac])
                        if s == 0:
                            break
                        k += s >> 4
                        if s != 0xF0:
                            block[k] = value(s & 15)
                        k += 1
                    out[c].append(block)
    return head, [np.array(x, np.int64).reshape(-1, 64) for x in out]


def _segments(scan: bytes) -> list[bytes]:
    """The stretches between restart markers, without stuffing."""
    out, at, start = [], 0, 0
    while True:
        at = scan.find(b"\xff", at)
        if at < 0 or at + 1 >= len(scan):
            out.append(scan[start:])
            break
        if scan[at + 1] == 0:
            at += 2
        elif 0xD0 <= scan[at + 1] <= 0xD7:
            out.append(scan[start:at])
            at += 2
            start = at
        else:
            out.append(scan[start:at])
            break
    return [x.replace(b"\xff\x00", b"\xff") for x in out]


def _one_code(scan: np.ndarray) -> np.ndarray:
    """All blocks of scans in which every coefficient takes a zero bit and eight value bits."""
    return _as_coefficients(_one_code_bytes(scan))


def _one_code_bytes(scan: np.ndarray) -> np.ndarray:
    plain = _unstuff(scan).reshape(-1, 72)
    bits = np.unpackbits(plain, axis=1).reshape(len(plain), 64, 9)
    if bits[:, :, 0].any():
        raise ValueError("bad Huffman code")
    return np.packbits(np.ascontiguousarray(bits[:, :, 1:]).reshape(len(plain), 512), axis=1)


def _as_coefficients(v: np.ndarray) -> np.ndarray:
    signed = v.astype(np.int16)
    return np.where(signed >= 128, signed, signed - 255)


def luma(head: Head, blocks: np.ndarray) -> np.ndarray:
    """Pixels (blocks by 64) of a component's blocks: dequantised, transformed, rounded, clipped."""
    part = head.parts[0]
    quant = np.array(dict(head.quant)[part[3]], np.int64)
    small = int(quant.max()) == 1 and abs(blocks).max(initial=0) <= 255
    kind = np.float32 if small else np.float64
    sums = (blocks * quant).astype(kind) @ BASIS.astype(kind)
    return np.clip(np.floor((sums + 2048) / 4096) + 128, 0, 255).astype(np.uint8)


def histograms(video: Video) -> np.ndarray:
    """Luma histogram of every frame, frames by ``BINS``."""
    out = np.zeros((len(video.frames), BINS), np.int64)
    for i, f in enumerate(video.frames):
        head, parts = coefficients(f)
        out[i] = np.bincount(luma(head, parts[0]).ravel() >> 4, minlength=BINS)
    return out


def shots(hist: np.ndarray, window: int = 8, factor: float = 2.0, least: float = 0.15) -> list[tuple[int, int]]:
    """Clips as (first, last) frame. A cut falls before a frame whose histogram difference from the
    frame before (half the summed change, as a share of its pixels) is at least ``least`` and
    above the mean plus ``factor`` deviations of up to ``window`` differences before it in the clip."""
    if not len(hist):
        return []
    share = hist / np.maximum(1, hist.sum(axis=1, keepdims=True))
    change = np.abs(np.diff(share, axis=0)).sum(axis=1) / 2
    out, first = [], 0
    for i, d in enumerate(change.tolist(), 1):
        past = change[max(first, i - 1 - window) : i - 1]
        limit = past.mean() + factor * past.std() if len(past) else 0.5
        if d >= least and d > limit:
            out.append((first, i - 1))
            first = i
    return [*out, (first, len(hist) - 1)]


def clip_rows(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Timed clips of a column of AVI files: id, clip, first_frame, last_frame, start_s, end_s. Null
    and empty media have no clips."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for key, data in zip(batch.column("id").to_pylist(), batch.column("media").to_pylist(), strict=True):
            if data:
                video = read_avi(data)
                rows += [(key, k, a, b, a / video.fps, (b + 1) / video.fps) for k, (a, b) in enumerate(shots(histograms(video)))]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [batch.schema.field("id").type, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "clip", "first_frame", "last_frame", "start_s", "end_s"])

    kind = media.schema[id_col].dataType.simpleString()
    return map_pieces(media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")), kernel, f"id {kind}, clip int, first_frame int, last_frame int, start_s double, end_s double", "media")


def as_payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\x00")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores whole texts as AVI files and reads them back: doc_id, media (the file), n_bytes,
    payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (frame size and
    rate, clips and the histogram over all frames).

    Null and empty texts give 64 zero bytes; equal texts give equal values; repeated rows get one
    result each; an empty table gives an empty result; other columns are ignored. A very long text is
    one file: n bytes take up to some 100 n bytes of a worker's memory. Ties do not occur: nothing is ordered.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [as_payload(t) for t in batch.column("text").to_pylist()]
        files = store([p for _, p in made])
        videos = [read_avi(f) for f in files]
        scans = np.frombuffer(b"".join(f[split_frame(f)[1] :] for v in videos for f in v.frames), np.uint8)
        blocks = _one_code_bytes(scans)
        pixels = luma(read_head(FRAME_HEAD), _as_coefficients(blocks))
        frame_of = np.repeat(np.arange(len(pixels) // BLOCKS), FRAME_BYTES)
        hist = np.bincount(frame_of * BINS + (pixels.ravel() >> 4), minlength=len(pixels) // BLOCKS * BINS).reshape(-1, BINS)
        raw, at, rows = blocks.tobytes(), 0, []
        for (n, _), file, video in zip(made, files, videos, strict=True):
            back = raw[at * FRAME_BYTES : at * FRAME_BYTES + struct.unpack("<Q", video.extra)[0]]
            own = hist[at : at + len(video.frames)]
            at += len(video.frames)
            clips = ",".join(f"{a / video.fps:.2f}-{(b + 1) / video.fps:.2f}" for a, b in shots(own))
            feature = f"{video.width}x{video.height}@{video.fps:g};frames={len(own)};clips={clips};luma={'.'.join(map(str, own.sum(axis=0).tolist()))}"
            rows.append((file, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature))
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["media", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], ["doc_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, media binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_pieces(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), kernel, schema)
