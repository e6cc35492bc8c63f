"""Media columns: AVI files of motion JPEG, read through their RIFF index, cut into shots.

A payload is stored as 16 x 12 grey frames of lossless JPEG (SOF3, predictor 1). The Huffman table gives
category s a code of 9 - s bits, so that each sample takes nine bits and the frames of a batch are packed and
unpacked as arrays. The reader takes sizes and offsets from the idx1 index, checks each frame's header, decodes
it, and finds shots where the difference of neighbouring histograms stands out from those around it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

WIDTH, HEIGHT, RATE, BITS = 16, 12, 25, 9
FRAME = WIDTH * HEIGHT
#: Histogram bins; frames on either side that set the threshold; standard deviations and least share of changed samples for a cut.
BINS, AROUND, SIGMAS, LEAST = 16, 12, 2.0, 0.2
#: Payload bytes of the rows that are worked on together; frames that are encoded or decoded at once, of a long text too.
CHUNK, BLOCK = 1 << 20, 4_096


def _header() -> bytes:
    """SOI, DHT, SOF3 and SOS of every frame."""
    dht = bytes([0x00] + [1] * BITS + [0] * (16 - BITS) + list(range(BITS - 1, -1, -1)))  # code of 9 - s bits for category s
    sof = struct.pack(">BHHBBBB", 8, HEIGHT, WIDTH, 1, 1, 0x11, 0)
    sos = bytes([1, 1, 0x00, 1, 0, 0])  # predictor 1
    return b"\xff\xd8" + b"".join(bytes([0xFF, m]) + struct.pack(">H", len(x) + 2) + x for m, x in ((0xC4, dht), (0xC3, sof), (0xDA, sos)))


HEADER, END = _header(), b"\xff\xd9"
_SHIFT = np.arange(BITS - 1, -1, -1, dtype=np.int16)


def _code_table() -> tuple[np.ndarray, np.ndarray]:
    """The nine bits of each difference from -255 to 255, and the difference of each nine bits."""
    of, back = np.zeros(511, np.int16), np.full(512, -999, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = (1 << BITS - s) - 2 if s < BITS else 0  # canonical codes: all ones but the last bit
        bits = code << s | (d if d > 0 else d + (1 << s) - 1 if s else 0)
        of[d + 255], back[bits] = bits, d
    return of, back


_OF, _BACK = _code_table()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """One JPEG for each row of samples (n, 192), 8-bit; BLOCK frames at once."""
    out: list[bytes] = []
    for lo in range(0, len(samples), BLOCK):
        x = samples[lo : lo + BLOCK].reshape(-1, HEIGHT, WIDTH).astype(np.int16)
        d = np.empty_like(x)
        d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
        d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
        d[:, 0, 0] = x[:, 0, 0] - 128
        bits = (_OF[d.reshape(-1, FRAME) + 255][:, :, None] >> _SHIFT & 1).astype(np.uint8)
        raw = np.packbits(bits.reshape(len(x), -1), axis=1)
        flat = raw.reshape(-1)
        full = flat == 255
        ends = np.arange(1, len(raw) + 1) * raw.shape[1]
        if full.any():  # a zero follows each byte of ones
            at = np.flatnonzero(full)
            ends = ends + np.searchsorted(at, ends)
            flat = np.insert(flat, at + 1, 0)
        data, start = flat.tobytes(), 0
        for hi in ends.tolist():
            out.append(HEADER + data[start:hi] + END)
            start = hi
    return out


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """The samples (n, 192) of lossless JPEG frames of 16 x 12 grey samples; BLOCK frames at once.

    Runs of frames with the headers that encode_frames writes are decoded as arrays, others one by one from their own
    headers (Huffman table, predictor 1 to 7). What isn't such a frame raises ValueError.
    """
    out = np.empty((len(frames), FRAME), np.uint8)
    n, lo = len(HEADER), 0
    own = [f[:n] == HEADER for f in frames]
    while lo < len(frames):
        hi = lo + 1
        if own[lo]:
            while hi < len(frames) and own[hi] and hi - lo < BLOCK:
                hi += 1
            out[lo:hi] = _decode_block(frames[lo:hi])
        else:
            out[lo] = decode_frame(frames[lo])
        lo = hi
    return out


def _decode_block(frames: list[bytes]) -> np.ndarray:
    n = len(HEADER)
    if any(f[-2:] != END for f in frames):
        raise ValueError("a frame without end marker")
    flat = np.frombuffer(b"".join([f[n:-2] for f in frames]), np.uint8)
    stuffed = np.zeros(len(flat), bool)
    stuffed[1:] = (flat[:-1] == 255) & (flat[1:] == 0)
    flat = flat[~stuffed]
    if len(flat) != len(frames) * FRAME * BITS // 8:
        raise ValueError("a frame's entropy-coded data has another length")
    bits = np.unpackbits(flat).reshape(-1, BITS).astype(np.int16)
    d = _BACK[bits @ (1 << _SHIFT)].reshape(-1, HEIGHT, WIDTH)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return np.cumsum(d, axis=2).astype(np.uint8).reshape(-1, FRAME)


def decode_frame(frame: bytes) -> np.ndarray:
    """The samples of one lossless JPEG frame, from its DHT, SOF3 and SOS segments."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, codes, shape, predictor, shift = 2, {}, None, None, 0
    while predictor is None:
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise ValueError("a JPEG frame that breaks off before its scan")
        kind, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body, at = frame[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xC4:
            while body:
                counts, values, code, taken = body[1:17], body[17 : 17 + sum(body[1:17])], 0, 0
                table = codes[body[0] & 15] = {}
                for length, count in enumerate(counts, 1):
                    for _ in range(count):
                        table[length, code] = values[taken]
                        code, taken = code + 1, taken + 1
                    code <<= 1
                body = body[17 + len(values) :]
        elif kind == 0xC3:
            bits, height, width, parts = struct.unpack_from(">BHHB", body)
            shape = (bits, height, width, parts)
        elif kind == 0xDA:
            table, predictor, shift = codes.get(body[2] >> 4), body[-3], body[-1] & 15
        elif 0xC0 <= kind <= 0xCF:
            raise ValueError("not a lossless Huffman frame")
    if shape != (8, HEIGHT, WIDTH, 1) or table is None or not 1 <= predictor <= 7 or shift:
        raise ValueError("not a 16 x 12 grey frame of 8 bits")
    data = frame[at : frame.rindex(END)].replace(b"\xff\x00", b"\xff")
    stream, place = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0
    x = np.zeros((HEIGHT, WIDTH), np.int64)
    for i in range(HEIGHT):
        for j in range(WIDTH):
            code = length = 0
            while (length, code) not in table or not length:
                if place >= len(stream) or length > 16:
                    raise ValueError("entropy-coded data that breaks off or has an unknown code")
                code, length, place = code << 1 | stream[place], length + 1, place + 1
            size, value = table[length, code], 0
            for bit in stream[place : place + size]:
                value = value << 1 | bit
            place += size
            d = value if not size or value >> (size - 1) else value - (1 << size) + 1
            a, b, c = (int(x[i, j - 1]) if j else 0), (int(x[i - 1, j]) if i else 0), (int(x[i - 1, j - 1]) if i and j else 0)
            guess = 128 if not i and not j else a if not i else b if not j else (a, b, c, a + b - c, a + (b - c >> 1), b + (a - c >> 1), a + b >> 1)[predictor - 1]
            x[i, j] = guess + d & 0xFFFF
    if x.max(initial=0) > 255:
        raise ValueError("a sample beyond 8 bits")
    return x.astype(np.uint8).reshape(FRAME)


def write_avi(frames: list[bytes], length: int) -> bytes:
    """A RIFF AVI file of the frames with an idx1 index; `length` is kept as INFO comment. The frames are copied once."""

    def chunk(name: bytes, data: bytes) -> bytes:
        return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)

    def group(kind: bytes, name: bytes, data: bytes) -> bytes:
        return chunk(kind, name + data)

    biggest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // RATE, biggest * RATE, 0, 0x10, len(frames), 0, 1, biggest, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, len(frames), biggest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    hdrl = group(b"LIST", b"hdrl", chunk(b"avih", avih) + group(b"LIST", b"strl", chunk(b"strh", strh) + chunk(b"strf", strf)))
    sizes = np.fromiter(map(len, frames), np.int64, len(frames))
    steps = sizes + (sizes & 1) + 8
    index = np.zeros(len(frames), [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
    index["id"], index["flags"], index["at"], index["size"] = b"00dc", 0x10, 4 + np.cumsum(steps) - steps, sizes
    info = group(b"LIST", b"INFO", chunk(b"ICMT", b"%d\0" % length))
    movi = 4 + int(steps.sum())
    idx1 = chunk(b"idx1", index.tobytes())
    total = 4 + len(hdrl) + len(info) + 8 + movi + len(idx1)
    if total >= 1 << 32:
        raise ValueError("a payload too long for one AVI file (about 2.9 GB)")
    parts = [b"RIFF", struct.pack("<I", total), b"AVI ", hdrl, info, b"LIST", struct.pack("<I", movi), b"movi"]
    for f in frames:
        parts += (b"00dc", struct.pack("<I", len(f)), f, b"\0" * (len(f) & 1))
    parts.append(idx1)
    return b"".join(parts)


def read_avi(data: bytes) -> tuple[list[bytes], float, int]:
    """(frames named by the index, frames a second, length kept in the comment) of an AVI file."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict[bytes, tuple[int, int]] = {}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"LIST":
                kind = data[at + 8 : at + 12]
                found[kind] = (at + 8, size)
                if kind != b"movi":
                    walk(at + 12, at + 8 + size)
            else:
                found.setdefault(name, (at + 8, size))
            at += 8 + size + (size & 1)

    walk(12, 8 + struct.unpack_from("<I", data, 4)[0])
    if b"idx1" not in found or b"movi" not in found:
        raise ValueError("an AVI file without index")
    index = np.frombuffer(data, [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")], found[b"idx1"][1] // 16, found[b"idx1"][0])
    index = index[index["id"] == b"00dc"]
    at = index["at"].astype(np.int64) + found[b"movi"][0] + 8
    frames = [data[a : a + n] for a, n in zip(at.tolist(), index["size"].tolist())]
    scale, rate = struct.unpack_from("<II", data, found[b"strh"][0] + 20)
    at, size = found.get(b"ICMT", (0, 0))
    return frames, rate / scale, int(data[at : at + size].rstrip(b"\0") or b"-1")


def histograms(samples: np.ndarray) -> np.ndarray:
    out = np.empty((len(samples), BINS), np.int16)
    for lo in range(0, len(samples), BLOCK):
        part = samples[lo : lo + BLOCK]
        n = len(part)
        out[lo : lo + n] = np.bincount((np.arange(n)[:, None] * BINS + (part >> 4)).reshape(-1), minlength=n * BINS).reshape(n, BINS)
    return out


def cuts(hist: np.ndarray) -> np.ndarray:
    """Frames that begin a shot. The difference to the frame before must exceed LEAST, and the mean of the
    differences of up to AROUND frames on either side (without its own) by SIGMAS standard deviations."""
    n = len(hist)
    if n < 2:
        return np.zeros(1, np.int64)
    d = np.abs(np.diff(hist, axis=0)).sum(1, dtype=np.int64) / (2 * FRAME)
    one, two = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    i = np.arange(n - 1)
    lo, hi = np.maximum(i - AROUND, 0), np.minimum(i + AROUND + 1, n - 1)
    k = np.maximum(hi - lo - 1, 1)
    mean = (one[hi] - one[lo] - d) / k
    spread = np.sqrt(np.maximum((two[hi] - two[lo] - d * d) / k - mean * mean, 0))
    return np.concatenate([[0], 1 + np.flatnonzero((d > LEAST) & (d > mean + SIGMAS * spread + 1e-12))])


def _grouped(rows: Iterator[tuple], size) -> Iterator[list[tuple]]:
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += size(r)
        if n >= CHUNK:
            yield held
            held, n = [], 0
    if held:
        yield held


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(b.column("id").to_pylist(), b.column("payload").to_pylist())
        for part in _grouped(rows, lambda r: len(r[1])):
            padded = [x + b" " * (-len(x) % FRAME if x else FRAME) for _, x in part]
            frames, lo, out = encode_frames(np.frombuffer(b"".join(padded), np.uint8).reshape(-1, FRAME)), 0, []
            for (_, x), p in zip(part, padded):
                hi = lo + len(p) // FRAME
                out.append(write_avi(frames[lo:hi], len(x)))
                lo = hi
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], b.schema.field("id").type), pa.array(out, pa.binary())], ["id", "media"])


def to_avi(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each text in UTF-8, blanks appended up to a positive multiple of 192 bytes, as an AVI file.

    Null texts count as empty: one frame of blanks. One row per input row, repeated rows too; other columns are ignored. A
    text takes about ten times its bytes in memory at most, whatever its length; one beyond 2.9 GB raises ValueError.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.encode(text_of(text_col), "UTF-8").alias("payload")).mapInArrow(_encode, f"id {kind}, media binary")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, list[tuple]]]:
    """Lists of (id, media, frames a second, length, samples)."""
    for b in batches:
        rows = zip(b.column("id").to_pylist(), b.column("media").to_pylist())
        for part in _grouped(rows, lambda r: len(r[1] or b"")):
            part = [r for r in part if r[1] is not None]
            opened = [read_avi(m) for _, m in part]
            every = [f for frames, _, _ in opened for f in frames]
            samples, lo, out = decode_frames(every) if every else np.zeros((0, FRAME), np.uint8), 0, []
            for (i, m), (frames, rate, length) in zip(part, opened):
                out.append((i, m, rate, length, samples[lo : lo + len(frames)]))
                lo += len(frames)
            yield b.schema.field("id").type, out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for kind, part in _decoded(batches):
        hist, lo, rows = histograms(np.concatenate([p[4] for p in part])) if part else None, 0, []
        for i, media, rate, length, samples in part:
            payload = samples.tobytes()
            own = hist[lo : lo + len(samples)]
            lo += len(samples)
            at = cuts(own)
            mean = own.sum(0, dtype=np.int64) * 255 // (len(samples) * FRAME)
            feature = f"frames={len(samples)};rate={rate:g};shots={len(at)};cuts={','.join(map(str, at.tolist()))};levels={bytes(mean.astype(np.uint8).tolist()).hex()}"
            rows.append((i, length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        columns = list(zip(*rows)) if rows else [()] * 8
        kinds = [kind, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def features(media: DataFrame) -> DataFrame:
    """Of (id, media): the payload read back from the frames, its digests, and a feature string (frames, rate,
    shots, first frames of shots, mean histogram in 1/255). Rows with null media are left out; a file that can't
    be read raises ValueError."""
    kind = media.schema["id"].dataType.simpleString()
    return media.mapInArrow(_features, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for kind, part in _decoded(batches):
        rows = []
        for i, _, rate, _, samples in part:
            at = cuts(histograms(samples)).tolist() if len(samples) else []
            rows += [(i, k, a, b - 1, a / rate, b / rate) for k, (a, b) in enumerate(zip(at, [*at[1:], len(samples)]))]
        columns = list(zip(*rows)) if rows else [()] * 6
        kinds = [kind, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["id", "clip", "first_frame", "last_frame", "start_s", "end_s"])


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows of (id, media): one per shot, in order; frames are inclusive, end_s is exclusive."""
    kind = media.schema["id"].dataType.simpleString()
    return media.mapInArrow(_clips, f"id {kind}, clip int, first_frame int, last_frame int, start_s double, end_s double")
