import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexloom.llm import media


def decode_slowly(frame):
    """A lossless JPEG frame by the standard's rules: any Huffman table, bit by bit."""
    at, codes, size = 2, {}, None
    while True:
        mark, n = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + n]
        if mark == 0xC4:
            code, k = 0, 17
            for length in range(1, 17):
                for _ in range(body[length]):
                    codes[(length, code)] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
        elif mark == 0xC3:
            size = struct.unpack_from(">HH", body, 1)
        at += 2 + n
        if mark == 0xDA:
            assert body[3] == 1
            break
    bits = "".join(f"{b:08b}" for b in frame[at:-2].replace(b"\xff\x00", b"\xff"))
    pos, out = 0, np.zeros(size, np.int64)
    for y in range(size[0]):
        for x in range(size[1]):
            length = 1
            while (length, int(bits[pos : pos + length], 2)) not in codes:
                length += 1
            s = codes[(length, int(bits[pos : pos + length], 2))]
            pos += length
            v = int(bits[pos : pos + s] or "0", 2)
            pos += s
            d = v if not s or v >> s - 1 else v - (1 << s) + 1
            out[y, x] = (d + (out[y, x - 1] if x else out[y - 1, 0] if y else 128)) % 65536
    return out.reshape(-1)


def test_frames_are_standard_lossless_jpeg():
    rng = np.random.default_rng(1)
    samples = np.stack([rng.integers(0, 256, 192), np.full(192, 255), np.zeros(192), np.tile([0, 255], 96), np.arange(192)]).astype(np.uint8)
    frames = media.encode_frames(samples)
    assert any(b"\xff\x00" in f[len(media.HEADER) : -2] for f in frames)
    for row, f in zip(samples, frames):
        assert (decode_slowly(f) == row).all()
    assert (media.decode_frames(frames) == samples).all()
    with pytest.raises(ValueError):
        media.decode_frames([frames[0][:-1]])


def test_riff_layout_and_index():
    frames = media.encode_frames(np.arange(192 * 3).reshape(3, 192).astype(np.uint8))
    data = media.write_avi(frames, 500)
    assert struct.unpack_from("<I", data, 4)[0] == len(data) - 8
    assert media.read_avi(data) == (frames, 25.0, 500)
    with pytest.raises(ValueError):
        media.read_avi(data.replace(b"idx1", b"idx2"))


def test_shots_are_found_where_the_histogram_jumps():
    rng = np.random.default_rng(2)
    low = [rng.integers(0, 40, 192) for _ in range(20)]
    high = [rng.integers(200, 256, 192) for _ in range(20)]
    at = media.cuts(media.histograms(np.array(low + high + low).astype(np.uint8)))
    assert at.tolist() == [0, 20, 40]
    assert media.cuts(media.histograms(np.zeros((1, 192), np.uint8))).tolist() == [0]


def test_round_trip_of_odd_rows(spark, odd, none):
    stored = media.to_avi(odd)
    got = media.features(stored).collect()
    by_text = {}
    for r in odd.collect():
        payload = (r["text"] or "").encode()
        padded = payload + b" " * (-len(payload) % 192 if payload else 192)
        by_text.setdefault(r["doc_id"], []).append((len(payload), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])))
    assert len(got) == odd.count()
    for r in got:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in by_text[r["id"]]
    ones = [tuple(r)[1:] for r in got if r["id"] == 1]
    assert ones[0] == ones[1]
    clips = media.clips(stored).where("id = 6").orderBy("first_frame").collect()
    assert clips[0]["start_s"] == 0.0 and all(c["end_s"] > c["start_s"] for c in clips)
    assert media.features(media.to_avi(none)).count() == 0 and media.clips(media.to_avi(none)).count() == 0


def test_random_bytes_survive(spark):
    random.seed(3)
    rows = [(i, random.randbytes(random.randint(0, 2000))) for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["id", "payload"])
    found = [x for _, part in media._decoded(media._encode([batch])) for x in part]
    assert [(i, s.tobytes()[:n]) for i, _, _, n, s in found] == rows


def test_frames_with_other_tables_and_predictors_are_decoded():
    """A plain encoder with a table of its own (each category with a code of four bits or more) and all predictors."""
    rng = np.random.default_rng(4)
    lengths = {s: 4 for s in range(9)}
    for predictor in range(1, 8):
        x = rng.integers(0, 256, (12, 16)).tolist()
        code, bits = {s: format(i, "04b") for i, s in enumerate(lengths)}, ""
        for i in range(12):
            for j in range(16):
                a, b, c = x[i][j - 1] if j else 0, x[i - 1][j] if i else 0, x[i - 1][j - 1] if i and j else 0
                guess = 128 if not i and not j else a if not i else b if not j else {1: a, 2: b, 3: c, 4: a + b - c, 5: a + (b - c >> 1), 6: b + (a - c >> 1), 7: a + b >> 1}[predictor]
                d = x[i][j] - guess
                s = abs(d).bit_length()
                if s > 8:
                    x[i][j] = max(0, min(255, guess))
                    d = x[i][j] - guess
                    s = abs(d).bit_length()
                bits += code[s] + (format(d if d > 0 else d + (1 << s) - 1, f"0{s}b") if s else "")
        bits += "1" * (-len(bits) % 8)
        data = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        dht = bytes([0, 0, 0, 0, 9] + [0] * 12 + list(range(9)))
        segments = [(0xE0, b"JFIF"), (0xC4, dht), (0xC3, struct.pack(">BHHBBBB", 8, 12, 16, 1, 1, 0x11, 0)), (0xDA, bytes([1, 1, 0, predictor, 0, 0]))]
        frame = b"\xff\xd8" + b"".join(bytes([0xFF, m]) + struct.pack(">H", len(v) + 2) + v for m, v in segments) + data + b"\xff\xd9"
        got = media.decode_frames([frame, *media.encode_frames(np.zeros((1, 192), np.uint8)), frame])
        assert got[0].tolist() == got[2].tolist() == np.array(x).reshape(-1).tolist() and not got[1].any()
    for bad in (b"", b"\xff\xd8", frame[:40], frame.replace(b"\xff\xc3", b"\xff\xc0")):
        with pytest.raises(ValueError):
            media.decode_frames([bad])


def test_a_long_text_takes_little_memory():
    import tracemalloc

    payload = (b"some words of a long text " * 400_000)[: 192 * 50_000]
    tracemalloc.start()
    frames = media.encode_frames(np.frombuffer(payload, np.uint8).reshape(-1, 192))
    avi = media.write_avi(frames, len(payload))
    del frames
    frames, _, length = media.read_avi(avi)
    assert media.decode_frames(frames).tobytes() == payload and length == len(payload)
    assert tracemalloc.get_traced_memory()[1] < 10 * len(payload)
    tracemalloc.stop()


def test_the_query_against_a_brute_version(spark, sf):
    """Payload, digests and the feature of every document, from the definitions."""
    import hashlib
    import zlib

    from lexloom.llm import queries

    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op2_media_columns"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        raw = docs[r["doc_id"]]
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        frames = [payload[i : i + 192] for i in range(0, len(payload), 192)]
        hist = [[sum(1 for v in f if v // 16 == k) for k in range(16)] for f in frames]
        d = [sum(abs(x - y) for x, y in zip(a, b)) / 384 for a, b in zip(hist, hist[1:])]
        cut = [0]
        for i, v in enumerate(d):
            around = d[max(i - 12, 0) : i] + d[i + 1 : i + 13]
            mean = sum(around) / max(len(around), 1)
            spread = max(sum(y * y for y in around) / max(len(around), 1) - mean * mean, 0) ** 0.5
            if v > 0.2 and v > mean + 2 * spread + 1e-12:
                cut.append(i + 1)
        levels = bytes(sum(h[k] for h in hist) * 255 // (len(frames) * 192) for k in range(16)).hex()
        assert r["feature"] == f"frames={len(frames)};rate=25;shots={len(cut)};cuts={','.join(map(str, cut))};levels={levels}"
