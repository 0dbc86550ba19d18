import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from chronomesh.llm import media


def test_frames_round_trip():
    rng = np.random.default_rng(1)
    flat = np.zeros((1, 12, 16), np.uint8)
    frames = np.concatenate([rng.integers(0, 256, (50, 12, 16)).astype(np.uint8), rng.choice(np.array([0, 255], np.uint8), (20, 12, 16)), flat, flat + 255])
    assert (media.decode_frames(media.encode_frames(frames)) == frames).all()
    tall = rng.integers(0, 256, (3, 7, 5)).astype(np.uint8)
    assert (media.decode_frames(media.encode_frames(tall)) == tall).all()


def test_avi_is_read_by_index_and_without():
    frames = media.encode_frames(np.arange(192 * 3, dtype=np.int64).astype(np.uint8).reshape(3, 12, 16))
    data = media.write_avi(frames, payload=5)
    head, got = media.read_avi(data)
    assert got == frames and head["n_frames"] == 3 and head["codec"] == "MJPG" and (head["width"], head["height"]) == (16, 12) and head["comment"] == "payload=5"
    cut = data.index(b"idx1")
    bare = data[:4] + struct.pack("<I", cut - 8) + data[8:cut]
    assert media.read_avi(bare)[1] == frames
    for bad in (b"", b"RIFF", data[:100], b"x" * 500):
        with pytest.raises((media.BadMedia, struct.error)):
            media.read_avi(bad)


def baseline(planes, factors, restart=0, bring=True):
    """A baseline JPEG of component planes (whole blocks) under a flat quantisation of 2, with codes of fixed lengths, or the typical ones."""
    order = media.zigzag()
    k = np.arange(8)
    basis = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    ac = [r << 4 | z for r in range(16) for z in range(1, 11)] + [0x00, 0xF0]
    dc_code, ac_code = (lambda z: f"{z:04b}"), (lambda rs: f"{ac.index(rs):08b}")
    if not bring:
        typical = {k: {symbol: f"{code:0{n}b}" for (n, code), symbol in t.items()} for k, t in media.default_tables().items()}
        dc_code, ac_code = typical[0].__getitem__, typical[0x10].__getitem__
    extra = lambda v: f"{v if v > 0 else v + (1 << abs(v).bit_length()) - 1:0{abs(v).bit_length()}b}" if v else ""
    wide, tall = max(f[0] for f in factors), max(f[1] for f in factors)
    across, down = planes[0].shape[1] // 8 // factors[0][0], planes[0].shape[0] // 8 // factors[0][1]
    out, bits, last = b"", "", [0] * len(planes)

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")

    for m in range(across * down):
        if restart and m and m % restart == 0:
            out, bits, last = out + flush(bits) + bytes([0xFF, 0xD0 + (m // restart - 1) % 8]), "", [0] * len(planes)
        for c, (plane, (h, v)) in enumerate(zip(planes, factors)):
            for b in range(h * v):
                y, x = (m // across * v + b // h) * 8, (m % across * h + b % h) * 8
                z = np.rint(basis @ (plane[y : y + 8, x : x + 8] - 128.0) @ basis.T / 2).astype(int).ravel()[order].tolist()
                d, last[c] = z[0] - last[c], z[0]
                bits += dc_code(abs(d).bit_length()) + extra(d)
                run = 0
                for i in range(1, 64):
                    if not any(z[i:]):
                        bits += ac_code(0)
                        break
                    if z[i] == 0 and run < 15:
                        run += 1
                        continue
                    bits += ac_code(0xF0 if z[i] == 0 else run << 4 | abs(z[i]).bit_length()) + extra(z[i])
                    run = 0
    head = media._segment(media.DQT, bytes([0] + [2] * 64))
    head += media._segment(media.SOF0, struct.pack(">BHHB", 8, down * tall * 8, across * wide * 8, len(planes)) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(factors)))
    if bring:
        head += media._segment(media.DHT, bytes([0, 0, 0, 0, 12] + [0] * 12 + list(range(12))) + bytes([0x10] + [0] * 7 + [len(ac)] + [0] * 8 + ac))
    if restart:
        head += media._segment(media.DRI, struct.pack(">H", restart))
    scan = media._segment(media.SOS, bytes([len(planes)] + [x for c in range(len(planes)) for x in (c + 1, 0)] + [0, 63, 0]))
    return b"\xff\xd8" + head + scan + out + flush(bits) + b"\xff\xd9"


def test_baseline_frames():
    rng = np.random.default_rng(5)
    smooth = lambda h, w: np.clip(128 + 60 * np.sin(np.arange(h)[:, None] / 5) + 40 * np.cos(np.arange(w) / 7) + rng.normal(0, 6, (h, w)), 0, 255).astype(np.uint8)
    gray = smooth(24, 32)
    for restart in (0, 3):
        assert np.abs(media.decode_baseline(baseline([gray], [(1, 1)], restart)).astype(int) - gray).max() <= 4
    luma = smooth(32, 48)
    colour = baseline([luma, smooth(16, 24), smooth(16, 24)], [(2, 2), (1, 1), (1, 1)])
    assert np.abs(media.decode_baseline(colour).astype(int) - luma).max() <= 4
    frames = [baseline([np.full((16, 16), v, np.uint8)], [(1, 1)]) for v in (20, 20, 20, 220, 220)]
    assert [(a, b) for a, b, _, _ in media.shots(media.intra_frames(media.read_avi(media.write_avi(frames, 16, 16))[1]))] == [(0, 3), (3, 5)]
    with pytest.raises(media.BadMedia):
        media.decode_baseline(frames[0][:-30])


def test_typical_tables():
    made = media.default_tables()
    assert [len(made[k]) for k in (0, 1, 16, 17)] == [12, 12, 162, 162]
    code = {(k, s): f"{c:0{n}b}" for k, t in made.items() for (n, c), s in t.items()}
    # codes that the standard prints
    assert (code[0, 0], code[0, 11], code[1, 11]) == ("00", "111111110", "11111111110")
    assert (code[16, 0], code[16, 0xF0], code[16, 1], code[16, 0xFA]) == ("1010", "11111111001", "00", "1" * 15 + "0")
    assert (code[17, 0], code[17, 0xF0], code[17, 1], code[17, 0xFA]) == ("00", "1111111010", "01", "1" * 15 + "0")
    rng = np.random.default_rng(6)
    gray = np.clip(128 + 60 * np.sin(np.arange(24)[:, None] / 5) + 40 * np.cos(np.arange(32) / 7) + rng.normal(0, 6, (24, 32)), 0, 255).astype(np.uint8)
    assert np.abs(media.decode_baseline(baseline([gray], [(1, 1)], bring=False)).astype(int) - gray).max() <= 4


def test_opendml_index_and_parts():
    samples = np.random.default_rng(8).integers(0, 256, (9, 12, 16)).astype(np.uint8)
    frames = media.encode_frames(samples, 4)
    assert frames == media.encode_frames(samples) and (media.decode_frames(frames, 4) == samples).all()
    data = media.write_avi(frames, payload=7, opendml=True)
    assert b"idx1" not in data and media.read_avi(data)[1] == frames and media.read_avi(data)[0]["comment"] == "payload=7"
    cut = data.index(b"indx")  # without the index the movi list is read
    assert media.read_avi(data[:cut] + b"JUNK" + data[cut + 4 :])[1] == frames
    more = b"AVIX" + b"LIST" + struct.pack("<I", 4 + sum(8 + len(f) + len(f) % 2 for f in frames)) + b"movi" + b"".join(b"00dc" + struct.pack("<I", len(f)) + f + b"\0" * (len(f) % 2) for f in frames)
    bare = data[:cut] + b"JUNK" + data[cut + 4 :]
    assert media.read_avi(bare + b"RIFF" + struct.pack("<I", len(more)) + more)[1] == frames * 2


def test_damage_is_a_row(spark):
    rng = random.Random(4)
    gray = np.arange(256, dtype=np.uint8).reshape(16, 16)
    whole = [media.write_avi([baseline([gray], [(1, 1)])] * 3, 16, 16), media.write_avi(media.encode_frames(np.zeros((3, 12, 16), np.uint8))), media.write_avi(media.encode_frames(np.zeros((3, 12, 16), np.uint8)), opendml=True)]
    zero = bytearray(whole[0])
    at = zero.index(b"\xff\xc0")
    zero[at + 11] = 0  # a sampling factor of 0
    vast = bytearray(whole[1])
    at = vast.index(b"\xff\xc3")
    vast[at + 5 : at + 9] = b"\xff" * 4  # 65535 x 65535 samples
    short = bytearray(whole[0])
    at = short.index(b"\xff\xdb")
    short[at + 2 : at + 4] = struct.pack(">H", 20)
    files = [bytes(zero), bytes(vast), bytes(short)]
    for _ in range(300):
        made = bytearray(rng.choice(whole))
        for _ in range(rng.choice([1, 3, 20])):
            made[rng.randrange(len(made))] = rng.randrange(256)
        files.append(bytes(made[: rng.choice([len(made), rng.randrange(len(made))])]))
    df = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)] + [(None, bytearray(whole[1]))], "doc_id long, media binary")
    got = media.clips(df).collect()
    assert all(r.error for r in got if r.doc_id in (0, 1, 2)) and {0, 1, 2} <= {r.doc_id for r in got}
    assert [(r.doc_id, r.first_frame, r.end_frame, r.error) for r in got if r.doc_id is None] == [(None, 0, 3, None)]


def test_shots():
    rng = np.random.default_rng(2)
    scenes = [rng.normal(m, 5, (n, 12, 16)).clip(0, 255).astype(np.uint8) for m, n in ((40, 10), (200, 15), (110, 5))]
    assert [(a, b) for a, b, _, _ in media.shots(np.concatenate(scenes))] == [(0, 10), (10, 25), (25, 30)]
    assert media.shots(np.concatenate(scenes), 10)[1][2:] == (1000, 2500)
    assert media.shots(np.empty((0, 12, 16), np.uint8)) == []


def test_digest(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "é" * 96, "é" * 97, "\u0000￿𝄞" * 1000, "z" * 200_001] + ["".join(rng.choices("ab cdéß\n", k=rng.randint(0, 3000))) for _ in range(40)]
    rows = [(None if i == 9 else i, t, 1) for i, t in enumerate(texts)] + [(2, "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media_bytes int").repartition(3)
    got = media.digest(df).collect()
    assert len(got) == len(rows) and media.digest(df.limit(0)).count() == 0
    files = {r.doc_id: bytes(r.media) for r in media.encode_texts(df).collect()}
    for r in got:
        raw = (texts[9 if r.doc_id is None else r.doc_id] or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_bytes == len(files[r.doc_id]) and r.media_sha256 == hashlib.sha256(files[r.doc_id]).hexdigest()
        assert b"".join(media.decode_frames([f]).tobytes() for f in media.read_avi(files[r.doc_id])[1]) == payload
    stored = media.encode_texts(df).unionByName(spark.createDataFrame([(77, None), (78, bytearray(b"junk"))], "doc_id long, media binary"))
    found = media.clips(stored).collect()
    assert not [r for r in found if r.doc_id == 77] and [r.error for r in found if r.doc_id == 78] == ["not an AVI file"]
    assert [r.end_frame for r in found if r.doc_id == 6][-1] == 1042
