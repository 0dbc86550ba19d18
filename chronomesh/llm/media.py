"""Media columns: AVI motion-JPEG, with lossless intra frames, RIFF indexes and shots."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.llm.common import slices

WIDTH, HEIGHT = 16, 12
FRAME = WIDTH * HEIGHT
FPS = 25
PAD = 32
#: Frames that are coded or decoded in one step.
BLOCK_FRAMES = 4096
HISTOGRAM_BINS = 16
#: A frame opens a shot if its histogram difference exceeds the running mean by so many running deviations, and a floor.
SENSITIVITY, FLOOR, MEMORY = 3.0, 0.25, 0.9

# Marker codes of the JPEG standard (ITU-T T.81).
SOI, EOI, SOS, DHT, DQT, DRI, SOF0, SOF1, SOF3 = 0xD8, 0xD9, 0xDA, 0xC4, 0xDB, 0xDD, 0xC0, 0xC1, 0xC3


def _code_lengths() -> list[int]:
    """Number of codes of each length 1..16: difference categories 0..8 get 2, 3, 3, 3, 3, 3, 4, 5 and 6 bits' codes in order."""
    lengths = [2, 3, 3, 3, 3, 3, 4, 5, 6]
    return [lengths.count(n) for n in range(1, 17)]


COUNTS, CATEGORIES = _code_lengths(), list(range(9))


def huffman_codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length): canonical codes ascend within a length and are doubled from one length to the next."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            out[symbol] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_head(width: int, height: int) -> bytes:
    """Start of a lossless (process 14, predictor 1) gray frame with its own table."""
    frame = _segment(SOF3, struct.pack(">BHHB3B", 8, height, width, 1, 1, 0x11, 0))
    table = _segment(DHT, bytes([0, *COUNTS, *CATEGORIES]))
    return bytes([0xFF, SOI]) + frame + table + _segment(SOS, bytes([1, 1, 0, 1, 0, 0]))


def predictions(samples: np.ndarray, width: int) -> np.ndarray:
    """Predictor 1 for frames (n, height, width): the sample to the left; above, in a line's first column; 128 at the start."""
    out = np.empty_like(samples)
    out[:, :, 1:] = samples[:, :, :-1]
    out[:, 1:, 0] = samples[:, :-1, 0]
    out[:, 0, 0] = 128
    return out


def encode_frames(samples: np.ndarray, block: int = BLOCK_FRAMES) -> list[bytes]:
    """Lossless JPEG frames of 8-bit samples (n, height, width), coded in blocks of frames, so memory doesn't grow with n."""
    return [f for at in range(0, len(samples), block) for f in _encode_block(samples[at : at + block])]


def _encode_block(samples: np.ndarray) -> list[bytes]:
    n, height, width = samples.shape
    x = samples.astype(np.int16)
    diff = (x - predictions(x, width)).reshape(n, -1)
    size = np.frompyfunc(int.bit_length, 1, 1)(np.arange(256)).astype(np.int64)[np.abs(diff)]
    codes = huffman_codes(COUNTS, CATEGORIES)
    code, length = (np.array([codes[s][k] for s in CATEGORIES], np.int64) for k in (0, 1))
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    value, bits = (code[size] << size) | extra, length[size] + size
    ends = np.cumsum(bits, axis=1)
    total = (ends[:, -1] + 7) // 8
    base = np.concatenate([[0], np.cumsum(total)])
    first = ends - bits + 8 * base[:-1, None]
    # a code takes at most 14 bits, so it touches at most three bytes; codes don't overlap, so sums are unions
    shifted = (value << (24 - bits - (first & 7))).ravel()
    byte = (first >> 3).ravel()
    out = np.zeros(base[-1] + 3)
    for k in range(3):
        out += np.bincount(byte + k, (shifted >> (16 - 8 * k)) & 255, len(out))
    last = base[1:] - 1
    out[last] += (1 << (8 * total - ends[:, -1])) - 1  # the last byte is filled with ones
    packed = out[: base[-1]].astype(np.uint8).tobytes()
    head, tail = _frame_head(width, height), bytes([0xFF, EOI])
    return [head + packed[a:b].replace(b"\xff", b"\xff\x00") + tail for a, b in zip(base[:-1].tolist(), base[1:].tolist())]


def write_avi(frames: list[bytes], width: int = WIDTH, height: int = HEIGHT, fps: int = FPS, payload: int | None = None, opendml: bool = False) -> bytes:
    """A RIFF AVI file of MJPG frames with an idx1 index; payload, the bytes stored, goes into an INFO comment.

    opendml: frames are listed by an OpenDML index (indx in the stream's header, ix00 among the frames) instead.
    """

    def chunk(name: bytes, body: bytes) -> bytes:
        return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)

    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)

    def header(more: bytes = b"") -> bytes:
        return chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", bitmap) + more))

    head, parts, index, at = header(), [], [], 4
    for f in frames:
        parts.append(chunk(b"00dc", f))
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        at += len(parts[-1])
    info = b"" if payload is None else chunk(b"LIST", b"INFO" + chunk(b"ICMT", b"payload=%d\0" % payload))
    if opendml:
        listed = struct.pack("<HBBI4sQI", 2, 0, 1, len(frames), b"00dc", 0, 0)
        above = lambda at: chunk(b"indx", struct.pack("<HBBI4s12xQII", 4, 0, 0, 1, b"00dc", at, 0, len(frames)))
        movi = 12 + len(header(above(0))) + len(info) + 8  # where the movi list's name lies
        base = movi + at
        listed += b"".join(struct.pack("<II", movi + struct.unpack_from("<I", x, 8)[0] + 8, len(f)) for x, f in zip(index, frames))
        body = b"AVI " + header(above(base)) + info + chunk(b"LIST", b"movi" + b"".join(parts) + chunk(b"ix00", listed))
        return b"RIFF" + struct.pack("<I", len(body)) + body
    body = b"AVI " + head + info + chunk(b"LIST", b"movi" + b"".join(parts)) + chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


class BadMedia(ValueError):
    """The bytes are not an AVI file of frames that can be decoded."""


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            raise BadMedia("a chunk runs over its end")
        yield name, at + 8, at + 8 + size
        at += 8 + size + size % 2


def _opendml_frames(data: bytes, indexes: list[tuple[int, int]]) -> list[bytes]:
    """Frames that OpenDML indexes list: each entry of an index of indexes names a chunk, whose entries are places in the file."""
    frames = []
    for a, b in indexes:
        width, _, kind, n = struct.unpack_from("<HBBI", data, a)
        if kind or a + 24 + 16 * n > b:
            raise BadMedia("not an index of indexes")
        for k in range(n):
            at = struct.unpack_from("<Q", data, a + 24 + 16 * k)[0]
            if at + 32 > len(data):
                raise BadMedia("an index lies beyond the end")
            size = struct.unpack_from("<I", data, at + 4)[0]
            width, _, kind, m, name, base, _ = struct.unpack_from("<HBBI4sQI", data, at + 8)
            if width != 2 or kind != 1 or 24 + 8 * m > size:
                raise BadMedia("not an index of chunks")
            for i in range(m):
                start, length = struct.unpack_from("<II", data, at + 32 + 8 * i)
                length &= 0x7FFFFFFF  # the first bit marks frames that aren't key frames
                if base + start + length > len(data):
                    raise BadMedia("a frame runs over the end")
                frames.append(data[base + start : base + start + length])
    return frames


def read_avi(data: bytes) -> tuple[dict, list[bytes]]:
    """Header values and the frames that the OpenDML index or the idx1 index lists; without an index, those that the movi lists hold.

    Files of several RIFF parts (AVIX) are read as one.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise BadMedia("not an AVI file")
    head: dict = {}
    lists, index, wide = [], None, []
    stack, at = [], 0
    while data[at : at + 4] == b"RIFF" and data[at + 8 : at + 12] in (b"AVI ", b"AVIX"):
        end = min(len(data), at + 8 + struct.unpack_from("<I", data, at + 4)[0])
        stack += list(_chunks(data, at + 12, end))
        at = end + end % 2
    while stack:
        name, a, b = stack.pop(0)
        if name == b"LIST":
            kind = data[a : a + 4]
            if kind == b"movi":
                lists.append((a, b))
            else:
                stack += list(_chunks(data, a + 4, b))
        elif name == b"avih":
            v = struct.unpack_from("<14I", data, a)
            head |= {"us_per_frame": v[0], "n_frames": v[4], "width": v[8], "height": v[9]}
        elif name == b"strh" and "codec" not in head and data[a : a + 4] == b"vids":
            head |= {"codec": data[a + 4 : a + 8].decode("latin-1"), "scale": struct.unpack_from("<I", data, a + 20)[0], "rate": struct.unpack_from("<I", data, a + 24)[0]}
        elif name == b"indx" and data[a + 8 : a + 12][2:] in (b"dc", b"db"):
            wide.append((a, b))
        elif name == b"idx1":
            index = [(data[i : i + 4], *struct.unpack_from("<III", data, i + 4)) for i in range(a, b - 15, 16)]
        elif name == b"ICMT":
            head["comment"] = data[a:b].rstrip(b"\0").decode("latin-1")
    if not lists:
        raise BadMedia("no movi list")
    if wide:
        return head, _opendml_frames(data, wide)
    if index is None or len(lists) > 1:
        return head, [data[a:b] for m in lists for a, b in _listed(data, *m)]
    # offsets count from the movi list's name, or, in some writers, from the file's start
    frames = [x for x in index if x[0][2:] in (b"dc", b"db")]
    base = lists[0][0]
    if frames and data[base + frames[0][2] : base + frames[0][2] + 4] != frames[0][0]:
        base = 0
    return head, [data[base + at + 8 : base + at + 8 + size] for _, _, at, size in frames]


def _listed(data: bytes, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Places of the frames in a movi list, those in `rec ` lists included."""
    for name, x, y in _chunks(data, a + 4, b):
        if name == b"LIST":
            yield from _listed(data, x, y)
        elif name[2:] in (b"dc", b"db"):
            yield x, y


def _parse_frame(frame: bytes) -> tuple[int, int, bytes, tuple]:
    """Height, width, entropy-coded bytes and Huffman table of a gray lossless frame."""
    if frame[:2] != bytes([0xFF, SOI]):
        raise BadMedia("not a JPEG frame")
    at, shape, table = 2, None, None
    while at + 4 <= len(frame):
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if marker == SOF3:
            bits, height, width, parts = struct.unpack_from(">BHHB", body)
            if bits != 8 or parts != 1:
                raise BadMedia("only 8-bit gray lossless frames are decoded")
            shape = (height, width)
        elif marker == DHT:
            table = (tuple(body[1:17]), tuple(body[17:]))
        elif marker == SOS:
            if shape is None or table is None or body[3] != 1:
                raise BadMedia("the scan lacks its frame, its table or predictor 1")
            end = frame.rfind(bytes([0xFF, EOI]))
            return *shape, frame[at + 2 + size : end if end > 0 else len(frame)], table
        elif 0xC0 <= marker <= 0xCF and marker not in (DHT, 0xC8, 0xCC):
            raise BadMedia("only lossless intra frames are decoded")
        at += 2 + size
    raise BadMedia("no scan")


def decode_frames(frames: list[bytes], block: int = BLOCK_FRAMES) -> np.ndarray:
    """Samples (n, height, width) of frames of one shape: a block of frames is decoded in step, one sample of each at a time."""
    if not frames:
        return np.empty((0, 0, 0), np.uint8)
    made = [_decode_block(frames[at : at + block]) for at in range(0, len(frames), block)]
    if len({m.shape[1:] for m in made}) > 1:
        raise BadMedia("frames differ in shape")
    return made[0] if len(made) == 1 else np.concatenate(made)


def _decode_block(frames: list[bytes]) -> np.ndarray:
    parsed = [_parse_frame(f) for f in frames]
    height, width, _, table = parsed[0]
    if not height or not width or any(p[0] * p[1] > 8 * len(p[2]) for p in parsed):  # a sample takes a bit at least
        raise BadMedia("a scan is too short for its frame")
    if any((p[0], p[1], p[3]) != (height, width, table) for p in parsed):
        if len(parsed) == 1:
            raise BadMedia("unreadable frame")
        made = [_decode_block([f]) for f in frames]
        if len({m.shape for m in made}) > 1:
            raise BadMedia("frames differ in shape")
        return np.concatenate(made)
    symbol_of, length_of = np.full(1 << 16, -1, np.int64), np.zeros(1 << 16, np.int64)
    for symbol, (code, length) in huffman_codes(list(table[0]), list(table[1])).items():
        symbol_of[code << (16 - length) : (code + 1) << (16 - length)] = symbol
        length_of[code << (16 - length) : (code + 1) << (16 - length)] = length
    scans = [p[2].replace(b"\xff\x00", b"\xff") for p in parsed]
    starts = np.cumsum([0, *(len(s) + 4 for s in scans)])[:-1]
    data = np.frombuffer(b"".join(s + b"\xff\xff\xff\xff" for s in scans), np.uint8).astype(np.int64)
    word = np.zeros(len(data), np.int64)  # the 32 bits from each byte on
    for k in range(4):
        word[: len(data) - k] |= data[k:] << (24 - 8 * k)
    at, limit = starts * 8, (starts + np.array([len(s) for s in scans])) * 8
    out = np.empty((height * width, len(scans)), np.int64)
    for i in range(height * width):
        window = word[np.minimum(at >> 3, len(word) - 1)] << (at & 7)
        head = (window >> 16) & 0xFFFF
        size, length = symbol_of[head], length_of[head]
        if (size < 0).any():
            raise BadMedia("unknown code")
        extra = (window >> (32 - length - size)) & ((1 << size) - 1)
        diff = np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
        at = at + length + size
        before = 128 if i == 0 else out[i - width] if i % width == 0 else out[i - 1]
        out[i] = (before + diff) & 0xFFFF
    if (at > limit).any() or (out > 255).any():
        raise BadMedia("a scan ends early")
    return out.T.reshape(len(scans), height, width).astype(np.uint8)


def process_of(frame: bytes) -> int:
    """The marker of a JPEG frame's coding process."""
    at = 2
    while at + 4 <= len(frame) and frame[at] == 0xFF:
        if 0xC0 <= frame[at + 1] <= 0xCF and frame[at + 1] not in (DHT, 0xC8, 0xCC):
            return frame[at + 1]
        at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
    raise BadMedia("no frame header")


def zigzag() -> np.ndarray:
    """Place in a block of each coefficient in coding order: diagonals in turn, up and down."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


# The typical Huffman tables of ITU-T T.81, annex K.3, which motion-JPEG frames without tables of their own
# use: numbers of codes by length, and the first symbols; the symbols that are left follow in ascending order.
DC_COUNTS = {0: (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), 1: (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0)}
AC_COUNTS = {0: (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), 1: (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119)}
AC_FIRST = {
    0: "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82",
    1: "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1",
}


def default_tables() -> dict[int, dict[tuple[int, int], int]]:
    """The typical tables by class (0 DC, 16 AC) and number (0 luminance, 1 chrominance): (length, code) -> symbol."""
    every = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    out = {}
    for n in (0, 1):
        first = [int(x, 16) for x in AC_FIRST[n].split()]
        for kind, counts, symbols in ((0, DC_COUNTS[n], list(range(12))), (0x10, AC_COUNTS[n], first + sorted(set(every) - set(first)))):
            out[kind | n] = {(length, code): symbol for symbol, (code, length) in huffman_codes(list(counts), symbols).items()}
    return out


class _Bits:
    """Bits of entropy-coded bytes, most significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\xff\xff\xff", 0, 8 * len(data)

    def take(self, n: int) -> int:
        """The next n <= 16 bits as a number."""
        at = self.at
        self.at += n
        if self.at > self.end:
            raise BadMedia("a scan ends early")
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 3], "big") >> (24 - (at & 7) - n)) & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise BadMedia("unknown code")

    def signed(self, size: int) -> int:
        value = self.take(size) if size else 0
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def decode_baseline(frame: bytes) -> np.ndarray:
    """Luma samples (height, width) of a sequential Huffman-coded DCT frame of 8 bits. Tables it doesn't bring are the typical ones."""
    at, quant, tables, restart, parts = 2, {}, default_tables(), 0, []
    while True:
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise BadMedia("no scan")
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body, at = frame[at + 4 : at + 2 + size], at + 2 + size
        if marker == DQT:
            while body:
                wide, n = body[0] >> 4, body[0] & 15
                if len(body) < 65 + 64 * wide:
                    raise BadMedia("a quantisation table is too short")
                quant[n] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(float)
                body = body[65 + 64 * wide :]
        elif marker == DHT:
            while body:
                kind, counts = body[0], list(body[1:17])
                symbols = list(body[17 : 17 + sum(counts)])
                tables[kind] = {(length, code): symbol for symbol, (code, length) in huffman_codes(counts, symbols).items()}
                body = body[17 + sum(counts) :]
        elif marker == DRI:
            restart = struct.unpack(">H", body)[0]
        elif marker in (SOF0, SOF1):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise BadMedia("only 8-bit frames are decoded")
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif marker == SOS:
            uses = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            break
    if not parts or set(uses) != {p[0] for p in parts}:
        raise BadMedia("only one scan of all components is decoded")
    if not height or not width or any(not 1 <= x <= 4 for p in parts for x in p[1:3]) or any(p[3] not in quant for p in parts):
        raise BadMedia("a frame without size, sampling factors or quantisation tables")
    end = frame.rfind(bytes([0xFF, EOI]))
    pieces = re.split(rb"\xff[\xd0-\xd7]", frame[at : end if end > 0 else len(frame)])
    wide, tall = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * wide)), -(-height // (8 * tall))
    if across * down * 2 > 8 * (len(frame) - at):  # a block takes two symbols at least
        raise BadMedia("a scan is too short for its frame")
    order = zigzag()
    k = np.arange(8)
    basis = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    luma, fh, fv = np.zeros((down * parts[0][2] * 8, across * parts[0][1] * 8)), parts[0][1], parts[0][2]
    bits, last = _Bits(b""), {}
    for m in range(across * down):
        if m % (restart or across * down) == 0:
            piece = m // (restart or across * down)
            if piece >= len(pieces):
                raise BadMedia("a restart interval is missing")
            bits, last = _Bits(pieces[piece].replace(b"\xff\x00", b"\xff")), {p[0]: 0 for p in parts}
        for c, (name, h, v, q) in enumerate(parts):
            for b in range(h * v):
                dc, ac = tables[uses[name] >> 4], tables[0x10 | (uses[name] & 15)]
                block = np.zeros(64)
                last[name] += bits.signed(bits.symbol(dc))
                block[0] = last[name]
                i = 1
                while i < 64:
                    rs = bits.symbol(ac)
                    run, size = rs >> 4, rs & 15
                    if not size and run != 15:
                        break
                    i += run
                    if i > 63:
                        raise BadMedia("a block runs over its end")
                    block[i] = bits.signed(size)
                    i += 1
                if c == 0:
                    square = np.zeros(64)
                    square[order] = block * quant[q]
                    y, x = (m // across * fv + b // h) * 8, (m % across * fh + b % h) * 8
                    luma[y : y + 8, x : x + 8] = basis.T @ square.reshape(8, 8) @ basis + 128
    height_y, width_y = -(-height * fv // tall), -(-width * fh // wide)
    return np.clip(np.rint(luma), 0, 255).astype(np.uint8)[:height_y, :width_y]


def intra_frames(frames: list[bytes]) -> np.ndarray:
    """Gray samples (n, height, width) of motion-JPEG frames: lossless ones in step, baseline ones one by one."""
    if frames and process_of(frames[0]) in (SOF0, SOF1):
        made = [decode_baseline(f) for f in frames]
        if len({m.shape for m in made}) > 1:
            raise BadMedia("frames differ in shape")
        return np.stack(made)
    return decode_frames(frames)


def shots(samples: np.ndarray, fps: float = FPS) -> list[tuple[int, int, int, int]]:
    """Clips (first frame, frame after the last, start ms, end ms), cut where the gray histogram changes abruptly.

    The difference of neighbouring frames' histograms (half their L1 distance, 0 to 1) is held against the running
    mean and deviation of the clip so far; a cut needs SENSITIVITY deviations and at least FLOOR above the mean.
    """
    n = len(samples)
    if not n:
        return []
    flat = samples.reshape(n, -1).astype(np.int64) * HISTOGRAM_BINS // 256
    hist = np.bincount((flat + HISTOGRAM_BINS * np.arange(n)[:, None]).ravel(), minlength=n * HISTOGRAM_BINS).reshape(n, HISTOGRAM_BINS)
    diffs = (np.abs(np.diff(hist, axis=0)).sum(1) / (2 * flat.shape[1])).tolist()
    cuts, mean, var, seen = [0], 0.0, 0.0, 0
    for i, d in enumerate(diffs, 1):
        if d > FLOOR and (not seen or d > mean + SENSITIVITY * var**0.5 + FLOOR / 2):
            cuts.append(i)
            mean = var = 0.0
            seen = 0
            continue
        step = (1 - MEMORY) if seen else 1.0
        mean, var = mean + step * (d - mean), (1 - step) * (var + step * (d - mean) ** 2)
        seen += 1
    return [(a, b, round(a * 1000 / fps), round(b * 1000 / fps)) for a, b in zip(cuts, [*cuts[1:], n])]


def payload_of(text: bytes) -> bytes:
    """The text's bytes, filled with bytes 32 up to a positive multiple of a frame's samples."""
    return text + bytes([PAD]) * (-len(text) % FRAME if text else FRAME)


def store(texts: list[bytes]) -> list[bytes]:
    """An AVI file for each text: its payload as the samples of lossless frames."""
    payloads = [payload_of(t) for t in texts]
    counts = [len(p) // FRAME for p in payloads]
    frames = encode_frames(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, HEIGHT, WIDTH)) if payloads else []
    out, at = [], 0
    for n, text in zip(counts, texts):
        out.append(write_avi(frames[at : at + n], payload=len(text)))
        at += n
    return out


def read_back(files: list[bytes]) -> list[np.ndarray]:
    """The samples of each file's frames, parsed and decoded from its bytes alone."""
    parsed = [read_avi(f)[1] for f in files]
    samples = decode_frames([f for frames in parsed for f in frames])
    ends = np.cumsum([0, *map(len, parsed)])
    return [samples[a:b] for a, b in zip(ends, ends[1:])]


def clips(media: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """Timed clip rows of AVI motion-JPEG bytes: key, clip, first_frame, end_frame, start_ms, end_ms, error.

    Frames are found through the RIFF index and decoded as intra frames. Null bytes give no rows; bytes that can't be
    decoded, for whatever damage, give one row that has only key and error. A file of no frames gives no rows, and so does
    an empty table. Null keys and repeated rows are returned as they are; other columns are not read.
    """
    schema = f"{key} long, clip int, first_frame int, end_frame int, start_ms long, end_ms long, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows = []
            for k, data in zip(batch.column("k").to_pylist(), batch.column("media").to_pylist()):
                if data is None:
                    continue
                try:
                    head, frames = read_avi(data)  # frames are slices; pixels are bounded by the file's own bytes
                    fps = head["rate"] / head["scale"] if head.get("scale") and head.get("rate") else 1e6 / (head.get("us_per_frame") or 40_000)
                    rows += [(k, i, *x, None) for i, x in enumerate(shots(intra_frames(frames), fps))]
                except Exception as e:  # whatever is wrong with one file is that file's row
                    rows.append((k, None, None, None, None, None, str(e) if isinstance(e, BadMedia) else f"{type(e).__name__}: {e}"))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [c.split()[0] for c in schema.split(", ")])

    return media.select(F.col(key).cast("long").alias("k"), F.col(column).cast("binary").alias("media")).mapInArrow(run, schema)


def encode_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each document's text as an AVI file. Null text counts as empty; repeated rows are each stored.

    A null doc_id is returned as null, an empty table gives no rows, columns besides doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            made = store([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def feature_of(samples: np.ndarray) -> str:
    """Frames, clips, and the clips' times, as text."""
    found = shots(samples)
    return f"frames={len(samples)};clips={len(found)};" + ",".join(f"{a}-{b}" for _, _, a, b in found)


def digest(docs: DataFrame) -> DataFrame:
    """Store each document's text as AVI bytes, read them back, and describe both: one row per document (see DIGEST).

    Files are made, decoded and dropped within a bounded slice, so nothing is shuffled. Null or empty text: a payload
    of one frame of blanks, n_bytes 0. Null doc_id: returned as null. Repeated rows are each returned. An empty table
    gives no rows. Columns besides doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            files = store(texts)
            columns: list[list] = [[] for _ in range(7)]
            for text, file, samples in zip(texts, files, read_back(files)):
                back = samples.tobytes()
                values = (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature_of(samples))
                for column, value in zip(columns, values):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, kinds)], [c.split()[0] for c in DIGEST.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DIGEST)
