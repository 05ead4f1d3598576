"""AVI motion-JPEG: write and parse RIFF files, code and decode intra frames, and detect shots.

Frames that this module writes are lossless JPEG (ITU T.81, process 14: predictive coding of 8-bit samples with Huffman codes).
Of other files, baseline frames (sequential DCT, 8-bit samples, grey or YCbCr) are decoded to their luma. Each frame stands
alone, so that any can be decoded from its index entry. Frames are decoded side by side: one step decodes the next sample of
all frames of a block with one table lookup each.
"""

from __future__ import annotations

import re
import struct

import numpy as np

#: Differences of 8-bit samples are in categories 0 to 8; these nine have codes of four bits, 0000 to 1000.
CATEGORIES, CODE_BITS = 9, 4
WINDOW = CODE_BITS + 8
#: Frames that are coded or decoded side by side.
BLOCK = 4096
#: Classes of the histograms by which shots are told apart.
BINS = 16


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    code, bits = np.zeros(511, np.int64), np.zeros(511, np.int64)
    value, used = np.zeros(1 << WINDOW, np.int16), np.zeros(1 << WINDOW, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        extra = d if d > 0 else d + (1 << size) - 1 if d < 0 else 0
        n, c = CODE_BITS + size, size << size | extra
        code[d + 255], bits[d + 255] = c, n
        at = c << (WINDOW - n)
        value[at : at + (1 << (WINDOW - n))], used[at : at + (1 << (WINDOW - n))] = d, n
    return code, bits, value, used


CODE, BITS, VALUE, USED = _tables()


def jpeg_header(width: int, height: int) -> bytes:
    counts = [0, 0, 0, CATEGORIES, *[0] * 12]
    dht = struct.pack(">HB", 19 + CATEGORIES, 0) + bytes(counts) + bytes(range(CATEGORIES))
    sof = struct.pack(">HBHHB", 11, 8, height, width, 1) + bytes([1, 0x11, 0])
    sos = struct.pack(">HB", 8, 1) + bytes([1, 0, 1, 0, 0])  # predictor 1: the sample to the left
    return b"\xff\xd8\xff\xc4" + dht + b"\xff\xc3" + sof + b"\xff\xda" + sos


def _predicted(frames: np.ndarray) -> np.ndarray:
    """Differences to the prediction: the left sample; in the first column the one above; 128 at the start."""
    d = np.empty(frames.shape, np.int16)
    d[:, :, 1:] = frames[:, :, 1:].astype(np.int16) - frames[:, :, :-1]
    d[:, 1:, 0] = frames[:, 1:, 0].astype(np.int16) - frames[:, :-1, 0]
    d[:, 0, 0] = frames[:, 0, 0].astype(np.int16) - 128
    return d


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """JPEG files of frames, an array (n, height, width) of bytes."""
    out: list[bytes] = []
    head = jpeg_header(frames.shape[2], frames.shape[1])
    for at in range(0, len(frames), BLOCK):
        some = frames[at : at + BLOCK]
        d = _predicted(some).reshape(len(some), -1).astype(np.int64) + 255
        code, bits = CODE[d], BITS[d]
        ends = np.cumsum(bits, axis=1)
        size = (ends[:, -1] + 7) // 8  # bytes of each scan
        first = np.concatenate([[0], np.cumsum(size)])
        pos = (ends - bits + 8 * first[:-1, None]).ravel()
        word = code.ravel() << (24 - (pos & 7) - bits.ravel())
        byte, n = pos >> 3, int(first[-1])
        scan = np.zeros(n + 2)
        for k, shift in enumerate((16, 8, 0)):
            scan += np.bincount(byte + k, (word >> shift) & 255, minlength=n + 2)[: n + 2]
        scan = scan[:n].astype(np.uint8)
        # the last byte is filled with ones; a byte 255 is followed by 0
        scan[first[1:] - 1] |= ((1 << (8 * size - ends[:, -1])) - 1).astype(np.uint8)
        full = np.flatnonzero(scan == 255)
        stuffed = np.insert(scan, full + 1, 0).tobytes()
        moved = first + np.searchsorted(full, first)
        out += [head + stuffed[a:b] + b"\xff\xd9" for a, b in zip(moved[:-1], moved[1:], strict=True)]
    return out


def parse_jpeg(data: bytes) -> tuple[int, int, int]:
    """(width, height, start of the scan) of a lossless grey frame with the tables above; ValueError for any other."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, width, height, table = 2, 0, 0, b""
    while at + 4 <= len(data):
        mark, n = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if mark == 0xC3:
            depth, height, width, parts = struct.unpack(">BHHB", body[:6])
            if (depth, parts) != (8, 1):
                raise ValueError("frames of 8-bit grey samples only")
        elif mark == 0xC4:
            table = body
        elif mark == 0xDA:
            if not width or table[4] != CATEGORIES or list(table[17:]) != list(range(CATEGORIES)) or body[3] != 1:
                raise ValueError("another Huffman table or predictor")
            return width, height, at
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise ValueError("not a lossless frame")
    raise ValueError("no scan")


def decode_frames(files: list[bytes]) -> np.ndarray:
    """The frames of JPEG files of one size, as an array (n, height, width)."""
    if not files:
        return np.zeros((0, 0, 0), np.uint8)
    out, known = [], {}
    for at in range(0, len(files), BLOCK):
        some = files[at : at + BLOCK]
        scans = []
        for f in some:
            # frames of one camera have one header; it is parsed once
            start = known.get(f[:60])
            if start is None:
                width, height, start = parse_jpeg(f)
                if known and (width, height) != (w, h):  # noqa: F821
                    raise ValueError("frames differ in size")
                w, h = width, height
                known[f[:60]] = start
            scans.append(f[start:-2])
        sizes = np.array([len(s) for s in scans])
        raw = np.frombuffer(b"".join(scans), np.uint8)
        first = np.concatenate([[0], np.cumsum(sizes)])
        zero = np.flatnonzero((raw[1:] == 0) & (raw[:-1] == 255)) + 1
        data = np.delete(raw, zero)
        first = first - np.searchsorted(zero, first)
        padded = np.concatenate([data, np.full(4, 255, np.uint8)]).astype(np.int32)
        words = padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]
        pos = first[:-1] * 8
        samples = np.empty((h * w, len(some)), np.uint8)
        top = np.full(len(some), 128, np.int16)
        for k in range(h * w):
            c = (words[pos >> 3] >> (24 - WINDOW - (pos & 7))) & ((1 << WINDOW) - 1)
            left = top if k % w == 0 else left  # noqa: F821
            left = left + VALUE[c]
            pos = pos + USED[c]
            samples[k] = left
            if k % w == 0:
                top = left
        out.append(samples.T.reshape(len(some), h, w))
    return np.concatenate(out)


def _run(*parts: str) -> bytes:
    """Bytes of hexadecimal numbers, and of ranges of them."""
    return bytes(x for p in " ".join(parts).split() for a, b in [(p.split("-") * 2)[:2]] for x in range(int(a, 16), int(b, 16) + 1))


_TAIL = "83-8a 92-9a a2-aa b2-ba c2-ca d2-da"
#: The tables that motion-JPEG frames without own ones use (T.81, annex K): class << 4 | number: counts of lengths, symbols.
DEFAULT_TABLES = {
    0x00: (_run("00 01 05 01 01 01 01 01 01 00 00 00 00 00 00 00"), bytes(range(12))),
    0x01: (_run("00 03 01 01 01 01 01 01 01 01 01 00 00 00 00 00"), bytes(range(12))),
    0x10: (
        _run("00 02 01 03 03 02 04 03 05 05 04 04 00 00 01 7d"),
        _run("01-03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a", "16-1a 25-2a 34-3a 43-4a 53-5a 63-6a 73-7a", _TAIL, "e1-ea f1-fa"),
    ),
    0x11: (
        _run("00 02 01 02 04 04 03 04 07 05 04 04 00 01 02 77"),
        _run("00-03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1", "17-1a 26-2a 35-3a 43-4a 53-5a 63-6a 73-7a 82", _TAIL, "e2-ea f2-fa"),
    ),
}
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
_COSINES = np.array([[np.sqrt((2 if u else 1) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
_HUFFMAN: dict[tuple[bytes, bytes], list] = {}


def _lookup(counts: bytes, symbols: bytes) -> list:
    """(length, symbol) of the code that any 16 bits begin with; None where there is none."""
    found = _HUFFMAN.get((counts, symbols))
    if found is None:
        if len(_HUFFMAN) >= 16:
            _HUFFMAN.clear()
        found, code, k = [None] * 65536, 0, 0
        for n, many in enumerate(counts, 1):
            for _ in range(many):
                found[code << (16 - n) : (code + 1) << (16 - n)] = [(n, symbols[k])] * (1 << (16 - n))
                code, k = code + 1, k + 1
            code <<= 1
        if len(found) != 65536:
            raise ValueError("not a Huffman table")
        _HUFFMAN[counts, symbols] = found
    return found


def is_baseline(data: bytes) -> bool:
    """Whether the first frame header is that of a sequential DCT frame with Huffman codes."""
    at = 2
    while at + 4 <= len(data) and data[at] == 255 and data[at + 1] != 0xDA:
        if data[at + 1] in (0xC0, 0xC1):
            return True
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return False


def decode_baseline(data: bytes) -> np.ndarray:
    """The luma of a baseline frame. Of two fields in one chunk the rows are interleaved."""
    fields, at = [], 0
    while data[at : at + 2] == b"\xff\xd8":
        luma, at = _field(data, at + 2)
        fields.append(luma)
        again = data.find(b"\xff\xd8\xff", at)
        at = again if again >= 0 else len(data)
    if not fields:
        raise ValueError("not a JPEG file")
    if len({f.shape for f in fields}) > 1:
        raise ValueError("fields differ in size")
    return np.stack(fields, 1).reshape(-1, fields[0].shape[1])


def _field(data: bytes, at: int) -> tuple[np.ndarray, int]:
    tables, quants, restart, parts = dict(DEFAULT_TABLES), {}, 0, {}
    while at + 4 <= len(data):
        if data[at] != 255:
            raise ValueError("no marker")
        mark = data[at + 1]
        if mark == 255:
            at += 1
            continue
        n = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(float)
                body = body[65 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                end = 17 + sum(body[1:17])
                tables[body[0]] = body[1:17], body[17:end]
                body = body[end:]
        elif mark in (0xC0, 0xC1):
            depth, height, width, many = struct.unpack(">BHHB", body[:6])
            if depth != 8 or many not in (1, 3) or not height or not width:
                raise ValueError("frames of 8-bit grey or YCbCr samples only")
            parts = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(many)}
            first = body[6]
        elif 0xC2 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise ValueError("neither a lossless nor a baseline frame")
        elif mark == 0xEE and body[:5] == b"Adobe" and body[11:12] == b"\0" and len(parts) != 1:
            raise ValueError("RGB frames aren't decoded")
        elif mark == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif mark == 0xDA:
            scan = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
            stop = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(data, at)
            end = stop.start() if stop else len(data)
            if first in [c for c, _ in scan]:
                luma = _luma(data[at:end], scan, parts, tables, quants, restart, first, width, height)
                return luma, end
            at = end
    raise ValueError("no scan")


def _luma(raw: bytes, scan, parts, tables, quants, restart: int, first: int, width: int, height: int) -> np.ndarray:
    h, v, q = parts[first]
    wide, high = max(p[0] for p in parts.values()), max(p[1] for p in parts.values())
    if (h, v) != (wide, high):
        raise ValueError("luma of less than full size")
    if len(scan) == 1:
        h = v = 1
    columns, rows = -(-width // (8 * h)), -(-height // (8 * v))
    order = []
    for c, t in scan:
        times = (h * v) if c == first else parts[c][0] * parts[c][1]
        order += [(c, _lookup(*tables[t >> 4]), _lookup(*tables[0x10 | t & 15]))] * times
    blocks, total = np.zeros((rows * columns * h * v, 64)), rows * columns
    segments = [x.replace(b"\xff\x00", b"\xff") for x in re.split(rb"\xff[\xd0-\xd7]", raw)]
    done = at = 0
    for segment in segments:
        pos, before, limit = 0, {c: 0 for c, _ in scan}, 8 * len(segment)
        segment += b"\xff" * 8

        def bits(n):
            return int.from_bytes(segment[pos >> 3 : (pos >> 3) + 5], "big") >> (40 - n - (pos & 7)) & ((1 << n) - 1)  # noqa: B023

        for _ in range(min(restart or total, total - done)):
            for c, dc, ac in order:
                code = dc[bits(16)]
                k, own = 0, at if c == first else -1
                while True:
                    if code is None or pos > limit:
                        raise ValueError("a broken scan")
                    pos += code[0]
                    zeros, size = (code[1] >> 4, code[1] & 15) if k else (0, code[1])
                    if k and not size and zeros != 15:
                        break
                    k += zeros
                    value = bits(size) if size else 0
                    pos += size
                    if size and not value >> (size - 1):
                        value -= (1 << size) - 1
                    if k == 0:
                        value = before[c] = before[c] + value
                    if k > 63 or pos > limit:
                        raise ValueError("a broken scan")
                    if own >= 0 and value:
                        blocks[own, k] = value
                    k += 1
                    if k == 64:
                        break
                    code = ac[bits(16)]
                at += own >= 0
            done += 1
    if done < total:
        raise ValueError("a broken scan")
    square = np.zeros_like(blocks)
    square[:, ZIGZAG] = blocks * quants[q]
    samples = np.clip(np.rint(_COSINES.T @ square.reshape(-1, 8, 8) @ _COSINES + 128), 0, 255).astype(np.uint8)
    return samples.reshape(rows, columns, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(rows * v * 8, columns * h * 8)[:height, :width]


def shots_of(files: list[bytes]) -> list[tuple[int, int]]:
    """The shots of a file's frames. Baseline frames are decoded one by one; an empty chunk repeats the frame before it."""
    kind = next((f for f in files if f), b"")
    if not is_baseline(kind):
        return shots(decode_frames(files))
    hist, shape = [], None
    for f in files:
        if f or not hist:
            luma = decode_baseline(f)
            if shape not in (None, luma.shape):
                raise ValueError("frames differ in size")
            shape = luma.shape
            now = np.bincount(luma.ravel().astype(np.int64) * BINS // 256, minlength=BINS)
        hist.append(now)
    return cuts(np.array(hist), luma.size)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int, height: int, fps: int = 25) -> bytes:
    """An AVI file of JPEG frames with its index."""
    n, largest = len(frames), max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, n, 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    sizes = np.array([len(f) for f in frames], dtype=np.int64)
    steps = 8 + sizes + (sizes & 1)
    index = np.zeros((n, 4), "<u4")
    index[:, 0], index[:, 1] = struct.unpack("<I", b"00dc")[0], 0x10
    index[:, 2], index[:, 3] = 4 + np.cumsum(steps) - steps, sizes
    movi = _chunk(b"LIST", b"movi" + b"".join([_chunk(b"00dc", f) for f in frames]))
    return _chunk(b"RIFF", b"AVI " + hdrl + movi + _chunk(b"idx1", index.tobytes()))


def read_avi(data: bytes) -> tuple[list[bytes], int]:
    """(frames, microseconds per frame), by the file's index; without one, by walking the movie's chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    end, at = min(len(data), 8 + struct.unpack("<I", data[4:8])[0]), 12
    micros, movi, index = 0, None, None
    while at + 8 <= end:
        name, n = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        kind = data[at + 8 : at + 12] if name == b"LIST" else b""
        if kind == b"hdrl":
            head = data.find(b"avih", at, at + 8 + n)
            micros = struct.unpack("<I", data[head + 8 : head + 12])[0] if head > 0 else 0
        elif kind == b"movi":
            movi = at + 8, at + 8 + n
        elif name == b"idx1":
            index = np.frombuffer(data[at + 8 : at + 8 + n // 16 * 16], "<u4").reshape(-1, 4)
        at += 8 + n + (n & 1)
    if movi is None:
        raise ValueError("an AVI file without frames")
    if index is None:
        frames, at = [], movi[0] + 4
        while at + 8 <= movi[1]:
            n = struct.unpack("<I", data[at + 4 : at + 8])[0]
            if data[at + 2 : at + 4] in (b"dc", b"db"):
                frames.append(data[at + 8 : at + 8 + n])
            at += 8 + n + (n & 1)
        return frames, micros
    video = index[np.isin(index[:, 0] >> 16, [0x6364, 0x6264])]
    base = movi[0] if not len(video) or data[movi[0] + int(video[0, 2]) + 2 : movi[0] + int(video[0, 2]) + 4] in (b"dc", b"db") else 0
    return [data[base + o + 8 : base + o + 8 + n] for o, n in video[:, 2:].tolist()], micros


def shots(frames: np.ndarray, bins: int = BINS, window: int = 8, factor: float = 2.0, least: float = 0.25) -> list[tuple[int, int]]:
    """(first frame, end) of each shot. A cut is where the difference of neighbours' histograms (0 to 1) is over `least` and
    over `factor` times the mean difference of the `window` frames before and after."""
    n = len(frames)
    if n == 0:
        return []
    flat = frames.reshape(n, -1).astype(np.int64) * bins // 256 + np.arange(n)[:, None] * bins
    hist = np.bincount(flat.ravel(), minlength=n * bins).reshape(n, bins)
    return cuts(hist, frames[0].size, window, factor, least)


def cuts(hist: np.ndarray, size: int, window: int = 8, factor: float = 2.0, least: float = 0.25) -> list[tuple[int, int]]:
    """shots, by the frames' histograms of `size` samples."""
    n = len(hist)
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2.0 * size)
    run = np.concatenate([[0.0], np.cumsum(diff)])
    k = np.arange(n - 1)
    low, high = np.maximum(k - window, 0), np.minimum(k + window + 1, n - 1)
    around = (run[high] - run[low] - diff) / np.maximum(high - low - 1, 1)
    at = [0, *(np.flatnonzero((diff > least) & (diff > factor * around)) + 1).tolist(), n]
    return list(zip(at[:-1], at[1:], strict=True))
