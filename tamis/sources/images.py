"""Pictures: what their headers say, frames of TIFF files, and the texts of an OCR back end.

read(file, frame) is the back end: it gives the lines of a frame with their scores, 0 to 1."""

from __future__ import annotations

import struct
from collections.abc import Callable

Lines = list[tuple[str, float]]
#: Tags of TIFF and EXIF that are kept.
TAGS = {0x010E: "description", 0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x0131: "software", 0x0132: "modified", 0x013B: "artist", 0x8298: "copyright", 0x9003: "taken"}
MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}


def _tiff(data: bytes, most: int = 10_000) -> tuple[list[dict[int, object]], dict[str, str]]:
    """(tags of each frame, named tags of the first) of a TIFF file or EXIF block."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}

    def directory(at: int) -> tuple[dict[int, object], int]:
        (n,) = struct.unpack_from(f"{order}H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
            place, size = at + 10 + 12 * k, sizes.get(kind, 1) * count
            if size > 4:
                (place,) = struct.unpack_from(f"{order}I", data, place)
            if kind == 2:
                tags[tag] = data[place : place + count].split(b"\0")[0].decode("latin-1").strip()
            elif kind in (3, 4):
                tags[tag] = struct.unpack_from(f"{order}{'H' if kind == 3 else 'I'}", data, place)[0]
            elif kind == 5:
                a, b = struct.unpack_from(f"{order}II", data, place)
                tags[tag] = a / b if b else 0.0
        return tags, struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]

    frames, seen, at = [], set(), struct.unpack_from(f"{order}I", data, 4)[0]
    while at and at not in seen and len(frames) < most:
        seen.add(at)
        tags, at = directory(at)
        frames.append(tags)
    named = dict(frames[0]) if frames else {}
    if isinstance(named.get(0x8769), int):
        named |= directory(named[0x8769])[0]
    return frames, {name: str(named[tag]) for tag, name in TAGS.items() if tag in named}


def _jpeg(data: bytes) -> dict[str, str]:
    at, out = 2, {}
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if mark == 0xE1 and body.startswith(b"Exif\0\0"):
            try:
                out |= {f"exif_{k}": v for k, v in _tiff(body[6:])[1].items()}
            except (ValueError, struct.error):
                pass
        elif mark == 0xE0 and body.startswith(b"JFIF\0") and body[7] == 1:
            out["dpi"] = f"{struct.unpack_from('>H', body, 8)[0]}x{struct.unpack_from('>H', body, 10)[0]}"
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", body, 1)
            return out | {"width": str(width), "height": str(height), "mode": {1: "L", 4: "CMYK"}.get(body[5], "RGB")}
        at += 2 + size
    raise ValueError("a JPEG without a frame")


def metadata(data: bytes) -> dict[str, str]:
    """format, width, height, mode, frames, size_bytes, and dpi and EXIF tags where there are any."""
    out = {"size_bytes": str(len(data)), "frames": "1"}
    if data.startswith(b"\x89PNG\r\n\x1a\n"):
        width, height, depth, color = struct.unpack_from(">IIBB", data, 16)
        out |= {"format": "PNG", "width": str(width), "height": str(height), "mode": "1" if depth == 1 and color == 0 else MODES.get(color, "L")}
        at = data.find(b"pHYs")
        if at > 0 and data[at + 12] == 1:
            out["dpi"] = "x".join(str(round(v * 0.0254)) for v in struct.unpack_from(">II", data, at + 4))
    elif data.startswith(b"\xff\xd8"):
        out |= {"format": "JPEG"} | _jpeg(data)
    elif data[:6] in (b"GIF87a", b"GIF89a"):
        width, height = struct.unpack_from("<HH", data, 6)
        out |= {"format": "GIF", "width": str(width), "height": str(height), "mode": "P"}
    elif data.startswith(b"BM"):
        width, height, _, bits = struct.unpack_from("<iiHH", data, 18)
        out |= {"format": "BMP", "width": str(width), "height": str(abs(height)), "mode": {1: "1", 8: "P"}.get(bits, "RGB")}
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        kind = data[12:16]
        if kind == b"VP8X":
            width, height = (int.from_bytes(data[a : a + 3], "little") + 1 for a in (24, 27))
        elif kind == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            width, height = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        else:
            width, height = (v & 0x3FFF for v in struct.unpack_from("<HH", data, 26))
        out |= {"format": "WEBP", "width": str(width), "height": str(height), "mode": "RGB"}
    else:
        frames, named = _tiff(data)
        first = frames[0] if frames else {}
        out |= {"format": "TIFF", "width": str(first.get(256, 0)), "height": str(first.get(257, 0)), "mode": "RGB" if first.get(277) == 3 else "L", "frames": str(len(frames))}
        out |= {f"exif_{k}": v for k, v in named.items()}
        if 282 in first and 283 in first:
            out["dpi"] = f"{round(first[282])}x{round(first[283])}"
    return out


def weight(text: str) -> int:
    return sum(not c.isspace() for c in text)


def of_lines(lines: Lines) -> tuple[str, float]:
    """(text, confidence from 0 to 100): the scores' mean, each weighted by its line's characters."""
    kept = [(t.strip(), min(max(s, 0.0), 1.0)) for t, s in lines if t.strip()]
    total = sum(max(1, weight(t)) for t, _ in kept)
    return "\n".join(t for t, _ in kept), 100 * sum(s * max(1, weight(t)) for t, s in kept) / total if total else 0.0


def of_frames(frames: list[tuple[str, float]]) -> tuple[str, float]:
    """(text, confidence) of a file's frames: weighted by their characters, all alike if none has any."""
    total = sum(weight(t) for t, _ in frames)
    mean = sum(c * weight(t) for t, c in frames) / total if total else sum(c for _, c in frames) / max(len(frames), 1)
    return "\n\n".join(t for t, _ in frames if t), mean


def image(data: bytes, read: Callable[[bytes, int], Lines], faces: Callable[[bytes], int] | None = None) -> tuple[str, dict[str, str]]:
    """(text, metadata with ocr_attempted, ocr_confidence and faces_detected). All frames of a TIFF file are read, of others the first."""
    known = metadata(data)
    frames = int(known["frames"]) if known["format"] == "TIFF" else 1
    text, confidence = of_frames([of_lines(read(data, k)) for k in range(frames)])
    found = {"faces_detected": str(faces(data))} if faces else {}
    return text, known | found | {"ocr_attempted": "true", "ocr_confidence": f"{confidence:.4f}"}
