"""Media columns: clips of AVI motion-JPEG files, and documents stored as such files.

`clips` takes rows with the bytes of AVI files and yields a row per shot. `document_media` stores texts losslessly as 8-bit
samples of 24 x 24 frames, reads the stored file back through the same parser and decoder, and describes it.

Defined results: a null or empty text is one frame of padding; a file that isn't a whole motion-JPEG AVI of lossless or baseline frames
yields one clip row with its error and no times; null bytes do so too; an empty table gives an empty result. A batch holds
as many rows as Arrow gives it; very long texts are coded in blocks of frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import mjpeg
from .store import table

SIDE = 24
FRAME = SIDE * SIDE
CLIPS = "id long, clip int, start_ms double, end_ms double, first_frame int, n_frames int, error string"
MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, n_shots int"


def clips(media: DataFrame, id_column: str = "id", bytes_column: str = "media") -> DataFrame:
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, data in zip(b["id"], b["media"], strict=True):
                try:
                    files, micros = mjpeg.read_avi(bytes(data or b""))
                    for k, (first, end) in enumerate(mjpeg.shots_of(files)):
                        rows.append((key, k, first * micros / 1000, end * micros / 1000, first, end - first, None))
                except (ValueError, IndexError, KeyError, OverflowError, struct.error) as e:
                    rows.append((key, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["id", "clip", "start_ms", "end_ms", "first_frame", "n_frames", "error"]).astype({"id": "Int64", "clip": "Int32", "first_frame": "Int32", "n_frames": "Int32"})

    return media.selectExpr(f"cast(`{id_column}` as long) as id", f"`{bytes_column}` as media").mapInPandas(of, CLIPS)


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    size = max(FRAME, -(-len(raw) // FRAME) * FRAME)
    return len(raw), raw + b"\xff" * (size - len(raw))


def stored(payload: bytes) -> bytes:
    frames = np.frombuffer(payload, np.uint8).reshape(-1, SIDE, SIDE)
    return mjpeg.write_avi(mjpeg.encode_frames(frames), SIDE, SIDE)


def document_media(docs: DataFrame) -> DataFrame:
    """The digest columns of each document's file; payloads are what the decoder gives from the stored bytes."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [padded(t) for t in b["text"]]
            rows, at = [], 0
            while at < len(parts):
                # texts of about a block's frames are coded together
                end, frames = at, 0
                while end < len(parts) and (end == at or frames + len(parts[end][1]) // FRAME <= mjpeg.BLOCK):
                    frames += len(parts[end][1]) // FRAME
                    end += 1
                rows += described(b["doc_id"].iloc[at:end], parts[at:end])
                at = end
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEDIA.split(", ")]).astype({"doc_id": "Int64"})

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInPandas(of, MEDIA)


def described(ids, parts: list[tuple[int, bytes]]) -> list[tuple]:
    coded = mjpeg.encode_frames(np.frombuffer(b"".join(p for _, p in parts), np.uint8).reshape(-1, SIDE, SIDE))
    files, at = [], 0
    for _, p in parts:
        files.append(mjpeg.write_avi(coded[at : at + len(p) // FRAME], SIDE, SIDE))
        at += len(p) // FRAME
    read = [mjpeg.read_avi(f)[0] for f in files]
    frames = mjpeg.decode_frames([x for r in read for x in r])
    rows, at = [], 0
    for key, (n, _), file, r in zip(ids, parts, files, read, strict=True):
        own = frames[at : at + len(r)]
        at += len(r)
        payload = own.tobytes()
        cuts = mjpeg.shots(own)
        feature = f"{len(cuts)}:" + ",".join(str(first) for first, _ in cuts)
        rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature, len(r), len(cuts)))
    return rows


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(table(spark, sf_dir, "documents"))
