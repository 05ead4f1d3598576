"""Exact ids of a byte-level BPE, fast: chunks between spaces are encoded once per worker and looked up afterwards.

A pre-token of this vocabulary starts at a space or inside a run without spaces, so that a text whose runs of white space
are at most one character long is the concatenation of its chunks, each with the space before it. Other texts, and those
that hold a special token's string, go to the tokenizer whole. tests/llm compare both ways.
"""

from __future__ import annotations

import re
from array import array

_RUN = re.compile(r"\s\s")
#: Chunks that a worker remembers; beyond it the memory is emptied. Bounds the memory, not the result.
REMEMBERED = 300_000


class _Chunks(dict):
    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = array("I", self.encode(" " + chunk)).tobytes()
        if len(chunk) <= 40:
            self[chunk] = ids
        return ids


class Encoder:
    """ids(text): the ids as little-endian unsigned 32-bit integers, those of Tokenizer.encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        special = [t["content"] for t in said["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        byte = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(byte[c] for c in t): i for t, i in said["model"]["vocab"].items() if t not in special}
        import public_tokenizers

        core = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = core.encode_ordinary
        self.chunks = _Chunks(self.encode)

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.special and self.special.search(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if _RUN.search(text):
            return array("I", self.encode(text)).tobytes()
        first, *rest = text.split(" ")
        head = array("I", self.encode(first)).tobytes() if first else b""
        return head + b"".join(map(self.chunks.__getitem__, rest))


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
