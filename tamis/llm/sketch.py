"""Shingle sets of texts as sorted 64-bit hashes, and their fast similarity sketches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are hashed at once; bounds memory. Longer texts are hashed in parts, longer words whole.
BLOCK = 1 << 20
_SEPARATORS = [9, 10, 11, 12, 13, 32]
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """of(texts): for each text, hashes of the distinct shingles of `width` words (A-Z in lower case), sorted. A text of fewer
    words has its whole sequence as one; a text without words has none.

    A word's hash is the mixed sum of byte value x power of its place, counted from the word's first byte. Sums are taken for
    whole blocks of texts at once: separators count as 0, so that what lies between two words' first bytes is the first word."""

    def __init__(self, width: int = 4):
        self.width = width
        values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD[5]))
        values[65:91] = values[97:123]
        values[_SEPARATORS] = 0
        self.values = values
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.odd = np.array([_ODD[k % len(_ODD)] + 2 * (k // len(_ODD)) for k in range(width)], np.uint64)

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        texts = texts.cast(pa.large_binary())
        if texts.null_count:
            texts = pc.fill_null(texts, b"")
        n = len(texts)
        if not n:
            return
        _, cuts, data = texts.buffers()
        cuts = np.frombuffer(cuts, np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + BLOCK, "right")) - 1)
            yield from self._sets(data[cuts[at] : cuts[to]], cuts[at : to + 1] - cuts[at])
            at = to

    def _sets(self, data: np.ndarray, cuts: np.ndarray) -> Iterator[np.ndarray]:
        if len(data) > BLOCK:  # one long text
            words = np.concatenate([self._words(x, np.array([0, len(x)]))[0] for x in _parts(data)])
            first = np.array([0, len(words)])
        else:
            words, first = self._words(data, cuts)
        m = max(0, len(words) - self.width + 1)
        s = np.zeros(m, np.uint64)
        for k in range(self.width):
            s += words[k : k + m] * self.odd[k]
        s = mix(s)
        for i, j in pairwise(first.tolist()):
            if j - i >= self.width:
                own = np.sort(s[i : j - self.width + 1])
                yield own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif j > i:
                missing = np.array([(self.width - j + i) * _ODD[7] % 2**64], np.uint64)
                yield mix((words[i:j] * self.odd[: j - i]).sum(keepdims=True) + missing)
            else:
                yield np.zeros(0, np.uint64)

    def _words(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of data, and how many of them begin before each cut."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(cuts), np.int64)
        while len(self.powers) < n:
            self.powers, self.inverses = (np.concatenate((x, x * np.uint64(pow(r, len(x), 2**64)))) for x, r in ((self.powers, _ODD[6]), (self.inverses, pow(_ODD[6], -1, 2**64))))
        value = self.values[data]
        begins = value != 0
        inner = cuts[cuts < n]
        at_cuts = begins[inner]
        begins[1:] &= ~begins[:-1]
        begins[inner] = at_cuts
        starts = np.flatnonzero(begins)
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(len(cuts), np.int64)
        value *= self.powers[:n]
        return mix(np.add.reduceat(value, starts) * self.inverses[starts]), np.searchsorted(starts, cuts)


def _parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of about BLOCK bytes, cut at separators alone."""
    cuts = np.flatnonzero(np.isin(data, _SEPARATORS))
    at = 0
    while at < len(data):
        k = np.searchsorted(cuts, at + BLOCK)
        to = int(cuts[k]) + 1 if k < len(cuts) else len(data)
        yield data[at:to]
        at = to


def fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


class Sketcher:
    """Fast similarity sketching: in round i below t, each element throws the value i + fraction into one hashed bin, and a bin
    keeps its least; in rounds t to 2t - 1 every element throws into bin i - t, so that every bin is filled after 2t rounds.
    Rounds end when all bins are filled, which takes about t ln t / |set| of them. Coordinates of two sets agree with
    probability J, and their mean is concentrated about J as it is for independent samples."""

    def __init__(self, t: int, seed: int = 0x5EED):
        self.t = t
        self.seeds = mix(np.arange(1, 2 * t + 1, dtype=np.uint64) * np.uint64(_ODD[0]) + np.uint64(seed))

    def of(self, s: np.ndarray) -> np.ndarray:
        t, n = self.t, len(s)
        full = np.uint64(2**64 - 1)
        bins = np.full(t, full, np.uint64)
        done = 0
        while done < 2 * t:
            rounds = min(2 * t - done, max(1, int(1.2 * t * np.log(t) / n)))
            if done < t < done + rounds:
                rounds = t - done
            h = mix(s[None, :] ^ self.seeds[done : done + rounds, None])
            at = np.arange(done, done + rounds, dtype=np.uint64)[:, None]
            value = at << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
            if done < t:
                where = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
                np.minimum.at(bins, where.ravel(), value.ravel())
            else:
                own = slice(done - t, done - t + rounds)
                bins[own] = np.minimum(bins[own], value.min(axis=1))
            done += rounds
            if (bins != full).all():
                break
        return bins


def band_keys(bins: np.ndarray, rows: int) -> np.ndarray:
    """For each row of bins, a 64-bit key of each band of `rows` coordinates; keys of different bands differ too."""
    parts = bins.reshape(len(bins), -1, rows)
    key = np.tile(np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * np.uint64(_ODD[4]), (len(bins), 1))
    for k in range(rows):
        key = mix(key ^ mix(parts[:, :, k] + np.uint64(_ODD[k % len(_ODD)])))
    return key.view(np.int64)


def one_byte(bins: np.ndarray) -> np.ndarray:
    return (mix(bins) & np.uint64(255)).astype(np.uint8)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
