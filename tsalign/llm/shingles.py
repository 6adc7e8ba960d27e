"""Words and shingles of whole texts as 64-bit hashes, many texts at a time."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

from tsalign.llm.common import mix

U64 = np.uint64
SHINGLE = 5

#: Bytes hashed at once. A longer text is cut between words, so memory does not grow with it.
SEGMENT = 1_000_000

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_VALUE = mix(np.arange(1, 257, dtype=U64))
_VALUE[65:91] = _VALUE[97:123]  # A-Z as a-z
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = mix(np.arange(1001, 1001 + SHINGLE, dtype=U64)) | U64(1)
_SHORT = mix(np.arange(2001, 2001 + SHINGLE, dtype=U64))

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SEGMENT + 4096), base, dtype=U64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=U64)
    return have[:n]


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word in ``data``."""
    raw = np.frombuffer(data, dtype=np.uint8)
    gap = _SEPARATOR[raw]
    edge = np.diff(gap.astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, dtype=U64), starts
    summed = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum(_VALUE[raw] * _power(_BASE, len(raw)), out=summed[1:])
    words = (summed[ends] - summed[starts]) * _power(_BASE_INVERSE, len(raw))[starts]
    return mix(words ^ (ends - starts).astype(U64)), starts


def _cut(data: bytes) -> Iterator[bytes]:
    """``data`` in pieces of about ``SEGMENT`` bytes that end between words."""
    at = 0
    while len(data) - at > SEGMENT:
        gap = _GAP.search(data, at + SEGMENT)
        end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order; empty for NULL."""
    batch: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if batch:
            begins = np.cumsum([0] + [len(b) + 1 for b in batch])
            words, starts = _hash_words(b" ".join(batch))
            cuts = np.searchsorted(starts, begins)
            for i in range(len(batch)):
                yield words[cuts[i] : cuts[i + 1]]
        batch.clear()

    for text in texts:
        data = text.encode("utf-8", "surrogatepass") if text else b""
        if len(data) > SEGMENT:
            yield from flush()
            size = 0
            yield np.concatenate([_hash_words(piece)[0] for piece in _cut(data)])
            continue
        batch.append(data)
        size += len(data) + 1
        if size >= SEGMENT:
            yield from flush()
            size = 0
    yield from flush()


def shingle_set(words: np.ndarray) -> np.ndarray:
    """The distinct five-word shingles, sorted; the whole sequence as one if it is shorter; empty without words."""
    n = len(words)
    if n == 0:
        return np.empty(0, dtype=U64)
    if n < SHINGLE:
        return mix((words * _PLACE[:n]).sum(dtype=U64, keepdims=True) ^ _SHORT[n])
    out = words[: n - SHINGLE + 1] * _PLACE[0]
    for j in range(1, SHINGLE):
        out += words[j : n - SHINGLE + 1 + j] * _PLACE[j]
    return np.unique(mix(out))


def shingle_sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    return map(shingle_set, word_hashes(texts))
