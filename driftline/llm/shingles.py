"""Hashes of words and of word shingles, computed for many texts at once over their bytes."""

from __future__ import annotations

import numpy as np

_SPLIT = np.zeros(256, bool)
_SPLIT[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte (A-Z as a-z), and odd multipliers of positions in a word and in a shingle.
_BYTE = _RNG.integers(0, 2**64, 256, np.uint64, endpoint=False)[_FOLD]
_P = int(_RNG.integers(0, 2**63)) * 4 + 3 & 2**64 - 1
_PLACE = _RNG.integers(0, 2**64, 16, np.uint64, endpoint=False) | np.uint64(1)
_power = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if len(_power[0]) < n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate((_P, pow(_P, -1, 2**64))):
            x = np.full(size, np.uint64(base), np.uint64)
            x[0] = 1
            _power[k] = np.cumprod(x, dtype=np.uint64)
    return _power


def _hash_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of bytes that end in a space. Words are runs of bytes other than space and x09 to x0D in A-Z
    lower case; the hash is a polynomial over random byte values, by prefix sums, and then mixed with the length."""
    gap = _SPLIT[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start, end
    power, inverse = _powers(len(data))
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64)])
    h = (total[end] - total[start]) * inverse[start]
    return mix(h ^ mix((end - start).astype(np.uint64))), start, end


def hash_words(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, number of words of each text)."""
    raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else (t or b"") for t in texts]
    h, start, _ = _hash_bytes(np.frombuffer(b" ".join(raw) + b" ", np.uint8))
    lens = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    return h, np.diff(np.concatenate([[0], np.searchsorted(start, np.cumsum(lens))]))


def words_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first characters) of the words of one text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass") + b" ", np.uint8)
    h, start, _ = _hash_bytes(data)
    if len(data) - 1 != len(text):  # places of bytes to places of characters
        start = (np.cumsum((data & 0xC0) != 0x80) - 1)[start]
    return h, start


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text; of fewer words the whole sequence; of none, nothing."""
    out: list[np.ndarray] = []
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t or "")
        if size > 1_000_000:
            out += _block_sets(block, k)
            block, size = [], 0
    return out + _block_sets(block, k) if block else out


def _block_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    h, counts = hash_words(texts)
    n = len(h)
    # Each word's hash times the multiplier of its place; a short text's missing places are left out.
    full = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        full += h[j : n - k + 1 + j] * _PLACE[j]
    full = mix(full)
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            s = np.sort(full[at : at + c - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif c:
            out.append(mix((h[at : at + c] * _PLACE[:c]).sum(dtype=np.uint64, keepdims=True) + np.uint64(c)))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out
