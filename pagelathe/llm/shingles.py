"""Words and word n-grams of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import xxhash

_SEGMENT = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_rng = np.random.Generator(np.random.PCG64(20_240_501))
_BYTE = _rng.integers(1, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ORDER = _rng.integers(1, 1 << 63, 64, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE modulo 2^64 and their inverses."""
    global _powers, _inverse
    if len(_powers) <= n:
        back = np.uint64(pow(int(_BASE), -1, 1 << 64))
        size = max(n + 1, _SEGMENT + 1)
        for base, name in ((_BASE, "_powers"), (back, "_inverse")):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers, _inverse


def _edges(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in bytes; what is held beside them is a segment's."""
    out, before = [], True
    for a in range(0, len(x), _SEGMENT):
        part = x[a : a + _SEGMENT]
        space = (part - np.uint8(9) < 5) | (part == 0x20)
        turns = np.flatnonzero(space[1:] != space[:-1]) + (a + 1)
        out.append(np.concatenate([[a], turns]) if space[0] != before else turns)
        before = bool(space[-1])
    edges = np.concatenate([*out, [] if before else [len(x)]]).astype(np.int64)
    return edges[0::2], edges[1::2]


def word_hashes(texts: list[bytes], key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, words in each text). Words are runs of bytes but 0x20 and 0x09-0x0D.

    A word of up to 16 bytes is two numbers, which are mixed with the key; of a longer one, BLAKE2 with the key makes
    the hash. With a key that is drawn for a job, no two words can be made to collide beforehand.
    """
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    flat = b"\n".join([*texts, bytes(16)])
    size = len(flat) - 16
    if not texts or size <= len(texts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    first, last = _edges(np.frombuffer(flat, np.uint8, size))
    eight = np.ndarray((size + 8,), "<u8", flat, strides=(1,))
    n = last - first
    low, high = eight[first] & _MASK[np.minimum(n, 8)], eight[np.minimum(first + 8, size)] & _MASK[np.clip(n - 8, 0, 8)]
    k1, k2 = (np.uint64(int.from_bytes(blake2b(bytes([j]), digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")) for j in (1, 2))
    hashes = mix(mix(mix(low ^ k1) + (high ^ k2)) + n.astype(np.uint64))
    for k in np.flatnonzero(n > 16).tolist():
        hashes[k] = int.from_bytes(blake2b(flat[first[k] : last[k]], digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")
    return hashes, np.diff(np.searchsorted(first, ends), prepend=0)


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 with A-Z, and nothing else, in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def shingle_sets(texts: list[bytes], width: int, key: int = 0) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; of a text with fewer words, that of the whole sequence."""
    words, counts = word_hashes(texts, key)
    n = max(0, len(words) - width + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(width):
        grams += words[k : k + n] * _ORDER[k]
    grams = mix(grams)
    out, at = [], 0
    for m in counts.tolist():
        if m >= width:
            own = grams[at : at + m - width + 1].copy()
            own.sort()
            keep = np.ones(len(own), np.bool_)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        elif m:
            own = mix((words[at : at + m] * _ORDER[:m]).sum(dtype=np.uint64, keepdims=True) + np.uint64(m))
        else:
            own = np.zeros(0, np.uint64)
        out.append(own)
        at += m
    return out


def set_signature(own: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set."""
    h = xxhash.xxh3_64_intdigest(own.tobytes())
    return h - (1 << 64) if h >> 63 else h


def byte_slices(texts: list[bytes], most: int = 1 << 20):
    """Ranges of texts that hold about so many bytes."""
    start = held = 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)
