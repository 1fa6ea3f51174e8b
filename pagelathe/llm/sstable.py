"""Sorted-string tables of token ids: prefix-compressed blocks, sparse index, Bloom filter, footer.

File layout, integers little-endian:

    block*      zstd of entries: shared u16, rest u16, value u32, rest of key, value
    index       zstd of: last key's length u16, last key, offset u64, length u32, entries u32
    bloom       u8 hash count, then the bits
    footer      index offset u64, index length u64, bloom offset u64, bloom length u64, entries u64,
                ids u64, bytes per id u8, 7 magic bytes

A key is the document identifier as 8 big-endian bytes with the sign bit turned, so that byte order is
number order; a null identifier has the empty key and comes first. Equal keys keep their order.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import xxhash
import zstandard

MAGIC = b"PLSST01"
FOOTER = struct.Struct("<6QB7s")
ENTRY = struct.Struct("<HHI")
BLOCK = struct.Struct("<QII")
BITS_PER_KEY, HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")


def doc_id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _bits(key: bytes, size: int, hashes: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + k * b) % size for k in range(hashes)]


class Writer:
    """Takes entries in key order. Holds one block, the index and two hashes a key."""

    def __init__(self, out: BinaryIO, id_bytes: int, block_bytes: int = 1 << 18) -> None:
        self.out, self.id_bytes, self.block_bytes = out, id_bytes, block_bytes
        self.pack = zstandard.ZstdCompressor(level=1)
        self.block, self.in_block, self.index, self.keys = bytearray(), 0, bytearray(), []
        self.at = self.entries = self.ids = 0
        self.last = self.first = None

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key = key_of(doc_id)
        if self.last is not None and key < self.last:
            raise ValueError("keys must come in order")
        shared = 0
        if self.in_block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype(f"<u{self.id_bytes}").tobytes()
        self.block += ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self.in_block += 1
        self.entries += 1
        self.ids += len(ids)
        self.last = key
        self.keys.append(key)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        data = self.pack.compress(bytes(self.block))
        self.out.write(data)
        self.index += struct.pack("<H", len(self.last)) + self.last + BLOCK.pack(self.at, len(data), self.in_block)
        self.at += len(data)
        self.block, self.in_block = bytearray(), 0

    def close(self) -> None:
        if self.in_block:
            self._flush()
        size = max(64, len(self.keys) * BITS_PER_KEY + 7 & ~7)
        bits = np.zeros(size, np.bool_)
        for key in self.keys:
            bits[_bits(key, size, HASHES)] = True
        index, bloom = self.pack.compress(bytes(self.index)), bytes([HASHES]) + np.packbits(bits).tobytes()
        self.out.write(index + bloom)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.entries, self.ids, self.id_bytes, MAGIC))
        self.out.close()


class Reader:
    """Random and sequential access to a table, a block at a time."""

    def __init__(self, source: BinaryIO) -> None:
        self.source = source
        source.seek(0, 2)
        source.seek(source.tell() - FOOTER.size)
        at, n, bloom_at, bloom_n, self.entries, self.ids, self.id_bytes, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a sorted-string table")
        self.unpack = zstandard.ZstdDecompressor()
        index = self.unpack.decompress(self._read(at, n), max_output_size=1 << 31) if n else b""
        bloom = self._read(bloom_at, bloom_n)
        self.hashes, self.bits = bloom[0], np.unpackbits(np.frombuffer(bloom[1:], np.uint8))
        self.last_keys, self.blocks, k = [], [], 0
        while k < len(index):
            n = int.from_bytes(index[k : k + 2], "little")
            self.last_keys.append(index[k + 2 : k + 2 + n])
            self.blocks.append(BLOCK.unpack_from(index, k + 2 + n))
            k += 2 + n + BLOCK.size

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        at, n, entries = self.blocks[k]
        data = self.unpack.decompress(self._read(at, n), max_output_size=(1 << 32) - 1)
        key, p = b"", 0
        for _ in range(entries):
            shared, rest, size = ENTRY.unpack_from(data, p)
            p += ENTRY.size
            key = key[:shared] + data[p : p + rest]
            p += rest
            yield key, np.frombuffer(data, f"<u{self.id_bytes}", size // self.id_bytes, p)
            p += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.blocks)):
            for key, ids in self._block(k):
                yield doc_id_of(key), ids

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The first entry of an identifier: Bloom filter, then binary search, then one block."""
        key = key_of(doc_id)
        if not self.bits[_bits(key, len(self.bits), self.hashes)].all():
            return None
        k = bisect_left(self.last_keys, key)
        if k < len(self.blocks):
            for found, ids in self._block(k):
                if found == key:
                    return ids
        return None
