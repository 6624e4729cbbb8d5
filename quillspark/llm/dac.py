"""Directly addressable codes: a static array of integers with access to any element without decoding others.

Level k holds the k-th byte of every id that has one. A bitmap a level says which ids continue on the next level, and
a directory counts the ones before every block of the bitmap, so an element's place on the next level is one rank.

Layout, little-endian: b"DAC1", uint64 length, uint32 levels; then a level: uint64 size, its bytes, its bitmap
(bit i of byte i // 8 counted from the least), uint32 ones before each block of 512 bits.
"""

from __future__ import annotations

import numpy as np

MAGIC, BLOCK = b"DAC1", 64
_ONES = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint8)


def encode(ids: np.ndarray) -> bytes:
    """The code of unsigned integers below 2^32."""
    level, out = np.ascontiguousarray(ids, dtype=np.uint32), []
    while len(level):
        more = level > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(_ONES[bits], np.arange(0, len(bits), BLOCK), dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones[:-1])]).astype("<u4")
        out.append(np.uint64(len(level)).tobytes() + level.astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        level = level[more] >> np.uint32(8)
        # an id that continues has a chunk above zero or more levels to go, so the last level never continues
    return MAGIC + np.uint64(len(ids)).tobytes() + np.uint32(len(out)).tobytes() + b"".join(out)


class Reader:
    """Random access to an encoded array."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a directly addressable code")
        self.length, levels, at = int(np.frombuffer(data, "<u8", 1, 4)[0]), int(np.frombuffer(data, "<u4", 1, 12)[0]), 16
        self.levels = []
        for _ in range(levels):
            n = int(np.frombuffer(data, "<u8", 1, at)[0])
            wide, blocks, at = -(-n // 8), -(-n // (8 * BLOCK)), at + 8
            self.levels.append((np.frombuffer(data, np.uint8, n, at), np.frombuffer(data, np.uint8, wide, at + n), np.frombuffer(data, "<u4", blocks, at + n + wide)))
            at += n + wide + 4 * blocks

    def __len__(self) -> int:
        return self.length

    def rank(self, level: int, i: int) -> int:
        """Ones before bit i."""
        _, bits, ranks = self.levels[level]
        byte = i >> 3
        start = byte // BLOCK * BLOCK
        ones = int(ranks[byte // BLOCK]) if byte // BLOCK < len(ranks) else int(ranks[-1]) + int(_ONES[bits[(len(ranks) - 1) * BLOCK :]].sum()) if len(ranks) else 0
        if byte < len(bits):
            ones += int(_ONES[bits[start:byte]].sum()) + int(_ONES[bits[byte] & ((1 << (i & 7)) - 1)])
        return ones

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.length:
            raise IndexError(i)
        value, level = 0, 0
        while True:
            chunks, bits, _ = self.levels[level]
            value |= int(chunks[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            i, level = self.rank(level, i), level + 1

    def slice(self, start: int, stop: int) -> np.ndarray:
        """ids[start:stop], touching only the chunks of that range."""
        out = np.zeros(max(0, stop - start), dtype=np.uint32)
        where, level = None, 0  # None: all places
        while start < stop:
            chunks, bits, _ = self.levels[level]
            if where is None:
                out[:] = chunks[start:stop]
            else:
                out[where] |= chunks[start:stop].astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(bits[start >> 3 : -(-stop // 8)], bitorder="little")[start & 7 :][: stop - start].view(bool)
            if not more.any():
                break
            where, start, stop, level = np.flatnonzero(more) if where is None else where[more], (first := self.rank(level, start)), first + int(more.sum()), level + 1
        return out
