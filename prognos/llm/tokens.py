"""Encoding by distinct parts: whatever a tokenizer never merges across is encoded once and looked up afterwards."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa


def gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[begin : begin + size] of every entry, behind one another."""
    total = int(size.sum())
    before = np.cumsum(size) - size
    return flat[np.repeat(begin - before, size) + np.arange(total)]


def distinct(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(number of each part, the distinct parts) of bytes cut where `begin` is true; the first byte begins a part."""
    if not len(data):
        return np.zeros(0, np.int64), []
    offsets = np.append(np.flatnonzero(begin), len(data)).astype(np.int64)
    parts = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = parts.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


class PartCache:
    """Ids of parts; `encode` gets new parts and returns (flat ids, ids of each).

    Holds `most` parts between calls, so memory is bounded: beyond that the half that was asked for least goes.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int) -> None:
        self.encode, self.most = encode, most
        self.place: dict[bytes, int] = {}
        self.asked, self.size, self.begin = (np.zeros(0, np.int64) for _ in range(3))
        self.flat = np.zeros(0, np.uint32)

    def _add(self, new: list[bytes]) -> None:
        flat, size = self.encode(new)
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.asked = np.concatenate([self.asked, np.zeros(len(new), np.int64)])
        self.flat = np.concatenate([self.flat, flat])

    def _shrink(self) -> None:
        kept = np.sort(np.argsort(-self.asked, kind="stable")[: self.most // 2])
        names = list(self.place)
        self.place = {names[i]: n for n, i in enumerate(kept.tolist())}
        self.flat = gathered(self.flat, self.begin[kept], self.size[kept])
        self.asked, self.size = self.asked[kept] // 2, self.size[kept]
        self.begin = np.cumsum(self.size) - self.size

    def __call__(self, codes: np.ndarray, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each part) of parts given by their numbers in a list of distinct ones."""
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if new := [p for p in parts if p not in self.place]:
            self._add(new)
        place = np.fromiter(map(self.place.__getitem__, parts), np.int64, len(parts))
        self.asked[place] += np.bincount(codes, minlength=len(parts))
        at = place[codes]
        out = gathered(self.flat, self.begin[at], self.size[at]), self.size[at]
        if len(self.place) > self.most:
            self._shrink()
        return out
