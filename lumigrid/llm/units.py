"""Texts cut into units whose ids are found once, by whole Arrow batches.

A tokenizer whose pieces never reach over some places can take the units between them
alone. Units are cut and hashed by NumPy in one pass over a batch's bytes, so that a
Python object is made for each new unit only, not for each word of the text.
"""

from __future__ import annotations

import numpy as np

from lumigrid.llm.words import rolling_keys

_TOP = np.uint64(2**64 - 1)


class Units:
    """Units of some texts: unit k is data[start[k]:end[k]]; ``first[i]:first[i+1]`` are
    those of text i. Equal units have equal keys; unequal ones differ but for 2**-64."""

    def __init__(self, data: np.ndarray, at: np.ndarray, cut: np.ndarray):
        """cut: whether a unit begins at each byte; the first byte of a text begins one."""
        cut[at[:-1][at[:-1] < at[1:]]] = True
        self.data, self.start = data, np.flatnonzero(cut)
        self.end = np.r_[self.start[1:], len(data)] if len(self.start) else self.start
        self.first = np.searchsorted(self.start, at)
        self.key = rolling_keys(data, self.start, self.end)

    def texts(self, which: np.ndarray) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.start[which].tolist(), self.end[which].tolist(), strict=True)]


class Memo:
    """Lists of ids by key, all in arrays; it forgets everything beyond `most` ids."""

    def __init__(self, most: int = 6_000_000, dtype=np.int32):
        self.most, self.dtype = most, dtype
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.full(1, _TOP), np.zeros(1, np.int32), np.zeros(1, np.int32)
        self.flat = np.zeros(0, self.dtype)
        self._index()

    def _index(self) -> None:
        bits = max(len(self.keys).bit_length() - 2, 1)
        self.shift = np.uint64(64 - bits)  # keys are spread evenly: their first bits tell nearly where they stand
        self.near = np.searchsorted(self.keys[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        spot = self.near[keys >> self.shift]
        behind = np.flatnonzero(self.keys[spot] < keys)
        while len(behind):
            spot[behind] += 1
            behind = behind[self.keys[spot[behind]] < keys[behind]]
        return spot

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """The first place of each key that is not held."""
        absent = np.flatnonzero(self.keys[self._spot(keys)] != keys)
        return absent[np.unique(keys[absent], return_index=True)[1]]

    def add(self, keys: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """New keys and their ids, list after list."""
        order = np.argsort(keys)
        at = (len(self.flat) + np.cumsum(size) - size)[order]
        to = np.searchsorted(self.keys[:-1], keys[order])
        self.keys, self.at, self.size = np.insert(self.keys, to, keys[order]), np.insert(self.at, to, at), np.insert(self.size, to, size[order])
        self.flat = np.concatenate([self.flat, flat]).astype(self.dtype, copy=False)
        self._index()

    def full(self, more: int) -> bool:
        return len(self.flat) > 0 and len(self.flat) + more > self.most

    def ids(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of held keys, list after list, and how many each has."""
        spot = self._spot(keys)
        size = self.size[spot]
        ends = np.cumsum(size, dtype=np.int32)
        source = np.repeat(self.at[spot] - (ends - size), size)
        source += np.arange(len(source), dtype=np.int32)
        return self.flat[source], size
