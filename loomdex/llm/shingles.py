"""Word shingle sets of whole texts as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from loomdex.llm.common import RangeHash, ascii_lower, mixed, raw_text

WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
STEP = np.uint64(0xD6E8FEB86659FD93)


class Shingler:
    """Distinct shingle hashes of every row of a text column.

    A-Z are lower-cased, words are runs of other bytes than ASCII white space. A
    text of fewer words than ``width`` has its whole sequence as the only shingle.
    """

    def __init__(self, width: int) -> None:
        self.width, self.hashes = width, RangeHash()
        self.white = np.zeros(256, bool)
        self.white[list(WHITE)] = True

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        yield from self.of(*raw_text(column))

    def of(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The sets of texts laid end to end."""
        raw = ascii_lower(raw)
        inside = ~self.white[raw]
        first, last = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
        first[offsets[:-1]] = True
        last[offsets[1:]] = True
        starts = np.flatnonzero(inside & (first[:-1] | np.r_[True, ~inside[:-1]]))
        ends = np.flatnonzero(inside & (last[1:] | np.r_[~inside[1:], True])) + 1
        self.hashes.load(raw)
        words = self.hashes.of(starts, ends)
        bounds = np.searchsorted(starts, offsets)
        rolled = np.zeros(max(0, len(words) - self.width + 1), np.uint64)
        for k in range(self.width):
            rolled = rolled * STEP + words[k : k + len(rolled)]
        rolled = mixed(rolled)
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if end - start >= self.width:
                yield np.unique(rolled[start : end - self.width + 1])
            elif end > start:
                whole = np.array([end - start], np.uint64)
                for k in range(start, end):
                    whole = whole * STEP + words[k]
                yield mixed(whole ^ STEP)
            else:
                yield np.zeros(0, np.uint64)


def set_id(tokens: np.ndarray) -> int:
    """A number for a set: equal sets have equal numbers."""
    both = mixed(tokens.sum(dtype=np.uint64, keepdims=True) + np.array([len(tokens)], np.uint64) * STEP)
    return int(both.view(np.int64)[0])
