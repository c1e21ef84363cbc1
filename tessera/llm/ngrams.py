"""Byte n-grams of texts as 64-bit codes, counted and looked up with arrays.

A text becomes ``order`` pads, its UTF-8 bytes and one end byte.  Pad and end are
0xFE and 0xFF, which UTF-8 never uses.  The code of a window holds its bytes, the
last one lowest, so the code of a shorter suffix is a mask and the context of a
code is a shift.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

PAD, END = 0xFE, 0xFF
#: Bytes that are turned into codes at a time.
CHUNK = 1 << 19
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def codes_of(data: np.ndarray, order: int) -> np.ndarray:
    """Codes of all windows of order + 1 bytes that don't end in a pad."""
    n = len(data) - order
    code = np.zeros(n, np.uint64)
    for j in range(order + 1):
        code = (code << np.uint64(8)) | data[j : n + j]
    return code[data[order:] != PAD]


def chunks(texts: Iterable[bytes | None], order: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int]]]]:
    """(codes, [(text number, codes of it)]) of about CHUNK codes; a longer text spans several, with its context."""
    pads, parts, owners, size = bytes([PAD]) * order, [], [], 0

    def flush():
        return codes_of(np.frombuffer(b"".join(parts), np.uint8), order), owners

    for i, text in enumerate(texts):
        whole = (text or b"") + bytes([END])
        for at in range(0, len(whole), CHUNK):
            piece = whole[at : at + CHUNK]
            if at:
                # a continued text brings its own context, hidden behind pads so that it isn't counted twice
                if parts:
                    yield flush()
                    parts, owners, size = [], [], 0
                before = np.frombuffer(pads + whole[max(0, at - order) : at], np.uint8)[-order:] if order else np.empty(0, np.uint8)
                data = np.concatenate([before, np.frombuffer(piece, np.uint8)])
                yield codes_of(data, order), [(i, len(piece))]
                continue
            parts.append(pads + piece)
            owners.append((i, len(piece)))
            size += len(piece)
            if size >= CHUNK:
                yield flush()
                parts, owners, size = [], [], 0
    if parts:
        yield flush()


class Counter:
    """Sums codes; holds at most about ``limit`` distinct ones, and a buffer, before it hands them on."""

    def __init__(self, limit: int = 1 << 20, buffer: int = 1 << 20):
        self.limit, self.buffer, self.parts, self.counted, self.size = limit, buffer, [], [], 0
        self.codes, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        self.parts.append(codes)
        self.size += len(codes)
        if self.size < self.buffer:
            return None
        self._fold()
        return self.take() if len(self.codes) > self.limit else None

    def add_counts(self, codes: np.ndarray, counts: np.ndarray) -> None:
        """Sorted codes with counts; they are added when as many as the buffer holds have come."""
        self.counted.append((codes, counts))
        self.size += len(codes)
        if self.size >= max(self.buffer, len(self.codes)):
            self._fold()

    def _fold(self) -> None:
        if not self.parts and not self.counted:
            return
        given = [(self.codes, self.counts)] if len(self.codes) else []
        if self.parts:
            given.append(np.unique(np.concatenate(self.parts), return_counts=True))
        given += self.counted
        self.parts, self.counted, self.size = [], [], 0
        new, n = given[0]
        if len(given) > 1:
            # sorted runs: a stable sort merges them
            new, n = np.concatenate([g[0] for g in given]), np.concatenate([g[1] for g in given])
            order = np.argsort(new, kind="stable")
            new = new[order]
            first = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]]))
            new, n = new[first], np.add.reduceat(n[order], first)
        self.codes, self.counts = new, n.astype(np.int64)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._fold()
        out = self.codes, self.counts
        self.codes, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        return out


class CodeTable:
    """Open-addressed map from codes to their places 0, 1, ..., looked up for whole arrays."""

    def __init__(self, codes: np.ndarray):
        codes = codes.astype(np.uint64)
        self.bits = max(4, (4 * max(1, len(codes)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, _EMPTY)
        self.place = np.zeros(1 << self.bits, np.int32)
        left, slot = np.arange(len(codes), dtype=np.int32), self._slot(codes)
        while len(left):
            free = self.keys[slot] == _EMPTY
            _, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slot[won]], self.place[slot[won]] = codes[left[won]], left[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Place of each code, -1 if it isn't there."""
        slot = self._slot(codes)
        key = self.keys[slot]
        out = np.where(key == codes, self.place[slot], np.int32(-1))
        open_ = np.flatnonzero((key != codes) & (key != _EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            key = self.keys[slot[open_]]
            hit = key == codes[open_]
            out[open_[hit]] = self.place[slot[open_[hit]]]
            open_ = open_[~hit & (key != _EMPTY)]
        return out


def score_texts(texts: Iterable[bytes | None], order: int, logp, count: int) -> np.ndarray:
    """Sum of ``logp(codes)`` over each text."""
    out = np.zeros(count)
    for codes, owners in chunks(texts, order):
        values, at = logp(codes), 0
        starts = np.cumsum([0] + [n for _, n in owners[:-1]])
        for (i, _), total in zip(owners, np.add.reduceat(values, starts), strict=True):
            out[i] += total
        at += len(values)
    return out
