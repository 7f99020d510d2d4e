"""Suffix order of a shard by induced sorting with disk-backed bucket queues."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

QUEUE_BYTES = 64 << 20  # held in memory by all queues of one sort
READ_TOGETHER = 1 << 18  # positions taken from a queue at a time
PAIRS = 1 << 17  # of neighbours compared at a time


class BucketQueues:
    """A priority queue of suffix positions, first by first symbol, then by arrival.

    Induction only ever adds a suffix behind those of its symbol that are already in order, so one first-in-first-out queue per symbol
    is a whole priority queue. Beyond a bound of bytes, blocks go to an unnamed scratch file, which ends with the task.
    """

    def __init__(self, symbols: int, held: int = QUEUE_BYTES):
        self.blocks: list[list] = [[] for _ in range(symbols)]
        self.held, self.bound, self.file, self.kind = 0, held, None, None

    def push(self, symbol: int, positions: np.ndarray) -> None:
        if not len(positions):
            return
        self.kind = positions.dtype
        if self.held + positions.nbytes > self.bound:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            self.file.write(positions.tobytes())
            self.blocks[symbol].append((at, len(positions)))
        else:
            self.held += positions.nbytes
            self.blocks[symbol].append(positions.copy())

    def get(self, symbol: int, k: int) -> np.ndarray:
        block = self.blocks[symbol][k]
        if isinstance(block, tuple):
            self.file.seek(block[0])
            block = np.frombuffer(self.file.read(self.kind.itemsize * block[1]), dtype=self.kind)
        return block

    def pull(self, symbol: int) -> Iterator[np.ndarray]:
        """What has arrived, in order, then what arrived meanwhile; small blocks are read together."""
        k = 0
        while k < len(self.blocks[symbol]):
            parts, size = [], 0
            while k < len(self.blocks[symbol]) and size < READ_TOGETHER:
                parts.append(self.get(symbol, k))
                size += len(parts[-1])
                k += 1
            yield np.concatenate(parts)

    def back(self, symbol: int) -> Iterator[np.ndarray]:
        k = len(self.blocks[symbol])
        while k:
            parts, size = [], 0
            while k and size < READ_TOGETHER:
                k -= 1
                parts.append(self.get(symbol, k)[::-1])
                size += len(parts[-1])
            yield np.concatenate(parts)


def positions_type(text: np.ndarray) -> type:
    """The smaller of the two types that hold all positions of a text."""
    return np.int32 if len(text) < 1 << 31 else np.int64


def small_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S), for a text that ends with its one smallest symbol."""
    n = len(text)
    kind = positions_type(text)
    at = np.arange(n, dtype=kind)
    at[:-1][text[1:] == text[:-1]] = n - 1
    following = np.minimum.accumulate(at[::-1])[::-1]  # the next place whose symbol is not the one after it
    rises = np.ones(n, dtype=bool)
    rises[:-1] = text[1:] > text[:-1]
    return rises[following]


def _spread(text: np.ndarray, small: np.ndarray, positions: np.ndarray, want_small: bool, queues: BucketQueues) -> None:
    """Push the suffixes one to the left that have the wanted type, in the order of `positions`."""
    left = positions[positions > 0] - 1
    left = left[small[left] == want_small]
    if not len(left):
        return
    symbols = text[left]
    order = np.argsort(symbols, kind="stable")
    left, symbols = left[order], symbols[order]
    cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    starts = np.concatenate([[0], cuts])
    for a, b in zip(starts, np.append(cuts, len(left))):
        queues.push(int(symbols[a]), left[a:b])


def induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, symbols: int, held: int) -> Iterator[np.ndarray]:
    """All suffixes in order, block by block, from the leftmost small suffixes in order.

    The first pass goes up the symbols and adds the large suffixes, the second goes down and adds the small ones.
    """
    large = BucketQueues(symbols, held)
    by_symbol = text[seeds]
    borders = np.searchsorted(by_symbol, np.arange(symbols + 1))
    for c in range(symbols):
        for block in large.pull(c):
            _spread(text, small, block, False, large)
        _spread(text, small, seeds[borders[c]: borders[c + 1]], False, large)
    tiny = BucketQueues(symbols, held)
    tiny.push(int(text[-1]), np.array([len(text) - 1], dtype=seeds.dtype))
    for c in range(symbols - 1, -1, -1):
        for block in tiny.pull(c):
            _spread(text, small, block, True, tiny)
        for block in large.back(c):
            _spread(text, small, block, True, tiny)
    for c in range(symbols):
        yield from large.pull(c)
        yield from tiny.back(c)


def equal_runs(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether text[a:a+length] equals text[b:b+length], for each pair; only pairs equal so far are read on."""
    same = np.ones(len(a), dtype=bool)
    left, k = np.flatnonzero(length > 0), 0
    while len(left):
        differs = text[a[left] + k] != text[b[left] + k]
        same[left[differs]] = False
        k += 1
        left = left[~differs]
        left = left[length[left] > k]
    return same


def equal_windows(text: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether the `width` symbols at a and b are equal, seven at a time."""
    if width < 7:
        return equal_runs(text, a, b, np.full(len(a), width))
    words = np.zeros(len(text), dtype=np.uint64)
    for k in range(7):
        ahead = text[k:].astype(np.uint64)
        ahead <<= np.uint64(9 * k)
        words[: len(ahead)] |= ahead
    same = np.zeros(len(a), dtype=bool)
    for first in range(0, len(a), PAIRS):
        left = np.arange(first, min(len(a), first + PAIRS))
        for k in [*range(0, width - 6, 7), width - 7]:
            left = left[words[a[left] + k] == words[b[left] + k]]
        same[left] = True
    return same


def suffix_order(text: np.ndarray, symbols: int, depth: int, held: int = QUEUE_BYTES) -> Iterator[np.ndarray]:
    """Suffix positions in the order of their first `depth` symbols at least, block by block.

    `text` must end with its one smallest symbol. Leftmost small suffixes are put in order first: one induction sorts their substrings, equal
    ones get equal names, and the string of names is sorted in turn, by pairs of ranks over twice the length each round
    until `depth` is covered. A second induction gives the order of all suffixes.
    """
    small = small_types(text)
    kind = positions_type(text)
    marks = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(kind)
    if len(marks) > 1:
        is_mark = np.zeros(len(text), dtype=bool)
        is_mark[marks] = True
        rough = marks[np.argsort(text[marks], kind="stable")]
        order = np.concatenate([block[is_mark[block]] for block in induce(text, small, rough, symbols, held)])
        ends = np.append(marks[1:], len(text) - 1)
        size = np.zeros(len(text), dtype=kind)
        size[marks] = np.minimum(ends - marks + 1, len(text) - marks)
        a, b = order[:-1], order[1:]
        equal = (size[a] == size[b]) & equal_runs(text, a, b, np.where(size[a] == size[b], np.minimum(size[a], depth), 0))
        size[order] = np.concatenate([[1], 1 + np.cumsum(~equal)])  # from here on their names
        rank, step = size[marks].astype(np.int64), 1
        while step < depth and rank.max() < len(rank):  # a mark is two symbols at least before the next
            ahead = np.concatenate([rank[step:], np.zeros(min(step, len(rank)), dtype=np.int64)])[: len(rank)]
            key = rank * (len(rank) + 1) + ahead
            by = np.argsort(key, kind="stable")
            rank[by] = np.concatenate([[1], 1 + np.cumsum(key[by][1:] != key[by][:-1])])
            step *= 2
        marks = marks[np.argsort(rank, kind="stable")]
    yield from induce(text, small, marks, symbols, held)


def repeated_windows(strings: list[bytes], width: int, held: int = QUEUE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of `width` bytes of the strings, grouped: (class, string number, offset), windows that are equal having one class.

    Neighbours in suffix order have a common prefix of `width` or not; runs of those that have are the classes. Classes of one window are left out.
    """
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.ones(starts[-1] + 1, dtype=np.uint16)  # 1 ends a string
    raw = np.frombuffer(b"\x00".join(strings) + b"\x00", dtype=np.uint8)
    text[:-1] = raw + np.uint16(2)
    text[starts[1:] - 1] = 1
    text[-1] = 0
    valid = np.zeros(len(text), dtype=bool)
    for a, n in zip(starts, sizes):
        if n >= width:
            valid[a: a + n - width + 1] = True
    order = np.concatenate([block[valid[block]] for block in suffix_order(text, 258, width, held)] or [np.zeros(0, dtype=np.int32)])
    same = equal_windows(text, order[:-1], order[1:], width) if len(order) > 1 else np.zeros(0, dtype=bool)
    classes = np.concatenate([[0], np.cumsum(~same)]).astype(order.dtype) if len(order) else np.zeros(0, dtype=np.int32)
    many = np.bincount(classes)[classes] > 1 if len(order) else np.zeros(0, dtype=bool)
    order, classes = order[many], classes[many]
    string = np.searchsorted(starts, order, side="right") - 1
    return classes.astype(np.int64), string, order - starts[string]
