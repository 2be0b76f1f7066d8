"""Flat numpy helpers that the batch operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import chain, repeat

import numpy as np

#: a pair of symbols that never merges
NO_MERGE = np.iinfo(np.int64).max


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i] - 1`` of all i, in order."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def mix(values: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the whole word."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class MergeRounds:
    """Byte-pair merges of many words at once, over flat symbol arrays.

    One round finds the best pair of every word (segmented minimum), merges
    its leftmost occurrence and drops the consumed symbols. All occurrences of
    the pair merge together where that equals merging one after the other: no
    merge that starts or ends with the new symbol may have a better rank.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray, symbols: int):
        key = left.astype(np.int64) * symbols + right
        order = np.lexsort((rank, key))
        first = np.r_[True, np.diff(key[order]) != 0]
        order = order[first]
        self.key, self.rank, self.merged, self.symbols = key[order], rank[order].astype(np.int64), merged[order], symbols
        best = np.full(symbols, NO_MERGE)
        np.minimum.at(best, left, rank)
        np.minimum.at(best, right, rank)
        worst = np.full(symbols, -1)
        np.maximum.at(worst, merged, rank)
        self.alone = best < worst  # symbols whose later merges may come first
        self._rank = np.r_[self.rank, NO_MERGE]  # the last for no pair (-1)
        self._slots()

    def _slots(self) -> None:
        """Open addressing over the pairs: a lookup costs a few gathers."""
        size = 1 << int(np.ceil(np.log2(max(2, len(self.key)) * 4)))
        self.shift = np.uint64(64 - int(np.log2(size)))
        self.slot = np.full(size, -1, np.int64)
        self.mask = size - 1
        waiting = np.arange(len(self.key))
        at = self._home(self.key)
        while len(waiting):
            free = self.slot[at] < 0
            self.slot[at[free]] = waiting[free]
            lost = self.slot[at] != waiting
            waiting, at = waiting[lost], (at[lost] + 1) & self.mask

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair's merge, -1 where there is none."""
        key = left * self.symbols + right
        at = self._home(key)
        found = self.slot[at]
        open_ = np.flatnonzero((found >= 0) & (self.key[found] != key))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            got = self.slot[at[open_]]
            found[open_] = got
            open_ = open_[(got >= 0) & (self.key[got] != key[open_])]
        return found

    def run(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all words, flat, and how many each word has."""
        words = len(lengths)
        sym, word = symbols.astype(np.int64), np.repeat(np.arange(words, dtype=np.int32), lengths)
        pair = np.full(len(sym), -1)
        inner = np.flatnonzero(word[:-1] == word[1:])
        pair[inner] = self.pairs(sym[inner], sym[inner + 1])
        rank = self._rank[pair]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.r_[heads, len(sym)])
            ended = best == NO_MERGE
            if ended.any():
                live = np.repeat(~ended, sizes)
                done.append((word[~live], sym[~live]))
                word, sym, pair, rank = word[live], sym[live], pair[live], rank[live]
                best, sizes = best[~ended], sizes[~ended]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            if len(hit) > len(best):
                follows = np.r_[False, np.diff(hit) == 1]
                run = np.maximum.accumulate(np.where(follows, -1, np.arange(len(hit))))
                keep = (np.arange(len(hit)) - run) % 2 == 0  # of overlapping pairs every second one
                first = np.r_[True, word[hit][1:] != word[hit][:-1]]
                hit = hit[keep & (first | ~self.alone[self.merged[pair[hit]]])]
            sym[hit] = self.merged[pair[hit]]
            stays = np.ones(len(sym), bool)
            stays[hit + 1] = False
            at = hit - np.arange(1, len(hit) + 1) + 1  # places after the others have moved up
            sym, word, pair, rank = sym[stays], word[stays], pair[stays], rank[stays]
            anew = np.concatenate([at, at[at > 0] - 1])
            anew = anew[anew + 1 < len(sym)]
            same = word[anew] == word[anew + 1]
            pair[at] = -1
            pair[anew] = np.where(same, self.pairs(sym[anew], sym[np.minimum(anew + 1, len(sym) - 1)]), -1)
            rank[at] = NO_MERGE
            rank[anew] = self._rank[pair[anew]]
        if not done:
            return np.zeros(0, np.int64), np.zeros(words, np.int64)
        word, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=words)


class WordTable:
    """Ids of the words seen so far by this worker; emptied when it is full."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 500_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _room(self, array: np.ndarray, need: int) -> np.ndarray:
        if need <= len(array):
            return array
        grown = np.zeros(max(need, len(array) * 3 // 2), array.dtype)
        grown[: len(array)] = array
        return grown

    def _add(self, words: list[str]) -> None:
        flat, sizes = self.encode(words)
        n, total = len(self.place), len(flat)
        self.flat = self._room(self.flat, self.used + total)
        self.start, self.size = self._room(self.start, n + len(words)), self._room(self.size, n + len(words))
        self.flat[self.used : self.used + total] = flat
        self.size[n : n + len(words)] = sizes
        self.start[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.place.update(zip(words, range(n, n + len(words)), strict=True))

    def ids(self, texts: list[list[str]]) -> Iterable[np.ndarray]:
        """The ids of each text, given as its words."""
        if len(self.place) > self.most:
            self._clear()
        flat = list(chain.from_iterable(texts))
        at = np.fromiter(map(self.place.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            late = [flat[i] for i in missing.tolist()]
            self._add(list(dict.fromkeys(late)))
            at[missing] = np.fromiter(map(self.place.__getitem__, late), np.int64, len(late))
        begin = 0
        for words in texts:
            own = at[begin : begin + len(words)]
            begin += len(words)
            yield self.flat[spread(self.start[own], self.size[own].astype(np.int64))]


def slices(values: list, weight: Callable[[object], int], most: int = 2_000_000) -> Iterable[tuple[int, int]]:
    """Ranges of ``values`` of about ``most`` weight each; a heavy value is alone."""
    begin, held = 0, 0
    for i, value in enumerate(values):
        held += weight(value)
        if held >= most:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(values):
        yield begin, len(values)


def parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` each 64-bit key belongs to; follows the order of keys."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def pack_parts(keys: np.ndarray, columns: list[np.ndarray], parts: int) -> Iterable[tuple[int, bytes]]:
    """One block of bytes for each part: its keys and the columns beside them."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    columns = [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(parts_of(keys, parts))) + 1
    for begin, end in zip(np.r_[0, cuts], np.r_[cuts, len(keys)], strict=True):
        if end > begin:
            yield int(parts_of(keys[begin : begin + 1], parts)[0]), b"".join(c[begin:end].tobytes() for c in [keys, *columns])


def unpack_parts(blocks: list[bytes], types: list[np.dtype]) -> list[np.ndarray]:
    """The keys and columns of all blocks of one part, put together."""
    width = sum(np.dtype(t).itemsize for t in types)
    columns: list[list[np.ndarray]] = [[] for _ in types]
    for block in blocks:
        n, at = len(block) // width, 0
        for held, kind in zip(columns, types, strict=True):
            held.append(np.frombuffer(block, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(c) for c in columns]
