"""Best-fit packing of token sequences by rounds of local packing and merging.

A partition packs its pieces best-fit and emits the bins that are nearly full.
Bins with room are items of the next round, where fewer partitions each pack
the rest of several; this goes on while a round still saves bins.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hemicycle.llm.arrays import WordTable, slices
from hemicycle.session import cut_lineage

#: a bin with this share of the capacity is not opened again
NEARLY_FULL = 0.999
#: free items that one task of a merge round packs, about
ITEMS_PER_TASK = 20_000

_PLAIN = re.compile("[a-zà-öø-ÿ]+|[.,!?|;:]+")
_CLOSED = re.compile("(?<=[a-zà-öø-ÿ])([.,])(?=[ \n])")
_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_BINS = "size int, members array<struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint>>"


class WordIds:
    """Ids of a word-level BPE file; texts go through it word by word.

    Words are cut at the white space that the file's own splitter drops. Plain
    words go straight to the merges; all others through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        byte = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in byte]
        self.shown = {b: chr(b) for b in byte} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.table = WordTable(self._words)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out: list[list[int]] = []
        tokens, plain, shown, odd = self.lib.model.tokenize, _PLAIN.fullmatch, self.shown, []
        for word in words:
            if plain(word):
                out.append([t.id for t in tokens(word if word.isascii() else word.encode().decode("latin-1").translate(shown))])
            else:
                odd.append(len(out) if word else -1)
                out.append([])
        odd = [i for i in odd if i >= 0]
        for i, found in zip(odd, self.lib.encode_batch([words[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = found.ids
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter((i for ids in out for i in ids), np.int32, int(sizes.sum())), sizes

    @staticmethod
    def split(text: str) -> list[str]:
        """Parts that the file's splitter would never join, in lower case."""
        if "Σ" not in text:  # its lower case hangs on what follows, which the file ignores
            text = text.lower()
        return _CLOSED.sub(r" \1", text).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for begin, end in slices(texts, len):
            yield from self.table.ids([self.split(t) for t in texts[begin:end]])


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items put, largest first, into the open bin that they fill most."""
    bins: list[list[int]] = []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room
    rooms: list[int] = []  # the rooms that some bin has, in order
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(rooms, size)
        if at == len(rooms):
            room, number = capacity, len(bins)
            bins.append([])
        else:
            room = rooms[at]
            number = open_at[room].pop()
            if not open_at[room]:
                rooms.pop(at)
        bins[number].append(i)
        if room := room - size:
            if not open_at[room]:
                insort(rooms, room)
            open_at[room].append(number)
    return bins


def _bins(sizes: list[int], members: list[list[dict]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(members, pa.list_(_MEMBER))], names=["size", "members"])


def _packed(items: list[tuple[int, list[dict]]], capacity: int) -> pa.RecordBatch:
    sizes = np.array([s for s, _ in items], np.int64)
    bins = best_fit(sizes, capacity)
    return _bins([int(sizes[b].sum()) for b in bins], [[m for i in b for m in items[i][1]] for b in bins])


def local_bins(docs: DataFrame, tokenizer: str, capacity: int, closing_id: int, id_col: str, text_col: str) -> DataFrame:
    """Bins of each input partition; full ones leave the task at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(tokenizer)
        items: list[tuple[int, list[dict]]] = []
        for batch in batches:
            full = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist()), strict=True):
                ids = np.r_[ids, closing_id].astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    member = {"doc_id": doc_id, "piece": piece, "start": start, "length": len(part), "ids_crc32": zlib.crc32(part.tobytes())}
                    (full if len(part) == capacity else items).append((len(part), [member]))
            if full:
                yield _bins([s for s, _ in full], [m for _, m in full])
            if len(items) >= ITEMS_PER_TASK:
                yield _packed(items, capacity)
                items = []
        if items:
            yield _packed(items, capacity)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, _BINS)


def merge_bins(bins: DataFrame, parts: int, capacity: int) -> DataFrame:
    """One round: bins with room, dealt to ``parts`` tasks, are packed as items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[tuple[int, list[dict]]] = []
        for batch in batches:
            items += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            if sum(map(len, (m for _, m in items))) >= 8 * ITEMS_PER_TASK:  # bounded, whatever a task is dealt
                yield _packed(items, capacity)
                items = []
        if items:
            yield _packed(items, capacity)

    return bins.repartition(parts).mapInArrow(run, _BINS)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, closing_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the token ids of all documents into sequences of at most ``capacity``.

    A document is its ids and ``closing_id``; longer ones are cut into pieces
    of ``capacity``. Returns per piece ``doc_id, piece, start, length,
    ids_crc32, sequence_id, offset``. Null and empty texts are one closing id;
    rows with equal or null ids are packed as rows of their own; an empty table
    gives an empty result; other columns are not read.
    """
    bins = cut_lineage(local_bins(docs, tokenizer, capacity, closing_id, id_col, text_col))
    enough = int(capacity * NEARLY_FULL)
    done = bins.filter(F.col("size") >= enough)
    loose = bins.filter(F.col("size") < enough)
    count, items = loose.agg(F.count("*"), F.coalesce(F.sum(F.size("members")), F.lit(0))).first()
    while count > 1:
        parts = max(1, -(-items // ITEMS_PER_TASK), -(-count // ITEMS_PER_TASK))
        merged = cut_lineage(merge_bins(loose, parts, capacity))
        total = merged.count()
        done = done.unionByName(merged.filter(F.col("size") >= enough))
        loose = merged.filter(F.col("size") < enough)
        left, items = loose.agg(F.count("*"), F.coalesce(F.sum(F.size("members")), F.lit(0))).first()
        if parts == 1 or total > 0.99 * count:
            break
        count = left
    numbered = done.unionByName(loose).withColumn("sequence_id", F.monotonically_increasing_id())
    offsets = F.expr(
        "transform(members, (m, i) -> named_struct('m', m, 'offset', aggregate(slice(members, 1, i), 0L, (a, x) -> a + x.length)))"
    )
    rows = numbered.select("sequence_id", F.explode(offsets).alias("r"))
    return rows.select("r.m.*", "sequence_id", F.col("r.offset").alias("offset"))
