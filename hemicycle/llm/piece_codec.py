"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model file is only read for its pieces and scores. Text becomes words (a
run of space marks and what follows it), and the distinct words of a batch are
merged together in flat arrays. A word that was seen before is not merged again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hemicycle.llm.arrays import MergeRounds, WordTable, slices, spread

SPACE = "▁"
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class PieceCodec:
    """Encoder and decoder of one model with byte fallback and no normalisation."""

    def __init__(self, model: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(n)]
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        self.byte = np.zeros(256, np.int32)
        for i in range(n):
            if lib.is_byte(i):
                self.byte[int(self.pieces[i][1:-1], 16)] = i
        at = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in at):
            raise ValueError("pieces that go on after a space mark can't be encoded word by word")
        for c in sorted({c for p in at for c in p} - at.keys()):  # never final on its own
            at[c] = len(at) + n
        names = {i: p for p, i in at.items()}
        left, right, rank, merged = [], [], [], []
        order = {i: r for r, i in enumerate(sorted((i for i in at.values() if i < n), key=lambda i: (-lib.get_score(i), i)))}
        for piece, i in at.items():
            for cut in range(1, len(piece)):
                a, b = at.get(piece[:cut]), at.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(order[i]), merged.append(i)
        self.other = max(names, default=0) + 1  # symbols from here on are code points without a piece
        self.rounds = MergeRounds(np.array(left), np.array(right), np.array(rank), np.array(merged), self.other + 0x110000)
        points = sorted((ord(p), i) for p, i in at.items() if len(p) == 1)
        self.point, self.point_id = np.array([p for p, _ in points]), np.array([i for _, i in points])
        self.names = names
        surface = [b"" if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        for value, i in enumerate(self.byte):
            surface[i] = bytes([value])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_len = np.array([len(s) for s in surface])
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len
        self.table = WordTable(self._words)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, flat, and their counts."""
        flat, counts = [], []
        for begin, end in slices(words, len, 50_000):
            some = words[begin:end]
            points = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32).astype(np.int64)
            near = np.searchsorted(self.point, points).clip(0, len(self.point) - 1)
            known = self.point[near] == points
            symbols = np.where(known, self.point_id[near], self.other + points)
            sizes = np.fromiter(map(len, some), np.int64, len(some))
            ids, n = self.rounds.run(symbols, sizes)
            ids, n = self._fall_back(ids, n)
            flat.append(ids), counts.append(n)
        return np.concatenate(flat), np.concatenate(counts)

    def _fall_back(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the pieces of their bytes."""
        odd = np.flatnonzero(ids >= len(self.pieces))
        if not len(odd):
            return ids, n
        texts = [(self.names.get(int(i)) or chr(int(i) - self.other)).encode() for i in ids[odd]]
        width = np.ones(len(ids), np.int64)
        width[odd] = [len(t) for t in texts]
        word = np.repeat(np.arange(len(n)), n)
        out = np.repeat(ids, width)
        places = spread((np.cumsum(width) - width)[odd], width[odd])
        out[places] = self.byte[np.frombuffer(b"".join(texts), np.uint8)]
        return out, np.bincount(np.repeat(word, width), minlength=len(n))

    @staticmethod
    def split(text: str) -> list[str]:
        """Words whose merges are independent; their texts give the marked text."""
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " ":
            return _WORDS.findall(SPACE + text.replace(" ", SPACE))
        return (SPACE + text.replace(" ", f" {SPACE}").replace("\n", " \n")).split(" ")

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of every text with the begin and end ids."""
        for begin, end in slices(texts, len):
            for ids in self.table.ids([self.split(t) for t in texts[begin:end]]):
                yield np.r_[self.begin, ids, self.end].astype("<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the text: pieces put together, marks as spaces, no first space."""
        ids = ids.astype(np.int64)
        text = self.surface[spread(self.surface_at[ids], self.surface_len[ids])].tobytes()
        text = text[1:] if text[:1] == b" " else text
        return text


@lru_cache(maxsize=2)
def codec(model: str) -> PieceCodec:
    return PieceCodec(model)


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """Encode and decode whole texts.

    Returns ``id_col, n_tokens, ids_sha256, decoded_sha256`` and, with
    ``full``, also ``ids`` and ``decoded``. Null texts count as empty and give
    the begin and end ids; rows with equal or null ids stay rows of their own.
    An empty table gives an empty result; other columns are not read.
    ``model`` is the path of a SentencePiece BPE model on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if full else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model)
        for batch in batches:
            n, ids_hash, text_hash, ids, texts = [], [], [], [], []
            for one in coder.encode(batch.column(1).to_pylist()):
                back = coder.decode(one)
                n.append(len(one))
                ids_hash.append(hashlib.sha256(one.tobytes()).hexdigest())
                text_hash.append(hashlib.sha256(back).hexdigest())
                if full:
                    ids.append(one.astype(np.int32)), texts.append(back.decode("utf-8", "replace"))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            if full:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if full else [])])

    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInArrow(run, schema)
