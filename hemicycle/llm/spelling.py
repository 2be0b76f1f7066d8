"""Spelling variants by blocked Gram matrices of letter counts.

Words that differ by one inserted, deleted or replaced code point have letter
counts at a squared distance of one (a length more) or two (equal lengths). A
NumPy product of two blocks of letter counts gives all their squared distances
at once; only pairs at exactly those values are compared letter by letter.

Blocks are cells of words of one length with equal counts in a few groups of
letters. One edit moves a word to the same cell, to one where two groups differ
by one, or to one of the next length where one group does, so a cell meets its
own words and a fixed number of neighbour cells, each pair of cells once. A
crowded cell is cut into chunks; a chunk meets one chunk of every neighbour at a
time, so no row holds more than a fixed number of chunks, whatever the cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hemicycle.llm.storage import settled

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"
#: letter groups whose counts make the cells: a code point's remainder
GROUPS = 6
#: code points a chunk should have, about
CHUNK = 1 << 14
#: entries of one distance matrix
TILE = 1 << 22
_FOUND = "word string, near long, best_n long, best string"


def typed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, every: int = 31) -> DataFrame:
    """Words with at least ``least`` code points, one row an occurrence.

    Of a run whose ``crc32("id:run")`` is a multiple of ``every`` the code point
    at ``crc32 % length`` is left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run")
    ).filter(F.length("run") >= least)
    ascii_only = F.octet_length("run") == F.length("run")
    low = runs.select("id", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h")).filter(
        (F.length("run") > least) | (F.col("h") % every != 0)
    )
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def _cell(word: Column) -> list[Column]:
    """Length, then the letters in each group but the last (the rest)."""
    groups = ["".join(chr(c) for c in [*range(97, 123), *range(65, 91), *range(0xC0, 0x100)] if c % GROUPS == g) for g in range(GROUPS)]
    size = F.length(word)
    return [size, *[size - F.length(F.translate(word, g, "")) for g in groups[:-1]]]


def _steps() -> list[list[int]]:
    """Offsets from a cell to the neighbours it meets; the others meet it."""
    def offset(size: int, plus: int, minus: int | None) -> list[int]:
        return [size, *[(g == plus) - (g == minus) for g in range(GROUPS - 1)]]

    same = [offset(0, i, j) for i in range(GROUPS) for j in range(i)]
    return [[0] * GROUPS, *same, *[offset(1, i, None) for i in range(GROUPS)]]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters differ by one edit; ``b`` is as long as ``a`` or one longer."""
    size = a.shape[1]
    if b.shape[1] == size:
        return (a != b).sum(axis=1) == 1
    same, late = a == b[:, :-1], a == b[:, 1:]
    head = np.where(same.all(axis=1), size, np.argmin(same, axis=1))  # equal letters at the start
    tail = np.where(late.all(axis=1), size, np.argmin(late[:, ::-1], axis=1))  # and at the end
    return head + tail >= size


def _letters(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def near_pairs(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs one edit apart; all words of a side are equally long."""
    a, b = _letters(left), _letters(right)
    alphabet, place = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
    kind = np.float32 if max(a.shape[1], b.shape[1]) < 1 << 10 else np.float64

    def counts(letters: np.ndarray, codes: np.ndarray) -> np.ndarray:
        spots = np.repeat(np.arange(len(letters)), letters.shape[1]) * len(alphabet) + codes
        return np.bincount(spots, minlength=len(letters) * len(alphabet)).reshape(len(letters), -1).astype(kind)

    ca, cb = counts(a, place[: a.size]), counts(b, place[a.size :])
    # |a|^2 - 2 a.b + |b|^2 as one product
    ca = np.column_stack([ca, (ca * ca).sum(axis=1), np.ones(len(ca), kind)])
    cb = np.column_stack([-2 * cb, np.ones(len(cb), kind), (cb * cb).sum(axis=1)]).T
    wanted = 2 if a.shape[1] == b.shape[1] else 1
    lefts, rights = [], []
    step = max(1, TILE // len(b))
    for begin in range(0, len(a), step):
        i, j = np.nonzero(ca[begin : begin + step] @ cb == wanted)
        for at in range(0, len(i), TILE // 16):  # compared letter by letter in bounded pieces
            x, y = i[at : at + TILE // 16] + begin, j[at : at + TILE // 16]
            good = one_edit(a[x], b[y])
            lefts.append(x[good]), rights.append(y[good])
    empty = np.zeros(0, np.int64)
    return np.concatenate([*lefts, empty]).astype(np.int64), np.concatenate([*rights, empty]).astype(np.int64)


def _summary(at: np.ndarray, other: np.ndarray, words: list[str], others: list[str], n: np.ndarray) -> list[tuple[str, int, int, str]]:
    """For each word of ``at``: how many near words, and the most frequent one."""
    rank = np.argsort(np.argsort(np.array(others, dtype=object), kind="stable"), kind="stable")
    order = np.lexsort((rank[other], -n[other], at))
    at, other = at[order], other[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
    sizes = np.diff(np.r_[first, len(at)])
    return [
        (words[i], s, int(n[j]), others[j]) for i, s, j in zip(at[first].tolist(), sizes.tolist(), other[first].tolist(), strict=True)
    ]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A home chunk with the chunks that visit it: ``home, home_n, guests, guests_n, itself``."""
    for batch in batches:
        rows: list[tuple[str, int, int, str]] = []
        for home, n, guests, m, itself in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            left, right = guests.split(" "), home.split(" ")  # guests are as long or one shorter
            count, many = np.array(m), np.array(n)
            i, j = near_pairs(left, right)
            rows += _summary(i, j, left, right, many)
            if not itself:  # within one chunk every pair is found from both sides
                rows += _summary(j, i, right, left, count)
        if rows:
            word, near, best_n, best = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(word), pa.array(near, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best)], names=["word", "near", "best_n", "best"]
            )


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` of each word of ``(word, n)`` that has near words.

    ``best`` is the near word of largest n, of equal ones the smallest.
    """
    cell = _cell(F.col("word"))
    keyed = words.select("word", "n", F.array(*cell).alias("cell"))
    sizes = keyed.groupBy("cell").agg(F.ceil(F.count("*") * F.element_at("cell", 1) / CHUNK).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int")
    dealt = keyed.join(sizes, "cell").withColumn("chunk", chunk)
    packed = F.array_agg(F.struct("word", "n"))  # about CHUNK code points
    blocks = dealt.groupBy("cell", "chunk").agg(packed.alias("p")).select(
        "cell", "chunk", F.array_join("p.word", " ").alias("words"), F.col("p.n").alias("n")
    )
    blocks = settled(blocks)
    places = blocks.select("cell", "chunk")
    to = F.explode(F.array(*[F.array(*[F.lit(v) for v in s]) for s in _steps()]))
    visits = blocks.select(F.col("cell").alias("from"), F.col("chunk").alias("part"), "words", F.col("n").alias("m"), to.alias("step"))
    own = F.array_max(F.transform("step", F.abs)) == 0
    visits = visits.select("part", "words", "m", own.alias("own"), F.col("step")[0].alias("shorter"), F.zip_with("from", "step", lambda a, b: a + b).alias("cell"))
    met = visits.join(places, "cell").filter(~F.col("own") | (F.col("part") <= F.col("chunk")))
    itself = F.col("own") & (F.col("part") == F.col("chunk"))
    # one chunk of each neighbour at most, so a row holds a fixed number of chunks
    guests = met.groupBy("cell", "chunk", "part", "shorter", itself.alias("itself")).agg(F.array_agg(F.struct("words", "m")).alias("g"))
    rows = guests.join(blocks, ["cell", "chunk"]).select(
        "words", "n", F.array_join("g.words", " ").alias("guests"), F.flatten("g.m").alias("m"), "itself"
    )
    found = rows.mapInArrow(_meet, _FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.n")).alias("best_n"), "b.best"
    )


def follow(links: DataFrame) -> DataFrame:
    """``word, root``: the last word that the forms of ``(word, form)`` lead to.

    Forms never lead back, as each is far more frequent than the one before.
    Every round doubles the steps taken, and a chain has as many as counts have
    digits, so a few rounds are enough.
    """
    now = settled(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = settled(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_went")))
        if step.filter("_went").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, factor: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word that occurs twice or more.

    ``form`` is the near word (one edit away) of largest n, of equal ones the
    smallest in code-point order, if its n is ``factor`` times the word's n or
    more; otherwise null, as ``form_n``. ``root`` is the word at the end of the
    forms, the word itself if it has none.

    Null and empty texts have no words; a null id counts as an empty one in the
    hash that leaves letters out; rows that share an id count each. Runs may be
    of any length. Other columns are ignored. Without words there are no rows.
    """
    counted = typed_words(docs, id_col, text_col, least).groupBy("word").agg(F.count("*").alias("n")).filter("n >= 2")
    words = settled(counted)
    near = near_words(words)
    fits = F.col("best_n") >= factor * F.col("n")
    full = settled(words.join(near, "word", "left").select(
        "word", F.when(fits, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best_n")).alias("form_n"),
    ))
    roots = follow(full.filter("form is not null"))
    return full.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
