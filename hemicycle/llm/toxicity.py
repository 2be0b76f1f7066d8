"""Toxicity from the nearest labelled examples.

Examples and documents are TF-IDF vectors over all words of the examples; a
word weighs the more the better it tells the label, and none is left out. The
examples' inverted index is cut into blocks that carry the largest weight of
each word; a block is read only if its bound can still reach the nearest
``NEIGHBOURS``, so the cosines found are exact. Neighbours vote with a power of
their cosine, and a logistic curve fitted on left-out votes makes a probability
of the vote.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hemicycle.session import cut_lineage

#: labelled rows at most that the model is fitted on, half of them for each label
MOST_EXAMPLES = 4000
#: weight of a word that says nothing about the label, beside the square root of its chi-squared value over what chance gives, by the examples
PLAIN, CHANCE = 0.02, 20.0
NEIGHBOURS, POWER, BLOCK = 16, 4, 32
#: words that this part of the examples holds are kept as dense rows: one in so many
COMMON = 16
#: texts scored at once
TEXTS = 64
#: blocks read in the first step
STEP = 8
#: a vote of this weight for the share of the label stands beside the neighbours
PRIOR_WEIGHT = 0.05
_WORD = re.compile(r"\w+")


def stems(text: str | None) -> Counter:
    """Counts of the words of a whole text."""
    return Counter(_WORD.findall((text or "").lower()))


class Postings:
    """Sparse lists of ``(place, weight)`` a word, in blocks of places with their largest weights."""

    def __init__(self, word: np.ndarray, place: np.ndarray, weight: np.ndarray, words: int, examples: int):
        order = np.lexsort((place, word))
        word, self.place, self.weight = word[order], place[order].astype(np.int32), weight[order]
        self.words, self.examples, self.blocks = words, examples, max(1, -(-examples // BLOCK))
        block, self.inside = self.place // BLOCK, self.place % BLOCK
        new = np.r_[True, (word[1:] != word[:-1]) | (block[1:] != block[:-1])] if len(word) else np.zeros(0, bool)
        self.begin = np.flatnonzero(new)  # of each run of a word in a block
        self.end = np.r_[self.begin[1:], len(word)] if len(word) else self.begin
        self.size = self.end - self.begin
        self.block = block[self.begin].astype(np.min_scalar_type(self.blocks))  # small numbers are sorted by their digits
        self.top = np.maximum.reduceat(self.weight, self.begin) if len(word) else self.weight
        self.runs = np.searchsorted(word[self.begin], np.arange(words + 1))  # of each word
        found = np.bincount(word, minlength=words)
        common = np.flatnonzero(found * COMMON >= max(1, examples))
        self.row = np.full(words, -1)  # of a common word in the dense part, which is multiplied for many texts at once
        self.row[common] = np.arange(len(common))
        self.dense = self[common.tolist()].reshape(len(common), self.blocks * BLOCK)

    def common(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What common words add to the cosines of some texts with every example."""
        x = np.zeros((len(vectors), len(self.dense)))
        for i, (at, w) in enumerate(vectors):
            row = self.row[at]
            dense = row >= 0
            x[i, row[dense]] = w[dense]
        return x @ self.dense

    def __getitem__(self, at: list[int]) -> np.ndarray:
        """Weights of some words as a dense array, word x block x place in the block."""
        out = np.zeros((len(at), self.blocks * BLOCK))
        for i, w in enumerate(at):
            runs = slice(self.runs[w], self.runs[w + 1])
            if runs.start < runs.stop:
                part = slice(self.begin[runs.start], self.end[runs.stop - 1])
                out[i, self.place[part]] = self.weight[part]
        return out.reshape(len(at), self.blocks, BLOCK)


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of some ranges, and the range of each."""
    size = end - begin
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) + (begin - np.cumsum(size) + size)[which], which


@dataclass
class Model:
    """Words with their weights, examples block by block, and the curve."""

    weight: dict[str, float]
    example_ids: np.ndarray
    labels: np.ndarray
    postings: Postings
    share: float
    curve: tuple[float, float]

    def __post_init__(self) -> None:
        self.place = {s: i for i, s in enumerate(self.weight)}
        self.idf = np.array(list(self.weight.values()))

    def known(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Places and counts of the words that the model has, by place."""
        place = np.fromiter((self.place.get(s, -1) for s in counts), np.int64, len(counts))
        order = np.argsort(place, kind="stable")[np.count_nonzero(place < 0) :]
        return place[order], np.fromiter(counts.values(), np.int64, len(counts))[order]

    def vector(self, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Stems of a text that the model knows, with unit weights."""
        at, counts = known
        if not len(at):
            return at, np.zeros(0)
        w = (1 + np.log(counts)) * self.idf[at]
        return at, w / np.linalg.norm(w)

    def nearest(self, at: np.ndarray, w: np.ndarray, skip: int = -1, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Exactly the nearest examples with a cosine over zero, best first; ties by place."""
        post = self.postings
        if common is None:
            common = post.common([(at, w)])[0]
        common = common.reshape(post.blocks, BLOCK)
        rare = post.row[at] < 0
        terms, w = at[rare], w[rare]
        runs, term = _ranges(post.runs[terms], post.runs[terms + 1])
        block, w = post.block[runs], w[term]
        bound = common.max(axis=1) + np.bincount(block, w * post.top[runs], post.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        by_block = np.argsort(block, kind="stable")  # the runs of each block
        runs, w = runs[by_block], w[by_block]
        last = np.cumsum(np.bincount(block, minlength=post.blocks))
        first = np.concatenate(([0], last[:-1]))
        ids, cos, worst = np.zeros(0, np.int64), np.zeros(0), 0.0
        begin = 0
        while begin < len(order):
            blocks = order[begin : begin + STEP + begin]  # as many again as were read
            begin += len(blocks)
            if len(ids) >= NEIGHBOURS:
                blocks = blocks[bound[blocks] >= worst - 1e-9]
                if not len(blocks):
                    break
            pick, which = _ranges(first[blocks], last[blocks])
            chosen = runs[pick]
            size, start = post.size[chosen], post.begin[chosen]
            of = np.repeat(np.arange(len(pick)), size)  # the run of each entry
            entry = np.arange(len(of)) + (start - np.cumsum(size) + size)[of]
            slot = (which * BLOCK)[of] + post.inside[entry]
            sums = np.bincount(slot, w[pick][of] * post.weight[entry], len(blocks) * BLOCK) + common[blocks].ravel()
            use = sums > max(0.0, worst - 1e-9)
            places = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()[use]
            other = places != skip
            ids, cos = np.concatenate((ids, places[other])), np.concatenate((cos, sums[use][other]))
            if len(ids) > NEIGHBOURS:
                best = np.lexsort((ids, -cos))[:NEIGHBOURS]
                ids, cos = ids[best], cos[best]
            if len(ids) == NEIGHBOURS:
                worst = cos.min()
        best = np.lexsort((ids, -cos))
        return ids[best], cos[best]

    def vote(self, near: np.ndarray, cos: np.ndarray) -> float:
        power = cos**POWER
        return float((power @ self.labels[near] + PRIOR_WEIGHT * self.share) / (power.sum() + PRIOR_WEIGHT))

    def score_all(self, texts: list[str | None]) -> Iterator[tuple[float, list[int], list[float]]]:
        """Probability of the label, with the examples that it rests on, of each text."""
        for begin in range(0, len(texts), TEXTS):
            vectors = [self.vector(self.known(stems(t))) for t in texts[begin : begin + TEXTS]]
            for (at, w), common in zip(vectors, self.postings.common(vectors), strict=True):
                near, cos = self.nearest(at, w, common=common) if len(at) else (np.zeros(0, np.int64), np.zeros(0))
                a, b = self.curve
                vote = np.clip(self.vote(near, cos), 1e-6, 1 - 1e-6)
                p = 1 / (1 + np.exp(-(a * np.log(vote / (1 - vote)) + b)))
                yield float(p), self.example_ids[near].tolist(), cos.tolist()


def chi_squared(n: int, pos: int, found: int, hits: int) -> float:
    """Of a word in ``found`` of ``n`` examples, ``hits`` of the ``pos`` labelled ones; 0 if it speaks against."""
    if hits * (n - pos) <= (found - hits) * pos:
        return 0.0
    b, c = found - hits, pos - hits
    d = n - pos - b
    return n * (hits * d - b * c) ** 2 / max(1e-9, found * (c + d) * pos * (n - pos))


def build(examples: list[tuple[int, int, Counter]], found: dict[str, tuple[int, int]], totals: dict[int, int]) -> Model:
    """Fit on ``(id, label, words)``.

    ``found`` has the examples and labelled examples of each word, ``totals``
    the labelled rows of each label.
    """
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    n, pos = len(examples), sum(label for _, label, _ in examples)
    weight, told = {}, {}
    for word, (k, h) in sorted(found.items()):
        told[word] = (max(0.0, chi_squared(n, pos, k, h) - CHANCE) / max(1, n)) ** 0.5
        weight[word] = float((np.log(n / k) + 0.1) * (PLAIN + told[word]))
    # like examples share blocks, which keeps the bounds low
    rows = [(i, label, c) for i, label, c in examples if c]
    lead = [max(c, key=lambda s: (told[s] * weight[s], s)) for _, _, c in rows]
    rows = [r for _, r in sorted(zip(lead, rows, strict=True), key=lambda x: (-told[x[0]], x[0], x[1][1], x[1][0]))]
    place = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    model = Model(weight, np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float), Postings(*place, len(weight), 0), share, (1.0, 0.0))
    vectors = [model.vector(model.known(r[2])) for r in rows]
    if rows:
        word = np.concatenate([at for at, _ in vectors])
        at = np.repeat(np.arange(len(rows)), [len(at) for at, _ in vectors])
        model.postings = Postings(word, at, np.concatenate([w for _, w in vectors]), len(weight), len(rows))
    votes = []
    for begin in range(0, len(rows), TEXTS):
        part = vectors[begin : begin + TEXTS]
        for j, ((at, w), common) in enumerate(zip(part, model.postings.common(part), strict=True), begin):
            votes.append(model.vote(*model.nearest(at, w, skip=j, common=common)))
    silent = Counter(label for _, label, c in examples if not c)
    prior = model.vote(np.zeros(0, np.int64), np.zeros(0))
    x = np.array(votes + [prior, prior]).clip(1e-6, 1 - 1e-6)
    y = np.array([r[1] for r in rows] + [0, 1], float)
    count = np.r_[np.ones(len(rows)), silent[0], silent[1]]
    have = {k: max(1, sum(1 for e in examples if e[1] == k)) for k in (0, 1)}
    count *= np.where(y > 0, totals.get(1, 0) / have[1], totals.get(0, 0) / have[0])  # as often as labelled rows have the label
    model.curve = logistic(np.log(x / (1 - x)), y, count)
    return model


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit, by damped Newton steps."""
    t = np.array([1.0, 0.0])
    design = np.c_[x, np.ones(len(x))]
    total = max(weight.sum(), 1e-9)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(design @ t).clip(-30, 30)))
        gradient = design.T @ (weight * (p - y)) / total + 1e-3 * (t - [1.0, 0.0])
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design / total + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        t = t - step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(max(t[0], 1e-3)), float(t[1])


def in_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``MOST_EXAMPLES`` labelled rows outside the held-out fold.

    Rows are taken in the order of a hash of the id, half for each label (the
    rest of a short half goes to the other). A document with several labels
    has the highest; null labels and ids do not count. Only word counts of the
    chosen rows come to the driver.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.max(label_col) > 0).cast("int").alias("label"))
    known = known.filter(~in_held_out(F.col(id_col))).join(docs.select(id_col).distinct(), id_col, "left_semi")
    known = cut_lineage(known)
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    half = MOST_EXAMPLES // 2
    take = {1: min(totals.get(1, 0), max(half, MOST_EXAMPLES - totals.get(0, 0)))}
    take[0] = min(totals.get(0, 0), MOST_EXAMPLES - take[1])
    order = F.xxhash64(F.col(id_col), F.lit(7))
    chosen = None
    for label, most in take.items():
        part = known.filter(F.col("label") == label).orderBy(order, id_col).limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = cut_lineage(chosen)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.withColumnRenamed(id_col, "id")), "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [stems(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))],
                names=["id", "label", "stems", "counts"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    sums = rows.select("id", "text", "label").mapInArrow(count, f"id {kind}, label int, stems array<string>, counts array<bigint>")
    # bounded by the sample, as all that follows
    counts, found = {}, {}
    rows = cut_lineage(sums.groupBy("id").agg(F.max("label").alias("label"), F.collect_list(F.struct("stems", "counts")).alias("parts")))
    for r in rows.toLocalIterator():
        sum_of: Counter = Counter()
        for part in r["parts"]:  # rows that share an id are one example
            for word, c in zip(part["stems"], part["counts"], strict=True):
                sum_of[word] += c
        counts[r["id"]] = sum_of
        for word in sum_of:
            k, h = found.get(word, (0, 0))
            found[word] = k + 1, h + r["label"]
    examples = [(r[id_col], r["label"], counts.get(r[id_col], Counter())) for r in chosen.collect()]
    return build(sorted(examples, key=lambda e: e[0]), found, totals)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", model: Model | None = None
) -> DataFrame:
    """``id_col, held_out, score, predicted, evidence, cosines`` of every row.

    ``evidence`` are the ids of the examples that voted. Null and empty texts,
    and texts without a known word, get the score of the bare prior. Without
    labels every score is the same. Rows with null or repeated ids are scored
    as rows of their own; an empty table gives an empty result.
    """
    model = model or fit(docs, labels, id_col, text_col, label_col)
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the words of MOST_EXAMPLES texts at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            found = list(own.score_all(batch.column(2).to_pylist()))
            scores = [f[0] for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                    pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.float64())),
                ],
                names=[id_col, "held_out", "score", "predicted", "evidence", "cosines"],
            )

    rows = docs.select(F.col(id_col), in_held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int, evidence array<bigint>, cosines array<double>")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([f[0] < 0.5 for f in sent.value.score_all(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
