"""Centroid clustering on whole numbers with an incremental distance matrix.

Every vector keeps its exact dot products with all centroids. A squared
distance is ``|x|^2 - 2 x.c + |c|^2``, so when a centroid moves, its column of
products changes by ``x.(new - old)``, which touches only the components that
changed; a centroid that stays costs nothing. The products are stored after
each round in the checkpoint folder in the smallest integers that hold them.
Sums of a cluster are added up inside each task, then by Spark; the driver sees
one number per centroid and component.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hemicycle.llm.storage import settled

#: bits of the pieces in which long components are summed
PIECE = 26
#: products below this are exact in doubles, below the other in 64-bit integers
EXACT_DOUBLE, EXACT_LONG = 1 << 53, 1 << 62
MOST_LONG = (1 << 63) - 1
_STATE = "id long, ints binary, dots binary, cluster int, distance long"


def _size(values: np.ndarray) -> int:
    return max(abs(int(values.max())), abs(int(values.min()))) if values.size else 0


def _fitted(values: np.ndarray) -> np.ndarray:
    """64-bit integers if all values are below their half, Python integers otherwise."""
    return values.astype(np.int64) if values.dtype != object or _size(values) < EXACT_LONG else values


def whole_numbers(lists: list[list[float]], scale: int) -> np.ndarray:
    """``floor(scale * x)`` of all components, exactly."""
    x = np.asarray(lists, np.float64)
    if _size(np.abs(x)) * scale < EXACT_DOUBLE:  # a multiple by a power of two is exact
        return np.floor(x * scale).astype(np.int64)
    wide = [[math.floor(Fraction(v) * scale) for v in row] for row in x.tolist()]
    return np.array(wide, dtype=object).reshape(x.shape)


def pack(rows: np.ndarray) -> list[bytes]:
    """Each row as bytes: a letter for the type, then its numbers."""
    most = _size(rows)
    if most >= EXACT_LONG:
        return [b"t" + ",".join(map(str, r)).encode() for r in rows.tolist()]
    kind = "h" if most < 1 << 15 else "i" if most < 1 << 31 else "q"
    return [kind.encode() + r.tobytes() for r in np.ascontiguousarray(rows, dtype=kind)]


def unpack(blobs: list[bytes], width: int) -> np.ndarray:
    kinds = np.array([b[:1] for b in blobs])
    out = np.zeros((len(blobs), width), object if (kinds == b"t").any() else np.int64)
    for kind in np.unique(kinds).tolist():
        at = np.flatnonzero(kinds == kind)
        if kind == b"t":
            out[at] = np.array([[int(v) for v in blobs[i][1:].split(b",")] for i in at.tolist()], dtype=object)
        else:
            out[at] = np.frombuffer(b"".join(blobs[i][1:] for i in at.tolist()), kind.decode()).reshape(len(at), width)
    return out


def _times(x: np.ndarray, step: np.ndarray) -> np.ndarray:
    """``x @ step`` exactly, in the fastest arithmetic that allows it."""
    bound = _size(x) * _size(step) * max(1, x.shape[1])
    if bound < EXACT_DOUBLE:
        return np.rint(x.astype(np.float64) @ step.astype(np.float64)).astype(np.int64)
    if bound < EXACT_LONG:
        return x.astype(np.int64) @ step.astype(np.int64)
    return x.astype(object) @ step.astype(object)


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if _size(a) + _size(b) < EXACT_LONG:
        return _fitted(a) + _fitted(b)
    return a.astype(object) + b.astype(object)


def moved(x: np.ndarray, dots: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The products of ``x`` with ``new``, from those with ``old``."""
    step = _fitted(new.astype(object) - old.astype(object))
    changed = step != 0
    if changed.all():
        return _sum(dots, _times(x, step.T))
    out = dots.copy()
    for c in np.flatnonzero(changed.any(axis=1)).tolist():
        at = np.flatnonzero(changed[c])
        column = _sum(out[:, c], _times(x[:, at], step[c, at]))
        out = out.astype(object) if column.dtype == object else out
        out[:, c] = column
    return out


def nearest(x: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, the first of equal ones, and its squared distance."""
    if 4 * x.shape[1] * max(_size(x), _size(centroids)) ** 2 < EXACT_LONG:
        x, dots, centroids = (v.astype(np.int64) for v in (x, dots, centroids))
    else:
        x, dots, centroids = (v.astype(object) for v in (x, dots, centroids))
    distance = (x * x).sum(axis=1)[:, None] - 2 * dots + (centroids * centroids).sum(axis=1)
    best = np.argmin(distance, axis=1)
    return best, distance[np.arange(len(x)), best]


def _assign(old: np.ndarray, new: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unpack(batch.column("ints").to_pylist(), new.shape[1])
            if batch.schema.get_field_index("dots") < 0:
                dots = np.zeros((len(x), len(new)), np.int64)
            else:
                dots = unpack(batch.column("dots").to_pylist(), len(new))
            dots = moved(x, dots, old, new)
            cluster, distance = nearest(x, dots, new)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("ints"), pa.array(pack(dots), pa.binary()), pa.array(cluster.astype(np.int32)),
                    pa.array([min(int(d), MOST_LONG) for d in distance.tolist()], pa.int64()),
                ],
                names=["id", "ints", "dots", "cluster", "distance"],
            )

    return run


def _sums(count: int, width: int):
    """Rows ``cluster, component, piece, amount`` of a task; component -1 counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = defaultdict(lambda: np.zeros((count, width), np.int64))
        sizes = np.zeros(count, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, cluster = unpack(batch.column("ints").to_pylist(), width), batch.column("cluster").to_numpy()
            sizes += np.bincount(cluster, minlength=count)
            piece = 0
            while _size(x) >= 1 << PIECE:
                np.add.at(held[piece], cluster, (x & ((1 << PIECE) - 1)).astype(np.int64))
                x, piece = x >> PIECE, piece + 1
            np.add.at(held[piece], cluster, x.astype(np.int64))
        rows = [(c, -1, 0, int(n)) for c, n in enumerate(sizes.tolist()) if n]
        for piece, total in held.items():
            c, d = np.nonzero(total)
            rows += zip(c.tolist(), d.tolist(), [piece] * len(c), total[c, d].tolist(), strict=True)
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(columns, [pa.int32(), pa.int32(), pa.int32(), pa.int64()], strict=True)],
            names=["cluster", "component", "piece", "amount"],
        )

    return run


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floored mean of each cluster; an empty one keeps its centroid."""
    count, width = centroids.shape
    rows = state.select("ints", "cluster").mapInArrow(_sums(count, width), "cluster int, component int, piece int, amount long")
    total: dict[tuple[int, int], int] = defaultdict(int)
    # one row a centroid, component and piece
    for r in rows.groupBy("cluster", "component", "piece").agg(F.sum("amount").alias("amount")).collect():
        total[r.cluster, r.component] += r.amount << (PIECE * r.piece)
    out = centroids.astype(object)
    for c in range(count):
        if size := total.get((c, -1)):
            out[c] = [total.get((c, d), 0) // size for d in range(width)]
    return _fitted(out)


def cluster_vectors(
    vectors: DataFrame, count: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: str = "2",
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors with exactly ``width`` components, none null or non-finite, are
    kept; each component x becomes floor(scale * x). The first centroids are the
    kept vectors whose ``seed:id`` has the smallest sha256; each round assigns
    all vectors to the nearest centroid (ties: the smaller number) and moves
    every centroid that has vectors to their floored mean; then all are
    assigned once more.

    Rows that share an id count each. Rows without an id are assigned but never
    start a cluster. With fewer such vectors than ``count`` there are fewer
    clusters; without any there are no rows. Other columns are ignored.
    Distances and sums beyond the range of a long are shown as its maximum;
    the assignment itself is exact for numbers of any size.
    """
    spark = vectors.sparkSession
    names = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = base.filter((F.size("v") == width) & ~odd)
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = kept.filter("id is not null").orderBy(first, "v").limit(count).collect()  # ``count`` rows
    if not starts:
        return spark.createDataFrame([], names)

    def ints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                numbers = pack(whole_numbers(batch.column("v").to_pylist(), scale))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(numbers, pa.binary())], names=["id", "ints"])

    state = kept.mapInArrow(ints, "id long, ints binary")
    centroids = _fitted(whole_numbers([r.v for r in starts], scale))
    before = np.zeros_like(centroids)
    for left in range(rounds, -1, -1):
        state = settled(state.mapInArrow(_assign(before, centroids), _STATE))
        if left:
            before, centroids = centroids, _means(state, centroids)

    inertia = dict(state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())  # one row a centroid
    inertia = {c: int(v) for c, v in inertia.items()}
    whole = min(sum(inertia.values()), MOST_LONG)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(c, min(v, MOST_LONG), whole, digest[c]) for c, v in sorted(inertia.items())]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select(F.col("id").alias(id_col), "cluster", "distance").join(F.broadcast(table), "cluster").select(
        id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
