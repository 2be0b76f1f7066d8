"""Permutation inference for spatial statistics, as arrays of draws.

Draws come from md5 digests of their names, which any SQL engine can repeat, and
serve all variables at once. Conditional draws have one row a slot with all draws
in one array; permutations of all units are made in batches of packed bytes, and
the files of a batch are removed before the next.

``members`` is (keys, unit_id, y): the units of each key with one array of
values. Its positions 0, 1, ... in the order of unit_id are what is permuted.
Neighbour relations are rows (keys, layer, group, node, bits): bit b says that
position 64 * group + b has ``node`` as a neighbour in that layer.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5
from math import sin
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from hemicycle.functions.frames import attach, sized
from hemicycle.functions.ordered import row_index
from hemicycle.session import cut_lineage, shuffles_removed

#: positions of a block; two blocks of values are the most a task holds
BLOCK = 2048
#: blocks and chunks double from ``PARTS`` of them on, up to ``WIDEST`` positions, so that rows of a draw don't grow with the square of the units
PARTS, WIDEST = 64, 1 << 15
#: digests made at once, in the processor's cache
LANES = 1 << 14
#: numbers of one array that a task fills at a time
TILE = 1 << 21
#: draws this much below the observed value, in units of the sum of squares, count as equal
EQUAL = 1e-9
#: positions whose digests a task makes at a time, and digests that it sorts at a time
CHUNK, RUN = 1 << 12, 1 << 16
#: a batch has at least ``LEAST`` draws, and more while it has fewer than ``DRAWN`` values
LEAST, DRAWN = 32, 1 << 23


def name_of(keys: Sequence[str], *parts) -> Column:
    """``key:..:part:..``, the text whose md5 digest is a draw."""
    return F.concat_ws(":", *[F.col(k).cast("string") for k in keys], *[p.cast("string") for p in parts])


def placed(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add position ``pos`` and size ``n`` of the key; units with a null value take no part."""
    keys = list(keys)
    full = members.filter(F.forall("y", lambda v: v.isNotNull()))
    rows = row_index(full, keys, ["unit_id"], "pos")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return cut_lineage(rows.join(sizes, keys) if keys else rows.withColumn("n", sizes.select("n").scalar()))


def single_layer(ways: DataFrame, where: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Relation of one layer from directed pairs (src, dst) within each key."""
    keys = list(keys)
    src = where.select(*keys, F.col("unit_id").alias("src"), F.col("pos").alias("_i"))
    dst = where.select(*keys, F.col("unit_id").alias("dst"), F.col("pos").alias("node"))
    both = ways.select("src", "dst").distinct().join(src, "src").join(dst, [*keys, "dst"])
    bit = F.expr("shiftleft(1L, cast(_i % 64 as int))")
    return both.groupBy(*keys, F.lit(1).alias("layer"), F.expr("_i div 64").alias("group"), "node").agg(F.bit_or(bit).alias("bits"))


def opened(relation: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs (keys, layer, pos, node) of a relation."""
    at = F.explode(F.expr("filter(sequence(0, 63), b -> shiftright(bits, b) & 1 = 1)"))
    return relation.select(*keys, "layer", "group", "node", at.alias("_b")).select(
        *keys, "layer", (F.col("group") * 64 + F.col("_b")).alias("pos"), "node"
    )


def spread(where: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Means and sums of squares of every variable: arrays ``mean``, ``z2``."""
    keys = list(keys)
    means = where.groupBy(*keys).agg(F.array(*[F.avg(F.col("y")[v]) for v in range(width)]).alias("mean"))
    both = attach(where, means, keys)
    gap = [F.col("y")[v] - F.col("mean")[v] for v in range(width)]
    squares = both.groupBy(*keys).agg(F.max("n").alias("n"), F.first("mean").alias("mean"), F.array(*[F.sum(g * g) for g in gap]).alias("z2"))
    return cut_lineage(squares)


def _packed(pos: np.ndarray, numbers: np.ndarray, block: int, **more) -> dict[str, list]:
    """Places within blocks and numbers of ascending positions as bytes, one row a block."""
    blocks, first = np.unique(pos // block, return_index=True)
    ends = [*first[1:].tolist(), len(pos)]
    at, numbers = (pos % block).astype("<u2"), numbers.astype("<f8")
    spans = list(zip(first.tolist(), ends, strict=True))
    return {
        "block": blocks.tolist(), "at": [at[i:j].tobytes() for i, j in spans], "z": [numbers[i:j].tobytes() for i, j in spans],
        **{name: [value] * len(spans) for name, value in more.items()},
    }


def _pack(block: int):
    """One row of bytes for the ``pos`` and ``z`` of a group that lies in one block."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        pos = rows.column("pos").to_numpy()
        order = np.argsort(pos)
        found = _packed(pos[order], np.array(rows.column("z").to_pylist(), np.float64)[order], block)
        return pa.table({"at": pa.array(found["at"], pa.binary()), "z": pa.array(found["z"], pa.binary())})

    return run


_TURNS = [s for turn in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in turn * 4]
_SINES = [int(abs(sin(i + 1)) * 2**32) for i in range(64)]
_BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


class _Digests:
    """md5 digests of ``start + tail`` for many tails, all at once for every start.

    Tails of one length have their bytes in the same words of the only block;
    texts of more than one block are digested one by one.
    """

    def __init__(self, tails: list[bytes]):
        self.tails = tails
        sizes = np.array([len(t) for t in tails])
        self.groups = []
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            for i in range(0, len(at), LANES):
                some = at[i : i + LANES]
                self.groups.append((some, size, np.frombuffer(b"".join([tails[j] for j in some.tolist()]), np.uint8).reshape(len(some), size)))
        self.words: dict[tuple[int, int], dict[int, np.ndarray]] = {}

    def _placed(self, group: int, before: int) -> dict[int, np.ndarray]:
        """Words that hold bytes of the tails after ``before`` other bytes."""
        if (group, before) not in self.words:
            _, size, letters = self.groups[group]
            first, last = before // 4, (before + size + 3) // 4
            room = np.zeros((len(letters), 4 * (last - first)), np.uint8)
            room[:, before - 4 * first : before - 4 * first + size] = letters
            self.words[group, before] = {first + i: w for i, w in enumerate(np.ascontiguousarray(room.view("<u4").T))}
        return self.words[group, before]

    def of(self, start: bytes) -> np.ndarray:
        out = np.empty((len(self.tails), 16), np.uint8)
        for group, (at, size, _) in enumerate(self.groups):
            if len(start) + size > 55:
                out[at] = np.frombuffer(b"".join([md5(start + self.tails[i]).digest() for i in at.tolist()]), np.uint8).reshape(-1, 16)
                continue
            plain = start + bytes(size) + b"\x80" + bytes(55 - len(start) - size) + (8 * (len(start) + size)).to_bytes(8, "little")
            fixed, moving = np.frombuffer(plain, "<u4"), self._placed(group, len(start))
            words = [moving[i] | fixed[i] if i in moving else int(fixed[i]) for i in range(16)]
            out[at] = _rounds(words, len(at)).view(np.uint8).reshape(-1, 16)
        return out


def _rounds(words: list, n: int) -> np.ndarray:
    """The 64 steps of md5 on one block; a word is an array, or a number all share."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _BEGIN)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i, (turn, sine) in enumerate(zip(_TURNS, _SINES, strict=True)):
        if i < 16:
            word = words[i]
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            word = words[(5 * i + 1) % 16]
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            word = words[(3 * i + 5) % 16]
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            word = words[7 * i % 16]
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        if isinstance(word, int):
            np.add(f, np.uint32((word + sine) & 0xFFFFFFFF), out=f)
        else:
            np.add(f, word, out=f), np.add(f, np.uint32(sine), out=f)
        np.left_shift(f, np.uint32(turn), out=t), np.right_shift(f, np.uint32(32 - turn), out=f), np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    out = np.empty((n, 4), "<u4")
    for i, x in enumerate((a, b, c, d)):
        np.add(x, np.uint32(_BEGIN[i]), out=out[:, i])
    return out


def _deal(first: int, last: int, keys: Sequence[str], chunk: int, length: int):
    """Digests of every draw with the place in the chunk, 18 bytes a unit, dealt to runs by their leading bits."""
    names = [*keys, "k", "run", "chunk", "held", "packed"]

    def run(batches):
        for batch in batches:
            fixed = [batch.column(k) for k in keys]
            for i in range(batch.num_rows):
                runs = -(-batch.column("n")[i].as_py() // length)
                head, tails = batch.column("head")[i].as_py(), [t.encode() for t in batch.column("tails")[i].as_py()]
                place = np.arange(len(tails), dtype="<u2").view(np.uint8).reshape(-1, 2)
                made = _Digests(tails)
                for k in range(first, last):
                    digests = made.of(f"{head}{k}".encode())
                    into = (digests[:, :4].copy().view(">u4").ravel().astype(np.uint64) * np.uint64(runs)) >> np.uint64(32)
                    order = np.argsort(into.astype(np.uint16) if runs <= 1 << 16 else into, kind="stable")
                    entries = np.concatenate([digests, place], axis=1)[order]
                    at, begin, held = np.unique(into[order], return_index=True, return_counts=True)
                    packed = [entries[b : b + h].tobytes() for b, h in zip(begin.tolist(), held.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        *[pa.array([c[i].as_py()] * len(at), c.type) for c in fixed], pa.array([k] * len(at), pa.int32()),
                        pa.array(at.tolist(), pa.int64()), pa.array([batch.column("chunk")[i].as_py()] * len(at), pa.int64()),
                        pa.array(held.tolist(), pa.int64()), pa.array(packed, pa.binary()),
                    ], names=names)

    return run


def _meet(width: int, block: int, chunk: int):
    """Sort the digests of a run; the unit of rank r takes the value of position r."""

    def run(key: tuple, dealt: pa.Table, values: pa.Table) -> pa.Table:
        kinds = {"block": pa.int64(), "at": pa.binary(), "z": pa.binary()}
        out: dict[str, list] = {name: [] for name in kinds}
        if dealt.num_rows and values.num_rows:
            entries = np.frombuffer(b"".join(dealt.column("packed").to_pylist()), np.uint8).reshape(-1, 18)
            pos = np.repeat(dealt.column("chunk").to_numpy(), dealt.column("held").to_numpy()) * chunk
            pos = pos + entries[:, 16:].copy().view("<u2").ravel()
            high, low = (entries[:, i : i + 8].copy().view(">u8").ravel().astype(np.uint64) for i in (0, 8))
            order = np.argsort(high)
            if (np.diff(high[order]) == 0).any():
                order = np.lexsort((pos, low, high))
            pos = pos[order]
            blocks = values.column("block").to_numpy()
            parts, order = values.column("z").to_pylist(), np.argsort(blocks)
            z = np.frombuffer(b"".join([parts[i] for i in order.tolist()]), "<f8").reshape(-1, width)
            begin = dealt.column("offset")[0].as_py() - int(blocks.min()) * block
            order = np.argsort(pos)
            out = _packed(pos[order], z[begin : begin + len(pos)][order], block)
        return pa.table({name: pa.array(out[name], kind) for name, kind in kinds.items()})

    return run


def _cross_products(first: int, count: int, width: int, block: int):
    """Sums over neighbours of ``z[i] * z[j] / degree[i]`` of every draw, by layer."""

    def run(key: tuple, ways: pa.Table, values: pa.Table) -> pa.Table:
        layers, sums = [], []
        if ways.num_rows and values.num_rows:
            held = values.column("block").to_numpy()
            blocks = np.unique(held)
            z, shares = np.zeros((len(blocks) * block, count, width)), {}
            spot = np.searchsorted(blocks, held) * block
            for base, k, at, numbers in zip(spot.tolist(), *(values.column(c).to_pylist() for c in ("k", "at", "z")), strict=True):
                rows = base + np.frombuffer(at, "<u2").astype(np.int64)
                if k < 0:  # shares of the layer -k
                    shares.setdefault(-k, np.zeros(len(z)))[rows] = np.frombuffer(numbers, "<f8")
                else:
                    z[rows, k - first] = np.frombuffer(numbers, "<f8").reshape(-1, width)
            z = z.reshape(len(z), -1)
            group, node, layer = (ways.column(c).to_numpy() for c in ("group", "node", "layer"))
            bits = np.unpackbits(ways.column("bits").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, bit = np.nonzero(bits)
            i, j = (np.searchsorted(blocks, p // block) * block + p % block for p in (group[row] * 64 + bit, node[row]))
            step = max(1, TILE // (count * width))
            for one in np.unique(layer).tolist():
                total = np.zeros(count * width)
                own = np.flatnonzero(layer[row] == one)
                w = shares[one][i[own]]
                for begin in range(0, len(own), step):
                    part = own[begin : begin + step]
                    total += np.einsum("p,pk,pk->k", w[begin : begin + step], z[i[part]], z[j[part]])
                layers.append(one), sums.append(total)
        return pa.table({"layer": pa.array(layers, pa.int32()), "sums": pa.array(sums, pa.list_(pa.float64()))})

    return run


def _widened(length: int, rows: int) -> int:
    while rows > PARTS * length and length < WIDEST:
        length *= 2
    return length


def cross_products(relation: DataFrame, members: DataFrame, keys: Sequence[str], permutations: int) -> DataFrame:
    """``keys, layer, variable, n, s0, z2, cross, larger`` of a relation.

    ``cross`` is the sum of z times the mean z of the neighbours, ``s0`` counts
    positions with neighbours, ``larger`` the draws with at least that sum.
    ``members`` must be ``placed``. Pairs meet the values of two blocks.

    Draws are made in batches, and what a batch wrote is removed before the
    next, so disk grows with the units and not with the draws.
    """
    keys = list(keys)
    spark = members.sparkSession
    size = members.agg(F.count("*").alias("rows"), F.max(F.size("y")).alias("width")).first()
    width, block, chunk, kinds = max(1, size.width or 0), _widened(BLOCK, size.rows), _widened(CHUNK, size.rows), dict(members.dtypes)
    head = [f"{k} {kinds[k]}" for k in keys]
    relation = cut_lineage(relation)
    facts = spread(members, keys, width)
    for k in keys:  # a null key meets nothing
        members = members.where(F.col(k).isNotNull())
    centred = attach(members, facts.select(*keys, "mean"), keys).select(*keys, "unit_id", "pos", "n", F.zip_with("y", "mean", lambda a, m: a - m).alias("z"))
    packed = [*keys, "block", "at", "z"]
    inside = ", ".join([*head, "block long", "at binary", "z binary"])
    values = centred.select(*keys, "pos", "z", F.expr(f"pos div {block}").alias("block")).groupBy(*keys, "block")
    values = cut_lineage(values.applyInArrow(_keyed_rows(_pack(block), [*keys, "block"]), inside))
    tail = F.concat_ws(":", F.lit(""), F.col("unit_id").cast("string"))
    start = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit("")) if keys else F.lit("")
    listed = F.sort_array(F.collect_list(F.struct("pos", tail.alias("tail"))))
    chunks = centred.groupBy(*keys, "n", F.expr(f"pos div {chunk}").alias("chunk")).agg(listed.alias("l"))
    chunks = chunks.select(*keys, "n", "chunk", start.alias("head"), F.col("l.tail").alias("tails"))
    chunks = cut_lineage(chunks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))

    degree = cut_lineage(opened(relation, keys).groupBy(*keys, "layer", "pos").agg(F.count("*").alias("_d")))
    shares = degree.select(*keys, "layer", F.expr(f"pos div {block}").alias("block"), "pos", (1 / F.col("_d")).alias("z"))
    shares = shares.groupBy(*keys, "layer", "block").applyInArrow(
        _keyed_rows(_pack(block), [*keys, "layer", "block"]), ", ".join([*head, "layer int", "block long", "at binary", "z binary"])
    )
    shares = cut_lineage(shares.select(*packed, (-F.col("layer")).alias("k")))
    near, far = F.expr(f"group div {block // 64}"), F.expr(f"node div {block}")
    ways = cut_lineage(relation.withColumns({"a": F.least(near, far), "b": F.greatest(near, far)}))
    tasks = cut_lineage(ways.select(*keys, "a", "b").distinct())
    # pairs inside a block go where it meets another one, so that it travels once less
    other = tasks.where("a <> b").groupBy(*keys, "a").agg(F.min("b").alias("_b"))
    own = F.when(F.col("a") == F.col("b"), F.coalesce("_b", "b")).otherwise(F.col("b"))
    ways = cut_lineage(ways.join(other, [*keys, "a"], "left").withColumn("b", own).drop("_b"))
    tasks = tasks.join(other, [*keys, "a"], "left").withColumn("b", own).select(*keys, "a", "b").distinct()
    tasks = sized(cut_lineage(tasks.withColumn("block", F.explode(F.array_distinct(F.array("a", "b"))))))

    per = max(LEAST, DRAWN // max(1, size.rows))
    parts = None
    with shuffles_removed(spark):
        for first in range(0, permutations + 1, per):
            last = min(first + per, permutations + 1)
            drawn, dealt = _values_of_draws(Parts(chunks, chunk), Parts(values, block), keys, max(1, first), last, width)
            if first == 0:
                drawn = drawn.unionByName(values.withColumn("k", F.lit(0)))
            met = drawn.unionByName(shares).join(tasks, [*keys, "block"])
            met = met.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("a").alias("_a"), F.col("b").alias("_b"), "block", "k", "at", "z")
            found = ways.groupBy(*keys, "a", "b").cogroup(met.groupBy(*[f"_{k}" for k in keys], "_a", "_b")).applyInArrow(
                _keyed(_cross_products(first, last - first, width, block), keys), ", ".join([*head, "layer int", "sums array<double>"])
            )
            flat = found.select(*keys, "layer", F.posexplode("sums").alias("_p", "s")).groupBy(*keys, "layer", "_p").agg(F.sum("s").alias("s"))
            part = cut_lineage(flat.select(
                *keys, "layer", (F.col("_p") % width).alias("variable"), (F.expr(f"_p div {width}") + first).alias("k"), "s"
            ))
            dealt.unpersist(blocking=True)
            parts = part if parts is None else parts.unionByName(part)
    each = cut_lineage(parts)
    seen = each.filter("k = 0").select(*keys, "layer", "variable", F.col("s").alias("cross"))
    linked = degree.groupBy(*keys, "layer").agg(F.count("*").alias("s0"))
    sizes = facts.select(*keys, "n", F.posexplode("z2").alias("variable", "z2"))
    base = seen.join(linked, [*keys, "layer"]).join(sizes, [*keys, "variable"])
    enough = F.col("s") >= F.col("cross") - EQUAL * F.col("z2")
    larger = each.filter("k > 0").join(base, [*keys, "layer", "variable"]).groupBy(*keys, "layer", "variable").agg(F.count_if(enough).alias("larger"))
    return base.join(larger, [*keys, "layer", "variable"], "left")


class Parts(NamedTuple):
    """Packed rows, and the positions that a row stands for."""

    rows: DataFrame
    length: int


def _values_of_draws(chunks: Parts, values: Parts, keys: list[str], first: int, last: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Packed values ``keys, block, at, z, k`` of the draws, and the stored digests to drop once they are used.

    The order of the digests of a draw is the permutation. Runs of digests are
    sorted one by one; sizes of the earlier runs give the first rank of a run.
    """
    chunks, chunk = chunks
    values, block = values
    kinds = dict(chunks.dtypes)
    head = [f"{k} {kinds[k]}" for k in keys]
    dealt = chunks.mapInArrow(
        _deal(first, last, keys, chunk, RUN), ", ".join([*head, "k int", "run long", "chunk long", "held long", "packed binary"])
    ).persist(StorageLevel.DISK_ONLY)
    runs = dealt.groupBy(*keys, "k", "run").agg(F.sum("held").alias("_size"))
    before = Window.partitionBy(*keys, "k").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut_lineage(runs.withColumn("offset", F.coalesce(F.sum("_size").over(before), F.lit(0))))  # one row for RUN units
    span = F.sequence(F.expr(f"offset div {block}"), F.expr(f"(offset + _size - 1) div {block}"))
    needed = runs.select(*keys, F.col("k").alias("_k"), F.col("run").alias("_run"), F.explode(span).alias("block"))
    lent = needed.join(values.select(*keys, "block", "z"), [*keys, "block"])
    lent = lent.select(*[F.col(k).alias(f"_{k}") for k in keys], "_k", "_run", "block", "z")
    ranked = dealt.join(runs.drop("_size"), [*keys, "k", "run"])
    met = ranked.groupBy(*keys, "k", "run").cogroup(lent.groupBy(*[f"_{k}" for k in keys], "_k", "_run")).applyInArrow(
        _keyed(_meet(width, block, chunk), [*keys, "k"]), ", ".join([*head, "k int", "block long", "at binary", "z binary"])
    )
    return met.select(*keys, "block", "at", "z", "k"), dealt


def _keyed(run, keys: Sequence[str]):
    """Put the group's key values in front of what ``run`` returns."""

    def with_keys(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(key, left, right)
        for i, k in enumerate(keys):
            out = out.add_column(i, k, pa.array([key[i].as_py()] * out.num_rows, key[i].type))
        return out

    return with_keys


def _keyed_rows(run, keys: Sequence[str]):
    """``_keyed`` for a function of one table."""
    both = _keyed(lambda key, rows, _: run(key, rows), keys)
    return lambda key, rows: both(key, rows, rows)


def pseudo_p(larger: Column, permutations: int) -> Column:
    """(1 + the smaller tail count) / (permutations + 1)."""
    return (F.least(larger, permutations - larger) + 1) / (permutations + 1)


def _picked(targets: list[list[int]]) -> np.ndarray:
    """Fisher-Yates picks: step s swaps place s with ``targets[s]``, and place s is drawn."""
    targets = np.array(targets, np.int64)
    steps = targets.shape[1]
    last = targets.copy()  # value that was moved to place targets[:, s] by step s
    out = np.zeros_like(targets)

    def value(place: np.ndarray, s: int) -> np.ndarray:
        found = place.copy()
        for t in range(s):
            found = np.where(targets[:, t] == place, last[:, t], found)
        return found

    for s in range(steps):
        out[:, s] = value(targets[:, s], s)
        last[:, s] = value(np.full(len(targets), s), s)
    return out


def _draw(batches):
    for batch in batches:
        if batch.num_rows:
            targets = batch.column("targets")
            sizes = np.array([len(t) for t in targets.to_pylist()])
            rows: list = [None] * batch.num_rows
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                for i, r in zip(at.tolist(), _picked(targets.take(pa.array(at)).to_pylist()) if size else [[]] * len(at), strict=True):
                    rows[i] = list(r)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in batch.schema.names if c != "targets"], pa.array(rows, pa.list_(pa.int64()))],
                names=[*[c for c in batch.schema.names if c != "targets"], "picked"],
            )


def conditional_draws(slots: DataFrame, keys: Sequence[str], permutations: int) -> DataFrame:
    """``keys, k, slot, r``: for every draw, distinct places of 0 .. n - 2, one a slot.

    ``slots`` is (keys, n, slots). Place r stands for position r, or r + 1 from
    the unit's own position on, so all units of a key share the draws.
    """
    keys = list(keys)
    drawn = slots.select(*keys, "n", "slots", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("k"))

    def target(s):
        number = F.conv(F.substring(F.md5(name_of(keys, F.col("k"), s)), 1, 15), 16, 10).cast("long")
        return s + F.pmod(number, F.col("n") - 1 - s)

    steps = F.when(F.col("slots") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1), target)).otherwise(F.array().cast("array<long>"))
    rows = drawn.select(*keys, "k", steps.alias("targets"))
    kinds = ", ".join([*[f"{k} {t}" for k, t in slots.dtypes if k in keys], "k int", "picked array<long>"])
    return rows.mapInArrow(_draw, kinds).select(*keys, "k", F.posexplode("picked").alias("slot", "r"))


def _count_larger(permutations: int, width: int):
    """How many draws reach the observed sum, and the observed product with the own value."""

    def run(key: tuple, units: pa.Table, draws: pa.Table) -> pa.Table:
        ids, out = units.column("unit_id"), {"more": [], "high": []}
        if units.num_rows:
            pos, degree = (units.column(c).to_numpy() for c in ("pos", "degree"))
            own, near = (np.array(units.column(c).to_pylist(), np.float64) for c in ("z", "near"))
            order = np.argsort(draws.column("slot").to_numpy())
            r = np.array(draws.column("r").to_pylist(), np.int64)[order] if draws.num_rows else np.zeros((0, permutations), np.int64)
            low, high = (np.array(draws.column(c).to_pylist(), np.float64).reshape(-1, permutations, width)[order] for c in ("low", "high"))
            step = max(1, TILE // (permutations * width))
            for begin in range(0, len(pos), step):
                p, d = pos[begin : begin + step], degree[begin : begin + step]
                sums = np.zeros((len(p), permutations, width))
                for s in range(int(d.max())):
                    live = np.flatnonzero(d > s)
                    before = r[s] < p[live][:, None]
                    sums[live] += np.where(before[:, :, None], low[s], high[s])
                seen = near[begin : begin + step][:, None, :]
                side = own[begin : begin + step][:, None, :]
                reach = sums >= seen
                out["more"] += reach.sum(axis=1).tolist()
                out["high"] += np.where(side > 0, reach, np.where(side < 0, sums <= seen, True)).sum(axis=1).tolist()
        return pa.table({"unit_id": ids, "more": pa.array(out["more"], pa.list_(pa.int64())), "high": pa.array(out["high"], pa.list_(pa.int64()))})

    return run


def local_counts(members: DataFrame, ways: DataFrame, facts: DataFrame, keys: Sequence[str], permutations: int, width: int) -> DataFrame:
    """``keys, unit_id, degree, near, more, high`` of each unit with neighbours.

    ``near`` is the sum of the neighbours' values, ``more`` counts the draws
    of as many other units whose sum is not below it, ``high`` those whose
    product with the unit's centred value is not below the observed product;
    one entry a variable. A task holds the draws of its largest degree.
    """
    keys = list(keys)
    where = members.select(*keys, "unit_id", "pos", "n", "y")
    src = where.select(*keys, F.col("unit_id").alias("src"))
    dst = where.select(*keys, F.col("unit_id").alias("dst"), "y")
    met = ways.select("src", "dst").distinct().join(dst, "dst").join(src, [*keys, "src"])
    near = met.groupBy(*keys, F.col("src").alias("unit_id")).agg(
        F.count("*").alias("degree"), F.array(*[F.sum(F.col("y")[v]) for v in range(width)]).alias("near")
    )
    units = attach(where.join(near, [*keys, "unit_id"]), facts.select(*keys, "mean"), keys).withColumn("z", F.zip_with("y", "mean", lambda a, m: a - m))
    units = cut_lineage(units.withColumn("block", F.expr(f"pos div {BLOCK}")).drop("y", "mean"))
    if not permutations:
        none = F.lit(None).cast("array<long>")
        return units.select(*keys, "unit_id", "degree", "near", none.alias("more"), none.alias("high"))
    slots = units.groupBy(*keys).agg(F.max("n").alias("n"), F.max("degree").alias("slots"))
    draws = cut_lineage(conditional_draws(slots, keys, permutations))
    values = where.select(*keys, F.col("pos").alias("_at"), "y")
    both = draws.withColumn("_at", F.col("r")).join(values, [*keys, "_at"]).withColumnRenamed("y", "low").drop("_at")
    both = both.withColumn("_at", F.col("r") + 1).join(values, [*keys, "_at"]).withColumnRenamed("y", "high")
    lists = F.sort_array(F.collect_list(F.struct("k", "r", "low", "high")))  # one entry a draw
    table = cut_lineage(both.groupBy(*keys, "slot").agg(lists.alias("l")).select(
        *keys, "slot", F.col("l.r").alias("r"), F.flatten("l.low").alias("low"), F.flatten("l.high").alias("high")
    ))
    needs = units.groupBy(*keys, "block").agg(F.max("degree").alias("_most"))
    renamed = [f"_{k}" for k in keys]
    rows = table.select(*[F.col(k).alias(f"_{k}") for k in keys], "slot", "r", "low", "high")
    needs = needs.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("block").alias("_block"), "_most")
    copies = (rows.join(needs, renamed) if keys else rows.join(F.broadcast(needs), F.col("slot") < F.col("_most"))).filter("slot < _most")
    kinds = dict(members.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"unit_id {kinds['unit_id']}", "more array<long>", "high array<long>"])
    found = units.groupBy(*keys, "block").cogroup(copies.groupBy(*renamed, "_block")).applyInArrow(_keyed(_count_larger(permutations, width), keys), schema)
    return units.select(*keys, "unit_id", "degree", "near").join(found, [*keys, "unit_id"])
