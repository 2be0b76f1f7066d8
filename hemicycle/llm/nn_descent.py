"""Approximate nearest neighbours: an NN-descent graph and greedy search in it.

Equal vectors become one node. Nodes are put in two orders by their nearest
pivots; both orders are cut into blocks, and exact neighbours inside the blocks
start the graph. Then neighbours of a node's neighbours are compared with each
other, round by round, until few edges change. A round is a join: the edges of
a block of nodes meet one copy of each vector that the block's neighbourhoods
name, so a vector travels once a block and not once an edge.

A search holds the nearest nodes found so far and opens the best of them: their
graph neighbours are measured in double precision against the query, and the
search ends when every node it holds is open. All queries advance together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hemicycle.functions.ordered import row_index
from hemicycle.llm.storage import settled, written

#: edges of a node, and edges that lead to it, which a round looks at; hubs have
#: more of the latter, and another sample of them is taken each round
NEIGHBOURS = 32
#: nodes of a block
BLOCK = 512
#: sampled vectors that a digit of an order compares, and digits of an order
PIVOTS, DIGITS = 64, 3
#: the descent ends when a round replaces less than this share of the edges
SETTLED = 0.1
#: nodes that a search holds, and those it opens in one round
BEAM, OPENED = 256, 128
#: queries that meet one copy of a block
QUERIES = 1024
#: numbers in one array of pair distances
TILE = 1 << 22
#: a distance that stands for all that overflow
FAR = 1e300


def _squares(x: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Squared distances within groups of rows; far beyond the usual size all are equally far."""
    square = (x * x).sum(axis=-1)
    out = square[..., :, None] + square[..., None, :] - 2 * gram
    return np.nan_to_num(np.maximum(out, 0), nan=FAR, posinf=FAR)


def _matrix(blobs: list[bytes], kind: str, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), dims)


def _coded(kinds: DataFrame, pivots: list[list[float]], usual: float, kind: str) -> DataFrame:
    """``kind, ids, dims, order0, order1, vec``: digits are nearest pivots of the same length."""
    points = [np.asarray(p, np.float64) / usual for p in pivots]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v").to_pylist()
            sizes = np.array([len(v) for v in lists], np.int32)
            orders = np.zeros((2, len(lists)), np.int64)
            blobs: list[bytes] = [b""] * len(lists)
            for dims in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dims)
                x = np.array([lists[i] for i in at.tolist()], np.float64) + 0.0  # no negative zeros
                for i, row in zip(at.tolist(), x.astype(kind), strict=True):
                    blobs[i] = row.tobytes()
                x = x / usual
                for digit in range(2 * DIGITS):
                    own = [p for p in points[digit * PIVOTS : (digit + 1) * PIVOTS] if len(p) == dims]
                    if own:
                        p = np.array(own)
                        with np.errstate(all="ignore"):
                            nearest = np.argmin(np.nan_to_num((p * p).sum(axis=1) - 2 * x @ p.T, nan=FAR), axis=1)
                        orders[digit // DIGITS, at] = orders[digit // DIGITS, at] * PIVOTS + nearest
            yield pa.RecordBatch.from_arrays(
                [batch.column("kind"), batch.column("ids"), pa.array(sizes), *map(pa.array, orders), pa.array(blobs, pa.binary())],
                names=["kind", "ids", "dims", "order0", "order1", "vec"],
            )

    return kinds.select("kind", "ids", "v").mapInArrow(run, "kind long, ids array<long>, dims int, order0 long, order1 long, vec binary")


def _blocks(rows: DataFrame, order: list[str], sizes: DataFrame) -> DataFrame:
    """Add ``block`` and the place ``_at`` in it; blocks of a length are equally large."""
    placed = row_index(rows, ["dims"], order, "_pos").join(F.broadcast(sizes), "dims")
    n, blocks = F.col("_n"), F.col("_blocks")
    inside = F.expr("_pos * _blocks div _n")
    placed = placed.withColumn("_in", inside).withColumn("_first", F.expr("(_in * _n + _blocks - 1) div _blocks"))
    return placed.withColumn("block", F.col("_before") + F.col("_in")).withColumn("_at", F.col("_pos") - F.col("_first")).drop(
        "_pos", "_in", "_first", "_n", "_blocks", "_before"
    )


def numbered_nodes(kinds: DataFrame, kind: str, usual: float) -> DataFrame:
    """``node, dims, vec, ids, block1``: node div BLOCK is the block of the first order."""
    sample = kinds.orderBy(F.xxhash64("kind")).limit(2 * DIGITS * PIVOTS).select("v").collect()  # a fixed number
    coded = settled(_coded(kinds, [r.v for r in sample], usual, kind))
    each = Window.orderBy("dims").rowsBetween(Window.unboundedPreceding, -1)  # one row a vector length
    sizes = coded.groupBy("dims").agg(F.count("*").alias("_n")).withColumn("_blocks", F.ceil(F.col("_n") / BLOCK))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_blocks").over(each), F.lit(0)))
    first = _blocks(coded, ["order0", "kind"], sizes).withColumn("node", F.col("block") * BLOCK + F.col("_at")).drop("block", "_at")
    second = _blocks(first.select("node", "dims", "order1"), ["order1", "node"], sizes).select("node", F.col("block").alias("block1"))
    return settled(first.select("node", "dims", "vec", "ids").join(second, "node"))


def _pairs_inside(kind: str, usual: float, keep: int):
    """Exact neighbours of each node within its block."""

    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        n = len(node)
        if n < 2:
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        x = _matrix(table.column("vec").to_pylist(), kind, table.column("dims")[0].as_py()).astype(np.float64) / usual
        with np.errstate(all="ignore"):
            distance = _squares(x, x @ x.T)
        np.fill_diagonal(distance, np.inf)
        most = min(keep, n - 1)
        near = np.argpartition(distance, most - 1, axis=1)[:, :most]
        return pa.table({"src": np.repeat(node, most), "dst": node[near].ravel(), "d": np.take_along_axis(distance, near, axis=1).ravel()})

    return run


def _best(edges: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` shortest edges of each node; an edge known before is not fresh."""
    alone = edges.repartition("src").groupBy("src", "dst").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))
    return alone.withColumn("_r", rank).filter(F.col("_r") <= keep).drop("_r")


def _local_join(kind: str, usual: float, keep: int):
    """Compare the neighbours of every node of a block with each other."""

    def run(key: tuple, edges: pa.Table, vectors: pa.Table) -> pa.Table:
        none = pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        if not edges.num_rows or not vectors.num_rows:
            return none
        ids = vectors.column("member").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        blobs = vectors.column("vec").to_pylist()
        x = _matrix([blobs[i] for i in order.tolist()], kind, vectors.column("dims")[0].as_py()).astype(np.float64) / usual
        worst = vectors.column("worst").to_numpy()[order]
        mid, member, fresh = (edges.column(c).to_numpy(zero_copy_only=False) for c in ("mid", "member", "fresh"))
        order = np.argsort(mid, kind="stable")
        mid, member, fresh = mid[order], np.searchsorted(ids, member[order]), fresh[order]
        starts = np.flatnonzero(np.r_[True, mid[1:] != mid[:-1]])
        sizes = np.diff(np.r_[starts, len(mid)])
        width = int(sizes.max())
        row = np.repeat(np.arange(len(starts)), sizes)
        column = np.arange(len(mid)) - np.repeat(starts, sizes)
        at, new = np.full((len(starts), width), -1), np.zeros((len(starts), width), bool)
        at[row, column], new[row, column] = member, fresh
        found = []
        step = max(1, TILE // (width * max(width, x.shape[1])))
        for begin in range(0, len(at), step):
            a, f = at[begin : begin + step], new[begin : begin + step]
            points = x[a]
            with np.errstate(all="ignore"):
                distance = _squares(points, points @ points.transpose(0, 2, 1))
            hit = (distance < worst[a][:, :, None]) & (f[:, :, None] | f[:, None, :])
            hit &= (a >= 0)[:, :, None] & (a >= 0)[:, None, :] & (a[:, :, None] != a[:, None, :])
            i, j, k = np.nonzero(hit)
            found.append((a[i, j], a[i, k], distance[i, j, k]))
        src, dst, d = (np.concatenate(c) for c in zip(*found, strict=True))
        first = np.unique(src * len(ids) + dst, return_index=True)[1]
        src, dst, d = src[first], dst[first], d[first]
        order = np.lexsort((d, src))
        src, dst, d = src[order], dst[order], d[order]
        head = np.flatnonzero(np.r_[True, src[1:] != src[:-1]]) if len(src) else src
        count = np.diff(np.r_[head, len(src)])
        good = np.arange(len(src)) - np.repeat(head, count) < keep
        return pa.table({"src": ids[src[good]], "dst": ids[dst[good]], "d": d[good]})

    return run


def neighbour_graph(nodes: DataFrame, kind: str, usual: float, keep: int = NEIGHBOURS) -> DataFrame:
    """``src, dst, d``: about the ``keep`` nearest nodes of each node."""
    schema = "src long, dst long, d double"
    inside = _pairs_inside(kind, usual, keep)
    starts = [
        nodes.select(where.alias("block"), "node", "dims", "vec").groupBy("block").applyInArrow(inside, schema)
        for where in (F.expr(f"node div {BLOCK}"), F.col("block1"))
    ]
    graph = settled(_best(starts[0].unionByName(starts[1]).withColumn("fresh", F.lit(True)), keep))
    vectors = nodes.select(F.col("node").alias("member"), "dims", "vec")
    turn = 0
    while True:
        turn += 1
        back = graph.select(F.col("dst").alias("mid"), F.col("src").alias("member"), "fresh")
        rank = F.row_number().over(Window.partitionBy("mid").orderBy(F.xxhash64("mid", "member", F.lit(turn))))
        back = back.withColumn("_r", rank).filter(F.col("_r") <= keep).drop("_r")
        ahead = graph.select(F.col("src").alias("mid"), F.col("dst").alias("member"), "fresh")
        edges = ahead.unionByName(back).groupBy("mid", "member").agg(F.max("fresh").alias("fresh"))
        edges = settled(edges.withColumn("block", F.expr(f"mid div {BLOCK}")))
        worst = graph.groupBy(F.col("src").alias("member")).agg(
            F.when(F.count("*") >= keep, F.max("d")).otherwise(float("inf")).alias("worst")
        )
        needs = edges.select(F.col("block").alias("to"), F.col("member").alias("name")).distinct().withColumnRenamed("name", "member")
        needs = needs.join(worst, "member").join(vectors, "member")
        pairs = edges.groupBy("block").cogroup(needs.groupBy("to")).applyInArrow(_local_join(kind, usual, keep), schema)
        known = graph.withColumn("fresh", F.lit(False))
        graph = settled(_best(known.unionByName(pairs.withColumn("fresh", F.lit(True))), keep))
        total, changed = graph.agg(F.count("*"), F.count_if("fresh")).first()
        if changed <= SETTLED * total:
            return graph.drop("fresh")


def euclidean(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Distances of rows from ``one`` in double precision; large numbers do not overflow."""
    gap = points.astype(np.float64) - one.astype(np.float64)
    with np.errstate(over="ignore"):
        out = np.sqrt((gap * gap).sum(axis=1))
    odd = ~np.isfinite(out) | (out < 1e-150)
    if odd.any():
        most = np.maximum(np.abs(gap[odd]).max(axis=1), 1e-320)
        out[odd] = most * np.sqrt(((gap[odd] / most[:, None]) ** 2).sum(axis=1))
    return out


def _measure(kind: str):
    def run(key: tuple, asked: pa.Table, vectors: pa.Table) -> pa.Table:
        queries, found, distances = [], [], []
        if asked.num_rows and vectors.num_rows:
            node = vectors.column("node").to_numpy()
            order = np.argsort(node)
            blobs = vectors.column("vec").to_pylist()
            x = _matrix([blobs[i] for i in order.tolist()], kind, vectors.column("dims")[0].as_py())
            node = node[order]
            for query, wanted, vec in zip(*(asked.column(c).to_pylist() for c in ("query", "wanted", "q_vec")), strict=True):
                at = np.searchsorted(node, np.array(wanted, np.int64))
                queries.append(np.full(len(at), query, np.int64)), found.append(node[at]), distances.append(euclidean(x[at], np.frombuffer(vec, kind)))
        empty = [np.zeros(0, np.int64)]
        return pa.table({
            "query": np.concatenate(queries or empty), "node": np.concatenate(found or empty), "d": np.concatenate(distances or empty).astype(np.float64),
        })

    return run


def _measured(pairs: DataFrame, queries: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """``query, node, d`` of all pairs; a block asked for by many queries has copies."""
    asked = pairs.groupBy(F.expr(f"node div {BLOCK}").alias("block"), "query").agg(F.collect_list("node").alias("wanted"))
    asked = settled(asked)
    parts = asked.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    asked = asked.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int")).join(queries, "query")
    copies = nodes.select(F.expr(f"node div {BLOCK}").alias("block"), "node", "dims", "vec").join(parts, "block")
    copies = copies.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.select("block", "part", "query", "wanted", "q_vec")
    copies = copies.select(F.col("block").alias("to"), F.col("part").alias("copy"), "node", "dims", "vec")
    return asked.groupBy("block", "part").cogroup(copies.groupBy("to", "copy")).applyInArrow(_measure(kind), "query long, node long, d double")


def greedy_search(nodes: DataFrame, graph: DataFrame, asked: DataFrame, kind: str, beam: int = BEAM) -> DataFrame:
    """``query, node, d``: the nearest nodes found for each node in ``asked (query)``."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))
    back = graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "d").withColumn("_r", rank).filter(F.col("_r") <= NEIGHBOURS)
    both = graph.select("src", "dst").unionByName(back.select("src", "dst"))
    around = settled(both.groupBy(F.col("src").alias("node")).agg(F.collect_set("dst").alias("near")))
    queries = settled(asked.join(nodes.select(F.col("node").alias("query"), F.col("vec").alias("q_vec")), "query"))
    one = F.lit(1)
    held = asked.select("query", F.col("query").alias("node"), F.lit(0.0).alias("d"), F.lit(True).alias("open"), one.alias("turn"))
    per_query = Window.partitionBy("query")
    while True:
        opened = F.col("open") & (F.col("turn") <= OPENED)
        next_ones = held.filter(opened).join(around, "node").select("query", F.explode("near").alias("node")).distinct()
        unseen = next_ones.join(held.select("query", "node"), ["query", "node"], "left_anti")
        scored = _measured(unseen, queries, nodes, kind).withColumn("open", F.lit(True))
        closed = held.select("query", "node", "d", (F.col("open") & ~opened).alias("open"))
        best = closed.unionByName(scored).withColumn("_r", F.row_number().over(per_query.orderBy("d", "node"))).filter(F.col("_r") <= beam)
        turn = F.row_number().over(per_query.orderBy(F.col("open").desc(), "d", "node"))
        held = written(best.drop("_r").withColumn("turn", turn), "beam")
        if held.filter("open").isEmpty():
            return held.select("query", "node", "d")


def nearest_vectors(
    vectors: DataFrame, top: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = BEAM,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``top`` nearest vectors found for each query.

    Queries are the vectors whose id is divisible by ``every``; candidates are
    all vectors but the query's own; near means a small Euclidean distance,
    ``score``, ties go to the smaller id. The search is approximate.

    Vectors that are null, empty or zero, hold null or non-finite numbers, or
    have no id take no part; vectors of different lengths are never compared.
    Of rows that share an id the smallest vector (component by component)
    counts, once. Equal vectors are one node and are found together. With no
    more than ``top`` candidates all are found. Other columns are ignored;
    without queries there are no rows.
    """
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("id").isNotNull() & (F.size("v") > 0) & ~odd & F.exists("v", lambda x: x != 0)
    one = base.filter(good).groupBy("id").agg(F.min("v").alias("v"))
    one = settled(one.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))))
    # a query's answer needs no more than top + 1 members of a node
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = one.withColumn("_r", rank).filter(F.col("_r") <= top + 1)
    kinds = settled(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("kind", F.col("ids")[0]))
    if kinds.isEmpty():
        return spark.createDataFrame([], out)
    usual = kinds.agg(F.percentile_approx(F.array_max(F.transform("v", F.abs)), 0.5)).first()[0]  # keeps squares in range
    nodes = numbered_nodes(kinds, kind, usual)
    graph = neighbour_graph(nodes, kind, usual)
    named = nodes.select("node", F.explode("ids").alias("kind"), "ids").filter("kind = ids[0]").select("node", "kind")
    own = one.filter(F.pmod("id", F.lit(every)) == 0).join(kinds.select("v", "kind"), "v").select(F.col("id").alias("query_id"), "kind")
    own = settled(own.join(named, "kind").select("query_id", F.col("node").alias("query")))
    found = greedy_search(nodes, graph, own.select("query").distinct(), kind, beam)
    members = found.join(nodes.select("node", "ids"), "node").select("query", "d", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy("d", "vec_id")
    short = members.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top + 1)  # one may be the query itself
    met = own.join(short, "query").filter("query_id <> vec_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))
    return met.withColumn("rank", place).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", F.col("d").alias("score"))
