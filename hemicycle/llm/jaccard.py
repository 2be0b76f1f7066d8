"""N-gram Jaccard join by parity sketches.

A document is its set of distinct five-word shingles. Shingles are dealt to the
pieces of a sketch and XOR-hashed there, so a piece of two documents differs
only if a shingle that one of them lacks fell into it: the number of differing
pieces (Hamming distance) is at most the symmetric difference. Within a size
band the difference of linked sets is at most ``k``; with more than ``k``
pieces at least one agrees (pigeonhole), which gives the candidates. They are
verified on the whole sets.

Equal sets are one vertex, named by the sum of their hashes. Sets of up to
eight shingles link only with sets that have one shingle more (eight also with
ten): those are found by the sums that are left without one or two shingles.

Of two linked sets, the rarest piece that both hold has before it, in the order
of either, at most as many pieces as the two sets may differ in. Later pieces of
a set are not looked at. Inside a piece sets are first compared with one leader.
What is not connected then meets the other sets of the same leader in chunks,
where an inverted index of shingles counts all intersections at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_64_intdigest

from hemicycle.llm.arrays import mix, parts_of
from hemicycle.llm.components import components
from hemicycle.llm.storage import settled, written

WORDS = 5
#: linked: SHARE_TOP * intersection >= ... in whole numbers, 100 * i >= 80 * u
SIMILAR = 80
#: ratio of the sizes at the two ends of a band
BAND = 1.5625
#: keys that one reduce task sorts, about
KEYS_PER_PART = 4_000_000
#: keys and sets that a task collects before it sends them
BATCH_KEYS, BATCH_SETS = 2_000_000, 60_000
#: shingles in a chunk of the sets that have one leader, about
CHUNK = 131_072
#: a level beyond this is a further sketch of the level below it
LEVELS = 64

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: of a set in a band: its sum, band and sketch, spare pieces, size
_OWNER = np.dtype([("sig", "<i8"), ("level", "<i2"), ("spare", "<i4"), ("n", "<i4")])
_TOPS = np.ceil(8 * BAND ** np.arange(60)).astype(np.int64)


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text; empty without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for j in range(min(width, len(h))):
        out += h[j : j + n] * _ODD[j % len(_ODD)]
    return np.unique(mix(out))


def signature(s: np.ndarray) -> np.int64:
    """Sum of the hashes of a set."""
    return np.add.reduce(mix(s)).astype(np.int64)


def levels(n: int) -> list[int]:
    """Size bands that a set of ``n`` takes part in: its own and that of its smallest partner.

    The lowest band, up to eight shingles, has no pieces.
    """
    own, low = np.searchsorted(_TOPS, [n, -(-4 * n // 5)])
    return [int(x) for x in ([own] if own == low else [own, low]) if x]


def most_apart(level: int) -> int:
    """In how many shingles linked sets of a band differ at most.

    Linked sets of ``a <= b`` shingles differ in at most ``(a + b) / 9``, and
    ``b <= 1.25 a``, so in at most a quarter of the band's largest ``a``.
    """
    return int(_TOPS[level]) // 4


def pieces(level: int) -> int:
    """Number of pieces of a sketch in a band.

    More pieces tell sets apart no better: one that lost its only shingle is
    empty and has no key.
    """
    most = most_apart(level)
    return most + 1 + most * 3 // 2 + 1


def sketch_keys(s: np.ndarray, level: int) -> list[tuple[np.ndarray, int, int]]:
    """``keys, level, spare pieces`` of one sketch, or of several, the last with enough pieces.

    Linked sets agree in more pieces than either has to spare. A set whose
    shingles fell into too few pieces (spare below zero) might agree with
    another such set in empty ones only; so it is dealt anew, and two sets meet
    in the first sketch in which one of them has enough.
    """
    count, most, made = pieces(level), most_apart(level), []
    while not made or made[-1][2] < 0:
        again = len(made)
        dealt = mix(s + np.uint64(again) * _ODD[2]) if again else s
        number = ((dealt >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        order = np.argsort(number, kind="stable") if again else slice(None)  # sorted, as s is
        piece, value = number[order], mix(s[order] + np.uint64(1))
        heads = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
        code = level + LEVELS * again
        salt = mix(piece[heads] * _ODD[1] + np.array(code + 1, np.uint64))
        made.append((mix(np.bitwise_xor.reduceat(value, heads) ^ salt), code, len(heads) - most - 1))
    return made


def smaller_sums(s: np.ndarray) -> list[int] | None:
    """Sums of the sets of at most eight shingles that a set links with and includes."""
    if not 5 <= len(s) <= 10:
        return None
    h, total = mix(s), np.add.reduce(mix(s))
    if len(s) < 10:
        return (total - h).astype(np.int64).tolist()
    i, j = np.triu_indices(10, 1)
    return (total - h[i] - h[j]).astype(np.int64).tolist()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def set_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, sig, n_keys, smaller``: equal sets have equal ``sig``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sig, keys, smaller = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                n.append(len(s))
                sig.append(signature(s) if len(s) else None)
                keys.append(sum(min(len(s), pieces(level)) for level in levels(len(s))))
                smaller.append(smaller_sums(s))
            columns = [*(pa.array(x, pa.int64()) for x in (n, sig, keys)), pa.array(smaller, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_shingles", "sig", "n_keys", "smaller"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_shingles long, sig long, n_keys long, smaller array<long>")


def _opened(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(block[:8], "little")
    owners = np.frombuffer(block, _OWNER, n, 8)
    rest = 8 + owners.nbytes
    count = (len(block) - rest) // 6
    return np.frombuffer(block, np.uint32, count, rest), owners[np.frombuffer(block, np.uint16, count, rest + 4 * count)]


def _several(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: which occur more than once, and how often these do."""
    sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)])
    held = np.repeat(sizes, sizes)
    return held > 1, held[held > 1]


def shared_pieces(docs: DataFrame, parts: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, sig, level, top, spare, own, n, held``: the pieces that several sets hold.

    A task emits the keys of equal sets once. Keys are dealt to ``parts`` as
    blocks of numbers; a part is sorted and keys of one set dropped. Within a
    part 32 bits tell keys apart: a chance meeting is one candidate more.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple] = []
        total = 0

        def flush() -> pa.RecordBatch:
            """A block for each part: its sets once, then keys beside the places of their sets."""
            owners = np.array([h[1:] for h in held], _OWNER)
            key = np.concatenate([h[0] for h in held])
            place = np.repeat(np.arange(len(held), dtype=np.uint16), [len(h[0]) for h in held])
            part = parts_of(key, parts)
            order = np.argsort(part.astype(np.uint16) if parts <= 65536 else part, kind="stable")
            key, place, part = key[order].astype(np.uint32), place[order], part[order]
            heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            blocks = []
            for begin, end in zip(heads, np.r_[heads[1:], len(part)], strict=True):
                own = place[begin:end]  # ascending, as the sort is stable
                new = np.r_[True, own[1:] != own[:-1]]
                used = owners[own[new]]
                blocks.append(len(used).to_bytes(8, "little") + used.tobytes() + key[begin:end].tobytes() + (np.cumsum(new) - 1).astype(np.uint16).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(part[heads].astype(np.int32)), pa.array(blocks, pa.binary())], names=["part", "block"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingles(text)
                bands = levels(len(s))
                if not bands or doc_id is None:
                    continue
                sig = signature(s)
                if sig in seen:
                    continue
                seen.add(sig)
                for level in bands:
                    for keys, code, spare in sketch_keys(s, level):
                        held.append((keys, sig, code, spare, len(s)))
                        total += len(keys)
                if total >= BATCH_KEYS or len(held) >= BATCH_SETS:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks.setdefault(part, []).append(block)
        for part in list(blocks):
            key, own = (np.concatenate(x) for x in zip(*map(_opened, blocks.pop(part)), strict=True))
            order = np.argsort(key, kind="stable")
            order = order[_several(key[order])[0]]
            key, own = key[order], own[order]
            order = np.lexsort((own["level"], own["sig"], key))
            key, own = key[order], own[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (own["sig"][1:] != own["sig"][:-1]) | (own["level"][1:] != own["level"][:-1])]
            key, own = key[new], own[new]  # equal sets once
            several, held = _several(key)
            key, own = key[several].astype(np.int64) + (np.int64(part) << np.int64(32)), own[several]
            level = own["level"].astype(np.int32)
            top = _TOPS[level % LEVELS]
            count = own["spare"] + (top // 4).astype(np.int32) + np.int32(1)
            columns = (key, own["sig"], level, top, own["spare"], count, own["n"], held.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=["key", "sig", "level", "top", "spare", "own", "n", "held"])

    made = _texts(docs, id_col, text_col).mapInArrow(emit, "part int, block binary")
    return made.repartition(parts, "part").mapInArrow(reduce, "key long, sig long, level int, top long, spare int, own int, n int, held int")


def set_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``sig, members``: the sorted hashes of each document's set, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([signature(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["sig", "members"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "sig long, members binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                common = int((y[np.searchsorted(y, x).clip(0, len(y) - 1)] == x).sum())
                linked.append(100 * common >= SIMILAR * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    left = sets.select(F.col("sig").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("sig").alias("b"), F.col("members").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _fits() -> Column:
    return 100 * F.least("n", "o") >= SIMILAR * F.greatest("n", "o")


def _candidates(shared: DataFrame) -> DataFrame:
    """``key, sig, n, held``: the pieces at which a set has to look for partners.

    Linked sets agree in more pieces than the spare ones. A set with no more
    shared pieces than that has no partner. Of the others, in one order of all
    keys, the most crowded spare ones can go: one more agrees. What a set has
    before the rarest piece that it shares with a linked one is in the
    difference of the two, which is at most a quarter of its size.
    """
    for _ in range(2):
        mine = Window.partitionBy("sig", "level")
        placed = shared.withColumns({"_rank": F.row_number().over(mine.orderBy("held", "key")), "_several": F.count("*").over(mine)})
        placed = placed.filter("_several > spare").withColumns({"_at": F.expr("own - _several + _rank - 1"), "kept": F.expr("_rank <= _several - spare")})
        placed = placed.withColumn("kept", F.expr("kept and 4 * _at <= n")).drop("_rank", "_several", "_at")
        keys = placed.groupBy("key").agg(F.min("sig").alias("_a"), F.max("sig").alias("_b")).filter("_a <> _b").select("key")
        placed = written(placed.join(keys, "key"), "pieces")
        shared = placed.drop("kept")
    return placed.filter("kept").select("key", "sig", "n", "held")


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of some ranges, one after the other."""
    return np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)


def close_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, component: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked sets of different components; without ``right`` among ``left``.

    Each set of the left meets the sets that hold its shingles by an inverted
    index of the right ones, which gives the sizes of all intersections.
    """
    among = right is None
    right = left if among else right
    sizes = np.array([len(s) for s in right], np.int64)
    members = np.concatenate(right)
    order = np.argsort(members, kind="stable")
    owner = np.repeat(np.arange(len(right)), sizes)[order]
    members = members[order]
    heads = np.flatnonzero(np.r_[True, members[1:] != members[:-1]])
    runs = np.diff(np.r_[heads, len(members)])
    names = members[heads]
    found_a, found_b = [], []
    for i, s in enumerate(left):
        at = np.searchsorted(names, s).clip(0, len(names) - 1)
        at = at[names[at] == s]
        common = np.bincount(owner[_ranges(heads[at], runs[at])], minlength=len(right))
        linked = (100 * common >= SIMILAR * (len(s) + sizes - common)) & (other != component[i])
        if among:
            linked[: i + 1] = False
        j = np.flatnonzero(linked)
        found_a.append(np.full(len(j), i))
        found_b.append(j)
    return np.concatenate(found_a), np.concatenate(found_b)


def linked_in_groups(homes: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: the links between sets of one group ``lead`` and different ``component`` of ``homes (lead, sig, n, component)``.

    A group is cut into chunks of about ``CHUNK`` shingles, and each two of
    them meet in a task: a group of any size is held by none, and the rows
    made for it grow with its sets times its chunks.
    """
    chunks = homes.groupBy("lead").agg(F.expr(f"cast(ceil(sum(n) / {CHUNK}) as int)").alias("_chunks"))
    dealt = homes.join(chunks, "lead").withColumn("_own", F.expr("cast(pmod(xxhash64(sig), _chunks) as int)"))
    dealt = dealt.withColumn("_met", F.explode(F.expr("sequence(0, _chunks - 1)"))).drop("_chunks", "n")
    dealt = dealt.withColumns({"_i": F.least("_own", "_met"), "_j": F.greatest("_own", "_met")}).drop("_met")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
            sig = np.array([r[0] for r in rows], np.int64)
            component = np.array([r[1] for r in rows], np.int64)
            if (component == component[0]).all():
                return
            members = [np.frombuffer(r[3], np.uint64) for r in rows]
            own = np.array([r[2] for r in rows])
            if i == j:
                a, b = close_pairs(members, None, component, component)
                yield from zip(sig[a].tolist(), sig[b].tolist(), strict=True)
                return
            x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
            if len(x) and len(y):
                a, b = close_pairs([members[k] for k in x], [members[k] for k in y], component[x], component[y])
                yield from zip(sig[x[a]].tolist(), sig[y[b]].tolist(), strict=True)

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        now, rows = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for lead, i_, j_, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (lead, i_, j_):
                    if len(rows) > 1:
                        _, i, j = now
                        found.extend(links(rows))
                    now, rows = (lead, i_, j_), []
                rows.append(row)
            yield out(found)
        if len(rows) > 1:
            _, i, j = now
            yield out(list(links(rows)))

    met = dealt.join(sets, "sig").repartition("lead", "_i", "_j").sortWithinPartitions("lead", "_i", "_j")
    return met.select("lead", "_i", "_j", "sig", "component", "_own", "members").mapInArrow(run, "a long, b long")


def linked_sets(docs: DataFrame, kinds: DataFrame, parts: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``a, b``: enough links of different sets of nine shingles or more to connect all that are linked.

    ``kinds`` has a document (``kind``) of each set (``sig``).
    """
    member = _candidates(written(shared_pieces(docs, parts, id_col, text_col), "shared"))
    wanted = kinds.join(member.select("sig").distinct(), "sig", "left_semi").select("sig", "kind")
    picked = docs.join(wanted, docs[id_col].cast("long") == wanted["kind"], "left_semi")
    # of a repeated id also others; as a table it has a size, by which Spark chooses the joins with the pairs
    sets = written(set_table(picked, id_col, text_col).dropDuplicates(["sig"]), "sets")

    # first every set with the leader of its key, then what is still apart with all others of the same leader
    degree = member.groupBy("sig").agg(F.sum("held").alias("degree"))
    best = F.max_by(F.struct(F.col("sig").alias("other"), F.col("n").alias("o")), F.struct("degree", "sig"))
    lead = member.join(degree, "sig").groupBy("key").agg(best.alias("_l")).select("key", "_l.*")
    led = written(member.drop("held").join(lead, "key").filter("sig <> other"), "led")
    near = led.filter(_fits()).select(F.least("sig", "other").alias("a"), F.greatest("sig", "other").alias("b")).distinct()
    first = settled(verified(near, sets))
    label = components(first).select(F.col("id").alias("sig"), F.col("component").alias("_new"))
    now = led.join(label, "sig", "left").withColumn("component", F.coalesce("_new", "sig"))
    ends = now.groupBy("key").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).filter("_a <> _b").select("key")
    homes = written(now.join(ends, "key").select(F.col("other").alias("lead"), "sig", "n", "component").distinct(), "homes")
    return first.unionByName(linked_in_groups(homes, sets))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    Documents without words have an empty set and are a component of their
    own, as are rows with a null id (component null). Rows that share an id
    are one vertex, with the links of all their texts. An empty table gives an
    empty result; other columns are not read.
    """
    spark = docs.sparkSession
    sizes = settled(set_sizes(docs, id_col, text_col))
    kinds = settled(sizes.filter("n_shingles > 0 and doc_id is not null").groupBy("sig").agg(
        F.min("doc_id").alias("kind"), F.max("n_shingles").alias("n"), F.max("n_keys").alias("n_keys"), F.first("smaller").alias("smaller")))
    total = kinds.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // KEYS_PER_PART))

    larger = kinds.filter("smaller is not null").select("kind", F.col("n").alias("o"), F.explode("smaller").alias("sig"))
    least = kinds.filter("n <= 8").select("sig", F.col("kind").alias("b"), "n")
    short = larger.join(least, "sig").filter(100 * F.col("n") >= SIMILAR * F.col("o")).select(F.col("kind").alias("a"), "b")
    same = sizes.join(kinds.select("sig", "kind"), "sig").filter("doc_id <> kind").select(F.col("doc_id").alias("a"), F.col("kind").alias("b"))
    links = linked_sets(docs, kinds, parts, id_col, text_col)
    ends = [kinds.select(F.col("sig").alias(x), F.col("kind").alias(f"_{x}")) for x in "ab"]
    links = links.join(ends[0], "a").join(ends[1], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    label = components(links.unionByName(short).unionByName(same))
    out = sizes.join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
