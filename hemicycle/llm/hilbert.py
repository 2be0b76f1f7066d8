"""Sharding along a Hilbert curve through several metadata dimensions.

Every dimension is quantised to a few bits at approximate quantiles, the cell
gets its index on the curve, rows are put in curve order by one range shuffle,
and equal runs are cut. Neighbouring cells land in the same shard, so the
bounds of each dimension per shard are narrow and files can be pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from hemicycle.session import cut_lineage


def order_key(df: DataFrame, name: str) -> Column:
    """A number in the order of the column; strings count by their first bytes."""
    kind = df.schema[name].dataType.simpleString()
    col = F.col(f"`{name}`")
    if kind in ("string", "binary"):
        head = F.rpad(F.hex(F.substring(col.cast("binary"), 1, 7)), 14, "0")
        return F.conv(head, 16, 10).cast("double")
    return col.cast("double")


def quantise(df: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """Add ``_axis0 ..``: the quantile bin of each dimension; nulls are in bin 0.

    The bounds are ``2 ** bits - 1`` numbers a dimension, so they fit a literal.
    """
    shares = F.array(*[F.lit(i / 2**bits) for i in range(1, 2**bits)])
    keyed = df.withColumns({f"_axis{i}": order_key(df, d) for i, d in enumerate(dims)})
    bounds = keyed.agg(*[F.percentile_approx(f"_axis{i}", shares, 10_000).alias(f"b{i}") for i in range(len(dims))]).first()
    codes = {}
    for i in range(len(dims)):
        code = F.hash(f"_axis{i}").bitwiseAND(0)  # zero, but not a constant: the optimiser would unfold the whole curve over it
        for bound in sorted(set(bounds[i] or [])):
            code = code + F.coalesce((F.col(f"_axis{i}") > bound).cast("int"), F.lit(0))
        codes[f"_axis{i}"] = code
    return keyed.withColumns(codes)


def with_curve_index(df: DataFrame, axes: list[str], bits: int, name: str = "curve") -> DataFrame:
    """Add the Hilbert index of integer columns of ``bits`` bits each.

    From the highest bit down, axes are exchanged or inverted as the bit says,
    then the axes are Gray-coded and their bits interleaved.
    """
    own = df.columns
    x = [f"_h{i}" for i in range(len(axes))]
    df = df.withColumns({h: F.col(a).cast("int") for h, a in zip(x, axes, strict=True)})
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i, h in enumerate(x):
            turn = F.col(h).bitwiseAND(1 << bit) != 0
            swap = F.col(x[0]).bitwiseXOR(F.col(h)).bitwiseAND(low)
            first = F.when(turn, F.col(x[0]).bitwiseXOR(F.lit(low))).otherwise(F.col(x[0]).bitwiseXOR(swap))
            df = df.withColumns({x[0]: first} if i == 0 else {x[0]: first, h: F.when(turn, F.col(h)).otherwise(F.col(h).bitwiseXOR(swap))})
    for i in range(1, len(x)):
        df = df.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    flip = F.lit(0)
    for bit in range(bits - 1, 0, -1):
        flip = flip.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(1 << bit) != 0, (1 << bit) - 1).otherwise(0))
    df = df.withColumn("_flip", flip)
    df = df.withColumns({h: F.col(h).bitwiseXOR(F.col("_flip")).cast("long") for h in x})
    index = F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        for h in x:
            index = F.shiftleft(index, 1).bitwiseOR(F.shiftright(F.col(h), bit).bitwiseAND(F.lit(1).cast("long")))
    return df.withColumn(name, index).select(*own, name)


def shard_rows(
    docs: DataFrame, shards: int = 40, dims: tuple[str, ...] = ("lang", "source", "size"), bits: int = 5,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Shard every row so that shards differ by one row at most (law ``rows``).

    Returns ``doc_id, size, text_crc32, curve, shard, slot`` and the dimensions.
    ``size`` is the UTF-8 bytes of the text plus 16 and may be a dimension. A
    null text has no bytes and the checksum of the empty text; null dimensions
    are in the first bin. Equal texts of a cell follow each other; ties are
    broken by id, and fully equal rows take neighbouring slots in any order.
    Rows with null or repeated ids are sharded like all others. With fewer
    rows than shards some shards are empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [d for d in dims if d != "size"]
    base = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), *[F.col(f"`{d}`") for d in own],
    )
    coded = quantise(base, list(dims), bits)
    curved = with_curve_index(coded, [f"_axis{i}" for i in range(len(dims))], bits)
    order = ["curve", "size", "text_crc32", "doc_id"]
    ranged = curved.select("doc_id", "size", "text_crc32", *own, "curve").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.select(
        "*", F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"),
    ))
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy())})
    at = F.col("_before") + F.col("_at")
    rows = placed.join(F.broadcast(offsets), "_part").withColumn("_pos", at).withColumn("shard", F.expr(f"cast(_pos * {shards} div _all as int)"))
    return rows.withColumn("slot", F.expr(f"_pos - (shard * _all + {shards - 1}) div {shards}")).select(
        "doc_id", "size", "text_crc32", *own, "curve", "shard", "slot"
    )


def shard_bounds(sharded: DataFrame, dims: tuple[str, ...] = ("lang", "source", "size")) -> DataFrame:
    """Rows and the bounds of each dimension per shard: what a reader prunes by."""
    return sharded.groupBy("shard").agg(
        F.count("*").alias("rows"), *[f(d).alias(f"{n}_{d}") for d in dims for f, n in ((F.min, "min"), (F.max, "max"))]
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, **options) -> None:
    """Write ``docs`` as one folder a shard, rows in slot order.

    Rows meet their place by ``doc_id``, which must be unique here.
    """
    places = shard_rows(docs, shards, **options).select("doc_id", "shard", "slot")
    rows = docs.join(places, "doc_id").repartition("shard").sortWithinPartitions("shard", "slot")
    rows.drop("slot").write.partitionBy("shard").parquet(path)
