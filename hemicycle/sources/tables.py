"""Readers of source files: text in, typed canonical tables out.

Files are read as strings and cast afterwards, so one odd cell never decides
the type of a column. Every ``read_*`` is a thin reader around a
``normalise_*`` function that works on any DataFrame.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from hemicycle.functions.ordered import row_index
from hemicycle.functions.text import normalize_cut
from hemicycle.session import cut_lineage

# fixed values: accepted headers of each canonical column, first match wins
CUT_HEADERS = ["CUT", "cod_cut", "COD_CUT", "CODIGO_COMUNA", "cod_comuna", "COD_COMUNA", "Cod_Comuna", "codigo_cut"]
ROLL_CUT_HEADERS = ["CUT", "COD_COMUNA", "CODIGO_COMUNA", "cod_comuna", "CÓD. COMUNA", "COD. COMUNA", "Cod_Comuna", "codigo_comuna"]
NAME_HEADERS = ["NOMBRE_COMUNA", "N_COMUNA", "COMUNA", "nombre_comuna", "nombre"]
PERSON_HEADERS = ["PERSONAS", "personas", "TOTAL_PERSONAS", "total_personas", "POB_TOTAL", "pob_total", "POBLACION", "poblacion"]
HOUSEHOLD_HEADERS = ["HOGARES", "hogares", "TOTAL_HOGARES", "total_hogares", "VIVIENDAS_HABITADAS", "viviendas_habitadas"]
TOTAL_HEADERS = ["TOTAL", "total", "INSCRITOS", "inscritos", "TOTAL_INSCRITOS", "electores", "ELECTORES"]
MEN_HEADERS = ["HOMBRES", "hombres", "H", "VARONES", "varones"]
WOMEN_HEADERS = ["MUJERES", "mujeres", "M", "FEMENINO", "femenino"]
RESULT_HEADERS = {
    "votos": ["VOTOS", "votos", "TOTAL_VOTOS", "total_votos", "N_VOTOS", "TOTAL VOTOS"],
    "partido": ["PARTIDO", "partido", "LISTA", "lista", "PACTO", "pacto"],
    "candidato": ["CANDIDATO", "candidato", "NOMBRE_CANDIDATO", "CANDIDATO(A)", "nombre"],
    "circunscripcion": ["DISTRITO", "distrito", "CIRCUNSCRIPCION", "CIRCUNSCRIPCIÓN", "DISTRITO ELECTORAL",
                        "circunscripcion", "circunscripción"],
}

#: bytes of the largest file that is hashed in one cell; longer ones are streamed
CELL = 1 << 26
_MARK = b"\xef\xbb\xbf"
_SUFFIX = r"(\.[^.]*)$"
# fixed values: names that Hadoop's codecs unpack, and the option to leave one as it is, whose name is shaded in Spark's jars
PACKED = [".bz2", ".deflate", ".gz", ".lz4", ".passthrough", ".snappy", ".zst"]
_UNPACKED = ["io.compress.passthrough.extension", "org.apache.hadoop.shaded.io.compress.passthrough.extension"]


def read_text_table(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """Delimited file with a header, all columns as strings."""
    return spark.read.option("header", True).option("sep", sep).option("escape", '"').csv(path)


def pick(df: DataFrame, target: str, headers: Iterable[str], required: bool = True) -> DataFrame:
    """Rename the first known header to ``target`` unless it is there already."""
    if target in df.columns:
        return df
    for header in headers:
        if header in df.columns:
            return df.withColumnRenamed(header, target)
    if required:
        raise KeyError(f"no column for {target}; found {df.columns}")
    return df


def whole(column: str) -> Column:
    """Number cut to an integer, 0 where the text is no number."""
    return F.coalesce(F.col(column).try_cast("double").cast("long"), F.lit(0).cast("long"))


def _with_cut(df: DataFrame, headers: Iterable[str] = CUT_HEADERS) -> DataFrame:
    numbered = pick(df, "CUT", headers).withColumn("CUT", F.col("CUT").try_cast("double").cast("int"))
    return numbered.where("CUT IS NOT NULL")


def _keep(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def normalise_population(raw: DataFrame) -> DataFrame:
    out = pick(pick(_with_cut(raw), "personas", PERSON_HEADERS), "hogares", HOUSEHOLD_HEADERS, False)
    out = pick(out, "nombre_comuna", NAME_HEADERS, False)
    for c in ("personas", "hogares"):
        if c in out.columns:
            out = out.withColumn(c, whole(c))
    return _keep(out, ["CUT", "nombre_comuna", "personas", "hogares"])


def read_population(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return normalise_population(read_text_table(spark, path, sep))


def normalise_blocks(raw: DataFrame) -> DataFrame:
    columns = ["CUT", "COD_DISTRITO", "n_per", "n_hog"]
    missing = set(columns) - set(raw.columns)
    if missing:
        raise KeyError(f"missing columns: {sorted(missing)}")
    return raw.select(*[whole(c).alias(c) for c in columns]).where("CUT > 0")


def read_block_population(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return normalise_blocks(read_text_table(spark, path, sep))


def normalise_voter_roll(raw: DataFrame, year: int | None = None) -> DataFrame:
    out = _with_cut(raw, ROLL_CUT_HEADERS)
    for target, headers in (("inscritos", TOTAL_HEADERS), ("hombres", MEN_HEADERS), ("mujeres", WOMEN_HEADERS)):
        out = pick(out, target, headers, False)
    for c in ("inscritos", "hombres", "mujeres"):
        if c in out.columns:
            out = out.withColumn(c, whole(c))
    if "inscritos" not in out.columns:
        if not {"hombres", "mujeres"} <= set(out.columns):
            raise KeyError(f"no registered total and no parts; found {raw.columns}")
        out = out.withColumn("inscritos", F.col("hombres") + F.col("mujeres"))
    out = pick(out, "nombre_comuna", NAME_HEADERS, False)
    if year is not None:
        out = out.withColumn("year", F.lit(year))
    return _keep(out, ["CUT", "nombre_comuna", "hombres", "mujeres", "inscritos", "year"])


def read_voter_roll(spark: SparkSession, path: str, year: int | None = None, sep: str = ",") -> DataFrame:
    return normalise_voter_roll(read_text_table(spark, path, sep), year)


def normalise_results(raw: DataFrame, kind: str = "diputados") -> DataFrame:
    out = raw
    for target, headers in RESULT_HEADERS.items():
        out = pick(out, target, headers, False)
    out = pick(out, "CUT", ROLL_CUT_HEADERS, False)
    if "votos" in out.columns:
        out = out.withColumn("votos", whole("votos"))
    return out.withColumn("tipo_eleccion", F.lit(kind))


def read_results(spark: SparkSession, path: str, kind: str = "diputados", sep: str = ",") -> DataFrame:
    return normalise_results(read_text_table(spark, path, sep), kind)


def read_json_map(spark: SparkSession, path: str, pad_keys: bool = False, whole_file: bool = True) -> DataFrame:
    """A JSON object as (key, value) rows; unit codes may be padded to five.

    ``whole_file=False`` reads one object per line, for large maps.
    """
    text = spark.read.option("wholetext", whole_file).text(path)
    rows = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    return rows.withColumn("key", normalize_cut(F.col("key"))) if pad_keys else rows


def read_candidates_raw(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files of one layout family stacked, headers trimmed and lower-cased.

    Files whose headers differ are read on their own and united by name.
    """
    out = None
    for path in paths:
        part = read_text_table(spark, path)
        part = part.toDF(*[c.strip().lower() for c in part.columns]).withColumn("source_file", F.input_file_name())
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def file_order() -> list[Column]:
    """Sort keys that restore the line order of the files just read."""
    return [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]


def read_plans_wide(spark: SparkSession, path: str, units: DataFrame) -> DataFrame:
    """One column per plan and one line per unit, turned into plan rows.

    ``units`` is (unit_id, position) with the 0-based line of each unit.
    """
    raw = spark.read.option("header", True).csv(path)
    plans = [c for c in raw.columns]
    placed = raw.select(*plans, *[o.alias(f"_o{i}") for i, o in enumerate(file_order())])
    placed = row_index(placed, (), ["_o0", "_o1", "_o2"], "position").select("position", *plans)
    long = placed.unpivot(["position"], plans, "plan", "district")
    return long.join(units, "position").select("plan", "unit_id", F.col("district").cast("int").alias("district"))


GEOJSON = T.StructType([
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
])


def read_layer(spark: SparkSession, path: str, key: str, headers: dict[str, str] | None = None, whole_file: bool = False) -> tuple[DataFrame, DataFrame]:
    """GeoJSON features as a unit table and a vertex table.

    One feature per line is the layout that scales; ``whole_file`` reads a
    FeatureCollection. ``headers`` repairs property names. Of features with
    the same key the first stays.
    """
    if whole_file:
        collection = T.StructType([T.StructField("features", T.ArrayType(GEOJSON))])
        rows = spark.read.schema(collection).option("multiLine", True).json(path)
        rows = rows.select("_metadata.file_path", F.posexplode("features").alias("_pos", "f")).select("file_path", "_pos", "f.*")
        order = F.struct("file_path", "_pos")
    else:
        rows = spark.read.schema(GEOJSON).json(path)
        order = F.struct(*file_order())
    fixed = {**{v: v for v in (headers or {}).values()}, **(headers or {})}
    properties = F.transform_keys("properties", lambda k, _: F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for p in fixed.items() for x in p]), k), k)) if fixed else F.col("properties")
    ordered = rows.select(properties.alias("properties"), "geometry", order.alias("_o"))
    first = ordered.groupBy(F.element_at("properties", F.lit(key)).alias("unit_id")).agg(
        F.min_by(F.struct("properties", "geometry"), "_o").alias("f")
    ).select("unit_id", "f.properties", "f.geometry")
    ring = "array<array<array<double>>>"
    parts = F.when(F.col("geometry.type") == "MultiPolygon", F.from_json("geometry.coordinates", f"array<{ring}>")).otherwise(
        F.array(F.from_json("geometry.coordinates", ring)))
    vertices = (
        first.select("unit_id", F.posexplode(parts).alias("part", "_rings"))
        .select("unit_id", "part", F.posexplode("_rings").alias("ring", "_points"))
        .select("unit_id", "part", "ring", F.posexplode("_points").alias("seq", "_p"))
        .select("unit_id", "part", "ring", "seq", F.col("_p")[0].alias("x"), F.col("_p")[1].alias("y"))
    )
    return first.select("unit_id", "properties"), vertices


def list_files(spark: SparkSession, base: str, pattern: str = "*") -> DataFrame:
    """Path, length and time of files below ``base``; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.load(base).select("path", "length", "modificationTime")


def list_layers(files: DataFrame, layers: DataFrame) -> DataFrame:
    """Files per layer name and whether there are any; ``layers`` is (layer)."""
    name = F.regexp_extract("path", r"([^/]+?)(?:_\d+)?\.[^./]+$", 1)
    counts = files.groupBy(name.alias("layer")).agg(F.count(F.lit(1)).alias("files"))
    return layers.join(counts, "layer", "left").select(
        "layer", F.coalesce("files", F.lit(0)).alias("files"), F.col("files").isNotNull().alias("available"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file_name, time, sha256`` of files whose lines, each with a line end, come in order.

    The reader drops a byte order mark and does not say whether the last line
    has an end; the length of the file tells both.
    """
    now, length, time, seen, held = None, 0, 0, 0, b""
    plain, marked = hashlib.sha256(), hashlib.sha256(_MARK)

    def ended() -> pa.RecordBatch:
        missing = length - seen
        if missing not in (-1, 0, 2, 3):
            raise ValueError(f"{now} has {length} bytes, {seen} were read")
        digest = plain if missing <= 0 else marked
        if missing in (0, 3):
            digest.update(held)
        name = unquote(now).rsplit("/", 1)[-1]
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([time], pa.int64()), pa.array([digest.hexdigest()])], names=["file_name", "time", "sha256"])

    for batch in batches:
        if not batch.num_rows:
            continue
        paths, lines = pc.run_end_encode(batch.column(0)), batch.column(3)
        offsets = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
        data, begin = memoryview(lines.buffers()[2]), 0
        for path, end in zip(paths.values.to_pylist(), paths.run_ends.to_pylist(), strict=True):
            if path != now:
                if now is not None:
                    yield ended()
                now, length, time, seen, held = path, batch.column(1)[begin].as_py(), batch.column(2)[begin].as_py(), 0, b""
                plain, marked = hashlib.sha256(), hashlib.sha256(_MARK)
            part = data[offsets[begin] : offsets[end]]
            for digest in (plain, marked):
                digest.update(held)
                digest.update(part[:-1])
            seen, held, begin = seen + len(part), bytes(part[-1:]), end
    if now is not None:
        yield ended()


@contextmanager
def _one_file_a_task(spark: SparkSession) -> Iterator[None]:
    """Files read meanwhile are neither cut nor put together."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, str(1 << 48))
        yield
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)


def _large_digests(spark: SparkSession, base: str, pattern: str, suffixes: Sequence[str]) -> DataFrame:
    """``file_name, time, sha256`` of files of more than ``CELL`` bytes; a task streams a file.

    A digest needs its bytes in order, so a file is not shared by tasks. Names
    that Spark would unpack are read as they are.
    """
    name, parts = F.col("_metadata.file_name"), []
    known = [s for s in PACKED if s in suffixes]
    for suffix in [None, *known]:
        reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n")
        own = ~F.coalesce(F.regexp_extract(name, _SUFFIX, 1).isin(known), F.lit(False))
        if suffix:
            reader = reader.option("io.compression.codecs", "org.apache.hadoop.io.compress.PassthroughCodec")
            for key in _UNPACKED:
                reader = reader.option(key, suffix)
            own = F.endswith(name, F.lit(suffix))
        rows = reader.text(base).where(own & (F.col("_metadata.file_size") > CELL))
        parts.append(rows.select(
            "_metadata.file_path", "_metadata.file_size", F.unix_micros("_metadata.file_modification_time").alias("time"),
            F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("line"),
        ).mapInArrow(_digests, "file_name string, time long, sha256 string"))
    with _one_file_a_task(spark):
        return cut_lineage(reduce(DataFrame.unionByName, parts))


def file_provenance(spark: SparkSession, base: str, election: str, authority: str, parser: str, pattern: str = "*") -> DataFrame:
    """Content hash, name and UTC time of every source file, of any length."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(base)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    large = [r[0] for r in files.where(F.col("length") > CELL).select(F.regexp_extract(name, _SUFFIX, 1)).distinct().collect()]
    found = files.where(F.col("length") <= CELL).select(name.alias("file_name"), F.unix_micros("modificationTime").alias("time"), F.sha2("content", 256).alias("sha256"))
    if large:
        found = found.unionByName(_large_digests(spark, base, pattern, large))
    return found.select(
        "sha256", "file_name",
        F.date_format(F.to_utc_timestamp(F.timestamp_micros("time"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("modified"),
        F.lit(parser).alias("parser_version"), F.lit(authority).alias("authority"), F.lit(election).alias("election_id"),
    )


def combined_hash(provenance: DataFrame, key: str = "file_name") -> DataFrame:
    """One hash over the file hashes in key order."""
    pairs = F.sort_array(F.collect_list(F.struct(key, "sha256")))
    joined = F.array_join(F.transform(pairs, lambda p: p["sha256"]), "|")
    return provenance.agg(F.sha2(joined, 256).alias("combined_sha256"), F.count(F.lit(1)).alias("files"))
