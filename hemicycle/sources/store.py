"""Stored plans, run manifests and bundles."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from hemicycle.functions.frames import rnd
from hemicycle.functions.ordered import row_index
from hemicycle.plans.table import filter_plans, sample_plans
from hemicycle.sources.tables import list_files

ASSIGNMENT = "run_id string, scenario string, chain_id tinyint, draw int, unit_id string, district smallint"
MANIFEST = (
    "run_id string, timestamp_start timestamp, timestamp_end timestamp, "
    "scenario struct<name:string,pop_tolerance_requested:double,n_districts:int>, "
    "data map<string,string>, algorithm map<string,string>, environment map<string,string>, outputs map<string,string>"
)


#: parts of a run and scenario that may go to different tasks
WRITE_PARTS = 64


def write_plans(plans: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Long plan rows as snappy Parquet by run and scenario.

    A task sorts its rows by folder, so rows are first dealt to tasks of
    Spark's advisory size, whatever files they were read from.
    """
    typed = plans.where("unit_id IS NOT NULL").select(
        F.col("run_id").cast("string"), F.col("scenario").cast("string"), F.col("chain_id").cast("tinyint"),
        F.col("draw").cast("int"), F.col("unit_id").cast("string"), F.col("district").cast("smallint"),
    )
    parts = typed.withColumn("_part", F.pmod(F.xxhash64("draw", "unit_id"), F.lit(WRITE_PARTS)))
    dealt = parts.hint("rebalance", "run_id", "scenario", "_part").drop("_part")
    dealt.write.mode(mode).partitionBy("run_id", "scenario").option("compression", "snappy").parquet(path)


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """Plan rows; filters on run and scenario prune whole folders."""
    return spark.read.schema(ASSIGNMENT).parquet(path)


def write_manifest(manifest: DataFrame, path: str, mode: str = "append") -> None:
    manifest.write.mode(mode).json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


class PlanStore:
    """Assignments, statistics, chain metrics and manifests under one folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def save(self, plans: DataFrame, stats: DataFrame, chains: DataFrame, manifest: DataFrame) -> None:
        write_plans(plans, f"{self.base}/assignments")
        stats.write.mode("overwrite").parquet(f"{self.base}/ensemble_stats")
        chains.write.mode("overwrite").parquet(f"{self.base}/chain_metrics")
        write_manifest(manifest, f"{self.base}/run_manifest", "overwrite")

    def plans(self) -> DataFrame:
        return read_plans(self.spark, f"{self.base}/assignments")

    def stats(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/ensemble_stats")

    def chains(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/chain_metrics")

    def manifest(self) -> DataFrame:
        return read_manifest(self.spark, f"{self.base}/run_manifest")

    def scenario_name(self) -> str:
        """Of the assignments, else of the manifest, else ``unknown``."""
        row = self.plans().select("scenario").limit(1).first() or self.manifest().select("scenario.name").limit(1).first()
        return row[0] if row and row[0] else "unknown"

    def _keyed(self) -> DataFrame:
        return self.plans().withColumnRenamed("draw", "plan_id")

    def filter(self, **bounds: float) -> DataFrame:
        return filter_plans(self._keyed(), self.stats(), **bounds).withColumnRenamed("plan_id", "draw")

    def sample(self, n: int, seed: int) -> DataFrame:
        return sample_plans(self._keyed(), n, seed).withColumnRenamed("plan_id", "draw")


def latest_runs(files: DataFrame, run_id: str | None = None) -> DataFrame:
    """The newest statistics file of each scenario.

    Paths look like ``<scenario>/ensemble_stats...`` or
    ``<scenario>/run_<time>_<id>/ensemble_stats...``. Without a run id the
    file next to the run folders wins; with one, the newest run whose folder
    holds the id, its first 8 letters, or the 8 letters without dashes.
    """
    parts = files.select(
        "path",
        F.regexp_extract("path", r"([^/]+)(?:/run_[^/]+)?/ensemble_stats[^/]*(?:/[^/]+)?$", 1).alias("scenario"),
        F.regexp_extract("path", r"/(run_[^/]+)/ensemble_stats", 1).alias("run"),
    ).where("scenario <> ''")
    if run_id is not None:
        names = [run_id, run_id[:8], run_id.replace("-", "")[:8]]
        match = F.lit(False)
        for n in names:
            match = match | F.contains(F.col("run"), F.lit(n))
        parts = parts.where(match)
    rank = F.when(F.col("run") == "", F.lit("~")).otherwise(F.col("run"))
    return parts.groupBy("scenario").agg(F.max_by("run", rank).alias("run"), F.max_by("path", F.struct(rank, "path")).alias("path"))


def load_ensembles(spark: SparkSession, base: str, scenarios: Sequence[str] | None = None, run_id: str | None = None) -> DataFrame:
    """Statistics of the chosen run of every scenario, tagged by scenario.

    Columns are matched by name: files are read together only if their headers
    agree, and a column that a file lacks is null there. Columns in which
    every value is a number become doubles. The file of a run may also be a
    folder of parts. Without any file the result has the scenario only.
    """
    chosen = latest_runs(list_files(spark, base, "*.csv").where(F.contains("path", F.lit("/ensemble_stats"))), run_id)
    if scenarios is not None:
        chosen = chosen.where(F.col("scenario").isin(list(scenarios)))
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in chosen.select("path").collect():  # one path per scenario
        path = re.sub(r"(/ensemble_stats[^/]*)/[^/]*$", r"\1", row.path)
        header = tuple(spark.read.option("header", True).csv(path).columns)
        groups.setdefault(header, []).append(path)
    scenario = F.regexp_extract(F.input_file_name(), r"([^/]+)(?:/run_[^/]+)?/ensemble_stats[^/]*(?:/[^/]+)?$", 1)
    stats = spark.createDataFrame([], "scenario string")
    for paths in groups.values():
        rows = spark.read.option("header", True).csv(paths).withColumn("scenario", scenario)
        stats = stats.unionByName(rows, allowMissingColumns=True)
    names = [c for c in stats.columns if c != "scenario"]
    if not names:
        return stats
    number = {c: F.col(f"`{c}`").try_cast("double") for c in names}
    odd = stats.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & number[c].isNull()).alias(c) for c in names]).first()
    return stats.select("scenario", *[(F.col(f"`{c}`") if odd[c] else number[c]).alias(c) for c in names])


def load_scenario_statuses(spark: SparkSession, base: str) -> DataFrame:
    """(scenario, status, reason) of scenarios that left a status file."""
    rows = spark.read.schema("status string, reason string").option("multiLine", True).option(
        "recursiveFileLookup", True).option("pathGlobFilter", "*status*.json").json(base)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("scenario"), "status", "reason")


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Undirected edges once, smaller end first, without loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def bundle_units(units: DataFrame, compactness: DataFrame, shapes: DataFrame) -> DataFrame:
    """GeoJSON-shaped rows: (unit_id, feature) with compactness to 6 digits.

    ``shapes`` is the vertex table of the units.
    """
    rings = shapes.groupBy("unit_id", "part", "ring").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.array(p["x"], p["y"])).alias("_ring"))
    parts = rings.groupBy("unit_id", "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("ring", "_ring"))), lambda r: r["_ring"]).alias("_part"))
    polygons = parts.groupBy("unit_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "_part"))), lambda p: p["_part"]).alias("coordinates"))
    fields = units.join(compactness.select("unit_id", rnd("polsby_popper", 6).alias("compactness")), "unit_id", "left")
    both = fields.join(polygons, "unit_id")
    feature = F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.struct("unit_id", *[c for c in fields.columns if c != "unit_id"]).alias("properties"),
        F.struct(F.lit("MultiPolygon").alias("type"), "coordinates").alias("geometry")))
    return both.select("unit_id", feature.alias("feature"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    canonical_edges(edges).write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def redist_inputs(units: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Indexed units and half edges (i < j) for an outside sampler."""
    indexed = row_index(units, (), ["unit_id"], "idx")
    pairs = canonical_edges(edges)
    for end, name in (("src", "i"), ("dst", "j")):
        pairs = pairs.join(indexed.select(F.col("unit_id").alias(end), F.col("idx").alias(name)), end)
    return indexed, pairs.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
