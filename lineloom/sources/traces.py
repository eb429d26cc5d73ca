"""Traces, layouts, images and ground truth as tables."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The headers of a wide trace file are these prefixes and a pattern's number.
_PREFIX = {"x": "x-kolam ", "y": "y-kolam "}
_COLUMN = re.compile(_PREFIX["x"] + r"(\d+)$")


def pattern_ids(spark: SparkSession, path: str) -> list[int]:
    """Ids of a wide file's patterns, from its header alone."""
    names = spark.read.option("header", True).csv(path).columns
    return sorted(int(m[1]) for m in map(_COLUMN.match, names) if m)


class Catalog:
    """Names of collections and the files behind them."""

    def __init__(self, paths: Mapping[str, str]) -> None:
        self.paths = dict(paths)

    def path(self, collection: str) -> str:
        if collection not in self.paths:
            raise ValueError(f"unknown collection {collection!r}; known: {', '.join(sorted(self.paths))}")
        return self.paths[collection]

    def traces(self, spark: SparkSession, collection: str, ids: list[int] | None = None) -> DataFrame:
        return read_wide(spark, self.path(collection), collection, ids)


def read_wide(spark: SparkSession, path: str, collection: str, ids: list[int] | None = None) -> DataFrame:
    """trace(collection, pattern_id, step, x, y) of all or some patterns, in one scan that reads only their columns.

    The order of a file's rows is the stroke: the file is read unsplit (multiLine) and rows are numbered in that same projection, before
    any shuffle. Points with a missing coordinate are left out, both coordinates together.
    """
    ids = pattern_ids(spark, path) if ids is None else ids
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in spark.read.option("header", True).csv(path).columns])
    wide = spark.read.option("header", True).option("multiLine", True).schema(schema).csv(path)
    points = [F.struct(F.lit(i).alias("pattern_id"), *[F.col(f"`{_PREFIX[c]}{i}`").alias(c) for c in "xy"]) for i in ids]
    if not points:
        return spark.createDataFrame([], "collection string, pattern_id int, step bigint, x double, y double")
    numbered = wide.withColumn("step", F.monotonically_increasing_id())  # before the explode, which would number its own rows
    long = numbered.select("step", F.explode(F.array(*points)).alias("p"))
    return long.select(F.lit(collection).alias("collection"), "p.pattern_id", "step", "p.x", "p.y").where("x is not null and y is not null")


def event_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces from the events table: a user is a pattern, an event a step; coordinates are multiples of a half."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    x = (F.floor(F.col("value") * 100).cast("bigint") % 17) / F.lit(2.0)
    return e.select(F.col("user_id").alias("pattern_id"), F.col("event_id").alias("step"), x.alias("x"), ((F.col("event_id") % 13) / F.lit(2.0)).alias("y"))


def lattice(spark: SparkSession, width: int, height: int, pattern_id: int = 0) -> DataFrame:
    """Dots of a full rectangle."""
    xs = spark.range(width).select(F.lit(pattern_id).alias("pattern_id"), F.col("id").cast("int").alias("x"))
    return xs.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))


#: Fields of ground-truth documents.
TRUTH = T.StructType(
    [
        T.StructField("csv_path", T.StringType()),
        T.StructField("kolam_number", T.IntegerType()),
        T.StructField("seed", T.LongType()),
        T.StructField("n_nodes", T.IntegerType()),
        T.StructField("n_edges", T.IntegerType()),
        T.StructField("render_scale_px_per_lattice_unit", T.DoubleType()),
        T.StructField("dot_pixel_positions", T.MapType(T.StringType(), T.ArrayType(T.DoubleType()))),
        T.StructField("edges", T.ArrayType(T.ArrayType(T.ArrayType(T.IntegerType())))),
        T.StructField(
            "degradation",
            T.StructType([T.StructField(n, T.DoubleType()) for n in ("rotation_deg", "scale", "contrast", "brightness", "vignette_strength", "blur_sigma", "noise_std", "jpeg_quality", "measured_gray_mean", "measured_gray_std")]),
        ),
    ]
)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground-truth documents, one per file, with the file's stem as image_id."""
    docs = spark.read.option("multiLine", True).schema(TRUTH).json(path)
    return docs.withColumn("image_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1))


def truth_points(truth: DataFrame) -> DataFrame:
    """image_id, idx, lx, ly, x, y: dots of ground truth, in the order of their lattice places."""
    p = truth.select("image_id", F.explode("dot_pixel_positions").alias("at", "px"))
    place = F.split("at", ",")
    p = p.select("image_id", place[0].cast("int").alias("lx"), place[1].cast("int").alias("ly"), F.get("px", 0).alias("x"), F.get("px", 1).alias("y"))
    order = F.array_sort(F.collect_list(F.struct("lx", "ly", "x", "y")))
    return p.groupBy("image_id").agg(order.alias("d")).select("image_id", F.posexplode("d").alias("idx", "d")).select("image_id", F.col("idx").cast("bigint").alias("idx"), "d.*")


def truth_edges(truth: DataFrame) -> DataFrame:
    """image_id, ends, mult of documents that list edges."""
    e = truth.where("edges is not null").select("image_id", F.explode("edges").alias("e"))
    a, b = (F.struct(F.get(F.get("e", i), 0).alias("x"), F.get(F.get("e", i), 1).alias("y")) for i in (0, 1))
    lo, hi = F.least(a, b), F.greatest(a, b)
    return e.groupBy("image_id", lo["x"].alias("ax"), lo["y"].alias("ay"), hi["x"].alias("bx"), hi["y"].alias("by")).agg(F.count("*").alias("mult"))


def image_files(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """path, content of the image files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")


def as_pattern(node: DataFrame, collection: str = "uploaded", pattern_id: int = 0) -> DataFrame:
    """A graph's dots as a stand-in trace: sorted, so that steps are defined."""
    order = F.array_sort(F.collect_list(F.struct("x", "y")))
    dots = node.agg(order.alias("d")).select(F.posexplode("d").alias("step", "p"))
    return dots.select(F.lit(collection).alias("collection"), F.lit(pattern_id).alias("pattern_id"), F.col("step").cast("bigint").alias("step"), F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))
