"""The file-level graph: weighted edges rolled up from symbol edges, degrees, packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.constants import CONFIDENCE_FACTOR, PROPAGATION, lookup_sql
from lodestar.functions.paths import dirname


def edge_weight():
    return F.expr(lookup_sql("kind", PROPAGATION)) * F.expr(lookup_sql("confidence", CONFIDENCE_FACTOR))


def roll_up(edges: DataFrame, keys=()) -> DataFrame:
    """``edges(keys, src_file, dst_file, kind, confidence)`` -> strongest weight per file pair."""
    return (
        edges.filter(F.col("src_file") != F.col("dst_file"))
        .groupBy(*keys, F.col("src_file").alias("src"), F.col("dst_file").alias("dst"))
        .agg(F.max(edge_weight()).alias("w"))
    )


def with_files(edges: DataFrame, nodes: DataFrame, keys=()) -> DataFrame:
    """Attach the files of both ends to symbol edges; edges with a missing end drop out."""
    files = nodes.select(*keys, "id", "file")
    src = files.select(*keys, F.col("id").alias("src"), F.col("file").alias("src_file"))
    dst = files.select(*keys, F.col("id").alias("dst"), F.col("file").alias("dst_file"))
    return edges.join(src, [*keys, "src"]).join(dst, [*keys, "dst"])


def degrees(file_edges: DataFrame, keys=()) -> DataFrame:
    """Size of each file's outgoing row plus its incoming row."""
    ends = file_edges.select(*keys, F.explode(F.array("src", "dst")).alias("file"))
    return ends.groupBy(*keys, "file").agg(F.count("*").alias("degree"))


def both_ways(file_edges: DataFrame, keys=(), forward=True, backward=True) -> DataFrame:
    """Edges along the allowed directions, the stronger weight kept where both exist."""
    ways = []
    if forward:
        ways.append(F.struct(F.col("src").alias("x"), F.col("dst").alias("y")))
    if backward:
        ways.append(F.struct(F.col("dst").alias("x"), F.col("src").alias("y")))
    turned = file_edges.select(*keys, "w", F.inline(F.array(*ways)))
    renamed = turned.select(*keys, F.col("x").alias("src"), F.col("y").alias("dst"), "w")
    if len(ways) == 1:
        return renamed
    return renamed.groupBy(*keys, "src", "dst").agg(F.max("w").alias("w"))


def packages(files: DataFrame) -> DataFrame:
    """Add ``package``: a parsed Go file belongs to its directory's package clause,
    every other file to its directory. ``files(.., file, lang, pkg)`` with null ``lang``
    for a file no parser handles."""
    directory = dirname("file")
    go = F.concat(directory, F.lit("::"), F.col("pkg"))
    return files.withColumn("package", F.when(F.col("lang") == "go", go).otherwise(directory))


def small_packages(files: DataFrame, keys=(), max_size: int | None = None) -> DataFrame:
    """Packages of at most ``max_size`` files, all by default, with their ``members``."""
    sizes = files.groupBy(*keys, "package").agg(F.count("*").alias("members"))
    return sizes if max_size is None else sizes.filter(F.col("members") <= max_size)
