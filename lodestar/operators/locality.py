"""Rankings from the directory tree and from package membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.paths import ancestors, dirname
from lodestar.operators.filegraph import small_packages
from lodestar.operators.ranking import locale_order


def asked_of(files: DataFrame, anchors: DataFrame, keys: list) -> DataFrame:
    """The files of repositories that have an anchor; no other can be in an answer."""
    return files.join(anchors.select(*keys).distinct(), keys, "left_semi") if keys else files


def package_mates(files: DataFrame, anchors: DataFrame, limit: int, keys=(), max_size: int | None = None) -> DataFrame:
    """The first ``limit`` files of the anchor's package in listing order.

    Packages of more than ``max_size`` files, if it is given, have no mates.

    Only the first ``limit + 1`` members of a package can appear in any answer, so each
    package is cut to those before it meets the anchors.
    ``files(keys, file, package, seq)``
    """
    keys = list(keys)
    files = asked_of(files, anchors, keys)
    members = files.join(small_packages(files, keys, max_size), [*keys, "package"], "left_semi")
    listing = Window.partitionBy(*keys, "package").orderBy("seq")
    heads = (
        members.withColumn("_pos", F.row_number().over(listing))
        .filter(F.col("_pos") <= limit + 1)
        .select(*keys, "package", "file", "_pos")
    )
    located = anchors.select(*keys, "anchor").distinct().join(
        files.select(*keys, F.col("file").alias("anchor"), "package"), [*keys, "anchor"]
    )
    mates = located.join(heads, [*keys, "package"]).filter(F.col("file") != F.col("anchor"))
    order = Window.partitionBy(*keys, "anchor").orderBy("_pos")
    return (
        mates.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select(*keys, "anchor", "file", "rank")
    )


def directory_ranked(files: DataFrame, anchors: DataFrame, limit: int, keys=(), place: str | None = None) -> DataFrame:
    """Same directory first, then ancestors and descendants, then sibling directories.

    Ties go by file name, so from any one directory only its first ``limit + 1`` names
    can be listed. The list is therefore built once per directory from such heads, and
    anchors only look it up; files are never paired with files.

    ``place`` names a column of ``files`` that numbers a repository's files in that order,
    if there is one; texts are then not compared again.
    """
    keys = list(keys)
    named = [*keys, "file"] if place is None else [*keys, "file", place]
    order = [locale_order("file"), F.col("file")] if place is None else [F.col(place)]
    located = asked_of(files, anchors, keys).select(*named).distinct().withColumn("dir", dirname("file"))
    by_name = Window.partitionBy(*keys, "dir").orderBy(*order)
    heads = (
        located.withColumn("_pos", F.row_number().over(by_name))
        .filter(F.col("_pos") <= limit + 1)
        .select(F.col("dir").alias("other"), *named)
    )
    dirs = located.select(*keys, "dir").distinct()
    asked = anchors.select(*keys, "anchor").distinct().withColumn("dir", dirname("anchor"))
    homes = asked.select(*keys, "dir").distinct()

    same = homes.select(*keys, "dir", F.col("dir").alias("other"), F.lit(3).alias("tier"))
    above = homes.select(*keys, "dir", F.explode(ancestors("dir")).alias("other"), F.lit(2).alias("tier"))
    below = dirs.select(*keys, F.explode(ancestors("dir")).alias("dir"), F.col("dir").alias("other")).join(
        homes, [*keys, "dir"], "left_semi"
    ).withColumn("tier", F.lit(2))
    near = same.unionByName(above).unionByName(below).join(heads, [*keys, "other"])

    # Siblings share a parent, and no ancestor or descendant has the same parent as the
    # home. So one list per parent serves all its directories: of twice the heads, at
    # most half are the home's own.
    by_parent = Window.partitionBy(*keys, "parent").orderBy(*order)
    sibling_heads = (
        heads.withColumn("parent", dirname("other"))
        .withColumn("_n", F.row_number().over(by_parent))
        .filter(F.col("_n") <= 2 * (limit + 1))
        .drop("_n")
    )
    far = (
        homes.withColumn("parent", dirname("dir"))
        .join(sibling_heads, [*keys, "parent"])
        .filter(F.col("other") != F.col("dir"))
        .withColumn("tier", F.lit(1))
    )

    columns = [*named, "dir", "tier"]
    by_tier = Window.partitionBy(*keys, "dir").orderBy(F.col("tier").desc(), *order)
    per_dir = (
        near.select(*columns)
        .unionByName(far.select(*columns))
        .withColumn("_n", F.row_number().over(by_tier))
        .filter(F.col("_n") <= limit + 1)
    )
    answers = asked.join(per_dir, [*keys, "dir"]).filter(F.col("file") != F.col("anchor"))
    by_rank = Window.partitionBy(*keys, "anchor").orderBy("_n")
    return (
        answers.withColumn("rank", F.row_number().over(by_rank))
        .filter(F.col("rank") <= limit)
        .select(*keys, "anchor", "file", F.col("tier").alias("score"), "rank")
    )
