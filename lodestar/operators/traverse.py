"""Bounded breadth-first reach from every anchor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.ranking import locale_order
from lodestar.session import settle, settle_by


def reach(file_edges: DataFrame, anchors: DataFrame, keys=(), max_hops: int = 5, parts: int | None = None) -> DataFrame:
    """Files within ``max_hops`` of each anchor in either direction.

    ``(keys, anchor, file, hop, weight)``: the first hop that reaches the file, and the
    strongest edge that reaches it at that hop. Only rows found in the previous hop are
    expanded; rows found earlier travel along a self row of the adjacency, which makes
    each hop one join and one combined aggregate. ``parts`` is that of the walk.
    """
    keys = list(keys)
    none = F.lit(None).cast("double")
    if keys:
        file_edges = file_edges.join(anchors.select(*keys).distinct(), keys, "left_semi")
    # both directions and the self rows in one aggregate: a union would be dealt anew
    ways = F.array(*[
        F.struct(F.col(x).alias("file"), F.col(y).alias("dst"), w.alias("w"), F.lit(x == y).alias("self"))
        for x, y, w in (("src", "dst", F.col("w")), ("dst", "src", F.col("w")), ("src", "src", none), ("dst", "dst", none))
    ])
    moves = file_edges.select(*keys, F.inline(ways)).groupBy(*keys, "file", "dst", "self").agg(F.max("w").alias("w")).drop("self")
    moves = settle(moves, "adjacency") if parts is None else settle_by(moves, "adjacency", keys, parts)
    state = anchors.select(*keys, "anchor").distinct().select(
        *keys, "anchor", F.col("anchor").alias("file"), F.lit(0).alias("hop"), F.lit(0.0).alias("weight")
    )
    stays = F.col("w").isNull()
    for hop in range(max_hops):
        met = state.join(moves, [*keys, "file"]).filter(stays | (F.col("hop") == hop))
        found = F.struct(
            F.when(stays, F.col("hop")).otherwise(F.lit(hop + 1)).alias("hop"),
            (-F.when(stays, F.col("weight")).otherwise(F.col("w"))).alias("neg"),
        )
        state = (
            met.select(*keys, "anchor", F.col("dst").alias("file"), found.alias("f"))
            .groupBy(*keys, "anchor", "file")
            .agg(F.min("f").alias("f"))
            .select(*keys, "anchor", "file", F.col("f.hop").alias("hop"), (-F.col("f").getField("neg")).alias("weight"))
        )
        if parts is not None and hop % 2 == 1 and hop + 1 < max_hops:
            state = settle_by(state, "hops", keys, parts)
    return state.filter(F.col("file") != F.col("anchor"))


def bfs_ranked(reached: DataFrame, limit: int, keys=(), max_hops: int = 3) -> DataFrame:
    """Nearest first, then heaviest, then by name.

    A hop that fills the limit is the last one expanded, so ordering the whole reach and
    cutting it at ``limit`` gives the same list as stopping early.
    """
    order = Window.partitionBy(*keys, "anchor").orderBy(
        "hop", F.col("weight").desc(), locale_order("file"), F.col("file")
    )
    near = reached.filter(F.col("hop") <= max_hops)
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def closure_sizes(reached: DataFrame, keys=()) -> DataFrame:
    return reached.groupBy(*keys, "anchor").agg(F.count("*").alias("closure_size"))
