"""Keeping facts and graph current while edits arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.operators import resolve
from lodestar.plans.indexing import reindex
from lodestar.sources.sinks import save_graph

_FACTS = ("files", "defs", "refs", "imports", "locals")


def save_facts(facts: resolve.Facts, path: str) -> None:
    for name in _FACTS:
        getattr(facts, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load_facts(spark: SparkSession, path: str, modules=None, aliases=None, keys=()) -> resolve.Facts:
    return resolve.Facts(*(spark.read.parquet(f"{path}/{n}") for n in _FACTS), modules, aliases, tuple(keys))


def follow_edits(edits: DataFrame, start: resolve.Facts, target: str, checkpoint: str):
    """Start a query that re-reads edited files and resolves the graph after each batch.

    ``edits(keys, file, content)`` streams the new text of changed files. Batch ``n``
    reads version ``n - 1`` and overwrites version ``n``, so a repeated batch gives the
    same result.
    """
    spark = edits.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        before = start if number == 0 else load_facts(
            spark, f"{target}/v{number - 1}/facts", start.modules, start.aliases, start.keys
        )
        after = reindex(before, batch)
        save_facts(after, f"{target}/v{number}/facts")
        save_graph(resolve.resolve(after), f"{target}/v{number}/graph")

    return edits.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
