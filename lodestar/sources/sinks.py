"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.resolve import Graph


def write_trace(events: DataFrame, path: str) -> None:
    """One JSON event per line, null fields left out, one folder per run."""
    events.write.partitionBy("run_id").mode("append").json(path)


def predictions(patches: DataFrame) -> DataFrame:
    """Exactly the fields an evaluator reads."""
    return patches.select("org", "repo", "number", "fix_patch")


def write_predictions(patches: DataFrame, path: str) -> None:
    predictions(patches).write.mode("overwrite").json(path)


def append_progress(results: DataFrame, path: str) -> None:
    """Finished instances are added as they come; earlier lines are never rewritten."""
    results.write.mode("append").json(path)


def write_results(results: DataFrame, path: str) -> None:
    """One folder per instance; only the folders of the instances at hand are replaced."""
    results.write.partitionBy("instance_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def save_graph(graph: Graph, path: str) -> None:
    for name, df in (("nodes", graph.nodes), ("edges", graph.edges), ("files", graph.files), ("unresolved", graph.unresolved)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str, keys=()) -> Graph:
    nodes, edges, files, unresolved = (spark.read.parquet(f"{path}/{n}") for n in ("nodes", "edges", "files", "unresolved"))
    return Graph(nodes, edges, files, unresolved, tuple(keys))


def write_summary(summary: DataFrame, path: str) -> None:
    """A report has a fixed number of rows and goes into one file."""
    summary.coalesce(1).orderBy(F.col(summary.columns[0])).write.mode("overwrite").json(path)
