"""Version-control history as rows of (commit, file)."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_log(logs: DataFrame, log: str = "value") -> DataFrame:
    """``(commit_id, file)`` from a log that writes a NUL before each commit's file list."""
    chunks = logs.select(F.posexplode(F.split(F.col(log), "\u0000")).alias("commit_id", "chunk"))
    names = F.filter(F.transform(F.split("chunk", "\n"), lambda n: F.trim(n)), lambda n: n != "")
    return chunks.select(F.col("commit_id").cast("long").alias("commit_id"), F.explode(names).alias("file"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A captured log, one record per commit so that a large log is split over tasks."""
    chunks = spark.read.option("lineSep", "\u0000").text(path).withColumn("commit_id", F.monotonically_increasing_id())
    names = F.filter(F.transform(F.split("value", "\n"), lambda n: F.trim(n)), lambda n: n != "")
    return chunks.select("commit_id", F.explode(names).alias("file"))


def capture_log(root: str, target: str, max_commits: int | None = None) -> bool:
    """Write the log of a checkout, or its newest ``max_commits``, to ``target``; False when there is no history."""
    newest = [] if max_commits is None else [f"-n{max_commits}"]
    command = ["git", "-C", root, "log", *newest, "--name-only", "--no-merges", "--pretty=format:%x00"]
    with open(target, "wb") as out:
        return subprocess.run(command, stdout=out, stderr=subprocess.DEVNULL, check=False).returncode == 0
