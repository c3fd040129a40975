"""Session helpers: table access and durable cut points for long lineages."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a session in a single process, as in tests, gets a folder of its own if the
    setting is missing: executors elsewhere would each write to their own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lodestar-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def run_dir(spark: SparkSession) -> str:
    """The part of the shared folder that this application writes to."""
    return f"{shared_dir(spark)}/lodestar/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> bool:
    """Delete what this application has written to the shared folder, once its results are stored.

    Frames that were made before can no longer be read. False if there was nothing.
    """
    _STAGES.clear()
    while _DEALT:
        spark.sql(f"DROP TABLE IF EXISTS {_DEALT.pop()}")
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and continue from the written table.

    This cuts the lineage, survives the loss of executors, and gives the planner
    true sizes for the joins that follow.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(*sources: DataFrame, each: int = 8 << 20) -> int:
    """Partitions that hold ``each`` bytes of the files of ``sources``; no fewer than the session's."""
    spark = sources[0].sparkSession
    files = sorted({unquote(f) for source in sources for f in source.inputFiles()})
    listed = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] if files else 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((listed or 0) / each))


def settle_by(df: DataFrame, label: str, by: list, parts: int) -> DataFrame:
    """Like ``settle``, dealt into ``parts`` buckets of ``by``, which later steps keep.

    Joins and groups on ``by`` and more columns then read the buckets as they are; the
    session is told to take rows that are dealt by some of a join's keys. All rows of one
    value of ``by`` are in one task, so this is for values that are many and small.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    name = f"lodestar_{label}_{uuid.uuid4().hex}"
    dealt = df.repartition(parts, *by).write.bucketBy(parts, *by).option("path", f"{run_dir(spark)}/{name}")
    dealt.format("parquet").saveAsTable(name)
    _DEALT.append(name)
    return spark.table(name)


_DEALT: list = []


def file_state(*sources: DataFrame) -> tuple:
    """Number and hash of path, size and time of the files that ``sources`` read; their contents stay unread."""
    files = sorted({unquote(f) for source in sources for f in source.inputFiles()})
    if not files:
        return (0, None)
    listed = sources[0].sparkSession.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
    mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    return tuple(listed.agg(F.count("*"), F.sum(mark)).first())


_STAGES: dict = {}


def stage(name: str, sources: list[DataFrame], build):
    """What ``build()`` returned for ``sources``, built once for each state of their files.

    ``sources`` are tables as read; a file that was added, replaced or removed leads to a
    new build, so a result is never older than the data it is made from.
    """
    spark = sources[0].sparkSession
    key = (name, spark.sparkContext.applicationId, *file_state(*sources))
    if key not in _STAGES:
        _STAGES[key] = build()
    return _STAGES[key]
