"""Attribution and repeat reads as a stream: windows over a micro-batch beside what earlier ones left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from lodestar.session import run_dir

TOUCH_SCHEMA = "run_id STRING, path STRING, seq BIGINT, turn INT, action STRING, source STRING, hash STRING"
OUTPUT_SCHEMA = (
    "run_id STRING, path STRING, seq BIGINT, action STRING, attributed_source STRING, first_surfaced_turn INT, "
    "seen_before BOOLEAN, unchanged BOOLEAN"
)
KEYS = ["run_id", "path"]


def _surfaced():
    return F.when((F.col("action") == "surface") & F.col("source").isNotNull(), F.struct("source", "turn"))


def _touched():
    return F.when(F.col("action") != "surface", F.struct("action", "hash"))


def attribute(touches: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Reads and edits of ``touches`` (:data:`TOUCH_SCHEMA`, ``action`` being surface, read or edit) per :data:`OUTPUT_SCHEMA`.

    ``known(run_id, path, first, last)`` is what touches before these have left, see :func:`left_by`.
    """
    upto = Window.partitionBy(*KEYS).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = touches.withColumn("_first", F.first(_surfaced(), True).over(upto)).withColumn("_last", F.last(_touched(), True).over(upto))
    rows = rows.filter(F.col("action") != "surface")
    first, last = F.col("_first"), F.col("_last")
    if known is not None:
        rows = rows.join(known, KEYS, "left")
        first, last = F.coalesce("first", "_first"), F.coalesce("_last", "last")
    is_read = F.col("action") == "read"
    seen = is_read & F.coalesce(last["action"] == "read", F.lit(False))
    return rows.select(
        *KEYS, "seq", "action", F.coalesce(first["source"], F.lit("unseen")).alias("attributed_source"), first["turn"].alias("first_surfaced_turn"),
        seen.alias("seen_before"), (seen & F.coalesce(last["hash"] == F.col("hash"), F.lit(False))).alias("unchanged"),
    )


def left_by(touches: DataFrame) -> DataFrame:
    """(run_id, path, first, last): who surfaced each path first, and the last read or edit of it."""
    return touches.groupBy(*KEYS).agg(
        F.min_by(_surfaced(), F.when(_surfaced().isNotNull(), F.col("seq"))).alias("first"), F.max_by(_touched(), F.when(_touched().isNotNull(), F.col("seq"))).alias("last")
    )


def attribute_to_files(touches: DataFrame, label: str) -> str:
    """Process what is available of the stream ``touches`` into Parquet files in the shared folder; their path.

    A micro-batch is ordered by ``seq`` within a path; batches arrive in order. Each writes what
    it leaves of the paths it holds beside its rows, and reads what earlier ones left of the same
    paths. A repeated batch overwrites its own files, so it gives the same result.
    """
    spark = touches.sparkSession
    base = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def apply(batch: DataFrame, number: int) -> None:
        left = left_by(batch)
        known = None
        if number:
            folders = [f"{base}/left/batch={n}" for n in range(number)]
            earlier = batch.sparkSession.read.schema(StructType(left.schema.fields).add("batch", IntegerType())).option("basePath", f"{base}/left").parquet(*folders)
            earlier = earlier.join(batch.select(*KEYS).distinct(), KEYS, "left_semi")
            known = earlier.groupBy(*KEYS).agg(
                F.min_by("first", F.when(F.col("first").isNotNull(), F.col("batch"))).alias("first"), F.max_by("last", F.when(F.col("last").isNotNull(), F.col("batch"))).alias("last")
            )
        attribute(batch, known).write.mode("overwrite").parquet(f"{base}/rows/batch={number}")
        left.write.mode("overwrite").parquet(f"{base}/left/batch={number}")

    query = touches.writeStream.foreachBatch(apply).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{base}/rows"


def touches_of(events: DataFrame) -> DataFrame:
    """Trace events as touches: surfaced paths, reads and edits."""
    kind = F.col("type")
    none = F.lit(None).cast("string")

    def row(path, action, source, content):
        return F.struct(path.alias("path"), F.lit(action).alias("action"), source.alias("source"), content.alias("hash"))

    shown = F.when(kind == "suggestion_surfaced", F.transform("paths", lambda p: row(p, "surface", F.col("source"), none)))
    reads = F.when(
        kind.isin("path_access", "repeat_read", "failed_read"), F.array(row(F.col("path_name"), "read", none, F.col("hash")))
    )
    edits = F.when(kind == "edit", F.array(row(F.col("path_name"), "edit", none, none)))
    return events.select("run_id", "seq", "turn", F.inline(F.coalesce(shown, reads, edits)))
