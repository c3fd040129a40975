"""Traces, metrics, progress, prices and recorded responses on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators.pricing import PRICE_SCHEMA
from lodestar.operators.telemetry import TRACE_SCHEMA
from lodestar.sources.dataset import read_lines

TRACE_FIELDS = {
    "runId": "run_id", "testBaseline": "test_baseline", "latencyMs": "latency_ms", "inputTokens": "input_tokens",
    "outputTokens": "output_tokens", "cacheReadTokens": "cache_read_tokens", "cacheWriteTokens": "cache_write_tokens",
    "costUsd": "cost_usd", "toolCalls": "tool_calls", "stopReason": "stop_reason", "contextTokens": "context_tokens",
    "beforeTokens": "before_tokens", "afterTokens": "after_tokens", "trimmedResults": "trimmed_results",
    "resultBytes": "result_bytes", "pathName": "path_name", "attributedSource": "attributed_source",
    "firstSurfacedTurn": "first_surfaced_turn", "firstTurn": "first_turn", "addedLines": "added_lines",
    "removedLines": "removed_lines", "editedFiles": "edited_files",
}


def _split_columns(ddl: str):
    depth, part, out = 0, "", []
    for ch in ddl.replace("\n", " "):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    return [*out, part.strip()]


def read_traces(spark: SparkSession, root: str) -> DataFrame:
    """Every ``trace.jsonl`` without a sibling ``metrics.json``; the run is named by its folder.

    ``seq`` is the position of an event in its file.
    """
    wire = {v: k for k, v in TRACE_FIELDS.items()}
    columns = [c.split(" ", 1) for c in _split_columns(TRACE_SCHEMA)]
    payload = [(n, t) for n, t in columns if n != "seq"]
    schema = ", ".join(f"{wire.get(n, n)} {t}" for n, t in payload)
    reader = spark.read.option("recursiveFileLookup", "true")
    lines = reader.option("pathGlobFilter", "trace.jsonl").text(root).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
    )
    folder = F.regexp_extract("path", "^(?:[a-z]+:)?/*(.*)/[^/]*$", 1)
    whole = reader.option("pathGlobFilter", "metrics.json").format("binaryFile").load(root)
    unscored = lines.withColumn("folder", folder).join(whole.select(folder.alias("folder")), "folder", "left_anti")
    # A line takes at least a byte, so the split's offset plus the row number inside the
    # split orders the lines of a file, however the file was cut.
    in_split = Window.partitionBy("path", "start").orderBy("at")
    placed = unscored.withColumn("seq", F.col("start") + F.row_number().over(in_split))
    parsed = placed.filter(F.trim("value") != "").select("seq", "folder", F.from_json("value", schema).alias("e"))
    return parsed.select(
        "seq",
        F.regexp_extract("folder", "([^/]*)$", 1).alias("run_id"),
        *[F.col(f"e.{wire.get(n, n)}").alias(n) for n, _ in payload if n != "run_id"],
    )


def read_metrics(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Every ``metrics.json`` below ``root``, one object per file."""
    return (
        spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "metrics.json").json(root)
    )


def read_progress(spark: SparkSession, path: str, schema: str, key: str = "instance_id") -> DataFrame:
    """Finished instances; a line cut short by a crash is skipped.

    A record with a field of another type keeps its other fields; that one is null.
    """
    records = read_lines(spark, path).filter(F.col("record").isNotNull())
    fields = spark.createDataFrame([], schema).schema
    rows = records.select(*(F.try_variant_get("record", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in fields))
    return rows.filter(F.col(key).isNotNull())


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Price overrides: one JSON object of model -> rates; an unreadable file gives no rows."""
    rates = "MAP<STRING, STRUCT<input: DOUBLE, output: DOUBLE, cacheRead: DOUBLE, cacheWrite: DOUBLE>>"
    text = spark.read.option("wholetext", "true").text(path)
    entries = text.select(F.explode(F.from_json("value", rates)).alias("price_key", "p"))
    out = entries.select("price_key", "p.input", "p.output", "p.cacheRead", "p.cacheWrite")
    return out.toDF(*[c.split(" ")[0] for c in PRICE_SCHEMA.split(", ")])


def read_cassettes(spark: SparkSession, path: str) -> DataFrame:
    """Recorded responses by request hash, the response kept as a variant."""
    rows = spark.read.text(path).filter(F.trim("value") != "")
    return rows.select(
        F.get_json_object("value", "$.hash").alias("hash"), F.try_parse_json(F.get_json_object("value", "$.response")).alias("response")
    )


def request_hash(*columns) -> Column:
    return F.substring(F.sha1(F.to_json(F.struct(*columns))), 1, 16)
