"""Per-run metrics from event traces, and the comparison of two arms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.pricing import match_prices, price_table

# What marks a surfaced path as a test file.
TEST_FILE_PATTERN = r"(_test\.|\.test\.|\.spec\.)"

TRACE_SCHEMA = """
seq BIGINT, run_id STRING, type STRING, turn INT,
task STRING, repo STRING, graph BOOLEAN, test_baseline INT, provider STRING, model STRING, ts BIGINT,
latency_ms DOUBLE, input_tokens BIGINT, output_tokens BIGINT, cache_read_tokens BIGINT,
cache_write_tokens BIGINT, cost_usd DOUBLE, tool_calls ARRAY<STRING>, stop_reason STRING, context_tokens BIGINT,
before_tokens BIGINT, after_tokens BIGINT, trimmed_results INT,
name STRING, args MAP<STRING,STRING>, ok BOOLEAN, result_bytes BIGINT, note STRING,
kind STRING, anchor STRING, ms DOUBLE, results INT, surfaced ARRAY<STRING>,
paths ARRAY<STRING>, source STRING, path_name STRING, attributed_source STRING, first_surfaced_turn INT,
first_turn INT, unchanged BOOLEAN, recovered BOOLEAN, candidates ARRAY<STRING>,
added_lines INT, removed_lines INT, command STRING, preexisting INT, bytes BIGINT, suppressed BOOLEAN,
reason STRING, scoped BOOLEAN, edited_files ARRAY<STRING>
"""

ACCESS_SOURCES = ("graph", "search", "model", "task", "unseen")

# Metrics that are summed over the runs of an arm.
SUMMED = (
    "turns", "model_calls", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens",
    "total_tokens", "cost_usd", "tool_calls", "search_calls", "files_inspected", "unique_files_inspected",
    "repeated_reads", "failed_reads", "failed_reads_recovered", "graph_lookups",
    "graph_suggestions_surfaced", "graph_suggestions_followed", "enrichment_bytes", "files_edited",
    "edits", "test_runs", "test_runs_passed", "compile_checks", "compile_failures", "compile_scoped",
    "unknown_symbols_flagged", "outline_reads", "envelope_reads", "wall_ms",
)


def of_type(events: DataFrame, *types: str) -> DataFrame:
    return events.filter(F.col("type").isin(*types))


def count_by_name(events: DataFrame) -> DataFrame:
    """Tool calls per run and tool name."""
    return of_type(events, "tool_call").groupBy("run_id", "name").agg(F.count("*").alias("calls"))


def tool_call_map(events: DataFrame) -> DataFrame:
    """The same counts as one map per run; the entries are bounded by the tool names."""
    entries = F.collect_list(F.struct("name", "calls"))
    return count_by_name(events).groupBy("run_id").agg(F.map_from_entries(entries).alias("tool_calls_by_name"))


def edited_files(events: DataFrame) -> DataFrame:
    """Distinct edited paths of each run, with the position of their first edit."""
    return of_type(events, "edit").groupBy("run_id", "path_name").agg(F.min("seq").alias("first_seq"))


def first_accesses(events: DataFrame) -> DataFrame:
    """One row per (run, path): the source credited with its first access."""
    return (
        of_type(events, "path_access")
        .groupBy("run_id", "path_name")
        .agg(F.min_by("attributed_source", "seq").alias("source"))
    )


def _path_counts(events: DataFrame) -> DataFrame:
    """Distinct-path counts per run, by two map-side combined aggregations."""

    def role(name, when, path):
        return F.when(when, F.struct(F.lit(name).alias("role"), path.alias("path"), F.col("attributed_source").alias("src")))

    def roles(name, when, paths):
        items = F.transform(
            paths, lambda p: F.struct(F.lit(name).alias("role"), p.alias("path"), F.lit(None).cast("string").alias("src"))
        )
        return F.when(when, items)

    kind, is_type = F.col("kind"), F.col("type")
    path = F.col("path_name")
    single = F.array_compact(
        F.array(
            role("read", (is_type == "path_access") & (kind == "read"), path),
            role("access", is_type == "path_access", path),
            role("edit", is_type == "edit", path),
        )
    )
    empty = F.array().cast("array<struct<role:string,path:string,src:string>>")
    shown = roles("graph", (is_type == "suggestion_surfaced") & (F.col("source") == "graph"), F.col("paths"))
    tests = roles(
        "test",
        is_type == "graph_lookup",
        F.filter("surfaced", lambda p: p.rlike(TEST_FILE_PATTERN)),
    )
    facts = events.select(
        "run_id", "seq", F.inline(F.concat(single, F.coalesce(shown, empty), F.coalesce(tests, empty)))
    )
    distinct = facts.groupBy("run_id", "role", "path").agg(F.min_by("src", "seq").alias("src"))

    def count(name):
        return F.count_if(F.col("role") == name)

    return distinct.groupBy("run_id").agg(
        count("read").alias("unique_files_inspected"),
        count("edit").alias("files_edited"),
        count("graph").alias("graph_suggestions_surfaced"),
        count("test").alias("test_files_discovered"),
        *[
            F.count_if((F.col("role") == "access") & (F.col("src") == s)).alias(f"access_{s}")
            for s in ACCESS_SOURCES
        ],
    )


def run_metrics(events: DataFrame) -> DataFrame:
    """About fifty numbers per run, from one pass of conditional aggregates plus one of distinct paths."""
    is_type = F.col("type")
    zero = F.lit(0).cast("long")

    def n(kind, *conditions):
        test = is_type == kind
        for c in conditions:
            test = test & F.coalesce(c, F.lit(False))
        return F.count_if(test)

    def total(kind, column):
        return F.coalesce(F.sum(F.when(is_type == kind, F.coalesce(F.col(column), zero))), zero)

    def first(kind, *columns):
        return F.min_by(F.struct(*columns), F.when(is_type == kind, F.col("seq")))

    base = events.groupBy("run_id").agg(
        first("run_start", "task", "repo", "graph", "provider", "model").alias("start"),
        first("run_end", "turn", "reason", "ms").alias("end"),
        n("model_call").alias("model_calls"),
        total("model_call", "input_tokens").alias("input_tokens"),
        total("model_call", "output_tokens").alias("output_tokens"),
        total("model_call", "cache_read_tokens").alias("cache_read_tokens"),
        total("model_call", "cache_write_tokens").alias("cache_write_tokens"),
        F.round(F.coalesce(F.sum(F.when(is_type == "model_call", F.col("cost_usd"))), F.lit(0.0)), 6).alias("cost_usd"),
        F.greatest(zero, F.max(F.when(is_type == "model_call", F.col("context_tokens")))).alias("max_context_tokens"),
        n("context_trim").alias("context_trims"),
        n("tool_call").alias("tool_calls"),
        n("tool_call", F.col("name").isin("grep", "glob")).alias("search_calls"),
        n("path_access", F.col("kind") == "read").alias("files_inspected"),
        n("repeat_read").alias("repeated_reads"),
        n("repeat_read", F.col("unchanged")).alias("repeated_reads_stubbed"),
        n("failed_read").alias("failed_reads"),
        n("failed_read", F.col("recovered")).alias("failed_reads_recovered"),
        n("graph_lookup").alias("graph_lookups"),
        F.round(F.coalesce(F.sum(F.when(is_type == "graph_lookup", F.col("ms"))), F.lit(0.0)), 2).alias("graph_lookup_ms_total"),
        F.round(F.coalesce(F.max(F.when(is_type == "graph_lookup", F.col("ms"))), F.lit(0.0)), 2).alias("graph_lookup_ms_max"),
        total("enrichment", "bytes").alias("enrichment_bytes"),
        n("enrichment", F.col("suppressed")).alias("enrichment_suppressed"),
        n("edit").alias("edits"),
        n("test_run").alias("test_runs"),
        n("test_run", F.col("ok")).alias("test_runs_passed"),
        F.coalesce(F.max_by("ok", F.when(is_type == "test_run", F.col("seq"))), F.lit(False)).alias("verified"),
        n("compile_check").alias("compile_checks"),
        n("compile_check", ~F.col("ok")).alias("compile_failures"),
        n("compile_check", F.col("scoped")).alias("compile_scoped"),
        n("unknown_symbol").alias("unknown_symbols_flagged"),
        n("tool_call", F.col("note") == "outline").alias("outline_reads"),
        n("graph_lookup", F.col("kind") == "envelope").alias("envelope_reads"),
    )
    counts = _path_counts(events)
    known = match_prices(
        base.select(F.coalesce("start.model", F.lit("")).alias("model")), price_table(events.sparkSession)
    ).select("model", F.lit(True).alias("cost_known"))
    joined = (
        base.join(counts, "run_id", "left")
        .withColumn("model", F.coalesce("start.model", F.lit("")))
        .join(known, "model", "left")
    )
    sent = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")
    count_columns = [c for c in counts.columns if c != "run_id"]
    passed = [c for c in base.columns if c not in ("run_id", "start", "end")]
    followed = F.coalesce("access_graph", zero)
    surfaced = F.coalesce("graph_suggestions_surfaced", zero)
    return joined.select(
        "run_id",
        F.coalesce("start.task", F.lit("")).alias("task"),
        F.coalesce("start.repo", F.lit("")).alias("repo"),
        F.coalesce("start.graph", F.lit(False)).alias("graph"),
        F.coalesce("start.provider", F.lit("")).alias("provider"),
        "model",
        F.coalesce(F.col("end.turn").cast("long"), F.col("model_calls")).alias("turns"),
        F.coalesce("end.reason", F.lit("unknown")).alias("stop_reason"),
        F.coalesce("end.ms", F.lit(0.0)).alias("wall_ms"),
        *passed,
        *[F.coalesce(c, zero).alias(c) for c in count_columns],
        (sent + F.col("output_tokens")).alias("total_tokens"),
        F.coalesce(F.try_divide("cache_read_tokens", sent), F.lit(0.0)).alias("cache_hit_rate"),
        F.coalesce("cost_known", F.lit(False)).alias("cost_known"),
        followed.alias("graph_suggestions_followed"),
        F.coalesce(F.try_divide(followed, surfaced), F.lit(0.0)).alias("graph_follow_rate"),
    )


def aggregate_arms(metrics: DataFrame, label="label", resolved="verified") -> DataFrame:
    """Totals and per-run means of each arm; rates are recomputed from totals."""
    arms = metrics.groupBy(F.col(label).alias("label")).agg(
        F.count("*").alias("runs"),
        F.count_if(resolved).alias("resolved"),
        *[F.sum(f).alias(f"total_{f}") for f in SUMMED],
        F.max("max_context_tokens").alias("total_max_context_tokens"),
        F.sum("graph_lookup_ms_total").alias("total_graph_lookup_ms_total"),
    )
    sent = F.col("total_input_tokens") + F.col("total_cache_read_tokens") + F.col("total_cache_write_tokens")
    arms = arms.withColumn("resolve_rate", F.col("resolved") / F.col("runs")).withColumn(
        "total_cache_hit_rate", F.coalesce(F.try_divide("total_cache_read_tokens", sent), F.lit(0.0))
    )
    averaged = [c for c in arms.columns if c.startswith("total_") and c != "total_cache_hit_rate"]
    return arms.select(
        "*",
        *[(F.col(c) / F.col("runs")).alias("mean_" + c[len("total_"):]) for c in averaged],
        F.col("total_cache_hit_rate").alias("mean_cache_hit_rate"),
    )
