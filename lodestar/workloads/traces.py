"""Agent traces read off the event stream: a user is a run, an event is a trace event."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestar.operators import ledger, telemetry
from lodestar.operators.ordered import nearest_rank
from lodestar.operators.pricing import PRICES, price_table, with_cost
from lodestar.functions.text import estimate_tokens
from lodestar.plans.report import REPORT_ROWS, report_rows, verdict
from lodestar.session import register_tables, table
from lodestar.streaming import ledger as stream_ledger
from lodestar.workloads.registry import workload

# One text for both engines: which trace event each row of the stream stands for.
TRACE = """
base AS (SELECT event_id AS seq, 'u' || user_id AS run_id, user_id, event_type AS e, value AS v,
                CAST(day(ts) AS INTEGER) AS turn,
                CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
trace AS (SELECT seq, run_id, turn, k,
  CASE e
    WHEN 'purchase' THEN CASE WHEN k % 10 = 9 THEN 'context_trim' ELSE 'model_call' END
    WHEN 'click' THEN CASE WHEN k % 5 = 4 THEN 'enrichment' ELSE 'tool_call' END
    WHEN 'view' THEN CASE k % 3 WHEN 0 THEN 'path_access' WHEN 1 THEN 'graph_lookup' ELSE 'suggestion_surfaced' END
    WHEN 'error' THEN CASE k % 4 WHEN 0 THEN 'failed_read' WHEN 1 THEN 'repeat_read' WHEN 2 THEN 'compile_check'
                                 ELSE 'unknown_symbol' END
    ELSE CASE k % 6 WHEN 0 THEN 'run_start' WHEN 1 THEN 'run_end' WHEN 2 THEN 'test_run' WHEN 3 THEN 'path_access'
                    ELSE 'edit' END END AS type,
  'task-' || k AS task, 'repo-' || (k % 5) AS repo, k % 4 < 2 AS graph,
  CASE WHEN k % 4 = 0 THEN 'gpt-5-mini-2026-08-07' WHEN k % 4 = 1 THEN 'gpt-5-' || k
       WHEN k % 4 = 2 THEN 'llama3.1:8b' ELSE 'unlisted-' || k END AS model,
  CAST(round(v * 100) AS BIGINT) AS input_tokens, CAST(k * 3 AS BIGINT) AS output_tokens,
  CAST(round(v * 200) AS BIGINT) % 1000 AS cache_read_tokens, CAST(k AS BIGINT) AS cache_write_tokens,
  v / 1000 AS cost_usd, CAST(round(v * 100) AS BIGINT) + k AS context_tokens,
  CASE k % 4 WHEN 0 THEN 'grep' WHEN 1 THEN 'glob' WHEN 2 THEN 'read_file' ELSE 'bash' END AS name,
  CASE WHEN k % 7 = 0 THEN 'outline' END AS note,
  k % 2 = 0 AS ok, k % 8 = 1 AS unchanged, k % 8 = 4 AS recovered, k % 8 = 2 AS scoped, k % 2 = 1 AS suppressed,
  v AS ms, CAST(k * 11 AS BIGINT) AS bytes,
  CASE WHEN e = 'view' AND k % 3 = 0 THEN 'read' WHEN e = 'signup' AND k % 6 = 3 THEN 'edit'
       WHEN k % 2 = 0 THEN 'envelope' ELSE 'expand' END AS kind,
  CASE k % 3 WHEN 0 THEN 'finished' WHEN 1 THEN 'turn_cap' ELSE 'token_budget' END AS reason,
  'pkg/f' || (k % 37) || CASE WHEN k % 5 = 0 THEN '_test.go' ELSE '.go' END AS path_name,
  'pkg/f' || (k % 37) || CASE WHEN k % 5 = 0 THEN '_test.go' ELSE '.go' END || ',pkg/f' || ((k + 7) % 37) || '.go' AS shown,
  CASE k % 4 WHEN 0 THEN 'graph' WHEN 1 THEN 'search' WHEN 2 THEN 'model' ELSE 'task' END AS source,
  CASE k % 5 WHEN 0 THEN 'graph' WHEN 1 THEN 'search' WHEN 2 THEN 'model' WHEN 3 THEN 'task' ELSE 'unseen' END
    AS attributed_source
  FROM base)
"""


def trace_events(spark, sf_dir):
    register_tables(spark, sf_dir, ["events"])
    rows = spark.sql(f"WITH {TRACE} SELECT * FROM trace")
    shown = F.split("shown", ",")
    return rows.select(
        "*", shown.alias("surfaced"), shown.alias("paths"), F.lit("provider").alias("provider")
    )


_n = "CAST(count(*) FILTER (WHERE {}) AS BIGINT)"


def _count(cond):
    return _n.format(cond)


def _total(kind, column):
    return f"CAST(coalesce(sum({column}) FILTER (WHERE type = '{kind}'), 0) AS BIGINT)"


_PRICE_VALUES = ", ".join(f"('{k}', {a}e0, {b}e0, {c}e0, {d}e0)" for k, (a, b, c, d) in PRICES.items())

METRICS = f"""{TRACE},
prices(price_key, p_input, p_output, p_cache_read, p_cache_write) AS (VALUES {_PRICE_VALUES}),
starts AS (SELECT run_id, task, repo, graph, model FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS n FROM trace WHERE type = 'run_start') t WHERE n = 1),
ends AS (SELECT run_id, turn, reason, ms FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS n FROM trace WHERE type = 'run_end') t WHERE n = 1),
lastrun AS (SELECT run_id, ok FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS n FROM trace WHERE type = 'test_run') t WHERE n = 1),
acc AS (SELECT run_id, path_name, attributed_source FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, path_name ORDER BY seq) AS n FROM trace WHERE type = 'path_access') t WHERE n = 1),
accn AS (SELECT run_id, {', '.join(f"{_count(f'attributed_source = {chr(39)}{s}{chr(39)}')} AS access_{s}" for s in telemetry.ACCESS_SOURCES)}
         FROM acc GROUP BY run_id),
surf AS (SELECT run_id, CAST(count(DISTINCT p) AS BIGINT) AS n FROM (
  SELECT run_id, unnest(string_split(shown, ',')) AS p FROM trace WHERE type = 'suggestion_surfaced' AND source = 'graph') t GROUP BY run_id),
tf AS (SELECT run_id, CAST(count(DISTINCT p) AS BIGINT) AS n FROM (
  SELECT run_id, unnest(string_split(shown, ',')) AS p FROM trace WHERE type = 'graph_lookup') t
  WHERE regexp_matches(p, '(_test\\.|\\.test\\.|\\.spec\\.)') GROUP BY run_id),
agg AS (SELECT run_id, {_count("type = 'model_call'")} AS model_calls,
  {_total('model_call', 'input_tokens')} AS input_tokens, {_total('model_call', 'output_tokens')} AS output_tokens,
  {_total('model_call', 'cache_read_tokens')} AS cache_read_tokens,
  {_total('model_call', 'cache_write_tokens')} AS cache_write_tokens,
  round(coalesce(sum(cost_usd) FILTER (WHERE type = 'model_call'), 0), 6) AS cost_usd,
  coalesce(max(context_tokens) FILTER (WHERE type = 'model_call'), 0) AS max_context_tokens,
  {_count("type = 'context_trim'")} AS context_trims, {_count("type = 'tool_call'")} AS tool_calls,
  {_count("type = 'tool_call' AND name IN ('grep', 'glob')")} AS search_calls,
  {_count("type = 'path_access' AND kind = 'read'")} AS files_inspected,
  {_count("type = 'repeat_read'")} AS repeated_reads, {_count("type = 'repeat_read' AND unchanged")} AS repeated_reads_stubbed,
  {_count("type = 'failed_read'")} AS failed_reads, {_count("type = 'failed_read' AND recovered")} AS failed_reads_recovered,
  {_count("type = 'graph_lookup'")} AS graph_lookups,
  round(coalesce(sum(ms) FILTER (WHERE type = 'graph_lookup'), 0), 2) AS graph_lookup_ms_total,
  round(coalesce(max(ms) FILTER (WHERE type = 'graph_lookup'), 0), 2) AS graph_lookup_ms_max,
  {_total('enrichment', 'bytes')} AS enrichment_bytes, {_count("type = 'enrichment' AND suppressed")} AS enrichment_suppressed,
  {_count("type = 'edit'")} AS edits, {_count("type = 'test_run'")} AS test_runs,
  {_count("type = 'test_run' AND ok")} AS test_runs_passed, {_count("type = 'compile_check'")} AS compile_checks,
  {_count("type = 'compile_check' AND NOT ok")} AS compile_failures, {_count("type = 'compile_check' AND scoped")} AS compile_scoped,
  {_count("type = 'unknown_symbol'")} AS unknown_symbols_flagged,
  {_count("type = 'tool_call' AND note = 'outline'")} AS outline_reads,
  {_count("type = 'graph_lookup' AND kind = 'envelope'")} AS envelope_reads,
  CAST(count(DISTINCT path_name) FILTER (WHERE type = 'path_access' AND kind = 'read') AS BIGINT) AS unique_files_inspected,
  CAST(count(DISTINCT path_name) FILTER (WHERE type = 'edit') AS BIGINT) AS files_edited
  FROM trace GROUP BY run_id),
metrics AS (SELECT a.*, coalesce(s.task, '') AS task, coalesce(s.repo, '') AS repo, coalesce(s.graph, FALSE) AS graph,
  coalesce(s.model, '') AS model, coalesce(CAST(e.turn AS BIGINT), a.model_calls) AS turns,
  coalesce(e.reason, 'unknown') AS stop_reason, coalesce(e.ms, 0e0) AS wall_ms, coalesce(l.ok, FALSE) AS verified,
  {', '.join(f'coalesce(n.access_{s}, 0) AS access_{s}' for s in telemetry.ACCESS_SOURCES)},
  coalesce(g.n, 0) AS graph_suggestions_surfaced, coalesce(t.n, 0) AS test_files_discovered,
  coalesce(n.access_graph, 0) AS graph_suggestions_followed,
  CASE WHEN coalesce(g.n, 0) = 0 THEN 0e0 ELSE coalesce(n.access_graph, 0) / CAST(g.n AS DOUBLE) END AS graph_follow_rate,
  a.input_tokens + a.output_tokens + a.cache_read_tokens + a.cache_write_tokens AS total_tokens,
  CASE WHEN a.input_tokens + a.cache_read_tokens + a.cache_write_tokens = 0 THEN 0e0 ELSE
    a.cache_read_tokens / CAST(a.input_tokens + a.cache_read_tokens + a.cache_write_tokens AS DOUBLE) END AS cache_hit_rate,
  EXISTS (SELECT 1 FROM prices p WHERE starts_with(s.model, p.price_key)) AS cost_known
  FROM agg a LEFT JOIN starts s USING (run_id) LEFT JOIN ends e USING (run_id) LEFT JOIN lastrun l USING (run_id)
  LEFT JOIN accn n USING (run_id) LEFT JOIN surf g USING (run_id) LEFT JOIN tf t USING (run_id)),
arms AS (SELECT CASE WHEN graph THEN 'graph' ELSE 'plain' END AS label, CAST(count(*) AS BIGINT) AS runs,
  CAST(count(*) FILTER (WHERE verified) AS BIGINT) AS resolved,
  count(*) FILTER (WHERE verified) / CAST(count(*) AS DOUBLE) AS resolve_rate,
  {', '.join(f'CAST(sum({f}) AS DOUBLE) AS total_{f}' for f in telemetry.SUMMED)},
  CAST(max(max_context_tokens) AS DOUBLE) AS total_max_context_tokens,
  sum(graph_lookup_ms_total) AS total_graph_lookup_ms_total
  FROM metrics GROUP BY 1)
"""

ROUNDED = {"cache_hit_rate", "graph_follow_rate"}


@workload(
    "run_metrics",
    f"WITH {METRICS} SELECT * REPLACE (round(cache_hit_rate, 8) AS cache_hit_rate, "
    "round(graph_follow_rate, 8) AS graph_follow_rate) FROM metrics",
)
def run_metrics(spark, sf_dir):
    out = telemetry.run_metrics(trace_events(spark, sf_dir)).drop("provider")
    return out.select(*[F.round(c, 8).alias(c) if c in ROUNDED else c for c in out.columns])


def arms(spark, sf_dir):
    metrics = telemetry.run_metrics(trace_events(spark, sf_dir))
    label = F.when(F.col("graph"), "graph").otherwise("plain")
    return telemetry.aggregate_arms(metrics.withColumn("label", label))


_ARM_TOTALS = [f"total_{f}" for f in (*telemetry.SUMMED, "max_context_tokens", "graph_lookup_ms_total")]


@workload(
    "arm_totals",
    f"""WITH {METRICS} SELECT label, runs, resolved, round(resolve_rate, 8) AS resolve_rate,
    {', '.join(f'round({c}, 4) AS {c}, round({c} / runs, 6) AS {c.replace("total_", "mean_", 1)}' for c in _ARM_TOTALS)},
    round(total_cache_read_tokens / nullif(total_input_tokens + total_cache_read_tokens + total_cache_write_tokens, 0), 8)
      AS mean_cache_hit_rate FROM arms""",
)
def arm_totals(spark, sf_dir):
    a = arms(spark, sf_dir)
    pairs = []
    for c in _ARM_TOTALS:
        mean = c.replace("total_", "mean_", 1)
        pairs += [F.round(F.col(c).cast("double"), 4).alias(c), F.round(mean, 6).alias(mean)]
    return a.select(
        "label", "runs", "resolved", F.round("resolve_rate", 8).alias("resolve_rate"), *pairs,
        F.round("mean_cache_hit_rate", 8).alias("mean_cache_hit_rate"),
    )


_RATIO = "coalesce((c.total_{0} / c.runs) / nullif(b.total_{0} / b.runs, 0), 1)"


@workload(
    "arm_verdict",
    f"""WITH {METRICS}, d AS (SELECT ({' + '.join(_RATIO.format(m) for m in ('model_calls', 'tool_calls', 'unique_files_inspected', 'total_tokens'))}) / 4 - 1 AS x,
      c.resolve_rate - b.resolve_rate AS y, b.resolved + c.resolved AS r
      FROM arms b JOIN arms c ON b.label = 'plain' AND c.label = 'graph')
    SELECT round(x, 6) AS exploration_delta, round(y, 6) AS correctness_delta, (y >= -0.001 AND x < -0.05 AND r > 0) AS helped,
      CASE WHEN y < -0.001 THEN 'correctness' WHEN x < -0.05 AND r > 0 THEN 'exploration fell'
           WHEN x < -0.05 THEN 'exploration fell' WHEN x > 0.05 THEN 'exploration rose' ELSE 'no material' END AS outcome FROM d""",
)
def arm_verdict(spark, sf_dir):
    v = verdict(arms(spark, sf_dir), "plain", "graph")
    outcome = F.regexp_extract("reason", "^(correctness|exploration fell|exploration rose|no material)", 1)
    return v.select(
        F.round("exploration_delta", 6).alias("exploration_delta"),
        F.round("correctness_delta", 6).alias("correctness_delta"), "helped", outcome.alias("outcome"),
    )


def _mean_sql(metric):
    if metric == "resolve_rate":
        return metric
    if metric == "cache_hit_rate":
        sent = "total_input_tokens + total_cache_read_tokens + total_cache_write_tokens"
        return f"total_cache_read_tokens / nullif({sent}, 0)"
    return f"total_{metric} / runs"


_REPORT_VALUES = ", ".join(f"{{'metric': '{label}', 'x': {_mean_sql(m)}}}" for label, m, _, _ in REPORT_ROWS)


@workload(
    "arm_report",
    f"""WITH {METRICS}, v AS (SELECT label, unnest([
      {_REPORT_VALUES}
      ], recursive := true) FROM arms)
    SELECT b.metric, round(b.x, 6) AS baseline, round(c.x, 6) AS candidate, round(c.x - b.x, 6) AS delta
    FROM v b JOIN v c ON b.metric = c.metric AND b.label = 'plain' AND c.label = 'graph'
    WHERE NOT (b.x = 0 AND c.x = 0)""",
)
def arm_report(spark, sf_dir):
    rows = report_rows(arms(spark, sf_dir), "plain", "graph")
    return rows.select("metric", *[F.round(c, 6).alias(c) for c in ("baseline", "candidate", "delta")])


@workload(
    "tool_calls_by_name",
    f"WITH {TRACE} SELECT run_id, name, count(*) AS calls FROM trace WHERE type = 'tool_call' GROUP BY run_id, name",
)
def tool_calls_by_name(spark, sf_dir):
    return telemetry.count_by_name(trace_events(spark, sf_dir))


@workload(
    "edited_files",
    f"WITH {TRACE} SELECT run_id, path_name, min(seq) AS first_seq FROM trace WHERE type = 'edit' GROUP BY run_id, path_name",
)
def edited_files(spark, sf_dir):
    return telemetry.edited_files(trace_events(spark, sf_dir))


@workload(
    "lookup_percentiles",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
                count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type,
      max(value) FILTER (WHERE i = least(n - 1, CAST(floor(0.5 * n) AS BIGINT))) AS p50,
      max(value) FILTER (WHERE i = least(n - 1, CAST(floor(0.9 * n) AS BIGINT))) AS p90,
      max(value) FILTER (WHERE i = n - 1) AS p100 FROM r GROUP BY event_type""",
)
def lookup_percentiles(spark, sf_dir):
    return nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", (50, 90, 100))


@workload(
    "call_costs",
    f"""WITH {METRICS}, m AS (SELECT DISTINCT model FROM trace),
    best AS (SELECT m.model, p.*, row_number() OVER (PARTITION BY m.model ORDER BY length(p.price_key) DESC) AS n
             FROM m JOIN prices p ON starts_with(m.model, p.price_key))
    SELECT t.seq, t.model, b.price_key, b.price_key IS NOT NULL AS cost_known,
      round(coalesce((t.input_tokens * b.p_input + t.output_tokens * b.p_output + t.cache_read_tokens * b.p_cache_read
             + t.cache_write_tokens * b.p_cache_write) / 1000000, 0), 8) AS cost_usd
    FROM trace t LEFT JOIN best b ON b.model = t.model AND b.n = 1 WHERE t.type = 'model_call'""",
)
def call_costs(spark, sf_dir):
    calls = telemetry.of_type(trace_events(spark, sf_dir), "model_call").drop("cost_usd")
    priced = with_cost(calls, price_table(spark))
    return priced.select("seq", "model", "price_key", "cost_known", F.round("cost_usd", 8).alias("cost_usd"))


# -- ledger state ---------------------------------------------------------------

SURFACED = """surfaced AS (SELECT run_id, seq, turn, source, unnest(string_split(shown, ',')) AS path
  FROM trace WHERE type = 'suggestion_surfaced'),
firsts AS (SELECT run_id, path, source, turn, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, path ORDER BY seq) AS n FROM surfaced) t WHERE n = 1)"""


def surfaced_paths(events):
    return telemetry.of_type(events, "suggestion_surfaced").select(
        "run_id", "seq", "turn", "source", F.explode("paths").alias("path")
    )


@workload("first_surfaced", f"WITH {TRACE}, {SURFACED} SELECT * FROM firsts")
def first_surfaced(spark, sf_dir):
    return ledger.first_surfaced(surfaced_paths(trace_events(spark, sf_dir)))


@workload(
    "access_attribution",
    f"""WITH {TRACE}, {SURFACED}
    SELECT t.seq, t.run_id, t.path_name AS path, coalesce(f.source, 'unseen') AS attributed_source,
           f.turn AS first_surfaced_turn
    FROM trace t LEFT JOIN firsts f ON f.run_id = t.run_id AND f.path = t.path_name AND f.seq < t.seq
    WHERE t.type = 'path_access'""",
)
def access_attribution(spark, sf_dir):
    events = trace_events(spark, sf_dir)
    accesses = telemetry.of_type(events, "path_access").select("seq", "run_id", F.col("path_name").alias("path"))
    return ledger.attribute(accesses, surfaced_paths(events))


TOUCHES = """touches AS (SELECT run_id, path_name AS path, seq, CASE WHEN type = 'edit' THEN 'edit' ELSE 'read' END AS kind,
  CASE WHEN type = 'edit' THEN NULL ELSE 'h' || (k % 3) END AS hash
  FROM trace WHERE type IN ('edit', 'path_access', 'repeat_read', 'failed_read'))"""


@workload(
    "repeat_reads",
    f"""WITH {TRACE}, {TOUCHES}, p AS (SELECT *, lag(kind) OVER w AS pk, lag(hash) OVER w AS ph FROM touches
      WINDOW w AS (PARTITION BY run_id, path ORDER BY seq))
    SELECT run_id, path, seq, kind, hash, coalesce(pk = 'read', FALSE) AS seen_before,
           coalesce(pk = 'read' AND ph = hash, FALSE) AS unchanged FROM p WHERE kind = 'read'""",
)
def repeat_reads(spark, sf_dir):
    register_tables(spark, sf_dir, ["events"])
    return ledger.repeat_reads(spark.sql(f"WITH {TRACE}, {TOUCHES} SELECT * FROM touches"))


@workload(
    "unseen_facts",
    f"""WITH {TRACE}, f AS (SELECT run_id, seq AS lookup, kind AS label, unnest(string_split(shown, ',')) AS node_id
      FROM trace WHERE type = 'graph_lookup')
    SELECT *, lookup = min(lookup) OVER (PARTITION BY run_id, label, node_id) AS fresh FROM f""",
)
def unseen_facts(spark, sf_dir):
    lookups = telemetry.of_type(trace_events(spark, sf_dir), "graph_lookup")
    return ledger.unseen_facts(
        lookups.select("run_id", F.col("seq").alias("lookup"), F.col("kind").alias("label"), F.explode("surfaced").alias("node_id"))
    )


@workload(
    "search_counts",
    f"""WITH {TRACE} SELECT run_id, seq, task AS pattern, count(*) OVER (PARTITION BY run_id, task ORDER BY seq) AS times
    FROM trace WHERE type = 'tool_call' AND name IN ('grep', 'glob')""",
)
def search_counts(spark, sf_dir):
    calls = telemetry.of_type(trace_events(spark, sf_dir), "tool_call").filter(F.col("name").isin("grep", "glob"))
    return ledger.search_counts(calls.select("run_id", "seq", F.col("task").alias("pattern")))


@workload(
    "budget_stops",
    f"""WITH {TRACE}, r AS (SELECT run_id, seq, CAST(sum(input_tokens + output_tokens + cache_write_tokens)
        OVER (PARTITION BY run_id ORDER BY seq) AS BIGINT) AS spent FROM trace WHERE type = 'model_call')
    SELECT run_id, min(seq) AS stop_seq, min(spent) AS spent FROM r WHERE spent > 40000 GROUP BY run_id""",
)
def budget_stops(spark, sf_dir):
    calls = telemetry.of_type(trace_events(spark, sf_dir), "model_call").select(
        "run_id", "seq", (F.col("input_tokens") + F.col("output_tokens") + F.col("cache_write_tokens")).alias("fresh_tokens")
    )
    return ledger.budget_stops(calls, 40_000)


# -- conversations --------------------------------------------------------------


@workload(
    "token_estimates",
    """SELECT conv_id, count(*) AS messages, CAST(sum(ceil(length(text) / 4e0)) AS BIGINT) AS tokens
    FROM conversations GROUP BY conv_id""",
)
def token_estimates(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("messages"), F.sum(estimate_tokens("text")).cast("long").alias("tokens")
    )


TRIM = """m AS (SELECT conv_id AS run_id, turn AS idx, role, text AS content, CAST(ceil(length(text) / 4e0) AS BIGINT) AS tokens
  FROM conversations),
t AS (SELECT m.*, CAST(sum(tokens) OVER (PARTITION BY run_id) AS BIGINT) AS before_tokens,
  max(idx) OVER (PARTITION BY run_id) + 1 AS n FROM m),
s AS (SELECT *, (before_tokens > 400 AND idx >= 2 AND idx < n - 2 AND role = 'assistant' AND length(content) >= 400) AS el,
  '[earlier tool result trimmed to save context: ' || length(content) || ' characters. Re-run the tool if you need it again.]' AS stub FROM t),
g AS (SELECT *, CASE WHEN el THEN tokens - CAST(ceil(length(stub) / 4e0) AS BIGINT) ELSE 0 END AS saved FROM s),
c AS (SELECT *, coalesce(sum(saved) OVER (PARTITION BY run_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM g),
r AS (SELECT *, el AND before_tokens - earlier > 280 AS trimmed FROM c)"""


@workload(
    "context_trim",
    f"""WITH {TRIM} SELECT run_id, CAST(max(before_tokens) AS BIGINT) AS before_tokens,
      CAST(sum(tokens - CASE WHEN trimmed THEN saved ELSE 0 END) AS BIGINT) AS after_tokens,
      CAST(count(*) FILTER (WHERE trimmed) AS BIGINT) AS trimmed FROM r GROUP BY run_id""",
)
def context_trim(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("idx"), "role", F.col("text").alias("content")
    )
    return ledger.trim_outcome(ledger.trim_context(messages, 400, keep_recent=2, role="assistant"))


# -- the same state as a stream ---------------------------------------------------


@workload(
    "stream_attribution",
    f"""WITH {TRACE}, {SURFACED}, {TOUCHES}, p AS (SELECT *, lag(kind) OVER w AS pk, lag(hash) OVER w AS ph FROM touches
      WINDOW w AS (PARTITION BY run_id, path ORDER BY seq))
    SELECT p.run_id, p.path, p.seq, p.kind AS action, coalesce(f.source, 'unseen') AS attributed_source, f.turn AS first_surfaced_turn,
      p.kind = 'read' AND coalesce(p.pk = 'read', FALSE) AS seen_before,
      p.kind = 'read' AND coalesce(p.pk = 'read' AND p.ph = p.hash, FALSE) AS unchanged
    FROM p LEFT JOIN firsts f ON f.run_id = p.run_id AND f.path = p.path AND f.seq < p.seq""",
)
def stream_attribution(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    view = f"arriving_{uuid.uuid4().hex}"
    arriving.createOrReplaceTempView(view)
    rows = spark.sql(f"WITH {TRACE.replace('FROM events', 'FROM ' + view)} SELECT * FROM trace")
    events = rows.withColumn("paths", F.split("shown", ",")).withColumn("hash", F.concat(F.lit("h"), (F.col("k") % 3).cast("string")))
    path = stream_ledger.attribute_to_files(stream_ledger.touches_of(events), "attribution")
    return spark.read.schema(stream_ledger.OUTPUT_SCHEMA).option("recursiveFileLookup", True).parquet(path)
