"""Navigation, lookup and validation over the resolved code bases."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.constants import CONFIDENCE_RANK, KIND_PRIORITY, lookup_sql
from lodestar.operators import fuzzy, navigate, validate
from lodestar.session import register_tables
from lodestar.workloads.codebase import FACTS, RESOLVED, fact, imports_of, named, paired, unwritten
from lodestar.workloads.registry import workload

TRUST = lookup_sql("confidence", CONFIDENCE_RANK, "0")


def _prio(column):
    return "(" + lookup_sql(column, KIND_PRIORITY, "0") + ")"


RELATED = f"""{RESOLVED},
nd AS (SELECT repo, id, kind, file, name, start_line, pos, is_test FROM sym UNION ALL
  SELECT repo, id, 'file', file, regexp_replace(file, '^.*/', ''), 1, -1, is_test FROM fnode),
rel0 AS (
  SELECT e.*, src AS anchor, dst AS node, 'Calls' AS label, 0 AS f FROM edges e WHERE kind = 'calls'
  UNION ALL SELECT e.*, dst, src, 'Called by', 0 FROM edges e WHERE kind = 'calls'
  UNION ALL SELECT e.*, src, dst, 'Uses types', 0 FROM edges e WHERE kind = 'references'
  UNION ALL SELECT e.*, dst, src, 'Implementations', 0 FROM edges e WHERE kind = 'implements'
  UNION ALL SELECT e.*, dst, src, 'Related tests', 0 FROM edges e WHERE kind = 'tests'
  UNION ALL SELECT e.*, dst, src, 'Related tests', 1 FROM edges e JOIN nd n ON n.repo = e.repo AND n.id = e.src WHERE e.kind = 'calls' AND n.is_test),
rel AS (SELECT repo, anchor, label, node, kind AS via, confidence, line, {TRUST} AS trust FROM rel0
  QUALIFY row_number() OVER (PARTITION BY repo, anchor, label, node ORDER BY {TRUST} DESC, f, pass, of, op, oo, oi) = 1),
code AS (SELECT r.* FROM rel r JOIN nd n ON n.repo = r.repo AND n.id = r.node WHERE NOT (r.label = 'Called by' AND n.is_test))
"""

NEIGHBORS = f"""{RELATED},
lift0 AS (SELECT c.repo, 'file:' || a.file AS anchor, CASE c.label WHEN 'Calls' THEN 'Related code' WHEN 'Called by' THEN 'Used by' ELSE c.label END AS label,
  c.node, c.via, c.confidence, c.line, c.trust, {_prio('a.kind')} AS pr, a.start_line AS sl, a.pos AS sp
  FROM code c JOIN sym a ON a.repo = c.repo AND a.id = c.anchor AND a.kind <> 'test' JOIN nd n ON n.repo = c.repo AND n.id = c.node
  WHERE c.label IN ('Calls', 'Called by', 'Related tests') AND (n.file <> a.file OR c.label = 'Related tests')),
lift AS (SELECT * FROM lift0 QUALIFY row_number() OVER (PARTITION BY repo, anchor, label, node ORDER BY trust DESC, -pr, sl, sp) = 1),
grp AS (SELECT repo, anchor, label, node, via, confidence, line, trust FROM code WHERE anchor NOT LIKE 'file:%'
  UNION ALL SELECT repo, anchor, label, node, via, confidence, line, trust FROM lift
  UNION ALL SELECT e.repo, e.src, 'Defined here', e.dst, e.kind, e.confidence, e.line, 3 FROM edges e JOIN sym s ON s.repo = e.repo AND s.id = e.dst
    WHERE e.kind = 'contains' AND s.kind <> 'test'),
placed AS (SELECT g.*, n.file AS node_file, row_number() OVER (PARTITION BY g.repo, g.anchor, g.label ORDER BY g.trust DESC, {_prio('n.kind')} DESC,
    icu_sort_key(n.file, 'und'), n.start_line, n.pos) AS rank,
  count(*) OVER (PARTITION BY g.repo, g.anchor, g.label) AS n FROM grp g JOIN nd n ON n.repo = g.repo AND n.id = g.node WHERE g.node <> g.anchor),
shown AS (SELECT repo, anchor, label, node, via, confidence, line, CAST(rank AS INTEGER) AS rank, CAST(greatest(0, n - 8) AS BIGINT) AS truncated, node_file
  FROM placed WHERE rank <= 8)
"""

_COLUMNS = ["repo", "anchor", "label", "node", "via", "confidence", "line", "rank", "truncated"]


@workload("neighbors", f"WITH {NEIGHBORS} SELECT {', '.join(_COLUMNS)} FROM shown")
def neighbors(spark, sf_dir):
    _, graph = paired(spark, sf_dir)
    return navigate.neighbors(graph).select(*_COLUMNS)


@workload(
    "surfaced_files",
    f"""WITH {NEIGHBORS} SELECT DISTINCT s.repo, s.anchor, s.node_file AS file FROM shown s
    JOIN nd a ON a.repo = s.repo AND a.id = s.anchor WHERE a.file <> s.node_file""",
)
def surfaced_files(spark, sf_dir):
    _, graph = paired(spark, sf_dir)
    return navigate.surfaced_files(navigate.neighbors(graph), graph)


@workload("relations", f"WITH {RELATED} SELECT repo, anchor, label, node, via, confidence, line FROM rel")
def relations(spark, sf_dir):
    _, graph = paired(spark, sf_dir)
    return navigate.relations(graph).drop("tie")


FILE_REL = f"""{RELATED},
fr AS (SELECT r.repo, 'file:' || a.file AS anchor, r.label, r.node, r.via, r.confidence, r.line, r.trust, n.kind AS nk, n.file AS nf, n.start_line AS nl, n.pos AS np
  FROM rel r JOIN sym a ON a.repo = r.repo AND a.id = r.anchor JOIN nd n ON n.repo = r.repo AND n.id = r.node WHERE n.file <> a.file
  QUALIFY row_number() OVER (PARTITION BY r.repo, a.file, r.label, r.node ORDER BY r.trust DESC, a.pos) = 1),
fp AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo, anchor, label ORDER BY trust DESC, {_prio('nk')} DESC, icu_sort_key(nf, 'und'), nl, np) AS INTEGER) AS rank FROM fr)
"""


def _file_relation(name, label):
    @workload(
        f"file_{name}",
        f"WITH {FILE_REL} SELECT repo, anchor, node, via, confidence, line, rank FROM fp WHERE label = '{label}'",
    )
    def run(spark, sf_dir):
        _, graph = paired(spark, sf_dir)
        rows = navigate.relation_of_files(graph, name)
        return rows.select("repo", "anchor", "node", "via", "confidence", "line", "rank")

    return run


file_callers = _file_relation("callers", "Called by")
file_callees = _file_relation("callees", "Calls")
file_tests = _file_relation("tests", "Related tests")


# Of touched(repo, change, anchor, pos): what each change reaches.
SURFACE = f"""
cb AS (SELECT * FROM code WHERE label = 'Called by'),
direct AS (SELECT t.repo, t.change, c.node, c.via, c.confidence, c.line, c.trust FROM touched t JOIN cb c ON c.repo = t.repo AND c.anchor = t.anchor
  WHERE NOT EXISTS (SELECT 1 FROM touched x WHERE x.repo = t.repo AND x.change = t.change AND x.anchor = c.node)
  QUALIFY row_number() OVER (PARTITION BY t.repo, t.change, c.node ORDER BY c.trust DESC, t.pos) = 1),
first AS (SELECT t.repo, t.change, c.node, t.pos, c.trust AS ft FROM touched t JOIN cb c ON c.repo = t.repo AND c.anchor = t.anchor
  WHERE NOT EXISTS (SELECT 1 FROM touched x WHERE x.repo = t.repo AND x.change = t.change AND x.anchor = c.node)
  QUALIFY row_number() OVER (PARTITION BY t.repo, t.change, c.node ORDER BY t.pos, c.trust DESC) = 1),
second AS (SELECT f.repo, f.change, c.node, c.via, c.confidence, c.line, c.trust FROM first f JOIN cb c ON c.repo = f.repo AND c.anchor = f.node
  WHERE NOT EXISTS (SELECT 1 FROM touched x WHERE x.repo = f.repo AND x.change = f.change AND x.anchor = c.node)
    AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.repo = f.repo AND d.change = f.change AND d.node = c.node)
  QUALIFY row_number() OVER (PARTITION BY f.repo, f.change, c.node ORDER BY c.trust DESC, f.pos, f.ft DESC, f.node) = 1),
others AS (SELECT t.repo, t.change, r.node, r.via, r.confidence, r.line, r.trust, r.label FROM touched t JOIN rel r ON r.repo = t.repo AND r.anchor = t.anchor
  WHERE r.label IN ('Implementations', 'Related tests')
  QUALIFY row_number() OVER (PARTITION BY t.repo, t.change, r.label, r.node ORDER BY r.trust DESC, t.pos) = 1),
ig AS (SELECT *, 'Direct callers' AS label FROM direct UNION ALL SELECT *, 'Indirect callers' FROM second
  UNION ALL SELECT repo, change, node, via, confidence, line, trust, CASE label WHEN 'Related tests' THEN 'Tests covering the change' ELSE label END FROM others),
ip AS (SELECT g.*, row_number() OVER (PARTITION BY g.repo, g.change, g.label ORDER BY g.trust DESC, {_prio('n.kind')} DESC, icu_sort_key(n.file, 'und'), n.start_line, n.pos) AS rank,
  count(*) OVER (PARTITION BY g.repo, g.change, g.label) AS n FROM ig g JOIN nd n ON n.repo = g.repo AND n.id = g.node)
"""

IMPACT = f"""{RELATED},
touched AS (SELECT repo, file AS change, id AS anchor, pos FROM sym), {SURFACE}
"""


def _each_file(graph):
    return graph.files.select("repo", F.col("file").alias("change"), "file", F.lit(0).alias("ord"))


@workload(
    "impact",
    f"""WITH {IMPACT} SELECT repo, change, label, node, via, confidence, line, CAST(rank AS INTEGER) AS rank,
    CAST(greatest(0, n - 12) AS BIGINT) AS truncated FROM ip WHERE rank <= 12""",
)
def impact(spark, sf_dir):
    _, graph = paired(spark, sf_dir)
    out = navigate.impact(graph, _each_file(graph))
    return out.select("repo", "change", "label", "node", "via", "confidence", "line", "rank", "truncated")


@workload(
    "covering_test_files",
    f"""WITH {IMPACT} SELECT DISTINCT t.repo, t.change, n.file AS test_file FROM touched t
    JOIN rel r ON r.repo = t.repo AND r.anchor = t.anchor AND r.label = 'Related tests' JOIN nd n ON n.repo = r.repo AND n.id = r.node""",
)
def covering_test_files(spark, sf_dir):
    _, graph = paired(spark, sf_dir)
    return navigate.covering_test_files(graph, _each_file(graph))


@workload(
    "symbol_at",
    f"""WITH {RESOLVED} SELECT r.repo, r.file, r.line, arg_min(s.id, (s.end_line - s.start_line) * 1000000 + s.pos) AS node
    FROM (SELECT DISTINCT repo, file, line FROM refs) r JOIN sym s ON s.repo = r.repo AND s.file = r.file AND r.line BETWEEN s.start_line AND s.end_line
    GROUP BY r.repo, r.file, r.line""",
)
def symbol_at(spark, sf_dir):
    return navigate.symbol_at(named(spark, sf_dir), fact(spark, sf_dir, "refs"))


QUERIES_SQL = """SELECT DISTINCT repo, CASE pk % 7 WHEN 0 THEN file || '#' || name WHEN 1 THEN file || ':' || (start_line + 1) WHEN 2 THEN ' ' || file
  WHEN 3 THEN coalesce(receiver || '.', '') || name WHEN 4 THEN name WHEN 5 THEN 'zz' || name ELSE file || ':' || (start_line + 9) END AS query FROM defs"""


@workload(
    "resolve_anchors",
    f"""WITH {RESOLVED}, ask AS (SELECT repo, query, trim(query) AS raw FROM ({QUERIES_SQL}) t),
    s1 AS (SELECT a.repo, a.query, 1 AS st, count(DISTINCT s.id) AS n, min(s.id) AS node FROM ask a JOIN sym s ON s.repo = a.repo
      AND length(a.raw) - length(replace(a.raw, '#', '')) = 1 AND s.file = split_part(a.raw, '#', 1)
      AND (s.name = split_part(a.raw, '#', 2) OR s.qualified = split_part(a.raw, '#', 2)) GROUP BY a.repo, a.query),
    s2 AS (SELECT a.repo, a.query, f.id AS fnode, arg_min(s.id, (s.end_line - s.start_line) * 1000000 + s.pos) AS node FROM ask a
      JOIN fnode f ON f.repo = a.repo AND f.file = regexp_extract(a.raw, '^(.*):([0-9]+)$', 1)
      LEFT JOIN sym s ON s.repo = a.repo AND s.file = f.file AND CAST(regexp_extract(a.raw, '^(.*):([0-9]+)$', 2) AS INTEGER) BETWEEN s.start_line AND s.end_line
      GROUP BY a.repo, a.query, f.id),
    s3 AS (SELECT a.repo, a.query, f.id AS node FROM ask a JOIN fnode f ON f.repo = a.repo AND f.file = a.raw),
    s4 AS (SELECT a.repo, a.query, min(s.id) AS node FROM ask a JOIN sym s ON s.repo = a.repo AND s.qualified = a.raw GROUP BY 1, 2 HAVING count(*) = 1),
    s5 AS (SELECT a.repo, a.query, count(*) AS n, min(s.id) AS node, count(*) FILTER (WHERE s.kind <> 'test' AND NOT s.is_test) AS nc,
      min(s.id) FILTER (WHERE s.kind <> 'test' AND NOT s.is_test) AS cn FROM ask a JOIN sym s ON s.repo = a.repo AND
      CASE WHEN length(a.raw) - length(replace(a.raw, '.', '')) = 1 THEN s.name = split_part(a.raw, '.', 2) AND s.receiver = split_part(a.raw, '.', 1) ELSE s.name = a.raw END
      GROUP BY 1, 2),
    u AS (SELECT repo, query, 1 AS st, CASE WHEN n = 1 THEN 'symbol' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN node END AS node, n FROM s1
      UNION ALL SELECT repo, query, 2, CASE WHEN node IS NULL THEN 'file' ELSE 'symbol' END, coalesce(node, fnode), 1 FROM s2
      UNION ALL SELECT repo, query, 3, 'file', node, 1 FROM s3 UNION ALL SELECT repo, query, 4, 'symbol', node, 1 FROM s4
      UNION ALL SELECT repo, query, 5, CASE WHEN n = 1 OR nc = 1 THEN 'symbol' ELSE 'ambiguous' END, CASE WHEN n = 1 THEN node WHEN nc = 1 THEN cn END, n FROM s5)
    SELECT a.repo, a.query, coalesce(u.status, 'notfound') AS status, u.node, coalesce(u.n, 0) AS n_candidates FROM ask a
    LEFT JOIN (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY repo, query ORDER BY st) = 1) u ON u.repo = a.repo AND u.query = a.query""",
)
def resolve_anchors(spark, sf_dir):
    graph = named(spark, sf_dir)
    register_tables(spark, sf_dir, ["part", "lineitem"])
    asked = spark.sql(f"WITH {FACTS} {QUERIES_SQL}")
    return navigate.resolve_anchors(graph, asked)


TERMS_SQL = """SELECT DISTINCT repo, CASE pk % 3 WHEN 0 THEN name WHEN 1 THEN upper(name) ELSE substr(name, 1, length(name) - 2) || 'zz' END AS term FROM defs"""
GRAMS = "list_distinct([substr('  ' || lower({0}) || ' ', i, 3) for i in range(1, length({0}) + 2)])"


@workload(
    "find_symbols",
    f"""WITH {RESOLVED}, ask AS ({TERMS_SQL}),
    ex AS (SELECT a.*, s.id, s.file, s.pos FROM ask a JOIN sym s ON s.repo = a.repo AND s.name = a.term),
    ci AS (SELECT a.*, s.id FROM ask a JOIN sym s ON s.repo = a.repo AND lower(s.name) = lower(a.term)
      WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.repo = a.repo AND ex.term = a.term)),
    un AS (SELECT a.*, {GRAMS.format('term')} AS g FROM ask a WHERE NOT EXISTS (SELECT 1 FROM sym s WHERE s.repo = a.repo AND lower(s.name) = lower(a.term))),
    nm AS (SELECT DISTINCT repo, name, {GRAMS.format('name')} AS g FROM sym),
    fz AS (SELECT u.repo, u.term, n.name, 2 * len(list_intersect(u.g, n.g)) / CAST(len(u.g) + len(n.g) AS DOUBLE) AS score FROM un u JOIN nm n ON n.repo = u.repo),
    fr AS (SELECT f.repo, f.term, f.score, s.id, row_number() OVER (PARTITION BY f.repo, f.term ORDER BY round(f.score, 10) DESC, s.file, s.pos) AS i
      FROM fz f JOIN sym s ON s.repo = f.repo AND s.name = f.name WHERE f.score > 0.55)
    SELECT repo, term, 'exact' AS stage, 1e0 AS score, id AS node FROM ex UNION ALL SELECT repo, term, 'any-case', 1e0, id FROM ci
    UNION ALL SELECT repo, term, 'fuzzy', round(score, 6), id FROM fr WHERE i <= 8""",
)
def find_symbols(spark, sf_dir):
    graph = named(spark, sf_dir)
    register_tables(spark, sf_dir, ["part", "lineitem"])
    found = fuzzy.find_symbols(graph.nodes, spark.sql(f"WITH {FACTS} {TERMS_SQL}"), ["repo"])
    return found.withColumn("score", F.round("score", 6))


GUESSES_SQL = "SELECT DISTINCT repo, 'server/' || dir || '/f' || (size % 10) || '.go' AS guess FROM defs"
SEGS = "[x for x in string_split({0}, '/') if x <> '']"
STEM = "regexp_replace(regexp_replace({0}, '^.*/', ''), '\\.[^.]+$', '')"


@workload(
    "path_candidates",
    f"""WITH {RESOLVED}, g AS (SELECT repo, guess, {SEGS.format('guess')} AS gs, {STEM.format('guess')} AS st FROM ({GUESSES_SQL}) t),
    f AS (SELECT repo, file, {SEGS.format('file')} AS fs, {STEM.format('file')} AS st FROM files),
    g2 AS (SELECT *, {GRAMS.format('st')} AS gg FROM g), f2 AS (SELECT *, {GRAMS.format('st')} AS fg FROM f),
    sc AS (SELECT g.repo, g.guess, f.file,
      2 * CASE WHEN f.st = g.st THEN 1e0 ELSE 2 * len(list_intersect(f.fg, g.gg)) / CAST(len(f.fg) + len(g.gg) AS DOUBLE) END
      + CASE WHEN regexp_extract(f.file, '(\\.[^./]*)$', 1) = regexp_extract(g.guess, '(\\.[^./]*)$', 1) THEN 0.4e0 ELSE 0e0 END
      + 0.5e0 * len([x for x in f.fs if list_contains(g.gs, x)])
      + CASE WHEN len(f.fs) > 1 AND len(g.gs) > 1 AND f.fs[-2] = g.gs[-2] THEN 1.2e0 ELSE 0e0 END AS score
      FROM g2 g JOIN f2 f ON f.repo = g.repo),
    r AS (SELECT *, row_number() OVER (PARTITION BY repo, guess ORDER BY round(score, 10) DESC, file) AS rank FROM sc WHERE round(score, 10) > 0.6)
    SELECT repo, guess, file, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
)
def path_candidates(spark, sf_dir):
    files = fact(spark, sf_dir, "files")
    register_tables(spark, sf_dir, ["part", "lineitem"])
    found = fuzzy.path_candidates(files, spark.sql(f"WITH {FACTS} {GUESSES_SQL}"), ["repo"])
    return found.withColumn("score", F.round("score", 6))


def unknown_sql(name: str, refs: str = "TRUE") -> str:
    """CTE ``name``: the names that the references for which ``refs`` holds do not find."""
    return f"""
    {name}_ext AS (
      SELECT repo, file, alias AS name FROM imp WHERE import_dir IS NULL AND import_file IS NULL AND alias IS NOT NULL
      UNION SELECT repo, file, name_a FROM imp WHERE import_dir IS NULL AND import_file IS NULL AND name_a IS NOT NULL
      UNION SELECT repo, file, name_b FROM imp WHERE import_dir IS NULL AND import_file IS NULL AND name_b IS NOT NULL),
    {name}_hidden AS (SELECT repo, file, name FROM locals UNION SELECT * FROM {name}_ext),
    {name}_op AS (SELECT l.*, r.member FROM look l JOIN refs r ON r.repo = l.repo AND r.file = l.file AND r.pos = l.pos WHERE l.ek <> 'implements' AND {refs}
      AND NOT EXISTS (SELECT 1 FROM locals x WHERE x.repo = l.repo AND x.file = l.file AND x.name = l.name)
      AND NOT EXISTS (SELECT 1 FROM {name}_hidden x WHERE x.repo = l.repo AND x.file = l.file AND x.name = l.qualifier)
      AND NOT (l.qualifier IS NULL AND EXISTS (SELECT 1 FROM {name}_ext x WHERE x.repo = l.repo AND x.file = l.file AND x.name = l.name))),
    {name}_lands AS (SELECT DISTINCT e.repo, e.src, e.line, s.name FROM edges e JOIN sym s ON s.repo = e.repo AND s.id = e.dst WHERE e.line IS NOT NULL),
    {name}_d AS (SELECT o.*, EXISTS (SELECT 1 FROM imp i WHERE i.repo = o.repo AND i.file = o.file AND i.alias = o.qualifier AND (i.lang <> 'go' OR i.import_dir IS NOT NULL)) AS known,
      EXISTS (SELECT 1 FROM sym s WHERE s.repo = o.repo AND s.name = o.name) AS anywhere
      FROM {name}_op o WHERE NOT EXISTS (SELECT 1 FROM {name}_lands t WHERE t.repo = o.repo AND t.src = o.src AND t.line = o.line AND t.name = o.name)),
    {name}_j AS (SELECT *, CASE WHEN qualifier IS NOT NULL THEN CASE WHEN known THEN 'not-in-package' END WHEN NOT anywhere THEN 'not-found' END AS reason
      FROM {name}_d WHERE NOT member OR known),
    {name} AS (SELECT repo, file, name, qualifier, line, pos, reason FROM {name}_j WHERE reason IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY repo, file, name, qualifier ORDER BY pos) = 1)"""


@workload("unknown_symbols", f"WITH {RESOLVED}, {unknown_sql('unknown')} SELECT * FROM unknown")
def unknown_symbols(spark, sf_dir):
    facts, graph = unwritten(spark, sf_dir)
    return validate.unknown_symbols(facts, graph)


@workload(
    "outline_lines",
    f"""WITH {RESOLVED} SELECT s.repo, s.file, CAST(row_number() OVER (PARTITION BY s.repo, s.file ORDER BY s.start_line, s.pos) AS INTEGER) AS n,
    '  ' || lpad(s.start_line || '', 5, ' ') || '  ' || s.kind || ' ' || s.name AS text FROM sym s""",
)
def outline_lines(spark, sf_dir):
    graph = named(spark, sf_dir)
    return navigate.outline_lines(graph)


@workload(
    "outline_heads",
    f"""WITH {RESOLVED}, n AS (SELECT repo, file, count(*) AS c FROM sym GROUP BY 1, 2),
    i AS (SELECT repo, file, string_agg(spec, ', ' ORDER BY pos) FILTER (WHERE pos < 12) AS specs, count(*) AS c FROM imports GROUP BY 1, 2)
    SELECT f.repo, f.file, f.file || ' (' || f.line_count || ' lines, package ' || f.pkg || ', ' || n.c || ' symbols)' AS header,
    '  imports: ' || i.specs || CASE WHEN i.c > 12 THEN ' … +' || (i.c - 12) ELSE '' END AS imports
    FROM files f JOIN n USING (repo, file) LEFT JOIN i USING (repo, file)""",
)
def outline_heads(spark, sf_dir):
    return navigate.outline_heads(named(spark, sf_dir), imports_of(spark, sf_dir))


@workload(
    "envelopes",
    f"""WITH {RELATED}, p AS (SELECT c.repo, c.anchor, c.label, c.node, CAST(row_number() OVER (PARTITION BY c.repo, c.anchor, c.label ORDER BY c.trust DESC,
      {_prio('n.kind')} DESC, icu_sort_key(n.file, 'und'), n.start_line, n.pos) AS INTEGER) AS rank FROM code c JOIN nd n ON n.repo = c.repo AND n.id = c.node)
    SELECT * FROM p WHERE (label IN ('Calls', 'Called by') AND rank <= 12) OR (label = 'Related tests' AND rank <= 6)""",
)
def envelopes(spark, sf_dir):
    _, graph = paired(spark, sf_dir)
    return navigate.envelopes(graph).select("repo", "anchor", "label", "node", "rank")
