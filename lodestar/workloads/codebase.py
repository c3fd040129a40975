"""Fact tables of many small code bases, read off parts and order lines.

A brand is a repository and a part a definition; the part that follows another in an
order is what its definition refers to. Go and TypeScript files, tests, imports that
resolve and imports that do not, typed receivers and ambiguous names all occur.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import resolve
from lodestar.session import register_tables, settle, stage, table
from lodestar.workloads.registry import workload

# One text for both engines.
FACTS = """
p0 AS (SELECT p_brand AS repo, p_partkey AS pk, p_size AS size, p_type IN ('SMALL', 'MEDIUM', 'LARGE') AS is_go,
  lower(p_type) AS dir, CAST(floor(p_size / 5) AS INTEGER) AS fno,
  split_part(p_name, ' ', 1) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2)
    || (p_partkey % 4) AS word FROM part),
p1 AS (SELECT *, dir || '/f' || fno || CASE WHEN is_go AND fno = 0 THEN '_test.go' WHEN is_go THEN '.go'
    WHEN fno = 0 THEN '.test.ts' ELSE '.ts' END AS file, fno = 0 AS is_test,
  CASE pk % 7 WHEN 0 THEN 'type' WHEN 1 THEN 'interface' WHEN 2 THEN 'const' WHEN 3 THEN 'fn' WHEN 4 THEN 'fn' ELSE 'method' END AS k FROM p0),
p2 AS (SELECT *, CASE WHEN k = 'fn' AND is_test THEN 'test' WHEN k = 'fn' THEN 'function' ELSE k END AS kind,
  CASE WHEN k = 'type' THEN 'T' || (size % 3) WHEN k = 'interface' THEN 'I' || (size % 3)
       WHEN k = 'fn' AND is_test THEN 'Test_' || word ELSE word END AS name,
  CASE WHEN k = 'method' THEN 'T' || (size % 3) END AS receiver,
  CASE WHEN k = 'type' AND NOT is_go THEN 'I' || (pk % 3) END AS implements_name,
  CAST(row_number() OVER (PARTITION BY repo, file ORDER BY pk) - 1 AS INTEGER) AS pos FROM p1),
defs AS (SELECT *, pos * 10 + 1 AS start_line, pos * 10 + 9 AS end_line, k <> 'const' AS exported FROM p2),
files AS (SELECT repo, file, CASE WHEN is_go THEN 'go' ELSE 'typescript' END AS lang, dir AS pkg, is_test,
  CAST(max(end_line) AS INTEGER) AS line_count FROM defs GROUP BY repo, file, is_go, dir, is_test),
nexts AS (SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk,
  lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS to_pk FROM lineitem),
pairs AS (SELECT n.ok, n.ln, n.sk, a.pk, a.repo, a.file, a.is_go, a.pos AS enclosing, a.start_line, b.repo AS b_repo, b.name AS b_name,
  b.size AS b_size, b.dir AS b_dir, b.fno AS b_fno, b.is_go AS b_go, b.is_test AS b_test
  FROM nexts n JOIN defs a ON a.pk = n.pk JOIN defs b ON b.pk = n.to_pk),
refs AS (SELECT repo, file, CAST(row_number() OVER (PARTITION BY repo, file ORDER BY ok, ln, pk, sk) - 1 AS INTEGER) AS pos,
  CASE WHEN ln = 5 THEN 'T' || (b_size % 3) ELSE b_name END AS name,
  CASE ln WHEN 2 THEN 'a' || (b_size % 6) WHEN 4 THEN 'x' WHEN 6 THEN 'T' || (b_size % 3) WHEN 7 THEN 'v' || (b_size % 3) END AS qualifier,
  CASE WHEN ln = 4 THEN 'T' || (b_size % 3) END AS qualifier_type, start_line + ln AS line,
  CASE WHEN ln = 5 THEN 'reference' ELSE 'call' END AS kind, ln IN (2, 3, 4, 6, 7) AS member,
  CASE WHEN ln <> 7 THEN enclosing END AS enclosing FROM pairs),
imports AS (SELECT repo, file, CAST(row_number() OVER (PARTITION BY repo, file ORDER BY ok, ln, pk, sk) - 1 AS INTEGER) AS pos,
  CASE WHEN repo <> b_repo THEN 'ext/' || b_dir WHEN is_go THEN 'example.com/m/' || b_dir
       ELSE '../' || b_dir || '/f' || b_fno || CASE WHEN b_test THEN '.test' ELSE '' END || CASE ln % 3 WHEN 0 THEN '.js' ELSE '' END END AS spec,
  CASE WHEN is_go OR ln % 2 = 0 THEN 'a' || (b_size % 6) END AS alias,
  CASE WHEN NOT is_go THEN b_name END AS name_a,
  CASE WHEN NOT is_go AND b_name <> 'T' || (b_size % 3) THEN 'T' || (b_size % 3) END AS name_b, start_line AS line
  FROM pairs WHERE repo = b_repo OR ln = 7),
locals AS (SELECT DISTINCT repo, file, 'v' || (size % 2) AS name FROM defs)
"""

RESOLVED = f"""{FACTS},
sym AS (SELECT repo, 'sym:' || file || '#' || coalesce(receiver || '.', '') || name || ':' || kind AS id, file, dir, kind, name,
  receiver, is_test, min(pos) AS pos, max(start_line) AS start_line, max(end_line) AS end_line,
  coalesce(receiver || '.', '') || name AS qualified, arg_max(exported, pos) AS exported
  FROM defs GROUP BY ALL),
fnode AS (SELECT repo, 'file:' || file AS id, file, regexp_replace(file, '/[^/]*$', '') AS dir, is_test FROM files),
ends AS (SELECT repo, id, is_test, file FROM sym UNION ALL SELECT repo, id, is_test, file FROM fnode),
exts(o, e) AS (VALUES (0, '.ts'), (1, '.tsx'), (2, '.mts'), (3, '.cts'), (4, '.js'), (5, '.jsx'), (6, '.mjs'), (7, '.cjs')),
asked AS (SELECT DISTINCT i.repo, i.spec, regexp_replace(i.spec, '^\\.\\./', '') AS base FROM imports i JOIN files f USING (repo, file)
  WHERE f.lang <> 'go' AND i.spec LIKE '.%'),
stems AS (SELECT *, base AS stem, 0 AS s FROM asked UNION ALL
  SELECT *, regexp_replace(base, '\\.js$', ''), 1 FROM asked WHERE base LIKE '%.js'),
tries AS (SELECT repo, spec, stem || e AS target, s * 100 + o AS prio FROM stems, exts
  UNION ALL SELECT repo, spec, stem || '/index' || e, s * 100 + 10 + o FROM stems, exts
  UNION ALL SELECT repo, spec, stem, 99 FROM stems WHERE s = 1
  UNION ALL SELECT repo, spec, base, 1000 FROM asked),
ts_target AS (SELECT t.repo, t.spec, arg_min(t.target, t.prio) AS target FROM tries t
  JOIN files f ON f.repo = t.repo AND f.file = t.target GROUP BY t.repo, t.spec),
imp AS (SELECT i.*, f.lang, CASE WHEN f.lang = 'go' AND starts_with(i.spec, 'example.com/m/') THEN substr(i.spec, 15) END AS import_dir,
  CASE WHEN f.lang <> 'go' THEN t.target END AS import_file FROM imports i JOIN files f USING (repo, file)
  LEFT JOIN ts_target t ON t.repo = i.repo AND t.spec = i.spec),
b_go AS (SELECT repo, file, alias, arg_max(import_dir, pos) AS dir FROM imp WHERE import_dir IS NOT NULL AND alias IS NOT NULL GROUP BY 1, 2, 3),
b_ns AS (SELECT repo, file, alias, arg_max(import_file, pos) AS target FROM imp WHERE import_file IS NOT NULL AND alias IS NOT NULL GROUP BY 1, 2, 3),
b_named AS (SELECT repo, file, local, arg_max(import_file, pos) AS target FROM (
  SELECT repo, file, pos, import_file, name_a AS local FROM imp WHERE import_file IS NOT NULL AND name_a IS NOT NULL UNION ALL
  SELECT repo, file, pos, import_file, name_b FROM imp WHERE import_file IS NOT NULL AND name_b IS NOT NULL) t GROUP BY 1, 2, 3),
look AS (SELECT r.repo, r.file, r.pos, f.lang, regexp_replace(r.file, '/[^/]*$', '') AS dir, r.name, r.qualifier, r.qualifier_type, r.line,
  CASE WHEN r.kind = 'call' THEN 'calls' ELSE 'references' END AS ek,
  coalesce('sym:' || d.file || '#' || coalesce(d.receiver || '.', '') || d.name || ':' || d.kind, 'file:' || r.file) AS src
  FROM refs r JOIN files f USING (repo, file) LEFT JOIN defs d ON d.repo = r.repo AND d.file = r.file AND d.pos = r.enclosing
  UNION ALL SELECT d.repo, d.file, d.pos, CASE WHEN d.is_go THEN 'go' ELSE 'typescript' END, d.dir, d.implements_name, NULL, NULL, d.start_line, 'implements',
  'sym:' || d.file || '#' || coalesce(d.receiver || '.', '') || d.name || ':' || d.kind FROM defs d WHERE d.implements_name IS NOT NULL),
q AS (SELECT DISTINCT repo, file, lang, dir, name, qualifier, qualifier_type FROM look),
own0 AS (SELECT q.repo, q.file, q.qualifier_type AS t, s.file AS ofile, s.name AS oname, 0 AS g, 0 AS tier, s.pos FROM q
    JOIN sym s ON s.repo = q.repo AND s.file = q.file AND s.name = q.qualifier_type
  UNION SELECT q.repo, q.file, q.qualifier_type, s.file, s.name, 0, 1, s.pos FROM q
    JOIN sym s ON s.repo = q.repo AND s.dir = q.dir AND s.name = q.qualifier_type WHERE q.lang = 'go'
  UNION SELECT q.repo, q.file, q.qualifier_type, s.file, s.name, 1, 0, s.pos FROM q
    JOIN b_named b ON b.repo = q.repo AND b.file = q.file AND b.local = q.qualifier_type
    JOIN sym s ON s.repo = q.repo AND s.file = b.target AND s.name = b.local
  UNION SELECT q.repo, q.file, q.qualifier_type, u.file, u.name, 2, 0, u.pos FROM q
    JOIN (SELECT repo, name, min(file) AS file, min(pos) AS pos FROM sym WHERE kind IN ('type', 'interface') GROUP BY 1, 2 HAVING count(*) = 1) u
    ON u.repo = q.repo AND u.name = q.qualifier_type),
own AS (SELECT * FROM own0 QUALIFY g = min(g) OVER (PARTITION BY repo, file, t)),
r2 AS (SELECT q.*, 2 AS stage, m.id AS dst, m.file AS cf, m.pos AS cp, o.tier, o.ofile, o.pos AS opos FROM q
  JOIN own o ON o.repo = q.repo AND o.file = q.file AND o.t = q.qualifier_type
  JOIN sym m ON m.repo = q.repo AND m.kind = 'method' AND m.name = q.name AND m.receiver = o.oname AND m.file = o.ofile),
r2b AS (SELECT DISTINCT repo, file, lang, dir, name, qualifier, qualifier_type, stage, dst, cf, cp FROM (
  SELECT *, dense_rank() OVER (PARTITION BY repo, file, name, qualifier, qualifier_type ORDER BY tier, ofile, opos) AS n FROM r2) t WHERE n = 1),
hits AS (SELECT * FROM r2b
  UNION ALL SELECT q.*, 3, s.id, s.file, s.pos FROM q JOIN b_go b ON b.repo = q.repo AND b.file = q.file AND b.alias = q.qualifier
    LEFT JOIN sym s ON s.repo = q.repo AND s.dir = b.dir AND s.name = q.name WHERE q.lang = 'go'
  UNION ALL SELECT q.*, 4, s.id, s.file, s.pos FROM q JOIN b_ns b ON b.repo = q.repo AND b.file = q.file AND b.alias = q.qualifier
    LEFT JOIN sym s ON s.repo = q.repo AND s.file = b.target AND s.name = q.name WHERE q.lang <> 'go'
  UNION ALL SELECT q.*, 5, s.id, s.file, s.pos FROM q JOIN b_named b ON b.repo = q.repo AND b.file = q.file AND b.local = q.qualifier
    JOIN sym s ON s.repo = q.repo AND s.kind = 'method' AND s.receiver = b.local AND s.name = q.name
    WHERE q.lang <> 'go' AND EXISTS (SELECT 1 FROM sym o WHERE o.repo = q.repo AND o.file = b.target AND o.name = b.local)
  UNION ALL SELECT q.*, 6, s.id, s.file, s.pos FROM q JOIN sym s ON s.repo = q.repo AND s.kind = 'method' AND s.name = q.name WHERE q.qualifier IS NOT NULL
  UNION ALL SELECT q.*, 7, s.id, s.file, s.pos FROM q JOIN sym s ON s.repo = q.repo AND s.file = q.file AND s.name = q.name WHERE q.qualifier IS NULL
  UNION ALL SELECT q.*, 8, s.id, s.file, s.pos FROM q JOIN b_named b ON b.repo = q.repo AND b.file = q.file AND b.local = q.name
    JOIN sym s ON s.repo = q.repo AND s.file = b.target AND s.name = b.local WHERE q.qualifier IS NULL AND q.lang <> 'go'
  UNION ALL SELECT q.*, 9, s.id, s.file, s.pos FROM q JOIN sym s ON s.repo = q.repo AND s.dir = q.dir AND s.name = q.name WHERE q.qualifier IS NULL AND q.lang = 'go'
  UNION ALL SELECT q.*, 10, s.id, s.file, s.pos FROM q JOIN sym s ON s.repo = q.repo AND s.name = q.name WHERE q.qualifier IS NULL),
best AS (SELECT * FROM hits QUALIFY stage = min(stage) OVER (PARTITION BY repo, file, name, qualifier, qualifier_type)),
ans AS (SELECT *, CASE WHEN stage IN (6, 10) THEN CASE WHEN count(*) OVER w = 1 THEN 'likely' ELSE 'heuristic' END ELSE 'exact' END AS confidence,
  count(*) OVER w AS n, row_number() OVER (PARTITION BY repo, file, name, qualifier, qualifier_type ORDER BY cf, cp) AS i
  FROM best WHERE dst IS NOT NULL WINDOW w AS (PARTITION BY repo, file, name, qualifier, qualifier_type)),
res AS (SELECT l.repo, l.file, l.pos, l.line, l.ek, l.src, a.dst, a.confidence, a.n, a.i FROM look l LEFT JOIN ans a ON a.repo = l.repo AND a.file = l.file
  AND a.name = l.name AND a.qualifier IS NOT DISTINCT FROM l.qualifier AND a.qualifier_type IS NOT DISTINCT FROM l.qualifier_type),
unres AS (SELECT DISTINCT repo, file, pos FROM res WHERE ek <> 'implements' AND (dst IS NULL OR (confidence = 'heuristic' AND n > 3))),
owner AS (SELECT d.repo, d.file, d.pos, 'sym:' || d.file || '#' || coalesce(d.receiver || '.', '') || d.name || ':' || d.kind AS src, d.start_line,
  coalesce((SELECT arg_min(s.id, s.pos) FROM sym s WHERE s.repo = d.repo AND s.file = d.file AND s.name = d.receiver),
           (SELECT arg_min(s.id, s.file || '#' || lpad(s.pos || '', 9, '0')) FROM sym s WHERE s.repo = d.repo AND s.dir = d.dir AND s.name = d.receiver)) AS dst
  FROM defs d WHERE d.kind = 'method'),
aff AS (SELECT d.repo, d.file, d.pos, d.dir, d.start_line, 'sym:' || d.file || '#' || d.name || ':' || d.kind AS src,
  split_part(regexp_replace(d.name, '^(Test|Benchmark|Fuzz|Example)_?', ''), '_', 1) AS stem FROM defs d WHERE d.kind = 'test' AND d.is_test),
aff_l AS (SELECT a.*, s.id AS dst, s.file AS cf, s.pos AS cp FROM aff a JOIN sym s ON s.repo = a.repo AND s.dir = a.dir AND s.name = a.stem AND NOT s.is_test),
aff_g AS (SELECT a.*, s.id AS dst, s.file AS cf, s.pos AS cp FROM aff a JOIN sym s ON s.repo = a.repo AND s.name = a.stem AND NOT s.is_test
  WHERE NOT EXISTS (SELECT 1 FROM aff_l l WHERE l.repo = a.repo AND l.file = a.file AND l.pos = a.pos)),
aff_n AS (SELECT *, count(*) OVER (PARTITION BY repo, file, pos) AS n FROM (SELECT * FROM aff_l UNION ALL SELECT * FROM aff_g) t),
e0 AS (
  SELECT repo, 'file:' || file AS src, 'sym:' || file || '#' || coalesce(receiver || '.', '') || name || ':' || kind AS dst, 'contains' AS kind, 'exact' AS confidence,
    CAST(NULL AS INTEGER) AS line, file AS of, 0 AS op, pos AS oo, 0 AS oi FROM defs
  UNION ALL SELECT i.repo, 'file:' || i.file, f.id, 'imports', 'exact', i.line, i.file, 1, i.pos, 0 FROM imp i JOIN fnode f ON f.repo = i.repo AND f.dir = i.import_dir AND f.file <> i.file
  UNION ALL SELECT repo, 'file:' || file, 'file:' || import_file, 'imports', 'exact', line, file, 1, pos, 0 FROM imp WHERE import_file IS NOT NULL
  UNION ALL SELECT repo, src, dst, ek, confidence, line, file, CASE WHEN ek = 'implements' THEN 4 ELSE 2 END, pos, i FROM res
    WHERE dst IS NOT NULL AND CASE WHEN ek = 'implements' THEN i <= 3 ELSE NOT (confidence = 'heuristic' AND n > 3) END
  UNION ALL SELECT repo, src, dst, 'references', 'exact', start_line, file, 3, pos, 0 FROM owner WHERE dst IS NOT NULL
  UNION ALL SELECT repo, src, dst, 'tests', CASE WHEN n = 1 THEN 'exact' ELSE 'heuristic' END, start_line, file, 5, pos, 0 FROM aff_n WHERE n <= 3),
e1 AS (SELECT e.*, x.is_test AS st, y.is_test AS dt FROM e0 e JOIN ends x ON x.repo = e.repo AND x.id = e.src JOIN ends y ON y.repo = e.repo AND y.id = e.dst WHERE e.src <> e.dst),
e2 AS (SELECT repo, src, dst, kind, confidence, line, 0 AS pass, of, op, oo, oi FROM e1
  UNION ALL SELECT repo, src, dst, 'tests', confidence, line, 1, of, op, oo, oi FROM e1 WHERE kind = 'calls' AND st AND NOT dt),
edges AS (SELECT repo, kind || '|' || src || '|' || dst || '|' || coalesce(line, 0) AS id, src, dst, kind, confidence, line, pass, of, op, oo, oi FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, src, dst, kind, line ORDER BY pass, of, op, oo, oi) AS rn FROM e2) t WHERE rn = 1)
"""


def fact(spark, sf_dir, name):
    """One fact table of the tables' present files, written once."""
    sources = ["part", "lineitem"] if name in ("refs", "imports") else ["part"]

    def build():
        register_tables(spark, sf_dir, ["part", "lineitem"])
        return settle(spark.sql(f"WITH {FACTS} SELECT * FROM {name}"), name)

    return stage(f"fact-{name}", [table(spark, sf_dir, t) for t in sources], build)


# References and imports in one pass over the pairs of a file; the columns are those of FACTS.
USES = """
SELECT repo, file, CAST(row_number() OVER (PARTITION BY repo, file ORDER BY ok, ln, pk, sk) - 1 AS INTEGER) AS pos,
  name, qualifier, qualifier_type, start_line + ln AS line, kind, member, enclosing, start_line, imports,
  CAST(count_if(imports) OVER (PARTITION BY repo, file ORDER BY ok, ln, pk, sk ROWS UNBOUNDED PRECEDING) - 1 AS INTEGER) AS import_pos,
  spec, alias, name_a, name_b FROM (
SELECT repo, file, ok, ln, pk, sk, start_line,
  CASE WHEN ln = 5 THEN 'T' || (b_size % 3) ELSE b_name END AS name,
  CASE ln WHEN 2 THEN 'a' || (b_size % 6) WHEN 4 THEN 'x' WHEN 6 THEN 'T' || (b_size % 3) WHEN 7 THEN 'v' || (b_size % 3) END AS qualifier,
  CASE WHEN ln = 4 THEN 'T' || (b_size % 3) END AS qualifier_type,
  CASE WHEN ln = 5 THEN 'reference' ELSE 'call' END AS kind, ln IN (2, 3, 4, 6, 7) AS member,
  CASE WHEN ln <> 7 THEN enclosing END AS enclosing, imports,
  CASE WHEN NOT imports THEN NULL WHEN repo <> b_repo THEN 'ext/' || b_dir WHEN is_go THEN 'example.com/m/' || b_dir
       ELSE '../' || b_dir || '/f' || b_fno || CASE WHEN b_test THEN '.test' ELSE '' END || CASE ln % 3 WHEN 0 THEN '.js' ELSE '' END END AS spec,
  CASE WHEN imports AND (is_go OR ln % 2 = 0) THEN 'a' || (b_size % 6) END AS alias,
  CASE WHEN imports AND NOT is_go THEN b_name END AS name_a,
  CASE WHEN imports AND NOT is_go AND b_name <> 'T' || (b_size % 3) THEN 'T' || (b_size % 3) END AS name_b
  FROM (SELECT *, (repo = b_repo OR ln = 7) IS TRUE AS imports FROM pairs))
"""


def uses(spark, sf_dir):
    """The facts ``refs`` and ``imports``, for questions that need both."""

    def build():
        register_tables(spark, sf_dir, ["part", "lineitem"])
        rows = settle(spark.sql(f"WITH {FACTS} {USES}"), "uses")
        refs = rows.select("repo", "file", "pos", "name", "qualifier", "qualifier_type", "line", "kind", "member", "enclosing")
        imports = rows.filter("imports").select(
            "repo", "file", F.col("import_pos").alias("pos"), "spec", "alias", "name_a", "name_b", F.col("start_line").alias("line")
        )
        return refs, imports

    return stage("fact-uses", [table(spark, sf_dir, t) for t in ("part", "lineitem")], build)


def defs_of(spark, sf_dir):
    return fact(spark, sf_dir, "defs").select(
        "repo", "file", "pos", "name", "kind", "start_line", "end_line", "exported", "receiver",
        F.concat(F.col("kind"), F.lit(" "), F.col("name")).alias("signature"),
        F.array_compact(F.array("implements_name")).alias("implements_names"),
    )


def imports_of(spark, sf_dir):
    return with_names(fact(spark, sf_dir, "imports"))


def with_names(imports):
    entry = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("k"), F.col(c).alias("v")))
    return imports.select(
        "repo", "file", "pos", "spec", "alias", "line",
        F.map_from_entries(F.array_compact(F.array(entry("name_a"), entry("name_b")))).alias("names"),
    )


def facts_of(spark, sf_dir) -> resolve.Facts:
    files = fact(spark, sf_dir, "files")
    modules = files.select("repo").distinct().withColumn("go_module", F.lit("example.com/m"))
    refs, imports = uses(spark, sf_dir)
    local = fact(spark, sf_dir, "locals")
    return resolve.Facts(files, defs_of(spark, sf_dir), refs, with_names(imports), local, modules, None, ("repo",))


def named(spark, sf_dir) -> resolve.Graph:
    """Files and symbols alone, for questions that follow no edge."""
    files = fact(spark, sf_dir, "files")

    def build():
        known = resolve.Facts(files, defs_of(spark, sf_dir), None, None, keys=("repo",))
        return resolve.Graph(settle(resolve.build_nodes(known), "nodes"), None, files, None, ("repo",))

    return stage("nodes", [table(spark, sf_dir, "part")], build)


def paired(spark, sf_dir):
    """Facts and graph with the strongest edge of each pair and kind, for questions that read no lines."""

    def build():
        facts = facts_of(spark, sf_dir)
        g = resolve.resolve(facts, nodes=named(spark, sf_dir).nodes, per_line=False)
        return facts, resolve.Graph(g.nodes, settle(g.edges, "pairs"), g.files, None, g.keys, g.per_pair)

    return stage("pairs", [table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")], build)


def indexed(spark, sf_dir):
    """Facts and graph of the tables' present files, resolved once and then queried."""

    def build():
        facts = facts_of(spark, sf_dir)
        g = resolve.resolve(facts, nodes=named(spark, sf_dir).nodes)
        return facts, resolve.Graph(g.nodes, settle(g.edges, "edges"), g.files, settle(g.unresolved, "unresolved"), g.keys)

    return stage("graph", [table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")], build)


def unwritten(spark, sf_dir):
    """Facts and graph whose edges are not written, for a question that reads them once."""
    facts = facts_of(spark, sf_dir)
    return facts, resolve.resolve(facts, nodes=named(spark, sf_dir).nodes)


@workload("graph_nodes", f"WITH {RESOLVED} SELECT repo, id, kind, name, qualified, file, start_line, end_line, receiver, exported FROM sym "
          "UNION ALL SELECT n.repo, n.id, 'file', regexp_replace(n.file, '^.*/', ''), n.file, n.file, 1, f.line_count, NULL, TRUE "
          "FROM fnode n JOIN files f ON f.repo = n.repo AND f.file = n.file")
def graph_nodes(spark, sf_dir):
    return named(spark, sf_dir).nodes.select("repo", "id", "kind", "name", "qualified", "file", "start_line", "end_line", "receiver", "exported")


@workload("graph_edges", f"WITH {RESOLVED} SELECT repo, id, src, dst, kind, confidence, line FROM edges")
def graph_edges(spark, sf_dir):
    _, graph = indexed(spark, sf_dir)
    return graph.edges.drop("ord", "in_test")


@workload("unresolved_refs", f"WITH {RESOLVED} SELECT * FROM unres")
def unresolved_refs(spark, sf_dir):
    _, graph = indexed(spark, sf_dir)
    return graph.unresolved


@workload("import_targets", f"WITH {RESOLVED} SELECT repo, file, pos, spec, import_dir, import_file FROM imp")
def import_targets(spark, sf_dir):
    return resolve.resolve_imports(facts_of(spark, sf_dir)).select("repo", "file", "pos", "spec", "import_dir", "import_file")


@workload(
    "graph_stats",
    f"""WITH {RESOLVED}, e AS (SELECT repo, count(*) AS edges, count(*) FILTER (WHERE confidence = 'heuristic') AS heuristic_edges FROM edges GROUP BY repo),
    s AS (SELECT repo, count(*) AS symbols FROM sym GROUP BY repo), f AS (SELECT repo, count(*) AS files FROM files GROUP BY repo),
    u AS (SELECT repo, count(*) AS unresolved_refs FROM unres GROUP BY repo)
    SELECT f.repo, f.files, s.symbols, e.edges, e.heuristic_edges, coalesce(u.unresolved_refs, 0) AS unresolved_refs
    FROM f JOIN s USING (repo) JOIN e USING (repo) LEFT JOIN u USING (repo)""",
)
def graph_stats(spark, sf_dir):
    _, graph = unwritten(spark, sf_dir)
    return resolve.graph_stats(graph)
