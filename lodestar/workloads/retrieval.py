"""Related-file ranking and its evaluation.

A customer is a repository, an order a commit, a part's type, size class and name a file
path. The newest order of a customer is the change to predict; the orders before it are
the history, and lines that follow each other in an older order are structural edges.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.constants import CONFIDENCE_FACTOR, PROPAGATION, STRATEGIES, lookup_sql
from lodestar.operators import cochange, evaluate, filegraph, fusion, locality, traverse, walk
from lodestar.operators.ranking import locale_order
from lodestar.session import partitions_for, settle, settle_by, table
from lodestar.workloads.registry import workload

FILE = (
    "lower(p_type) || CASE WHEN p_size >= 26 THEN '/sub/' ELSE '/' END || split_part(p_name, ' ', 2) "
    "|| CASE WHEN p_size % 10 = 0 THEN '.md' ELSE '.go' END"
)

LINES = f"""
newest AS (SELECT o_custkey AS repo, max(o_orderdate) AS day FROM orders GROUP BY o_custkey),
last_commit AS (SELECT o.o_custkey AS repo, max(o.o_orderkey) AS commit_id FROM orders o
                JOIN newest n ON n.repo = o.o_custkey AND n.day = o.o_orderdate GROUP BY o.o_custkey),
lines AS (SELECT o.o_custkey AS repo, o.o_orderkey AS commit_id, l.l_linenumber AS ln, l.l_partkey AS pk,
                 l.l_suppkey AS sk, l.l_returnflag AS rf, l.l_linestatus AS ls, {FILE} AS file,
                 o.o_orderkey = c.commit_id AS is_gold
          FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey
          JOIN last_commit c ON c.repo = o.o_custkey),"""

# One text for both engines: what the lines of the repositories say.
OF_LINES = """
gold AS (SELECT DISTINCT repo, file FROM lines WHERE is_gold),
history AS (SELECT DISTINCT repo, commit_id, file FROM lines WHERE NOT is_gold),
files AS (SELECT repo, file, CASE WHEN file LIKE '%.go' THEN 'go' END AS lang, regexp_replace(file, '^(.*/)?([^/]+)/[^/]+$', '{pkg}') AS pkg
          FROM (SELECT DISTINCT repo, file FROM lines WHERE NOT is_gold) t),
steps AS (SELECT repo, file AS src_file,
                 lead(file) OVER (PARTITION BY commit_id ORDER BY ln, pk, sk) AS dst_file,
                 CASE rf || ls WHEN 'AF' THEN 'implements' WHEN 'AO' THEN 'tests' WHEN 'NF' THEN 'contains'
                      WHEN 'NO' THEN 'imports' WHEN 'RF' THEN 'calls' ELSE 'references' END AS kind,
                 CASE ln % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'likely' ELSE 'heuristic' END AS confidence
          FROM lines WHERE NOT is_gold),
edges AS (SELECT * FROM steps WHERE dst_file IS NOT NULL)
"""

# the lines are dealt by repository, and a commit lies in one
SPARK_OF_LINES = OF_LINES.replace("{pkg}", "$2").replace("PARTITION BY commit_id", "PARTITION BY repo, commit_id")
DUCK_REPOS = LINES + OF_LINES.replace("{pkg}", "\\2")

W = f"({lookup_sql('kind', PROPAGATION)}) * ({lookup_sql('confidence', CONFIDENCE_FACTOR)})"

FILE_GRAPH = f"""{DUCK_REPOS},
fe AS (SELECT repo, src_file AS src, dst_file AS dst, max({W}) AS w FROM edges WHERE src_file <> dst_file
       GROUP BY repo, src_file, dst_file),
deg AS (SELECT repo, file, count(*) AS degree FROM (SELECT repo, src AS file FROM fe UNION ALL SELECT repo, dst FROM fe) t
        GROUP BY repo, file),
both_ways AS (SELECT repo, src, dst, max(w) AS w FROM (SELECT repo, src, dst, w FROM fe UNION ALL SELECT repo, dst, src, w FROM fe) t
         GROUP BY repo, src, dst),
ix AS (SELECT g.repo, g.file FROM gold g JOIN files f ON f.repo = g.repo AND f.file = g.file),
inst AS (SELECT repo, count(*) AS n FROM ix GROUP BY repo HAVING count(*) >= 2),
anchors AS (SELECT ix.repo, ix.file AS anchor, inst.n - 1 AS n_targets FROM ix JOIN inst USING (repo))
"""


def _walk_sql(name, source):
    return f"""
{name}_d AS (SELECT s.repo, s.src, s.dst, s.w / ln(2 + deg.degree) AS d FROM {source} s
             JOIN deg ON deg.repo = s.repo AND deg.file = s.dst),
{name}_p AS (SELECT repo, src, dst, d / sum(d) OVER (PARTITION BY repo, src) AS p FROM {name}_d),
{name}_walk(repo, anchor, file, m, k) AS (
  SELECT repo, anchor, anchor, 1e0, 0 FROM anchors
  UNION ALL
  SELECT w.repo, w.anchor, p.dst, sum(0.85e0 * w.m * p.p), w.k + 1 FROM {name}_walk w
  JOIN {name}_p p ON p.repo = w.repo AND p.src = w.file
  WHERE w.k < 12 AND w.m >= 1e-6 GROUP BY w.repo, w.anchor, p.dst, w.k),
{name}_score AS (SELECT repo, anchor, file, sum(m) AS score FROM {name}_walk WHERE k > 0 AND file <> anchor
                 GROUP BY repo, anchor, file)"""


BACK = "back AS (SELECT repo, dst AS src, src AS dst, w FROM fe)"
PPR = _walk_sql("ppr", "both_ways")
DEP = _walk_sql("dep", "back")
REACH = """
hops(repo, anchor, file, hop) AS (
  SELECT repo, anchor, anchor, 0 FROM anchors
  UNION
  SELECT h.repo, h.anchor, b.dst, h.hop + 1 FROM hops h JOIN both_ways b ON b.repo = h.repo AND b.src = h.file WHERE h.hop < 5),
near AS (SELECT repo, anchor, file, min(hop) AS hop FROM hops GROUP BY repo, anchor, file),
reach AS (SELECT n.repo, n.anchor, n.file, n.hop, max(b.w) AS weight FROM near n
          JOIN near f ON f.repo = n.repo AND f.anchor = n.anchor AND f.hop = n.hop - 1
          JOIN both_ways b ON b.repo = n.repo AND b.src = f.file AND b.dst = n.file
          WHERE n.file <> n.anchor GROUP BY n.repo, n.anchor, n.file, n.hop)"""
KEY = "icu_sort_key({}, 'und')"


def _ranked(source, order, limit="20"):
    return (
        f"SELECT repo, anchor, file, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo, anchor ORDER BY {order}) AS rank "
        f"FROM {source}) t WHERE rank <= {limit}"
    )


BY_SCORE = f"round(score, 10) DESC, {KEY.format('file')}, file"
DIR = "CASE WHEN {0} LIKE '%/%' THEN regexp_replace({0}, '/[^/]*$', '') ELSE '.' END"
COCHANGE = """
sizes AS (SELECT repo, commit_id, 1 / ln(1 + count(*)) AS w FROM history GROUP BY repo, commit_id HAVING count(*) >= 2),
used AS (SELECT h.repo, h.commit_id, h.file, s.w FROM history h JOIN sizes s USING (repo, commit_id)),
own AS (SELECT repo, file, sum(w) AS own FROM used GROUP BY repo, file),
total AS (SELECT repo, sum(w) AS total FROM sizes GROUP BY repo),
pairs AS (SELECT a.repo, a.file AS anchor, b.file, sum(a.w) AS together FROM used a
          JOIN used b ON a.repo = b.repo AND a.commit_id = b.commit_id AND a.file <> b.file GROUP BY a.repo, a.file, b.file),
co AS (SELECT p.repo, p.anchor, p.file, p.together * t.total / (x.own * y.own) * ln(1 + p.together) AS score
       FROM pairs p JOIN total t USING (repo) JOIN own x ON x.repo = p.repo AND x.file = p.anchor
       JOIN own y ON y.repo = p.repo AND y.file = p.file JOIN anchors z ON z.repo = p.repo AND z.anchor = p.anchor)"""
LOCAL = f"""
located AS (SELECT repo, file, {DIR.format('file')} AS dir, CASE WHEN lang = 'go' THEN {DIR.format('file')} || '::' || pkg
            ELSE {DIR.format('file')} END AS package FROM files),
dirscore AS (SELECT repo, anchor, file, score FROM (
  SELECT a.repo, a.anchor, f.file, CASE WHEN f.dir = h.dir THEN 3
     WHEN starts_with(f.dir, h.dir || '/') OR starts_with(h.dir, f.dir || '/') THEN 2
     WHEN ({DIR.format('f.dir')}) = ({DIR.format('h.dir')}) THEN 1 ELSE 0 END AS score
  FROM anchors a JOIN located h ON h.repo = a.repo AND h.file = a.anchor
  JOIN located f ON f.repo = a.repo AND f.file <> a.anchor) t WHERE score > 0),
psize AS (SELECT repo, package, count(*) AS n FROM located GROUP BY repo, package),
mates AS (SELECT a.repo, a.anchor, f.file FROM anchors a JOIN located h ON h.repo = a.repo AND h.file = a.anchor
  JOIN psize s ON s.repo = h.repo AND s.package = h.package
  JOIN located f ON f.repo = h.repo AND f.package = h.package AND f.file <> a.anchor)"""

ALL = f"""RECURSIVE_MARK {FILE_GRAPH}, {BACK}, {PPR}, {DEP}, {REACH}, {COCHANGE}, {LOCAL},
r_graph AS ({_ranked('ppr_score', BY_SCORE)}), r_dep AS ({_ranked('dep_score', BY_SCORE)}),
r_bfs AS ({_ranked('(SELECT * FROM reach WHERE hop <= 3) q', f"hop, weight DESC, {KEY.format('file')}, file")}),
r_co AS ({_ranked('co', BY_SCORE)}), r_pkg AS ({_ranked('mates', 'file')}),
r_dir AS ({_ranked('dirscore', f"score DESC, {KEY.format('file')}, file")}),
base AS (SELECT 'graph' AS strategy, * FROM r_graph UNION ALL SELECT 'dependents', * FROM r_dep
  UNION ALL SELECT 'graph-bfs', * FROM r_bfs UNION ALL SELECT 'cochange', * FROM r_co
  UNION ALL SELECT 'packages', * FROM r_pkg UNION ALL SELECT 'directory', * FROM r_dir),
member(fused, part) AS (VALUES ('combined', 'graph'), ('combined', 'packages'), ('combined', 'cochange'), ('combined', 'directory'),
  ('lean', 'graph'), ('lean', 'cochange'), ('no-graph', 'packages'), ('no-graph', 'cochange'), ('no-graph', 'directory'),
  ('no-directory', 'graph'), ('no-directory', 'packages'), ('no-directory', 'cochange'),
  ('no-cochange', 'graph'), ('no-cochange', 'packages'), ('no-cochange', 'directory'),
  ('no-packages', 'graph'), ('no-packages', 'cochange'), ('no-packages', 'directory')),
votes AS (SELECT m.fused AS strategy, b.repo, b.anchor, b.file, sum(1e0 / (60 + b.rank)) AS score
          FROM base b JOIN member m ON m.part = b.strategy GROUP BY 1, 2, 3, 4),
fused AS (SELECT strategy, repo, anchor, file, rank FROM (SELECT *, row_number() OVER (
            PARTITION BY strategy, repo, anchor ORDER BY {BY_SCORE}) AS rank FROM votes) t WHERE rank <= 20),
ranked AS (SELECT strategy, repo, anchor, file, rank FROM base UNION ALL SELECT * FROM fused),
per_anchor AS (SELECT r.strategy, r.repo, r.anchor, max(a.n_targets) AS t,
  count(*) FILTER (WHERE ix.file IS NOT NULL AND rank <= a.n_targets) AS g,
  {', '.join(f"count(*) FILTER (WHERE ix.file IS NOT NULL AND rank <= {k}) AS h{k}, count(*) FILTER (WHERE rank <= {k}) AS s{k}" for k in (5, 10, 20))}
  FROM ranked r JOIN anchors a ON a.repo = r.repo AND a.anchor = r.anchor
  LEFT JOIN ix ON ix.repo = r.repo AND ix.file = r.file GROUP BY 1, 2, 3),
strategies(strategy) AS (VALUES {', '.join(f"('{s}')" for s in STRATEGIES)}),
scores AS (SELECT i.repo, s.strategy, coalesce(sum(g / CAST(t AS DOUBLE)), 0) / max(i.n) AS recall_at_g,
  {', '.join(f"coalesce(sum(h{k} / CAST(t AS DOUBLE)), 0) / max(i.n) AS recall_{k}, coalesce(sum(CASE WHEN s{k} = 0 THEN 0e0 ELSE h{k} / CAST(s{k} AS DOUBLE) END), 0) / max(i.n) AS precision_{k}" for k in (5, 10, 20))}
  FROM inst i CROSS JOIN strategies s LEFT JOIN per_anchor p ON p.repo = i.repo AND p.strategy = s.strategy GROUP BY i.repo, s.strategy),
summary AS (SELECT a.strategy, count(*) AS instances, avg(a.recall_at_g) AS recall_at_g,
  {', '.join(f"avg(a.recall_{k}) AS recall_{k}, avg(a.precision_{k}) AS precision_{k}" for k in (5, 10, 20))},
  CAST(count(*) FILTER (WHERE round(a.recall_at_g, 10) > round(b.recall_at_g, 10)) AS BIGINT) AS wins,
  CAST(count(*) FILTER (WHERE round(a.recall_at_g, 10) < round(b.recall_at_g, 10)) AS BIGINT) AS losses
  FROM scores a JOIN scores b ON b.repo = a.repo AND b.strategy = 'directory' GROUP BY a.strategy)
""".replace("RECURSIVE_MARK", "WITH RECURSIVE")

GRAPH = f"WITH RECURSIVE {FILE_GRAPH}"


def repository_lines(spark, sf_dir):
    """Order lines as changed files, dealt by repository once, and the number of buckets.

    A customer has few orders, so a repository is small; how many there are in a task
    does not grow with the input.
    """
    orders, lineitem, part = (table(spark, sf_dir, name) for name in ("orders", "lineitem", "part"))
    parts = partitions_for(lineitem)
    commits = orders.select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("day"))
    newest = commits.filter(F.col("day").isNotNull()).groupBy("repo").agg(F.max(F.struct("day", "commit_id")).alias("last"))
    marked = commits.join(newest, "repo").select("repo", "commit_id", (F.col("commit_id") == F.col("last.commit_id")).alias("is_gold"))
    lines = lineitem.select(
        F.col("l_orderkey").alias("commit_id"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
        F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"),
    )
    files = part.select(F.col("p_partkey").alias("pk"), F.expr(FILE).alias("file"))
    # dealt by as many parts as the result, so that a task does not grow with the input here either
    placed = lines.repartition(parts, "commit_id").join(marked.repartition(parts, "commit_id"), "commit_id")
    return settle_by(placed.join(files, "pk"), "lines", ["repo"], parts), parts


def repositories(spark, sf_dir):
    """The derived tables, by name."""
    lines, parts = repository_lines(spark, sf_dir)
    view = f"lines_{uuid.uuid4().hex}"
    lines.createOrReplaceTempView(view)
    text = SPARK_OF_LINES.replace("FROM lines", f"FROM {view}")

    def of_lines(select):
        return spark.sql(f"WITH {text} {select}")

    listed = Window.partitionBy("repo").orderBy(locale_order("file"), F.col("file"))
    files = filegraph.packages(of_lines("SELECT * FROM files")).withColumn("seq", F.col("file"))
    return {
        "gold": of_lines("SELECT * FROM gold"),
        "history": of_lines("SELECT * FROM history"),
        "files": files.withColumn("place", F.row_number().over(listed)),
        "file_edges": filegraph.roll_up(of_lines("SELECT * FROM edges"), ["repo"]),
    }, parts


def anchored(spark, sf_dir, *names):
    """The repositories' anchors and the tables ``names``, all dealt by repository."""
    r, parts = repositories(spark, sf_dir)
    if "place" not in names:  # the locale order of files is only worth its sort where directories are ranked
        r["files"] = r["files"].drop("place")
    r = {k: settle_by(v, k, ["repo"], parts) for k, v in r.items() if k in ("gold", "files", *names)}
    gold = evaluate.split_gold(r["gold"], r["files"])
    r["split"] = gold
    r["anchors"] = settle_by(evaluate.anchors_of(gold), "anchors", ["repo"], parts)
    r["parts"] = parts
    return r


@workload("file_graph", f"{GRAPH} SELECT repo, src, dst, round(w, 6) AS w FROM fe")
def file_graph(spark, sf_dir):
    return repositories(spark, sf_dir)[0]["file_edges"].withColumn("w", F.round("w", 6))


@workload("file_degree", f"{GRAPH} SELECT * FROM deg")
def file_degree(spark, sf_dir):
    return filegraph.degrees(repositories(spark, sf_dir)[0]["file_edges"], ["repo"])


@workload("file_packages", f"{GRAPH}, {LOCAL} SELECT repo, file, package FROM located")
def file_packages(spark, sf_dir):
    return repositories(spark, sf_dir)[0]["files"].select("repo", "file", "package")


@workload("pagerank_scores", f"{GRAPH}, {PPR} SELECT repo, anchor, file, round(score, 6) AS score FROM ppr_score")
def pagerank_scores(spark, sf_dir):
    r = anchored(spark, sf_dir, "file_edges")
    scores = walk.personalized_pagerank(r["file_edges"], r["anchors"], ["repo"], parts=r["parts"])
    return scores.withColumn("score", F.round("score", 6))


@workload("dependents_scores", f"{GRAPH}, {BACK}, {DEP} SELECT repo, anchor, file, round(score, 6) AS score FROM dep_score")
def dependents_scores(spark, sf_dir):
    r = anchored(spark, sf_dir, "file_edges")
    scores = walk.personalized_pagerank(r["file_edges"], r["anchors"], ["repo"], forward=False, parts=r["parts"])
    return scores.withColumn("score", F.round("score", 6))


@workload("graph_closure", f"{GRAPH}, {REACH} SELECT repo, anchor, file, CAST(hop AS INTEGER) AS hop, round(weight, 6) AS weight FROM reach")
def graph_closure(spark, sf_dir):
    r = anchored(spark, sf_dir, "file_edges")
    return traverse.reach(r["file_edges"], r["anchors"], ["repo"], parts=r["parts"]).withColumn("weight", F.round("weight", 6))


@workload(
    "bfs_ranked",
    f"{GRAPH}, {REACH} SELECT repo, anchor, file, CAST(rank AS INTEGER) AS rank FROM "
    f"({_ranked('(SELECT * FROM reach WHERE hop <= 3) q', 'hop, weight DESC, ' + KEY.format('file') + ', file', '10')}) z",
)
def bfs_ranked(spark, sf_dir):
    r = anchored(spark, sf_dir, "file_edges")
    reached = traverse.reach(r["file_edges"], r["anchors"], ["repo"], max_hops=3, parts=r["parts"])
    return traverse.bfs_ranked(reached, 10, ["repo"]).select("repo", "anchor", "file", "rank")


@workload(
    "directory_ranked",
    f"{GRAPH}, {LOCAL} SELECT repo, anchor, file, CAST(rank AS INTEGER) AS rank FROM "
    f"({_ranked('dirscore', 'score DESC, ' + KEY.format('file') + ', file', '10')}) z",
)
def directory_ranked(spark, sf_dir):
    r = anchored(spark, sf_dir, "place")
    return locality.directory_ranked(r["files"], r["anchors"], 10, ["repo"], "place").drop("score")


@workload(
    "package_mates",
    f"{GRAPH}, {LOCAL} SELECT repo, anchor, file, CAST(rank AS INTEGER) AS rank FROM ({_ranked('mates', 'file', '5')}) z",
)
def package_mates(spark, sf_dir):
    r = anchored(spark, sf_dir)
    return locality.package_mates(r["files"], r["anchors"], 5, ["repo"])


@workload(
    "related_files",
    f"""{ALL}, rg AS ({_ranked('ppr_score', BY_SCORE, '5')}), rc AS ({_ranked('co', BY_SCORE, '5')}),
    v AS (SELECT repo, anchor, file, sum(1e0 / (60 + rank)) AS score FROM (SELECT * FROM rg UNION ALL SELECT * FROM rc) t
          GROUP BY repo, anchor, file)
    SELECT repo, anchor, file, CAST(rank AS INTEGER) AS rank FROM ({_ranked('v', BY_SCORE, '5')}) z""",
)
def related_files(spark, sf_dir):
    r = anchored(spark, sf_dir, "file_edges", "history")
    parts = r["parts"]
    graph = walk.ppr_ranked(r["file_edges"], r["anchors"], 5, ["repo"], parts=parts)
    together = cochange.co_change_ranked(cochange.build_co_change(r["history"], ["repo"], parts=parts), r["anchors"], 5)
    columns = ["repo", "anchor", "file", "rank"]
    return fusion.fuse(graph.select(*columns).unionByName(together.select(*columns)), 5, ["repo"]).select(*columns)


def _scores(spark, sf_dir):
    r, parts = repositories(spark, sf_dir)
    r = {k: settle_by(v, k, ["repo"], parts) for k, v in r.items()}
    return evaluate.evaluate(r["file_edges"], r["files"], r["history"], r["gold"], parts=parts)


_METRICS = ["recall_at_g", *[f"{m}_{k}" for m in ("recall", "precision") for k in (5, 10, 20)]]


@workload(
    "evaluation_scores",
    f"{ALL} SELECT repo, strategy, {', '.join(f'round({m}, 6) AS {m}' for m in _METRICS)} FROM scores",
)
def evaluation_scores(spark, sf_dir):
    scores, _, _ = _scores(spark, sf_dir)
    return scores.select("repo", "strategy", *[F.round(m, 6).alias(m) for m in _METRICS])


@workload(
    "evaluation_summary",
    f"{ALL} SELECT strategy, instances, wins, losses, {', '.join(f'round({m}, 6) AS {m}' for m in _METRICS)} FROM summary",
)
def evaluation_summary(spark, sf_dir):
    scores, _, _ = _scores(spark, sf_dir)
    out = evaluate.summarise(scores)
    return out.select("strategy", "instances", "wins", "losses", *[F.round(m, 6).alias(m) for m in _METRICS])


@workload(
    "ablation",
    f"""{ALL} SELECT strategy, round(recall_at_g, 6) AS recall_at_g,
    round((SELECT recall_at_g FROM summary WHERE strategy = 'combined') - recall_at_g, 6) AS drop,
    round(1 - recall_at_g / (SELECT recall_at_g FROM summary WHERE strategy = 'combined'), 6) AS share
    FROM summary WHERE strategy LIKE 'no-%'""",
)
def ablation(spark, sf_dir):
    scores, _, _ = _scores(spark, sf_dir)
    out = evaluate.ablation(settle(evaluate.summarise(scores), "summary"))
    return out.select("strategy", *[F.round(c, 6).alias(c) for c in ("recall_at_g", "drop", "share")])


@workload(
    "closure_scores",
    f"""{GRAPH}, {REACH}, sz AS (SELECT repo, count(*) AS n FROM files GROUP BY repo),
    a AS (SELECT a.repo, a.anchor, a.n_targets, count(r.file) AS size, count(ix.file) AS found FROM anchors a
          LEFT JOIN reach r ON r.repo = a.repo AND r.anchor = a.anchor
          LEFT JOIN ix ON ix.repo = r.repo AND ix.file = r.file GROUP BY 1, 2, 3),
    u AS (SELECT ix.repo, count(*) FILTER (WHERE f.lang IS NULL) / CAST(count(*) AS DOUBLE) AS x FROM ix
          JOIN files f ON f.repo = ix.repo AND f.file = ix.file GROUP BY ix.repo)
    SELECT a.repo, round(avg(found / CAST(n_targets AS DOUBLE)), 6) AS closure_recall,
           round(avg(size / CAST(sz.n AS DOUBLE)), 6) AS closure_share, round(max(u.x), 6) AS unparsed_share
    FROM a JOIN sz USING (repo) JOIN u USING (repo) GROUP BY a.repo""",
)
def closure_scores(spark, sf_dir):
    r = anchored(spark, sf_dir, "file_edges")
    reached = settle_by(traverse.reach(r["file_edges"], r["anchors"], ["repo"], parts=r["parts"]), "reach", ["repo"], r["parts"])
    out = evaluate.closure_scores(reached, r["split"], r["anchors"], r["files"])
    return out.select("repo", *[F.round(c, 6).alias(c) for c in ("closure_recall", "closure_share", "unparsed_share")])


@workload(
    "miss_reasons",
    f"{GRAPH} SELECT 'created-by-patch' AS reason, count(*) AS files FROM gold g "
    "WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.repo = g.repo AND f.file = g.file)",
)
def miss_reasons(spark, sf_dir):
    r, _ = repositories(spark, sf_dir)
    return evaluate.miss_reasons(evaluate.split_gold(r["gold"], r["files"]))
