"""Scalar, search, log and patch work over documents, pages and parts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestar.functions import logs, patches, paths, text
from lodestar.operators import search
from lodestar.plans import verification
from lodestar.operators import navigate
from lodestar.session import run_dir, table
from lodestar.sources import dataset
from lodestar.workloads.codebase import paired
from lodestar.workloads.navigation import IMPACT, GRAMS, _each_file
from lodestar.workloads.registry import workload


@workload(
    "document_facts",
    """SELECT doc_id, substr(sha1(text), 1, 16) AS content_hash, CAST(len(string_split(text, chr(10))) AS INTEGER) AS line_count,
    CAST(ceil(length(text) / 4e0) AS BIGINT) AS tokens,
    CASE WHEN text = '' THEN 0 ELSE CAST(len(string_split(text, chr(10))) AS INTEGER) END AS counted FROM documents""",
)
def document_facts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.content_hash("text").alias("content_hash"), F.size(text.lines("text")).alias("line_count"),
        text.estimate_tokens("text").cast("long").alias("tokens"), text.count_lines("text").alias("counted"),
    )


@workload(
    "signatures",
    """SELECT doc_id, CASE WHEN length(s) > 160 THEN substr(s, 1, 159) || '…' ELSE s END AS signature FROM (
      SELECT doc_id, regexp_replace(trim(split_part(text || ' {', chr(10), 1)), '\\s*\\{\\s*$', '') AS s FROM documents) t""",
)
def signatures(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.signature(F.concat("text", F.lit(" {"))).alias("signature"))


@workload(
    "numbered_lines",
    """SELECT doc_id, array_to_string([lpad(i || '', CAST(greatest(5, length(i || '')) AS INTEGER), ' ') || '  ' || l[i] for i in range(1, len(l) + 1)], chr(10)) AS numbered
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) t""",
)
def numbered_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.number_lines("text").alias("numbered"))


@workload(
    "clipped_texts",
    """SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 90) || chr(10) || '… [' || (length(text) - 300)
      || ' characters trimmed] …' || chr(10) || right(text, 210) END AS clipped FROM documents""",
)
def clipped_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clip("text", 300).alias("clipped"))


CAMEL = "split_part(p_name, ' ', 1) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2)"


@workload(
    "identifiers",
    f"""SELECT p_partkey, array_to_string(list_transform(list_filter(regexp_split_to_array(
        regexp_replace(w, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: x <> ''), lambda x: lower(x)), '|') AS words,
      CASE WHEN length(w) >= 12 THEN w ELSE rpad(w, 12, ' ') END AS padded,
      CAST(len({GRAMS.format('w')}) AS INTEGER) AS grams FROM (SELECT p_partkey, {CAMEL} || '_' || p_brand AS w FROM part) t""",
)
def identifiers(spark, sf_dir):
    named = table(spark, sf_dir, "part").select("p_partkey", F.expr(f"{CAMEL} || '_' || p_brand").alias("w"))
    return named.select(
        "p_partkey", F.array_join(text.identifier_words("w"), "|").alias("words"), text.pad_right("w", 12).alias("padded"),
        F.size(text.trigrams("w")).alias("grams"),
    )


@workload(
    "name_similarity",
    f"""SELECT p_partkey, round(CASE WHEN p_name = lower(p_type) THEN 1e0 ELSE 2 * len(list_intersect({GRAMS.format('p_name')}, {GRAMS.format('p_type')}))
      / CAST(len({GRAMS.format('p_name')}) + len({GRAMS.format('p_type')}) AS DOUBLE) END, 6) AS score FROM part""",
)
def name_similarity(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", F.round(text.trigram_similarity("p_name", "p_type"), 6).alias("score"))


URL_PATH = "regexp_extract(url, '^https?://([^?#]+)', 1)"


@workload(
    "path_functions",
    f"""SELECT page_id, regexp_extract(p, '([^/]*)/*$', 1) AS base, CASE WHEN p LIKE '%/%' THEN regexp_replace(regexp_replace(p, '/+$', ''), '/[^/]*$', '') ELSE '.' END AS dir,
      regexp_extract(regexp_extract(p, '([^/]*)/*$', 1), '^.+(\\.[^.]*)$', 1) AS ext,
      regexp_replace(regexp_extract(p, '([^/]*)/*$', 1), '\\.[^.]+$', '') AS stem,
      regexp_replace(p, '/+$', '') AS norm, regexp_replace(p, '^m\\.', '') AS anchor
      FROM (SELECT page_id, {URL_PATH} AS p FROM pages) t""",
)
def path_functions(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(URL_PATH).alias("p"))
    climbed = paths.normalize(F.concat(F.lit("./x/../"), "p", F.lit("/./")))
    return rows.select(
        "page_id", paths.basename("p").alias("base"), paths.dirname("p").alias("dir"), paths.extname("p").alias("ext"),
        paths.stem("p").alias("stem"), climbed.alias("norm"),
        F.regexp_replace(paths.normalize_anchor(F.concat(F.lit(" /repo/./"), "p"), "/repo"), "^m\\.", "").alias("anchor"),
    )


DOC_FILE = "source || '/' || lang || '/d' || doc_id || '.txt'"


@workload(
    "grep_lines",
    f"""SELECT file, CAST(i AS INTEGER) AS line, substr(trim(l[i], chr(32) || chr(9) || chr(13)), 1, 200) AS text FROM (
      SELECT {DOC_FILE} AS file, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) t
    WHERE regexp_matches(l[i], '(the|le|der) [a-z]+ing?\\b')""",
)
def grep_lines(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.expr(DOC_FILE).alias("file"), F.col("text").alias("content"))
    return search.grep(files, "(the|le|der) [a-z]+ing?\\b", limit=None)


@workload(
    "grep_first",
    f"""SELECT file, CAST(i AS INTEGER) AS line, substr(trim(l[i], chr(32) || chr(9) || chr(13)), 1, 200) AS text FROM (
      SELECT {DOC_FILE} AS file, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) t
    WHERE regexp_matches(l[i], 'th[ae]') AND starts_with(file, 'src1/') AND regexp_matches(file, '^(?:.*/)?d[^/]*\\.txt$')
    ORDER BY file, line LIMIT 40""",
)
def grep_first(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.expr(DOC_FILE).alias("file"), F.col("text").alias("content"))
    return search.grep(files, "th[ae]", glob="**/d*.txt", path="./src1/")


@workload("glob_files", f"SELECT p AS file FROM (SELECT {URL_PATH} AS p FROM pages) t WHERE regexp_matches(p, '^(?:.*/)?en/[^/]*\\.html$')")
def glob_files(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.expr(URL_PATH).alias("file"))
    return search.glob_files(files, "**/en/*.html", limit=None)


HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"


@workload(
    "paths_mentioned",
    f"""WITH known AS (SELECT DISTINCT {HOST} AS file FROM pages),
    m AS (SELECT DISTINCT page_id, regexp_replace(unnest(regexp_extract_all(html, '[\\w./-]+\\.[A-Za-z][\\w]{{0,4}}')), '^\\./', '') AS file FROM pages)
    SELECT page_id, file FROM m WHERE file IN (SELECT file FROM known)""",
)
def paths_mentioned(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    known = pages.select(F.expr(HOST).alias("file")).distinct()
    return logs.paths_mentioned(pages, known, "page_id", "html")


# -- diffs, one section per line of a document ----------------------------------------


def diffs(spark, sf_dir):
    """Each line of a document becomes a changed file; the four kinds of change alternate."""
    docs = table(spark, sf_dir, "documents")

    def section(line, i):
        n = i.cast("string")
        old = F.concat(F.lit("src/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("_"), n, F.when(i % 3 == 0, "_test.go").otherwise(".go"))
        new = F.when(i % 4 == 3, F.concat(F.lit("lib/"), F.col("source"), F.lit("_"), n, F.lit(".go"))).otherwise(old)
        head = F.concat(F.lit("diff --git a/"), old, F.lit(" b/"), new, F.lit("\n"))
        body = (
            F.when(i % 4 == 1, F.concat(F.lit("new file mode 100644\n--- /dev/null\n+++ b/"), new))
            .when(i % 4 == 2, F.concat(F.lit("deleted file mode 100644\n--- a/"), old, F.lit("\n+++ /dev/null")))
            .when(i % 4 == 3, F.concat(F.lit("similarity index 90%\nrename from "), old, F.lit("\nrename to "), new))
            .otherwise(F.concat(F.lit("index 1..2\n--- a/"), old, F.lit("\n+++ b/"), new))
        )
        return F.concat(head, body, F.lit("\n@@ -1 +1 @@\n+"), line)

    return docs.select("doc_id", F.array_join(F.transform(text.lines("text"), section), "\n").alias("patch"))


DIFF_ROWS = """d AS (SELECT doc_id, lang, source, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
r AS (SELECT doc_id, i, CASE WHEN i % 4 = 3 THEN 'lib/' || source || '_' || i || '.go'
  ELSE 'src/' || lang || '/' || source || '_' || i || CASE WHEN i % 3 = 0 THEN '_test.go' ELSE '.go' END END AS path,
  CASE i % 4 WHEN 1 THEN 'added' WHEN 2 THEN 'deleted' ELSE 'modified' END AS status FROM d)"""


@workload("patch_files", f"WITH {DIFF_ROWS} SELECT doc_id, CAST(i + 1 AS INTEGER) AS ord, path, status FROM r")
def patch_files(spark, sf_dir):
    return patches.patch_files(diffs(spark, sf_dir), "doc_id")


@workload("patch_without_tests", f"WITH {DIFF_ROWS} SELECT DISTINCT doc_id, path AS file FROM r WHERE NOT regexp_matches(path, '_test\\.\\w+$')")
def patch_without_tests(spark, sf_dir):
    return patches.changed_files(diffs(spark, sf_dir), "doc_id").filter(~patches.is_test_path("file"))


# -- logs ------------------------------------------------------------------------------


def test_logs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")

    def line_of(line, i):
        unit = F.concat(F.lit("--- FAIL: Test_"), (i % 7).cast("string"), F.lit(" (0.1s)"))
        package = F.concat(F.lit("FAIL\tpkg/"), ((i + F.col("doc_id")) % 5).cast("string"), F.lit(" "), line)
        return F.when(i % 5 == 0, unit).when(i % 5 == 1, package).otherwise(line)

    return docs.select("doc_id", "source", "n_chars", F.array_join(F.transform(text.lines("text"), line_of), "\n").alias("log"))


LOG_UNITS = """l AS (SELECT doc_id, source, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
u AS (SELECT DISTINCT doc_id, source, CASE i % 5 WHEN 0 THEN 'Test_' || (i % 7) ELSE 'pkg/' || ((i + doc_id) % 5) END AS unit FROM l WHERE i % 5 < 2)"""


@workload("test_failures", f"WITH {LOG_UNITS} SELECT doc_id, unit FROM u")
def test_failures(spark, sf_dir):
    return test_logs(spark, sf_dir).select("doc_id", F.explode(logs.test_failures("log")).alias("unit"))


@workload(
    "failures_against_baseline",
    f"""WITH {LOG_UNITS}, b AS (SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source),
    base AS (SELECT u.source, u.unit FROM u JOIN b ON b.doc_id = u.doc_id)
    SELECT DISTINCT u.source, u.unit, EXISTS (SELECT 1 FROM base x WHERE x.source = u.source AND x.unit = u.unit) AS preexisting FROM u""",
)
def failures_against_baseline(spark, sf_dir):
    found = test_logs(spark, sf_dir).select("doc_id", "source", F.explode(logs.test_failures("log")).alias("unit"))
    first = found.groupBy("source", "unit").agg(F.min("doc_id").alias("doc_id"))
    base_doc = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    return logs.against_baseline(found, first.join(base_doc, ["source", "doc_id"], "left_semi"), ["source"])


LOG_TEXT = """t AS (SELECT doc_id, n_chars, [CASE (i - 1) % 5 WHEN 0 THEN '--- FAIL: Test_' || ((i - 1) % 7) || ' (0.1s)'
   WHEN 1 THEN 'FAIL' || chr(9) || 'pkg/' || ((i - 1 + doc_id) % 5) || ' ' || l[i] ELSE l[i] END for i in range(1, len(l) + 1)] AS ls
   FROM (SELECT doc_id, n_chars, string_split(text, chr(10)) AS l FROM documents) x)"""


@workload(
    "condensed_logs",
    f"""WITH {LOG_TEXT}, c AS (SELECT doc_id, n_chars % 2 = 0 AS ok,
      array_to_string([x for x in ls if regexp_matches(x, '(FAIL|--- FAIL|Error|error:|panic:|expected|Expected|✗|×|assert)')], chr(10)) AS hits,
      string_split(trim(array_to_string(ls, chr(10)), chr(32) || chr(9) || chr(10) || chr(13)), chr(10)) AS tail,
      array_to_string(([x for x in ls if trim(x) <> '' AND NOT regexp_matches(x, '^(go: downloading|Compiling|\\s*Finished)')])[1:40], chr(10)) AS comp FROM t)
    SELECT doc_id, CASE WHEN ok THEN array_to_string(tail[greatest(1, len(tail) - 7):], chr(10))
      WHEN length(hits) > 4000 THEN substr(hits, 1, 4000) || chr(10) || '… [output trimmed]' ELSE hits END AS test_output,
      CASE WHEN length(comp) > 3000 THEN substr(comp, 1, 3000) || chr(10) || '… [output trimmed]' ELSE comp END AS compiler_output,
      n_chars % 128 = 127 AS missing FROM (SELECT c.*, d.n_chars FROM c JOIN documents d USING (doc_id)) z""",
)
def condensed_logs(spark, sf_dir):
    rows = test_logs(spark, sf_dir)
    return rows.select(
        "doc_id", logs.condense_test_output("log", F.col("n_chars") % 2 == 0).alias("test_output"),
        logs.condense_compiler_output("log").alias("compiler_output"),
        logs.toolchain_missing(F.col("n_chars") % 128, "log").alias("missing"),
    )


@workload(
    "tool_arguments",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN substr(props, 1, length(props) - 1) END AS unparsed,
    CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events""",
)
def tool_arguments(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_type") == "error", F.left("props", F.length("props") - 1)).otherwise(F.col("props"))
    parsed = logs.tool_arguments(raw)
    return events.select(
        "event_id", F.get_json_object(parsed, "$.__unparsed").alias("unparsed"), F.get_json_object(parsed, "$.k").cast("int").alias("k")
    )


# -- instances -------------------------------------------------------------------------


def instance_lines(spark, sf_dir):
    """Documents as JSON lines; every seventh line is cut off, as a broken download would be.

    Every third one writes its issue's number as text and its base as a bare name.
    """
    docs = table(spark, sf_dir, "documents")
    parts = text.lines("text")
    odd = F.col("doc_id") % 3 == 0

    def record_of(number, base):
        issue = F.array(F.struct(number.alias("number"), F.col("source").alias("title"), F.try_element_at(parts, F.lit(2)).alias("body")))
        return F.to_json(
            F.struct(
                F.lit("org").alias("org"), F.col("source").alias("repo"), F.col("doc_id").alias("number"), base.alias("base"),
                F.try_element_at(parts, F.lit(1)).alias("title"), issue.alias("resolved_issues"), F.col("lang"), F.col("text").alias("run_result"),
            )
        )

    record = F.when(odd, record_of(F.col("doc_id").cast("string"), F.lit("main"))).otherwise(
        record_of(F.col("doc_id"), F.struct(F.lit("main").alias("ref")))
    )
    return docs.select(F.when(F.col("doc_id") % 7 == 0, F.left(record, F.length(record) - 5)).otherwise(record).alias("value"))


INSTANCES = """i AS (SELECT doc_id, source, lang, string_split(text, chr(10)) AS l FROM documents WHERE doc_id % 7 <> 0)"""


@workload(
    "dataset_instances",
    f"""WITH {INSTANCES} SELECT 'org__' || source || '-' || doc_id AS instance_id, lang, 'registry/' || 'org' || '_' || source || ':pr-' || doc_id AS image,
      'https://example.com/org/' || source || '.git' AS url,
      trim(CASE WHEN l[1] <> '' THEN '# ' || l[1] || chr(10) || chr(10) ELSE '' END || '## Linked issue #' || doc_id || ': ' || source
        || CASE WHEN coalesce(l[2], '') <> '' THEN chr(10) || chr(10) || l[2] ELSE '' END, chr(32) || chr(9) || chr(10) || chr(13)) AS task
    FROM i WHERE lang IN ('en', 'fr')""",
)
def dataset_instances(spark, sf_dir):
    path = f"{run_dir(spark)}/instances-{uuid.uuid4().hex}"
    instance_lines(spark, sf_dir).write.text(path)
    rows = dataset.load_dataset(spark, path, langs=["en", "fr"])
    return rows.select(
        "instance_id", "lang", dataset.image_name("registry/{org}_{repo}:pr-{number}").alias("image"),
        dataset.repo_url("https://example.com").alias("url"), dataset.task_text().alias("task"),
    )


@workload("dataset_malformed", "SELECT count(*) AS malformed FROM documents WHERE doc_id % 7 = 0")
def dataset_malformed(spark, sf_dir):
    path = f"{run_dir(spark)}/instances-{uuid.uuid4().hex}"
    instance_lines(spark, sf_dir).write.text(path)
    return dataset.count_malformed(spark, path)


# -- verification scope ----------------------------------------------------------------

SCOPE = f"""{IMPACT}, reached AS (SELECT repo, file AS change, file FROM files UNION
  SELECT i.repo, i.change, n.file FROM ip i JOIN nd n ON n.repo = i.repo AND n.id = i.node)"""


@workload(
    "compile_scope",
    f"WITH {SCOPE} SELECT DISTINCT repo, change, './' || regexp_replace(file, '/[^/]*$', '') || '/...' AS package FROM reached WHERE file LIKE '%.go'",
)
def compile_scope(spark, sf_dir):
    _, graph = paired(spark, sf_dir)
    changed = _each_file(graph)
    return verification.compile_scope(changed, navigate.impact_files(graph, changed), ["repo"])


@workload(
    "test_scope",
    f"""WITH {IMPACT}, c AS (SELECT DISTINCT t.repo, t.change, n.file FROM touched t JOIN rel r ON r.repo = t.repo AND r.anchor = t.anchor AND r.label = 'Related tests'
      JOIN nd n ON n.repo = r.repo AND n.id = r.node),
    e AS (SELECT *, TRUE AS scoped FROM c UNION ALL SELECT repo, file, file, FALSE FROM files f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.repo = f.repo AND c.change = f.file))
    SELECT DISTINCT repo, change, './' || regexp_replace(file, '/[^/]*$', '') || '/...' AS package, scoped FROM e WHERE file LIKE '%.go'""",
)
def test_scope(spark, sf_dir):
    _, graph = paired(spark, sf_dir)
    changed = _each_file(graph)
    return verification.test_scope(changed, navigate.covering_test_files(graph, changed), ["repo"])
