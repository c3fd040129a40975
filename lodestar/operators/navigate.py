"""Structural questions about a resolved graph, answered for many anchors at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.constants import CONFIDENCE_RANK, KIND_PRIORITY, lookup_sql
from lodestar.operators.ranking import locale_order
from lodestar.operators.resolve import Graph, file_id, strongest
from lodestar.session import settle

# Rows of a relation: (keys, anchor, label, node, via, confidence, line, tie).
GROUP_LABELS_SYMBOL = ("Calls", "Called by", "Uses types", "Implementations", "Related tests")
GROUP_LABELS_FILE = ("Defined here", "Related code", "Used by", "Related tests")
GROUP_LABELS_IMPACT = ("Direct callers", "Indirect callers", "Implementations", "Tests covering the change")


def trust(confidence: str | Column = "confidence") -> Column:
    column = F.col(confidence) if isinstance(confidence, str) else confidence
    return (
        F.when(column == "exact", CONFIDENCE_RANK["exact"])
        .when(column == "likely", CONFIDENCE_RANK["likely"])
        .otherwise(CONFIDENCE_RANK["heuristic"])
    )


def kind_priority(column: str = "kind") -> Column:
    return F.expr(lookup_sql(column, KIND_PRIORITY, "0"))


def keep_best(rows: DataFrame, by: list, tie: str = "tie") -> DataFrame:
    """One row per node and group: highest confidence, the earliest sighting on ties.

    A minimum, so a node that everything refers to is combined on the map side instead of
    being sorted in one task. What is kept stands behind what decides, and is carried once.
    """
    row = F.struct((-trust()).alias("c"), F.col(tie).alias("tie"), "via", "confidence", "line")
    best = rows.groupBy(*by).agg(F.min(row).alias("v"))
    return best.select(*by, "v.via", "v.confidence", "v.line", "v.tie")


def ranked(rows: DataFrame, nodes: DataFrame, keys: list, by: list, limit: int | None) -> DataFrame:
    """Order each group by confidence, kind, file and line; keep ``limit`` and count the rest."""
    about = nodes.select(
        *keys, F.col("id").alias("node"), F.col("kind").alias("node_kind"), F.col("name").alias("node_name"),
        F.col("file").alias("node_file"), F.col("start_line").alias("node_line"), F.col("pos").alias("node_pos"),
    )
    joined = rows.join(about, [*keys, "node"])
    order = Window.partitionBy(*keys, *by).orderBy(
        trust().desc(), kind_priority("node_kind").desc(), locale_order("node_file"), "node_line", "node_pos"
    )
    out = joined.withColumn("rank", F.row_number().over(order))
    if limit is None:
        return out
    sizes = rows.groupBy(*keys, *by).agg(F.greatest(F.lit(0), F.count("*") - limit).alias("truncated"))
    return out.filter(F.col("rank") <= limit).join(sizes, [*keys, *by])


def relations(graph: Graph) -> DataFrame:
    """Every edge as the group rows of both its ends, deduplicated per symbol anchor.

    The strongest edge of a pair and kind is its only row under a label, but for tests, which
    come from two kinds; only these are gathered once more.
    """
    keys = list(graph.keys)
    edges = graph.edges if graph.per_pair else strongest(graph.edges, keys)

    def row(anchor, node, label, when, first):
        return F.when(
            when,
            F.struct(
                F.col(anchor).alias("anchor"), F.lit(label).alias("label"), F.col(node).alias("node"), F.lit(first).alias("first")
            ),
        )

    kind = F.col("kind")
    calls = kind == "calls"
    rows = F.array_compact(
        F.array(
            row("src", "dst", "Calls", calls, 0),
            row("dst", "src", "Called by", calls, 0),
            row("src", "dst", "Uses types", kind == "references", 0),
            row("dst", "src", "Implementations", kind == "implements", 0),
            row("dst", "src", "Related tests", kind == "tests", 0),
            row("dst", "src", "Related tests", F.col("in_test"), 1),
        )
    )
    spread = edges.select(
        *keys, kind.alias("via"), "confidence", "line", "ord", F.inline(rows)
    ).withColumn("tie", F.struct("first", "ord"))
    by = [*keys, "anchor", "label", "node"]
    tests = F.col("label") == "Related tests"
    single = spread.filter(~tests).select(*by, "via", "confidence", "line", "tie")
    return single.unionByName(keep_best(spread.filter(tests), by))


def callers(graph: Graph) -> DataFrame:
    return relations(graph).filter(F.col("label") == "Called by")


def callees(graph: Graph) -> DataFrame:
    return relations(graph).filter(F.col("label") == "Calls")


def tests_for(graph: Graph) -> DataFrame:
    return relations(graph).filter(F.col("label") == "Related tests")


def implementations(graph: Graph) -> DataFrame:
    return relations(graph).filter(F.col("label") == "Implementations")


def _outside_tests(rows: DataFrame, graph: Graph) -> DataFrame:
    """Callers that are tests are listed as tests, not as callers."""
    keys = list(graph.keys)
    code = graph.nodes.filter(~F.col("is_test")).select(*keys, F.col("id").alias("node"))
    plain = rows.filter(F.col("label") != "Called by")
    return plain.unionByName(rows.filter(F.col("label") == "Called by").join(code, [*keys, "node"], "left_semi"))


def _contained(graph: Graph, with_tests: bool) -> DataFrame:
    """Symbols of each file with their place in the file's listing."""
    keys = list(graph.keys)
    symbols = graph.nodes.filter(F.col("kind") != "file")
    if not with_tests:
        symbols = symbols.filter(F.col("kind") != "test")
        place = F.struct((-kind_priority("kind")).alias("p"), F.col("start_line").alias("l"), F.col("pos").alias("s"))
    else:
        place = F.struct(F.lit(0).alias("p"), F.lit(0).alias("l"), F.col("pos").alias("s"))
    return symbols.select(*keys, F.col("id").alias("anchor"), F.col("file").alias("anchor_file"), place.alias("place"))


def _by_file(rows: DataFrame, graph: Graph, contained: DataFrame, labels: dict, same_file_ok=()) -> DataFrame:
    """Lift symbol rows to the files that define the anchors."""
    keys = list(graph.keys)
    files = graph.nodes.select(*keys, F.col("id").alias("node"), F.col("file").alias("node_file"))
    lifted = rows.filter(F.col("label").isin(*labels)).join(contained, [*keys, "anchor"]).join(files, [*keys, "node"])
    allowed = (F.col("node_file") != F.col("anchor_file")) | F.col("label").isin(*same_file_ok)
    renamed = F.coalesce(*[F.when(F.col("label") == a, F.lit(b)) for a, b in labels.items()])
    return keep_best(
        lifted.filter(allowed).select(
            *keys, file_id(F.col("anchor_file")).alias("anchor"), renamed.alias("label"), "node", "via", "confidence", "line",
            F.col("place").alias("tie"),
        ),
        [*keys, "anchor", "label", "node"],
    )


def neighbors(graph: Graph, anchors: DataFrame | None = None, per_group: int = 8, include_heuristic: bool = True) -> DataFrame:
    """Labelled groups around each symbol and each file, capped per group.

    ``anchors(keys, anchor)`` restricts the answer to some node ids.
    """
    keys = list(graph.keys)
    rows = settle(_outside_tests(relations(graph), graph), "relations")
    columns = [*keys, "anchor", "label", "node", "via", "confidence", "line"]
    contains = graph.edges.filter(F.col("kind") == "contains")
    shown = graph.nodes.filter(F.col("kind") != "test").select(*keys, F.col("id").alias("dst"))
    defined = contains.join(shown, [*keys, "dst"], "left_semi").select(
        *keys, F.col("src").alias("anchor"), F.lit("Defined here").alias("label"), F.col("dst").alias("node"),
        F.col("kind").alias("via"), "confidence", "line",
    )
    lifted = _by_file(
        rows, graph, _contained(graph, False),
        {"Calls": "Related code", "Called by": "Used by", "Related tests": "Related tests"}, ("Related tests",),
    )
    # a file's groups are those of what it defines; what stands outside any symbol is not among them
    symbols = rows.filter(~F.col("anchor").startswith("file:"))
    every = symbols.select(*columns).unionByName(defined.select(*columns)).unionByName(lifted.select(*columns))
    every = every.filter(F.col("node") != F.col("anchor"))
    if not include_heuristic:
        every = every.filter(F.col("confidence") != "heuristic")
    if anchors is not None:
        every = every.join(anchors.select(*keys, "anchor"), [*keys, "anchor"], "left_semi")
    every = settle(every, "groups")
    return ranked(every, graph.nodes, keys, ["anchor", "label"], per_group)


def surfaced_files(groups: DataFrame, graph: Graph) -> DataFrame:
    """Distinct files shown around each anchor, without the anchor's own."""
    keys = list(graph.keys)
    own = graph.nodes.select(*keys, F.col("id").alias("anchor"), F.col("file").alias("anchor_file"))
    return (
        groups.select(*keys, "anchor", "node_file")
        .distinct()
        .join(own, [*keys, "anchor"])
        .filter(F.col("node_file") != F.col("anchor_file"))
        .select(*keys, "anchor", F.col("node_file").alias("file"))
    )


def relation_of_files(graph: Graph, relation: str) -> DataFrame:
    """``callers``, ``callees`` or ``tests`` of everything a file defines, from other files."""
    label = {"callers": "Called by", "callees": "Calls", "tests": "Related tests"}[relation]
    rows = _by_file(relations(graph), graph, _contained(graph, True), {label: label})
    return ranked(rows.drop("tie"), graph.nodes, list(graph.keys), ["anchor", "label"], None)


def impact(graph: Graph, changed: DataFrame, per_group: int = 12) -> DataFrame:
    """What each change set reaches: ``changed(keys, change, file, ord)``.

    Groups: direct callers, indirect callers, implementations, covering tests.
    """
    keys = list(graph.keys)
    by = [*keys, "change"]
    symbols = graph.nodes.filter(F.col("kind") != "file").select(*keys, "file", F.col("id").alias("anchor"), "pos")
    touched = changed.join(symbols, [*keys, "file"]).select(
        *by, "anchor", F.struct(F.col("ord").alias("o"), F.col("pos").alias("p")).alias("place")
    )
    rows = settle(relations(graph).filter(F.col("label").isin("Called by", "Implementations", "Related tests")), "relations")
    code_callers = settle(_outside_tests(rows.filter(F.col("label") == "Called by"), graph), "callers")
    touched = settle(touched, "touched")
    is_changed = touched.select(*by, F.col("anchor").alias("node")).distinct()

    def reached(label, source):
        return keep_best(
            touched.join(source.filter(F.col("label") == label), [*keys, "anchor"]).select(
                *by, "node", "via", "confidence", "line", F.col("place").alias("tie")
            ),
            [*by, "node"],
        )

    direct = settle(reached("Called by", code_callers).join(is_changed, [*by, "node"], "left_anti"), "direct")
    first = (
        touched.join(code_callers, [*keys, "anchor"])
        .groupBy(*by, "node")
        .agg(F.min(F.struct("place", (-trust()).alias("c"))).alias("first"))
        .join(is_changed, [*by, "node"], "left_anti")
        .withColumnRenamed("node", "anchor")
    )
    second = keep_best(
        first.join(code_callers, [*keys, "anchor"]).select(
            *by, "node", "via", "confidence", "line", F.struct("first", "anchor").alias("tie")
        ),
        [*by, "node"],
    )
    indirect = second.join(is_changed, [*by, "node"], "left_anti").join(direct.select(*by, "node"), [*by, "node"], "left_anti")
    columns = [*by, "node", "via", "confidence", "line"]
    groups = None
    for name, part in (
        ("Direct callers", direct),
        ("Indirect callers", indirect),
        ("Implementations", reached("Implementations", rows)),
        ("Tests covering the change", reached("Related tests", rows)),
    ):
        part = part.select(*columns).withColumn("label", F.lit(name))
        groups = part if groups is None else groups.unionByName(part)
    return ranked(settle(groups, "surface"), graph.nodes, keys, ["change", "label"], per_group)


def _touched(graph: Graph, changed: DataFrame) -> DataFrame:
    """Symbols of each change set: ``(keys, change, anchor)``."""
    keys = list(graph.keys)
    symbols = graph.nodes.filter(F.col("kind") != "file").select(*keys, "file", F.col("id").alias("anchor"))
    return changed.join(symbols, [*keys, "file"]).select(*keys, "change", "anchor").distinct()


def _files_around(rows: DataFrame, graph: Graph) -> DataFrame:
    """Files of the nodes around each anchor: ``(keys, anchor, node_file)``."""
    keys = list(graph.keys)
    files = graph.nodes.select(*keys, F.col("id").alias("node"), F.col("file").alias("node_file"))
    return rows.select(*keys, "anchor", "node").join(files, [*keys, "node"]).select(*keys, "anchor", "node_file").distinct()


def impact_files(graph: Graph, changed: DataFrame) -> DataFrame:
    """Files of everything ``impact`` lists without a limit, and those of the change: ``(keys, change, node_file)``.

    Files ask for less than places do: which caller stands first, or was met before, changes
    none, so callers of callers are joined by their files and only files are gathered.
    """
    keys = list(graph.keys)
    touched = settle(_touched(graph, changed), "touched")
    rows = settle(relations(graph).filter(F.col("label").isin("Called by", "Implementations", "Related tests")).select(*keys, "anchor", "label", "node"), "reach")
    code = settle(_outside_tests(rows.filter(F.col("label") == "Called by"), graph), "callers")
    caller_files = settle(_files_around(code, graph), "caller_files")
    beside = _files_around(rows.filter(F.col("label") != "Called by"), graph)
    first = touched.join(code.select(*keys, "anchor", "node"), [*keys, "anchor"]).select(*keys, "change", F.col("node").alias("anchor"))
    reached = None
    for part in (
        changed.select(*keys, "change", F.col("file").alias("node_file")),
        touched.join(caller_files.unionByName(beside), [*keys, "anchor"]).select(*keys, "change", "node_file"),
        first.distinct().join(caller_files, [*keys, "anchor"]).select(*keys, "change", "node_file"),
    ):
        part = part.distinct()
        reached = part if reached is None else reached.unionByName(part)
    return reached.distinct()


def covering_test_files(graph: Graph, changed: DataFrame) -> DataFrame:
    """Every test file reached by a change set, without a cap."""
    keys = list(graph.keys)
    tests = _files_around(tests_for(graph), graph).withColumnRenamed("node_file", "test_file")
    return _touched(graph, changed).join(tests, [*keys, "anchor"]).select(*keys, "change", "test_file").distinct()


def symbol_at(graph: Graph, places: DataFrame, bin_lines: int = 128) -> DataFrame:
    """Innermost symbol enclosing each ``places(keys, file, line)``.

    Line ranges are cut into bins, so the range test runs inside an equi-join.
    """
    keys = list(graph.keys)
    spans = graph.nodes.filter(F.col("kind") != "file").select(
        *keys, "file", F.col("id").alias("node"), "start_line", "end_line", "pos",
        F.explode(F.sequence(F.floor(F.col("start_line") / bin_lines), F.floor(F.col("end_line") / bin_lines))).alias("bin"),
    )
    asked = places.select(*keys, "file", "line").distinct().withColumn("bin", F.floor(F.col("line") / bin_lines))
    inside = asked.join(spans, [*keys, "file", "bin"]).filter(F.col("line").between(F.col("start_line"), F.col("end_line")))
    narrow = F.struct((F.col("end_line") - F.col("start_line")).alias("w"), F.col("pos").alias("p"))
    return inside.groupBy(*keys, "file", "line").agg(F.min_by("node", narrow).alias("node"))


def resolve_anchors(graph: Graph, asked: DataFrame) -> DataFrame:
    """Bind ``asked(keys, query)`` texts to nodes, most specific form first.

    Returns ``(keys, query, status, node, n_candidates)`` with status ``file``,
    ``symbol``, ``ambiguous`` or ``notfound``.
    """
    keys = list(graph.keys)
    by = [*keys, "query"]
    asked = asked.select(*by).distinct().withColumn("raw", F.trim("query"))
    symbols = graph.nodes.filter(F.col("kind") != "file")
    files = graph.nodes.filter(F.col("kind") == "file").select(*keys, F.col("file"), F.col("id").alias("node"))

    # file#symbol, by name or qualified name
    parts = F.split("raw", "#")
    hashed = asked.filter(F.size(parts) == 2).select(*by, parts[0].alias("file"), parts[1].alias("want"))
    named = symbols.select(*keys, "file", F.col("id").alias("node"), F.explode(F.array_distinct(F.array("name", "qualified"))).alias("want"))
    h = hashed.join(named, [*keys, "file", "want"]).groupBy(*by).agg(F.count("*").alias("n"), F.min("node").alias("node"))
    h = h.select(*by, F.lit(1).alias("stage"), F.when(F.col("n") == 1, "symbol").otherwise("ambiguous").alias("status"),
                 F.when(F.col("n") == 1, F.col("node")).alias("node"), "n")

    # file:line when the file is known, then a known file
    numbered = asked.filter(F.col("raw").rlike("^.*:\\d+$")).select(
        *by, F.regexp_extract("raw", "^(.*):(\\d+)$", 1).alias("file"),
        F.try_to_number(F.regexp_extract("raw", "^(.*):(\\d+)$", 2), F.lit("999999999")).cast("int").alias("line"),
    )
    placed = numbered.join(files, [*keys, "file"])
    at = symbol_at(graph, placed).withColumnRenamed("node", "at_node")
    line = placed.join(at, [*keys, "file", "line"], "left").select(
        *by, F.lit(2).alias("stage"), F.when(F.col("at_node").isNotNull(), "symbol").otherwise("file").alias("status"),
        F.coalesce("at_node", "node").alias("node"), F.lit(1).cast("long").alias("n"),
    )
    whole = asked.withColumn("file", F.col("raw")).join(files, [*keys, "file"]).select(
        *by, F.lit(3).alias("stage"), F.lit("file").alias("status"), "node", F.lit(1).cast("long").alias("n")
    )

    # a unique qualified name
    qualified = symbols.groupBy(*keys, "qualified").agg(F.count("*").alias("n"), F.min("id").alias("node")).filter("n = 1")
    unique = asked.withColumn("qualified", F.col("raw")).join(qualified, [*keys, "qualified"]).select(
        *by, F.lit(4).alias("stage"), F.lit("symbol").alias("status"), "node", "n"
    )

    # a name, or Type.method; code outside tests breaks a tie
    dotted = F.split("raw", "\\.")
    two = F.size(dotted) == 2
    asked_names = asked.select(*by, F.when(two, dotted[1]).otherwise(F.col("raw")).alias("name"), F.when(two, dotted[0]).alias("want_receiver"))
    candidates = asked_names.join(
        symbols.select(*keys, "name", F.col("id").alias("node"), "receiver", "kind", "is_test"), [*keys, "name"]
    ).filter(F.col("want_receiver").isNull() | (F.col("receiver") == F.col("want_receiver")))
    code = (F.col("kind") != "test") & ~F.col("is_test")
    counted = candidates.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("node").alias("only"), F.count_if(code).alias("n_code"), F.min(F.when(code, F.col("node"))).alias("code_node")
    )
    chosen = F.when(F.col("n") == 1, F.col("only")).when(F.col("n_code") == 1, F.col("code_node"))
    by_name = counted.select(
        *by, F.lit(5).alias("stage"), F.when(chosen.isNotNull(), "symbol").otherwise("ambiguous").alias("status"), chosen.alias("node"), "n"
    )

    hits = h.unionByName(line).unionByName(whole).unionByName(unique).unionByName(by_name)
    first = hits.groupBy(*by).agg(F.min_by(F.struct("status", "node", "n"), "stage").alias("v"))
    return asked.drop("raw").join(first, by, "left").select(
        *by, F.coalesce("v.status", F.lit("notfound")).alias("status"), F.col("v.node").alias("node"),
        F.coalesce("v.n", F.lit(0)).cast("long").alias("n_candidates"),
    )


# -- outlines -------------------------------------------------------------------------


def outline_lines(graph: Graph) -> DataFrame:
    """One row per symbol line of a file's outline, in file order."""
    keys = list(graph.keys)
    symbols = graph.nodes.filter(F.col("kind") != "file")
    number = F.col("start_line").cast("string")
    label = F.when(F.coalesce("receiver", F.lit("")) != "", F.concat("receiver", F.lit("."), "name")).otherwise(F.col("name"))
    text = F.concat(F.lit("  "), F.lpad(number, F.greatest(F.length(number), F.lit(5)), F.lit(" ")), F.lit("  "), F.coalesce("signature", label))
    order = Window.partitionBy(*keys, "file").orderBy("start_line", "pos")
    return symbols.select(*keys, "file", F.row_number().over(order).alias("n"), text.alias("text"))


def outline_heads(graph: Graph, imports: DataFrame, shown: int = 12) -> DataFrame:
    """Header and import line of each file that defines something."""
    keys = list(graph.keys)
    symbols = graph.nodes.filter(F.col("kind") != "file").groupBy(*keys, "file").agg(F.count("*").alias("n_symbols"))
    listing = Window.partitionBy(*keys, "file").orderBy("pos")
    specs = (
        imports.withColumn("_n", F.row_number().over(listing)).filter(F.col("_n") <= shown)
        .groupBy(*keys, "file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "spec"))), lambda s: s["spec"]), ", ").alias("specs"))
    )
    total = imports.groupBy(*keys, "file").agg(F.count("*").alias("n_imports"))
    joined = graph.files.join(symbols, [*keys, "file"]).join(specs, [*keys, "file"], "left").join(total, [*keys, "file"], "left")
    package = F.when(F.coalesce("pkg", F.lit("")) != "", F.concat(F.lit(", package "), "pkg")).otherwise("")
    head = F.concat("file", F.lit(" ("), F.col("line_count").cast("string"), F.lit(" lines"), package, F.lit(", "),
                    F.col("n_symbols").cast("string"), F.lit(" symbols)"))
    more = F.when(F.col("n_imports") > shown, F.concat(F.lit(" … +"), (F.col("n_imports") - shown).cast("string"))).otherwise("")
    return joined.select(*keys, "file", head.alias("header"), F.concat(F.lit("  imports: "), "specs", more).alias("imports"))


def outlines(graph: Graph, imports: DataFrame) -> DataFrame:
    """``(keys, file, outline)``: header, imports and one line for each symbol, as one text.

    The lines of a file are gathered; they are as many as its symbols.
    """
    keys = list(graph.keys)
    lines = outline_lines(graph).groupBy(*keys, "file").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n").alias("lines")
    )
    heads = outline_heads(graph, imports)
    return heads.join(lines, [*keys, "file"]).select(*keys, "file", F.concat_ws("\n", "header", "imports", "lines").alias("outline"))


def envelopes(graph: Graph, anchors: DataFrame | None = None) -> DataFrame:
    """Nodes one hop around a symbol: at most 12 callees, 12 non-test callers, 6 tests."""
    keys = list(graph.keys)
    rows = _outside_tests(relations(graph), graph).filter(F.col("label").isin("Calls", "Called by", "Related tests"))
    if anchors is not None:
        rows = rows.join(anchors.select(*keys, "anchor"), [*keys, "anchor"], "left_semi")
    out = ranked(rows.drop("tie"), graph.nodes, keys, ["anchor", "label"], 12)
    return out.filter((F.col("label") != "Related tests") | (F.col("rank") <= 6)).drop("truncated")
