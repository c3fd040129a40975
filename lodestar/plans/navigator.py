"""One repository behind a small question-and-answer surface.

Every answer is capped, so turning it into text collects a bounded number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import render
from lodestar.functions.paths import normalize_anchor
from lodestar.operators import cochange, filegraph, fusion, fuzzy, navigate, resolve, validate, walk
from lodestar.plans.indexing import index_repository, reindex
from lodestar.session import settle

GROUP_ORDER = (
    "Defined here", "Related code", "Used by", "Calls", "Called by", "Uses types", "Implementations", "Related tests",
    "Direct callers", "Indirect callers", "Tests covering the change",
)
RELATION_CAP = 20


class Navigator:
    """Structural answers about one indexed repository."""

    enabled = True

    def __init__(self, facts: resolve.Facts, graph: resolve.Graph, known: DataFrame, commits: DataFrame | None = None, root: str = ""):
        self.facts, self.known, self.commits, self.root = facts, known, commits, root
        self._use(graph)

    @classmethod
    def index(cls, spark: SparkSession, root: str, commits: DataFrame | None = None) -> Navigator:
        facts, graph, known = index_repository(spark, root)
        return cls(facts, graph, known, commits, root)

    def _use(self, graph: resolve.Graph) -> None:
        self.graph = resolve.Graph(
            settle(graph.nodes, "nodes"), settle(graph.edges, "edges"), graph.files, graph.unresolved, graph.keys
        )
        self.file_edges = settle(filegraph.roll_up(filegraph.with_files(self.graph.edges, self.graph.nodes)), "file_edges")

    @property
    def spark(self) -> SparkSession:
        return self.graph.nodes.sparkSession

    def _ask(self, *anchors: str) -> DataFrame:
        rows = self.spark.createDataFrame([(a,) for a in anchors], "query STRING")
        return rows.withColumn("query", normalize_anchor("query", self.root or "/"))

    def resolve(self, anchor: str):
        """Row of (query, status, node, n_candidates)."""
        return navigate.resolve_anchors(self.graph, self._ask(anchor)).first()

    def _one(self, node: str) -> DataFrame:
        return self.spark.createDataFrame([(node,)], "anchor STRING")

    def expand(self, anchor: str, per_group: int = 8) -> DataFrame:
        """Labelled neighbours of a file or symbol; nothing for an anchor that is not known."""
        found = self.resolve(anchor)
        return navigate.neighbors(self.graph, self._one(found["node"] or ""), per_group)

    def alternatives(self, anchor: str) -> tuple[DataFrame, DataFrame]:
        """What an unknown anchor may have meant: existing paths, existing symbols."""
        return self.path_candidates(anchor), self.symbol_candidates(anchor)

    def find(self, name: str) -> DataFrame:
        terms = self._ask(name).withColumnRenamed("query", "term")
        return fuzzy.find_symbols(self.graph.nodes, terms)

    def symbol_candidates(self, term: str, limit: int = 6) -> DataFrame:
        return self.find(term).orderBy(F.col("score").desc(), "node").limit(limit)

    def path_candidates(self, path: str, limit: int = 5) -> DataFrame:
        return fuzzy.path_candidates(self.facts.files, self._ask(path).withColumnRenamed("query", "guess"), limit=limit)

    def relation(self, anchor: str, kind: str) -> DataFrame:
        """``callers``, ``callees`` or ``tests`` of a symbol, or of all a file defines. Uncapped."""
        node = self.resolve(anchor)["node"] or ""
        label = {"callers": "Called by", "callees": "Calls", "tests": "Related tests"}[kind]
        if node.startswith("file:"):
            return navigate.relation_of_files(self.graph, kind).filter(F.col("anchor") == node)
        rows = navigate.relations(self.graph).filter((F.col("anchor") == node) & (F.col("label") == label))
        return navigate.ranked(rows.drop("tie"), self.graph.nodes, [], ["anchor", "label"], None)

    def callers(self, anchor: str) -> DataFrame:
        return self.relation(anchor, "callers")

    def callees(self, anchor: str) -> DataFrame:
        return self.relation(anchor, "callees")

    def tests_for(self, anchor: str) -> DataFrame:
        return self.relation(anchor, "tests")

    def _changed(self, files) -> DataFrame:
        return self.spark.createDataFrame([("edit", f, i) for i, f in enumerate(files)], "change STRING, file STRING, ord INT")

    def impact(self, files) -> DataFrame:
        return navigate.impact(self.graph, self._changed(files))

    def covering_tests(self, files) -> DataFrame:
        return navigate.covering_test_files(self.graph, self._changed(files)).select("test_file")

    def related_files(self, anchor: str, limit: int = 5) -> DataFrame:
        """Files that usually change with the anchor's file: walk and history, fused."""
        query = self._ask(anchor)
        known = query.join(self.known.select(F.col("file").alias("query")), "query", "left_semi").first()
        node = None if known else self.resolve(anchor)["node"]
        file = known["query"] if known else (node or "").split("#")[0].partition(":")[2]
        anchors = self._one(file)
        columns = ["anchor", "file", "rank"]
        votes = walk.ppr_ranked(self.file_edges, anchors, limit).select(*columns)
        if self.commits is not None:
            index = cochange.build_co_change(self.commits)
            votes = votes.unionByName(cochange.co_change_ranked(index, anchors, limit).select(*columns))
        return fusion.fuse(votes, limit)

    def outline(self, file: str) -> str:
        heads = navigate.outline_heads(self.graph, self.facts.imports).filter(F.col("file") == file).collect()
        if not heads:
            return ""
        lines = navigate.outline_lines(self.graph).filter(F.col("file") == file).orderBy("n").collect()
        return "\n".join([*[t for t in (heads[0]["header"], heads[0]["imports"]) if t], *[r["text"] for r in lines]])

    def envelope(self, anchor: str) -> DataFrame | None:
        node = self.resolve(anchor)["node"]
        if node is None or node.startswith("file:"):
            return None
        return navigate.envelopes(self.graph, self._one(node))

    def unknown_symbols(self, file: str) -> DataFrame:
        return validate.unknown_symbols(self.facts, self.graph).filter(F.col("file") == file)

    def note_edit(self, changed: DataFrame, removed: DataFrame | None = None) -> None:
        """Take in ``changed(file, content)``: facts, graph and file graph are rebuilt."""
        self.facts = reindex(self.facts, changed, removed)
        self._use(resolve.resolve(self.facts))

    def text(self, groups: DataFrame) -> str:
        """Capped groups of one answer as text."""
        if "truncated" not in groups.columns:
            shown = groups.filter(F.col("rank") <= RELATION_CAP)
            extra = F.greatest(F.lit(0), F.lit(groups.count() - RELATION_CAP))
            groups = shown.withColumn("truncated", extra)
        rows = render.group_lines(groups, self.graph.nodes, []).collect()
        place = {label: i for i, label in enumerate(GROUP_ORDER)}
        rows.sort(key=lambda r: (place.get(r["label"], len(place)), r["n"]))
        return "\n".join(r["text"] for r in rows)

    def unknown_text(self, file: str) -> str:
        rows = render.unknown_lines(self.unknown_symbols(file)).orderBy("pos").collect()
        if not rows:
            return ""
        return "\n".join([f"This edit references {len(rows)} symbol(s) that do not exist:", *[r["text"] for r in rows]])


class NullNavigator:
    """The same surface without a graph: every answer is empty."""

    enabled = False

    def __init__(self, spark: SparkSession):
        self._empty = spark.createDataFrame([], "node STRING, file STRING, rank INT")

    def __getattr__(self, name):
        if name in ("outline", "text", "unknown_text"):
            return lambda *a, **k: ""
        if name == "envelope":
            return lambda *a, **k: None
        if name.startswith("_") or not hasattr(Navigator, name):
            raise AttributeError(name)
        return lambda *a, **k: self._empty
