"""Merkle manifest of a dataset: a tree for each source, one over the sources, proofs for every row.

Only every ``KEPT_EVERY``-th level of a tree is stored. What lies between is made anew from
the stored nodes of an aligned subtree when proofs are read, and thrown away after.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.session import settle

#: Nodes that make a run, and levels from one stored level up to the next.
ARITY = 3
KEPT_EVERY = 5
#: The steps from a node to a root: at each level the digests left and right of it in its run.
STEPS = "array<struct<before: array<string>, after: array<string>>>"
TEXTS = pa.list_(pa.string())
STEP_KIND = pa.list_(pa.struct([("before", TEXTS), ("after", TEXTS)]))


def digest(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: str | Column, text: str | Column | None = None) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    value = F.col(value) if isinstance(value, str) else value
    written = (value if text is None else text).cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(written).cast("string"), F.lit(":"), written))


def leaf(text: Column) -> Column:
    """Digest of a row of documents, with ``text`` in place of its text."""
    return F.sha2(F.concat(*(field(c) for c in ("doc_id", "source", "lang", "n_chars")), field(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree, leaf and tampered (the leaf of the tampered row, null where none is) of every row.

    A row is tampered with where its id's CRC-32 is even: line feeds leave its text.
    """
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        tree_name("source").alias("tree"),
        leaf(F.col("text")).alias("leaf"),
        F.when(tampered, leaf(F.replace("text", F.lit("\n"), F.lit("")))).alias("tampered"),
    )


def tree_name(source: str) -> Column:
    """A source's tree; names sort as sources do, bytewise with null first."""
    return F.when(F.col(source).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(source)))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (tree, ...) with ``place``, from 0 by ``order`` within the tree, and ``size``, the tree's rows.

    Ranges of (tree, order) are sorted apart and numbered by what lies before them, so a
    tree of any size is spread over tasks; so are equal rows, which a hash of chance parts.
    """
    chance = F.rand(11).alias("chance_")
    by = ["tree", *order, "chance_"]
    ranged = rows.select("*", chance).repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = settle(ranged.select(*rows.columns, F.spark_partition_id().alias("range_"), F.monotonically_increasing_id().alias("row_")), "manifest-order")
    parts = ranged.groupBy("tree", "range_").agg(F.min("row_").alias("first_"), F.count("*").alias("count_"))
    before = Window.partitionBy("tree").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("tree", "range_", "first_", F.coalesce(F.sum("count_").over(before), F.lit(0)).alias("before_"), F.sum("count_").over(Window.partitionBy("tree")).alias("size"))
    return ranged.join(parts, ["tree", "range_"]).select(*rows.columns, (F.col("before_") + F.col("row_") - F.col("first_")).alias("place"), "size")


def climb(nodes: list[str], size: int, every: int) -> list[list[str]]:
    """The levels of an aligned subtree from its lowest, until the next stored level or the tree's root."""
    levels = [nodes]
    while len(levels) <= every and size > 1:
        below = levels[-1]
        levels.append([digest(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
        size = -(-size // ARITY)
    return levels


def block_of(every: int) -> Column:
    """The place of the stored node above a stored node."""
    return F.floor(F.col("place") / ARITY**every).cast("long").alias("block")


def parents(nodes: DataFrame, every: int) -> DataFrame:
    """tree, place, size, digest of the next stored level of trees that have more than a root here."""

    def run(key, table):
        table = table.sort_by("place")
        size = table["size"][0].as_py()
        levels = climb(table["digest"].to_pylist(), size, every)
        for _ in levels[1:]:
            size = -(-size // ARITY)
        return pa.table({"tree": [key[0].as_py()], "place": [key[1].as_py()], "size": [size], "digest": levels[-1]}, schema=pa.schema([("tree", pa.string()), ("place", pa.int64()), ("size", pa.int64()), ("digest", pa.string())]))

    several = nodes.filter("size > 1").select("tree", "place", "size", "digest", block_of(every))
    return several.groupBy("tree", "block").applyInArrow(run, "tree string, place long, size long, digest string")


def stored_levels(lowest: DataFrame, every: int) -> list[DataFrame]:
    """The stored levels of all trees of ``lowest`` (tree, place, size, digest), each written once."""
    levels = [lowest]
    while not (above := settle(parents(levels[-1], every), "manifest-level")).isEmpty():
        levels.append(above)
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """tree, digest of each tree's root, which is the only node of its level."""
    alone = [level.filter("size = 1").select("tree", "digest") for level in levels]
    for other in alone[1:]:
        alone[0] = alone[0].unionByName(other)
    return alone[0]


def steps_below(nodes: DataFrame, above: DataFrame, every: int) -> DataFrame:
    """``nodes`` of a stored level with ``steps`` to the end of the path that their block's root has.

    ``above`` (tree, place, steps, subroot) holds the next stored level. A block's interior
    nodes are made from its stored ones; each of these takes its siblings from them, then they
    go. ``subroot`` comes down with the path.
    """
    extra = [c for c in nodes.columns if c not in ("tree", "block")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema if f.name in extra)

    def run(key, table, upper):
        table = table.drop_columns(["block"]).sort_by("place")
        rest, subroot = upper["steps"][0].as_py(), upper["subroot"][0].as_py()
        levels = climb(table["digest"].to_pylist(), table["size"][0].as_py(), every)
        paths = []
        for i in range(table.num_rows):
            path = []
            for level in levels[:-1]:
                start = i - i % ARITY
                path.append({"before": level[start:i], "after": level[i + 1 : start + ARITY]})
                i //= ARITY
            paths.append(path + rest)
        return table.append_column("steps", pa.array(paths, STEP_KIND)).append_column("subroot", pa.array([subroot] * len(paths), pa.string()))

    grouped = nodes.select("tree", *extra, block_of(every)).groupBy("tree", "block")
    heads = above.select(F.col("tree").alias("over_tree"), F.col("place").alias("over_block"), "steps", "subroot").groupBy("over_tree", "over_block")
    return grouped.cogroup(heads).applyInArrow(run, f"tree string, {kinds}, steps {STEPS}, subroot string")


def proofs(levels: list[DataFrame], tops: DataFrame, every: int) -> DataFrame:
    """The lowest level with ``steps`` and ``subroot``, from the end of each tree's path in ``tops``.

    ``tops``: tree, steps, subroot. Paths go down level by level: each block gets that of its
    root once, whatever its size.
    """
    found = None
    for level in reversed(levels):
        # a root is over itself, with no step between
        over = level.filter("size = 1").select("tree", "place").join(tops, "tree").select("tree", "place", "steps", "subroot")
        if found is not None:
            over = over.unionByName(settle(found.select("tree", "place", "steps", "subroot"), "manifest-paths"))
        found = steps_below(level, over, every)
    return found


class Manifest:
    """The stored nodes of a forest, and of the tree over its roots.

    ``levels`` are the stored levels of the sources' trees, of which the first has the leaves
    with the columns that came with them; ``upper`` are those of the tree over ``subroots``.
    """

    def __init__(self, leaves: DataFrame, *order: str, every: int = KEPT_EVERY):
        """``leaves``: tree, digest and others; ``order`` names the columns that a tree is ordered by.

        One level in ``every`` is stored.
        """
        self.every = every
        self.levels = stored_levels(settle(placed(leaves, *order, "digest"), "manifest-leaves"), every)
        self.subroots = settle(roots(self.levels), "manifest-subroots")
        over = placed(self.subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source_tree"), "digest"), "source_tree")
        self.upper = stored_levels(settle(over, "manifest-sources"), every)
        self.root = roots(self.upper).select("digest")

    def proofs(self) -> DataFrame:
        """Every leaf with its tree's ``subroot`` and its ``steps`` to the root of all."""
        end = self.root.select(F.lit("").alias("tree"), F.expr(f"CAST(array() AS {STEPS})").alias("steps"), F.lit("").alias("subroot"))
        tops = proofs(self.upper, end, self.every).select(F.col("source_tree").alias("tree"), "steps", F.col("digest").alias("subroot"))
        return proofs(self.levels, settle(tops, "manifest-tops"), self.every)


def siblings(steps: str) -> Column:
    """The digests of a proof in one text, level by level, left to right."""
    return F.array_join(F.flatten(F.transform(F.col(steps), lambda s: F.concat(s["before"], s["after"]))), "")


def folded(start: Column, steps: str) -> Column:
    """The root that ``start`` leads to with the siblings of a proof."""
    return F.aggregate(steps, start, lambda node, s: F.sha2(F.concat(F.array_join(s["before"], ""), node, F.array_join(s["after"], "")), 256))


def manifest_digests(docs: DataFrame, every: int = KEPT_EVERY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Leaves ascend by doc_id, null first; rows that share an id in a source stand next to each
    other in the order of their leaves, and equal rows are a leaf each. A null source is a
    tree of its own, before the others. Texts are read once and not shuffled. An empty table
    has no root and gives no rows; columns beside those of ``documents`` are not read. A row
    without an id is not tampered with.
    """
    made = Manifest(settle(leaves(docs).withColumnRenamed("leaf", "digest"), "manifest-rows"), "doc_id", every=every)
    root = made.root.first()
    found = made.proofs().select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        F.lit(root.digest if root else None).cast("string").alias("root"),
        F.sha2(siblings("steps"), 256).alias("proof_sha256"),
        folded(F.coalesce("tampered", "digest"), "steps").alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _written(column: str, text: str | None = None) -> str:
    text = text or f"CAST({column} AS VARCHAR)"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE CAST(strlen({text}) AS VARCHAR) || ':' || {text} END"


_LEAF = "sha256(" + " || ".join(_written(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {})"

#: The same trees with every level held, one step of recursion each.
MANIFEST_SQL = f"""
WITH RECURSIVE
given AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS tree,
    {_LEAF.format(_written("text", "text"))} AS leaf,
    {_LEAF.format(_written("text", "replace(text, chr(10), '')"))} AS tampered,
    xor(list_reduce(
      list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7],
        lambda d, k: CASE WHEN d % 2 = 1 THEN xor(d // 2, 3988292384) ELSE d // 2 END, xor(c, b)),
      4294967295), 4294967295) AS crc
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY tree) AS size
  FROM given),
nodes AS (
  SELECT tree, 0 AS level, place, size, leaf AS node FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 3, (size + 2) // 3, sha256(string_agg(node, '' ORDER BY place))
  FROM nodes WHERE size > 1 GROUP BY tree, level, place // 3, size),
subroots AS (
  SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size
  FROM nodes WHERE size = 1),
upper AS (
  SELECT 0 AS level, place, size, node FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, (size + 2) // 3, sha256(string_agg(node, '' ORDER BY place))
  FROM upper WHERE size > 1 GROUP BY level, place // 3, size),
low AS (
  SELECT tree, place AS leaf_place, 0 AS level, place, size, '' AS proof,
    CASE WHEN crc % 2 = 0 THEN tampered ELSE leaf END AS folded
  FROM leaves
  UNION ALL
  SELECT l.tree, l.leaf_place, l.level + 1, l.place // 3, (l.size + 2) // 3,
    l.proof || coalesce(string_agg(n.node, '' ORDER BY n.place) FILTER (WHERE n.place <> l.place), ''),
    sha256(string_agg(CASE WHEN n.place = l.place THEN l.folded ELSE n.node END, '' ORDER BY n.place))
  FROM low l JOIN nodes n ON n.tree = l.tree AND n.level = l.level AND n.place // 3 = l.place // 3
  WHERE l.size > 1
  GROUP BY l.tree, l.leaf_place, l.level, l.place, l.size, l.proof, l.folded),
high AS (
  SELECT l.tree, l.leaf_place, 0 AS level, s.place, s.size, l.proof, l.folded
  FROM low l JOIN subroots s ON s.tree = l.tree WHERE l.size = 1
  UNION ALL
  SELECT h.tree, h.leaf_place, h.level + 1, h.place // 3, (h.size + 2) // 3,
    h.proof || coalesce(string_agg(n.node, '' ORDER BY n.place) FILTER (WHERE n.place <> h.place), ''),
    sha256(string_agg(CASE WHEN n.place = h.place THEN h.folded ELSE n.node END, '' ORDER BY n.place))
  FROM high h JOIN upper n ON n.level = h.level AND n.place // 3 = h.place // 3
  WHERE h.size > 1
  GROUP BY h.tree, h.leaf_place, h.level, h.place, h.size, h.proof, h.folded)
SELECT l.doc_id, l.leaf, s.node AS subroot, r.node AS root, sha256(h.proof) AS proof_sha256,
  h.folded AS folded_root, h.folded = r.node AS verified
FROM leaves l
JOIN subroots s ON s.tree = l.tree
JOIN high h ON h.size = 1 AND h.tree = l.tree AND h.leaf_place = l.place
CROSS JOIN (SELECT node FROM upper WHERE size = 1) r
"""
