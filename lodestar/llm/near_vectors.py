"""Near duplicates among vectors: an exact metric range join over blocks of pivot cells."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lodestar.llm.components import components
from lodestar.session import settle

#: Least cosine of a link.
COSINE = 0.93
#: Vectors a cell should hold, and the most pivots a label gets.
CELL, MOST_PIVOTS = 4096, 64
#: Vectors of a cell that one task compares with as many others.
BLOCK = 1024
#: Vectors of a label that one task compares with its pivots.
SHARE = 20_000
#: Bytes of the rows that go to a Python worker at once, and the setting for it.
MOST_BATCH, BATCH_BYTES = "16m", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rounding that distances may carry.
SLACK = 1e-9


def reach(cosine: float) -> float:
    """Distance of two unit vectors that have this cosine."""
    return math.sqrt(2 - 2 * cosine)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the unit vector as bytes of doubles, null where there is none.

    There is none for null or zero vectors, or with null or non-finite components.
    """

    def run(batches):
        for batch in batches:
            units = []
            for v in batch.column("embedding").to_pylist():
                unit = None
                if v and None not in v:
                    x = np.array(v, np.float64)
                    top = np.abs(x).max()
                    if np.isfinite(x).all() and top > 0:
                        x = x / top  # squares of very large or small numbers stay in range
                        unit = (x / np.sqrt(x @ x)).tobytes()
                units.append(unit)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(units, pa.binary())], names=["vec_id", "label", "unit"])

    schema = vectors.select("vec_id", "label").schema.add("unit", "binary")
    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, schema)


def rows_of(units) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1)


def cells(reps: DataFrame) -> DataFrame:
    """Each vector in one cell: that of its nearest pivot.

    A label has as many pivots as it needs for cells of ``CELL`` vectors, ``MOST_PIVOTS`` at
    most; with one, its vectors share a cell, and ``large`` is false.
    """
    keys = ["label", "width"]
    sizes = reps.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("parts", F.least(F.lit(MOST_PIVOTS), F.ceil(F.col("n") / CELL)))
    sized = reps.join(sizes.withColumn("shares", F.ceil(F.col("n") / SHARE)), keys)
    small = sized.filter("parts = 1").select(*reps.columns, F.lit(0).cast("long").alias("cell"), F.lit(False).alias("large"))
    large = sized.filter("parts > 1").withColumn("share", F.pmod(F.xxhash64("rep", F.lit(3)), "shares"))
    pivots = large.filter(F.pmod(F.xxhash64("rep", F.lit(1)), F.ceil(F.col("n") / F.col("parts"))) == 0)
    heads = pivots.groupBy(*keys).agg(F.max("shares").alias("shares"), F.sort_array(F.collect_list("unit")).alias("pivots"))
    heads = heads.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")
    rows = large.select(*reps.columns, "share", F.lit(None).cast("array<binary>").alias("pivots"), F.lit(1).alias("side")).unionByName(
        heads.withColumn("side", F.lit(0)), allowMissingColumns=True
    )
    kept = reps.columns

    def run(batches):
        head, pivot = None, None
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in (*keys, "share", "side")), strict=True))
            at = 0
            while at < batch.num_rows:
                end = at + 1
                while end < batch.num_rows and names[end] == names[at]:
                    end += 1
                if names[at][3] == 0:
                    head, pivot = names[at][:3], rows_of(batch.column("pivots")[at].as_py())
                else:
                    part = batch.slice(at, end - at).select(kept)
                    cell = np.zeros(end - at, np.int64)  # by chance the hash may have picked no pivot
                    if head == names[at][:3]:
                        cell = (rows_of(part.column("unit").to_pylist()) @ pivot.T).argmax(axis=1).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(np.ones(end - at, bool))], names=[*kept, "cell", "large"])
                at = end

    placed = rows.repartition(*keys, "share").sortWithinPartitions(*keys, "share", "side")
    return small.unionByName(placed.mapInArrow(run, small.schema))


def forest(ids: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> dict[int, int]:
    """The least id that each end of ``pairs`` (indexes into ``ids``) reaches."""
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while up.setdefault(i, i) != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in zip(*(p.tolist() for p in pairs), strict=True):
        a, b = root(i), root(j)
        if a != b:
            if ids[a] < ids[b]:
                a, b = b, a
            up[a] = b
    return {int(ids[i]): int(ids[root(i)]) for i in list(up)}


def linked(x: np.ndarray, y: np.ndarray, near: np.ndarray, counts: dict[int, int]) -> list[tuple[int, int, int]]:
    """rep, links and root of what ``counts`` or a tree over the ``near`` pairs of ``x`` and ``y`` name."""
    i, j = np.nonzero(near)
    code = np.unique(np.concatenate([x, y]), return_inverse=True)
    tree = forest(code[0], (code[1][i], code[1][len(x) + j]))
    return [(r, counts.get(r, 0), tree.get(r, r)) for r in {*counts, *tree} if counts.get(r, 0) or tree.get(r, r) != r]


def links(placed: DataFrame, cosine: float) -> DataFrame:
    """rep, links and root: for every vector of a label of one cell, its links and a tree over them.

    A cell is compared block by block, so a task holds two blocks whatever the cell's size.
    Only the links' number and a spanning forest leave a task, never the pairs.
    """
    keys = ["label", "width"]
    sizes = placed.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = placed.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(2)), "blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = dealt.withColumn("other", every).withColumn("side", F.lit(0))
    right = dealt.withColumn("other", F.col("block")).withColumn("block", every).withColumn("side", F.lit(1))
    both = left.unionByName(right).select(*keys, "block", "other", "side", "rep", "unit", "copies")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        one, two = frame[frame["side"] == 0], frame[frame["side"] == 1]
        if one.empty or two.empty:
            return pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
        a, b, copies = rows_of(list(one["unit"])), rows_of(list(two["unit"])), two["copies"].to_numpy()
        x, y = one["rep"].to_numpy(), two["rep"].to_numpy()
        near = (a @ b.T >= cosine) & (x[:, None] != y[None, :])
        counts = dict(zip(x.tolist(), (near.astype(np.int64) @ copies).tolist(), strict=True))
        return pd.DataFrame(linked(x, y, near, counts), columns=["rep", "links", "root"]).astype("int64")

    return both.groupBy(*keys, "block", "other").applyInPandas(run, "rep long, links long, root long")


def far_links(placed: DataFrame, cosine: float) -> DataFrame:
    """Like ``links``, for labels of many cells, without a copy of a vector for each block that it meets.

    A block of a cell is one row, written once; the pairs of blocks are read from there by a
    product of partitions, which shuffles nothing, so disk grows with the vectors alone. Two
    blocks are compared unless their centres are further apart than their radii and the reach
    of a link.
    """
    keys = ["label", "width"]
    placed.sparkSession.conf.set(BATCH_BYTES, MOST_BATCH)  # a row holds two blocks
    sizes = placed.groupBy(*keys, "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = placed.join(sizes, [*keys, "cell"]).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(2)), "blocks"))
    schema = placed.select(*keys, "cell").schema.add("block", "long").add("rep", "binary").add("copies", "binary").add("unit", "binary").add("centre", ArrayType(DoubleType())).add("radius", "double")

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x = rows_of(list(frame["unit"]))
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
        rows = [(*key, *(frame[c].to_numpy().astype(np.int64).tobytes() for c in ("rep", "copies")), x.tobytes(), centre.tolist(), radius)]
        return pd.DataFrame(rows, columns=schema.names)

    packed = settle(dealt.select(*keys, "cell", "block", "rep", "copies", "unit").groupBy(*keys, "cell", "block").applyInPandas(pack, schema), "vector-blocks")
    one, two = (packed.select(*(F.col(c).alias(f"{side}_{c}") for c in packed.columns)) for side in "ab")
    apart = F.sqrt(F.aggregate(F.zip_with("a_centre", "b_centre", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, d: t + d))
    meet = (
        (F.col("a_label") == F.col("b_label"))
        & (F.col("a_width") == F.col("b_width"))
        & (F.struct("a_cell", "a_block") <= F.struct(F.col("b_cell").alias("a_cell"), F.col("b_block").alias("a_block")))
        & (apart <= F.col("a_radius") + F.col("b_radius") + reach(cosine) + SLACK)
    )
    pairs = one.hint("shuffle_replicate_nl").join(two, meet).withColumn("same", (F.col("a_cell") == F.col("b_cell")) & (F.col("a_block") == F.col("b_block")))
    columns = [f"{side}_{c}" for side in "ab" for c in ("rep", "copies", "unit")]

    def run(batches):
        for batch in batches:
            for same, *row in zip(batch.column("same").to_pylist(), *(batch.column(c) for c in columns), strict=True):
                x, some, a, y, others, b = (np.frombuffer(v.as_py(), np.float64 if c.endswith("unit") else np.int64) for v, c in zip(row, columns, strict=True))
                near = (a.reshape(len(x), -1) @ b.reshape(len(y), -1).T >= cosine) & (x[:, None] != y[None, :])
                if not near.any():
                    continue
                counts = dict(zip(x.tolist(), (near.astype(np.int64) @ others).tolist(), strict=True))
                if not same:
                    for r, n in zip(y.tolist(), (near.T.astype(np.int64) @ some).tolist(), strict=True):
                        counts[r] = counts.get(r, 0) + n
                rep, links, root = zip(*linked(x, y, near, counts), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (rep, links, root)], names=["rep", "links", "root"])

    return pairs.select("same", *columns).mapInArrow(run, "rep long, links long, root long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding, label).

    Two rows are linked if their labels are equal and not null and their cosine, in doubles,
    is at least ``cosine`` (above 0). Null, zero and non-finite vectors, and rows without a vec_id,
    link with nothing.
    Rows of one label and unit vector are joined as one, with their number. Vectors of
    different lengths are never linked. Repeated rows are one vector and have its result each;
    rows that share a vec_id but not label and direction are vectors of their own, with links
    of their own, in one component. An empty table gives no rows; other columns are not read.
    """
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    units = settle(unit_vectors(given).withColumn("mark", F.unhex(F.sha2("unit", 256))), "vectors")
    able = units.filter("label IS NOT NULL AND unit IS NOT NULL AND vec_id IS NOT NULL")
    copies = able.groupBy("label", "mark").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("copies"))
    reps = able.groupBy("label", "mark").agg(F.any_value("unit").alias("unit")).join(copies, ["label", "mark"])
    reps = settle(reps.withColumn("width", F.length("unit")), "vector-reps")
    marks = able.select("vec_id", "label", "mark")
    placed = settle(cells(reps.drop("mark")), "vector-cells")
    found = settle(links(placed.filter("NOT large"), cosine).unionByName(far_links(placed.filter("large"), cosine)), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    tied = marks.join(reps.select("label", "mark", "rep"), ["label", "mark"]).filter("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    named = reps.select(F.col("rep").alias("vec_id")).unionByName(tied.select(F.col("a").alias("vec_id"))).groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1")
    # an id of several vectors ties their components; others need no row
    ties = tied.join(named.select(F.col("vec_id").alias("a")), "a", "left_semi")
    group = components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(ties))
    classes = (
        reps.join(counts, "rep", "left")
        .join(group.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "mark", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    known = marks.join(classes, ["label", "mark"]).select("vec_id", "n_links", "component_id")
    alone = units.filter("label IS NULL OR unit IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
