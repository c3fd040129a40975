"""Source text as a relation of tokens.

A regular expression cuts each file into tokens on the JVM; scans of the tokens of a file
give line numbers, nesting depth and neighbours, from which the facts are read with
ordinary filters and aggregates. The text is repartitioned by file once, before it is cut,
so the much larger token table is never shuffled. A task holds the tokens of a file; its
size has no bound but the one that the listing of files was given.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Files whose tokens are sent to a Python worker at once.
BATCH_FILES = 100
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

IDENTIFIER = r"[\p{L}_$][\p{L}\p{N}_$]*"
SPACE = r"\s*+"
BLANKS = " \t\r\n\f\u000b"
LINE_COMMENT = r"//[^\n]*+"
BLOCK_COMMENT = r"/\*[\s\S]*?(?:\*/|\z)"
DOUBLE_QUOTED = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?'
SINGLE_QUOTED = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?"
RAW_QUOTED = r"`[^`]*+`?"
TEMPLATE = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`?"
NUMBER = r"\.?[0-9][\p{L}\p{N}_.]*+"
# A slash starts a pattern only where an operand is expected.
REGEX_LITERAL = r"(?<=[(,=:\[!&|?{};+\n]\s{0,8})/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+"

# Every token carries the blanks before it, so that blanks take no rows of their own.
GO_TOKENS = SPACE + "(?:" + "|".join(
    [LINE_COMMENT, BLOCK_COMMENT, DOUBLE_QUOTED, SINGLE_QUOTED, RAW_QUOTED, IDENTIFIER, NUMBER, r":=|\.\.\.|<-|==|!=|<=|>=|&&|\|\|", r"\S"]
) + ")"
TS_TOKENS = SPACE + "(?:" + "|".join(
    [LINE_COMMENT, BLOCK_COMMENT, REGEX_LITERAL, DOUBLE_QUOTED, SINGLE_QUOTED, TEMPLATE, IDENTIFIER, NUMBER, r"=>|\.\.\.|\?\.|===|!==|==|!=|<=|>=|&&|\|\||\?\?", r"\S"]
) + ")"


def in_file(keys) -> Window:
    return Window.partitionBy(*keys, "file").orderBy("i")


class Tokens:
    """The tokens of some whole files in a task, as arrays; what looks along a file is a scan of one."""

    def __init__(self, raws: pa.ListArray):
        lengths = np.asarray(pc.fill_null(pc.list_value_length(raws), 0), np.int64)
        raw = raws.flatten()
        row = np.repeat(np.arange(len(lengths)), lengths)
        tok = pc.utf8_ltrim(raw, characters=BLANKS)
        size, breaks, own = _ints(pc.utf8_length(raw)), _ints(pc.count_substring(raw, "\n")), _ints(pc.count_substring(tok, "\n"))
        first = (np.cumsum(lengths) - lengths)[row]

        def before(steps):
            total = np.cumsum(steps) - steps
            return total - total[first] if len(total) else total

        off, line = before(size) + size - _ints(pc.utf8_length(tok)), before(breaks) + breaks - own + 1
        kept = np.flatnonzero(~_flags(pc.or_(pc.starts_with(tok, "//"), pc.starts_with(tok, "/*"))))
        #: for each token: which of the files it stands in, its place among all of the file's tokens, and so on
        self.row, self.i, self.off, self.line = row[kept], (np.arange(len(row)) - first)[kept], off[kept], line[kept]
        self.endl, self.tok = self.line + own[kept], tok.take(pa.array(kept))
        n = len(kept)
        self.n, self.at = n, np.arange(n)
        starts = np.ones(n, bool)
        starts[1:] = self.row[1:] != self.row[:-1]
        self.start = np.maximum.accumulate(np.where(starts, self.at, 0)) if n else self.at
        self.stop = np.append(np.flatnonzero(starts), n)[np.cumsum(starts)] if n else self.at
        self.fol = starts | (np.roll(self.endl, 1) < self.line)
        self.d, self.p, self.b = self.depth("{", "}"), self.depth("(", ")"), self.depth("[", "]")
        self.ident = _flags(pc.match_substring_regex(self.tok, "^[\\p{L}_$]"))
        quoted, number = pc.match_substring_regex(self.tok, "^[\"'`]"), pc.match_substring_regex(self.tok, r"^\.?[0-9]")
        #: place in :data:`CLASSES`, told by how the token begins
        self.cls = np.select([_flags(quoted), self.ident, _flags(number)], [0, 1, 2], 3)

    def among(self, *texts: str) -> np.ndarray:
        return _flags(pc.is_in(self.tok, value_set=pa.array(texts, pa.string())))

    def depth(self, opening: str, closing: str) -> np.ndarray:
        """Open brackets around each token; a closing one stands at the depth of its partner."""
        closes = self.among(closing)
        steps = self.among(opening).astype(np.int64) - closes
        total = np.cumsum(steps) - steps
        return total - total[self.start] - closes if self.n else total

    def beside(self, places: int) -> np.ndarray:
        """Index of the token so many places on in the same file, else -1."""
        to = self.at + places
        return np.where((to >= self.start) & (to < self.stop), to, -1)

    def last(self, marked: np.ndarray) -> np.ndarray:
        """Index of the last marked token up to each, within its file, else -1."""
        found = np.maximum.accumulate(np.where(marked, self.at, -1)) if self.n else self.at
        return np.where(found < self.start, -1, found)

    def next(self, marked: np.ndarray) -> np.ndarray:
        """Index of the first marked token after each, within its file, else -1."""
        found = np.minimum.accumulate(np.append(np.where(marked, self.at, self.n), self.n)[::-1])[::-1][1:]
        return np.where(found < self.stop, found, -1)

    def opener(self) -> np.ndarray:
        """Index of the parenthesis that each token stands in, or is, else the last one of its level, else -1."""
        opens = self.among("(")
        level = np.where(opens, self.p + 1, self.p)
        order = np.lexsort((self.at, level, self.row))
        same = np.ones(self.n, bool)
        same[1:] = (level[order][1:] != level[order][:-1]) | (self.row[order][1:] != self.row[order][:-1])
        group = np.maximum.accumulate(np.where(same, self.at, 0)) if self.n else self.at
        found = np.maximum.accumulate(np.where(opens[order], self.at, -1)) if self.n else self.at
        out = np.empty(self.n, np.int64)
        out[order] = np.where(found < group, -1, order[found])
        return out

    def text(self, index: np.ndarray) -> pa.Array:
        """The tokens at ``index``, null for -1."""
        return self.tok.take(pa.array(index, mask=index < 0))

    def is_at(self, index: np.ndarray, *texts: str) -> np.ndarray:
        """Whether the token at ``index`` is one of ``texts``; no token is none of them."""
        return (index >= 0) & self.among(*texts)[index] if self.n else index >= 0


def _ints(values) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.int64)


def _flags(values) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(bool)


def taken(values: np.ndarray, index: np.ndarray) -> pa.Array:
    """``values`` at ``index``, null for -1."""
    return pa.array(values[index] if len(values) else values, mask=index < 0)


#: Tokens that a task holds as arrays at once, unless one file has more.
TOKENS_AT_ONCE = 200_000
TOKEN_SCHEMA = (
    "i int, tok string, off bigint, line bigint, endl bigint, fol boolean, d bigint, p bigint, b bigint, prev1 string, prev2 string, prev3 string, "
    "next1 string, next2 string, next3 string, next4 string, open_prev1 string, open_prev2 string, open_at int, open_d bigint, "
    "cls string, prev_cls string, prev_cls2 string, next_cls string, next_cls2 string"
)
CLASSES = ("string", "ident", "number", "op")


def _columns(t: Tokens) -> list:
    beside = [t.text(t.beside(k)) for k in (-1, -2, -3, 1, 2, 3, 4)]
    opener = t.opener()
    around = [taken(t.beside(k), opener) for k in (-1, -2)] if t.n else [pa.array([], pa.int64())] * 2
    opened = [t.text(np.asarray(pc.fill_null(k, -1), np.int64)) for k in around]
    places = [pa.array(t.i.astype(np.int32)), t.tok, *(pa.array(x) for x in (t.off, t.line, t.endl, t.fol, t.d, t.p, t.b))]
    classes = pa.array(CLASSES)
    cls = [classes.take(taken(t.cls, t.beside(k))) for k in (0, -1, -2, 1, 2)]
    return [*places, *beside, *opened, taken(t.i.astype(np.int32), opener), taken(t.d, opener), *cls]


def tokenize(files: DataFrame, pattern: str, keys=(), more=None, more_schema: str = "") -> DataFrame:
    """Significant tokens of ``files(keys, file, content)`` with position and nesting.

    ``i`` index, ``off`` character offset, ``line``, ``endl`` last line, ``fol`` first on
    its line, ``d``/``p``/``b`` depth of braces, parentheses and brackets outside the
    token, ``prev1..3`` and ``next1..4`` neighbouring tokens, and what precedes the
    parenthesis each token stands in (``open_prev1``, ``open_prev2``; ``open_at``, ``open_d``
    its place); ``cls`` and those of neighbours. ``more(tokens)`` gives further columns of ``more_schema`` from :class:`Tokens`.

    The expression cuts texts on the JVM; the tokens of a file are then scanned as arrays
    in the task that has the file, so they are neither dealt nor sorted.
    """
    keys = list(keys)
    spark = files.sparkSession
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_FILES:
        spark.conf.set(BATCH_SETTING, str(BATCH_FILES))
    # A fixed count: sized by its compressed text alone, a partition would be merged with
    # others before its text grows into tokens.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = files.repartition(parts, *keys, "file")
    cut = placed.select(*keys, "file", F.regexp_extract_all("content", F.lit(pattern), F.lit(0)).alias("raws"))
    schema = StructType(cut.schema.fields[:-1] + StructType.fromDDL(TOKEN_SCHEMA + (", " + more_schema if more_schema else "")).fields)
    names, own = schema.names, len(keys) + 1

    def run(batches):
        for batch in batches:
            counts = np.asarray(pc.fill_null(pc.list_value_length(batch.column(own)), 0), np.int64)
            share = (np.cumsum(counts) - counts) // TOKENS_AT_ONCE
            for n in np.unique(share):
                first, last = np.searchsorted(share, n), np.searchsorted(share, n, side="right")
                some = batch.slice(first, last - first)
                t = Tokens(some.column(own))
                found = _columns(t) + (more(t) if more else [])
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(t.row)) for c in some.columns[:own]), *found], names=names)

    return cut.mapInArrow(run, schema)


def next_value(value: Column, keys, *levels) -> Column:
    """First non-null ``value`` after the token, within its file and, if given, nesting levels.

    Read backwards as a running last value; a frame that looks forward would be
    evaluated anew for every row.
    """
    backwards = Window.partitionBy(*keys, "file", *levels).orderBy(F.col("i").desc())
    return F.last(value, True).over(backwards.rowsBetween(Window.unboundedPreceding, -1))


def with_blocks(tokens: DataFrame, keys=()) -> DataFrame:
    """Add to each opening brace where its block ends (``close_i``, ``close_end``, ``close_line``).

    Opening and closing braces of one level alternate, so the partner is the next brace
    of the level. All windows keep the partitioning by file. Blocks that follow each other directly, as a braced return type and
    the body after it, count as one.
    """
    by_level = [*keys, "file", "d", "_brace"]
    level = Window.partitionBy(*by_level).orderBy("i")
    opening = F.col("tok") == "{"
    joined = (F.col("prev1") == "}") | (F.col("prev1").isin("|", "&") & (F.col("prev2") == "}"))
    starts_run = F.when(opening & ~F.coalesce(joined, F.lit(False)), 1).otherwise(0)
    partner = F.lead(F.struct("i", "line", F.col("off").alias("end"))).over(level)
    marked = tokens.withColumn("_brace", F.col("tok").isin("{", "}")).select(
        "*", F.when(opening, partner).alias("_close"), F.sum(starts_run).over(level.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_run")
    )
    last = F.max("_close").over(Window.partitionBy(*by_level, "_run"))
    return marked.withColumn("_last", F.when(opening, last)).select(
        *tokens.columns,
        F.col("_last.i").alias("close_i"),
        F.col("_last.line").alias("close_line"),
        (F.col("_last.end") + 1).alias("close_end"),
    )


def innermost(points: DataFrame, spans: DataFrame, on_file: list, values: dict, start_in=False, end_in=False) -> DataFrame:
    """``points(on_file, i)`` with ``values`` (name: column of ``spans``) of the innermost span around each, else null.

    ``spans(on_file, start_i, end_i)`` lie within each other or apart, like brackets; so where
    they open and close gives each place its depth, and the span around a place is the last
    one that opened at this depth. Two windows over the file take time in proportion to points
    and spans. ``start_in`` and ``end_in`` say whether a point on a span's end lies in it.
    """
    carried = F.struct(*[F.col(c).alias(name) for name, c in values.items()])
    none = F.lit(None).cast(spans.select(carried.alias("s")).schema["s"].dataType)
    opens = spans.select(*on_file, F.col("start_i").alias("i"), F.lit(1 if start_in else 3).alias("turn"), F.lit(1).alias("step"), (-F.col("end_i")).alias("wide"), carried.alias("span"))
    closes = spans.select(*on_file, F.col("end_i").alias("i"), F.lit(4 if end_in else 0).alias("turn"), F.lit(-1).alias("step"), F.lit(0).cast("long").alias("wide"), none.alias("span"))
    asked = points.select(*on_file, "i").distinct().select(*on_file, "i", F.lit(2).alias("turn"), F.lit(0).alias("step"), F.lit(0).cast("long").alias("wide"), none.alias("span"))
    order = ("i", "turn", "wide")
    upto = Window.partitionBy(*on_file).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = Window.partitionBy(*on_file, "_deep").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deep = opens.unionByName(closes).unionByName(asked).withColumn("_deep", F.sum("step").over(upto))
    # a closing row stands at the depth outside, where it must not hide what is open there
    found = deep.withColumn("_in", F.last(F.when(F.col("step") == 1, F.col("span")), True).over(level))
    inside = F.when(F.col("_deep") > 0, F.col("_in"))
    return found.filter(F.col("turn") == 2).select(*on_file, "i", *[inside[name].alias(name) for name in values])


def node_text(content: Column, start: Column, end: Column) -> Column:
    return F.substring(content, start + 1, end - start)
