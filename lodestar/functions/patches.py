"""Unified diffs as rows of changed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.constants import TEST_PATH_PATTERN


def _clean(path: Column) -> Column:
    """Unquote a git path and drop its ``a/`` or ``b/`` prefix."""
    trimmed = F.btrim(path, F.lit(" \t\r"))
    inner = F.substring(trimmed, F.lit(2), F.length(trimmed) - 2)
    unescaped = F.replace(F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")), F.lit("\\t"), F.lit("\t"))
    quoted = trimmed.startswith('"') & trimmed.endswith('"')
    return F.regexp_replace(F.when(quoted, unescaped).otherwise(trimmed), "^[ab]/", "")


def patch_files(patches: DataFrame, key: str, patch: str = "patch") -> DataFrame:
    """``(key, ord, path, status)`` for every file section of each diff.

    A diff is cut at its section headers, and each section is read by its marker lines;
    the last marker of a kind decides, as in a sequential reading. Sections are exploded
    before they are parsed, so one large diff spreads over many rows.
    """
    parts = F.split(F.concat(F.lit("\n"), F.col(patch)), "\ndiff --git ")
    sections = patches.filter(F.col(patch) != "").select(key, F.posexplode(parts).alias("ord", "section")).filter("ord > 0")
    header = F.substring_index("section", "\n", 1)
    body = F.slice(F.split("section", "\n"), F.lit(2), F.size(F.split("section", "\n")))

    def value_after(prefix):
        hits = F.filter(body, lambda line: line.startswith(prefix))
        return F.substring(F.try_element_at(hits, F.lit(-1)), F.lit(len(prefix) + 1), F.lit(1_000_000))

    def marker(line):
        rest = F.btrim(F.substring(line, F.lit(5), F.length(line)), F.lit(" \t\r"))
        gone = rest == "/dev/null"
        return (
            F.when(line.startswith("new file mode") | (line.startswith("--- ") & gone), "added")
            .when(line.startswith("deleted file mode") | (line.startswith("+++ ") & gone), "deleted")
        )

    marks = F.array_compact(F.transform(body, marker))
    cut = F.length(header) - F.length(F.substring_index(header, " b/", -1)) - 3
    split_at = F.when(header.contains(" b/"), cut)
    old = F.when(split_at.isNotNull(), F.left(header, split_at)).otherwise(header)
    new = F.when(split_at.isNotNull(), F.substring(header, split_at + 2, F.length(header))).otherwise(header)
    read = sections.select(
        key,
        "ord",
        F.coalesce(_clean(value_after("rename from ")), _clean(old)).alias("a"),
        F.coalesce(_clean(value_after("rename to ")), _clean(new)).alias("b"),
        F.coalesce(F.try_element_at(marks, F.lit(-1)), F.lit("modified")).alias("status"),
    )
    path = F.when(F.col("status") == "deleted", F.col("a")).otherwise(F.coalesce("b", "a"))
    return read.select(key, "ord", path.alias("path"), "status").filter((F.col("path") != "") & (F.col("path") != "/dev/null"))


def changed_files(patches: DataFrame, key: str, patch: str = "patch") -> DataFrame:
    return patch_files(patches, key, patch).select(key, F.col("path").alias("file")).distinct()


def is_test_path(path) -> Column:
    return (F.col(path) if isinstance(path, str) else path).rlike(TEST_PATH_PATTERN)
