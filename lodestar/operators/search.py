"""Regular-expression and glob search over file contents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.constants import MAX_GLOB_SHOWN, MAX_GREP_RESULTS
from lodestar.functions.text import lines


def glob_pattern(glob: str) -> str:
    """A path regex for ``**/`` (optional directories), ``**``, ``*`` and ``?``."""
    rules = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    pieces = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    return "^" + "".join(rules.get(p, re.sub(r"[.+^${}()|\[\]\\]", r"\\\g<0>", p)) for p in pieces) + "$"


def portable_pattern(pattern: str) -> str:
    """Give ``\\b`` its ASCII meaning, as in the search dialect users write.

    The JVM counts accented letters as word characters at a boundary, but not in ``\\w``.
    """
    ascii_boundary = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
    return re.sub(r"(\\\\)|\\b", lambda m: m.group(1) or ascii_boundary, pattern)


def glob_files(files: DataFrame, glob: str, limit: int | None = MAX_GLOB_SHOWN) -> DataFrame:
    hits = files.filter(F.col("file").rlike(glob_pattern(glob))).select("file")
    return hits if limit is None else hits.orderBy("file").limit(limit)


def grep(
    contents: DataFrame,
    pattern: str,
    glob: str | None = None,
    path: str | None = None,
    limit: int | None = MAX_GREP_RESULTS,
) -> DataFrame:
    """Matching lines ``(file, line, text)`` of ``contents(file, content)``.

    Path tests come before the content is split into lines.
    """
    chosen = contents
    if path:
        prefix = re.sub(r"/$", "", re.sub(r"^\./", "", path))
        chosen = chosen.filter(F.col("file").startswith(prefix + "/") | (F.col("file") == prefix))
    if glob:
        chosen = chosen.filter(F.col("file").rlike(glob_pattern(glob)))
    hits = (
        chosen.select("file", F.posexplode(lines("content")).alias("i", "text"))
        .filter(F.col("text").rlike(portable_pattern(pattern)))
        .select("file", (F.col("i") + 1).alias("line"), F.left(F.btrim("text", F.lit(" \t\r")), F.lit(200)).alias("text"))
    )
    return hits if limit is None else hits.orderBy("file", "line").limit(limit)
