"""POSIX path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def basename(path) -> Column:
    return F.regexp_extract(_c(path), "([^/]*)/*$", 1)


def dirname(path) -> Column:
    """Parent directory; ``.`` for a bare name."""
    parent = F.regexp_extract(_c(path), "^(.*[^/])/+[^/]+/*$", 1)
    return F.when(parent != "", parent).when(_c(path).rlike("^/"), F.lit("/")).otherwise(F.lit("."))


def directory(path) -> Column:
    """Parent directory, with the repository root as the empty string."""
    parent = dirname(path)
    return F.when(parent == ".", F.lit("")).otherwise(parent)


def extname(path) -> Column:
    """Last dot and what follows it; empty for dot files and names without one."""
    return F.regexp_extract(basename(path), "^.+(\\.[^.]*)$", 1)


def stem(path) -> Column:
    return F.regexp_replace(basename(path), "\\.[^.]+$", "")


def segments(path) -> Column:
    return F.filter(F.split(_c(path), "/"), lambda s: s != "")


def normalize(path) -> Column:
    """Resolve ``.`` and ``..`` segments of a relative path."""

    def step(acc, part):
        backs_out = (part == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
        return (
            F.when((part == "") | (part == "."), acc)
            .when(backs_out, F.slice(acc, F.lit(1), F.size(acc) - 1))
            .otherwise(F.concat(acc, F.array(part)))
        )

    parts = F.aggregate(F.split(_c(path), "/"), F.array().cast("array<string>"), step)
    joined = F.array_join(parts, "/")
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def join_path(base, relative) -> Column:
    return normalize(F.concat_ws("/", F.when(_c(base) != "", _c(base)), _c(relative)))


def normalize_anchor(anchor, root: str) -> Column:
    """Trim, strip the repository root and a leading ``./``."""
    import re

    prefix = re.escape(root.rstrip("/") + "/").replace("/", "/")
    trimmed = F.trim(_c(anchor))
    return F.regexp_replace(F.regexp_replace(trimmed, f"^{prefix}", ""), "^\\./", "")


def ancestors(path) -> Column:
    """Every proper ancestor directory of a directory path (``a/b/c`` -> ``a``, ``a/b``)."""
    parts = F.split(_c(path), "/")
    return F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
        ),
    ).otherwise(F.array().cast("array<string>"))
