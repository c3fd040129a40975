"""Reading tool output: failures, condensed logs, mentioned paths, call arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import lines

# How test runners and compilers mark lines.
FAIL_PATTERN = r"(?m)^\s*(?:---\s+)?FAIL:?\s+(\S+)"
NOISE_PATTERN = r"^(go: downloading|Compiling|\s*Finished)"
INTERESTING_PATTERN = r"(FAIL|--- FAIL|Error|error:|panic:|expected|Expected|✗|×|assert)"
PATH_PATTERN = r"[\w./-]+\.[A-Za-z][\w]{0,4}"
MISSING_PATTERN = r"(?i)(^|\s)(command )?not found"


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def test_failures(output) -> Column:
    """Distinct failing units named in a test log, in order of appearance.

    A line is examined on its own: the unit must stand on the line that says FAIL.
    """
    per_line = F.transform(lines(output), lambda line: F.regexp_extract(line, FAIL_PATTERN, 1))
    return F.array_distinct(F.filter(per_line, lambda unit: unit != ""))


def toolchain_missing(exit_code, stderr) -> Column:
    return (_c(exit_code) == 127) | _c(stderr).rlike(MISSING_PATTERN)


def condense_compiler_output(output, limit: int = 3000) -> Column:
    kept = F.filter(lines(output), lambda line: (F.trim(line) != "") & ~line.rlike(NOISE_PATTERN))
    body = F.array_join(F.slice(kept, 1, 40), "\n")
    return _cut(body, limit)


# What stands for an empty log, and at the end of a cut one.
ALL_PASSED = "tests passed"
TRIMMED = "\n… [output trimmed]"


def condense_test_output(output, ok, limit: int = 4000) -> Column:
    tail = lines(F.btrim(_c(output), F.lit(" \t\n\r")))
    last = F.array_join(F.slice(tail, F.greatest(F.size(tail) - 7, F.lit(1)), F.lit(8)), "\n")
    passed = F.when(last == "", F.lit(ALL_PASSED)).otherwise(last)
    every = lines(output)
    hits = F.filter(every, lambda line: line.rlike(INTERESTING_PATTERN))
    body = F.array_join(F.when(F.size(hits) > 0, hits).otherwise(every), "\n")
    return F.when(_c(ok), passed).otherwise(_cut(body, limit))


def _cut(body: Column, limit: int) -> Column:
    return F.when(F.length(body) > limit, F.concat(F.left(body, F.lit(limit)), F.lit(TRIMMED))).otherwise(body)


def paths_mentioned(texts: DataFrame, known: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Known files named anywhere in a text: ``(key, file)``."""
    found = F.transform(
        F.regexp_extract_all(F.col(text), F.lit(f"({PATH_PATTERN})"), F.lit(1)),
        lambda p: F.regexp_replace(p, "^\\./", ""),
    )
    mentions = texts.select(key, F.explode(F.array_distinct(found)).alias("file"))
    return mentions.join(known.select("file"), "file", "left_semi").select(key, "file")


def tool_arguments(raw) -> Column:
    """Arguments of a tool call; text that is not JSON is kept under ``__unparsed``."""
    column = F.when(F.coalesce(_c(raw), F.lit("")) == "", F.lit("{}")).otherwise(_c(raw))
    parsed = F.try_parse_json(column)
    kept = F.when(F.schema_of_variant(parsed).rlike("^(OBJECT|ARRAY)"), F.to_json(parsed)).otherwise(F.lit("{}"))
    fallback = F.to_json(F.struct(column.alias("__unparsed")))
    return F.when(parsed.isNull(), fallback).otherwise(kept)


def against_baseline(failures: DataFrame, baseline: DataFrame, keys: list) -> DataFrame:
    """Failing units of each run, split into those the base already had and new ones."""
    known = baseline.select(*keys, "unit").distinct().withColumn("_known", F.lit(True))
    return failures.select(*keys, "unit").distinct().join(known, [*keys, "unit"], "left").select(
        *keys, "unit", F.coalesce("_known", F.lit(False)).alias("preexisting")
    )
