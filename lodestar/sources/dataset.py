"""Benchmark instances from JSON lines, and the text built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of an instance and how each is read; one of another shape is read as null.
FIELDS = {
    "org": "string",
    "repo": "string",
    "number": "string",
    "base": "struct<label:string,ref:string,sha:string>",
    "title": "string",
    "body": "string",
    "resolved_issues": "array<struct<number:bigint,title:string,body:string>>",
    "fix_patch": "string",
    "test_patch": "string",
    "lang": "string",
    "hints": "string",
    "repo_url": "string",
}


def instance_id() -> Column:
    return F.concat("org", F.lit("__"), "repo", F.lit("-"), "number")


def repo_url(default_host: str) -> Column:
    return F.coalesce("repo_url", F.concat(F.lit(default_host.rstrip("/") + "/"), "org", F.lit("/"), "repo", F.lit(".git")))


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """Every non-blank line as a variant, null where it is not JSON."""
    lines = spark.read.text(paths).filter(F.trim("value", F.lit(" \t\r")) != "")
    return lines.select(F.try_parse_json("value").alias("record"))


def load_dataset(spark: SparkSession, paths, langs=(), repos=(), ids=(), limit: int = 0) -> DataFrame:
    """Instances that match the filters; a record without org, repo or number fails the read."""
    records = read_lines(spark, paths).filter(F.col("record").isNotNull())
    rows = records.select(*(F.try_variant_get("record", f"$.{name}", kind).alias(name) for name, kind in FIELDS.items()))
    whole = (F.coalesce("org", F.lit("")) != "") & (F.coalesce("repo", F.lit("")) != "") & F.col("number").isNotNull()
    checked = F.when(whole, instance_id()).otherwise(F.raise_error(F.lit("instance is missing org/repo/number")))
    out = rows.withColumn("instance_id", checked)
    if langs:
        out = out.filter(F.lower(F.coalesce("lang", F.lit(""))).isin(*langs))
    if repos:
        out = out.filter(F.concat("org", F.lit("/"), "repo").isin(*repos))
    if ids:
        out = out.filter(F.col("instance_id").isin(*ids))
    out = out.filter(F.col("instance_id").isNotNull())
    return out.limit(limit) if limit else out


def count_malformed(spark: SparkSession, paths) -> DataFrame:
    """How many lines are not JSON. A record with a field of another type is none of them."""
    return read_lines(spark, paths).agg(F.count_if(F.col("record").isNull()).alias("malformed"))


def task_text() -> Column:
    """Title, body and linked issues; the reference patches never take part."""

    def filled(value, text):
        return F.when(F.coalesce(value, F.lit("")) != "", F.array(text)).otherwise(F.array().cast("array<string>"))

    def issue(i):
        head = F.concat(F.lit("## Linked issue #"), i["number"].cast("string"), F.lit(": "), i["title"])
        return F.concat(F.array(head), filled(i["body"], i["body"]))

    issues = F.coalesce("resolved_issues", F.array().cast("array<struct<number:bigint,title:string,body:string>>"))
    parts = F.concat(
        filled(F.col("title"), F.concat(F.lit("# "), "title")), filled(F.col("body"), F.col("body")), F.flatten(F.transform(issues, issue))
    )
    text = F.btrim(F.array_join(parts, "\n\n"), F.lit(" \t\n\r"))
    # fixed value: the text of an instance that says nothing itself
    fallback = F.concat(F.lit("Resolve pull request "), instance_id(), F.lit(" in "), "org", F.lit("/"), "repo", F.lit("."))
    return F.when(text == "", fallback).otherwise(text)


def image_name(template: str) -> Column:
    out = F.lit(template)
    for slot, value in (("{org}", F.col("org")), ("{repo}", F.col("repo")), ("{number}", F.col("number")), ("{id}", instance_id())):
        out = F.replace(out, F.lit(slot), value)
    return out


def remaining(instances: DataFrame, done: DataFrame) -> DataFrame:
    """Instances without a committed result, for resuming a sweep."""
    return instances.join(done.select("instance_id"), "instance_id", "left_anti")
