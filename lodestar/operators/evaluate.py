"""Scoring rankings against known change sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.constants import EVAL_KS, MAX_FILE_BYTES, STRATEGIES
from lodestar.operators import cochange, fusion, locality, traverse, walk
from lodestar.operators.ranking import comparable
from lodestar.session import settle, settle_by


@dataclass(frozen=True)
class Gold:
    """Change sets split by whether the repository knew the file beforehand."""

    indexable: DataFrame
    misses: DataFrame
    scored: DataFrame


def split_gold(gold: DataFrame, known: DataFrame, sizes: DataFrame | None = None, keys=("repo",)) -> Gold:
    """``gold(keys, file)`` against ``known(keys, file)``.

    ``sizes(keys, file, bytes)`` lists what exists in the work tree; a file absent from
    it was created by the change itself. An instance is scored when at least two of its
    files are indexable.
    """
    keys = list(keys)
    wanted = gold.select(*keys, "file").distinct()
    indexable = wanted.join(known.select(*keys, "file"), [*keys, "file"], "left_semi")
    missing = wanted.join(known.select(*keys, "file"), [*keys, "file"], "left_anti")
    if sizes is None:
        reason = missing.withColumn("reason", F.lit("created-by-patch"))
    else:
        reason = missing.join(sizes, [*keys, "file"], "left").select(
            *keys,
            "file",
            F.when(F.col("bytes").isNull(), "created-by-patch")
            .when(F.col("bytes") > MAX_FILE_BYTES, "too-large")
            .otherwise("excluded-by-lister")
            .alias("reason"),
        )
    counts = wanted.groupBy(*keys).agg(F.count("*").alias("gold_files")).join(
        indexable.groupBy(*keys).agg(F.count("*").alias("indexable_files")), keys, "left"
    )
    scored = counts.withColumn("indexable_files", F.coalesce("indexable_files", F.lit(0).cast("long")))
    scored = scored.withColumn("scored", (F.col("gold_files") >= 2) & (F.col("indexable_files") >= 2))
    return Gold(indexable, reason, scored)


def anchors_of(gold: Gold, keys=("repo",)) -> DataFrame:
    """Each indexable file of a scored instance, with the number of files to be found from it."""
    kept = gold.scored.filter("scored").select(*keys, (F.col("indexable_files") - 1).alias("n_targets"))
    return gold.indexable.join(kept, list(keys)).withColumnRenamed("file", "anchor")


def base_rankings(
    file_edges: DataFrame,
    files: DataFrame,
    history: cochange.CoChange,
    anchors: DataFrame,
    reached: DataFrame,
    limit: int,
    keys=("repo",),
    max_package: int | None = None,
    parts: int | None = None,
) -> DataFrame:
    """The six base signals in long form, each computed once for all anchors."""
    keys = list(keys)
    columns = [*keys, "anchor", "file", "rank"]
    signals = {
        "graph": walk.ppr_ranked(file_edges, anchors, limit, keys, parts=parts),
        "dependents": walk.ppr_ranked(file_edges, anchors, limit, keys, backward_only=True, parts=parts),
        "graph-bfs": traverse.bfs_ranked(reached, limit, keys),
        "cochange": cochange.co_change_ranked(history, anchors, limit),
        "packages": locality.package_mates(files, anchors, limit, keys, max_package),
        "directory": locality.directory_ranked(files, anchors, limit, keys, "place" if "place" in files.columns else None),
    }
    out = None
    for name, ranked in signals.items():
        part = ranked.select(*columns).withColumn("strategy", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def score_rankings(rankings: DataFrame, gold: Gold, anchors: DataFrame, keys=("repo",), ks=EVAL_KS) -> DataFrame:
    """Recall and precision at each k, and recall at the number of targets, per instance and strategy.

    Precision divides by what was returned, not by k. An anchor for which a strategy
    returns nothing counts as zero, so sums are divided by the number of anchors.
    """
    keys = list(keys)
    targets = gold.indexable.withColumn("hit", F.lit(True))
    sized = rankings.join(anchors, [*keys, "anchor"]).join(targets, [*keys, "file"], "left")
    hit = F.coalesce("hit", F.lit(False))
    rank = F.col("rank")
    per_anchor = sized.groupBy(*keys, "anchor", "strategy").agg(
        F.max("n_targets").alias("n_targets"),
        F.count_if(hit & (rank <= F.col("n_targets"))).alias("at_g"),
        *[F.count_if(hit & (rank <= k)).alias(f"hits_{k}") for k in ks],
        *[F.count_if(rank <= k).alias(f"shown_{k}") for k in ks],
    )
    sums = per_anchor.groupBy(*keys, "strategy").agg(
        F.sum(F.col("at_g") / F.col("n_targets")).alias("s_at_g"),
        *[F.sum(F.col(f"hits_{k}") / F.col("n_targets")).alias(f"s_recall_{k}") for k in ks],
        *[
            F.sum(F.coalesce(F.try_divide(f"hits_{k}", f"shown_{k}"), F.lit(0.0))).alias(f"s_precision_{k}")
            for k in ks
        ],
    )
    instances = gold.scored.filter("scored").select(
        *keys, "indexable_files", F.explode(F.array(*[F.lit(s) for s in STRATEGIES])).alias("strategy")
    )

    def mean(column):
        return F.coalesce(F.col(column) / F.col("indexable_files"), F.lit(0.0))

    return instances.join(sums, [*keys, "strategy"], "left").select(
        *keys,
        "strategy",
        mean("s_at_g").alias("recall_at_g"),
        *[mean(f"s_recall_{k}").alias(f"recall_{k}") for k in ks],
        *[mean(f"s_precision_{k}").alias(f"precision_{k}") for k in ks],
    )


def closure_scores(reached: DataFrame, gold: Gold, anchors: DataFrame, files: DataFrame, keys=("repo",)) -> DataFrame:
    """Per instance: share of targets in the structural closure, its size over the
    repository's, and the share of gold files no parser handles."""
    keys = list(keys)
    repo_size = files.groupBy(*keys).agg(F.count("*").alias("n_files"))
    sizes = traverse.closure_sizes(reached, keys)
    found = (
        reached.join(gold.indexable, [*keys, "file"], "left_semi")
        .groupBy(*keys, "anchor")
        .agg(F.count("*").alias("found"))
    )
    per_anchor = (
        anchors.join(sizes, [*keys, "anchor"], "left")
        .join(found, [*keys, "anchor"], "left")
        .join(repo_size, keys)
        .groupBy(*keys)
        .agg(
            F.avg(F.coalesce("found", F.lit(0)) / F.col("n_targets")).alias("closure_recall"),
            F.avg(F.coalesce("closure_size", F.lit(0)) / F.col("n_files")).alias("closure_share"),
        )
    )
    parsed = files.filter(F.col("lang").isNotNull()).select(*keys, "file", F.lit(1).alias("parsed"))
    unparsed = (
        gold.indexable.join(parsed, [*keys, "file"], "left")
        .groupBy(*keys)
        .agg((F.count_if(F.col("parsed").isNull()) / F.count("*")).alias("unparsed_share"))
    )
    return per_anchor.join(unparsed, keys)


def summarise(scores: DataFrame, keys=("repo",), ks=EVAL_KS) -> DataFrame:
    """Mean over instances per strategy, with wins and losses against the directory baseline."""
    keys = list(keys)
    baseline = scores.filter(F.col("strategy") == "directory").select(*keys, F.col("recall_at_g").alias("_base"))
    mine, theirs = comparable("recall_at_g"), comparable("_base")
    metrics = ["recall_at_g", *[f"recall_{k}" for k in ks], *[f"precision_{k}" for k in ks]]
    return (
        scores.join(baseline, keys)
        .groupBy("strategy")
        .agg(
            F.count("*").alias("instances"),
            *[F.avg(m).alias(m) for m in metrics],
            F.count_if(mine > theirs).alias("wins"),
            F.count_if(mine < theirs).alias("losses"),
        )
    )


def ablation(summary: DataFrame) -> DataFrame:
    """How far the full fusion falls when one of its signals is removed."""
    combined = summary.filter(F.col("strategy") == "combined").select("recall_at_g").scalar()
    lost = combined - F.col("recall_at_g")
    return summary.filter(F.col("strategy").startswith("no-")).select(
        "strategy", "recall_at_g", lost.alias("drop"), F.coalesce(F.try_divide(lost, combined), F.lit(0.0)).alias("share")
    )


def miss_reasons(gold: Gold) -> DataFrame:
    return gold.misses.groupBy("reason").agg(F.count("*").alias("files"))


def evaluate(
    file_edges: DataFrame,
    files: DataFrame,
    commit_files: DataFrame,
    gold_files: DataFrame,
    sizes: DataFrame | None = None,
    keys=("repo",),
    ks=EVAL_KS,
    limit: int | None = None,
    max_files: int | None = None,
    max_package: int | None = None,
    parts: int | None = None,
):
    """Rank every anchor with every strategy and score it. Returns
    ``(scores per instance and strategy, closure scores per instance, gold)``.

    Rankings go as deep as the largest k or, for larger change sets, the number of
    targets; the deepest such limit is one aggregated number. Each anchor's list is then
    cut to its own limit before fusion, as fusion only sees what each signal returned.
    ``max_files`` and ``max_package`` leave out larger commits and packages; none are by default.
    With ``parts``, all tables are dealt by ``keys`` alone, for instances that are many and small.
    """
    keys = list(keys)

    def cut(df, label):
        return settle(df, label) if parts is None else settle_by(df, label, keys, parts)

    gold = split_gold(gold_files, files, sizes, keys)
    anchors = cut(anchors_of(gold, keys), "anchors")
    top = limit or max(ks)
    deepest = max(top, anchors.agg(F.max("n_targets")).first()[0] or 0)
    edges = file_edges if parts else settle(file_edges, "file_edges")
    reached = cut(traverse.reach(edges, anchors, keys, parts=parts), "reach")
    history = cochange.build_co_change(commit_files, keys, max_files=max_files, parts=parts)
    base = base_rankings(edges, files, history, anchors, reached, deepest, keys, max_package, parts)
    own_limit = anchors.select(*keys, "anchor", F.greatest(F.lit(top), "n_targets").alias("own_limit"))
    base = cut(
        base.join(own_limit, [*keys, "anchor"]).filter(F.col("rank") <= F.col("own_limit")).drop("own_limit"), "base"
    )
    ranked = fusion.all_strategies(base, deepest, keys)
    ranked = ranked.join(own_limit, [*keys, "anchor"]).filter(F.col("rank") <= F.col("own_limit")).drop("own_limit")
    scores = score_rankings(ranked, gold, anchors, keys, ks)
    return scores, closure_scores(reached, gold, anchors, files, keys), gold

