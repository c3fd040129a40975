"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.session import settle

#: The exponent is searched on multiples of one part in so many, from 0 to 1.
STEPS = 1024
#: Entropy of the mix to reach, as a share of the largest possible one (equal weights).
TARGET_ENTROPY = 0.99
#: No source may be read more often than this.
MOST_PASSES = 4.0
#: Tokens of a block; each block holds every source in its weight.
BLOCK_TOKENS = 100_000
SEED = "mix-1"


def token_count(text: Column) -> Column:
    """Words between white space, as the measure of a source's size; null and empty texts count 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


def source_totals(docs: DataFrame) -> DataFrame:
    """source, tokens and their share of all; sources without a token are left out."""
    totals = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).filter(F.col("tokens") > 0)
    total = totals.agg(F.sum("tokens").alias("all_tokens"))
    return totals.join(F.broadcast(total)).withColumn("share", F.col("tokens") / F.col("all_tokens"))  # one row


def measures(sources: DataFrame, steps: list[int]) -> dict[int, tuple[float, float]]:
    """For each exponent k / STEPS: the entropy of the mix, and the most passes that a budget
    of all tokens makes over any source. One row comes back, whatever the number of sources."""
    found = []
    for k in steps:
        power = F.pow("share", F.lit(k / STEPS))
        found += [F.sum(power), F.sum(power * F.log("share")), F.max(power / F.col("share"))]
    row = sources.agg(*(c.alias(f"c{i}") for i, c in enumerate(found))).first()
    out = {}
    for i, k in enumerate(steps):
        z, weighted, most = row[3 * i : 3 * i + 3]
        out[k] = (math.log(z) - k / STEPS * weighted / z, most / z)
    return out


def exponent(sources: DataFrame, target: float, most_passes: float, budget_share: float = 1.0) -> int:
    """The largest step whose mix has ``target`` times the entropy of equal weights, or the
    smallest larger one that keeps every source within ``most_passes``.

    Entropy falls and the passes fall as the exponent grows, so both are found by bisection.
    If even the sources' own shares need more passes, step STEPS is taken.
    """
    low, high = 0, STEPS  # equal weights reach any target
    goal = target * measures(sources, [0])[0][0] - 1e-9
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if measures(sources, [mid])[mid][0] >= goal else (low, mid - 1)
    step, high = low, STEPS
    while step < high:
        mid = (step + high) // 2
        step, high = (step, mid) if measures(sources, [mid])[mid][1] * budget_share <= most_passes + 1e-9 else (mid + 1, high)
    return step


def target_weights(sources: DataFrame, step: int, budget: int | None = None) -> DataFrame:
    """source, tokens, weight and the source's part of the token budget (all tokens if None)."""
    power = F.pow("share", F.lit(step / STEPS))
    whole = sources.agg(F.sum(power).alias("z"))
    weight = F.round(power / F.col("z"), 12)
    total = F.col("all_tokens") if budget is None else F.lit(budget)
    return sources.join(F.broadcast(whole)).select("source", "tokens", weight.alias("weight"), F.floor(weight * total).cast("long").alias("budget"))


def realise(docs: DataFrame, weights: DataFrame, seed: str = SEED, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The documents that the budgets buy, as many times as they buy them.

    Every pass over a source takes its documents in an order of its own, that of a seeded hash
    of pass and id, and the pass stops at the source's budget: full passes come first, the
    last takes the leading documents up to the one that reaches the budget. A copy's block is
    where its running token count stands in units of the source's part of a block, so each
    block holds the sources in their weights; within the block ``place``, another seeded hash,
    orders the copies of all sources at random.

    Running counts are taken in about sqrt(n) parts of a pass and added up over the parts,
    so no task holds a whole source. Expects doc_id, source, n_tokens; returns them with
    copy (from 0), block and place.
    """
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    parts = weights.join(sizes.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("source").alias("of"), "tokens", "weight", "budget", F.ceil(F.sqrt("n")).cast("long").alias("parts")
    )
    passes = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("budget div tokens"))).alias("copy")
    dealt = docs.join(parts, F.col("source").eqNullSafe(F.col("of"))).select("*", passes)
    keyed = dealt.withColumn("key", seeded(seed)).withColumn("slot", F.conv(F.substring("key", 1, 7), 16, 10).cast("long"))
    placed = keyed.withColumn("part", F.expr("slot * parts div 268435456"))
    sums = placed.groupBy("of", "copy", "part").agg(F.sum("n_tokens").alias("in_part"))
    before = Window.partitionBy("of", "copy").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("of").alias("of2"), F.col("copy").alias("copy2"), F.col("part").alias("part2"), F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy("of", "copy", "part").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    running = placed.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    same = F.col("of").eqNullSafe(F.col("of2")) & (F.col("copy") == F.col("copy2")) & (F.col("part") == F.col("part2"))
    # copy i stands at i * tokens + at and is bought if that lies below the budget
    at = F.col("copy") * F.col("tokens") + F.col("ahead") + F.col("offset")
    bought = running.join(offsets, same).withColumn("at", at).filter("at < budget")
    block = F.floor(F.col("at") / (F.col("weight") * F.lit(block_tokens))).cast("long")
    place = F.conv(F.substring(seeded(f"{seed}/place"), 1, 15), 16, 10).cast("long")
    return bought.select(*docs.columns, "copy", block.alias("block"), place.alias("place"))


def seeded(seed: str) -> Column:
    """A hash of the seed, a pass and an id."""
    return F.md5(F.concat_ws("/", F.lit(seed), F.col("copy").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mix(docs: DataFrame, target: float = TARGET_ENTROPY, most_passes: float = MOST_PASSES, budget: int | None = None) -> DataFrame:
    """doc_id, source, n_tokens, copy, block and place of every copy in the mixed corpus.

    Null sources are one source. Documents without a token cost nothing and are taken
    whenever the order reaches them, but a source without any token has no weight and goes
    with all its documents; so a table without tokens, or without rows, gives no rows.
    Repeated rows are documents of their own; ties of the hash go by id, then tokens. Other
    columns are not read.
    """
    narrow = docs.select("doc_id", "source", token_count(F.col("text")).alias("n_tokens"))
    narrow = settle(narrow, "mix-docs")
    sources = settle(source_totals(narrow), "mix-sources")
    first = sources.agg(F.max("all_tokens")).first()[0]
    if first is None:
        return narrow.filter(F.lit(False)).withColumns({c: F.lit(0).cast("long") for c in ("copy", "block", "place")})
    step = exponent(sources, target, most_passes, 1.0 if budget is None else budget / first)
    return realise(narrow, target_weights(sources, step, budget))


def mixed_documents(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` as the mix takes them: a document bought twice comes twice, one not bought goes.

    Rows that share doc_id and source share their copies as evenly as they can.
    """
    id_, source_, copies_, rows_, row_, copy_ = own_names(docs, "id", "source", "copies", "rows", "row", "copy")
    bought = mix(docs, **limits).groupBy(F.col("doc_id").alias(id_), F.col("source").alias(source_)).agg(F.count("*").alias(copies_))
    both = docs.join(bought, F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(source_)))
    same = Window.partitionBy(id_, source_)
    both = both.withColumn(rows_, F.count("*").over(same)).withColumn(row_, F.row_number().over(same.orderBy(F.xxhash64("text"))))
    own = F.expr(f"({copies_} + {rows_} - {row_}) div {rows_}")
    return both.filter(own > 0).withColumn(copy_, F.explode(F.sequence(F.lit(1).cast("long"), own))).select(*docs.columns)


def own_names(frame: DataFrame, *names: str) -> list[str]:
    """``names`` with more underscores after them than any column of ``frame`` has."""
    mark = "_" * (1 + max((len(c) - len(c.rstrip("_")) for c in frame.columns), default=0))
    return [name + mark for name in names]


MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS BIGINT) AS n_tokens FROM documents
), totals AS (
  SELECT source, sum(n_tokens) AS tokens, count(*) AS n FROM sized GROUP BY source HAVING sum(n_tokens) > 0
), shares AS (
  SELECT *, sum(tokens) OVER () AS all_tokens, tokens / sum(tokens) OVER () AS share FROM totals
), steps AS (
  SELECT k, ln(sum(pow(share, k / {STEPS}.0))) - k / {STEPS}.0 * sum(pow(share, k / {STEPS}.0) * ln(share)) / sum(pow(share, k / {STEPS}.0)) AS entropy,
         max(pow(share, k / {STEPS}.0) / share) / sum(pow(share, k / {STEPS}.0)) AS passes
  FROM shares, range({STEPS + 1}) r(k) GROUP BY k
), reached AS (
  SELECT max(k) AS k FROM steps WHERE entropy >= {TARGET_ENTROPY} * (SELECT entropy FROM steps WHERE k = 0) - 1e-9
), chosen AS (
  SELECT coalesce(min(s.k), {STEPS}) AS k FROM steps s, reached r WHERE s.k >= r.k AND s.passes <= {MOST_PASSES} + 1e-9
), weights AS (
  SELECT source, tokens, all_tokens, round(pow(share, k / {STEPS}.0) / sum(pow(share, k / {STEPS}.0)) OVER (), 12) AS weight FROM shares, chosen
), passes AS (
  SELECT d.doc_id, d.source, d.n_tokens, w.tokens, w.weight, CAST(floor(w.weight * w.all_tokens) AS BIGINT) AS budget,
         unnest(range(CAST(floor(w.weight * w.all_tokens) AS BIGINT) // CAST(w.tokens AS BIGINT) + 1)) AS copy
  FROM sized d JOIN weights w ON d.source IS NOT DISTINCT FROM w.source
), placed AS (
  SELECT *, copy * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY source, copy
    ORDER BY md5('{SEED}/' || copy || '/' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, n_tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stands FROM passes
)
SELECT doc_id, source, n_tokens, copy, CAST(floor(stands / (weight * {BLOCK_TOKENS})) AS BIGINT) AS block,
  CAST('0x' || substr(md5('{SEED}/place/' || copy || '/' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place
FROM placed WHERE stands < budget
"""
