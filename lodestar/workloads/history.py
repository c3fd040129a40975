"""Co-change over order baskets: an order is a commit, a part is a file."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators.cochange import build_co_change, co_change_ranked, co_change_scores
from lodestar.session import table
from lodestar.workloads.registry import workload

BASKETS = """
touches AS (SELECT DISTINCT l_orderkey AS commit_id, l_partkey AS file FROM lineitem),
sizes AS (SELECT commit_id, 1 / ln(1 + count(*)) AS w FROM touches
          GROUP BY commit_id HAVING count(*) >= 2),
used AS (SELECT t.commit_id, t.file, s.w FROM touches t JOIN sizes s USING (commit_id)),
own AS (SELECT file, sum(w) AS own FROM used GROUP BY file),
total AS (SELECT sum(w) AS total FROM sizes),
pairs AS (SELECT a.file AS anchor, b.file AS file, sum(a.w) AS together
          FROM used a JOIN used b ON a.commit_id = b.commit_id AND a.file <> b.file
          GROUP BY a.file, b.file),
scored AS (SELECT p.anchor, p.file,
                  p.together * (SELECT total FROM total) / (x.own * y.own) * ln(1 + p.together) AS score
           FROM pairs p JOIN own x ON x.file = p.anchor JOIN own y ON y.file = p.file)
"""


def basket_index(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return build_co_change(lines, commit="l_orderkey", file="l_partkey")


@workload(
    "cochange_weights",
    f"WITH {BASKETS} SELECT file, round(own, 6) AS own, "
    "round((SELECT total FROM total), 4) AS total FROM own",
)
def cochange_weights(spark, sf_dir):
    index = basket_index(spark, sf_dir)
    return index.own.select("file", F.round("own", 6).alias("own"), F.round("total", 4).alias("total"))


@workload(
    "cochange_lift",
    f"WITH {BASKETS} SELECT anchor, file, round(score, 6) AS score FROM scored",
)
def cochange_lift(spark, sf_dir):
    scores = co_change_scores(basket_index(spark, sf_dir))
    return scores.select("anchor", "file", F.round("score", 6).alias("score"))


@workload(
    "cochange_top",
    f"""WITH {BASKETS}, ranked AS (
      SELECT anchor, file, score,
             row_number() OVER (PARTITION BY anchor ORDER BY round(score, 10) DESC, file) AS rank
      FROM scored)
    SELECT anchor, file, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score
    FROM ranked WHERE rank <= 10""",
)
def cochange_top(spark, sf_dir):
    top = co_change_ranked(basket_index(spark, sf_dir), None, 10)
    return top.select("anchor", "file", "rank", F.round("score", 6).alias("score"))
