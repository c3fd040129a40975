"""Run registered queries next to their SQL on DuckDB and compare the rows.

Also a command: ``python tests/compare.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from lodestar.session import TABLES  # noqa: E402


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(0.0 if value == 0 else value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def oracle(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(con, df, sql):
    """Mismatch text, or None when columns, types and rows agree."""
    spark_cols = sorted(df.columns)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != spark_cols:
        return f"columns {spark_cols} vs {sorted(names)}"
    order = [names.index(c) for c in spark_cols]
    theirs = Counter(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    ours = Counter(tuple(plain(r[c]) for c in spark_cols) for r in df.collect())
    if ours == theirs:
        return None
    only_ours = list((ours - theirs).items())[:4]
    only_theirs = list((theirs - ours).items())[:4]
    return (
        f"rows {sum(ours.values())} vs {sum(theirs.values())}\n  cols {spark_cols}"
        f"\n  only spark {only_ours}\n  only sql   {only_theirs}"
    )


def main(argv):
    from lodestar.workloads import ORACLES, QUERIES
    from tests.conftest import make_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = make_session()
    con = oracle(sf_dir)
    bad = 0
    for name in names:
        started = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problem = compare(con, df, ORACLES[name])
            else:
                problem = None if df.count() >= 0 else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main(sys.argv[1:])
