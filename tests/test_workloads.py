"""Every registered query against its SQL at the smallest scale."""

import pytest

from lodestar.workloads import ORACLES, QUERIES
from tests.compare import compare, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert compare(con, QUERIES[name](spark, SF), ORACLES[name]) is None


def test_references_and_imports_of_one_pass_are_the_facts(spark):
    from lodestar.workloads import codebase

    for one, name in zip(codebase.uses(spark, SF), ("refs", "imports"), strict=True):
        fact = codebase.fact(spark, SF, name)
        assert sorted(one.columns) == sorted(fact.columns) and one.select(*fact.columns).dtypes == fact.dtypes
        assert one.select(*fact.columns).exceptAll(fact).count() == fact.exceptAll(one.select(*fact.columns)).count() == 0 < fact.count()


def _without_written_edges(monkeypatch):
    from lodestar.workloads import codebase, navigation

    def written(*_):
        raise AssertionError("all edges were written")

    for module in (codebase, navigation):
        monkeypatch.setattr(module, "indexed", written, raising=False)


def test_edges_are_not_written_to_be_counted(spark, con, monkeypatch):
    _without_written_edges(monkeypatch)
    assert compare(con, QUERIES["graph_stats"](spark, SF), ORACLES["graph_stats"]) is None


def test_edges_are_not_written_to_find_unknown_names(spark, con, monkeypatch):
    _without_written_edges(monkeypatch)
    assert compare(con, QUERIES["unknown_symbols"](spark, SF), ORACLES["unknown_symbols"]) is None
