"""Every registered query of the core that has SQL gives its rows at the smallest size."""

from __future__ import annotations

import math

import pytest

from spindrift.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    res = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(res.columns)
    assert rows(df.columns, df.collect()) == rows(res.columns, res.fetchall())


@pytest.mark.parametrize("name", ["e_methods", "n6_factors", "pre_variable_genes", "q5_matched"])
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_every_place_of_the_gene_vectors_is_summed(spark, sf):
    assert set(QUERIES["a16_dot_all"](spark, sf).columns) == {"cell", *(f"v{i}" for i in range(20))}
