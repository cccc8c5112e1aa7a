"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from folioscope import catalog
from folioscope.queries import TABLES, chains, relations

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(autouse=True)
def shared_entities(monkeypatch, request, made):
    """Entities of the section corpus are found once for all queries that use them; the driver's own run finds them for each."""
    found = relations.all_entities

    def once(v):
        if "entities" not in made:
            made["entities"] = found(v)
        return made["entities"]

    for module in (relations, chains):
        monkeypatch.setattr(module, "all_entities", once)


@pytest.fixture(scope="module")
def made():
    return {}


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    asked = con.execute(ORACLE[name])
    columns = [c[0] for c in asked.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(map(plain, r)) for r in asked.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want


def test_every_table_is_fingerprinted_the_same_in_any_order(spark, sf_dir):
    from folioscope.operators.tables import fingerprint

    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    assert fingerprint(df, "o").collect() == fingerprint(df.repartition(5), "o").collect()


@pytest.mark.parametrize("edge_type", ["supplies", "responsible_party_for"])
def test_edges_are_made_distinct_where_they_are_dealt(spark, sf_dir, edge_type):
    from folioscope.queries import PARTS, Views

    edges = Views(spark, sf_dir).edges.where(f"edge_type = '{edge_type}'")
    # parts whose number grows with the table, and which are not joined again
    assert edges.rdd.getNumPartitions() == PARTS
