"""Every registered query against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from quillgraph.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries that find nothing in the smallest tables.
LARGER = {"entity_dup_pairs", "proximity_pair", "turn_dedup"}


@pytest.fixture(scope="module")
def ducks(sf_dir):
    """A database for each size, by its folder."""
    found = {}
    for folder in (sf_dir, sf_dir.replace("sf0.001", "sf0.01")):
        found[folder] = duckdb.connect()
        for t in TABLES:
            found[folder].sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return found


#: Queries that SQL can't express, and the tests that hold them against brute force.
NO_SQL = {"louvain_communities": "test_paths.py", "abbreviated_documents": "test_claims.py"}


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES) - set(NO_SQL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, ducks, sf_dir, name):
    folder = sf_dir.replace("sf0.001", "sf0.01") if name in LARGER else sf_dir
    got, want = QUERIES[name](spark, folder).toPandas(), ducks[folder].sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(str, df[columns].astype(object).values.tolist()))
    assert rows(got) == rows(want)
    assert len(got), "a query without rows shows nothing"
