"""Every registered query against its SQL, on whole tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
#: Chunks hold 4,096 points, at least 512 of a tile: the smallest tables give none.
CHUNKS_SF = "/root/testdata/sf0.01"


def folder(sql):
    return CHUNKS_SF if "chunked AS" in sql or "chunk_idx" in sql else SF


@pytest.fixture(scope="module")
def ducks():
    return {sf: connect(sf) for sf in (SF, CHUNKS_SF)}


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_rows_as_sql(spark, ducks, name):
    sql = contract.oracle_sql()[name]
    assert compare(spark, ducks[folder(sql)], contract.queries()[name], sql, folder(sql)) is None


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 7
