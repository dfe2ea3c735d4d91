"""The registry: every query has a counterpart or is one of those that SQL can't express, and the flagship agrees with it."""

import duckdb
import pytest

import __spark_entry__
from asofgraph.plans import registry
from asofgraph.plans.domain import BASE

SF = "/root/testdata/sf0.001"
#: Random draws and string similarity have no SQL; tests hold them against plain versions.
WITHOUT_SQL = {"bootstrap", "placebo", "fuzzy_top2", "permutation_p"}


def test_every_query_has_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == WITHOUT_SQL


@pytest.mark.parametrize("name", ["signal_diffusion", "active_edges_yearly", "residual_returns", "resolution_ladder", "forward_ic", "read_validate"])
def test_agrees_with_sql(spark, name):
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for t in BASE:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = registry.queries()[name](spark, SF)
    names = sorted(found.columns)
    plain = db.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({registry.oracle_sql()[name]})").fetchall()
    same = lambda rs: sorted((tuple(None if v is None else round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in rs), key=str)
    assert same(map(tuple, found.select(*names).collect())) == same(plain)


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
