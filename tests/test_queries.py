"""Every registered query with SQL against DuckDB on the smallest tables; the others must give rows."""

import math

import duckdb
import pytest

import prognos.plans.q_drift
import prognos.plans.q_evaluate
import prognos.plans.q_models
import prognos.plans.q_telemetry  # noqa: F401
from prognos.operators import models
from prognos.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def normal(rows):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = duck.execute(ORACLES[name])
    names = [c[0] for c in got.description]
    assert columns == sorted(names)
    want = [tuple(r[names.index(c)] for c in columns) for r in got.fetchall()]
    assert normal(df.select(*columns).collect()) == normal(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name, monkeypatch):
    """Of a grid, two cells are enough here; that queries hold all of them is tested in test_units.py."""
    whole = models.run_grid
    monkeypatch.setattr(models, "run_grid", lambda cells, job, session: whole(cells[:2], job, session))
    assert QUERIES[name](spark, DATA).count() >= 1
