import math
from datetime import datetime
from decimal import Decimal

import duckdb
import pytest

from pageloom.plans import registry
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (float, Decimal)):
        return None if math.isnan(x) else round(float(x), 6)
    if isinstance(x, datetime):
        return x.replace(tzinfo=None)
    return int(x) if isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_gives_the_same_rows(spark, db, name):
    want = db.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(repr([plain(r[c]) for c in want.columns]) for r in got.collect()) == sorted(repr(list(map(plain, r))) for r in want.fetchall())


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
