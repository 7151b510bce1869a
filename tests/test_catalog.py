import math
import os

import pytest

from textloom import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["benchmark", "documents", "embeddings", "events", "labels", "part"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, name):
    frame = catalog.queries()[name](spark, SF)
    answer = duck.sql(catalog.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(answer.columns)
    got, want = rows(frame.columns, frame.collect()), rows(answer.columns, answer.fetchall())
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
