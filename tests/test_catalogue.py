"""Every query outside the llm subpackage against its SQL, on the small tables."""

import math

import duckdb
import pytest

from lintel import catalogue

FOLDER = "/root/testdata/sf0.01"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for n in NAMES:
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{FOLDER}/{n}.parquet')")
    return con


def norm(rows):
    def one(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
            return "nan" if math.isnan(v) else f"{float(v):.6g}"
        return str(v)

    return sorted([tuple(one(v) for v in r) for r in rows])


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_against_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert norm(got.select(*columns).collect()) == norm(want)
    assert want, "an empty result tests nothing"
