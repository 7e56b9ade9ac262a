"""Every query of the library's own operators against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def shown(v):
    if v is None:
        return "NULL"
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(catalog.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(shown(dict(zip(names, row))[c]) for c in columns) for row in found.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def agrees(spark, folder, name, **tables):
    """A query against its SQL on tables of our own, given as SQL."""
    con = duckdb.connect()
    for t, made in tables.items():
        con.execute(f"copy ({made}) to '{folder}/{t}.parquet'")
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, str(folder))
    found = con.execute(catalog.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(shown(r[c]) for c in names) for r in df.collect()) == sorted(tuple(map(shown, row)) for row in found.fetchall())


def customers(*balances):
    return f"select i - 1 as c_custkey, 'Customer#' || i as c_name, b as c_acctbal from (select unnest([{', '.join(f'{b!r}::double' for b in balances)}]) as b, generate_subscripts([{', '.join('0' for _ in balances)}], 1) as i)"


def test_format_combinators_rounds_ties_to_even(spark, tmp_path):
    agrees(spark, tmp_path, "format_combinators", customer=customers(-330.5, -331.5, -0.5, -1.5, -0.49999999999999994, -0.4, -4503599627370497.0, -0.0, 0.5, 5000.0, 5000.01))


def test_format_fixed_keeps_the_sign_of_negative_zero(spark, tmp_path):
    agrees(spark, tmp_path, "format_fixed", customer=customers(-0.0, 0.0, -0.01, -0.04, -0.05, 0.04, 0.05, 12.25, -12.25, -999.99, 9999.99))
