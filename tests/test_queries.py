"""Every query with SQL gives what the SQL gives."""

import duckdb
import pytest

from plebis.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else repr(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, duck, data, name):
    df = catalog.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = [tuple(row[i] for i in at) for row in found.fetchall()]
    assert plain(map(tuple, df.select(*columns).collect())) == plain(expected)


def test_payload_is_nested_json(spark, data):
    import json

    rows = catalog.QUERIES["json_payload"](spark, data).limit(3).collect()
    assert rows and all(json.loads(r["payload"])["top_lists"][0]["place"] == 1 for r in rows)


def test_every_key_of_the_inventory():
    assert len(catalog.QUERIES) >= 105 and set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
