"""Every query against the SQL that states its result, run by DuckDB over the same tables."""

import duckdb
import pytest

from quire import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple("%.5f" % x if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = plans.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    said = duck.sql(plans.oracle_sql()[name])
    assert sorted(said.columns) == columns
    types = dict(zip(said.columns, map(str, said.types)))
    assert {c: TYPES.get(types[c], types[c]) for c in columns} == dict(df.dtypes)
    assert plain(df.select(*columns).collect()) == plain(said.select(*map(duckdb.ColumnExpression, columns)).fetchall())


def test_queries_without_sql(spark, sf_dir):
    assert set(plans.queries()) - set(plans.oracle_sql()) == {"sampled_pages", "connected_chains", "lexical_rank_english", "vector_topk_cells"}
    draw = lambda: sorted(map(tuple, plans.queries()["sampled_pages"](spark, sf_dir).collect()))
    assert len(draw()) == 20 and draw() == draw()


def test_scans_read_only_what_they_need(spark, sf_dir, capsys):
    plans.queries()["latest_per_key"](spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_orderdate" in plan
    assert "o_orderpriority" not in plan
