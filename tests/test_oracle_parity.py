"""Every registered query against its DuckDB twin on the smallest tables:
row count, column names and an order-insensitive value hash must agree."""

from __future__ import annotations

import duckdb
import pytest

from conftest import SMALL
import __spark_entry__ as E
from tools.check_oracle import TABLES, digest
from tools.type_audit import SPARK_TO_DUCK

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SMALL)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[name])
    o_cols, o_rows = [d[0] for d in res.description], res.fetchall()
    assert sorted(s_cols) == sorted(o_cols)
    assert len(s_rows) == len(o_rows)
    assert digest(s_cols, s_rows)[0] == digest(o_cols, o_rows)[0]
    # Column types agree too (integer widths, timestamps without zone, ...).
    duck_types = dict(zip(o_cols, (str(t) for t in con.sql(ORACLE[name]).types)))
    for f in df.schema.fields:
        st = f.dataType.simpleString()
        if st.startswith("decimal"):
            assert duck_types[f.name].startswith("DECIMAL"), (f.name, st, duck_types[f.name])
        else:
            assert SPARK_TO_DUCK.get(st, st.upper()) == duck_types[f.name], (f.name, st)


def test_every_query_has_a_twin(spark):
    assert [n for n in E.QUERIES if n not in ORACLE] == []


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "total_registered" in df.columns
