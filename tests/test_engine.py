"""Every registered query runs; those with SQL are held to DuckDB's rows."""

import datetime as dt
from decimal import Decimal

import duckdb
import pytest

from veritrace.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("nation", "customer", "part", "orders", "lineitem", "events", "documents", "labels")


def plain(value):
    if isinstance(value, (float, Decimal)):
        return "null" if value != value else f"{float(value):.6f}"
    if isinstance(value, dt.datetime):
        return value.date().isoformat() if value.time() == dt.time() else value.isoformat()
    return "null" if value is None else str(value)


def rows_of(rows, columns):
    return sorted(tuple(plain(r[c]) for c in columns) for r in rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, db, key):
    df = QUERIES[key](spark, SF)
    got = df.collect()
    assert got
    if key in ORACLES:
        cursor = db.execute(ORACLES[key])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        want = [dict(zip(names, r)) for r in cursor.fetchall()]
        columns = sorted(names)
        assert rows_of(got, columns) == rows_of(want, columns)


def test_checkup_messages(spark):
    found = {r["check"]: (r["severity"], r["message"]) for r in QUERIES["checkup_findings"](spark, SF).collect()}
    assert found["fill_programs"][0] == "error" and found["fill_programs"][1] == "no record carries a program any more, 100% did"
    assert found["record_count"][0] == "warn" and "records, was" in found["record_count"][1] and "(down " in found["record_count"][1]
    assert found["orphans"][1].startswith("3 child row(s) matched no record: 3 in alt")
