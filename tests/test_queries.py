"""Every registered query against the SQL that checks it."""

from __future__ import annotations

import math

import pytest

import __spark_entry__ as contract

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda at: columns[at])

    def value(v):
        if isinstance(v, float):
            return "NaN" if math.isnan(v) else str(round(v, 9) + 0.0)
        return str(v)

    return sorted(tuple(value(row[at]) for at in order) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = comparable([tuple(row) for row in df.collect()], df.columns)
    if name not in ORACLES:
        return
    cursor = duck.execute(ORACLES[name])
    columns = [entry[0] for entry in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == comparable(cursor.fetchall(), columns)


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_sketches_are_not_made_for_every_distinct_value(spark, sf_dir):
    plan = QUERIES["approximate_statistics"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("functions=")[0] for line in plan.splitlines() if "percentile_approx" in line and "keys=" in line]
    assert keys and not any("l_partkey" in key for key in keys)
