"""Runs a query and its SQL over the same tables, and compares them as the driver does: any order, columns by name."""

import duckdb

from tessera.llm import queries


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(r[i] for i in order) for r in data], key=repr)


def agree(spark, name, sf_dir, tables=("documents", "benchmark", "labels")):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(found.columns)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(found.columns, found.fetchall())
    assert len(got) == len(want)
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not wrong, wrong[:5]
