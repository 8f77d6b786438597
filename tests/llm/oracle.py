"""Runs a query and its SQL on the same tables."""

import duckdb


def both(spark, query, sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    want = con.sql(sql).fetchall()
    names = [c[0] for c in con.sql(f"DESCRIBE {sql}").fetchall()]
    got = [tuple(r[n] for n in names) for r in query.collect()]
    assert set(query.columns) == set(names)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    return sorted(got, key=key), sorted(want, key=key)
