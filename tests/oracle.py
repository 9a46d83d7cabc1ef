"""A query and its SQL over the smallest tables, as bags of rows."""

import decimal
import os

import duckdb

SF = os.environ.get("INKWELL_TEST_SF", "/root/testdata/sf0.001")


def connect():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        name, ext = os.path.splitext(f)
        if ext == ".parquet":
            c.execute(f"create view {name} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v + 0.0:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    return str(v)


def same(spark, con, query, sql):
    df = query(spark, SF)
    cols = sorted(df.columns)
    got = sorted([plain(r[c]) for c in cols] for r in df.select(*[f"`{c}`" for c in cols]).collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted([plain(r[names.index(c)]) for c in cols] for r in cur.fetchall())
    assert got == want
    return len(got)
