"""Runs a registered query and its SQL over one folder of tables."""

import math
from pathlib import Path

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def same_rows(spark, run, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = run(spark, str(DATA))
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert sorted(df.columns) == sorted(names)
    assert got == want
