"""A query's rows against its SQL in DuckDB."""

import glob
import os

import duckdb


def same_rows(spark, run, sql: str, sf_dir: str) -> int:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    mine = [tuple(r[c] for c in names) for r in df.collect()]
    cursor = con.execute(sql)
    theirs_names = [d[0] for d in cursor.description]
    assert sorted(theirs_names) == names
    at = [theirs_names.index(c) for c in names]
    theirs = [tuple(r[i] for i in at) for r in cursor.fetchall()]
    norm = lambda rows: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert norm(mine) == norm(theirs)
    return len(mine)
