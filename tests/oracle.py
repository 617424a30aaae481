"""Compares a query with its SQL as the driver does: columns by name, rows in any order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df, columns):
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return round(float(v), 9) if isinstance(v, float) else v.item() if hasattr(v, "item") else v

    kept = df[columns].astype(object).where(df[columns].notna(), None)
    out = []
    for r in kept.itertuples(index=False):
        out.append(repr(tuple(int(x) if isinstance(x := plain(v), float) and x.is_integer() else x for v in r)))
    return sorted(out)


def same(found, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    wanted = con.sql(sql).df()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    assert rows(found, columns) == rows(wanted, columns)
