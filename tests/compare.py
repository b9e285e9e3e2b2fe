"""Spark result against SQL result, as the driver compares them: by value, in any order."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duckdb_on(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return plain(float(v))
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def differences(df, con, sql: str) -> list[str]:
    """What differs, as text; empty if the results are equal."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    expected = [dict(zip(names, r)) for r in rel.fetchall()]
    found = []
    if sorted(names) != sorted(df.columns):
        found.append(f"columns: {sorted(df.columns)} but SQL has {sorted(names)}")
        return found
    order = sorted(names)
    left = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    right = Counter(tuple(plain(r[c]) for c in order) for r in expected)
    if left != right:
        only_l, only_r = left - right, right - left
        found.append(
            f"rows: {sum(left.values())} and {sum(right.values())} in SQL; "
            f"only Spark {list(only_l.items())[:2]}; only SQL {list(only_r.items())[:2]}"
        )
    kinds = dict(zip(names, [str(d[1]) for d in rel.description]))
    for f in df.schema.fields:
        s, d = f.dataType.simpleString(), kinds[f.name].lower()
        numeric = {"bigint": "bigint", "int": "integer", "double": "double", "string": "varchar", "boolean": "boolean"}
        if numeric.get(s) != d and "null" not in d:
            found.append(f"type of {f.name}: {s} but SQL has {d}")
    return found
