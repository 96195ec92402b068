"""Compare a registered query with its SQL on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.12g}" if v != int(v) or abs(v) > 1e15 else str(int(v))
    if isinstance(v, bool) or v is None:
        return str(v)
    if hasattr(v, "asDict"):
        return str({k: _plain(x) for k, x in sorted(v.asDict().items())})
    if isinstance(v, dict):
        return str({k: _plain(x) for k, x in sorted(v.items())})
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def spark_side(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def duck_side(con, sql):
    cur = con.execute(sql)
    return table([d[0] for d in cur.description], cur.fetchall())


def difference(df, con, sql) -> str | None:
    """None when equal, else a short account of the first difference."""
    (sc, sr), (dc, dr) = spark_side(df), duck_side(con, sql)
    if sc != dc:
        return f"columns {sc} != {dc}"
    if len(sr) != len(dr):
        only_s, only_d = sorted(set(sr) - set(dr))[:2], sorted(set(dr) - set(sr))[:2]
        return f"rows {len(sr)} != {len(dr)}; spark only {only_s}; sql only {only_d}"
    for a, b in zip(sr, dr):
        if a != b:
            return f"{sc}: spark {a} != sql {b}"
    return None if sr else "both sides are empty"
