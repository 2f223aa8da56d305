"""Compare a Spark result with SQL run by DuckDB on the same parquet tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _kind(name: str) -> str:
    name = name.lower()
    return {"bigint": "int64", "long": "int64", "integer": "int32", "int": "int32", "varchar": "string"}.get(name, name)


def _sortable(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str, places: int = 6) -> list[str]:
    """What differs: column names or types, row count, or values (numbers to ``places``)."""
    columns = sorted(df.columns)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = dict(zip(names, (str(d[1]) for d in cursor.description)))
    if sorted(names) != columns:
        return [f"columns {columns} against {sorted(names)}"]
    out = []
    ours = dict(df.dtypes)
    for c in columns:
        if _kind(ours[c]) != _kind(types[c]):
            out.append(f"type of {c}: {ours[c]} against {types[c]}")
    want = cursor.fetchall()
    order = [names.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in want), key=_sortable)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=_sortable)
    if len(want) != len(got):
        return out + [f"{len(got)} rows against {len(want)}"]
    exact = sum(a != b for a, b in zip(got, want))
    bad = [(a, b) for a, b in zip(got, want) if not all(_same(x, y, places) for x, y in zip(a, b))]
    if bad:
        out.append(f"{len(bad)} of {len(got)} rows differ, first {bad[0]}")
    elif exact:
        out.append(f"note: {exact} of {len(got)} rows differ in the last rounded digit")
    return out


def _same(x, y, places: int) -> bool:
    if isinstance(x, float) and isinstance(y, float):
        return math.isclose(x, y, rel_tol=10.0**-places, abs_tol=2 * 10.0**-places)
    return x == y
