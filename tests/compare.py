"""Row-for-row comparison of a registered query with its DuckDB SQL."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(value):
    """A value in a form that both engines give alike."""
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0 if math.isfinite(value) else value
    if hasattr(value, "as_tuple"):
        return plain(float(value))
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def differences(rows, columns, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if the rows are the same, else what differs."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(columns):
        return f"columns {sorted(columns)} against {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())
    got = Counter(tuple(plain(r[c]) for c in columns) for r in rows)
    if got == want:
        return ""
    return f"{got.total()} rows against {want.total()}; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
