"""Run a registered query and its SQL twin and compare them as unordered rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from runlens.plans.registry import TABLE_NAMES


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLE_NAMES:
        con.execute(f"create view {name} as select * from read_parquet('{path}/{name}.parquet')")
    return con


def canonical(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else ("f", float(f"{v:.9g}"))
    if isinstance(v, decimal.Decimal):
        return ("d", str(v.normalize()))
    if isinstance(v, datetime.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, datetime.date):
        return ("day", v.isoformat())
    if isinstance(v, dict):
        return ("m", tuple(sorted((k, canonical(x)) for k, x in v.items())))
    if hasattr(v, "asDict"):
        return canonical(v.asDict(recursive=True))
    if isinstance(v, (list, tuple)):
        return ("l", tuple(canonical(x) for x in v))
    return v


def differences(con, df, sql: str, show: int = 3) -> list[str]:
    """Empty when the rows agree."""
    out = []
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    expected_rows = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    order = sorted(names)
    at = [names.index(n) for n in order]
    expected = sorted((repr([canonical(r[i]) for i in at]) for r in expected_rows))
    got = sorted(repr([canonical(r[n]) for n in order]) for r in df.select(*order).collect())
    if len(got) != len(expected):
        out.append(f"rows {len(got)} != {len(expected)}")
    if got != expected:
        a, b = set(got), set(expected)
        out.append(f"{len(a - b)} only in spark, {len(b - a)} only in sql; columns {order}")
        out += ["  spark " + x[:400] for x in sorted(a - b)[:show]] + ["  sql   " + x[:400] for x in sorted(b - a)[:show]]
    if not got:
        out.append("no rows")
    return out
