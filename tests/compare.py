"""Rows of a query against those of its SQL, in any order."""

from __future__ import annotations

import decimal
import math


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return v


def ordered(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def assert_same(df, con, sql):
    names = sorted(df.columns)
    got = ordered(df.select(*(f"`{c}`" for c in names)).collect())
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    assert got == ordered([tuple(r[i] for i in at) for r in cursor.fetchall()])
