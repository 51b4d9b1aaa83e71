"""Order-insensitive comparison of a Spark frame with a DuckDB query."""

import math


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v if isinstance(v, (int, str, bool, type(None))) else str(v)


def check(df, con, sql):
    columns = sorted(df.columns)
    got = sorted(repr([plain(x) for x in r]) for r in df.select(*columns).collect())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in rel.fetchall())
    assert columns == sorted(names)
    assert got == want
