"""Compare a query with its SQL: columns by name, rows as a multiset, doubles to a relative 1e-6."""

import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return db


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.7g}") + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted([tuple(plain(r[k]) for k in order) for r in rows], key=repr)


def differences(df, db, sql):
    """What differs; empty if nothing."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(sql)
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} {len(want[1])}: only here {[r for r in got[1] if r not in want[1]][:2]}, only SQL {[r for r in want[1] if r not in got[1]][:2]}"
    for a, b in zip(got[1], want[1], strict=True):
        for x, y in zip(a, b, strict=True):
            if x != y and not (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=2e-6, abs_tol=1e-9)):
                return f"{a} {b}"
    return ""
