"""Comparison of a Spark query with its SQL twin in DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path / '*.parquet' if path.is_dir() else path}')")
    return con


def plain(v):
    """A value in a form that both engines' rows can be compared in."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else 0.0 if abs(v) < 5e-6 else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, int):
        return v
    return str(v)


def family(kind: str) -> str:
    """Spark's and DuckDB's names of a type under one name."""
    kind = kind.lower()
    return {"bigint": "long", "hugeint": "huge", "integer": "int", "varchar": "string", "timestamp_ntz": "timestamp", "bool": "boolean", "tinyint": "int", "smallint": "int"}.get(kind, kind)


def spark_rows(df) -> tuple[list[str], list[str], Counter]:
    names = sorted(df.columns)
    kinds = dict(df.dtypes)
    return names, [family(kinds[n]) for n in names], Counter(tuple(plain(r[n]) for n in names) for r in df.collect())


def duck_rows(con, sql: str) -> tuple[list[str], list[str], Counter]:
    out = con.execute(sql)
    columns = [(d[0], str(d[1])) for d in out.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i][0])
    return [columns[i][0] for i in order], [family(columns[i][1]) for i in order], Counter(tuple(plain(r[i]) for i in order) for r in out.fetchall())


def difference(df, con, sql: str) -> str:
    """What differs; empty if nothing does."""
    names, kinds, rows = spark_rows(df)
    names2, kinds2, rows2 = duck_rows(con, sql)
    if names != names2:
        return f"columns {names} and {names2}"
    said = [f"{n}: {a} and {b}" for n, a, b in zip(names, kinds, kinds2) if a != b]
    only, only2 = rows - rows2, rows2 - rows
    if only or only2:
        said.append(f"{sum(rows.values())} and {sum(rows2.values())} rows; only Spark: {list(only)[:2]}; only SQL: {list(only2)[:2]}")
    return "; ".join(said)
