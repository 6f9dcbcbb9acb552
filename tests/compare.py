"""Run a registered query and its SQL, and compare names, types and values."""

import datetime as dt
import decimal
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    if isinstance(value, decimal.Decimal):
        return str(value.normalize())
    return value


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    body = [tuple(cell(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(body, key=repr)


def kinds(rows):
    """Python type per column, to catch int/float/decimal mix-ups."""
    found = {}
    for row in rows:
        for i, v in enumerate(row):
            if v is not None:
                found.setdefault(i, set()).add(type(v).__name__)
    return found


def compare(spark, con, entry, sf_dir):
    """(rows, problem) where problem is None on a full match."""
    frame = entry.run(spark, sf_dir)
    names, ours = table_of(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(entry.sql)
    other_names, theirs = table_of([d[0] for d in cursor.description], cursor.fetchall())
    if names != other_names:
        return len(ours), f"columns {names} != {other_names}"
    if len(ours) != len(theirs):
        return len(ours), f"rows {len(ours)} != {len(theirs)}; only ours {list(set(ours) - set(theirs))[:2]}; only sql {list(set(theirs) - set(ours))[:2]}"
    if kinds(ours) != kinds(theirs):
        return len(ours), f"types {kinds(ours)} != {kinds(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return len(ours), f"values {a} != {b}"
    return len(ours), None
