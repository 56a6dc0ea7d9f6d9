"""Run a registered query and its SQL side by side and compare every value."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return "null" if value is None else str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(df, db, sql: str):
    """None when equal, else a short description of the first difference."""
    names = df.columns
    left = _rows(names, [tuple(r) for r in df.collect()])
    result = db.execute(sql)
    other = [d[0] for d in result.description]
    right = _rows(other, result.fetchall())
    if sorted(names) != sorted(other):
        return f"columns {sorted(names)} != {sorted(other)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ; {sorted(names)} first: {bad[0]}"
    return None


def types(df, db, sql: str):
    """Spark and DuckDB types per column, for the columns where they are not alike."""
    alike = {
        "bigint": {"BIGINT"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"},
        "int": {"INTEGER"}, "date": {"DATE"}, "timestamp": {"TIMESTAMP", "TIMESTAMP WITH TIME ZONE"},
        "timestamp_ntz": {"TIMESTAMP"},
    }
    other = {d[0]: d[1] for d in db.execute(f"DESCRIBE {sql}").fetchall()}
    return {
        f.name: (f.dataType.simpleString(), other.get(f.name))
        for f in df.schema.fields
        if other.get(f.name) not in alike.get(f.dataType.simpleString(), set())
    }


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    only = sys.argv[2:]
    spark = make_session()
    db = connect(sf_dir)
    plans, sqls = entry.queries(), entry.oracle_sql()
    for name, plan in plans.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        began = time.time()
        try:
            df = plan(spark, sf_dir)
            if name in sqls:
                verdict = compare(df, db, sqls[name]) or "ok"
                odd = types(df, db, sqls[name])
                if odd:
                    verdict += f" TYPES {odd}"
            else:
                verdict = f"rows only: {df.count()}"
        except Exception as problem:  # report and go on with the next query
            verdict = f"FAILED {type(problem).__name__}: {str(problem)[:1500]}"
        print(f"{name:32s} {time.time() - began:6.2f}s {verdict}", flush=True)
