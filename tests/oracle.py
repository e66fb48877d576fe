"""Runs queries beside their SQL and compares whole results. Also a command: python tests/oracle.py FOLDER [QUERY...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from datetime import date, datetime
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings cameras zones tracks visit_events tracklets reentry_decisions cross_camera_pair_scores eval_items doc_labels".split()


def plain(value):
    """A value as both engines give it."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in (value if isinstance(value, list) else list(value)))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def sql_rows(folder: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in got.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())


def compare(spark, folder: str, name: str, query, sql: str) -> str:
    """An empty text if they agree, else what differs."""
    columns, rows = spark_rows(query(spark, folder))
    expected_columns, expected = sql_rows(folder, sql)
    if columns != expected_columns:
        return f"{name}: columns {columns} and {expected_columns}"
    if rows != expected:
        more, less = rows - expected, expected - rows
        return f"{name}: {sum(rows.values())} and {sum(expected.values())} rows; too many {sum(more.values())} {list(more)[:3]}; missing {sum(less.values())} {list(less)[:3]}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as e
    from trackloom.session import local_session

    session = local_session(cpus=8)
    session.sparkContext.setLogLevel("ERROR")
    folder, wanted = sys.argv[1], sys.argv[2:]
    sqls = e.oracle_sql()
    failed = 0
    for name, query in e.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        began = time.time()
        try:
            said = compare(session, folder, name, query, sqls[name]) if name in sqls else f"no SQL, {query(session, folder).count()} rows"
        except Exception as x:
            said = f"{name}: {type(x).__name__} {str(x)[:600]}"
        failed += bool(said) and not said.startswith("no SQL")
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
    print("failed:", failed)
