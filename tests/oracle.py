"""Run registered queries beside their oracle SQL.

    python tests/oracle.py sf_dir [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False, name=None):
        rows.append(tuple(None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v for v in row))
    return list(frame.columns), sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    frame = fn(spark, sf_dir).toArrow()
    took = time.time() - start
    if sql is None:
        return frame.num_rows > 0, f"{frame.num_rows} rows, no oracle, {took:.1f}s"
    expected = con.sql(sql).to_arrow_table()
    types = {f.name: str(f.type) for f in frame.schema}
    want = {f.name: str(f.type) for f in expected.schema}
    problems = []
    if types != want:
        problems.append(f"types {sorted((k, types.get(k), want.get(k)) for k in types.keys() | want.keys() if types.get(k) != want.get(k))}")
    got_cols, got = canonical(frame.to_pandas())
    exp_cols, exp = canonical(expected.to_pandas())
    if got_cols != exp_cols:
        problems.append(f"columns {got_cols} != {exp_cols}")
    elif got != exp:
        diff = next(((g, e) for g, e in zip(got, exp) if g != e), None)
        problems.append(f"values: {len(got)} rows against {len(exp)}, first difference {str(diff)[:700]}")
    return not problems, f"{len(got)} rows, {took:.1f}s " + "; ".join(problems)


def main() -> None:
    import __spark_entry__ as entry

    from gridmosaic.session import local_session

    sf_dir, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            ok, note = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as error:  # report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:900]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
