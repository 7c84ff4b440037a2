"""Compare registered queries with their SQL counterparts: ``python -m tests.oracle_check [sf] [query ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

from pyspark.sql import DataFrame

DATA = Path("/root/testdata")
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


def _sortable(row):
    return tuple((v is not None, isinstance(v, float) and math.isnan(v), str(v)) for v in row)


def sql_rows(sf_dir: str, sql: str) -> tuple[dict[str, str], list[tuple]]:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'").fetchall()
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    names = sorted(types)
    picked = ", ".join(f'"{c}"' for c in names)
    return types, con.execute(f"SELECT {picked} FROM ({sql}) q").fetchall()


def differences(df: DataFrame, sf_dir: str, sql: str) -> list[str]:
    types, want = sql_rows(sf_dir, sql)
    names = sorted(df.columns)
    if names != sorted(types):
        return [f"columns {names} != {sorted(types)}"]
    kinds = dict(df.dtypes)
    found = [f"type of {c}: {kinds[c]} != {types[c]}" for c in names if TYPES.get(kinds[c]) != types[c]]
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=_sortable)
    want = sorted(want, key=_sortable)
    if len(got) != len(want):
        return [*found, f"{len(got)} rows != {len(want)}"]
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return found + [f"{len(bad)} of {len(got)} rows differ, first {pair}" for pair in bad[:1]]


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from ridelake.session import get_session

    sf_dir = str(DATA / (sys.argv[1] if len(sys.argv) > 1 else "sf0.01"))
    spark = get_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    oracle, failed = oracle_sql(), 0
    for name, run in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracle:
                verdict = differences(df, sf_dir, oracle[name])
            else:
                verdict = [] if df.count() else ["no rows"]
        except Exception as error:  # noqa: BLE001
            verdict = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(verdict)
        print(f"{'FAIL' if verdict else 'ok  '} {name} {time.time() - start:.1f}s {'; '.join(verdict)}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
