"""Runs registered queries on Spark and their SQL on DuckDB and compares rows as multisets."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}") + 0.0
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _kind(name: str) -> str:
    name = name.lower()
    for kind, words in {"int": ("int", "hugeint", "long"), "float": ("double", "float", "decimal"),
                        "str": ("string", "varchar"), "time": ("timestamp",), "bool": ("bool",),
                        "date": ("date",)}.items():
        if any(name.startswith(w) or name.endswith(w) for w in words):
            return kind
    return name


def spark_rows(df):
    columns = sorted(df.columns)
    kinds = {c: _kind(t) for c, t in df.dtypes}
    rows = [tuple(_plain(r[c]) for c in columns) for r in df.collect()]
    return columns, [kinds[c] for c in columns], Counter(rows)


def duck_rows(con, text):
    rel = con.sql(text)
    names = list(rel.columns)
    kinds = dict(zip(names, (_kind(str(t)) for t in rel.types)))
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    rows = [tuple(_plain(r[i]) for i in at) for r in rel.fetchall()]
    return columns, [kinds[c] for c in columns], Counter(rows)


def difference(spark_side, duck_side) -> str | None:
    if spark_side[0] != duck_side[0]:
        return f"columns {spark_side[0]} != {duck_side[0]}"
    if spark_side[1] != duck_side[1]:
        return f"types {list(zip(spark_side[0], spark_side[1]))} != {duck_side[1]}"
    ours, theirs = spark_side[2], duck_side[2]
    if ours != theirs:
        only_spark, only_duck = ours - theirs, theirs - ours
        show = lambda c: "\n    ".join(str(r)[:600] for r in sorted(c, key=str)[:3])
        return (f"rows {sum(ours.values())} vs {sum(theirs.values())}; only spark {sum(only_spark.values())}:\n    "
                f"{show(only_spark)}\n  only sql {sum(only_duck.values())}:\n    {show(only_duck)}")
    return None


def main() -> int:
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    import __spark_entry__ as entry
    from pyrewatch.session import local_session

    spark = local_session("compare")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    wanted = [q for q in queries if not sys.argv[1:] or any(w in q for w in sys.argv[1:])]
    failed = []
    for name in wanted:
        start = time.time()
        try:
            ours = spark_rows(queries[name](spark, sf_dir))
            middle = time.time()
            if name not in sqls:
                print(f"rows  {name}: {sum(ours[2].values())} rows {middle - start:.1f}s", flush=True)
                continue
            problem = difference(ours, duck_rows(con, sqls[name]))
            empty = " EMPTY" if not ours[2] else ""
        except Exception as error:  # noqa: BLE001
            problem, middle, empty = f"{type(error).__name__}: {str(error)[:1500]}", time.time(), ""
        if problem:
            failed.append(name)
            print(f"FAIL  {name}: {problem}", flush=True)
        else:
            print(f"ok    {name}: {sum(ours[2].values())} rows{empty} spark {middle - start:.1f}s "
                  f"sql {time.time() - middle:.1f}s", flush=True)
    print(f"{len(wanted) - len(failed)}/{len(wanted)} match; failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
