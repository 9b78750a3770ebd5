"""Compare a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb
from pyspark.sql import types as T


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return None if v is None else repr(v)


def _kind(v: T.DataType) -> str:
    if isinstance(v, (T.DoubleType, T.FloatType)):
        return "float"
    if isinstance(v, (T.LongType, T.IntegerType)):
        return "int"
    return {"string": "str", "boolean": "bool"}.get(v.typeName(), v.typeName())


DUCK_KINDS = {"DOUBLE": "float", "FLOAT": "float", "BIGINT": "int", "INTEGER": "int", "VARCHAR": "str",
              "BOOLEAN": "bool"}


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    names = sorted(df.columns)
    found = con.execute(sql)
    theirs = [c[0] for c in found.description]
    if sorted(theirs) != names:
        return f"columns {names} vs {sorted(theirs)}"
    kinds = {f.name: _kind(f.dataType) for f in df.schema}
    duck = dict(zip(theirs, (DUCK_KINDS.get(str(t[1]), str(t[1])) for t in found.description)))
    if kinds != duck:
        return f"types {[(n, kinds[n], duck[n]) for n in names if kinds[n] != duck[n]]}"
    order = [theirs.index(n) for n in names]
    want = Counter(tuple(_cell(r[i]) for i in order) for r in found.fetchall())
    got = Counter(tuple(_cell(r[n]) for n in names) for r in df.collect())
    if want != got:
        return (f"rows {sum(got.values())} vs {sum(want.values())}; only Spark {list((got - want).items())[:3]}; "
                f"only SQL {list((want - got).items())[:3]}")
    return None
