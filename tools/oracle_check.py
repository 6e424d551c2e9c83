"""Run each registered query on Spark and its SQL on DuckDB; compare.

usage: python tools/oracle_check.py [--sf DIR] [name-prefix ...]

Checks column names, row count, type family and exact values (order
insensitive), the way the round gate does.
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from contrail.plans.registry import all_oracle, all_queries, declared_doubles  # noqa: E402
from contrail.session import get_spark  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, int):
        return str(v)
    return str(v)


def family(t: str) -> str:
    t = t.lower()
    if any(k in t for k in ("int", "long", "short", "byte")):
        return "int"
    if any(k in t for k in ("double", "float", "decimal")):
        return "float"
    if "char" in t or "string" in t:
        return "str"
    if "timestamp" in t:
        return "ts"
    if "date" in t:
        return "date"
    if "bool" in t:
        return "bool"
    return t


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple("" if x is None else x for x in t))


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = get_spark("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    qs, oracle, doubles = all_queries(), all_oracle(), declared_doubles()
    names = [n for n in qs if not a.names or any(n.startswith(p) for p in a.names)]
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            sdf = qs[n](spark, a.sf)
            scols = sdf.columns
            stypes = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: spark error {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        sdoub = [c for c, t in stypes.items() if t in ("double", "float")]
        missing = [c for c in sdoub if c not in doubles.get(n, [])]
        if n not in oracle:
            print(f"ROWS {n}: {len(srows)} rows ({ts:.1f}s)" + (f" undeclared doubles {missing}" if missing else ""))
            continue
        try:
            rel = con.sql(oracle[n])
            ocols = rel.columns
            otypes = dict(zip(ocols, [str(x) for x in rel.types]))
            orows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: duckdb error {str(e)[:600]}")
            bad += 1
            continue
        probs = []
        if sorted(scols) != sorted(ocols):
            probs.append(f"columns spark-only={sorted(set(scols)-set(ocols))} sql-only={sorted(set(ocols)-set(scols))}")
        else:
            tf = [c for c in scols if family(stypes[c]) != family(otypes[c])]
            if tf:
                probs.append("types " + ", ".join(f"{c}:{stypes[c]}/{otypes[c]}" for c in tf))
            if len(srows) != len(orows):
                probs.append(f"rows spark={len(srows)} sql={len(orows)}")
            else:
                a_rows, b_rows = rows_of(scols, srows), rows_of(ocols, orows)
                diff = [(x, y) for x, y in zip(a_rows, b_rows) if x != y]
                if diff:
                    names_sorted = sorted(scols)
                    x, y = diff[0]
                    cd = [(names_sorted[i], x[i], y[i]) for i in range(len(x)) if x[i] != y[i]]
                    probs.append(f"{len(diff)} value diffs, first: {cd[:4]}")
        if missing:
            probs.append(f"undeclared doubles {missing}")
        if probs:
            bad += 1
            print(f"FAIL {n} ({ts:.1f}s): " + " | ".join(probs))
        else:
            print(f"OK   {n}: {len(srows)} rows ({ts:.1f}s)")
    print(f"{len(names) - bad}/{len(names)} ok")
    spark.stop()


if __name__ == "__main__":
    main()
