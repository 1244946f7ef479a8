"""Local stand-in for the driver's correctness gate: Spark query vs DuckDB oracle, order-insensitive."""

from __future__ import annotations

import json
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as E  # noqa: E402
from tempovar.session import local_session  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "benchmark", "labels"]


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(records):
    return sorted((tuple(norm(x) for x in r) for r in records), key=repr)


def main(sf_dir: str, names: list[str]):
    spark = local_session(os.environ.get("CHECK_CPUS", "*"))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    qs, os_ = E.queries(), E.oracle_sql()
    report = {}
    for name in names or [n for n in qs if n != "pipeline" and not n.startswith("op")]:
        t0 = time.time()
        df = qs[name](spark, sf_dir)
        cols = sorted(df.columns)
        srows = rows_of(df.select(*cols).collect())
        t1 = time.time()
        if name not in os_:
            report[name] = {"rows": len(srows), "oracle": None}
            print(name, "no oracle", len(srows), flush=True)
            continue
        rel = con.sql(os_[name])
        ocols = rel.columns
        odf = rel.fetchall()
        idx = [ocols.index(c) if c in ocols else None for c in cols]
        if None in idx or len(ocols) != len(cols):
            print(name, "COLUMN MISMATCH", sorted(ocols), cols, flush=True)
            report[name] = {"match": False}
            continue
        orows = rows_of([tuple(r[i] for i in idx) for r in odf])
        ok = srows == orows
        report[name] = {"match": ok, "spark_rows": len(srows), "oracle_rows": len(orows),
                        "spark_s": round(t1 - t0, 1), "oracle_s": round(time.time() - t1, 1)}
        print(name, report[name], flush=True)
        if not ok:
            sset, oset = set(srows), set(orows)
            print("  only spark:", list(sset - oset)[:3])
            print("  only oracle:", list(oset - sset)[:3])
            print("  cols:", cols)
    return report


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    rep = main(sf, sys.argv[2:])
    print(json.dumps({k: v.get("match") for k, v in rep.items()}))
