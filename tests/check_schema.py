"""Compare result column types of each Spark query with its DuckDB oracle (binding only, nothing runs)."""

import sys

import duckdb

sys.path.insert(0, "/root/repo")
import __spark_entry__ as E  # noqa: E402
from tempovar.session import local_session  # noqa: E402

SPARK = {"int": "int32", "bigint": "int64", "double": "double", "string": "string", "date": "date",
         "timestamp_ntz": "timestamp", "timestamp": "timestamp", "boolean": "bool", "smallint": "int16", "tinyint": "int8"}
DUCK = {"INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
        "TIMESTAMP": "timestamp", "BOOLEAN": "bool", "SMALLINT": "int16", "TINYINT": "int8", "HUGEINT": "int128",
        "DECIMAL": "decimal", "FLOAT": "float"}


def main(sf="/root/testdata/sf0.01"):
    spark = local_session()
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for name in qs:
        if name not in os_:
            continue
        s = {f.name: SPARK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in qs[name](spark, sf).schema}
        rel = con.sql(os_[name])
        o = {c: DUCK.get(str(t).split("(")[0], str(t)) for c, t in zip(rel.columns, rel.types)}
        diff = {c: (s.get(c), o.get(c)) for c in set(s) | set(o) if s.get(c) != o.get(c)}
        if diff:
            bad += 1
            print(name, diff)
    print("queries with type differences:", bad)


if __name__ == "__main__":
    main()
