"""Runs queries against their DuckDB twins: python tests/oracle.py [SF] [NAME...]"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return round(v, 5) + 0.0
        if isinstance(v, (list, tuple)):
            return tuple(plain(x) for x in v)
        return int(v) if isinstance(v, bool) else v

    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, name, f, sql, sf_dir):
    df = f(spark, sf_dir)
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    b = rows(rel.columns, rel.fetchall())
    if a == b:
        return len(a[1]), ""
    if a[0] != b[0]:
        return len(a[1]), f"columns {a[0]} | {b[0]}"
    only_a = [x for x in a[1] if x not in set(b[1])][:3]
    only_b = [x for x in b[1] if x not in set(a[1])][:3]
    return len(a[1]), f"{len(a[1])} | {len(b[1])} rows; ours {only_a}; twin {only_b}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or [n for n in queries if not n.startswith(("op", "pipeline"))]:
        t = time.time()
        try:
            n, diff = compare(spark, con, name, queries[name], oracle[name], sf_dir) if name in oracle else (queries[name](spark, sf_dir).count(), "")
        except Exception as e:  # noqa: BLE001  a report of every query
            n, diff = -1, str(e)[:700]
        bad += bool(diff)
        print(f"{'BAD' if diff else 'ok '} {name} {n} rows {time.time() - t:.1f}s{' no twin' if name not in oracle else ''} {diff[:900]}", flush=True)
    print("bad:", bad)
