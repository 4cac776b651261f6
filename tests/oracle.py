"""Compare registered queries with their oracles: python tests/oracle.py SF [name prefix ...]."""

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
        return float(int(v))
    return v


def sorted_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    got = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(got, key=repr)


FAMILY = {"bigint": "int64", "int": "int32", "double": "float", "float": "float", "string": "text", "boolean": "bool",
          "BIGINT": "int64", "INTEGER": "int32", "DOUBLE": "float", "FLOAT": "float", "VARCHAR": "text", "BOOLEAN": "bool"}


def compare(df, con, text):
    """None if equal, else a short reason."""
    rel = con.sql(text)
    want_cols, want_types = list(rel.columns), [str(t) for t in rel.types]
    want = rel.fetchall()
    got = df.collect()
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} vs {sorted(want_cols)}"
    kinds = {c: FAMILY.get(t, t) for c, t in df.dtypes}
    wkinds = {c: FAMILY.get(t, t) for c, t in zip(want_cols, want_types)}
    if kinds != wkinds:
        return f"types {[(c, kinds[c], wkinds[c]) for c in kinds if kinds[c] != wkinds[c]]}"
    a, b = sorted_rows(df.columns, got), sorted_rows(want_cols, want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    if a != b:
        only_a, only_b = set(a) - set(b), set(b) - set(a)
        return f"cols {sorted(df.columns)}: {len(only_a)} only spark {str(sorted(only_a, key=repr)[:3])[:500]}; {len(only_b)} only sql {str(sorted(only_b, key=repr)[:3])[:500]}"
    return None


def session():
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def main():
    import __spark_entry__ as entry

    sf = sys.argv[1]
    names = sys.argv[2:]
    spark, sf_dir = session(), f"{DATA}/sf{sf}"
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in sorted(queries.items()):
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                why = compare(df, con, oracles[name])
                n = ""
            else:
                n, why = df.count(), None
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:700]}"
        bad += why is not None
        print(f"{'ok ' if why is None else 'BAD'} {name} {time.time() - t:.1f}s {n if name not in oracles else ''} {why or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
