"""Compare registered queries with their oracle SQL on one set of tables.

Run as ``python tests/oracle_check.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    out = df.astype(object).where(df.notna(), None)
    return out.sort_values(by=list(out.columns), key=lambda s: s.astype(str)).reset_index(drop=True)


def kinds(df: pd.DataFrame) -> dict:
    def kind(s):
        k = s.dropna().map(type).map(lambda t: t.__name__).unique()
        return {"int" if n.startswith("int") else "float" if n.startswith("float") else n for n in k}

    return {c: kind(df[c]) for c in df.columns}


def compare(spark, con, query, sql, sf_dir):
    """(matches, message) of one query."""
    t0 = time.time()
    # The driver hands plain tuples around; missing numbers stay None.
    frame = query(spark, sf_dir)
    left = pd.DataFrame([tuple(r) for r in frame.collect()], columns=frame.columns, dtype=object)
    t1 = time.time()
    if sql is None:
        return len(left) > 0, f"{len(left)} rows, no oracle, {t1 - t0:.1f}s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    right = pd.DataFrame(cur.fetchall(), columns=names, dtype=object)
    t2 = time.time()
    note = f"{len(left)} rows, spark {t1 - t0:.1f}s, duckdb {t2 - t1:.1f}s"
    if sorted(left.columns) != sorted(right.columns):
        return False, f"{note}; columns {sorted(left.columns)} != {sorted(right.columns)}"
    if len(left) != len(right):
        return False, f"{note}; duckdb has {len(right)} rows"
    a, b = normal(left), normal(right)
    bad = None
    for c in a.columns:
        same = [x == y or (x is None and y is None) for x, y in zip(a[c], b[c])]
        if not all(same):
            n = same.index(False)
            bad = f"{same.count(False)} differ in {c}; row {n}: {a.loc[n].to_dict()} != {b.loc[n].to_dict()}"
            break
    ka, kb = kinds(a), kinds(b)
    odd = {c: (ka[c], kb[c]) for c in ka if ka[c] != kb[c] and ka[c] and kb[c]}
    if bad:
        return False, f"{note}; {bad}"
    if odd:
        return False, f"{note}; types {odd}"
    return len(left) > 0, note + ("" if len(left) else "; EMPTY")


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("CHECK_DIR", "/tmp/terrachron-check"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = session(), connect(sf_dir)
    failed = []
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in queries:
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, message = compare(spark, con, queries[name], oracles.get(name), sf_dir)
        except Exception as exc:  # report and go on
            ok, message = False, f"{type(exc).__name__}: {str(exc)[:1200]}"
        print("ok  " if ok else "FAIL", name, message, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
