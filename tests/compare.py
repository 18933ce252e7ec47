"""Run registered queries and their SQL side by side: python tests/compare.py SF_DIR [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(x) for x in value) + "]"
    return f"{type(value).__name__}:{value}"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order] and [tuple(_plain(r[i]) for i in order) for r in rows])


def compare(spark, con, sf_dir, run, sql) -> str:
    """Empty text when both sides agree, else what differs."""
    df = run(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if got else "no rows"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = _rows(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2]
        lost = [r for r in want if r not in set(got)][:2]
        return f"rows {len(got)} != {len(want)}; spark only {extra}; sql only {lost}"
    if not got:
        return "no rows on either side"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        lost = sorted(set(want) - set(got))[:2]
        extra = sorted(set(got) - set(want))[:2]
        return f"{len(bad)} rows differ; spark {str(extra)[:900]}; sql {str(lost)[:900]}"
    return ""


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def main(argv):
    import __spark_entry__ as entry

    sf_dir, names = argv[0], argv[1:]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracle = entry.oracle_sql()
    failed = 0
    for name, run in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        began = time.time()
        try:
            problem = compare(spark, con, sf_dir, run, oracle.get(name))
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        failed += bool(problem)
        kind = "sql" if name in oracle else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name} [{kind}] {time.time() - began:.1f}s {problem}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
