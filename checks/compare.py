"""Run registered queries and their SQL side by side: python -m checks.compare SF_DIR [name ...]."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of_spark(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(r[n] for n in names) for r in df.collect())


def rows_of_sql(con, text: str) -> tuple[list[str], Counter]:
    cur = con.execute(text)
    columns = [d[0] for d in cur.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(r[i] for i in order) for r in cur.fetchall())


def main() -> None:
    from checks.oracle import build
    from checks.queries import QUERIES

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    oracle, con = build(), connect(sf_dir)
    for name in names:
        t0 = time.time()
        try:
            cols, got = rows_of_spark(QUERIES[name](spark, sf_dir))
            t1 = time.time()
            if name not in oracle:
                print(f"ROWS {name} {sum(got.values())} {t1 - t0:.1f}s", flush=True)
                continue
            ocols, want = rows_of_sql(con, oracle[name])
            same = cols == ocols and got == want
            print(f"{'OK  ' if same else 'DIFF'} {name:28s} {sum(got.values()):7d} {sum(want.values()):7d} spark {t1 - t0:.1f}s sql {time.time() - t1:.1f}s", flush=True)
            if not same:
                print("  columns", cols, ocols)
                print("  only spark", sum((got - want).values()), list((got - want))[:4])
                print("  only sql  ", sum((want - got).values()), list((want - got))[:4], flush=True)
        except Exception as err:
            print(f"FAIL {name} {type(err).__name__} {str(err)[:700]}", flush=True)


if __name__ == "__main__":
    main()
