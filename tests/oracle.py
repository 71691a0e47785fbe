"""Hold queries against their SQL in DuckDB: python tests/oracle.py SF_DIR [NAME...]"""

import os
import sys
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return 0.0 if x == 0 else x
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, duck, query, sql, sf):
    """What differs, or an empty string."""
    df = query(spark, sf)
    got = rows_of(df.columns, df.collect())
    rel = duck.execute(sql)
    names = [x[0] for x in rel.description]
    want = rows_of(names, rel.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:3]}; only in SQL {list((want - got).items())[:3]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    from framelode.plans.registry import ORACLES, QUERIES

    session = SparkSession.builder.master(f"local[{os.environ.get('CPUS', '4')}]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    duck = connect(sys.argv[1])
    for name in sys.argv[2:] or QUERIES:
        began = time.time()
        try:
            said = compare(session, duck, QUERIES[name], ORACLES[name], sys.argv[1]) if name in ORACLES else f"no SQL; {QUERIES[name](session, sys.argv[1]).count()} rows"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
