"""python tests/oracle.py SF [NAME...]: holds queries against their SQL in DuckDB, as sorted rows."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "wordlist doclist doc_lengths docstore info source_plan lang_samples"
).split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(rows):
    def one(v):
        if isinstance(v, float):
            return f"{v:.6g}"
        return repr(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


def compare(df, con, sql):
    """(rows, what differs or '')."""
    cols = sorted(df.columns)
    ours = canon(df.select(*[f"`{c}`" for c in cols]).collect())
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return len(ours), f"columns {cols} and {sorted(rel.columns)}"
    theirs = canon(rel.select(*[f'"{c}"' for c in cols]).fetchall())
    if ours == theirs:
        return len(ours), ""
    a, b = set(ours), set(theirs)
    return len(ours), f"{len(ours)} and {len(theirs)} rows; only ours {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf, names = sys.argv[1], sys.argv[2:]
    d = f"/root/testdata/{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = duck(d), e.oracle_sql()
    bad = 0
    for name, f in e.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            if name in sql:
                n, why = compare(f(spark, d), con, sql[name])
            else:
                n, why = f(spark, d).count(), ""
        except Exception as x:  # noqa: BLE001
            n, why = -1, str(x)[:600]
        bad += bool(why)
        print(f"{'BAD ' if why else 'ok  '} {name} {n} rows {time.time() - t:.1f}s {'' if name in sql else '(no SQL)'} {why}", flush=True)
    sys.exit(bool(bad))
