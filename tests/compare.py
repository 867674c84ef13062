"""Runs queries against their SQL: python -m tests.compare [sf0.01] [name prefix ...]."""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings corpus_ds queries_ds qrels_ds qa_ds feat_rows retrieval mix_targets lang_samples".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if p.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return repr([_cell(x) for x in v])
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark, con, sf_dir, name, query, sql) -> str:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want = rows_of([c[0] for c in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return f"rows {len(got[1])} and {len(want[1])}; only here {sorted(a - b)[:3]}, only in SQL {sorted(b - a)[:3]}"
    return ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as E

    sf = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf), E.oracle_sql()
    for name, query in E.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        t = time.time()
        try:
            if name in sqls:
                said = differences(spark, con, sf, name, query, sqls[name]) or "equal"
            else:
                said = f"{query(spark, sf).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            said = f"FAILED {type(e).__name__}: {str(e)[:900]}"
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)
