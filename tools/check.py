"""Run registered queries and compare each with its SQL in DuckDB.

usage: python tools/check.py SF_DIR [name-or-prefix ...]
"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import duckdb  # noqa: E402

from itemloom.registry import QUERIES  # noqa: E402
from itemloom.session import build_session  # noqa: E402
import itemloom.queries  # noqa: E402,F401


def canon(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def main(folder, names):
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    bad = 0
    for q in QUERIES.values():
        if names and not any(q.name.startswith(n) for n in names):
            continue
        t0 = time.time()
        try:
            df = q.run(spark, folder)
            rows = df.collect()
        except Exception as e:  # report and go on
            print(f"FAIL {q.name}: {str(e)[:1500]}")
            bad += 1
            continue
        took = time.time() - t0
        if q.sql is None:
            print(f"rows {q.name}: {len(rows)} rows {took:.1f}s")
            continue
        try:
            t0 = time.time()
            cur = con.execute(q.sql)
            cols = [d[0] for d in cur.description]
            want = cur.fetchall()
            dt = time.time() - t0
        except Exception as e:
            print(f"SQLERR {q.name}: {str(e)[:800]}")
            bad += 1
            continue
        if sorted(cols) != sorted(df.columns):
            print(f"COLS {q.name}: spark {sorted(df.columns)} sql {sorted(cols)}")
            bad += 1
            continue
        order = sorted(df.columns)
        got = sorted(tuple(canon(r[c]) for c in order) for r in rows)
        exp = sorted(tuple(canon(r[cols.index(c)]) for c in order) for r in want)
        if got == exp:
            print(f"ok   {q.name}: {len(rows)} rows {took:.1f}s (sql {dt:.1f}s)")
        else:
            bad += 1
            sg, se = set(got), set(exp)
            only_g = [r for r in got if r not in se][:3]
            only_e = [r for r in exp if r not in sg][:3]
            print(f"DIFF {q.name}: {len(got)} vs {len(exp)} {order}\n   spark {str(only_g)[:700]}\n   sql   {str(only_e)[:700]}")
    print("bad:", bad)


main(sys.argv[1], sys.argv[2:])
