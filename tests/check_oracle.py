"""Run catalogue queries and their SQL side by side: python tests/check_oracle.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else repr(x)
        return repr(x)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None when equal, otherwise a short description of the first difference."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", 0
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    exp = canonical(want, names)
    if got == exp:
        return None, len(got)
    bad = [(a, b) for a, b in zip(got, exp) if a != b]
    only = bad[0] if bad else None
    return f"rows {len(got)} vs {len(exp)}, {len(bad)} differ, columns {sorted(names)}; first: {only}", len(got)


def main(argv):
    import __spark_entry__ as entry
    from bellwether.session import get_session

    sf = next((a for a in argv if a.startswith("/")), "/root/testdata/sf0.01")
    picks = [a for a in argv if not a.startswith("/")]
    spark = get_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in qs.items():
        if picks and not any(name == p or (p.endswith("*") and name.startswith(p[:-1])) for p in picks):
            continue
        t = time.time()
        try:
            df = build(spark, sf)
            if name in sqls:
                diff, n = compare(df, con, sqls[name])
            else:
                diff, n = None, len(df.collect())
        except Exception as e:
            diff, n = f"{type(e).__name__}: {str(e)[:600]}", 0
        took = time.time() - t
        if diff:
            bad += 1
            print(f"BAD {name} ({took:.1f}s): {diff}", flush=True)
        else:
            print(f"ok  {name} n={n} {took:.1f}s{'' if name in sqls else ' (rows only)'}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
