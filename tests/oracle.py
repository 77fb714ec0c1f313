"""Run queries next to DuckDB: ``python tests/oracle.py [sf] [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def norm(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def compare(df, con, sql):
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols, (sorted(names), cols)
    order = [names.index(c) for c in cols]
    want = Counter(tuple(norm(r[i]) for i in order) for r in rel.fetchall())
    missing, extra = want - got, got - want
    return sum(got.values()), sum(want.values()), list(missing.items())[:3], list(extra.items())[:3]


def main():
    from tests.conftest import make_session
    import __spark_entry__ as e
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.001"
    sf_dir = f"/root/testdata/{sf}"
    spark = make_session()
    con = connect(sf_dir)
    queries, sqls = e.queries(), e.oracle_sql()
    names = [n for n in queries if not sys.argv[2:] or any(n.startswith(p) for p in sys.argv[2:])]
    bad = 0
    for name in names:
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sqls:
                got, want, missing, extra = compare(df, con, sqls[name])
                ok = not missing and not extra
                print(f"{'ok ' if ok else 'BAD'} {name} rows={got}/{want} {time.time() - t:.1f}s", flush=True)
                if not ok:
                    bad += 1
                    print("   missing", str(missing)[:600])
                    print("   extra  ", str(extra)[:600])
            else:
                print(f"ok  {name} rows={df.count()} (no SQL) {time.time() - t:.1f}s", flush=True)
        except Exception as ex:  # noqa: BLE001
            bad += 1
            print(f"ERR {name}: {str(ex)[:1500]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
