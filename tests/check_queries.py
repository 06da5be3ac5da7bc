"""Compare registered queries with their SQL on DuckDB.

usage: python tests/check_queries.py [sf] [module,module] [name-substring]
"""
import datetime
import hashlib
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def canon(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


def digest(rows):
    return hashlib.md5(repr(rows).encode()).hexdigest()


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    sec = time.time() - t
    if sql is None:
        return True, f"rows-only n={len(rows)} {sec:.1f}s", df
    t = time.time()
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    dsec = time.time() - t
    sc, sr = table(df.columns, rows)
    dc, dr = table(dcols, drows)
    if sc != dc:
        return False, f"columns differ\n  spark={sc}\n  sql  ={dc}", df
    if sr == dr:
        st = {k: v for k, v in df.dtypes}
        dt = {d[0]: str(d[1]) for d in con.description} if con.description else {}
        odd = [f"{c}:{st[c]}/{dt.get(c)}" for c in st if not types_agree(st[c], dt.get(c, ""))]
        return True, f"n={len(rows)} spark {sec:.1f}s sql {dsec:.1f}s" + (f" TYPES {odd}" if odd else ""), df
    sset, dset = set(sr), set(dr)
    a = [r for r in sr if r not in dset]
    b = [r for r in dr if r not in sset]
    msg = f"MISMATCH spark n={len(sr)} sql n={len(dr)} only-spark {len(a)} only-sql {len(b)}\n  {sc}"
    for x, y in list(zip(a, b))[:3]:
        msg += f"\n  S {x}\n  D {y}"
    if not (a and b):
        msg += f"\n  S {a[:2]}\n  D {b[:2]}"
    return False, msg, df


def types_agree(s, d):
    m = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    if s in m:
        return d.upper() in (m[s], "NUMBER", "STRING") or d.upper().startswith(m[s])
    return True


def main():
    import duckdb
    from tapeworks.queries import HOME, load_all
    from tapeworks.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    mods = sys.argv[2].split(",") if len(sys.argv) > 2 and sys.argv[2] != "all" else None
    sub = sys.argv[3] if len(sys.argv) > 3 else ""
    d = f"/root/testdata/sf{sf}"
    q, o = load_all(mods)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(Path(d).glob("*.parquet")):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    spark = local_session(8)
    bad = []
    for name, fn in q.items():
        if mods and HOME[name] not in mods:
            continue
        if sub and not any(s in name for s in sub.split(",")):
            continue
        try:
            ok, msg, _ = compare(spark, con, name, fn, o.get(name), d)
        except Exception as e:
            ok, msg = False, f"{type(e).__name__}: {str(e)[:500]}"
        print(("ok   " if ok else "FAIL ") + name + "  " + msg, flush=True)
        if not ok:
            bad.append(name)
    print("FAILED:", bad)


if __name__ == "__main__":
    main()
