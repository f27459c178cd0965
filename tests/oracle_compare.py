"""Run every ``queries()`` entry against its ``oracle_sql()`` in DuckDB.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Compares row count, column names and the multiset of rows (columns sorted by
name, values compared exactly).
"""

from __future__ import annotations

import datetime as _dt
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if isinstance(v, float):
        return ("f", repr(v))
    if isinstance(v, decimal.Decimal):
        return ("d", str(v))
    if isinstance(v, _dt.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, _dt.date):
        return ("D", v.isoformat())
    if v is None:
        return ("n", "")
    return (type(v).__name__, str(v))


def _pandas_equal(sdf, odf) -> bool:
    """The comparison a pandas-based checker would make: both frames through
    pandas, columns sorted by name, rows sorted, every value as text."""
    a = sdf.toPandas()
    a = a[sorted(a.columns)].astype(str)
    b = odf[sorted(odf.columns)].astype(str)
    ka = sorted(map(tuple, a.values.tolist()))
    kb = sorted(map(tuple, b.values.tolist()))
    return ka == kb


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir: str, names=None, verbose=True, pandas=None) -> dict:
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or list(qs):
        t0 = time.time()
        rec = {"has_oracle": name in sql}
        try:
            df = qs[name](spark, sf_dir)
            rows = df.collect()
            cols = df.columns
            rec["rows"] = len(rows)
            if name in sql:
                r = con.execute(sql[name])
                ocols = [d[0] for d in r.description]
                orows = r.fetchall()
                rec["oracle_rows"] = len(orows)
                rec["columns_match"] = sorted(cols) == sorted(ocols)
                order = sorted(range(len(cols)), key=lambda i: cols[i])
                oorder = sorted(range(len(ocols)), key=lambda i: ocols[i])
                a = sorted(tuple(_norm(r[i]) for i in order) for r in rows)
                b = sorted(tuple(_norm(r[i]) for i in oorder) for r in orows)
                rec["values_match"] = a == b
                if pandas or (pandas is None and os.environ.get("ORACLE_PANDAS")):
                    rec["pandas_match"] = _pandas_equal(df, con.execute(sql[name]).df())
                if not rec["values_match"] and verbose:
                    diff_a = [x for x in a if x not in set(b)][:3]
                    diff_b = [x for x in b if x not in set(a)][:3]
                    rec["example_spark"] = diff_a
                    rec["example_oracle"] = diff_b
                    rec["spark_cols"] = sorted(cols)
                    rec["oracle_cols"] = sorted(ocols)
        except Exception as e:  # noqa: BLE001
            rec["error"] = repr(e)[:2000]
        rec["sec"] = round(time.time() - t0, 2)
        out[name] = rec
        if verbose:
            ok = rec.get("values_match") and rec.get("columns_match") and rec.get("rows") == rec.get("oracle_rows")
            print(("OK  " if ok else "BAD ") + name, rec, flush=True)
    return out


if __name__ == "__main__":
    from eventspark.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = build_session("local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if not (v.get("values_match") and v.get("columns_match"))]
    print("FAILED:", bad)
