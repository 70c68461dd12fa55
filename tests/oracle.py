"""Run registered queries in Spark and their SQL in DuckDB; compare results."""

from __future__ import annotations

import datetime as _dt
import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if os.environ.get("ORACLE_STRICT"):
            return v
        return float(f"{v:.9g}")
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def compare(spark, con, name, query, sf_dir):
    t0 = time.time()
    sdf = query.build(spark, sf_dir)
    cols = sdf.columns
    srows = [tuple(_norm(x) for x in r) for r in sdf.collect()]
    t1 = time.time()
    res = con.sql(query.sql)
    dcols = res.columns
    drows = [tuple(_norm(x) for x in r) for r in res.fetchall()]
    out = {"name": name, "spark_s": round(t1 - t0, 2), "rows": len(srows), "oracle_rows": len(drows)}
    if sorted(cols) != sorted(dcols):
        out["error"] = f"columns {cols} vs {dcols}"
        return out
    order = [dcols.index(c) for c in cols]
    drows = [tuple(r[i] for i in order) for r in drows]
    cs, cd = Counter(srows), Counter(drows)
    if cs != cd:
        out["error"] = f"values differ: spark-only {list((cs - cd).items())[:2]} oracle-only {list((cd - cs).items())[:2]}"
    return out


def main(argv):
    sys.path.insert(0, ".")
    from canopy.plans import load_all
    from canopy.session import get_spark
    sf_dir = "/root/testdata/sf0.01"
    names = argv[1:]
    reg = load_all()
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    if os.environ.get("ORACLE_TZ"):  # results must not depend on the session time zone
        spark.conf.set("spark.sql.session.timeZone", os.environ["ORACLE_TZ"])
    con = duck(sf_dir)
    bad = 0
    for name, q in reg.items():
        if names and name not in names:
            continue
        if q.sql is None:
            t0 = time.time()
            n = q.build(spark, sf_dir).count()
            print(f"ROWS  {name}: {n} rows ({time.time()-t0:.1f}s)")
            continue
        try:
            r = compare(spark, con, name, q, sf_dir)
        except Exception as e:  # noqa: BLE001
            r = {"name": name, "error": repr(e)[:400]}
        ok = "error" not in r
        bad += not ok
        print(("OK    " if ok else "FAIL  ") + str(r))
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv)
