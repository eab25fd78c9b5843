"""Command-line oracle check: ``python tests/run_oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_harness import compare, duck_connection  # noqa: E402

from tickflow.session import build_session  # noqa: E402


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as entry
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck_connection(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(qs):
        t = time.time()
        try:
            df = qs[name](spark, sf_dir)
            if name in sqls:
                r = compare(df, con, sqls[name])
            else:
                r = {"ok": True, "rows_only": df.count()}
        except Exception as e:  # noqa: BLE001
            r = {"ok": False, "error": str(e)[:600]}
        r["sec"] = round(time.time() - t, 2)
        if not r.get("ok") or not r.get("exact", True):
            bad += not r.get("ok")
            print(name, json.dumps(r, default=str)[:1500])
        else:
            print(name, "OK", r.get("spark_rows", r.get("rows_only")), r["sec"])
    print("FAILED", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
