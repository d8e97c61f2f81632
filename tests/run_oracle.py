"""python tests/run_oracle.py [prefix ...]: time and compare registered queries."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from hirelens.session import get_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

if __name__ == "__main__":
    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    spark = get_session(cores=int(os.environ.get("CORES", "8")), shuffle=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracle = entry.oracle_sql()
    picked = [q for q in entry.queries() if not sys.argv[1:] or any(q == p or q.startswith(p + "_") or (p.isalpha() and len(p) == 1 and q.startswith(p)) for p in sys.argv[1:])]
    fails = 0
    for name in picked:
        t = time.time()
        try:
            if name in oracle:
                diff = compare(spark, con, entry.queries()[name], oracle[name], sf)
                state = "ok" if diff is None else "DIFF " + diff
            else:
                rows = entry.queries()[name](spark, sf).collect()
                state = f"rows {len(rows)} {str(rows[:2])[:200]}"
        except Exception as e:  # noqa: BLE001
            state = "ERROR " + str(e)[:900]
        fails += state.startswith(("DIFF", "ERROR"))
        print(f"{name:34s} {time.time() - t:6.1f}s {state}", flush=True)
        spark.catalog.clearCache()
    print("failed", fails, "of", len(picked))
