"""Dev loop: compare queries with their oracles at one scale.
usage: python tests/run_oracles.py [sf_dir] [name ...]"""
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from oracle_harness import compare, duck  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from panelforge.session import get_spark  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = get_spark("oracles", master="local[8]", shuffle_partitions=8, extra={"spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
spark.sparkContext.setLogLevel("ERROR")
qs, os_ = E.queries(), E.oracle_sql()
bad = 0
for name in (names or sorted(qs)):
    t = time.time()
    try:
        df = qs[name](spark, sf)
        if name in os_:
            probs = compare(df, duck(sf, os_[name]))
        else:
            n = df.count()
            probs = [] if n >= 0 else ["no rows"]
            name += " (rows-only)"
    except Exception as e:  # noqa: BLE001
        probs = [f"error: {type(e).__name__}: {str(e)[:400]}"]
        traceback.print_exc(limit=2)
    bad += bool(probs)
    print(f"{'OK  ' if not probs else 'FAIL'} {name:28s} {time.time() - t:6.1f}s {'; '.join(probs)[:600]}", flush=True)
print("failures:", bad)
