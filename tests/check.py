"""python tests/check.py SF_DIR [name ...]: compare queries with their SQL, with timings."""

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from seqlab.session import build_session  # noqa: E402
from tests.compare import difference, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

sf, names = sys.argv[1], sys.argv[2:]
spark = build_session("check", "8")
qs, sqls = entry.queries(), entry.oracle_sql()
con = duck(sf)
failed = 0
for name in names or qs:
    t = time.time()
    try:
        df = qs[name](spark, sf)
        if name in sqls:
            verdict = difference(df, con, sqls[name]) or "ok"
        else:
            rows = df.collect()
            verdict = f"rows {len(rows)} {rows[:2]}"
    except Exception as e:  # report and go on
        verdict = f"ERROR {type(e).__name__} {str(e)[:1500]}"
    good = verdict == "ok" or verdict.startswith("rows")
    failed += not good
    print(f"{'  ' if good else '!!'} {name:32s} {time.time() - t:6.1f}s {verdict[:1500]}", flush=True)
print("failed", failed, "of", len(names or qs))
