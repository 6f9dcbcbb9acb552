"""Compare registered queries with their SQL: python tests/check.py SF [name-part ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import compare  # noqa: E402

import __spark_entry__  # noqa: E402,F401
from convoy.plans.registry import ENTRIES  # noqa: E402
from convoy.session import build_session  # noqa: E402


def main():
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    parts = sys.argv[2:]
    spark = build_session("convoy-check", master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = compare.connect(sf_dir)
    bad = 0
    for name, entry in ENTRIES.items():
        if parts and not any(p in name for p in parts):
            continue
        begin = time.time()
        try:
            if entry.sql:
                rows, problem = compare.compare(spark, con, entry, sf_dir)
            else:
                rows, problem = len(entry.run(spark, sf_dir).collect()), None
        except Exception as exc:  # report and go on to the next query
            rows, problem = -1, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} rows={rows:<7d} {time.time() - begin:6.2f}s {'' if entry.sql else '(no sql)'} {problem or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
