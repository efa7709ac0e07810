"""Command line: python tests/check_queries.py SF_DIR [name-prefix ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
import oracle  # noqa: E402
from sonarium.session import build_session  # noqa: E402


def main() -> int:
    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf_dir)
    sqls, failures = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start, spent = time.time(), -1.0
        try:
            df = fn(spark, sf_dir)
            df.collect()
            spent = time.time() - start
            if name in sqls:
                problem = oracle.compare(df, con, sqls[name])
            else:
                n = len(df.collect())
                problem = None if n else "no rows"
        except Exception as e:  # report every query, not just the first failing one
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        failures += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:32s} {spent:6.2f}s of {time.time() - start:6.2f}s "
              f"{'' if name in sqls else '(rows only) '}{problem or ''}", flush=True)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
