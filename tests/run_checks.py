"""Run all (or the named) queries against the oracle: ``run_checks.py SF_DIR [prefix ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tests.compare import differences, oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from fleetviews import build_session  # noqa: E402


def main(sf_dir: str, *prefixes: str) -> int:
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("OFF")
    con, statements, bad = oracle(sf_dir), entry.oracle_sql(), 0
    names = [n for n in entry.queries() if not prefixes or n.startswith(prefixes)]
    for name in names:
        began = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            problem = differences(df, con, statements[name]) if name in statements else f"(no oracle) {df.count()} rows"
        except Exception as error:  # a failing query must not hide the others
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        if problem:
            print(f"BAD {name} {time.time() - began:.1f}s {problem}", flush=True)
        elif prefixes:
            print(f"ok  {name} {time.time() - began:.1f}s", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(*sys.argv[1:])))
