"""Run registered queries against their oracles: python tests/check_oracles.py [sf_dir] [name ...]."""

import sys
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from compare import compare, connect

import __spark_entry__ as entry
from stockflow.session import build_session


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:] or list(queries)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                equal, message = compare(df, con, oracles[name])
                result = "ok" if equal and not message else f"{'TYPES' if equal else 'DIFF'} {message[:600]}"
            else:
                result = f"rows {df.count()}"
        except Exception:
            result = "ERROR " + traceback.format_exc()[-900:]
        bad += result.startswith(("DIFF", "TYPES", "ERROR"))
        print(f"{name:28s} {time.time() - start:6.2f}s {result}", flush=True)
    print(f"{len(wanted)} queries, {bad} with findings")


if __name__ == "__main__":
    main()
