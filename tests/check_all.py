"""Run every registered query against its oracle: ``python tests/check_all.py [sf_dir] [name…]``."""

from __future__ import annotations

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from compare import connect, difference

from histmetrics.demo import ORACLE, QUERIES
from histmetrics.session import build_session


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        master="local[8]", conf={"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.log.level": "ERROR"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    for name in names:
        begin = time.time()
        try:
            df = QUERIES[name](spark, sf)
            if name in ORACLE:
                told = difference(df, con, ORACLE[name]) or "ok"
            else:
                told = f"ok ({len(df.collect())} rows, no oracle)"
        except Exception as error:
            told = f"ERROR {type(error).__name__}: {str(error)[:600]}"
            if "Fatal" in told or "Internal" in told:
                con = connect(sf)
        bad += not told.startswith("ok")
        print(f"{name:36s} {time.time() - begin:6.2f}s  {told}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(main())
