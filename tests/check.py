"""Run registered queries against their SQL: python tests/check.py SF [name ...]"""

from __future__ import annotations

import pathlib
import sys
import time
import traceback

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

import oracle  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as contract  # noqa: E402


def main() -> int:
    folder = f"/root/testdata/sf{sys.argv[1]}"
    names = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = oracle.connect(folder)
    sql = contract.oracle_sql()
    bad = 0
    queries = contract.queries()
    wanted = [n for n in queries if not names or any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in names)]
    for name in wanted:
        start = time.time()
        try:
            ours = queries[name](spark, folder).toArrow()
            took = time.time() - start
            if name in sql:
                theirs = con.execute(sql[name]).to_arrow_table()
                problem = oracle.difference(ours, theirs)
            else:
                problem = None
            tag = "ok  " if problem is None else "BAD "
            extra = "" if name in sql else " (rows only)"
            print(f"{tag}{name}{extra} rows={ours.num_rows} {took:.1f}s {problem or ''}"[:1500], flush=True)
            bad += problem is not None
        except Exception as error:
            bad += 1
            text = "".join(traceback.format_exception_only(error)).strip()
            print(f"ERR {name} {text[:900]}", flush=True)
            if len(wanted) < 4:
                traceback.print_exc()
    print(f"{len(wanted)} queries, {bad} bad")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
