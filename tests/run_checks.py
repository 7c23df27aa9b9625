"""python tests/run_checks.py SF [name-part ...]: compare queries with their SQL."""

import importlib
import sys
import time
import traceback

sys.path.insert(0, ".")
from tests.compare import connect, difference  # noqa: E402
from themeloom.session import build_session  # noqa: E402


def main() -> int:
    sf, parts = sys.argv[1], sys.argv[2:]
    spark = build_session("checks", "local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = {}, {}
    for area in ("vectors", "drafts", "feeds", "corpus"):
        try:
            module = importlib.import_module(f"themeloom.checks.{area}")
        except ModuleNotFoundError as e:
            print("skip", area, e)
            continue
        queries |= module.QUERIES
        oracle |= module.ORACLE
    con = connect(sf)
    bad = 0
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            if name in oracle:
                said = difference(df, con, oracle[name])
            else:
                said = None if len(df.collect()) else "no rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:1500]}"
            if "-v" in parts:
                traceback.print_exc()
        bad += said is not None
        print(f"{time.time() - start:6.2f}s {name:32s} {'ok' if said is None else said[:1500]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
