"""Print the formatted physical plan of registered queries.

Usage: python scripts/explain_plans.py [sf_dir] [key ...]   (default: holdings_daily)

With ``--final`` the query is run first and the final adaptive plan is printed
(what adaptive execution actually chose: broadcasts, coalesced reads, reused
subqueries).
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from holdfast.queries import QUERIES  # noqa: E402
from holdfast.session import get_session  # noqa: E402


def main() -> None:
    args = [a for a in sys.argv[1:] if a != "--final"]
    final = "--final" in sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    keys = args[1:] or ["holdings_daily"]
    spark = get_session("local[8]", conf={"spark.sql.shuffle.partitions": "8"})
    for key in keys:
        df = QUERIES[key](spark, sf_dir)
        print(f"===== {key} =====")
        if final:
            df.collect()
            print(df._jdf.queryExecution().executedPlan().toString())
        else:
            df.explain("formatted")


if __name__ == "__main__":
    main()
