"""Print the physical plan of registered queries.

Usage: python tools/show_plans.py [sf_dir] query [query ...] [--mode formatted|simple|cost]

Plans are printed without running the queries (some builders run small
checkpoint jobs while the DataFrame is constructed).
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hearth.plans.registry import REGISTRY  # noqa: E402
from hearth.session import get_spark  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    mode = "formatted"
    if "--mode" in args:
        i = args.index("--mode")
        mode = args[i + 1]
        del args[i:i + 2]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.001"
    spark = get_spark("local[4]", shuffle_partitions=8)
    for name in args or sorted(REGISTRY):
        print(f"===== {name} =====")
        REGISTRY[name](spark, sf).explain(mode)
    spark.stop()


if __name__ == "__main__":
    main()
