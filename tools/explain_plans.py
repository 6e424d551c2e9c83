"""Write the physical plans of the headline queries to a text file.

usage: python tools/explain_plans.py [--sf DIR] [--out FILE] [--mode formatted|simple] [name ...]

The shared layers are NOT materialised here, so each plan shows the whole
lineage from the Parquet scans (pruned columns, pushed filters, exchanges,
joins) the way Catalyst plans it.
"""

from __future__ import annotations

import argparse
import contextlib
import functools
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from contrail.plans import registry  # noqa: E402
from contrail.plans.layers import Loyalty  # noqa: E402
from contrail.session import get_spark  # noqa: E402

DEFAULT = ["build_master", "customer_summary", "executive_kpis", "monthly_seasonality", "spearman_matrix",
           "gini", "tier_comparison", "feat_scaled"]


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--out", default="plans.txt")
    ap.add_argument("--mode", default="formatted")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = get_spark("local[8]", 8)
    registry.Loyalty = functools.partial(Loyalty, materialize=False)
    qs = registry.all_queries()
    with open(a.out, "w") as fh:
        for name in a.names or DEFAULT:
            buf = io.StringIO()
            with contextlib.redirect_stdout(buf):
                qs[name](spark, a.sf).explain(a.mode)
            fh.write(f"==================== {name} ====================\n{buf.getvalue()}\n")
    print(f"wrote {a.out}")
    spark.stop()


if __name__ == "__main__":
    main()
