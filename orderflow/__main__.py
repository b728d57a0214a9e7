"""Command line: list, run or explain registered queries.

    python -m orderflow list
    python -m orderflow run daily_kpis --sf /root/testdata/sf0.01 [--out /path/result.parquet] [--show 20]
    python -m orderflow explain daily_kpis --sf /root/testdata/sf0.01
"""

from __future__ import annotations

import argparse
import os
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="orderflow")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    for cmd in ("run", "explain"):
        p = sub.add_parser(cmd)
        p.add_argument("name")
        p.add_argument("--sf", default="/root/testdata/sf0.01")
        p.add_argument("--master", default=None)
        if cmd == "run":
            p.add_argument("--out", default=None, help="write the result as parquet here")
            p.add_argument("--show", type=int, default=20)
    a = ap.parse_args(argv)

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from orderflow.plans import catalog
    catalog.load_all()
    if a.cmd == "list":
        for name in catalog.REGISTRY:
            print(name + ("" if name in catalog.ORACLE else "  (rows-only check)"))
        return 0

    from orderflow.session import get_session
    spark = get_session(a.master)
    df = catalog.REGISTRY[a.name](spark, a.sf)
    if a.cmd == "explain":
        df.explain(mode="formatted")
    elif a.out:
        df.write.mode("overwrite").parquet(a.out)
        print(f"wrote {a.out}")
    else:
        df.show(a.show, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
