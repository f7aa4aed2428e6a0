"""Run the whole workload as one batch job.

    python -m agora --csv DIR [--file TABLE=NAME ...] --out DIR [--format parquet|csv]
    python -m agora --parquet DIR --out DIR
    python -m agora --tpch SF_DIR --out DIR          # the TPC-H test tables

Every analysis and SQL query is written to ``OUT/<query>/`` (the data behind
each chart or table of the original report), plus the per-customer RFM table
as CSV and the six summary datasets.  Nothing is collected to the driver
except the one-row KPI summary printed at the end.
"""

from __future__ import annotations

import argparse

from agora.plans.catalog import ALL_ANALYSES, EXPORTS, Workspace
from agora.session import build_session, release_staged
from agora.sources import read_marketplace_csv, read_marketplace_parquet, tpch_marketplace
from agora.sources.sinks import export_rfm, export_summaries


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="python -m agora", description=__doc__.split("\n\n")[0])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv", help="folder with one CSV file per table")
    src.add_argument("--parquet", help="folder with one Parquet dataset per table")
    src.add_argument("--tpch", help="folder with the TPC-H-like test tables")
    ap.add_argument("--file", action="append", default=[],
                    help="TABLE=FILENAME for a CSV file not named <table>.csv")
    ap.add_argument("--single-line", action="store_true",
                    help="no CSV field holds a line break: saves the scan for open quotes")
    ap.add_argument("--out", required=True, help="output folder")
    ap.add_argument("--format", choices=["parquet", "csv"], default="parquet")
    ap.add_argument("--skip-master", action="store_true",
                    help="do not write the joined master frame (its size is the fan-out)")
    args = ap.parse_args(argv)

    spark = build_session()
    if args.csv:
        files = dict(f.split("=", 1) for f in args.file)
        tables = read_marketplace_csv(spark, args.csv, files, multiline=not args.single_line)
    elif args.parquet:
        tables = read_marketplace_parquet(spark, args.parquet)
    else:
        tables = tpch_marketplace(spark, args.tpch)
    out = args.out.rstrip("/")
    try:
        with Workspace(spark, tables, materialize=True) as ws:
            for name, analysis in ALL_ANALYSES.items():
                if name == "py_master" and args.skip_master or name in EXPORTS:
                    continue
                writer = analysis(ws).write.mode("overwrite")
                if args.format == "csv":
                    writer.option("header", True).csv(f"{out}/{name}")
                else:
                    writer.parquet(f"{out}/{name}")
            export_rfm(ws.rfm, f"{out}/export")
            export_summaries(ws.delivered, ws.rfm, f"{out}/export", fmt=args.format)
            kpis = ALL_ANALYSES["py_kpis"](ws).first()  # one row
            print({k: kpis[k] for k in kpis.asDict()})
    finally:
        release_staged(spark)


if __name__ == "__main__":
    main()
