"""Command line: python -m tamis.cli --path PATH [--layers a,b] [--types a,b] [--out FOLDER] [--verify | --no-verify].

Exit codes: 0, 1 for an error, 2 for wrong use, 130 if it was interrupted."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .operators import findings as fd
from .operators import verify
from .plans.scan import Run, scan_options, scan_path


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tamis")
    p.add_argument("--path", required=True)
    p.add_argument("--layers", default="all")
    p.add_argument("--types", help="extensions, by default all that are known")
    p.add_argument("--out", default="reports")
    p.add_argument("--verify", action=argparse.BooleanOptionalAction, default=False)
    p.add_argument("--judge-url", default="http://localhost:11434")
    p.add_argument("--judge-model", default="qwen2.5:3b")
    a = p.parse_args(args)
    try:
        options = scan_options(a.layers, a.types)
    except ValueError as e:
        p.error(str(e))
    from .sources.sinks import write_reports

    spark = SparkSession.builder.getOrCreate()
    try:
        asked, status = verify.available(a.judge_url, a.judge_model, a.verify)
        judge = verify.chat_judge(a.judge_url, a.judge_model) if asked else None
        with Run(spark) as run:
            tables = scan_path(spark, a.path, judge=judge, excluded=(os.path.abspath(a.out),), **options)
            said = verify.report_part(fd.explode_findings(tables["results"]), status, a.judge_model) if judge else {"status": status}
            for kind, path in write_reports(tables, a.out, a.path, layers=options.get("layers"), verification=said, peaks=run.peaks).items():
                print(f"{kind}: {path}")
        tables["scan_summary"].show()
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
