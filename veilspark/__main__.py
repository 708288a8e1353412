"""``python -m veilspark scan [FILE ...]``: report files or standard input; exit status 2 if a document reaches ``--fail-on``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from veilspark.operators import scan
from veilspark.schema import RANK
from veilspark.session import checkpoint, local_session
from veilspark.sources import readers, writers


def options() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="veilspark", description=__doc__)
    one = top.add_subparsers(dest="what", required=True).add_parser("scan", help="report personal information and secrets")
    one.add_argument("paths", nargs="*", help="files, folders or globs that Spark reads; none or - for standard input")
    one.add_argument("--json", action="store_true", help="one JSON list instead of lines")
    one.add_argument("--show-values", action="store_true", help="values as they are instead of masked")
    one.add_argument("--fail-on", choices=[level for level in RANK if RANK[level]], help="status 2 if a document is at this level or above")
    one.add_argument("--cores", default="*", help="cores of the local session, where none is running")
    return top


def main(arguments: list[str] | None = None) -> int:
    asked = options().parse_args(arguments)
    spark = local_session(asked.cores)
    files = [p for p in asked.paths if p != "-"]
    texts = readers.text_files(spark, *files) if files else None
    if not files or "-" in asked.paths:
        stdin = readers.standard_input(spark, sys.stdin.read())
        texts = stdin if texts is None else texts.unionByName(stdin)
    report = checkpoint(scan.analyse(texts, "source", show_values=asked.show_values)).orderBy("source")
    if asked.json:
        rows = (json.loads(r["row"]) for r in report.select(F.to_json(F.struct("*")).alias("row")).toLocalIterator())
        print(json.dumps(list(rows), ensure_ascii=False, indent=2))
    else:
        for r in writers.report_lines(report).toLocalIterator():
            print("\n".join(r["lines"]))
    return 2 if asked.fail_on and scan.fails(report, asked.fail_on) else 0


if __name__ == "__main__":
    sys.exit(main())
