"""``python -m ledgerlake LEDGER QUERY [--format text|csv|json]``"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ledgerlake.functions.loading import load_all
from ledgerlake.plans.compiler import query
from ledgerlake.sources import sinks, text


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="ledgerlake")
    a.add_argument("ledger")
    a.add_argument("query")
    a.add_argument("--format", choices=("text", "csv", "json"), default="text")
    a.add_argument("--functions", action="append", default=[], help="modules of user functions")
    o = a.parse_args(argv)
    load_all(o.functions)
    spark = SparkSession.builder.appName("ledgerlake").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        df = query(text.load_file(spark, o.ledger), o.query)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if o.format == "text":
        for line in sinks.text_lines(df):
            print(line)
    elif o.format == "csv":
        cells = sinks.csv_cells(df)
        quote = lambda s: '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\n') else s
        print(",".join(cells.columns))
        for r in cells.toLocalIterator():
            print(",".join(quote(v) for v in r))
    else:
        rows = [r[0] for r in sinks.json_rows(df).toLocalIterator()]
        print("[" + ",\n ".join(rows) + "]")
    return 0


if __name__ == "__main__":
    sys.exit(main())
