"""python -m tessera FILE... -q QUERY [--document] [--csv | --json]: load files as tables and print a query's rows."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .engine import Engine
from .plans.dialect import DOCUMENT, VIEW
from .sources import sinks


def main() -> None:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("files", nargs="+", help="CSV, TSV, JSON or Parquet files; each becomes a table of its name")
    p.add_argument("-q", "--query", required=True)
    p.add_argument("--document", action="store_true", help="the document dialect")
    p.add_argument("--csv", action="store_true")
    p.add_argument("--json", action="store_true")
    args = p.parse_args()
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, DOCUMENT if args.document else VIEW)
    for f in args.files:
        engine.load(f)
    df = engine.query(args.query).df
    print(sinks.csv_text(df) if args.csv else sinks.json_text(df) if args.json else sinks.table_text(df, 100))
    spark.stop()


if __name__ == "__main__":
    main()
