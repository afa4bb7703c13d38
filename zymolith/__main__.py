"""Command line: ``python -m zymolith evaluate|query|list``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.catalog import QUERIES
from .plans.workflows import evaluated, fold_scores


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="zymolith", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list", help="names of the registered queries")
    q = verbs.add_parser("query", help="write the rows of a registered query")
    q.add_argument("name", choices=sorted(QUERIES))
    q.add_argument("tables")
    q.add_argument("output")
    e = verbs.add_parser("evaluate", help="score tables of predictions (model, fold, id, class, score, label)")
    e.add_argument("predictions")
    e.add_argument("output")
    e.add_argument("--categories", help="table (id, category)")
    e.add_argument("--least", type=int, default=3, help="positives that a class needs in a fold")
    e.add_argument("--folds", type=int, default=5)
    args = top.parse_args(argv)
    if args.verb == "list":
        print(*sorted(QUERIES), sep="\n")
        return 0
    spark = SparkSession.builder.appName("zymolith").getOrCreate()
    if args.verb == "query":
        QUERIES[args.name](spark, args.tables).write.parquet(args.output)
        return 0
    categories = spark.read.parquet(args.categories) if args.categories else None
    per_class, summary = evaluated(fold_scores(spark.read.parquet(args.predictions), categories, args.least), args.folds)
    per_class.write.option("header", True).csv(f"{args.output}/per_class")
    summary.write.option("header", True).csv(f"{args.output}/summary")
    return 0


if __name__ == "__main__":
    sys.exit(main())
