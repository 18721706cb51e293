"""python -m quillframe QUERY FOLDER [--json]: runs a query of the catalogue over the tables in a folder and prints its rows."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from quillframe.plans import catalogue
from quillframe.sources.external import render


def main(args: list[str]) -> int:
    names = [a for a in args if not a.startswith("--")]
    if len(names) != 2 or names[0] not in catalogue.QUERIES:
        print(__doc__, "\nQueries:", *catalogue.QUERIES, sep="\n  ", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("quillframe").getOrCreate()
    print(render(catalogue.QUERIES[names[0]](spark, names[1]), "--json" in args))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
