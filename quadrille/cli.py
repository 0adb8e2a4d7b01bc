"""Command line: convert documents, query them, lift tables.

python -m quadrille.cli convert IN... --to FORM [--out DIR] · query FILE... --sparql TEXT [--to FORM] · lift CSV --base IRI [--id COLUMN]
"""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from .graph import PREFIXES, Dataset
from .sources.lift import lift_csv
from .sources.readers import read
from .sources.writers import to_text, write


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quadrille", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    convert, query, lift = (commands.add_parser(n) for n in ("convert", "query", "lift"))
    for p in (convert, query):
        p.add_argument("files", nargs="+")
        p.add_argument("--from", dest="form")
        p.add_argument("--ns", action="append", default=[], help="prefix=namespace")
    convert.add_argument("--to", default="turtle")
    convert.add_argument("--out")
    query.add_argument("--sparql", required=True)
    query.add_argument("--to", default="txt")
    lift.add_argument("file")
    lift.add_argument("--base", required=True)
    lift.add_argument("--id", action="append", dest="identity")
    lift.add_argument("--class", dest="cls")
    lift.add_argument("--delimiter", default=",")
    lift.add_argument("--to", default="nt")
    given = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("quadrille").getOrCreate()
    if given.command == "lift":
        quads = lift_csv(spark, given.file, given.identity, given.base, delimiter=given.delimiter, cls=given.cls)
        sys.stdout.write(to_text(quads, given.to))
        return 0
    prefixes = PREFIXES | dict(x.split("=", 1) for x in given.ns)
    quads = reduce(DataFrame.unionByName, [read(spark, f, given.form) for f in given.files]).distinct()
    if given.command == "query":
        sys.stdout.write(Dataset(spark, quads, prefixes).query(given.sparql).serialize(given.to))
    elif given.out:
        write(quads, given.out, given.to, prefixes)
    else:
        sys.stdout.write(to_text(quads, given.to, prefixes))
    return 0


if __name__ == "__main__":
    sys.exit(main())
