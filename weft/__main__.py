"""python -m weft inspect|search|context|expressions PATH ...: look into an ontology from a shell."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from weft.plans.expressions import class_expressions
from weft.workspace import Workspace


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """What is printed: a table of at most --k rows."""
    parser = argparse.ArgumentParser(prog="weft")
    parser.add_argument("action", choices=("inspect", "search", "context", "expressions"))
    parser.add_argument("path")
    parser.add_argument("terms", nargs="*")
    parser.add_argument("--form")
    parser.add_argument("--k", type=int, default=10)
    parser.add_argument("--prefix", action="append", default=[])
    given = parser.parse_args(arguments)
    space = Workspace(spark or SparkSession.builder.getOrCreate(), given.path, given.form)
    if given.action in ("search", "context") and not given.terms:
        parser.error(f"{given.action} needs something to look for")
    found = {
        "inspect": space.summary,
        "search": lambda: space.search(given.terms, given.k, given.prefix),
        "context": lambda: space.context(" ".join(given.terms), given.k),
        "expressions": lambda: class_expressions(space.statements).limit(given.k),
    }[given.action]()
    text = found.toPandas().to_string(index=False)  # bounded by --k
    print(text)
    return text


if __name__ == "__main__":
    main()
