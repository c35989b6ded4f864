"""python -m tablelog ROOT: a prompt for statements over a table store."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from tablelog.plans.connection import Connection, format_table


def main(root: str) -> None:
    connection = Connection(SparkSession.builder.appName("tablelog").getOrCreate(), root)
    held = ""
    for line in sys.stdin:
        word = line.strip()
        if not held and word in (".quit", ".exit", ".q"):
            return
        if not held and word == ".help":
            print("Statements end with ;  .quit ends the session")
            continue
        held += line
        if ";" in line:
            for _, result in connection.script(held):
                print("ok" if result is None else f"error: {result}" if isinstance(result, Exception) else format_table(result))
            held = ""


if __name__ == "__main__":
    main(sys.argv[1])
