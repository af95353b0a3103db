"""``python -m tessera VERB ...``: the engine's verbs from a shell. ``filter`` answers standard input as it comes."""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

from tessera.engine import Engine
from tessera.plans.options import from_arguments
from tessera.streaming.input import filter_input


def main(words: list[str]) -> int:
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark, say=lambda line: print(line, file=sys.stderr))
    verb = words[0] if words else "help"
    if verb == "interactive" and len(words) > 1:
        from_arguments([*words[2:], ""])  # an unknown option is told before the watch begins
        engine.interactive(words[1], lambda: sys.stdin.readline() or None, print, words[2:])
        return 0
    if verb == "filter":
        options, query = from_arguments(words[1:])
        filter_input(spark, getattr(sys.stdin, "buffer", sys.stdin), query, options, lambda line: print(line, flush=True))
        return 0
    for line in engine.lines(words):
        print(line)
    while engine.watching:
        time.sleep(1)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
