"""Output lines: plain, Visual Studio, highlighted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.options import Options
from tessera.plans.pattern import compile_pattern, spans_udf

# Terminal colours, the usual ones of grep.
MATCH = "\x1b[;01;31m"
PATH = "\x1b[;0;35m"
NUMBER = "\x1b[;0;32m"
SEPARATOR = "\x1b[;0;36m"
RESET = "\x1b[0m"


def highlighted(line: Column, query: str, options: Options = Options(), begin: str = MATCH, end: str = RESET) -> Column:
    """The line with each match between marks, touching matches as one; empty matches get none. What looks like a mark in the line stays."""
    plan = compile_pattern(query, options.ignore_case, options.literal)
    if plan.deep:
        return _by_spans(line, spans_udf(*plan.deep, every=True)(line), begin, end)
    cut = _by_cuts(line, plan.pattern, begin, end)
    marked = F.regexp_replace(line, plan.pattern, f"{_quoted(begin)}$0{_quoted(end)}")
    marked = F.replace(F.replace(marked, F.lit(begin + end), F.lit("")), F.lit(end + begin), F.lit(""))
    return F.when(line.rlike(f"[{_signs(begin, end)}]"), cut).otherwise(marked)


def _signs(begin: str, end: str) -> str:
    """Characters without which no part of a line can be taken for marks: their first, if it is one sign that comes nowhere else in them."""
    both = begin + end
    own = begin[0] if begin[0] == end[0] and both.count(begin[0]) == 2 else both
    return "".join(f"\\x{{{ord(c):x}}}" for c in dict.fromkeys(own))


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def _by_spans(line: Column, spans: Column, begin: str, end: str) -> Column:
    """Marks at spans in order: one that touches the one before goes on with it."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        between = line.substr(acc["at"] + 1, s["begin"] - acc["at"])
        first = F.when((acc["at"] == s["begin"]) & F.endswith(acc["out"], F.lit(end)), F.substring(acc["out"], F.lit(1), F.length(acc["out"]) - len(end))).otherwise(F.concat(acc["out"], between, F.lit(begin)))
        out = F.concat(first, line.substr(s["begin"] + 1, s["end"] - s["begin"]), F.lit(end))
        return F.struct(s["end"].alias("at"), out.alias("out"))

    some = F.filter(spans, lambda s: s["end"] > s["begin"])
    return F.aggregate(some, start, step, lambda acc: F.concat(acc["out"], line.substr(acc["at"] + 1, F.length(line))))


def _by_cuts(line: Column, pattern: str, begin: str, end: str) -> Column:
    """Marks by the lengths of matched and unmatched pieces of a copy of equal length, in which two control characters are others."""
    cut = F.split(F.regexp_replace(F.translate(line, "\x01\x02", "\x03\x03"), pattern, "\x01$0\x02"), "[\x01\x02]", -1)
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"), F.lit(False).alias("inside"), F.lit(False).alias("open"))

    def step(acc: Column, piece: Column) -> Column:
        own = line.substr(acc["at"], F.length(piece))
        mark = F.when(acc["inside"] & ~acc["open"], F.lit(begin)).when(~acc["inside"] & acc["open"], F.lit(end)).otherwise(F.lit(""))
        some = F.length(piece) > 0
        out = F.when(some, F.concat(acc["out"], mark, own)).otherwise(acc["out"])
        return F.struct((acc["at"] + F.length(piece)).alias("at"), out.alias("out"), (~acc["inside"]).alias("inside"), F.when(some, acc["inside"]).otherwise(acc["open"]).alias("open"))

    return F.aggregate(cut, start, step, lambda acc: F.when(acc["open"], F.concat(acc["out"], F.lit(end))).otherwise(acc["out"]))


def rendered(found: DataFrame, query: str, options: Options = Options()) -> DataFrame:
    """Adds ``text``, the row as it is printed. Columns must be there if the options ask for them."""
    where = [F.col("line_no").cast("string")]
    if options.column:
        where.append(F.col("col").cast("string"))
    if options.end_column:
        where.append(F.col("end_col").cast("string"))
    path = F.col("path")
    line = highlighted(F.col("line"), query, options) if options.highlight_matches else F.col("line")
    if options.highlight:
        path = F.concat(F.lit(PATH), path, F.lit(RESET))
        where = [F.concat(F.lit(NUMBER), w, F.lit(RESET)) for w in where]
    if options.visual_studio:
        path = F.translate(path, "/", "\\")
        return found.withColumn("text", F.concat(path, F.lit("("), F.concat_ws(",", *where), F.lit("):"), line))
    colon = f"{SEPARATOR}:{RESET}" if options.highlight else ":"
    return found.withColumn("text", F.concat_ws(colon, path, *where, line))


def summary(matches: int, seconds: float, limit: int | None) -> str:
    """Closing line; a plus says that the limit ended the search. Fixed value: the sentence, which tools look for."""
    return f"Search complete, found {matches}{'+' if limit is not None and matches >= limit else ''} matches in {seconds:.2f} sec"
