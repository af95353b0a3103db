"""Line search over a corpus of ``(path, content)``.

A line ends at LF; the last may lack its end. Filters on paths and the literals that a match needs
run on whole rows, before texts are split, so that most texts are never exploded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fold_ascii
from tessera.plans.options import Options
from tessera.plans.pattern import Plan, compile_pattern, spans_udf


def lines(corpus: DataFrame, *carry: str) -> DataFrame:
    """``(path, *carry, line_no, line, ended)``: a row for each line, counted from 1 or after ``start_line`` if the corpus has it.

    ``ended`` is false for a last line without LF. Empty and null content has no lines.
    """
    first = F.col("start_line") if "start_line" in corpus.columns else F.lit(0)
    ends = F.octet_length("content") - F.octet_length(F.replace("content", F.lit("\n"), F.lit("")))
    rows = corpus.where("content <> ''").select("path", *carry, first.alias("__first"), ends.alias("__last"), "content")
    # Outer: a filter on the array's size, which would split each text once more, is not inferred.
    rows = rows.select("path", *carry, "__first", "__last", F.posexplode_outer(F.split("content", "\n", -1)).alias("__pos", "line"))
    rows = rows.where("__pos < __last OR line <> ''")
    return rows.select("path", *carry, (F.col("__pos") + 1 + F.col("__first")).cast("int").alias("line_no"), "line", (F.col("__pos") < F.col("__last")).alias("ended"))


def accepts(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Path filters: some include, if there are any, and no exclude; always without case."""
    out = F.lit(True)
    if include:
        out = reduce(Column.__or__, [compile_pattern(p, ignore_case=True).matches(path) for p in include])
    for p in exclude:
        out = out & ~compile_pattern(p, ignore_case=True).matches(path)
    return out


def first_match(plan: Plan, line: Column) -> tuple[Column, Column]:
    """Bytes before a line's first match, and of the match itself."""
    if plan.deep:
        return _span_bytes(line, spans_udf(*plan.deep, every=False)(line)[0])
    flags = plan.pattern[: plan.pattern.index(")") + 1]
    body = plan.pattern[len(flags) :]
    before = F.octet_length(F.regexp_extract(line, f"{flags}^(.*?)(?:{body})", 1))
    return before, F.octet_length(F.regexp_extract(line, plan.pattern, 0))


def _span_bytes(line: Column, span: Column) -> tuple[Column, Column]:
    return F.octet_length(line.substr(F.lit(1), span["begin"])), F.octet_length(line.substr(span["begin"] + 1, span["end"] - span["begin"]))


def search(corpus: DataFrame, query: str, options: Options = Options(), *carry: str) -> DataFrame:
    """``(path, *carry, line_no, line, ended)`` of each line with a match, one row a line, in no order yet.

    An empty match at the end of a last line without LF is none.
    """
    plan = compile_pattern(query, options.ignore_case, options.literal)
    if options.include or options.exclude:
        corpus = corpus.where(accepts(F.col("path"), options.include, options.exclude))
    if (possible := plan.possible(F.col("content"))) is not None and not options.bruteforce:
        corpus = corpus.where(possible)
    found = lines(corpus, *carry).where(plan.matches_line(F.col("line")))
    if not plan.empty:
        return found
    before, size = first_match(plan, F.col("line"))
    return found.where(F.col("ended") | (size > 0) | (before < F.octet_length("line")))


def columns(found: DataFrame, query: str, options: Options = Options()) -> DataFrame:
    """Adds ``col`` and ``end_col``: bytes from 1, the end not included."""
    plan = compile_pattern(query, options.ignore_case, options.literal)
    if plan.deep:  # looked for once
        own = found.withColumn("__span", spans_udf(*plan.deep, every=False)(F.col("line"))[0])
        before, size = _span_bytes(F.col("line"), F.col("__span"))
        return own.withColumns({"col": (before + 1).cast("int"), "end_col": (before + 1 + size).cast("int")}).drop("__span")
    before, size = first_match(plan, F.col("line"))
    return found.withColumn("col", (before + 1).cast("int")).withColumn("end_col", (before + 1 + size).cast("int"))


def ordered(found: DataFrame, limit: int | None = None, *first: str) -> DataFrame:
    """Rows in path and line order, after the columns in ``first``; a limit keeps the first rows of that order.

    Without a limit the rows found are shuffled once before the sort, so that the sort takes its
    sample from them and the corpus is searched only once.
    """
    order = (*first, "path", "line_no")
    return found.repartition("path").orderBy(*order) if limit is None else found.orderBy(*order).limit(limit)


def search_projects(projects: list[tuple[str, DataFrame]], query: str, options: Options = Options()) -> DataFrame:
    """Several corpora after each other, in list order; one that is listed twice is searched twice."""
    parts = [search(c, query, options).withColumn("project", F.lit(name)).withColumn("project_ord", F.lit(i)) for i, (name, c) in enumerate(projects)]
    return ordered(reduce(DataFrame.unionByName, parts), options.limit, "project_ord")


def folded_contains(col: Column, token: str, ignore_case: bool) -> Column:
    return F.contains(fold_ascii(col), F.lit(token.lower())) if ignore_case and token.isascii() else F.contains(col, F.lit(token))
