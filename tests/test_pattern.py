import re

import pytest

from tessera.plans.options import OptionError, Options, from_arguments, parse_options
from tessera.plans.pattern import PatternError, compile_pattern


def hits(spark, query, *lines, **kw):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(x,) for x in lines], "line string")
    return [r.line for r in df.where(compile_pattern(query, **kw).matches(F.col("line"))).collect()]


@pytest.mark.parametrize("bad", ["a++", "a**", "*a", "(a", "a)", "[a", "[z-a]", r"\1", "(?i)a", "a{1001}", "a{3,2}", "a*?", "[[:nope:]]", "a\\", "a\nb", r"\A", r"\pL"])
def test_rejected(bad):
    with pytest.raises(PatternError):
        compile_pattern(bad)


@pytest.mark.parametrize(
    "query,yes,no",
    [
        ("[[:digit:]]x", ["5x"], ["dx"]),
        ("a{", ["a{"], ["a"]),
        ("a{,2}", ["a{,2}"], ["aa"]),
        ("[a&&b]$", ["&", "a", "b"], ["c"]),
        ("^[]a]$", ["]", "a"], ["b"]),
        ("^[^[:alpha:]]$", ["1"], ["x"]),
        (r"\bé", ["xé"], ["é"]),
        (r"x\s$", ["x\t"], ["x\x0b"]),
        ("^a.b$", ["a\rb", "a\u2028b"], ["ab"]),
        ("a$", ["a"], ["a\r", "a\u0085"]),
        ("ab|cd", ["xcd"], ["ac"]),
        ("^(ab|cd){2}$", ["abcd"], ["ab"]),
        (r"\x41\.", ["A."], ["Ax"]),
        (r"^[\d\-x]+$", ["3-x"], ["a"]),
        ("[a-]", ["-"], ["b"]),
        (r"\w\W\D", ["a b"], ["a11"]),
    ],
)
def test_dialect(spark, query, yes, no):
    assert hits(spark, query, *yes, *no) == yes


def test_case(spark):
    assert hits(spark, "HeL", "hello", "HELLO", "x", ignore_case=True) == ["hello", "HELLO"]
    assert hits(spark, "[[:upper:]]", "A", "a", ignore_case=True) == []
    assert hits(spark, "É", "é", "É", "e", ignore_case=True) == ["é", "É"]
    assert hits(spark, "k", "\u212a", "K", ignore_case=True) == ["K"]
    with pytest.raises(PatternError):
        compile_pattern("[Z-a]", ignore_case=True)
    assert hits(spark, "A.B", "a.b", "axb", ignore_case=True, literal=True) == ["a.b"]


def test_needs_are_necessary():
    """A string that matches has what the plan says it needs."""
    for query, text in [("foo(bar|baz)+q?", "xfoobaz"), ("(a|b)c", "bc"), ("ab*cd", "acd"), ("x{2,}yz", "xxyz"), (r"a\bb|c", "c"), ("(ab)?cd", "cd")]:
        assert re.search(query, text)
        need = compile_pattern(query).needs

        def holds(n):
            return n.text in text if n.how == "text" else (all if n.how == "all" else any)(holds(p) for p in n.parts)

        assert need is None or holds(need)


def test_options():
    o = parse_options("i VCE L100 fi\\.c$ fi\\.h$ fe^x S fs fn")
    assert (o.ignore_case, o.visual_studio, o.column, o.end_column, o.limit, o.summary, o.style) == (True, True, True, True, 100, True, "name")
    assert o.include == ("\\.c$", "\\.h$") and o.exclude == ("^x",)
    assert parse_options("L0").limit is None and parse_options("L", Options(limit=3)).limit is None
    assert parse_options("HHD").highlight is False and parse_options("H").highlight_matches
    with pytest.raises(OptionError):
        parse_options("z")
    assert from_arguments(["i", "q"], {"TESSERA_OPTIONS": "L5"}) == (Options(ignore_case=True, limit=5), "q")
