"""The automaton against DuckDB, on random patterns and on lines that overflow a recursive engine."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import formats, lines
from tessera.plans.automaton import Automaton, Lazy, automaton
from tessera.plans.options import parse_options
from tessera.plans.pattern import FLAT, compile_pattern, in_python, parsed, stack_depth

ATOMS = ["a", "b", "c", "é", ".", "[ab]", "[^a]", "\\w", "\\b", "^", "$", "\\d", "ab", "😀"]


def pattern(rnd, depth=3):
    kind = rnd.random()
    if not depth or kind < 0.35:
        return rnd.choice(ATOMS)
    if kind < 0.55:
        return f"({pattern(rnd, depth - 1)}|{pattern(rnd, depth - 1)})"
    if kind < 0.75:
        return f"({pattern(rnd, depth - 1)})" + rnd.choice(["*", "+", "?", "{2}", "{1,3}", "{2,}"])
    return pattern(rnd, depth - 1) + pattern(rnd, depth - 1)


def test_random_patterns_equal_duckdb():
    rnd = random.Random(11)
    texts = ["".join(rnd.choice("abcé 1_😀d") for _ in range(rnd.randint(0, 12))) for _ in range(80)] + [""]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, x VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    for _ in range(400):
        query = pattern(rnd)
        want = con.execute("SELECT regexp_matches(x, $q), regexp_extract(x, '^(.*?)(?:' || $q || ')', 1), regexp_extract(x, $q) FROM t ORDER BY i", {"q": query}).fetchall()
        own = Automaton(parsed(query)[0])
        assert own.found(texts).tolist() == [r[0] for r in want], query
        for text, (hit, before, match) in zip(texts, want, strict=True):
            span = own.first(text)
            assert (span is None) == (not hit), (query, text)
            if span:
                assert (text[: span[0]], text[span[0] : span[1]]) == (before, match), (query, text)


def test_states_that_are_forgotten(monkeypatch):
    """A pattern with many states, more than are kept, in step and one by one."""
    monkeypatch.setattr("tessera.plans.automaton.MOST_STATES", 50)
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 90))) for _ in range(200)]
    own = Automaton(parsed("(a|b)*a(a|b){12}c")[0])
    con = duckdb.connect()
    want = [con.execute("SELECT regexp_matches(?, '(a|b)*a(a|b){12}c')", [t]).fetchone()[0] for t in texts]
    assert own.found(texts).tolist() == want == [bool(own.found([t])[0]) for t in texts] == [own.first(t) is not None for t in texts]
    assert len(own.test.states) < 200 and isinstance(own.test, Lazy)


def test_case_folds_as_the_plan_says():
    assert automaton("(HeL|x)+$", True).found(["hello", "HEL", "xXhel", "q"]).tolist() == [False, True, True, False]
    assert automaton("(É|à)+b", True).found(["éÀB", "eab", "é"]).tolist() == [True, False, False]
    assert automaton("(k|m)+", True).found(["K", "K"]).tolist() == [False, True]  # no fold beyond ASCII for an ASCII pattern
    assert in_python(compile_pattern("^(ab|c)*d$"))("abcabd") and not in_python(compile_pattern("^(ab|c)*d$"))("abcab")


@pytest.mark.parametrize("query,deep", [("(ab|c)*d", True), ("([a-z]+,)*x", True), ("(a|b.)*x", True), ("(a|b)*x", False), ("(ab)*x", False), ("[a-z]*,+x", False), ("(a|bc){2}x", False), ("(a|bc){900}x", True), (".{3,}x", False), ("(.a)*x", True), ("((ab)*c)*d", True), ("(a[bc]{2})+x", False)])
def test_which_patterns_are_deep(query, deep):
    assert (compile_pattern(query).deep is not None) == deep == (stack_depth(parsed(query)[0]) > FLAT + len(query))


LONG = ["abc" * 350_000, "ab,c," * 200_000 + "x", "a" * 1_000_000, "ab" * 500_000 + "d", "é😀" * 300_000 + ".x", "abc" * 350_000 + "x"]


@pytest.mark.parametrize("query", ["(ab|c)*d", "([a-z]+,)*x", "(a|b.)*x", "(a|b)*x", "(ab)*x", ".{3,}x", "(abc)+x$", "(.a)*x", "((ab)+c?)+x", "(a|aa)+$"])
def test_long_lines(spark, query):
    """No pattern, on either way, overflows a stack on lines of a megabyte."""
    corpus = spark.createDataFrame([(str(i), t) for i, t in enumerate(LONG)], "path string, content string").repartition(4)
    options = parse_options("CE")
    got = {(r.path, r.col, r.end_col) for r in lines.columns(lines.search(corpus, query, options), query, options).collect()}
    con = duckdb.connect()
    want = set()
    for i, t in enumerate(LONG):
        hit, match = con.execute("SELECT regexp_matches($t, $q), regexp_extract($t, $q)", {"t": t, "q": query}).fetchone()
        if hit:
            before = con.execute("SELECT strlen(regexp_extract($t, '^(.*?)(?:' || $q || ')', 1))", {"t": t, "q": query}).fetchone()[0]
            want.add((str(i), before + 1, before + 1 + len(match.encode())))
    assert got == want


def test_linear_time():
    """What takes a backtracking engine time that doubles with each character."""
    began = time.time()
    assert not automaton("(a|a|ab)*c").found(["ab" * 500_000])[0] and not automaton("((a*)*b)*c").found(["a" * 300_000])[0]
    assert time.time() - began < 20


def test_deep_marks_and_filters(spark):
    df = spark.createDataFrame([("x/abab", "ababcab d"), ("y/cc", None), ("z", "none")], "path string, line string")
    got = {r.path: r.marked for r in df.select("path", formats.highlighted(F.col("line"), "(ab|c)+", begin="<", end=">").alias("marked")).collect()}
    assert got == {"x/abab": "<ababcab> d", "y/cc": None, "z": "none".replace("none", "none")}
    assert [r.path for r in df.where(lines.accepts(F.col("path"), ("/(AB|c)*$",))).collect()] == ["x/abab", "y/cc"]
    empty = lines.search(spark.createDataFrame([("p", "xd\nxy")], "path string, content string"), "(ab|c)*$")
    assert [r.line_no for r in empty.collect()] == [1]  # the last line's empty match at its end is none
