import itertools
import random

from pyspark.sql import functions as F

from tessera.functions import bloom
from tessera.functions.fuzzy import FAR, ranks
from tessera.functions.text import normal_line_ends
from tessera.operators import files, formats, groups, index, info, lines, slices, snapshot
from tessera.operators.parts import cut, parts
from tessera.plans.options import parse_options
from tessera.sources.config import parse_config


def corpus(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "path string, content string")


def test_lines(spark):
    df = corpus(spark, a="x\ny\n", b="x\n\ny", c="", d=None, e="\n\n")
    got = [(r.path, r.line_no, r.line, r.ended) for r in lines.lines(df).orderBy("path", "line_no").collect()]
    assert got == [("a", 1, "x", True), ("a", 2, "y", True), ("b", 1, "x", True), ("b", 2, "", True), ("b", 3, "y", False), ("e", 1, "", True), ("e", 2, "", True)]
    ends = spark.createDataFrame([("a\r\nb\rc\n",)], "t string").select(normal_line_ends(F.col("t"))).first()[0]
    assert ends == "a\nb\nc\n"


def test_empty_matches_and_byte_columns(spark):
    df = corpus(spark, a="é😀x\nzz", b="q")
    found = lines.columns(lines.search(df, "x*$"), "x*$").orderBy("path", "line_no").collect()
    assert [(r.path, r.line_no, r.col, r.end_col) for r in found] == [("a", 1, 7, 8)]
    assert lines.search(df, "x*").count() == 3


def test_limit_is_a_prefix(spark):
    df = corpus(spark, **{f"f{i:03}": "hit\n" * (i % 4) for i in range(40)})
    every = [(r.path, r.line_no) for r in lines.ordered(lines.search(df, "hit")).collect()]
    for n in (0, 1, 7, 1000):
        assert [(r.path, r.line_no) for r in lines.ordered(lines.search(df, "hit"), n).collect()] == every[:n]


def test_highlight(spark):
    df = spark.createDataFrame([("aXbxa",)], "line string")
    show = lambda q, o="": df.select(formats.highlighted(F.col("line"), q, parse_options(o), "<", ">")).first()[0]
    odd = spark.createDataFrame([("a><b\x01a<>",), ("><",)], "line string")
    assert [r[0] for r in odd.select(formats.highlighted(F.col("line"), "a|b", parse_options(""), "<", ">")).collect()] == ["<a>><<b>\x01<a><>", "><"]
    assert [r[0] for r in odd.select(formats.highlighted(F.col("line"), "[ab><]", parse_options("i"), "<<", ">>")).collect()] == ["<<a><b>>\x01<<a<>>>", "<<><>>"]
    assert show("[ab]") == "<a>X<b>x<a>" and show("x*") == "aXb<x>a" and show("x|b", "i") == "a<Xbx>a" and show("y") == "aXbxa"


def slow_rank(q, s):
    q, s = q.lower(), s.lower()
    side = lambda c, o: 0 if o is None else ({"/": 1, ".": 1, "_": 2, "-": 2}.get(o, 4) if c.isalpha() or c in "[{" else 4)
    left = lambda i: side(s[i], s[i - 1] if i else None)
    right = lambda i: side(s[i], s[i + 1] if i + 1 < len(s) else None)
    best = None
    for places in itertools.product(*[[i for i, c in enumerate(s) if c == x] for x in q]):
        if any(a >= b for a, b in itertools.pairwise(places)):
            continue
        before = places[-2] if len(places) > 1 else -1
        if places[-1] != s.index(q[-1], before + 1):
            continue
        cost = left(places[0]) + right(places[-1])
        for a, b in itertools.pairwise(places):
            cost += 0 if b == a + 1 else right(a) + 10 + b - a - 2 + left(b)
        best = cost if best is None else min(best, cost)
    return best


def test_fuzzy_rank():
    rng = random.Random(3)
    for _ in range(400):
        s = "".join(rng.choice("ab/._-[c") for _ in range(rng.randint(1, 12)))
        q = "".join(rng.choice("abc/") for _ in range(rng.randint(1, 4)))
        assert files.rank(q, s) == slow_rank(q, s), (q, s)
    assert files.rank("a/b", "a/b") == 0


def test_ranks_of_ragged_texts():
    """One long text among short ones costs memory in its own length, and all ranks stay what they are alone."""
    import tracemalloc

    rng = random.Random(5)
    short = ["".join(rng.choice("ab/._-[c") for _ in range(rng.randint(0, 12))) for _ in range(1023)]
    long = "x/" * 500_000 + "abc"
    for q in ("a", "ab", "a/b", "x/xabc"):
        tracemalloc.start()
        got = ranks(q, [*short[:500], long, *short[500:]])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 200e6, (q, peak)
        assert got.tolist() == [ranks(q, [t])[0] for t in short[:500]] + [ranks(q, [long])[0]] + [ranks(q, [t])[0] for t in short[500:]]
    assert ranks("ab", []).tolist() == [] and ranks("ab", ["", ""]).tolist() == [FAR, FAR]


def test_find(spark):
    paths = spark.createDataFrame([(i, p) for i, p in enumerate(["src/render/Manager.cpp", "src\\net\\x.h", "", "readme"])], "n long, path string")
    rows = files.entries(paths.select("path", "n"), F.col("n"))
    find = lambda q, o="": [r.path for r in files.find(rows, q, parse_options(o)).collect()]
    assert find("") == ["src/render/Manager.cpp", "src\\net\\x.h", "readme"]
    assert find("render/ manager.c", "fs i") == ["src/render/Manager.cpp"] and find("manager", "fs") == []
    assert find(r"^x\.", "fn") == ["src\\net\\x.h"] and find("^x", "fp") == [] and find("sr", "ff L1") == ["src/render/Manager.cpp"]


def test_groups(spark):
    root = parse_config("path /r\ninclude \\.c$\nexclude ^gen$\ngroup\n path sub/\n include ^t\nendgroup\nfile /x/y.h\n", "/r", "p")
    got = spark.createDataFrame([(p,) for p in ["/r/a.c", "/r/gen/b.c", "/r/gen2/b.c", "/r/sub/t.c", "/r/sub/u.c", "/x/y.h", "/q/a.c", "/r/a.h"]], "path string")
    assert sorted(r.path for r in groups.project_files(root, got).collect()) == ["/r/a.c", "/r/gen2/b.c", "/r/sub/t.c", "/r/sub/u.c", "/x/y.h"]


def test_info(spark):
    df = corpus(spark, a="xx\ny", b="zz\n", c="")
    r = info.summary(df).first()
    assert (r.files, r.parts, r.bytes, r.lines, r.longest_line, r.longest_file) == (3, 3, 7, 3, 2, "b")
    none = info.summary(df.limit(0)).first()
    assert (none.files, none.bytes, none.lines, none.longest_file) == (0, 0, 0, None)
    bits = spark.createDataFrame([(bytearray(b"\xff\x01"), 3), (bytearray(b""), 0)], "bloom binary, rounds int")
    r = info.index_stats(bits).first()
    assert (r.indexed, r.bytes, r.rounds_max, r.filled_avg) == (1, 2, 3, 9 / 16)


def test_update_and_overlay(spark):
    old = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 1, 5)], "path string, mtime long, size long")
    new = spark.createDataFrame([("b", 1, 5), ("c", 2, 5), ("d", 1, 1)], "path string, mtime long, size long")
    assert {r.path: r.status for r in snapshot.differences(old, new).collect()} == {"a": "removed", "b": "reused", "c": "changed", "d": "added"}
    was, now = corpus(spark, a="x", b="x", c="x"), corpus(spark, c="y", d="x")
    got = snapshot.search_overlaid(was, corpus(spark, a="", c="", d="").select("path"), now, "x")
    assert sorted(r.path for r in got.collect()) == ["b", "d"]


def test_index_changes_nothing(spark):
    rng = random.Random(5)
    texts = {f"f{i:02}": "\n".join("".join(rng.choice("abcd ") for _ in range(30)) for _ in range(400)) + f"\nonly{i} here" for i in range(24)}
    df = corpus(spark, **texts).withColumn("chunk_id", F.expr("cast(substr(path, 2) as int) div 5").cast("long"))
    built = index.blooms(df.repartition(1).sortWithinPartitions("chunk_id", "path"))
    for q, o in [("abcd", ""), ("(abca|only7 h)", ""), ("ab", ""), ("ONLY1", "i"), ("abcd.*dcba", ""), ("only23", "l"), ("ONLY23", "l"), ("ONLY23", "li"), ("nowhere at all", "")]:
        a, b = (sorted((r.path, r.line_no) for r in f.collect()) for f in (index.search_indexed(df, built, q, parse_options(o)), lines.search(df, q, parse_options(o + "b"))))
        assert a == b, q
    found = lambda q: sorted(r.chunk_id for r in index.possible_chunks(built, index.wanted(q, parse_options(""))).collect())
    assert found("only13 here") == [2, 4] and found("nowhere at all") == [4]  # the last chunk is too small for a filter
    assert index.wanted("only23", parse_options("b")) is None


def test_bloom(spark):
    text = " ".join(f"word{i}" for i in range(9000))
    parts = spark.createDataFrame([(1, text), (2, "tiny")], "chunk_id long, content string").coalesce(1)
    built = index.blooms(parts)
    row = built.where("chunk_id = 1").first()
    own = bloom.grams(text.encode())
    assert bloom.might_hold(bytes(row.bloom), own, row.rounds) and len(row.bloom) == len(text) // 50
    assert [r.chunk_id for r in index.possible_chunks(built, index.wanted("zqxjk", parse_options("l"))).collect()] == [2]
    assert sorted(r.chunk_id for r in index.possible_chunks(built, index.wanted("word77", parse_options("l"))).collect()) == [1, 2]


def test_search_plan(spark):
    """A text is split once, in the one pass that the sort samples from too, and nothing is extracted for patterns that can't match nothing."""
    df = corpus(spark, a="thing\nx", b="y")
    plan = lines.ordered(lines.search(df, r"\bth[a-z]+\b"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1 and "regexp_extract" not in plan and plan.count("hashpartitioning") == 1
    assert "regexp_extract" in lines.search(df, "x*")._jdf.queryExecution().executedPlan().toString()
    assert lines.ordered(lines.search(df, "x"), 3)._jdf.queryExecution().executedPlan().toString().count("TakeOrderedAndProject") == 1


def test_ignored_case_is_ascii_case(spark):
    texts = ["KELVIN \u212a", "a[b", "A]B", "zZ", "É", "x_Y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from tessera.plans.pattern import compile_pattern, in_python

    for q, want in [("k$", []), ("[^a-y]z", ["zZ"]), ("A\\[b", ["a[b"]), ("[^k]elvin", []), ("kel", ["KELVIN \u212a"]), ("[^a]\\]b", []), ("[@-\\[]\\]", []), ("é", ["É"]), ("\\bX_y\\b", ["x_Y"])]:
        plan = compile_pattern(q, ignore_case=True)
        assert [r.t for r in df.where(plan.matches(F.col("t"))).collect()] == want, q
        assert [t for t in texts if in_python(plan)(t)] == want, q


def test_parts_have_the_lines_of_the_whole(spark):
    rng = random.Random(9)
    texts = {f"f{k}": "".join(rng.choice("abé \n") for _ in range(rng.randint(0, 300))) for k in range(20)} | {"end": "x\n" * 40, "none": ""}
    for t in texts.values():
        assert "".join(p for _, p in cut(t, 10)) == t and all(n == t[: sum(len(q) for _, q in list(cut(t, 10))[:i])].count("\n") for i, (n, p) in enumerate(cut(t, 10)))
    df = corpus(spark, **texts)
    for q in ("a+b", "x*$"):
        a, b = (sorted((r.path, r.line_no, r.line) for r in lines.search(x, q).collect()) for x in (df, parts(df, 16)))
        assert a == b


def test_many_roots_in_one_scan(spark):
    """Ten thousand folders are one join, and a file comes once for each folder that holds it."""
    paths = spark.createDataFrame([(f"/r{i}/s/f{i % 7}.c",) for i in range(20_000)] + [("/r5",), ("/r5x/y",), ("rel/a/b",), ("/top.c",)], "path string")
    roots = spark.createDataFrame([(f"/r{i}/" if i % 2 else f"/r{i}", i) for i in range(10_000)] + [("/r7/s", -1), ("rel", -2), ("/nowhere/deep/er", -3)], "root string, n int")
    got = groups.under_roots(paths, roots)
    rows = {(r.path, r.n): r.rest for r in got.collect()}
    assert len(rows) == 10_002 and rows["/r7/s/f0.c", -1] == "f0.c" and rows["/r7/s/f0.c", 7] == "s/f0.c" and rows["rel/a/b", -2] == "a/b"
    assert not any(p in ("/r5", "/r5x/y", "/top.c") for p, _ in rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") <= 2 and "Union" not in plan and "NestedLoop" not in plan
    assert groups.under_roots(paths, roots.limit(0)).count() == 0
    every = groups.under_roots(paths, spark.createDataFrame([("/", 1)], "root string, n int"))
    assert every.count() == 20_003  # the root of all absolute paths


def test_project_of_many_folders(spark):
    text = "".join(f"path /r{i}\n" for i in range(3000)) + "include c$\nfile /named.txt\ngroup\npath /r1/sub\ninclude ^x\nendgroup\n"
    paths = [f"/r{i}/a.{'c' if i % 2 else 'h'}" for i in range(4000)] + ["/named.txt", "/other.txt", "/r1/sub/x.c", "/r1/sub/x.h"]
    rows = spark.createDataFrame([(p, 1) for p in paths + paths[:9]], "path string, size long")
    got = sorted(r.path for r in groups.project_files(parse_config(text, "/"), rows).collect())
    assert got == sorted([f"/r{i}/a.c" for i in range(1, 3000, 2)] + ["/named.txt", "/r1/sub/x.c"])


def test_slices_rule_out_what_cannot_match(spark, tmp_path):
    """A search by slices finds what one without an index finds, in fewer chunks, without Python, and reads few pages."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = [(f"p{c:03}/{k}", " ".join(word() for _ in range(200)) + (f"\nNeedle{c} here" if k == 2 else ""), c) for c in range(150) for k in range(3)]
    df = spark.createDataFrame(rows, "path string, content string, chunk_id long").repartition(2, F.shiftright("chunk_id", 5)).sortWithinPartitions("chunk_id", "path")
    slices.sliced(df).sortWithinPartitions("slice", "grp").write.option("parquet.page.row.count.limit", slices.PAGE_ROWS).parquet(f"{tmp_path}/index")
    built = spark.read.parquet(f"{tmp_path}/index")
    for q, o in [("Needle77 here", ""), ("needle7", "i"), ("Needle1[0-9]|Needle77", ""), ("(abcd|Needle5) h", ""), ("[a-z]", ""), ("nothing of this", "l"), ("ab", ""), ("x|Needle", "")]:
        need = index.wanted(q, parse_options(o))
        if need is None:
            continue
        left = slices.pruned(df, built, need)
        found = lambda rows: sorted((r.path, r.line_no) for r in lines.search(rows, q, parse_options(o)).collect())  # noqa: E731, B023
        assert found(left) == found(df)
        if q == "Needle77 here":
            assert left.select("chunk_id").distinct().count() < 5
    asked = slices.useful(index.wanted("Needle77 here", parse_options("l")))
    plan = slices.possible(built, asked)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "In(slice" in plan
    assert slices.useful(index.wanted("abc", parse_options("l"))) is None and slices.stats(built).first().indexed == 150
    assert slices.stats(built.limit(0)).first().indexed == 0
