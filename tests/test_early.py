"""Limits that end a search early: the lines of the whole search, from few ranges of paths."""

import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.operators import early, lines
from tessera.plans.options import parse_options

SCHEMA = "path string, content string"


@pytest.mark.parametrize("n", [0, 1, 2, 5, 6, 21, 256, 1000])
def test_ranges_are_all_paths_once(n):
    at = [f"{i:04}" for i in range(n)]
    got = list(early.ranges(at))
    assert got[0][0] is None and got[-1][1] is None
    assert all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
    assert len(got) <= 2 + max(0, n).bit_length() / 2


def test_cuts_part_evenly_and_stay_few(spark):
    rows = spark.range(20000).select(F.format_string("d%05d/é", "id").alias("path"))
    at = early.cuts(rows.unionByName(spark.createDataFrame([(None,)], "path string")), 64)
    assert 60 <= len(at) <= 64 and at == sorted(at, key=str.encode)
    assert at == early.cuts(rows.repartition(7), 64)  # whatever the partitions
    assert early.cuts(rows.limit(0)) == []
    assert early.thinned(["b", "a", "b"]) == ["a", "b"] and len(early.thinned([f"{i:05}" for i in range(1000)])) == 250


@pytest.mark.parametrize("limit", [1, 2, 3, 40, 399, 400, 401, 10000])
def test_lines_are_those_of_the_whole_search(spark, limit):
    """Also with null paths, repeated rows, empty and null texts, and hot paths."""
    rows = [(f"p{i % 50:03}", "hit\nmiss\nhit") for i in range(200)] + [(None, "hit"), (None, "hit"), ("p000", None), ("zz", ""), ("é", "miss")] + [("p007", "hit\n" * 20)]
    corpus = spark.createDataFrame(rows, SCHEMA)
    options = parse_options(f"L{limit}")
    want = [tuple(r) for r in lines.ordered(lines.search(corpus, "hit"), limit).select("path", "line_no", "line").collect()]
    assert [tuple(r) for r in early.search_first(corpus, "hit", options).select("path", "line_no", "line").collect()] == want
    at = early.cuts(corpus)
    got = early.first_rows(lambda b, e: early.within(corpus, b, e), at, limit, lambda part, n: lines.ordered(lines.search(part, "hit"), n))
    assert [(r.path, r.line_no, r.line) for r in got] == want


def test_empty_corpus(spark):
    corpus = spark.createDataFrame([], SCHEMA)
    assert early.search_first(corpus, "x", parse_options("L3")).count() == 0
    assert list(early.first_rows(lambda b, e: corpus, [], 3, lambda part, n: part)) == []


def test_a_project_is_searched_from_its_begin(spark, tmp_path, monkeypatch):
    """A common word opens the first ranges alone, which the scan gets as filters; lines equal the whole search, with changes on top."""
    src, home = tmp_path / "src", tmp_path / "home"
    src.mkdir()
    home.mkdir()
    for i in range(300):
        (src / f"f{i:03}.c").write_text(f"word {i}\n" + "x" * 9000 + ("\nrare" if i == 299 else "") + "\n")
    (home / "p.cfg").write_text(f"path {src}\n")
    engine = Engine(spark, str(home), bucket_bytes=700_000, sizes=(1 << 18, 1 << 12))
    engine.build(str(home / "p.cfg"))
    every = engine.execute(["search", "p", "b", "word"])
    assert len(every) == 300
    seen, real = [], early.within
    monkeypatch.setattr(early, "within", lambda c, b, e: seen.append(real(c, b, e)) or seen[-1])
    cuts = engine._cuts(str(home / "p.cfg"))
    for limit in (1, 5, 150, 300, 400):
        seen.clear()
        assert engine.execute(["search", "p", f"b L{limit}", "word"]) == every[:limit]
        if limit == 1:
            assert cuts and len(seen) == 1
            assert "LessThan(path" in seen[0]._jdf.queryExecution().executedPlan().toString()
    assert engine.execute(["search", "p", "L1", "rare"])[0].startswith(f"{src}/f299.c")
    (src / "a.c").write_text("word first\n")
    (src / "f000.c").unlink()
    (src / "f001.c").write_text("word anew\n")
    engine.change(str(home / "p.cfg"), [f"{src}/a.c", f"{src}/f000.c", f"{src}/f001.c"])
    every = engine.execute(["search", "p", "b", "word"])
    read, real_read = [], Engine._read
    monkeypatch.setattr(Engine, "_read", lambda self, rows: read.append(rows.count()) or real_read(self, rows))
    assert engine.execute(["search", "p", "b L2", "word"]) == every[:2] and "first" in every[0] and "anew" in every[1]
    assert sum(read) == 2  # the changed files of the ranges that were searched, each once
    assert engine.execute(["search", "p", "b L400", "word"]) == every
