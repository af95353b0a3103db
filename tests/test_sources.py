import io
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.plans.options import parse_options
from tessera.sources import config, ranges, tree
from tessera.sources.store import ChangeList, Conflict, Folder, FormatError, Manifest, Store
from tessera.streaming import input
from tessera.streaming.watch import Watch, filter_stream


def test_transcoding():
    text = "aé😀\n"
    for code, mark in [("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("utf-32-le", b"\xff\xfe\0\0"), ("utf-32-be", b"\0\0\xfe\xff"), ("utf-8", b"\xef\xbb\xbf")]:
        assert tree.to_utf8(mark + text.encode(code)).decode() == text
    assert tree.to_utf8(b"\xff\xfea\0\x00\xd8b\0") == b"ab" and tree.to_utf8(b"\xffx") == b"\xffx"


def test_config(tmp_path):
    with pytest.raises(config.ConfigError, match=r"p\(2\)"):
        config.parse_config("path x\nendgroup\n", "/", "p")
    with pytest.raises(config.ConfigError):
        config.parse_config("group\n", "/", "p")
    g = config.parse_config("  # c\n\tpath  a b/../c \nx/y/\nz.c\n", "/base")
    assert g.paths == ["/base/a c".replace("a c", "c"), "/base/x/y"] and g.files == ["/base/z.c"]
    file = tmp_path / "h" / "p.cfg"
    config.new_config(str(file), ".")
    assert config.parse_config(file.read_text(), "/").include[0].startswith("\\.(cpp|")
    with pytest.raises(config.ConfigError):
        config.new_config(str(file), ".")
    (tmp_path / "h" / "q").mkdir()
    config.new_config(str(tmp_path / "h/q/r.cfg"), ".")
    names = lambda s: [n for n, _ in config.projects(s, str(tmp_path / "h"))]
    assert names("*") == ["p", "q/r"] and names("q/") == ["q/r"] and names("p,q/r") == ["p", "q/r"]
    assert config.normal_path("/a", "..\\b/./c") == "/b/c" and config.normal_path("/a", "C:/x/..") == "C:/"


def test_engine(spark, tmp_path):
    src = tmp_path / "src"
    (src / ".git").mkdir(parents=True)
    (src / "a.c").write_bytes(b"one\r\ntwo\r")
    (src / "b.c").write_bytes(b"\xff\xfe" + "drei\nz\u00e9ro".encode("utf-16-le"))
    (src / "skip.o").write_text("two")
    (src / ".git" / "c.c").write_text("two")
    home = tmp_path / "home"
    home.mkdir()
    (home / "p.cfg").write_text(f"path {src}\ninclude \\.c$\n")
    engine = Engine(spark, str(home))
    run = lambda *w: [x.replace(str(src), "S") for x in engine.execute(list(w))]
    assert run("projects") == ["p"]
    run("build", "p")
    assert run("search", "p", "two|drei") == ["S/a.c:2:two", "S/b.c:1:drei"]
    assert run("search", "p", "CE i L1", "O") == ["S/a.c:1:1:2:one"]
    assert run("search", "p,p", "l", "z\u00e9") == ["S/b.c:2:z\u00e9ro"] * 2
    assert run("files", "p", "fn", "^a") == ["S/a.c"]
    (src / "d.c").write_text("two\n")
    (src / "a.c").write_text("changed\n")
    assert run("search", "p", "two") == ["S/a.c:2:two"]
    (src / "x.bin").write_text("two\n")
    engine.execute(["change", "p", f"{src}/a.c", f"{src}/d.c", f"{src}/x.bin", "/elsewhere/x.c"])
    assert sorted(r.path.replace(str(src), "S") for r in engine.changes(str(home / "p.cfg")).collect()) == ["S/a.c", "S/d.c"]
    assert run("search", "p", "two|changed") == ["S/a.c:1:changed", "S/d.c:1:two"]
    os.remove(src / "b.c")
    assert run("update", "p") == ["p: +1 -1 *1"]
    assert run("files", "p", "") == ["S/a.c", "S/d.c"]
    assert run("info", "p")[0].startswith("p: 2 files, 12 bytes, 2 lines, longest 7 in S/a.c")
    rows = spark.createDataFrame([("b/x",), ("",), ("a/xy",)], "line string")
    assert engine.execute(["filter", "x"], rows) == ["b/x", "a/xy"]
    asked, said = iter(["files a.c\n", "nonsense", "search two", None]), []
    engine.interactive("p", lambda: next(asked), said.append, ["ff"], watch=False)
    assert [s.replace(str(src), "S") for s in said] == ["S/a.c", "S/d.c:1:two"]
    assert engine.execute(["help"])[0].startswith("Verbs") and engine.execute([]) == engine.execute(["help"])


def test_binary_contents(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_bytes(b"a\r\nb")
    got = tree.contents(spark, [str(tmp_path)], str(tmp_path)).collect()
    assert [(r.path, r.size, r.content) for r in got] == [("d/x.txt", 4, "a\nb")]


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now


def watched(spark, tmp_path, n=3, quiet=60):
    src, home = tmp_path / "src", tmp_path / "home"
    src.mkdir()
    home.mkdir()
    for i in range(n):
        (src / f"f{i}.c").write_text(f"line {i}\n")
    file = str(home / "p.cfg")
    (home / "p.cfg").write_text(f"path {src}\ninclude \\.c$\n")
    engine, clock = Engine(spark, str(home)), Clock()
    engine.build(file)
    watch = engine.watch(file, files=1, quiet=quiet)
    watch.clock, watch.last = clock, 0.0
    listed = lambda: sorted(r.path.rsplit("/", 1)[1] for r in engine.changes(file).collect())
    return src, file, engine, watch, clock, listed


def test_watch_updates_when_quiet(spark, tmp_path):
    src, file, engine, watch, clock, listed = watched(spark, tmp_path)
    assert watch.beat() == "quiet" and listed() == []
    (src / "new.c").write_text("new\n")
    (src / "out.bin").write_text("x")
    assert watch.beat() == "written" and listed() == ["new.c"]
    clock.now = 1000
    assert watch.beat() == "quiet"  # one change is not over the number
    (src / "f0.c").unlink()
    (src / "f1.c").write_text("longer than before\n")
    assert watch.beat() == "written" and listed() == ["f0.c", "f1.c", "new.c"]
    clock.now = 1059
    assert watch.beat() == "quiet" and listed() == ["f0.c", "f1.c", "new.c"]
    clock.now = 1061
    assert watch.beat() == "updated" and listed() == []
    assert sorted(r.path.rsplit("/", 1)[1] for r in engine.files("p", "").collect()) == ["f1.c", "f2.c", "new.c"]
    (src / "f1.c").write_text("again\n")
    assert watch.beat() == "written"
    (src / "f1.c").write_text("longer than before\n")
    row = engine._listed(engine._store(file)).where("path like '%f1.c'").first()
    os.utime(src / "f1.c", (row.mtime, row.mtime))
    assert watch.beat() == "written" and listed() == []  # as the index has it again


def test_watch_restarts_and_fails_well(spark, tmp_path, monkeypatch):
    src, file, engine, watch, clock, listed = watched(spark, tmp_path)
    for i in range(3):
        (src / f"n{i}.c").write_text("x\n")
    assert watch.beat() == "written" and len(listed()) == 3
    again = engine.watch(file, files=1, quiet=60)  # a new process
    again.clock, again.last = clock, 0.0
    assert again.beat() == "quiet" and len(listed()) == 3

    def broken(*a, **k):
        raise OSError("no room")

    clock.now = 61
    with monkeypatch.context() as m:
        m.setattr(Store, "write", broken)
        assert again.beat() == "failed" and len(listed()) == 3 and again.failures == 1
    assert again.beat() == "quiet"
    clock.now = 122
    assert again.beat() == "updated" and listed() == []


def test_quiet_time_goes_on_over_a_new_start(spark, tmp_path):
    """A watch that starts after the others have died counts from when the list was written."""
    src, file, engine, watch, clock, listed = watched(spark, tmp_path)
    for i in range(3):
        (src / f"n{i}.c").write_text("x\n")
    began = time.time()
    assert watch.beat() == "written"
    for quiet, want in ((3600, "quiet"), (0.5, "updated")):
        again = engine.watch(file, files=1, quiet=quiet)
        assert began - 1 <= again.last <= time.time() and again.last == engine._changes(file).written()
        time.sleep(0.6)
        assert again.beat() == want
    assert listed() == []


def test_a_watch_follows_its_project_file(spark, tmp_path):
    """Other folders and patterns count from the next beat on, and what was known of the old ones goes."""
    src, file, engine, watch, clock, listed = watched(spark, tmp_path)
    watch.beat()
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "m.c").write_text("m\n")
    (tmp_path / "home" / "p.cfg").write_text(f"path {src}\npath {tmp_path / 'more'}\ninclude \\.c$\nexclude ^f1\n")
    assert watch.beat() == "written" and listed() == ["f1.c", "m.c"]
    assert sum(n.startswith("tree-") for n in engine._store(file).folder.names()) == 1


def test_a_beat_at_rest_compares_nothing(spark, tmp_path, monkeypatch):
    """Also after an update by another engine, and a told change, each of which is compared once more."""
    src, file, engine, watch, clock, listed = watched(spark, tmp_path)
    compared, real = [], Watch._compare
    monkeypatch.setattr(Watch, "_compare", lambda self: compared.append(1) or real(self))
    while compared or not watch.seen:  # until no folder is too new to tell
        compared.clear()
        watch.beat()
        time.sleep(0.5)
    assert watch.beat() == "quiet" and not compared
    engine.change(file, [str(src / "f0.c")])
    assert listed() == ["f0.c"] and watch.beat() == "written" and compared and listed() == []
    watch.beat()
    compared.clear()
    assert watch.beat() == "quiet" and not compared
    (src / "f1.c").write_text("changed in place\n")
    engine.update(file)
    assert watch.beat() == "quiet" and compared and listed() == []


def test_watch_beats_as_a_stream(spark, tmp_path):
    src, file, engine, watch, clock, listed = watched(spark, tmp_path, quiet=2)
    watch.clock = time.time
    query = watch.start(spark, 0.5)
    try:
        for i in range(2):
            (src / f"n{i}.c").write_text("x\n")
        for _ in range(120):  # nothing changes any more, and still the update comes
            time.sleep(0.5)
            if engine._listed(engine._store(file)).count() == 5:
                break
        assert engine._listed(engine._store(file)).count() == 5
    finally:
        query.stop()
    assert query.exception() is None


def test_changes_that_come_during_an_update_stay(spark, tmp_path):
    changes = ChangeList(spark, str(tmp_path / "t"))
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    n = changes.write(paths("b", "a", "a"))
    changes.write(paths("a", "b", "c"))
    changes.forget(n)
    assert [r.path for r in changes.read().collect()] == ["c"]
    (tmp_path / "t" / "changes" / "c99").mkdir()  # a version whose writer died
    assert [r.path for r in changes.read().collect()] == ["c"]
    assert changes.write(paths("z")) == 100 and [r.path for r in changes.read().collect()] == ["z"]


def test_shell(spark, tmp_path, monkeypatch, capsys):
    from tessera.__main__ import main

    monkeypatch.setenv("TESSERA_HOME", str(tmp_path))
    monkeypatch.setattr("sys.stdin", io.BytesIO(b"x/abc\r\n\nq\nz/ab"))
    assert main(["filter", "fn", "^a"]) == 0 and capsys.readouterr().out == "x/abc\nz/ab\n"
    assert main([]) == 0 and capsys.readouterr().out.startswith("Verbs")


def test_blocks_hold_whole_lines():
    rnd = random.Random(8)
    raw = b"".join(b"x" * rnd.randint(0, 60) + b"\n" for _ in range(500)) + b"y" * 300 + b"\n" + b"tail"
    got = list(input.blocks(io.BytesIO(raw), 64, patience=1e9))
    assert b"".join(got) == raw and all(b.endswith(b"\n") for b in got[:-1]) and got[-1].endswith(b"tail")
    assert all(len(b) < 2 * 64 + 62 or b.count(b"\n") < 4 for b in got) and list(input.blocks(io.BytesIO(b""))) == []


def test_input_is_answered_before_its_end(spark, monkeypatch):
    """Answers come in the input's order while it is still open, and only a few blocks lie unread at a time."""
    monkeypatch.setattr(input, "AHEAD", 3)
    read, write = os.pipe()
    said, most = [], []
    real = input.Spool.unread
    monkeypatch.setattr(input.Spool, "unread", lambda self: most.append(real(self)) or most[-1])
    out = os.fdopen(write, "wb", buffering=0)

    def feed():
        out.write(b"a/first\nb/none\n")
        for _ in range(600):
            if said:
                break
            time.sleep(0.1)
        said.append("-- the input goes on")
        for i in range(12):
            out.write(b"".join(b"a/n%d\n" % (1000 * i + k) for k in range(1000)))
        out.write(b"a/last")
        out.close()

    feeder = threading.Thread(target=feed)
    feeder.start()
    with os.fdopen(read, "rb") as source:
        n = input.filter_input(spark, source, "^a/", parse_options(""), said.append)
    feeder.join()
    assert n == 12_002 and said[:2] == ["a/first", "-- the input goes on"] and said[2:] == [f"a/n{i}" for i in range(12_000)] + ["a/last"]
    assert max(most) <= 4


def test_input_with_limits_and_ranks(spark):
    raw = b"".join(b"src/x%d.c\n" % i for i in range(3000))
    ran = lambda q, o: (lambda said: (input.filter_input(spark, io.BytesIO(raw), q, parse_options(o), said.append), said))([])
    assert ran("x[0-9]*7\\.", "L3") == (3, ["src/x7.c", "src/x17.c", "src/x27.c"])
    assert ran("s/x2999", "ff L2")[1] == ["src/x2999.c"] and ran("nothing", "")[0] == 0


def test_filter_stream(spark):
    from tessera.plans.options import parse_options

    rows = spark.createDataFrame([("src/abc",), ("",), ("b/xa",)], "path string")
    found = lambda q, o="": [r.path for r in filter_stream(rows, q, parse_options(o)).collect()]
    assert found("A$", "i") == ["b/xa"] and found("") == ["src/abc", "b/xa"] and found("a.c", "l") == [] and found("^a", "fn") == ["src/abc"]
    assert found("b/ xa", "fs") == ["b/xa"] and found("sab", "ff") == ["src/abc"]


def test_excluded_folders_are_not_walked(spark, tmp_path, monkeypatch):
    for d in ("a/gen/deep", "a/src", ".git"):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "f.c").write_text("x")
    monkeypatch.setattr(tree, "BRANCHES", 1)
    walked = []
    found = tree.scan(str(tmp_path), lambda folder: walked.append(folder) or tree.skipper(str(tmp_path), [["^a/gen$"]])(folder))
    assert [p for p, _, _ in found] == [f"{tmp_path}/a/src/f.c"] and f"{tmp_path}/a/gen/deep" not in walked
    rows = lambda *e: sorted(r.path[len(str(tmp_path)) + 1 :] for r in tree.listing(spark, str(tmp_path), list(e)).collect())
    assert rows(["^a/gen$"]) == ["a/src/f.c"] and rows() == ["a/gen/deep/f.c", "a/src/f.c"]
    assert rows(["^a/gen$"], ["^a/src"]) == rows()  # each group excludes another


def stored_rows(spark, v, n=4):
    return spark.createDataFrame([(f"f{i}", 0, "x", v) for i in range(n)], "path string, part_no int, content string, size long")


def test_store_survives_a_writer_that_dies(spark, tmp_path, monkeypatch):
    """Readers have an index at any time, whatever step of a write fails."""
    store = Store(spark, str(tmp_path / "s"), target=50)
    rows = lambda v: stored_rows(spark, v)
    store.write("v1", rows(1), store.sized(100))
    sizes = lambda: {r.size for r in store.read().collect()}

    def dies(*a):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(store.folder, "publish", dies, raising=False)
        with pytest.raises(OSError):
            store.write("v2", rows(2), store.sized(100))
    assert sizes() == {1} and "v2" not in store.folder.names()
    before = store.read()
    store.write("v3", rows(3), store.sized(100))
    assert sizes() == {3} and {r.size for r in before.collect()} == {1}  # a reader that has begun goes on
    store.write("v4", rows(4), store.sized(100))
    assert sizes() == {4} and sorted(n for n in store.folder.names() if n.startswith("v")) == ["v3", "v4"]
    with pytest.raises(Conflict):
        store.folder.publish(f"MANIFEST-{store.manifest().number}", "{}")
    assert store.read(what="index").count() > 0 and store.stored_bytes() > 0
    assert not [n for n in store.folder.names() if n.startswith((".", "LEASE"))]


STEPS = ["before", "lease", "data", "index", "publish"]


@pytest.mark.parametrize("step", STEPS)
def test_two_writers_at_each_step(spark, tmp_path, monkeypatch, step):
    """A writer that is overtaken at any step raises, and the other's index stays whole; its own folder goes."""
    slow, fast = (Store(spark, str(tmp_path / "s"), target=50) for _ in range(2))
    fast.write("v0", stored_rows(spark, 0), fast.sized(100))
    base = slow.sized(100)
    done = []

    def overtaken():
        if not done:
            done.append(fast.write("v-fast", stored_rows(spark, 7, 30), fast.sized(100)))
            assert {r.size for r in fast.read().collect()} == {7}

    def after(name, now):
        real = getattr(slow if name in ("_written",) else slow.folder, name)

        def run(*a, **k):
            if now == "first":
                overtaken()
            out = real(*a, **k)
            if now == "last":
                overtaken()
            return out

        monkeypatch.setattr(slow if name == "_written" else slow.folder, name, run, raising=False)

    if step == "before":
        overtaken()
    elif step == "lease":
        after("write", "last")
    elif step == "data":
        after("names", "first")  # the data is there, its index is not
    elif step == "index":
        after("_written", "last")
    else:
        after("publish", "first")
    with pytest.raises(Conflict):
        slow.write("v-slow", stored_rows(spark, 8), base)
    assert done and {r.size for r in slow.read().collect()} == {7} and slow.read().count() == 30 and slow.read(what="index").count() > 0
    assert not [n for n in slow.folder.names() if n.startswith(("v-slow", "LEASE", "."))]
    slow.write("v-again", stored_rows(spark, 9), slow.sized(100))
    assert {r.size for r in fast.read().collect()} == {9}


def test_leases_end(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.folder.write("vdead/x", "x")
    store.folder.write("LEASE-vdead", str(time.time() + 60))
    store.write("v1", stored_rows(spark, 1), store.sized(10))
    assert "vdead" in store.folder.names() and store.leased() == {"vdead"}
    store.folder.write("LEASE-vdead", str(time.time() - 1))
    store.clean()
    assert sorted(n for n in store.folder.names() if not n.endswith(".crc")) == ["MANIFEST-1", "v1"]


def test_rows_that_go_missing_are_told(spark, tmp_path, monkeypatch):
    """A folder without the rows that were written is never published as an empty index."""
    store = Store(spark, str(tmp_path / "s"))
    store.write("v1", stored_rows(spark, 1), store.sized(10))
    monkeypatch.setattr(store.folder, "names", lambda below="": [] if "/" in below else Folder.names(store.folder, below), raising=False)
    with pytest.raises(OSError, match="4 rows were written"):
        store.write("v2", stored_rows(spark, 2), store.sized(10))
    assert {r.size for r in store.read().collect()} == {1}
    with pytest.raises(ValueError, match="not to be written"):
        Store(spark, store.top).write("v3", stored_rows(spark, 3), store.manifest())


def test_a_limit_ends_before_later_projects(spark, tmp_path, monkeypatch):
    """Lines up to a limit are those of the whole search, and projects behind the one that reaches it are not looked at."""
    src, file, engine, *_ = watched(spark, tmp_path)
    (tmp_path / "home" / "q.cfg").write_text((tmp_path / "home" / "p.cfg").read_text())
    engine.build(str(tmp_path / "home" / "q.cfg"))
    every = engine.execute(["search", "p,q,p", "line"])
    assert len(every) == 9
    real, looked = Engine.parts, []
    monkeypatch.setattr(Engine, "parts", lambda self, f, *a: looked.append(f.rsplit("/", 1)[1]) or real(self, f, *a))
    for n, projects in ((1, ["p.cfg"]), (3, ["p.cfg"]), (4, ["p.cfg", "q.cfg"]), (20, ["p.cfg", "q.cfg", "p.cfg"]), (0, ["p.cfg", "q.cfg", "p.cfg"])):
        looked.clear()
        assert engine.execute(["search", "p,q,p", f"L{n}", "line"]) == every[: n or 9] and looked == projects


def test_an_index_of_another_format(spark, tmp_path):
    """A search tells of it, and an update builds the index anew."""
    src, file, engine, *_ = watched(spark, tmp_path)
    store = engine._store(file)
    store.folder.publish("MANIFEST-2", '{"format": 2, "buckets": 1, "folders": {"0": "v1"}}')
    with pytest.raises(FormatError, match="run update"):
        engine.execute(["search", "p", "line"])
    assert engine.update(file).count() == 0 and store.manifest().number == 3
    assert engine.execute(["search", "p", "l", "line 1"]) == [f"{src}/f1.c:1:line 1"]


def test_builds_and_updates_begin_anew_when_overtaken(spark, tmp_path, monkeypatch):
    src, file, engine, *_ = watched(spark, tmp_path)
    (src / "new.c").write_text("needle\n")
    real, first = Store.write, []

    def write(self, version, rows, base):
        if not first:
            first.append(1)
            engine.update(file)  # another process, which is faster
        return real(self, version, rows, base)

    for verb in ("update", "build"):
        first.clear()
        with monkeypatch.context() as m:
            m.setattr(Store, "write", write)
            getattr(engine, verb)(file)
        assert engine.execute(["search", "p", "l", "needle"]) == [f"{src}/new.c:1:needle"] and len(engine.execute(["files", "p", ""])) == 4
        (src / "f1.c").write_text("other than before\n")


def test_store_keeps_untouched_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), target=10)
    store.write("v1", stored_rows(spark, 1, 40), store.sized(80))
    first = store.manifest()
    bucket = next(b for b, v in first.buckets.items() if v)
    base = Manifest(first.number, {b: None if b == bucket else v for b, v in first.buckets.items()})
    store.write("v2", store.read({bucket}).select("path", "part_no", "content", (F.col("size") + 100).alias("size")), base)
    second = store.manifest().buckets
    assert {b for b, v in first.buckets.items() if second[b] != v} == {bucket} and len(second) == 8
    got = {r.path: r.size for r in store.read().collect()}
    assert len(got) == 40 and set(got.values()) == {1, 101}
    assert Store(spark, str(tmp_path / "none")).read() is None


def test_buckets_split_by_further_bits():
    m = Manifest().split({1: 1000}, 100)
    assert sorted(m.buckets) == list(range(16, 32)) and m.slots() == list(range(16, 32))
    more = m.split({16: 350, 17: 149}, 100)
    assert set(more.buckets) == {*range(17, 32), 64, 80, 96, 112}  # only the one that has grown, by two bits
    slots = more.slots()
    assert len(slots) == 64 and all(slots[h] == next(b for b in more.buckets if b & ((1 << (b.bit_length() - 1)) - 1) == h & ((1 << (b.bit_length() - 1)) - 1)) for h in range(64))


def test_buckets_grow_with_a_project(spark, tmp_path):
    """Built small and grown a hundred times, buckets are near the target; then a small change writes one of them."""
    src, home, target = tmp_path / "src", tmp_path / "home", 4000
    src.mkdir()
    home.mkdir()
    (home / "p.cfg").write_text(f"path {src}\n")
    file, engine = str(home / "p.cfg"), Engine(spark, str(home), bucket_bytes=target)
    write = lambda i: (src / f"f{i:03}.c").write_text(f"needle {i}\n" + "x" * 390)
    for i in range(8):
        write(i)
    engine.build(file)
    store = engine._store(file)
    assert list(store.manifest().buckets) == [1]
    for i in range(8, 800):
        write(i)
    engine.update(file)
    sizes = {r.bucket: r.n for r in store.read().groupBy(F.shiftright("chunk_id", 32).alias("bucket")).agg(F.sum(F.length("content")).alias("n")).collect()}
    assert len(sizes) > 60 and max(sizes.values()) <= 2.5 * target and sum(sizes.values()) / len(sizes) > target / 3
    first = store.manifest().buckets
    (src / "f700.c").write_text("needle anew\n")
    (src / "f701.c").unlink()
    n = {r.status: r.n for r in engine.update(file).collect()}
    second = store.manifest().buckets
    assert n["changed"] == n["removed"] == 1 and n["buckets written"] <= 2 and len({b for b in second if second[b] != first.get(b)}) <= 2
    assert len(engine.execute(["search", "p", "needle"])) == 799 and engine.execute(["search", "p", "anew"]) == [f"{src}/f700.c:1:needle anew"]


def whole_text(raw):
    text = tree.to_utf8(raw).decode("utf-8", "replace")
    return text.replace("\r\n", "\n").replace("\r", "\n")


@pytest.mark.parametrize("code,mark", [("utf-8", b""), ("utf-8", b"\xef\xbb\xbf"), ("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("utf-32-le", b"\xff\xfe\0\0"), ("utf-32-be", b"\0\0\xfe\xff")])
def test_ranges_make_up_the_file(tmp_path, monkeypatch, code, mark):
    """Parts of all ranges, cut anywhere, are the file's text, and their line numbers go on."""
    monkeypatch.setattr(ranges, "STEP", 16)
    rnd = random.Random(4)
    for trial in range(60):
        text = "".join(rnd.choice(["a", "\u0a0d", "é", "😀", "\n", "\r", "\r\n", "ਊ", "\u0d0a"]) for _ in range(rnd.choice([0, 1, 5, 200])))
        raw = mark + text.encode(code)
        path = tmp_path / f"t{trial}"
        path.write_bytes(raw)
        size, chunk = rnd.choice([16, 33, 64]), rnd.choice([8, 16])
        cuts = [*range(0, len(raw), size), len(raw)] if raw else [0, 0]
        got, line = "", 0
        for begin, end in zip(cuts, cuts[1:], strict=False):
            own = list(ranges.parts_of(str(path), begin, end, chunk))
            with open(path, "rb") as file:
                lines = ranges.Lines(file)
                counted = lines.count(lines.begin(begin), lines.begin(end))
            assert counted == sum(ranges.line_ends(t) for _, t in own)
            for before, part in own:
                assert line + before == got.count("\n")
                got += whole_text(part)
                assert got.endswith("\n") or len(got) == len(whole_text(raw))
            line += counted
        assert got == whole_text(raw)


def test_large_files_by_ranges(spark, tmp_path):
    """A file of many ranges is read by many tasks, no row holds much of it, and an index of it is as one of small files."""
    path = tmp_path / "big.txt"
    path.write_bytes(b"\xff\xfe" + "".join(f"line {i} é\r\n" for i in range(60_000)).encode("utf-16-le"))
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "small.txt").write_bytes(b"one\rtwo")
    size, chunk = 1 << 16, 1 << 11
    rows = ranges.read(tree.listing(spark, str(tmp_path)), size, chunk).withColumn("task", F.spark_partition_id()).collect()
    big = sorted((r for r in rows if r.path.endswith("big.txt")), key=lambda r: r.part_no)
    assert len({r.task for r in big}) > 3 and max(len(r.content) for r in big) < 2 * chunk
    assert "".join(r.content for r in big) == "".join(f"line {i} é\n" for i in range(60_000))
    assert all(r.start_line == int(r.content.split()[1]) for r in big) and len({r.part_no for r in big}) == len(big)
    assert [(r.part_no, r.content) for r in rows if "empty" in r.path] == [(0, "")] and [r.content for r in rows if "small" in r.path] == ["one\ntwo"]
    assert ranges.read(spark.createDataFrame([(str(tmp_path / "gone"), 1, 5)], tree.SCHEMA)).count() == 0
    home = tmp_path / "home"
    home.mkdir()
    (home / "p.cfg").write_text(f"path {tmp_path}\ninclude txt$\n")
    engine = Engine(spark, str(home), bucket_bytes=1 << 18, sizes=(size, chunk))
    engine.execute(["build", "p"])
    data = engine._store(str(home / "p.cfg")).read()
    assert data.where("path like '%big.txt'").select(F.shiftright("chunk_id", 32)).distinct().count() > 3
    assert engine.execute(["search", "p", "C", "9999 é$"])[1] == f"{path}:19999:7:line 19999 é".replace(":19999:", ":20000:")
    assert engine.execute(["info", "p"])[1].endswith("0 parts out of order")
    path.write_bytes(b"".join(f"row {i}\n".encode() for i in range(10_000)))  # shrinks: all its buckets are written anew
    engine.execute(["update", "p"])
    assert engine.execute(["search", "p", "line|row 9999"]) == [f"{path}:10000:row 9999"]


def test_many_small_files_are_handed_on_together(spark, tmp_path):
    """Fewer and more than go at once, with empty ones and some of megabytes among them."""
    for i in range(2300):
        (tmp_path / f"f{i:04}").write_text("" if i % 7 == 0 else f"{i}\n" * (300_000 if i % 1000 == 1 else 1))
    files = tree.listing(spark, str(tmp_path)).coalesce(1)
    got = ranges.read(files).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("part_no", "start_line", "content"))).alias("parts")).collect()
    assert len(got) == 2300
    for r in got:
        parts = [p.content for p in r.parts]
        assert "".join(parts) == (tmp_path / r.path.rsplit("/", 1)[1]).read_text()
        assert [p.start_line for p in r.parts] == [sum(q.count("\n") for q in parts[:k]) for k in range(len(parts))]


def test_large_files_in_parts(spark, tmp_path):
    """A file over a chunk is stored in parts, its lines keep their numbers, and the index leaves out chunks."""
    src, home = tmp_path / "src", tmp_path / "home"
    src.mkdir()
    home.mkdir()
    (src / "big.c").write_text("".join(f"line number {i} of a large file\n" for i in range(40_000)) + "the needle is here\n")
    (src / "small.c").write_text("small\n")
    (home / "p.cfg").write_text(f"path {src}\n")
    said = []
    engine = Engine(spark, str(home), said.append)
    engine.execute(["build", "p"])
    assert said[0].startswith("2 files of")
    assert engine.execute(["search", "p", "l", "needle"]) == engine.execute(["search", "p", "lb", "needle"]) == [f"{src}/big.c:40001:the needle is here"]
    data = engine._store(str(home / "p.cfg")).read()
    assert data.where("path like '%big.c'").count() > 2 and engine.corpus(str(home / "p.cfg"), "needle").count() < data.count()
    assert len(engine.execute(["files", "p", ""])) == 2
    first, second = engine.execute(["info", "p"])
    assert first.startswith("p: 2 files,") and second.endswith("0 parts out of order")
    (src / "small.c").write_text("other size\n")
    n = {r.status: r.n for r in engine.update(str(home / "p.cfg")).collect()}
    assert n["changed"] == 1 and n["reused"] == 1 and engine.execute(["search", "p", "l", "number 39999 of"]) == [f"{src}/big.c:40000:line number 39999 of a large file"]
