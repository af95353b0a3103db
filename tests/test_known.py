"""Trees that are known: what a look finds is what a whole listing finds, and only changed folders are opened."""

import os
import random
import time

from tessera.sources import known, tree



#: No folder is too new: tests change them at another nanosecond.
ANY = -1e12


def make(top, n=3):
    for i in range(n):
        for j in range(n):
            (top / f"d{i}" / f"e{j}").mkdir(parents=True)
            (top / f"d{i}" / f"e{j}" / f"f{j}.c").write_text("x" * j)
    (top / "d0" / ".git").mkdir()
    (top / "d0" / ".git" / "no").write_text("no")
    (top / "skip").mkdir()
    (top / "skip" / "no").write_text("no")
    (top / "top é.c").write_text("")


def whole(spark, roots):
    return sorted(tuple(r) for r in tree.listings(spark, roots).collect())


def seen(it):
    return sorted(tuple(r) for r in it.files().collect())


def test_looks_equal_listings(spark, tmp_path):
    """Over files and folders that come, go, change, move and turn into each other and into links."""
    src = tmp_path / "src"
    make(src)
    (tmp_path / "far").mkdir()
    (tmp_path / "far" / "x.c").write_text("far")
    (tmp_path / "far" / "e0").mkdir()
    (tmp_path / "far" / "e0" / "f0.c").write_text("far")
    roots = {str(src): [["^skip$"]], str(src / "d1"): [], str(tmp_path / "none"): []}
    it = known.KnownTree(spark, str(tmp_path / "t"), roots)
    assert seen(it) == []
    assert it.look() and seen(it) == whole(spark, roots) != []

    def step(*acts):
        for act in acts:
            act()
        assert it.look()
        assert seen(it) == whole(spark, roots)

    step(lambda: (src / "d0/e0/f0.c").write_text("changed in place"), lambda: (src / "d2/e2/f2.c").unlink())
    step(lambda: (src / "d0/new/deep/deeper").mkdir(parents=True), lambda: (src / "d0/new/deep/deeper/n.c").write_text("n"))
    step(lambda: (src / "d2").rename(src / "d9"), lambda: (src / "d1/e1").rename(src / "d0/e7"))
    step(lambda: (src / "d0/e0").rename(tmp_path / "e0 away"), lambda: (src / "d0/e0").mkdir(), lambda: (src / "d0/e0/f0.c").write_text("another"))
    step(lambda: (src / "d9").rename(tmp_path / "d9 away"), lambda: (src / "d9").symlink_to(tmp_path / "d9 away"))
    step(lambda: (src / "d9").unlink(), lambda: (src / "d9").write_text("a file now"))
    step(lambda: (tmp_path / "none/a").mkdir(parents=True), lambda: (tmp_path / "none/a/b.c").write_text("b"))
    step(lambda: (tmp_path / "none").rename(tmp_path / "none away"))
    again = known.KnownTree(spark, str(tmp_path / "t"), roots)  # a new process goes on from the table
    assert again.number() == it.number() > 0


def test_random_changes(spark, tmp_path):
    rng, src = random.Random(5), tmp_path / "src"
    make(src, 2)
    roots = {str(src): []}
    it = known.KnownTree(spark, str(tmp_path / "t"), roots, ANY)
    it.look()
    for _ in range(6):
        time.sleep(0.02)
        for _ in range(4):
            folders = [f for f, _, _ in os.walk(src) if ".git" not in f]
            files = [os.path.join(f, n) for f in folders for n in os.listdir(f) if os.path.isfile(os.path.join(f, n))]
            act = rng.randrange(4)
            if act == 0:
                os.makedirs(os.path.join(rng.choice(folders), f"n{rng.random()}"))
            elif act == 1 and files:
                os.unlink(rng.choice(files))
            elif act == 2 and files:
                with open(rng.choice(files), "a") as f:
                    f.write("more")
            else:
                with open(os.path.join(rng.choice(folders), f"f{rng.random()}"), "w") as f:
                    f.write("new")
        it.look()
        assert seen(it) == whole(spark, roots)


def test_only_changed_folders_are_opened(tmp_path, monkeypatch):
    """Asking again opens no folder, and a change names its own folder alone."""
    import pandas as pd

    make(tmp_path)
    root, rows, todo = str(tmp_path), [], [str(tmp_path)]
    while todo:
        found = pd.concat(known._level({root: []}, ANY)(iter([pd.DataFrame({"root": [root] * len(todo), "folder": todo})])))
        rows.append(found[~found["below"]])
        todo = found[found["below"]]["folder"].tolist()
    table = pd.concat(rows)[known.COLUMNS].astype(object).where(lambda d: d.notna(), None)
    opened, real = [], os.scandir
    monkeypatch.setattr(known.os, "scandir", lambda p: opened.append(p) or real(p))
    assert len(pd.concat(known.differing(iter([table])))) == 0 and not opened
    (tmp_path / "d1" / "e1" / "new.c").write_text("new")
    (tmp_path / "d2" / "e2" / "f2.c").write_text("changed in place")
    diff = pd.concat(known.differing(iter([table])))
    assert sorted(diff["folder"]) == [f"{root}/d1/e1", f"{root}/d2/e2"] and not opened
    assert diff[diff["name"].notna()]["size"].tolist() == [16]


def test_at_rest_nothing_is_written(spark, tmp_path):
    make(tmp_path / "src")
    it = known.KnownTree(spark, str(tmp_path / "t"), {str(tmp_path / "src"): []}, ANY)
    assert it.look() and not it.look() and not it.look() and it.number() == 1
    (tmp_path / "t" / it.folder.top.rsplit("/", 1)[1] / "t2").mkdir()  # a look that died
    (tmp_path / "src" / "more").write_text("")
    assert it.look() and it.number() == 3
    assert not it.look()
    assert sorted(n for n in it.folder.names() if n.startswith(".work")) == []


def test_new_folders_have_no_stamp(tmp_path):
    """A folder may change again within a tick of the clock, so it is looked at once more."""
    assert known.stamp_of(str(tmp_path), "", 60) == "" and known.stamp_of(str(tmp_path), "") != ""
    assert known.stamp_of(str(tmp_path / "none"), "") is None
    (tmp_path / "file").write_text("")
    assert known.stamp_of(str(tmp_path / "file"), "") is None
    (tmp_path / "link").symlink_to(tmp_path)
    assert known.stamp_of(str(tmp_path / "link"), "") is None
    assert known.stamp_of(str(tmp_path / "link"), str(tmp_path / "link"), 60) == ""
