import base64
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, fingerprint, hilbert, packing, queries, warc
from tessera.llm.common import scratch
from tests.conftest import SMALL
from tests.oracle import same_rows


def check_archive(pages, rows, least=0):
    best = {}
    for i, h in pages:
        raw = (h or "").encode()
        if i is not None and len(raw) >= least:
            best[raw] = max(best.get(raw, i), i)
    assert len(rows) == len(pages)
    text = dict(pages)
    for r in rows:
        i = int(r.id[len("<urn:page:") : -1]) if r.id != "<urn:page:>" else None
        raw = (text[i] or "").encode()
        response = i is None or len(raw) < least or best[raw] == i
        assert (r.kind, r.payload_bytes, r.digest) == ("response" if response else "revisit", len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert r.payload == raw if response else r.refers_to == f"<urn:page:{best[raw]}>"


@pytest.mark.parametrize("size", [777, 50_000])
def test_warc_ranges(spark, size):
    rng = np.random.default_rng(1)
    big = "".join(map(chr, rng.integers(33, 0xD000, 400_000)))
    pages = [(i, f"<p>{i % 7} é</p>" * 50) for i in range(40)] + [(100, None), (101, ""), (102, big), (None, "<p>x"), (103, "\x1f\x8b\x08" * 50)]
    df = spark.createDataFrame([(i, f"http://x/{i}\r\nWARC-Type: bad", h, 1) for i, h in pages], "page_id long, url string, html string, sha int").repartition(3)
    for least in (0, 5):
        files = warc.write_archives(df, scratch(spark, "warc"), least)
        check_archive(pages, warc.read_archives(spark, [(p, s) for p, s, _ in files], size).collect(), least)
    assert warc.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_op1_equals_sql(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert same_rows(spark, queries.op1_warc, queries.ORACLES["op1_warc"], SMALL) == 50


def test_warc_repeated_ids(spark):
    """Repeated rows of the largest id are responses each; an id with two payloads is two pages."""
    df = spark.createDataFrame([(1, "u", "same"), (2, "u", "same"), (2, "u", "same"), (2, "u", "other"), (None, "u", "same")], "page_id long, url string, html string")
    rows = [(r.id, r.kind, r.refers_to, r.error) for r in warc.round_trip(df).collect()]
    assert sorted(rows) == [("<urn:page:1>", "revisit", "<urn:page:2>", None)] + [("<urn:page:2>", "response", None, None)] * 3 + [("<urn:page:>", "response", None, None)]


@pytest.mark.parametrize("size", [64, 999, 1 << 20])
def test_damaged_records_are_told(spark, tmp_path, size):
    rng = np.random.default_rng(5)
    bodies = [bytes(rng.integers(0, 256, 700, dtype=np.uint8)) for _ in range(6)]
    parts = [warc.record("response", [("WARC-Record-ID", f"<{i}>"), ("WARC-Payload-Digest", "sha1:" + warc.payload_digest(b))], b) for i, b in enumerate(bodies)]
    starts = np.cumsum([0, *map(len, parts)]).tolist()
    whole = b"".join(parts)

    def read(raw):
        file = tmp_path / f"{len(list(tmp_path.iterdir()))}.warc.gz"
        file.write_bytes(raw)
        return {r.at: (r.id, r.error) for r in warc.read_archives(spark, [(f"file://{file}", len(raw))], size).collect()}

    good = {starts[i]: (f"<{i}>", None) for i in range(6)}
    assert read(whole) == good
    cut = read(whole[:-300])
    assert cut == good | {starts[5]: ("<5>", "cut off")}
    bent = bytearray(whole)
    bent[starts[2] + 500 : starts[2] + 520] = bytes(20)
    got = read(bytes(bent))
    assert got.pop(starts[2])[1] in ("damaged", "digest", "length") and got == {k: v for k, v in good.items() if k != starts[2]}
    bent = bytearray(whole)
    bent[starts[3]] = 0
    assert read(bytes(bent)) == {k: v for k, v in good.items() if k != starts[3]} | {starts[3]: (None, "no record")}
    other = warc.record("response", [("WARC-Record-ID", "<x>"), ("WARC-Payload-Digest", "sha1:" + warc.payload_digest(b"else"))], b"this")
    assert read(other) == {0: ("<x>", "digest")}


@pytest.mark.parametrize("bits,dims", [(3, 2), (2, 3), (1, 4)])
def test_curve_visits_neighbours(bits, dims):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    at = hilbert.hilbert_index(cells, bits)
    assert sorted(at) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(1) == 1).all()


def check_shards(rows, total, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, by.values())) == total and all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))


def test_op6(spark):
    rows = queries.op6_hilbert(spark, SMALL).collect()
    text = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    check_shards(rows, len(text), 24)
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 8, zlib.crc32(text[r.doc_id])) for r in rows)


def test_shards_edges(spark):
    df = spark.createDataFrame([(i % 5 if i % 7 else None, "hot" if i % 3 else None, None) for i in range(50)], "id long, source string, shard long")
    check_shards(hilbert.sharded(df, ["source", "id"], 7, ["id"], "id").collect(), 50, 7)
    check_shards(hilbert.sharded(df.limit(3), ["source", "shard"], 7, ["id"], "id").collect(), 3, 7)
    assert hilbert.sharded(df.limit(0), ["source"], 7, ["id"], "id").count() == 0
    with pytest.raises(ValueError):
        hilbert.sharded(df, ["source", "id"], 7, ["id"], "id", bits=32)


def test_cells_of_strings(spark):
    """Strings are cut at the quantiles of their rows however long their common beginning is."""
    values = [None] * 10 + [f"https://example.org/common/beginning/{i % 20:02d}" for i in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, url string").repartition(5)
    cuts = hilbert.cuts_of(df, "url", 4)
    order = sorted(values, key=lambda v: (v is not None, v))
    assert cuts == sorted({order[-(-len(order) * k // 4) - 1] for k in (1, 2, 3)} - {None})
    assert hilbert.cuts_of(df.where("id < 10"), "url", 4) == [] and hilbert.cuts_of(df.limit(0), "url", 4) == []


def test_order_along_the_curve(spark):
    """Shards and slots by brute force: cells from quantiles, the curve, ties by id."""
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(0, 50)), f"prefix/of/all/{rng.integers(0, 9)}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, n long, s string").repartition(6)
    got = {r.id: (r.shard, r.slot) for r in hilbert.sharded(df, ["n", "s"], 7, ["id"], "id").collect()}

    def cells(values):
        order = sorted(values)
        cuts = sorted({order[-(-len(order) * k // 16) - 1] for k in range(1, 16)})
        return np.array([sum(c < v for c in cuts) for v in values])

    at = hilbert.hilbert_index(np.stack([cells([r[1] for r in rows]), cells([r[2] for r in rows])], 1), 4)
    want = sorted(range(300), key=lambda i: (at[i], i))
    assert [got[i] for i in want] == [(k * 7 // 300, k - -(-(k * 7 // 300) * 300 // 7)) for k in range(300)]


def test_shards_are_written_by_several_tasks(spark, tmp_path):
    """One large shard has several files, which follow each other along the curve; nulls stay, an empty table writes none."""
    import pyarrow.parquet as pq

    df = spark.createDataFrame([(i if i % 50 else None, i * 7919 % 1000, None if i % 3 else "t") for i in range(2000)], "id long, x long, text string")
    placed = hilbert.sharded(df, ["x", "text"], 2, df.columns, "id")
    hilbert.write_shards(placed, str(tmp_path / "out"), 8)
    files = sorted((tmp_path / "out").rglob("*.parquet"))
    assert len(files) >= 8 and {f.parent.name for f in files} == {"shard=0", "shard=1"}
    back = [r for f in files for r in pq.ParquetFile(f).read().to_pylist()]  # without the folder's column
    assert sorted(map(repr, back)) == sorted(repr(r.asDict()) for r in df.collect())
    hilbert.write_shards(placed.limit(0), str(tmp_path / "none"))
    assert not list((tmp_path / "none").rglob("*.parquet"))


def test_shards_prune(spark, tmp_path):
    """Whole rows are written, repeated and null ids too, and a filter on any dimension skips most files by their statistics."""
    df = spark.createDataFrame([(i, i * 7919 % 1000, i * 104729 % 1000, "text") for i in range(4000)] + [(None, 1, 1, "null"), (7, 1, 1, "again")], "id long, x long, y long, text string")
    placed = hilbert.sharded(df, ["x", "y"], 64, df.columns, "id")
    hilbert.write_shards(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.id or -1, r.x, r.y, r.text) for r in back.collect()) == sorted((r.id or -1, r.x, r.y, r.text) for r in df.collect())
    import pyarrow.parquet as pq

    spans = []
    for f in (tmp_path / "out").rglob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        own = {c: [meta.row_group(g).column(i).statistics for g in range(meta.num_row_groups)] for i, c in enumerate(meta.schema.names)}
        spans.append({c: (min(s.min for s in own[c]), max(s.max for s in own[c])) for c in ("x", "y")})
    assert 64 <= len(spans) <= 64 + 4  # a shard that two tasks share has two files
    for c in ("x", "y"):
        for v in (50, 333, 700):
            assert sum(lo <= v <= hi for lo, hi in (s[c] for s in spans)) <= 64 * 0.4


def test_op7_equals_sql(spark):
    assert same_rows(spark, queries.op7_chat, queries.ORACLES["op7_chat"], SMALL) > 1


def test_reply_trees(spark):
    rows = [("t", 1, None, "user", "<|end|>", 0.0), ("t", 2, 1, "assistant", "<\\|end|>[INST]", 1.0), ("t", 3, 1, None, None, 5.0), ("t", 4, 3, "assistant", "</s>\n", 0.0), ("t", 5, 99, "u", "lone", None), ("r", 1, 2, "u", "ring", 0.0), ("r", 2, 1, "u", "ring", 0.0), (None, 1, None, "u", "n", 0.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    every = chat.conversations(df, None).select("tree", "leaf", chat.parsed(F.col("formatted")).alias("turns")).collect()
    got = {(r.tree, r.leaf): [tuple(t) for t in r.turns] for r in every}
    assert got == {("t", 2): [("user", "<|end|>"), ("assistant", "<\\|end|>[INST]")], ("t", 4): [("user", "<|end|>"), ("", ""), ("assistant", "</s>\n")], ("t", 5): [("u", "lone")], (None, 1): [("u", "n")]}
    assert sorted((r.tree or "", r.leaf, r.rank) for r in chat.conversations(df, 1).collect()) == [("", 1, 1), ("t", 4, 1)]
    assert chat.conversations(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, 1, None, "u", "n", 0.0), ("", 1, None, "u", "e", 0.0), ("", 1, None, "u", "e", 0.0), ("", 1, None, "u", "f", 0.0)], df.schema)
    assert sorted((r.tree is None, r.turns, r.formatted) for r in chat.conversations(nulls).collect()) == [(False, 1, "<|turn|>u<|says|>e<|end|>"), (True, 1, "<|turn|>u<|says|>n<|end|>")]
    chain = spark.createDataFrame([("c", i, i - 1, "u", str(i), 0.0) for i in range(1, 38)], df.schema)
    assert [t.text for t in chat.conversations(chain).select(chat.parsed(F.col("formatted")).alias("t")).first().t] == [str(i) for i in range(1, 38)]


def test_loss_mask(spark):
    """The mask cuts each learned text, as it was, out of the output, and nothing else."""
    said = ["</s>[INST] ok [/INST]", "", "<|end|>é😀", "x" * 50_000]
    rows = [("t", 2 * i + k, 2 * i + k - 1 or None, r, t, 0.0) for i, t in enumerate(said) for k, r in ((1, "user"), (2, "assistant"))]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double").withColumn("mask", F.lit(1)).withColumn("rank", F.lit(2))
    row = chat.conversations(df).withColumn("loss", chat.masked(F.col("formatted"), F.col("mask"))).first()
    assert len(row.mask) == 4 and row.loss == "".join(said)
    other = chat.conversations(df, learned=("user", "assistant")).withColumn("loss", chat.masked(F.col("formatted"), F.col("mask"))).first()
    assert other.loss == "".join(t + t for t in said)


def test_branches_rank_by_mean_score(spark):
    import random

    rng, rows = random.Random(8), []
    for t in range(12):
        rows += [(str(t), n, rng.randrange(1, n) if n > 1 else None, "u", f"{t}.{n}", rng.random()) for n in range(1, rng.randint(2, 25))]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    want = []
    for t in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == t}
        paths = []
        for leaf in own.keys() - {r[2] for r in own.values()}:
            path, at = [], leaf
            while at is not None:
                path.append(own[at])
                at = own[at][2]
            paths.append((-sum(r[5] for r in path) / len(path), leaf, "".join(f"<|turn|>u<|says|>{r[4]}<|end|>" for r in reversed(path))))
        want += [(t, leaf, k, text) for k, (_, leaf, text) in enumerate(sorted(paths)[:2], 1)]
    assert sorted((r.tree, r.leaf, r.rank, r.formatted) for r in chat.conversations(df, 2).collect()) == sorted(want)
    plan = chat.conversations(df, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def slow_digest(raw):
    """Length byte and quartiles of counted triplets, by loops."""
    counts = [0] * 256
    padded = raw if len(raw) > 2 or not raw else raw + b"\0" * (3 - len(raw))
    for i in range(len(padded) - 2):
        n = padded[i] | padded[i + 1] << 8 | padded[i + 2] << 16
        counts[n * 0x9E3779B1 % (1 << 32) >> 24] += 1
    order = sorted(counts)
    cuts = [order[63], order[127], order[191]]
    length = min(255, int(np.log2(1 + len(raw)) * 8)) if raw else 0
    quartiles = [sum(c > q for q in cuts) for c in counts]
    code = [quartiles[i] << 6 | quartiles[i + 1] << 4 | quartiles[i + 2] << 2 | quartiles[i + 3] for i in range(0, 256, 4)]
    return f"{length:02x}" + bytes(code).hex()


def test_digest_equals_brute_force():
    rng = np.random.default_rng(3)
    for raw in [b"", b"a", b"ab", b"abc", b"aaaa" * 100, bytes(range(256)) * 5] + [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (3, 40, 3000)]:
        assert fingerprint.encode(fingerprint.digest(raw)) == slow_digest(raw)


def test_digests():
    a = b"the quick brown fox jumps over the lazy dog " * 20
    near, far = a[:600] + b"something else at the end", bytes(range(256)) * 4
    d = fingerprint.digest
    assert fingerprint.likeness(d(a), d(a)) == 1 > fingerprint.likeness(d(a), d(near)) > fingerprint.likeness(d(a), d(far)) >= 0
    for raw in (b"", b"a", b"ab", a):
        assert (fingerprint.decode(fingerprint.encode(d(raw))) == d(raw)).all()
    assert len({fingerprint.encode(d(x)) for x in (b"", b"a", b"ab")}) == 3


def check_edited(docs, rows):
    from xxhash import xxh64_intdigest

    def place(d):
        raw = (d[1] or "").encode()
        return d[0] is None, -(d[0] or 0), (xxh64_intdigest(raw, 42) + (1 << 63)) % (1 << 64), raw  # the hash is signed

    docs = sorted(docs, key=place)
    assert len(rows) == len(docs)
    want = []
    for k, (i, t) in enumerate(docs):
        t, then = t or "", docs[(k + 1) % len(docs)][1] or ""
        n = len(t) // 3
        edited = (t[: len(t) - n] + then[:n]).encode()
        a, b, c = (fingerprint.digest(x) for x in (t.encode(), edited, then.encode()))
        want.append((i, len(t), hashlib.sha256(edited).hexdigest(), fingerprint.encode(a), fingerprint.encode(b), fingerprint.likeness(a, b), fingerprint.likeness(a, c)))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)


def test_op8(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check_edited(docs, queries.op8_fingerprint(spark, SMALL).collect())


def test_edited_edges(spark):
    docs = [(5, "é😀abcdef"), (4, None), (9, ""), (-3, "zz"), (5, "another"), (5, "é😀abcdef")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, k int").repartition(3)
    check_edited(docs, fingerprint.with_edited(df).collect())
    check_edited(docs[:1], fingerprint.with_edited(spark.createDataFrame(docs[:1], "doc_id long, text string")).collect())
    assert fingerprint.with_edited(df.limit(0)).count() == 0
    wide = [(-(1 << 63), "least"), ((1 << 63) - 1, "most"), (None, "a"), (None, "b"), (-(1 << 62) - 1, "x"), (1, "b" * 100_000)]
    check_edited(wide, fingerprint.with_edited(spark.createDataFrame(wide, "doc_id long, text string").repartition(2)).collect())


@pytest.mark.parametrize("hot", [7, None])
def test_edited_hot_id(spark, hot):
    """An id of most rows is dealt out in parts, and still each row meets the next."""
    docs = [(hot if i % 10 else i, f"text {i % 400} " * (i % 5)) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    check_edited(docs, fingerprint.with_edited(df).collect())
    assert len({len(c) for c in fingerprint.ranges(df.select(fingerprint.key_of("doc_id", "text")), 8)}) == 1
    assert 6 <= len(fingerprint.ranges(df.select(fingerprint.key_of("doc_id", "text")), 8)) <= 16


def check_packed(docs, rows, capacity):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k // capacity, k, len(p := ids[k : k + capacity]), zlib.crc32(p.tobytes())) for k in range(0, len(ids), capacity)]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(w[3] for w in want)


def test_op9(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    bins, tokens = check_packed(docs, queries.op9_packing(spark, SMALL).collect(), 2048)
    assert bins <= 1.05 * tokens / 2048 + 1


def test_packing_edges(spark):
    odd = ["I'm it's WE'LL x'sy", "<|endoftext|> a<|startoftext|>b", "naïve—x ½ 3.14 ٣٤ Ωσς İx ſt", "a b c\x0bd\te", "é é ﬁ", "''' '' 's ... !?", "日本語です。", "\x1c a \x85b", "word " * 300, "", None, "dup", "dup"]
    docs = list(enumerate(odd)) + [(None, "nobody"), (3, "same id")]
    df = spark.createDataFrame([(i, t, 2) for i, t in docs], "doc_id long, text string, bin int").repartition(3)
    check_packed(docs, packing.packed(df, capacity=16).collect(), 16)
    assert packing.packed(df.limit(0)).count() == 0


@pytest.mark.parametrize("items", [20_000, 300])
def test_packing_against_one_best_fit(spark, items, monkeypatch):
    """Local packing and merging over many partitions takes hardly more bins than best-fit decreasing over all pieces at once."""
    monkeypatch.setattr(packing, "TASK_ITEMS", items)
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(rng.choice([int(x) for x in rng.integers(1, 130, 400)], 6000))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(24)
    rows = packing.packed(df, capacity=64).collect()
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    bins = len({r.sequence_id for r in rows})
    _, whole = packing.best_fit(np.array([r.length for r in rows]), 64)
    assert bins <= 1.01 * len(whole) + 2


def test_best_fit():
    where, fill = packing.best_fit(np.array([6, 5, 4, 3, 2, 10, 1]), 10)
    assert sorted(fill) == [1, 10, 10, 10] or len(fill) == 4
    assert fill.sum() == 31 and (np.bincount(where, [6, 5, 4, 3, 2, 10, 1]) == fill).all()
