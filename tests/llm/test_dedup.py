import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import phrases, queries, simhash
from tessera.llm.components import connected_components
from tests.conftest import SMALL
from tests.oracle import same_rows


def roots(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def slow_print(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_components(spark):
    rng = random.Random(1)
    for n, m in ((200, 120), (60, 200), (300, 299)):
        links = [(i, i + 1) for i in range(n - 1)] if m == n - 1 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        got = {r.v: r.root for r in connected_components(spark.createDataFrame([(b, a) for a, b in links] + [(0, 0)], "a long, b long")).collect()}
        assert [got.get(i, i) for i in range(n)] == roots(n, links)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("budget,limit", [(2, 4096), (2, 4), (3, 4)])
def test_trie_join_finds_every_link(spark, budget, limit, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_LIMIT", limit)
    rng = np.random.default_rng(budget)
    keys = []
    for base in rng.integers(0, 1 << 63, 30, dtype=np.uint64):
        for _ in range(12):
            k = int(base)
            for bit in rng.integers(0, 64, rng.integers(0, 4)):
                k ^= 1 << int(bit)
            keys.append(k)
    keys = np.unique(np.array(keys, np.uint64))
    df = spark.createDataFrame([(i, int(k)) for i, k in enumerate(keys.view(np.int64))], "id long, key long")
    links = [(r.a, r.b) for r in simhash.trie_links(df, budget).collect()]
    i, j = np.nonzero(np.triu(np.bitwise_count(keys[:, None] ^ keys[None, :]) <= budget, 1))
    assert roots(len(keys), links) == roots(len(keys), zip(i.tolist(), j.tolist(), strict=True))


def check_simhash(docs, got):
    prints = {i: slow_print(t) for i, t in docs}
    ids = sorted(prints)
    links = [(a, b) for a in range(len(ids)) for b in range(a) if (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= 2]
    want = roots(len(ids), links)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", ids[want[k]]) for k, i in enumerate(ids)}


def test_op2(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check_simhash(docs, queries.op2_simhash(spark, SMALL).collect())


def test_simhash_edges(spark):
    docs = [(5, None), (3, ""), (9, " \t"), (1, "A b"), (2, "a B"), (7, "É"), (8, "é"), (10, "x " * 3000)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, print string, head int")
    found = simhash.near_duplicates(df).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
    check_simhash(docs, found.collect())
    twice = simhash.near_duplicates(df.unionByName(df)).collect()
    assert len(twice) == 2 * len(docs)
    null = spark.createDataFrame([(None, "a"), (4, "a"), (None, "other words of its own")], "doc_id long, text string")
    assert sorted((r.id is None, r.component) for r in simhash.near_duplicates(null).collect() if r.component) == [(False, 4), (True, 4)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_similar_documents(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs, same = [], {}
    for k in range(60):
        base = [word() for _ in range(rng.randint(120, 400))]
        docs.append((10 * k, " ".join(base)))
        for c in range(3):
            copy = list(base)
            for at in rng.sample(range(len(copy)), max(1, len(copy) // 150)):
                copy[at] = word()
            docs.append((10 * k + 1 + c, " ".join(copy)))
    rows = simhash.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {r.id: r.component for r in rows}
    assert all(got[i] // 10 == i // 10 for i in got)
    assert sum(got[i] == i // 10 * 10 for i in got) >= 0.98 * len(got)
    assert all(r.kept == (r.id == r.component) for r in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a"), (3, "b"), (None, "a")], "doc_id long, text string")
    assert sorted((r.id, r.component, r.kept) for r in simhash.similar_documents(odd).collect()) == [(1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True), (3, 3, True)]
    assert simhash.similar_documents(odd.limit(0)).count() == 0


def jaccard_components(texts):
    parts = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in texts]
    links = [(i, j) for i, a in enumerate(parts) for j, b in enumerate(parts[:i]) if (a or b) and len(a & b) >= 0.8 * len(a | b) or a == b]
    return roots(len(texts), links)


@pytest.mark.parametrize("limit", [512, 4])
def test_similar_groups_of_any_size(spark, limit, monkeypatch):
    """Groups larger than a task's share give the same components: chains of edits, near copies, and look-alikes that are none."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(4):
        text = [word() for _ in range(120)]
        for _ in range(25):  # each is near the one before
            text = list(text)
            text[rng.randrange(120)] = word()
            texts.append(" ".join(text))
        texts += [" ".join(text[:75] + [word() for _ in range(45)]) for _ in range(12)]  # share a passage, similarity 0.45
    monkeypatch.setattr(simhash, "GROUP", limit)
    got = {r.id: r.component for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == jaccard_components(texts)


def test_group_size_changes_no_link(spark, monkeypatch):
    """With so few bands that many near pairs share none, groups within a task's share and over it have the same links."""
    rng = random.Random(6)
    texts, word = [], lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    for _ in range(3):
        base = [word() for _ in range(150)]
        for _ in range(30):
            text = list(base)
            for at in rng.sample(range(150), 2):
                text[at] = word()
            texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(simhash, "MISSED", 0.6)
    found = []
    for limit in (512, 20, 4):
        monkeypatch.setattr(simhash, "GROUP", limit)
        found.append({r.id: r.component for r in simhash.similar_documents(docs).collect()})
    assert found[0] == found[1] == found[2] and len(set(found[0].values())) >= 3


def test_equal_keys(spark):
    """Many texts with one SimHash are one key of the walk."""
    df = spark.range(50_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("x y "), F.repeat(F.lit("same words again "), 200), F.col("id").cast("string")).alias("text"))
    found = simhash.near_duplicates(df.limit(20_000))
    assert found.select("component").distinct().count() == 1 and found.count() == 20_000


def edited(rng, least, most, word):
    """Pairs of texts by kind of edit, whose five-word shingles have a Jaccard similarity from ``least`` to ``most``."""
    parts = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    out = {}
    while min(map(len, out.values()), default=0) < 60 or len(out) < 4:
        base, share = [word() for _ in range(rng.randint(120, 400))], rng.random() / 2
        n = max(1, int(share * len(base)))
        new, at, kind = [word() for _ in range(n)], rng.randint(0, len(base) - n), rng.choice(["append", "delete", "replace", "scatter"])
        copy = {"append": base + new, "delete": base[:at] + base[at + n :], "replace": base[:at] + new + base[at + n :]}.get(kind)
        if copy is None:
            gone = set(rng.sample(range(len(base)), max(1, n // 8)))
            copy = [word() if i in gone else w for i, w in enumerate(base)]
        a, b = parts(base), parts(copy)
        if least <= len(a & b) / len(a | b) <= most and len(out.setdefault(kind, [])) < 60:
            out[kind].append((" ".join(base), " ".join(copy)))
    return out


@pytest.mark.parametrize("least,most", [(0.8, 0.88), (0.65, 0.795)])
def test_similar_documents_by_edit(spark, least, most):
    """Pairs just at the similarity are linked whatever the edit, and pairs just below are not."""
    rng = random.Random(7)
    pairs = edited(rng, least, most, lambda: "".join(rng.choice("abcdefgh") for _ in range(5)))
    flat = [(kind, p) for kind, own in pairs.items() for p in own]
    docs = [(2 * k + c, text) for k, (_, p) in enumerate(flat) for c, text in enumerate(p)]
    got = {r.id: r.component for r in simhash.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    linked = Counter(kind for k, (kind, _) in enumerate(flat) if got[2 * k + 1] == 2 * k)
    if least >= 0.8:
        assert all(linked[kind] >= 0.98 * len(own) for kind, own in pairs.items()), linked
    else:
        assert not linked


def test_confirmed():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(8):
        base = np.unique(rng.integers(0, 1 << 32, 200, dtype=np.uint32))
        sets += [np.unique(rng.choice(base, rng.integers(150, len(base)), replace=False)) for _ in range(8)]
    sets.append(np.zeros(0, np.uint32))
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))]
    assert simhash.confirmed(sets, 0.8).tolist() == roots(len(sets), near)
    some = [(i, j) for i, j in near if j < 20]
    assert simhash.confirmed(sets, 0.8, 20).tolist() == roots(len(sets), some)
    keys = [[int(k) for k in rng.integers(0, 12, 3)] if i % 9 else [] for i in range(len(sets))]
    shared = [(i, j) for i, j in near if set(keys[i]) & set(keys[j])]
    assert len(shared) < len(near) and simhash.confirmed(sets, 0.8, keys=keys).tolist() == roots(len(sets), shared)
    comp = np.arange(len(sets)) // 8 * 8
    assert simhash.confirmed(sets, 0.8, 20, comp).tolist() == roots(len(sets), [*some, *enumerate(comp.tolist())])


def slow_removed(texts, window):
    docs = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(d[i : i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for d in docs:
        gone = [False] * len(d)
        for i in range(len(d) - window + 1):
            if seen[tuple(d[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(d), sum(gone), b" ".join(w for w, g in zip(d, gone, strict=True) if not g).decode()))
    return out


@pytest.mark.parametrize("window", [35, 8, 12])
def test_recurring_passages(spark, window):
    rng = random.Random(window)
    words = [f"w{i}é" if i % 3 else f"x{i}" for i in range(40)]
    base = [[rng.choice(words) for _ in range(rng.randint(30, 200))] for _ in range(12)]
    texts = []
    for _ in range(90):
        t = []
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            i = rng.randint(0, len(b))
            t += b[i : i + rng.randint(1, 90)] if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(1, 60))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(t))
    texts += [None, "", "be " * 400, "a b " * 60, "be " * 34, "be " * 35, *texts[:4], " ".join(texts[0].split())]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, rid int").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in phrases.without_recurring(df, window=window).collect()}
    assert [got[i] for i in range(len(texts))] == slow_removed(texts, window)


def test_recurring_passages_edges(spark):
    df = spark.createDataFrame([(1, "a  b"), (1, "a  b"), (None, None)], "doc_id long, text string")
    assert sorted((r.n_words, r.kept is None, r.kept) for r in phrases.without_recurring(df, original=True).collect() if r.kept) == [(2, False, "a  b")] * 2
    assert phrases.without_recurring(df.limit(0)).count() == 0
    short = spark.createDataFrame([(i, "few words only " * (i % 9)) for i in range(40)], "doc_id long, text string")  # no block has an anchor
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in phrases.without_recurring(short).collect()) == [(i, 3 * (i % 9), 0) for i in range(40)]


def test_op5(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = slow_removed([r.text for r in rows], 35)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op5_phrases(spark, SMALL).collect()}
    assert got == {r.doc_id: (*w[:2], hashlib.sha256(w[2].encode()).hexdigest()) for r, w in zip(rows, want, strict=True)}


def test_op5_equals_sql(spark):
    assert same_rows(spark, queries.op5_phrases, queries.ORACLES["op5_phrases"], SMALL) == 200


class Held:
    """Rows of a shard, as the store would give them."""

    def __init__(self, rows):
        self.rows = rows

    def of(self, block):
        return self.rows


def test_automata_alone_locate(monkeypatch):
    """Automata, however many a shard has, find each place of each phrase, and without them nothing goes."""
    monkeypatch.setattr(phrases, "MACHINE", 3)
    rng = random.Random(3)
    words = [b"w%d" % i for i in range(4)] + ["é".encode(), b"\xff"]
    docs = [[rng.choice(words) for _ in range(n)] for n in (0, 12, 34, 35, 500, 700)]
    wanted = [docs[4][i : i + 8] for i in (0, 17, 100, 492)] + [docs[5][i : i + 8] for i in (5, 692)] + [docs[4][:8]]
    rows = pa.table({"phrase": pa.array([b" ".join(p) for p in wanted], pa.binary()), "v": pa.array([1] * len(wanted), pa.int64())})
    shard = phrases._Shard(Held(rows), Held(None), 0, 35)
    assert len(shard.machines) == 3
    got = {(d, int(p)) for d, (at, which) in shard.located(docs).items() for p, k in zip(at, which, strict=True) if docs[d][p : p + 8] == wanted[k]}
    every = [(d, int(p)) for d, (at, _) in shard.located(docs).items() for p in at]
    assert got == set(every) == {(d, i) for d, own in enumerate(docs) if len(own) >= 35 for i in range(len(own) - 7) if own[i : i + 8] in wanted}
    words = phrases.Words(docs, 35)
    lo, hi = words.context(np.array([words.begin[4] + 100]))
    rows = rows.set_column(1, "v", pa.array(np.full(len(wanted), words.run(lo, hi)[0]).view(np.int64)))
    shard = phrases._Shard(Held(rows), Held(None), 0, 35)
    assert {d: x.sum() for d, x in shard.dropped(docs).items()} == {4: int(hi[0] - lo[0])}
    shard.machines = []
    assert shard.dropped(docs) == {}
