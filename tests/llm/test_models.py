import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontam, quality, queries, toxicity
from tessera.llm.common import stored

SF = "/root/testdata/sf0.01"


def auc(y, score):
    rank = pd.Series(score).rank().to_numpy()
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / n1 / n0


@pytest.mark.parametrize("name,label,least", [("op10_quality", "quality", 0.98), ("op4_toxicity", "toxic", 0.85)])
def test_held_out(spark, name, label, least):
    rows = queries.QUERIES[name](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(rows) == 1000 and rows.score.between(0, 1).all() and ((rows.score >= 0.7) == (rows.predicted == 1)).all()
    own = rows.merge(labels, on="doc_id")
    own = own[own.held_out]
    assert auc(own[label].to_numpy(), own.score.to_numpy()) >= least
    parts, held = (4, 2) if label == "quality" else (3, 1)
    assert (rows.held_out == rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % parts == held)).all()


@pytest.mark.parametrize("run,label", [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_scoring_edges(spark, run, label):
    docs = spark.createDataFrame([(i, f"fine words number {i}" if i % 2 else "bad trash bad trash", 0.5) for i in range(40)] + [(50, None, 1.0), (51, "", 1.0), (None, "x", 1.0), (1, "again", 1.0), (52, "w " * 50000, 1.0)], "doc_id long, text string, score double")
    good = 1 if label == "quality" else 0
    labels = spark.createDataFrame([(i, good if i % 2 else 1 - good) for i in range(40)] + [(None, 1), (3, None), (3, 7), (999, 1)], f"doc_id long, {label} int")
    got = run(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert run(docs, labels.limit(0)).count() == docs.count() and run(docs.limit(0), labels).count() == 0
    assert run(docs, labels.where(f"{label} = 1")).count() == docs.count()


def test_folding():
    assert toxicity.fold("L0ser, ιdіot! n!ce $tupïd").split() == ["loser", "idiot", "nice", "stupid"]
    lex = toxicity.Lexicon({" kill": 2.0, " kill ": 3.0}, (" kill switch ",))
    assert list(lex.hits(toxicity.fold("kill it, killer; a kill switch")).values()) == [3.0, 2.0]
    for text in ("“idiot”", "ｉｄｉｏｔ", "id́iot", "1d1ot", "i\u00addiot"):
        assert toxicity.fold(text).split() == ["idiot"], text
    both = toxicity.Lexicon({" loser ": 2.0, " kill ": 1.0})
    assert [both.measures(t)[2] for t in ("1oser", "a k1ll", "ki1l", "k!ll", "kill! 1", "10")] == [1, 1, 1, 1, 1, 0]


def slow_measures(lexicon, text):
    """Every pattern at every place, by loops."""
    out = {}
    for folded in toxicity.folds(text):
        free = [(i, i + len(x) - 1) for x in lexicon.exceptions for i in range(len(folded)) if folded.startswith(x, i)]
        for i in range(len(folded)):
            w = max((w for t, w in lexicon.terms.items() if folded.startswith(t, i)), default=0.0)
            if w > 0 and not any(a <= i < b for a, b in free):
                out[i] = max(w, out.get(i, 0.0))
    return np.log1p(sum(out.values())), 100 * sum(out.values()) / (toxicity.fold(text).count(" ") + 50), len(out)


def test_measures_equal_brute_force():
    rng = random.Random(6)
    words = ["kill", "killer", "k1ll", "switch", "dumb", "dumbo", "so", "a", "ｄumb", "dúmb", "f!ne", "fine!"]
    lex = toxicity.Lexicon({" kill": 2.0, " kill ": 3.0, " dumb": 1.5, " dumbo ": 4.0, " so ": 0.5}, (" kill switch ", " so dumb ", " a so "))
    for _ in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", ", ", "-"]) for _ in range(rng.randint(0, 40)))
        assert np.allclose(lex.measures(text), slow_measures(lex, text))


def test_exceptions_take_linear_time():
    import time

    lex = toxicity.Lexicon({" kill": 2.0}, (" kill switch ",))
    text = toxicity.fold("kill switch kill it " * 50_000)
    began = time.time()
    assert len(lex.hits(text)) == 50_000 and time.time() - began < 5


def test_scores_equal_brute_force(spark):
    """The mean of the vectors of words, character n-grams and repeat marks, and softmax over it, by loops."""
    rng = np.random.default_rng(2)
    vectors, layer, bias = rng.standard_normal((quality.ROWS, quality.DIM)), rng.standard_normal((quality.DIM, 2)), rng.standard_normal(2)
    model = quality.Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))
    texts = ["one two two three", "", None, "é 😀 a", "same " * 5000, "x"]
    got = {r.doc_id: r.score for r in quality.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        words = (t or "").split()
        rows = [f for w in words for f in quality.features(w)] + [quality.REPEAT for a, b in zip(words, words[1:], strict=False) if a == b]
        z = (np.mean([vectors[f] for f in rows], axis=0) if rows else np.zeros(quality.DIM)) @ layer + bias
        p = np.exp(z - z.max())
        assert abs(got[i] - p[1] / p.sum()) < 1e-4
    assert quality.features("ab") == [1 + zlib.crc32(x.encode()) % (quality.ROWS - 1) for x in ("ab", "<ab", "ab>", "<ab>")]


def test_repeated_ids_are_learned_once(spark):
    from tessera.llm.labels import training_rows

    docs = spark.createDataFrame([(i % 7, f"t{i % 14}") for i in range(700)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 7, i % 2) for i in range(70)], "doc_id long, quality int")
    rows, _ = training_rows(labels, docs, "quality", 4, 2, 3)
    assert rows.count() <= 6


#: Names that stages use inside, or have used.
CLASHES = ["score", "__text", "rid", "bytes", "kept", "n_words", "n_removed", "hash", "a.b", "tessera_id", "tessera_hash", "tessera_key", "carried_0", "text_", "hits"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_with_clashing_columns(spark, name, stage):
    """Columns of any name come through, with nulls, repeated rows, one id of different texts and a long text."""
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(None, None, None, None, None), (None, "x", "en", "x", 1), (10**6, "", "en", "x", 0), (10**6 + 1, "word " * 30_000, "en", "x", 150_000), (10**6 + 2, "one text of an id", "en", "x", 17), (10**6 + 2, "other words under it", "en", "x", 20)]
    docs = source.unionByName(spark.createDataFrame(odd, source.schema)).unionByName(source.limit(5))
    for k, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.lit(k))
    docs = stored(docs, "docs")
    out = stage(spark, docs, "/root/testdata/sf0.001")
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
        rows = out.collect()
        assert 0 < len(rows) <= docs.count() and all(r[c] == k for r in rows for k, c in enumerate(CLASHES))
        if name == "SimHash near-dedup":
            assert sum(r.doc_id == 10**6 + 2 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 2
    else:
        assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def test_no_peeking(spark):
    """Held-out labels change nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(labels, docs), quality.fit(other, docs)
    assert (a.weight == b.weight).all() and a.bias == b.bias


def normal(word):
    return word.lower().strip(decontam.BLANKS)


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert decontam.common_subsequence(a, b) == slow_lcs(a, b)


def weighted_passages(texts, vocabulary, idf):
    """TF-IDF rows of length one of all 64-word passages, by loops."""
    rows = []
    for t in texts:
        words = [vocabulary.get(normal(w), 0) for w in t.split()]
        for at in range(0, len(words), decontam.PASSAGE):
            row = np.zeros(len(idf))
            for w in words[at : at + decontam.PASSAGE]:
                row[w] += 1
            row = np.where(row > 0, 1 + np.log(np.maximum(row, 1)), 0) * idf
            rows.append(row / max(1e-30, np.linalg.norm(row)))
    return np.array(rows)


def test_latent_space(spark, monkeypatch):
    """The space from sums over partitions has numpy's leading singular vectors, whatever the tree of sums."""
    monkeypatch.setattr(decontam, "FAN_IN", 2)
    rng = random.Random(3)
    topics = [[f"{chr(97 + k)}w{i}" for i in range(12)] for k in range(5)]
    texts = [" ".join(rng.choice(topics[rng.randrange(5) if rng.random() < 0.1 else n % 5]) for _ in range(150)) for n in range(80)]
    items = decontam.items_of([(k, " ".join(t), None) for k, t in enumerate(topics)])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    ids = stored(decontam.map_arrow(docs, decontam._numbered(items.vocabulary), "doc_id long, ids binary"), "numbered")
    idf = decontam.weights(ids, items)
    assert (idf[1:] > 0).all()
    space = decontam.latent_space(ids, idf, rank=5)
    _, _, right = np.linalg.svd(weighted_passages(texts, items.vocabulary, idf), full_matrices=False)
    assert np.allclose(np.linalg.svd(space.T @ right[:5].T)[1], 1, atol=1e-3)  # the same subspace
    assert np.allclose(space.T @ space, np.eye(5), atol=1e-8)


def test_candidates_are_all_near_passages(spark):
    """No passage that an exhaustive search puts at the least cosine is missed, and every leak by brute force comes out."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    bench = [(k, " ".join(rng.choice(words[:900]) for _ in range(rng.randint(8, 60))), None) for k in range(40)]
    texts = []
    for n in range(150):
        t = [rng.choice(words) for _ in range(rng.randint(0, 300))]
        if n < 80:
            own = [w if rng.random() < 0.7 else rng.choice(words) for w in bench[n % 40][1].split()]
            at = rng.randint(0, len(t))
            t[at:at] = own
        texts.append(" ".join(t))
    items = decontam.items_of(bench)
    docs = [decontam.numbers(pa.array([t]), pa.array(list(items.vocabulary)))[0].astype(np.int64)[: len(t)] for t in texts]
    assert all([items.vocabulary.get(normal(w), 0) for w in t.split()] == d.tolist() for t, d in zip(texts, docs, strict=True))
    ids, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=len(items.vocabulary) + 1)
    idf = np.log(200 / (1 + df)) * (np.arange(len(df)) > 0)
    space = np.linalg.qr(np.random.default_rng(1).standard_normal((len(idf), 8)))[0]
    matcher = decontam._Matcher(items, idf, space)
    got = {(int(d), int(s), int(i)) for d, s, i, _ in (x for c in matcher.candidates(decontam.Passages(ids, sizes, 0, idf > 0)) for x in zip(*c, strict=True))}
    rows, place = weighted_passages(texts, items.vocabulary, idf), [(d, s) for d, n in enumerate(sizes) for s in range(0, n, decontam.PASSAGE)]
    wide = np.zeros((len(bench), len(idf)))
    for k, w in enumerate(items.words):
        for x in set(w):
            wide[k, x] = (1 + np.log(w.count(x))) * idf[x]
    wide /= np.linalg.norm(wide, axis=1, keepdims=True)
    a, b = rows @ space, wide @ space
    latent = (a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-30)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    near = np.maximum(latent, rows @ wide.T)
    assert {(*place[p], k) for p, k in zip(*np.nonzero(near >= decontam.COSINE + 1e-4), strict=True)} <= got
    assert got <= {(*place[p], k) for p, k in zip(*np.nonzero(near >= decontam.COSINE - 1e-4), strict=True)}
    found = set(matcher.leaks(ids, sizes))
    slow = {(d, k) for d, t in enumerate(docs) for k, w in enumerate(items.words) if slow_lcs(w, t.tolist()) >= 0.75 * len(w)}
    near_leaks = {(n, n % 40) for n in range(80)} & {(d, k) for d, t in enumerate(docs) for k, w in enumerate(items.words) if slow_lcs(w, t.tolist()) >= 0.62 * len(w)}
    assert slow & near_leaks and len(near_leaks & found) >= 0.98 * len(near_leaks)


@pytest.mark.parametrize("at_once", [1, 50, 1 << 17])
def test_bound_on_common_subsequences(monkeypatch, at_once):
    """Only surroundings with enough of the item's words, each as often as the item has it at most, are compared; none with such a subsequence is missed."""
    monkeypatch.setattr(decontam, "WORDS_AT_ONCE", at_once)
    rng = random.Random(5)
    names = [f"w{i}" for i in range(30)]
    bench = [(k, " ".join(rng.choice(names) for _ in range(rng.randint(1, 25))), None) for k in range(20)] + [(20, "often " * 450, None)]
    items = decontam.items_of(bench)
    matcher = decontam._Matcher(items, np.ones(len(items.vocabulary) + 1), np.zeros((len(items.vocabulary) + 1, 1)))
    ids = np.array([rng.choice([0, *items.vocabulary.values()]) for _ in range(600)] + [items.vocabulary["often"]] * 280 + [items.words[0][0]] * 40)
    lo = np.array([rng.randrange(len(ids)) for _ in range(800)] + [600, 600, 880])
    hi = np.array([min(len(ids), i + rng.randint(0, 60)) for i in lo[:800]] + [880, 860, 920])
    item = np.array([rng.randrange(20) for _ in range(800)] + [20, 20, 0])
    got = matcher.likely(ids, lo, hi, item)
    words, texts = [items.words[k] for k in item], [ids[i:j].tolist() for i, j in zip(lo, hi, strict=True)]
    shared = [sum((Counter(w) & Counter(t)).values()) / len(w) for w, t in zip(words, texts, strict=True)]
    assert got.tolist() == [x >= decontam.COMMON for x in shared] and got.any() and not got[-1]
    assert got[-3] and not got[-2]  # 280 and 260 words of 450
    assert all(g for g, w, t in zip(got, words, texts, strict=True) if slow_lcs(w, t) >= decontam.COMMON * len(w))


def test_long_items(spark):
    """More distinct words than 16 bits hold, in one item, and items of signs alone."""
    long = " ".join(f"w{i}" for i in range(100_000))
    bench = spark.createDataFrame([(1, long), (2, "..."), (3, None), (None, "w1 w2 w3"), (4, "one two three four five"), (4, "one two three four five")], "item_id long, text string")
    docs = spark.createDataFrame([(7, "first " + long + " last"), (8, "zero one two three four five six"), (8, "zero one two three four five six"), (9, None)], "doc_id long, text string")
    got = [(r.doc_id, r.item_id, r.common) for r in decontam.leaks(docs, bench).collect()]
    assert sorted(got) == [(7, 1, 1.0)] + [(8, 4, 1.0)] * 4


def test_leaks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: " ".join(map(normal, r.text.split())) for r in bench.collect()}
    texts = {r.doc_id: " " + " ".join(map(normal, r.text.split())) + " " for r in docs.collect()}
    truth = {(d, i) for d, t in texts.items() for i, x in items.items() if f" {x} " in t}
    rng, near = random.Random(1), []
    for k, text in items.items():
        words = [w for w in text.split() if rng.random() > 0.1]
        words[:-5] = ["novel" if rng.random() < 0.1 else w for w in words[:-5]]
        near.append((10**6 + k, "a start of its own " * 9 + " ".join(words) + " and an end" * 9, "x"))
    odd = [(None, None, "x"), (-1, "", "x"), (-2, "word " * 20000, "x")]
    more = spark.createDataFrame(near + odd, "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs.select("doc_id", "text", F.lit("x").alias("item_id")).unionByName(more), bench).collect()}
    assert {p for p in got if p[0] < 10**6} == truth
    assert len({p for p in got if p[0] >= 10**6 and p[0] - 10**6 == p[1]}) >= 0.9 * len(items)
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.leaks(docs.limit(0), bench).count() == 0


def test_cosines_by_term():
    rng = np.random.default_rng(4)
    a, b = (rng.random((n, 50)) * (rng.random((n, 50)) < 0.2) for n in (40, 30))
    a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30) for x in (a, b))
    (row, term), (item, of) = np.nonzero(a), np.nonzero(b)
    got = decontam._ByTerm(item, of, 3 * b[item, of], 50, 30).cosines(np.searchsorted(row, np.arange(41)), term, a[row, term])
    assert np.allclose(got, a @ b.T, atol=1e-6)


def test_leaks_outside_the_latent_space(spark, monkeypatch):
    """A leak is a candidate by its words even if nothing of it is in the latent space."""
    monkeypatch.setattr(decontam, "latent_space", lambda ids, idf: np.zeros((len(idf), 1)))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = bench.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("some other start " * 9), "text", F.lit(" and an end" * 9)).alias("text"))
    docs = docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 10**6, "text").toDF("doc_id", "text"))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert {(r.item_id, r.item_id) for r in bench.collect()} <= got


@pytest.mark.parametrize("kind", ["cut 3", "cut 5", "reworded 5"])
def test_leaks_without_their_end(spark, kind):
    """An item whose last words lack or are others is a leak; with an answer column its answer must be there."""
    what, n = kind.split()
    rows = [(r.item_id, r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(k, w) for k, w in rows if len(w) - int(n) >= 0.7 * len(w)]
    end = "" if what == "cut" else " novel" * int(n)
    planted = [(k, "a start of its own " * 9 + " ".join(w[: -int(n)]) + end + " and the last part" * 9) for k, w in rows]
    docs = spark.createDataFrame(planted, "doc_id long, text string").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    bench = spark.createDataFrame([(k, " ".join(w), " ".join(w[-int(n) :])) for k, w in rows], "item_id long, text string, reply string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert len(rows) >= 20 and {(k, k) for k, _ in rows} <= got
    if kind == "reworded 5":
        asked = {r.doc_id for r in decontam.leaks(docs, bench, answer_col="reply").collect() if r.doc_id < 10**6}
        assert len(asked) <= 0.2 * len(rows)


def test_pipeline(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "x", 0)], source.schema)
    docs, seen = source.unionByName(source.limit(5)).unionByName(extra), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SF), "stage")
        seen[name] = docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == source.columns and seen[name] <= before.count()
        if name == "SimHash near-dedup":
            assert docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
            assert docs.groupBy("text").count().where("count > 1 and length(text) > 0").isEmpty()
    assert 0 < seen["benchmark decontamination"] < seen["quality classifier"]
    assert corpus_pipeline.run(spark, SF).count() > 0
