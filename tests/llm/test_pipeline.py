"""Each stage of the pipeline, on what the one before kept, against a brute-force version of it."""

import numpy as np

import corpus_pipeline
from tessera.llm import decontam, quality
from tessera.llm.common import stored
from tests.conftest import SMALL
from tests.llm.test_dedup import jaccard_components, slow_removed
from tests.llm.test_files import check_packed
from tests.llm.test_models import normal, slow_lcs


def slow_score(model, text):
    words = text.split()
    rows = [f for w in words for f in quality.features(w)] + [quality.REPEAT for a, b in zip(words, words[1:], strict=False) if a == b]
    z = np.mean(model.weight.astype(np.float64)[rows]) if rows else 0.0
    return 1 / (1 + np.exp(-(z + model.bias)))


def slow_leaks(text, items):
    """Whether some 64-word passage, with its surroundings, has 60 % of an item's words in order."""
    words = [normal(w) for w in text.split()]
    for item in items:
        side = max(decontam.PASSAGE // 2, len(item))
        for at in range(-(decontam.PASSAGE // 2), len(words), decontam.PASSAGE // 2):
            near = words[max(0, at - side) : at + decontam.PASSAGE + side]
            if len(set(item) & set(near)) > 0.2 * len(set(item)) and slow_lcs(item, near) >= 0.6 * len(item):
                return True
    return False


def test_stages_equal_brute_force(spark):
    docs = stored(spark.read.parquet(f"{SMALL}/documents.parquet"), "docs")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages)
    rows = {r.doc_id: r.text for r in docs.collect()}

    def ran(name, docs):
        out = stored(stages[name](spark, docs, SMALL), "stage")
        return out, {r.doc_id: r.text for r in out.collect()} if "text" in out.columns else None

    model = quality.fit(spark.read.parquet(f"{SMALL}/labels.parquet"), docs)
    docs, got = ran("quality classifier", docs)
    score = {i: slow_score(model, t) for i, t in rows.items()}
    assert got == {i: t for i, t in rows.items() if i in got} and {i for i in rows if abs(score[i] - 0.5) > 1e-6 and score[i] > 0.5} == {i for i in got if abs(score[i] - 0.5) > 1e-6}

    rows = got
    docs, got = ran("SimHash near-dedup", docs)
    ids = sorted(rows)
    root = jaccard_components([rows[i] for i in ids])
    assert got == {i: rows[i] for k, i in enumerate(ids) if root[k] == k} and len(got) < len(rows)

    rows = got
    docs, got = ran("substring dedup", docs)
    ids = sorted(rows)
    left = slow_removed([rows[i] for i in ids], 35)
    assert got == {i: rows[i] if not gone else kept for i, (_, gone, kept) in zip(ids, left, strict=True)}

    rows = got
    docs, got = ran("benchmark decontamination", docs)
    items = [[w for w in map(normal, r.text.split()) if w] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert got == {i: t for i, t in rows.items() if not slow_leaks(t, items)}

    packed = stages["best-fit packing"](spark, docs, SMALL).collect()
    check_packed(list(got.items()), packed, 2048)


def test_stages_with_a_very_long_text_and_any_columns(spark):
    """A text of over 200,000 words, columns of types that have no hash or order, and repeated rows go through every stage."""
    long = " ".join(f"word{i * 7919 % 1_000_003} in" for i in range(110_000))
    rows = [(1, long, {"a": 1}, [1]), (2, "A short text of its own, with a few words.", None, None), (2, "A short text of its own, with a few words.", {"b": 2}, None), (None, None, None, [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>, score array<int>")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, SMALL)
        assert out.dtypes == docs.dtypes
        got = sorted((r.doc_id or 0, len(r.text or "")) for r in out.collect())
        assert got == ([(0, 0), (1, len(long)), (2, 42)] if name.startswith("SimHash") else [(0, 0), (1, len(long)), (2, 42), (2, 42)]), name
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.fit(labels, spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert quality.scored(docs, model, carry=("doc_id",)).count() == 4
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert sum(r.doc_id == 1 for r in packed) > 100 and all(r.length <= 2048 for r in packed)
