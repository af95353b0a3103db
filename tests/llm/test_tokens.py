"""Token counts and alignment against the tokenizers' libraries on whole texts."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import alignment, chunks, queries, token_counts
from tests.conftest import SMALL

PLACES = {n: public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model")}
ODD = [None, "", " ", "  ", "\n", " \n\t x", "<|endoftext|> <s> </s><0x0A>", "a<|startoftext|><|endoftext|>b", "it's IT'S 'S .'s", "é É ̸= ≠", "a   b　 c\x85\x1c d", "x" * 5000, "don't stop. now!stop,it", "▁x"]


def wild(n, letters, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


TEXTS = ODD + wild(800, "ab é漢　 \n\t\r .,'|<>\x00\x0b😀ﬁ́sS1 \u0085\x1c▁") + wild(800, "ab \n \t'.s!")


def library(name):
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(PLACES[name])
        return lambda x: len(own.encode(x, add_special_tokens=False).ids)
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=PLACES[name])
    return lambda x: len(own.encode(x))


@pytest.mark.parametrize("name", sorted(PLACES))
def test_counts_equal_the_library(spark, name):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs.repartition(3), name).collect()}
    count = library(name)
    for r in docs.collect():
        assert got[r.doc_id] == (len((r.text or "").encode()), count(r.text or "")), repr(r.text)


def test_count_query(spark):
    rows = queries.QUERIES["op11_token_counts"](spark, SMALL).collect()
    count = library("word_bpe_49k.json")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(texts) and all(r.n_tokens == count(texts[r.doc_id]) and r.over_limit == (r.n_tokens > 2048) for r in rows)


def slow_aligned(texts):
    """Every pair of tokens by loops over whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(PLACES["byte_bpe_50k.json"]), sentencepiece.SentencePieceProcessor(model_file=PLACES["piece_bpe_32k.model"])
    first.encode_special_tokens = True
    letter = alignment._byte_letters()
    docs = []
    for text in texts:
        docs.append(None)
        if not text:
            continue
        a, b = first.encode(" " + text, add_special_tokens=False), second.encode(text)
        a_bytes = [bytes(letter[c] for c in t) for t in a.tokens]
        b_bytes = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            continue
        a_end, b_end = (np.cumsum([len(x) for x in y]).tolist() for y in (a_bytes, b_bytes))
        pairs, low = [], 0
        for i, e, x in zip(a.ids, a_end, a_bytes, strict=True):
            while b_end[low] <= e - len(x):
                low += 1
            k = low
            while k < len(b) and b_end[k] - len(b_bytes[k]) < e:
                pairs.append((i, b[k]))
                k += 1
        groups, at = [], 0
        for e in sorted(set(a_end) & set(b_end)):
            groups.append("|".join(",".join(str(i) for i, x in zip(ids, ends, strict=True) if at < x <= e) for ids, ends in ((a.ids, a_end), (b, b_end))))
            at = e
        docs[-1] = (len(a.ids), len(b), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest())
    held = collections.Counter(p for d in docs if d for p in set(d[3]))
    most = collections.Counter()
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return [(*d[:3], len(d[3]), sum(held[p] == most[p[0]] for p in d[3]), sum(held[p] for p in d[3]), d[4]) if d else (0, 0, 0, 0, 0, 0, "") for d in docs]


def test_alignment_equals_loops(spark):
    texts = TEXTS + [r.text[:3000] for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in alignment.aligned(docs).collect()}
    assert [got[i] for i in range(len(texts))] == slow_aligned(texts)


def test_alignment_query_reads_all(spark):
    rows = queries.QUERIES["op12_alignment"](spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count() and all(r.n_links >= max(r.n_a, r.n_b) >= r.n_groups > 0 for r in rows)


@pytest.mark.parametrize("run", [token_counts.token_counts, alignment.aligned])
def test_token_edges(spark, run, monkeypatch):
    """Null ids, repeated rows, clashing names, an empty table."""
    docs = spark.createDataFrame([(1, "same words", "x"), (1, "same words", "x"), (None, "same words", None), (2, None, ""), (3, "", "")], "doc_id long, text string, block string")
    docs = docs.withColumn("n_tokens", F.lit(-1)).withColumn("pids", F.lit("p"))
    rows = run(docs).collect()
    assert len(rows) == 5 and run(docs.limit(0)).count() == 0
    same = [tuple(r[1:]) for r in rows if r.doc_id in (None, 1)]
    assert len(set(same)) == 1 and len(same) == 3
    assert all(set(r[1:]) <= {0, ""} for r in rows if r.doc_id in (2, 3))


def test_long_texts_come_in_portions():
    text = " ".join(f"word{i}" for i in range(5000)) + "  \n end" + "y" * 3000 + " z"
    texts = pa.array(["short one", text, "", "last"])
    got = [(rows.tolist(), x.to_pylist()) for rows, x in chunks.portions(texts, size=2000)]
    assert [r for r, _ in got].count([1]) > 10 and max(len(x) for r, y in got if r == [1] for x in y) < 5100
    back = collections.defaultdict(str)
    for rows, x in got:
        for r, y in zip(rows, x, strict=True):
            back[r] += y
    assert [back[i] for i in range(4)] == texts.to_pylist()
    whole, _ = chunks.cut(pa.array([text]))
    assert whole.to_pylist() == [c for r, y in got if r == [1] for x in y for c in chunks.cut(pa.array([x]))[0].to_pylist()]


def test_long_text_in_portions_counts_as_whole(spark, monkeypatch):
    text = "Some words, and more's of them\n\n again   é. " * 400
    parts = [x for _, y in chunks.portions(pa.array([" " + text]), size=500) for x in y.to_pylist()]
    both = alignment.pair(PLACES["byte_bpe_50k.json"], PLACES["piece_bpe_32k.model"])
    ids = [np.concatenate(x) for x in zip(*(both.ids(p) for p in parts), strict=True)]
    assert len(parts) > 20 and [x.tolist() for x in both.ids(" " + text)] == [x.tolist() for x in ids]
