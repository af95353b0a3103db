"""Supervised subword embeddings for text quality.

A document is the mean of the learned vectors of its words, their character n-grams and a mark for
each word that repeats the one before; a softmax layer over the mean gives the score. Words and
n-grams share hashed rows. Vectors and layer are trained together by stochastic gradient descent in
numpy, on a bounded sample of labelled documents whose feature counts executors prepare.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import carried, map_arrow, schema_of, slices
from tessera.llm.labels import part_of, training_rows

ROWS, DIM = 1 << 15, 8
GRAMS = (3, 4)
REPEAT = 0
#: Documents of each label that a model learns from, at most.
PER_CLASS = 1000
#: Words that a worker keeps.
CACHE = 400_000


def features(word: str) -> list[int]:
    """Rows of a word and of its character n-grams; row 0 is the repeat mark's."""
    crc, wide = zlib.crc32, f"<{word}>"
    names = [word] + [wide[i : i + n] for n in GRAMS for i in range(len(wide) - n + 1)]
    return [1 + crc(x.encode("utf-8", "surrogatepass")) % (ROWS - 1) for x in names]


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of all texts, the words one after the other as places among these, and where each text's begin. An empty text has one empty word."""
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
    coded = pc.dictionary_encode(lists.values)
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)


def repeats(at: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Words of each text that repeat the one before."""
    same = np.concatenate([[0], np.cumsum(np.concatenate([[False], at[1:] == at[:-1]]) if len(at) else np.zeros(0, bool))])
    first = np.zeros(len(begin) - 1, np.int64)
    inner = begin[:-1][begin[:-1] < len(at)]
    first[: len(inner)] = same[inner + 1] - same[inner]  # a text's first word follows another text's
    return same[begin[1:]] - same[begin[:-1]] - first


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, features, counts) of training texts."""
    for b in slices(batches):
        out = []
        words, places, begin = words_of(b.column(1))
        own = [features(w) if w else [] for w in words]
        for i, j, same in zip(begin.tolist(), begin[1:].tolist(), repeats(places, begin).tolist(), strict=False):
            rows = [f for p in places[i:j].tolist() for f in own[p]] + [REPEAT] * same
            at, n = np.unique(np.array(rows, np.int64), return_counts=True)
            out.append((at.astype(np.uint16).tobytes(), (n / max(1, n.sum())).astype(np.float32).tobytes()))
        yield pa.record_batch([b.column(0), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["y", "at", "share"])


@dataclass
class Model:
    """``weight[f]``: what feature f adds to the logit of label 1, its vector times the layer."""

    weight: np.ndarray
    bias: float


def train(y: np.ndarray, at: list[np.ndarray], share: list[np.ndarray], prior: float, epochs: int = 8, rate: float = 0.5, batch: int = 64, seed: int = 7) -> Model:
    """Vectors and softmax layer by gradient steps over shuffled batches, each parameter's step scaled by its past gradients.

    Examples are weighted to the labels' ``prior``. With one label only, the model is that prior.
    """
    prior = min(max(prior, 0.01), 0.99)
    logit = float(np.log(prior / (1 - prior)))
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(ROWS, np.float32), logit)
    rng = np.random.default_rng(seed)
    vectors = (rng.standard_normal((ROWS, DIM)) * 0.05).astype(np.float32)
    layer = (rng.standard_normal((DIM, 2)) * 0.5).astype(np.float32)
    bias = np.array([0, logit], np.float32)
    past_v, past_l = np.full((ROWS, DIM), 1e-8, np.float32), np.full((DIM, 2), 1e-8, np.float32)
    weight = np.where(y == 1, prior / max(1e-9, (y == 1).mean()), (1 - prior) / max(1e-9, (y == 0).mean())).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            own = [i for i in order[k : k + batch] if len(at[i])]
            if not own:
                continue
            rows, part = np.concatenate([at[i] for i in own]).astype(np.int64), np.concatenate([share[i] for i in own])
            size = np.array([len(at[i]) for i in own])
            mean = np.add.reduceat(vectors[rows] * part[:, None], np.cumsum(size) - size, axis=0)
            z = mean @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - np.eye(2, dtype=np.float32)[y[own]]) * weight[own][:, None] / len(own)
            to_mean = d @ layer.T
            spread = np.repeat(to_mean, size, axis=0) * part[:, None]
            grad = np.stack([np.bincount(rows, spread[:, c], ROWS) for c in range(DIM)], 1).astype(np.float32)
            to_layer = mean.T @ d
            past_v += grad * grad
            past_l += to_layer * to_layer
            vectors -= rate * grad / np.sqrt(past_v)
            layer -= rate * 0.2 * to_layer / np.sqrt(past_l)
            bias -= 0.1 * d.sum(0)
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(labels: DataFrame, docs: DataFrame, label: str = "quality", parts: int = 4, held_out: int = 2, per_class: int = PER_CLASS) -> Model:
    """Learn from labelled documents outside the held-out part, at most ``per_class`` of each label."""
    rows, prior = training_rows(labels, docs, label, parts, held_out, per_class)
    got = map_arrow(rows, _counts, "y int, at binary, share binary").toArrow().to_pylist()  # bounded by per_class
    got.sort(key=lambda r: (r["y"], r["at"], r["share"]))  # the same model whatever order executors answer in
    y = np.array([r["y"] for r in got], np.int64)
    return train(y, [np.frombuffer(r["at"], np.uint16) for r in got], [np.frombuffer(r["share"], np.float32) for r in got], prior if len(got) else 0.5)


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = model.weight.astype(np.float64).tolist()
        known: dict[str, tuple[float, int]] = {"": (0.0, 0)}
        for b in slices(batches, 2048, 16 << 20):
            if len(known) > CACHE:
                known = {"": (0.0, 0)}
            words, at, begin = words_of(b.column(0))
            found = list(map(known.get, words))
            for i, x in enumerate(found):
                if x is None:
                    rows = features(words[i])
                    found[i] = known[words[i]] = sum(map(weight.__getitem__, rows)), len(rows)
            value, count = np.array(found, np.float64).reshape(-1, 2)[at].T
            value, count = (np.concatenate([[0.0], np.cumsum(x)]) for x in (value, count))
            same = repeats(at, begin)
            n = count[begin[1:]] - count[begin[:-1]] + same
            z = np.where(n > 0, (value[begin[1:]] - value[begin[:-1]] + same * weight[REPEAT]) / np.maximum(n, 1), 0.0)
            out = 1 / (1 + np.exp(-np.clip(z + model.bias, -30, 30)))
            yield pa.record_batch([*b.columns[1:], pa.array(out, pa.float64())], [*b.schema.names[1:], "score"])

    return run


def scored(docs: DataFrame, model: Model, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), new: str = "score") -> DataFrame:
    """``(*carry, score)``: probability of label 1 of each whole text, one row for each input row.

    Null and empty texts, having no features, get the model's prior; repeated rows come back repeated;
    an empty table gives no rows. Nothing but the text and the carried columns, of any names, is read;
    ``new`` renames the score.
    """
    picks, schema, back = carried(docs, carry)
    rows = map_arrow(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), *picks), _scores(model), schema_of(schema, "score double"))
    return rows.select(*back, F.col("score").alias(new))


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document; a null id is not held out.

    Without labels of both kinds every score is the labels' share of ones, or a half without any. Whole
    texts are scored, however long; null texts as empty ones; repeated rows come back repeated; other
    columns, whatever their names, are not read; an empty table gives no rows.
    """
    rows = scored(docs, fit(labels, docs, label, parts, held_out))
    return rows.select("doc_id", (F.coalesce(part_of("doc_id", parts), F.lit(-1)) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
