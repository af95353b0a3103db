"""Benchmark decontamination by latent semantic retrieval.

Documents become passages, passages TF-IDF vectors over the words of the benchmark, and a randomised
SVD of all of them, run as sums over partitions, a latent space. A passage and an item near each other
by cosine, there or by the TF-IDF vectors themselves, are a candidate, however the words are ordered
or replaced; it counts as a leak if the item's longest common subsequence with the text around the
passage is long enough and, where the benchmark has answers, the item's answer is there too.

The benchmark is the query set: vocabulary, weights and latent space are of all items, and each
passage is held against all items, in blocks. What is broadcast grows with the benchmark and not with
the documents: about half a kilobyte for each of its distinct words.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, slices, stored

#: Words of a passage; latent dimensions, and those beyond them in the random range.
PASSAGE, RANK, EXTRA = 64, 96, 16
#: Bytes of numbered words (four a word) that are worked on at once; passages and items of a matrix of cosines.
PORTION, ROWS_AT_ONCE, ITEMS_AT_ONCE = 512 << 10, 4096, 1024
#: Words of candidates' surroundings that are looked up at once, unless one has more.
WORDS_AT_ONCE = 1 << 17
#: Vocabulary rows in one partial sum; partial sums that are added at once.
ROWS, FAN_IN = 64, 64
#: A word in a larger share of passages tells nothing, unless an item has no others.
MAX_DF = 0.01
#: Least cosine, common subsequence by item length, and share of the answer's words.
COSINE, COMMON, ANSWER, ANSWER_WORDS = 0.3, 0.6, 0.5, 5
#: Slots of the table of (word, item) pairs, as a power of two; a count there that stands for any number.
PAIR_BITS, MANY = 24, 255

BLANKS = string.punctuation + "…“”„«»‘’–—¡¿"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words in lower case without signs around them, of all texts, and where each text's begin. A word of signs alone is empty, and so is an empty text's only one."""
    words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
    return pc.utf8_trim(pc.utf8_lower(words.values), characters=BLANKS), words.offsets.to_numpy()


@dataclass
class Items:
    """The benchmark: ids, words as vocabulary numbers (from 1), answers, and which of these are real."""

    ids: list[int]
    words: list[list[int]]
    answers: list[list[int]]
    answered: list[bool]
    vocabulary: dict[str, int]


def items_of(rows: list) -> Items:
    """``rows`` of (item id, text, answer or None); without an answer the share of the item's last words is told, but none is asked for."""
    vocabulary: dict[str, int] = {}
    number = lambda text: [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(pa.array([text or ""]))[0].to_pylist() if w]
    words = [number(r[1]) for r in rows]
    answers = [number(r[2]) if r[2] else w[-ANSWER_WORDS:] for r, w in zip(rows, words, strict=True)]
    return Items([r[0] for r in rows], words, answers, [bool(r[2]) for r in rows], vocabulary)


def numbers(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32-bit vocabulary numbers from 1, 0 for other words, of all texts, and where each text's begin."""
    words, offsets = words_of(texts)
    at = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy()
    return (at + 1).astype(np.uint32), offsets


def _numbered(vocabulary: dict[str, int]):
    """(doc_id, words as 32-bit vocabulary numbers, 0 for others)."""
    known = list(vocabulary)  # in the order of their numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set = pa.array(known, pa.string())
        for b in slices(batches, 2048):
            ids, offsets = numbers(b.column(1), value_set)
            raw, cuts = ids.tobytes(), (4 * offsets.astype(np.int64)).tolist()
            yield pa.record_batch([b.column(0), pa.array([raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["doc_id", "ids"])

    return run


class Passages:
    """Counts of informative words by passage, of the documents of a batch; passages begin at ``shift`` before a document."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, shift: int, useful: np.ndarray):
        begin = np.cumsum(size) - size
        doc = np.repeat(np.arange(len(size)), size)
        count = (size + shift + PASSAGE - 1) // PASSAGE
        base = np.cumsum(count) - count
        at = np.flatnonzero(useful[ids])
        place = at - begin[doc[at]]
        passage = base[doc[at]] + (place + shift) // PASSAGE
        width = len(useful)
        key, n = np.unique(passage * width + ids[at], return_counts=True)
        self.passage, self.term, self.n = key // width, key % width, n
        self.doc_of = np.repeat(np.arange(len(size)), count)
        self.start_of = (np.arange(len(self.doc_of)) - np.repeat(base, count)) * PASSAGE - shift

    def weighted(self, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct passages, first entry of each, term, weight); the weights of a passage have length one."""
        w = (1 + np.log(self.n)) * idf[self.term]
        own, first = np.unique(self.passage, return_index=True)
        if len(own):
            w = w / np.repeat(np.sqrt(np.maximum(np.add.reduceat(w * w, first), 1e-30)), np.diff(np.append(first, len(w))))
        return own, first, self.term, w


def _parts(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw = b.column(1).to_pylist()
    return np.frombuffer(b"".join(raw), np.uint32).astype(np.int64), np.array([len(r) // 4 for r in raw], np.int64)


def _document_counts(width: int):
    """(term, passages with it), summed over a task; term 0 counts all passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        useful = np.ones(width, bool)
        useful[0] = False
        for b in slices(batches, 1024, PORTION):
            p = Passages(*_parts(b), 0, useful)
            total += np.bincount(p.term, minlength=width)
            total[0] += len(p.doc_of)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["term", "n"])

    return run


def _gram_product(idf: np.ndarray, basis: np.ndarray):
    """A task's share of A'(A basis), A being all weighted passages, in blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, small = np.zeros_like(basis), basis.astype(np.float32)
        for b in slices(batches, 1024, PORTION):
            own, first, term, w = Passages(*_parts(b), 0, idf > 0).weighted(idf)
            if not len(own):
                continue
            w = w.astype(np.float32)
            y = np.add.reduceat(small[term] * w[:, None], first, axis=0)
            back = np.repeat(y, np.diff(np.append(first, len(w))), axis=0) * w[:, None]
            order = np.argsort(term, kind="stable")
            rows, at = np.unique(term[order], return_index=True)
            total[rows] += np.add.reduceat(back[order], at, axis=0)
        from pyspark import TaskContext

        names = np.arange(0, len(total), ROWS)
        task = np.full(len(names), TaskContext.get().partitionId())
        yield pa.record_batch([pa.array(names), pa.array(task), pa.array([total[k : k + ROWS].tobytes() for k in names], pa.binary())], ["part", "task", "sums"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    parts = table.column("sums").to_pylist()
    total = np.frombuffer(parts[0], np.float64).copy()
    for p in parts[1:]:
        total += np.frombuffer(p, np.float64)
    return pa.table({"part": table.column("part")[:1], "task": table.column("task")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def _product(ids: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'(A basis): vocabulary rows by a few dozen columns, whatever the number of documents; tasks' shares are summed up a tree."""
    shares = map_arrow(ids, _gram_product(idf, basis), "part long, task long, sums binary")
    tasks = ids.rdd.getNumPartitions()
    while tasks > FAN_IN:
        shares = shares.select("part", F.expr(f"task div {FAN_IN}").alias("task"), "sums").groupBy("part", "task").applyInArrow(_summed, "part long, task long, sums binary")
        tasks = -(-tasks // FAN_IN)
    got = shares.groupBy("part").applyInArrow(_summed, "part long, task long, sums binary").collect()
    return np.concatenate([np.frombuffer(r.sums, np.float64) for r in sorted(got, key=lambda r: r.part)]).reshape(basis.shape)


def latent_space(ids: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """Right singular vectors of the passages, one row for each word: randomised range, one power step, small eigenproblem."""
    width = min(rank + EXTRA, max(1, int((idf > 0).sum())))
    basis = np.random.default_rng(seed).standard_normal((len(idf), width))
    basis[idf <= 0] = 0
    q, _ = np.linalg.qr(_product(ids, idf, basis))
    small = q.T @ _product(ids, idf, q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(-values)[:rank]
    return q @ vectors[:, top[values[top] > 1e-12 * max(1e-300, values.max())]]


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a column of the table at a time as the bits of an integer."""
    full = (1 << len(a)) - 1
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


class _ByTerm:
    """The items' weighted vectors, each of length one, by term."""

    def __init__(self, item: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int, items: int):
        weight = weight / np.sqrt(np.maximum(np.bincount(item, weight * weight, items), 1e-30))[item]
        order = np.argsort(term, kind="stable")
        self.item, self.weight, self.items = item[order], weight[order], items
        self.start = np.searchsorted(term[order], np.arange(terms + 1))

    def cosines(self, bounds: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """(passages, items) cosines over all words; a passage's entries lie between two ``bounds``."""
        passages = len(bounds) - 1
        row = np.repeat(np.arange(passages), np.diff(bounds))
        out = np.zeros((passages, self.items), np.float32)
        many = self.start[term + 1] - self.start[term]
        upto = np.cumsum(many)
        at = 0
        while at < len(term):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 21), "right")))
            n = many[at:stop]
            entry = np.repeat(self.start[term[at:stop]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            first, last = int(row[at]), int(row[stop - 1]) + 1
            cell = np.repeat(row[at:stop] - first, n) * self.items + self.item[entry]
            out[first:last] += np.bincount(cell, np.repeat(weight[at:stop], n) * self.weight[entry], (last - first) * self.items).reshape(last - first, self.items)
            at = stop
        return out


class _Matcher:
    """The items in a task: their vectors, in blocks, and what bounds a common subsequence."""

    def __init__(self, items: Items, idf: np.ndarray, space: np.ndarray):
        self.items, self.idf, self.useful, self.space = items, idf, idf > 0, space.astype(np.float32)
        self.size = np.array([len(w) for w in items.words], np.int64)
        flat = np.array([w for words in items.words for w in words], np.int64)
        item = np.repeat(np.arange(len(self.size)), self.size)
        self.pairs = np.zeros(1 << PAIR_BITS, np.uint8)  # how often the item has the word
        slot, n = np.unique(self._slot(flat, item), return_counts=True)
        self.pairs[slot] = np.minimum(n, MANY)
        rare = self.useful[flat]
        key, n = np.unique(item[rare] * len(idf) + flat[rare], return_counts=True)
        item, term = key // len(idf), key % len(idf)
        weight = (1 + np.log(n)) * idf[term]
        latent = np.zeros((len(items.ids), space.shape[1]))
        np.add.at(latent, item, weight[:, None] * space[term])
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-30)
        self.blocks = []
        for at in range(0, len(items.ids), ITEMS_AT_ONCE):
            own = (item >= at) & (item < at + ITEMS_AT_ONCE)
            many = min(ITEMS_AT_ONCE, len(items.ids) - at)
            self.blocks.append((at, latent[at : at + many].T.astype(np.float32), _ByTerm(item[own] - at, term[own], weight[own], len(idf), many)))

    @staticmethod
    def _slot(word: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Where the pair stands in the table; others that share its slot add to the count there, which only weakens the bound."""
        return (word * 0x9E3779B1 + item * 0x85EBCA77) & ((1 << PAIR_BITS) - 1)

    def candidates(self, p: Passages) -> Iterator[tuple[np.ndarray, ...]]:
        """(document, first word, item, cosine) of passages near an item."""
        own, first, term, w = p.weighted(self.idf)
        for k in range(0, len(own), ROWS_AT_ONCE):
            lo, hi = first[k], first[k + ROWS_AT_ONCE] if k + ROWS_AT_ONCE < len(own) else len(w)
            bounds = np.append(first, len(w))[k : k + ROWS_AT_ONCE + 1] - lo
            y = np.add.reduceat(self.space[term[lo:hi]] * w[lo:hi, None].astype(np.float32), bounds[:-1], axis=0)
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-30)
            for at, latent, by_term in self.blocks:
                # Of an item that leaks once little is in the latent space: its words themselves count as well.
                cosine = np.maximum(y @ latent, by_term.cosines(bounds, term[lo:hi], w[lo:hi]))
                near, which = np.nonzero(cosine >= COSINE)
                passage = own[k + near]
                yield p.doc_of[passage], p.start_of[passage], which + at, cosine[near, which]

    def likely(self, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether so many words from lo to hi are words of the item, none taken more often than the item has it, as the common subsequence must have at least."""
        out = np.zeros(len(lo), bool)
        rank = np.append(0, np.cumsum(ids > 0))
        ids, lo, hi, least = ids[ids > 0], rank[lo], rank[hi], COMMON * self.size[item]
        upto, width, at = np.cumsum(hi - lo), len(self.idf), 0
        while at < len(lo):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + WORDS_AT_ONCE, "right")))
            n, own, enough = (hi - lo)[at:stop], item[at:stop], least[at:stop]
            window = np.repeat(np.arange(len(n)), n)
            word = ids[np.repeat(lo[at:stop] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            hit = np.flatnonzero(self.pairs[self._slot(word, own[window])])
            hit = hit[(np.bincount(window[hit], minlength=len(n)) >= enough)[window[hit]]]
            key, times = np.unique(window[hit] * width + word[hit], return_counts=True)
            window, word = key // width, key % width
            most = self.pairs[self._slot(word, own[window])]
            out[at:stop] = np.bincount(window, np.where(most == MANY, times, np.minimum(times, most)), len(n)) >= enough
            at = stop
        return out

    def leaks(self, ids: np.ndarray, sizes: np.ndarray) -> dict[tuple[int, int], tuple]:
        """{(document, item): (common, cosine, answer, start)} at the best place."""
        begin = np.cumsum(sizes) - sizes
        best: dict[tuple[int, int], tuple] = {}
        for shift in (0, PASSAGE // 2):
            for doc, start, item, cosine in self.candidates(Passages(ids, sizes, shift, self.useful)):
                side = np.maximum(PASSAGE // 2, self.size[item])
                lo = begin[doc] + np.maximum(0, start - side)
                hi = begin[doc] + np.minimum(sizes[doc], start + PASSAGE + side)
                kept = np.flatnonzero(self.likely(ids, lo, hi, item))
                for d, s, c, x, a, b in zip(*(v[kept].tolist() for v in (doc, start, item, cosine, lo, hi)), strict=True):
                    words, text = self.items.words[c], ids[a:b].tolist()
                    there = set(text)
                    common = common_subsequence(words, text) / len(words)
                    answer = self.items.answers[c]
                    found = sum(w in there for w in answer) / max(1, len(answer))
                    if common >= COMMON and (found >= ANSWER or not self.items.answered[c]):
                        best[d, c] = max(best.get((d, c), (0.0,)), (common, x, found, max(0, s)))
        return best


def _leaks(items: Items, idf: np.ndarray, space: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Matcher(items, idf, space)
        for b in slices(batches, 1024, PORTION):
            best = matcher.leaks(*_parts(b))
            if best:
                rows = [(b.column(0)[d].as_py(), items.ids[c], *v) for (d, c), v in best.items()]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()), strict=True)], ["doc_id", "item_id", "common", "cosine", "answer", "start"])

    return run


RESULT = "doc_id long, item_id long, common double, cosine double, answer double, start long"


def weights(ids: DataFrame, items: Items) -> np.ndarray:
    """Inverse document frequency of each vocabulary word over all passages; zero for those that tell nothing."""
    width = len(items.vocabulary) + 1
    counts = map_arrow(ids, _document_counts(width), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a word of the benchmark
    df = np.zeros(width)
    for r in counts:
        df[r.term] = r.n
    passages, df[0] = max(1.0, df[0]), 0
    idf = np.log((1 + passages) / (1 + df)) + 0.1
    rare = df <= max(MAX_DF * passages, 3)
    keep = rare.copy()
    for words in items.words:
        if sum(rare[w] for w in set(words)) < 3:
            keep[words] = True
    idf[~keep] = 0
    idf[0] = 0
    return idf


def leaks(docs: DataFrame, benchmark: DataFrame, answer_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, common, cosine, answer, start)``: the items that leaked into each document, at their best place.

    ``common``: longest common subsequence by item length; ``answer``: share of the answer's words in
    the text around, at least half of them for a leak; an item without an answer has the share of its
    last words there, whatever it is. ``start``: word at which the passage begins; of equally good
    places the last. Null and empty texts and items leak nothing; items without an id are left out;
    repeated documents and repeated items come back repeated; items and texts may be of any length;
    either table may be empty; other columns are not read.
    """
    spark = docs.sparkSession
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    own = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")), answer).collect()  # the benchmark
    items = items_of([r for r in sorted(own, key=lambda r: (r[0], r[1], r[2] or "")) if r[1].strip()])
    if not items.vocabulary:
        return spark.createDataFrame([], RESULT)
    if any(not w for w in items.words):  # of signs alone
        real = [k for k, w in enumerate(items.words) if w]
        items = Items(*[[x[k] for k in real] for x in (items.ids, items.words, items.answers, items.answered)], items.vocabulary)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = stored(map_arrow(rows, _numbered(items.vocabulary), "doc_id long, ids binary"), "numbered")
    idf = weights(ids, items)
    return map_arrow(ids, _leaks(items, idf, latent_space(ids, idf)), RESULT)
