"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding lowers case, takes compatibility forms apart, drops marks on letters, turns look-alike letters
and digit substitutions into the letters they stand for and everything else into blanks. A 1 or ! in a
word may be an i or an l: both readings are matched. Terms are whole words or beginnings of words; their weights are log
odds learned from labelled documents. Phrases in which a term is innocent cancel its hits. The sum of
weights, alone and by length, goes through a logistic curve fitted to the same documents.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import carried, map_arrow, schema_of, slices, stored
from tessera.llm.labels import part_of, training_rows

#: Documents of each label that are learned from, at most.
PER_CLASS = 4000
STEMS = (4, 5, 6, 7)
#: Least z-score and log odds of a term.
LEAST_Z, LEAST_ODDS = 4.5, 1.5

#: Letters of other scripts and signs by the Latin letter they look like.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ո": "n", "к": "k", "м": "m", "т": "t",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "ł": "l", "ı": "i", "ø": "o",
}


class _Folds(dict):
    """What each character folds to, learned as characters come."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        if c in LOOKALIKES:
            out: str | None = LOOKALIKES[c]
        elif unicodedata.combining(c) or unicodedata.category(c) in ("Cf", "Mn"):
            out = None
        else:
            apart = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
            out = "".join(LOOKALIKES.get(x, x) if x.isalnum() else " " for x in apart) or " "
        self[code] = out
        return out


_FOLDS, _BLANK_BANG = _Folds(), {ord("!"): " "}
_EITHER = re.compile(r"(?<=\w)[1!]|1(?=[^\W\d_])")


def _translated(text: str) -> str:
    if "!" in text:  # it stands for a letter only inside a word
        text = re.sub(r"(?<![^\W\d_])!|!(?![^\W\d_])", " ", text)
    return f" {text.translate(_FOLDS)} "


def fold(text: str) -> str:
    """Folded text between blanks."""
    return _translated(text.lower())


def folds(text: str) -> list[str]:
    """The folded text, and again with each 1 or ! in a word as an l if there are any; places are the same."""
    text = text.lower()
    if "1" not in text and "!" not in text:
        return [_translated(text)]
    other = _EITHER.sub(lambda m: "l" if m.group() == "1" or text[m.end() : m.end() + 1].isalpha() else m.group(), text)
    return [_translated(text)] + ([_translated(other)] if other != text else [])


def _terms(words: list[str]) -> set[str]:
    """Patterns a text could be matched by: whole words and beginnings of words."""
    own = set(words)
    return {f" {w} " for w in own} | {f" {w[:n]}" for w in own for n in STEMS if len(w) > n}


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label with each pattern, counted by batch."""
    for b in slices(batches, rows=2048, byte_size=32 << 20):
        n: tuple[Counter, Counter] = (Counter(), Counter())
        for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            n[y].update(_terms(fold(text).split()))
        names = list(n[0].keys() | n[1].keys())
        yield pa.record_batch([pa.array(names, pa.string()), *[pa.array([c[x] for x in names], pa.int64()) for c in n]], ["term", "clean", "toxic"])


def _phrase_counts(terms: dict[str, float]):
    """Documents of each label with each two-word phrase around a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for b in slices(batches, rows=2048, byte_size=32 << 20):
            n: tuple[Counter, Counter] = (Counter(), Counter())
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                folded = fold(text)
                seen = set()
                for start in lexicon.hits(folded):
                    right = folded[start:].split(None, 2)[:2]
                    left = folded[: start + 1].rsplit(None, 1)[-1:]
                    seen |= {f" {' '.join(p)} " for p in (right, left + right[:1]) if len(p) == 2}
                n[y].update(seen)
            names = list(n[0].keys() | n[1].keys())
            yield pa.record_batch([pa.array(names, pa.string()), *[pa.array([c[x] for x in names], pa.int64()) for c in n]], ["term", "clean", "toxic"])

    return run


@dataclass
class Lexicon:
    """Patterns with weights, phrases that cancel hits inside them, and the curve of the score."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def machine(self):
        if not hasattr(self, "_machine"):
            machine = ahocorasick.Automaton()
            for t, w in self.terms.items():
                machine.add_word(t, (len(t), w))
            for t in self.exceptions:
                machine.add_word(t, (len(t), None))
            if len(machine):
                machine.make_automaton()
            self._machine = machine
        return self._machine

    def hits(self, folded: str) -> dict[int, float]:
        """{start: weight}, of all patterns that begin there the heaviest, without hits in exception phrases."""
        machine = self.machine()
        found: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        if not len(machine):
            return found
        for end, (size, weight) in machine.iter(folded):
            start = end - size + 1
            if weight is None:
                free.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        if not free:
            return found
        starts, upto = merged(free)
        return {s: w for s, w in found.items() if (k := bisect_right(starts, s)) == 0 or s >= upto[k - 1]}

    def measures(self, text: str) -> tuple[float, float, int]:
        """Log of the sum of weights; sum by length; number of hits."""
        first, *others = folds(text)
        found = self.hits(first)
        for other in others:
            for start, weight in self.hits(other).items():
                found[start] = max(weight, found.get(start, 0.0))
        total = sum(found.values())
        return float(np.log1p(total)), 100 * total / (first.count(" ") + 50), len(found)


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Begins and ends of the union of some spans, in order."""
    begins: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if begins and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    return begins, ends


def _measured(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [lexicon.measures(t) for t in b.column(0).to_pylist()]
            yield pa.record_batch([*b.columns[1:], pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int64())], [*b.schema.names[1:], "total", "density", "hits"])

    return run


def _curve(x: np.ndarray, y: np.ndarray, prior: float, steps: int = 2000) -> np.ndarray:
    """Logistic regression by gradient steps, examples weighted to the prior, coefficients not below zero."""
    prior = min(max(prior, 0.01), 0.99)
    w = np.zeros(3)
    w[0] = np.log(prior / (1 - prior))
    if len(set(y.tolist())) < 2:
        return w
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    x = np.column_stack([np.ones(len(x)), x])
    past = np.full(3, 1e-8)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip((x * w).sum(1), -30, 30)))
        g = (x * ((p - y) * weight)[:, None]).mean(0) + 1e-4 * w * [0, 1, 1]
        past += g * g
        w -= 0.5 * g / np.sqrt(past)
        w[1:] = np.maximum(w[1:], 0)
    return w


def fit(labels: DataFrame, docs: DataFrame, label: str = "toxic", parts: int = 3, held_out: int = 1, per_class: int = PER_CLASS) -> Lexicon:
    """Learn terms, exception phrases and curve from at most ``per_class`` labelled documents of each label.

    Null texts are as empty; repeated ids count once; labels of one kind, or none, give no terms and
    the labels' share as every score. Terms of equal weight at one place count once. Of a long text all
    words count; other columns, whatever their names, are not read; an empty table is one without labels.
    """
    rows, prior = training_rows(labels, docs, label, parts, held_out, per_class)
    rows = stored(rows, "labelled")
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    if not clean or not toxic:
        return Lexicon({}, (), _curve(np.zeros((0, 2)), np.zeros(0), prior if toxic + clean else 0.5))
    counts = map_arrow(rows, _term_counts, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    share = (F.col("c") + F.col("t")) / F.lit(clean + toxic)
    z = (F.col("t") / toxic - F.col("c") / clean) / F.sqrt(share * (1 - share) * (1 / clean + 1 / toxic) + 1e-12)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    best = counts.where("t > 1").select("term", z.alias("z"), odds.alias("odds")).where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS))
    terms = {r.term: r.odds for r in best.orderBy(F.desc("z"), "term").collect()}  # bounded by the sample's words
    around = map_arrow(rows, _phrase_counts(terms), "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    innocent = around.where((F.col("c") >= 3) & (F.col("c") / clean >= 2 * F.col("t") / toxic)).orderBy(F.desc("c"), "term")
    lexicon = Lexicon(terms, tuple(r.term for r in innocent.collect()))
    got = map_arrow(rows.select("text", "y"), _measured(lexicon), "y int, total double, density double, hits long").select("y", "total", "density").collect()  # bounded by per_class
    got = np.array(sorted(got), float)
    lexicon.curve = _curve(got[:, 1:], got[:, 0], prior)
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), new: tuple[str, str] = ("score", "hits")) -> DataFrame:
    """``(*carry, score, hits)`` of each whole text, in time linear in its length.

    Null and empty texts have no hits, and the score of none; repeated rows come back repeated; an
    empty table gives no rows; carried columns may have any names, and ``new`` renames the other two.
    """
    picks, schema, back = carried(docs, carry)
    plain = Lexicon(lexicon.terms, lexicon.exceptions, lexicon.curve)
    rows = map_arrow(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), *picks), _measured(plain), schema_of(schema, "total double, density double, hits long"))
    a, b, c = (float(x) for x in lexicon.curve)
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("total") + F.lit(c) * F.col("density"))))
    return rows.select(*back, score.alias(new[0]), F.col("hits").alias(new[1]))


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 3, held_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document; a null id is not held out.

    Whole texts are scored, however long, in one pass; null texts as empty ones; repeated rows come back
    repeated; other columns, whatever their names, are not read; an empty table gives no rows.
    """
    rows = scored(docs, fit(labels, docs, label, parts, held_out))
    return rows.select("doc_id", (F.coalesce(part_of("doc_id", parts), F.lit(-1)) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
