"""Removal of recurring passages: windows of words that also occur elsewhere.

Three passes over a stored copy of the texts; only hashes and phrases are shuffled, never texts. Rows
have a row id, and blocks of consecutive rows are the shards.

1. Anchors. Of the 8-word phrases in a window the one with the least hash is its anchor, so equal
   windows have equal anchors; about one phrase in fourteen is one. Each block counts its anchors,
   with the least and the largest hash of their contexts, all words that a window around one can reach. An anchor seen once is in no
   recurring window. One seen in a single context confirms that whole context.
2. Windows. Around anchors with several contexts, windows themselves are counted. The block in which
   a confirmed anchor comes first also hands out its phrase, the text that stands there.
3. Location. The phrases of confirmed passages go to the shards that need them. Each shard compiles
   them to Aho-Corasick automata of bounded size and streams all its documents through them. Their
   hits alone are the places looked at; what a hit's context or window has recur goes.

A shard's phrases lie in the shared store, in one folder for each part of the text table and sorted by
block, from which the part's tasks read them themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import carried, map_arrow, schema_of, scratch, slices, stored

PHRASE = 8
#: Rows of a block, as a power of two; blocks of a part; phrases of one automaton; anchors counted at once.
BLOCK_BITS, PART_BITS = 12, 33 - 12
MACHINE, COUNTED = 40_000, 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = _POWERS[base] = _powers(base, max(n, 1 << 16))
    return have[:n]


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two."""
    return mix(a * np.uint64(0xC2B2AE3D27D4EB4F) + b)


def _sliding(x: np.ndarray, size: int, op) -> np.ndarray:
    """``op`` over each run of ``size``: len(x) - size + 1 values."""
    width = 1
    while 2 * width <= size:
        x = op(x[:-width], x[width:])
        width *= 2
    rest = size - width
    return op(x[: len(x) - rest], x[rest:]) if rest else x


class Words:
    """The words of some documents in one array, with hashes of any run of words inside a document."""

    def __init__(self, docs: list[list[bytes]], window: int):
        self.window = window
        self.size = np.array([len(w) for w in docs], np.int64)
        self.end = np.cumsum(self.size)
        self.begin = self.end - self.size
        self.n = int(self.end[-1]) if len(docs) else 0
        each = np.fromiter((xxhash.xxh64_intdigest(x) for w in docs for x in w), np.uint64, self.n)
        self.doc = np.repeat(np.arange(len(docs)), self.size)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each * _power(BASE, self.n), dtype=np.uint64)])

    def run(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of the words lo to hi, end excluded; equal runs have equal hashes wherever they are."""
        raw = (self.sums[hi] - self.sums[lo]) * _power(INVERSE, self.n + 1)[lo]
        return mix(raw + (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def phrases(self) -> np.ndarray:
        """Hash of the phrase at each position; the largest number where it would leave its document."""
        out = np.full(self.n, TOP)
        at = np.arange(max(0, self.n - PHRASE + 1))
        out[at] = self.run(at, at + PHRASE)
        out[at[self.doc[at] != self.doc[at + PHRASE - 1]]] = TOP
        return out

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrase hashes; starts of windows; each window's anchor hash."""
        phrases = self.phrases()
        at = np.arange(max(0, self.n - self.window + 1))
        if not len(at):
            return phrases, at, np.zeros(0, np.uint64)
        least = _sliding(phrases, self.window - PHRASE + 1, np.minimum)[: len(at)]
        inside = self.doc[at] == self.doc[at + self.window - 1]
        return phrases, at[inside], least[inside]

    def selected(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of anchors, and their hashes."""
        phrases, starts, least = self.anchors()
        if not len(starts):
            return starts, least
        reach = self.window - PHRASE + 1
        padded = np.zeros(self.n + reach - 1, np.uint64)
        padded[starts + reach - 1] = least
        chosen = np.flatnonzero((_sliding(padded, reach, np.maximum) == phrases) & (phrases != TOP))
        return chosen, phrases[chosen]

    def context(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The run of words that windows with the phrase at ``at`` can reach."""
        doc = self.doc[at]
        return np.maximum(self.begin[doc], at - (self.window - PHRASE)), np.minimum(self.end[doc], at + self.window)


def _counted(*cols: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows and how often each occurs."""
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    first = np.flatnonzero(new)
    return [c[first] for c in cols], np.diff(np.append(first, len(order)))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices whose rows, by the row id in the first column, lie in one block."""
    for b in slices(batches):
        block = b.column(0).to_numpy() >> BLOCK_BITS
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield int(block[i]), b.slice(i, j - i)


def _split(b: pa.RecordBatch) -> list[list[bytes]]:
    return [(t or b"").split() for t in b.column(1).to_pylist()]


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now, n = -1, 0

        def counted() -> pa.RecordBatch:
            anchor, context = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            order = np.lexsort((context.view(np.int64), anchor))
            anchor, context = anchor[order], context[order]
            first = np.flatnonzero(np.concatenate([anchor[:1] == anchor[:1], anchor[1:] != anchor[:-1]]))
            last = np.append(first[1:], len(anchor))[: len(first)]
            return pa.record_batch([pa.array(np.full(len(first), now)), _long(anchor[first]), _long(context[first]), _long(context[last - 1]), pa.array(last - first)], ["block", "a", "lo", "hi", "n"])

        for block, b in by_block(batches):
            if held and (block != now or n >= COUNTED):
                yield counted()
                held, n = [], 0
            now = block
            words = Words(_split(b), window)
            at, anchor = words.selected()
            held.append((anchor, words.run(*words.context(at))))
            n += len(anchor)
        if held:
            yield counted()

    return run


class _Side:
    """Rows of a table written by part and sorted by block, a block at a time."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.at, self.rows = path, columns, None, None

    def of(self, block: int) -> pa.Table:
        if self.at != block:
            fs, at = pa.fs.FileSystem.from_uri(f"{self.path}/part={block >> PART_BITS}")
            found = []
            if fs.get_file_info(at).type != pa.fs.FileType.NotFound:
                for f in fs.get_file_info(pa.fs.FileSelector(at)):
                    if f.base_name.endswith(".parquet"):
                        found.append(pq.read_table(f.path, filesystem=fs, columns=self.columns, partitioning=None, filters=[("block", "=", block)]))
            self.at, self.rows = block, pa.concat_tables(found) if found else None
        return self.rows

    def hashes(self, block: int, name: str, where: str | None = None) -> np.ndarray:
        """Distinct values of a column, of the rows in which another one is true."""
        rows = self.of(block)
        if rows is None:
            return np.zeros(0, np.uint64)
        return np.unique((rows if where is None else rows.filter(rows.column(where))).column(name).to_numpy().view(np.uint64))


def _windows(window: int, asked: str):
    """(block, a, w, n): windows around anchors of several contexts; (block, a, phrase): the phrases that a block hands out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = _Side(asked, ["a", "mixed", "own"])
        now, mixed, own = -1, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for block, b in by_block(batches):
            if block != now:
                now, mixed, own = block, side.hashes(block, "a", "mixed"), side.hashes(block, "a", "own")
            if not len(mixed) and not len(own):
                continue
            docs = _split(b)
            words = Words(docs, window)
            phrases, starts, least = words.anchors()
            keep = np.isin(least, mixed)
            (anchor, hashed), n = _counted(least[keep], words.run(starts[keep], starts[keep] + window))
            at = np.flatnonzero(np.isin(phrases, own))
            given, first = np.unique(phrases[at], return_index=True)
            own = own[~np.isin(own, given)]
            text = []
            for p in at[first].tolist():
                doc = int(words.doc[p])
                k = p - int(words.begin[doc])
                text.append(b" ".join(docs[doc][k : k + PHRASE]))
            a = pa.array(np.concatenate([anchor, given]).view(np.int64))
            few, many = len(given), len(anchor)
            yield pa.record_batch([pa.array(np.full(many + few, block)), a, pa.concat_arrays([_long(hashed), pa.nulls(few, pa.int64())]), pa.concat_arrays([pa.array(n.astype(np.int64)), pa.nulls(few, pa.int64())]), pa.concat_arrays([pa.nulls(many, pa.binary()), pa.array(text, pa.binary())])], ["block", "a", "w", "n", "phrase"])

    return run


class _Shard:
    """The automata of a shard's phrases, what confirms their hits, and its documents' places."""

    def __init__(self, phrases: _Side, confirmed: _Side, block: int, window: int):
        self.window = window
        rows = phrases.of(block)
        self.machines, self.context, self.whole = [], np.zeros(0, np.uint64), np.zeros(0, bool)
        self.windows = np.zeros(0, np.uint64)
        if rows is None:
            return
        context = rows.column("v")
        self.whole = context.is_valid().to_numpy()
        self.context = context.fill_null(0).to_numpy().view(np.uint64)
        text = rows.column("phrase").to_pylist()
        for at in range(0, len(text), MACHINE):
            machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for k, t in enumerate(text[at : at + MACHINE], at):
                machine.add_word(f" {t.decode('latin-1')} ", k)  # a letter a byte
            machine.make_automaton()
            self.machines.append(machine)
        if (own := confirmed.of(block)) is not None:
            self.windows = np.unique(pair(*(own.column(c).to_numpy().view(np.uint64) for c in ("a", "v"))))

    def located(self, docs: list[list[bytes]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """{document: (word at which a phrase stands, which phrase)} of those with hits."""
        out = {}
        for doc, own in enumerate(docs):
            if len(own) < self.window:
                continue
            line = f" {b' '.join(own).decode('latin-1')} "
            hits = [hit for machine in self.machines for hit in machine.iter(line)]
            if hits:
                ends, which = np.array(hits, np.int64).T
                blanks = np.cumsum([len(w) + 1 for w in own])  # place of the blank after each word
                out[doc] = (np.searchsorted(blanks, ends) - (PHRASE - 1), which)
        return out

    def dropped(self, docs: list[list[bytes]]) -> dict[int, np.ndarray]:
        """{document: whether each of its words goes} of those that lose any."""
        found = self.located(docs) if self.machines else {}
        if not found:
            return {}
        words = Words([docs[i] for i in found], self.window)
        at = np.concatenate([p + words.begin[k] for k, (p, _) in enumerate(found.values())])
        which = np.concatenate([x for _, x in found.values()])
        change = np.zeros(words.n + 1, np.int64)
        whole = self.whole[which]
        lo, hi = words.context(at[whole])
        ok = (words.run(lo, hi) == self.context[which[whole]]) & (hi - lo >= self.window)
        np.add.at(change, lo[ok], 1)
        np.add.at(change, hi[ok], -1)
        if not whole.all():
            _, starts, least = words.anchors()
            near = np.zeros(words.n + 1, np.int64)
            np.add.at(near, np.maximum(0, at[~whole] - (self.window - PHRASE)), 1)
            np.add.at(near, at[~whole] + 1, -1)
            keep = np.cumsum(near)[starts] > 0
            starts, least = starts[keep], least[keep]
            ok = np.isin(pair(least, words.run(starts, starts + self.window)), self.windows)
            np.add.at(change, starts[ok], 1)
            np.add.at(change, starts[ok] + self.window, -1)
        drop = np.cumsum(change)[:-1] > 0
        cut = {i: drop[words.begin[k] : words.end[k]] for k, i in enumerate(found)}
        return {i: own for i, own in cut.items() if own.any()}


def _removed(window: int, phrases: str, confirmed: str, original: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _Side(phrases, ["phrase", "v"]), _Side(confirmed, ["a", "v"])
        now, shard = -1, None
        for block, b in by_block(batches):
            if block != now:
                now, shard = block, _Shard(*sides, block, window)
            raw, docs = b.column(1).to_pylist(), _split(b)
            gone, kept = [0] * len(docs), list(docs)
            for i, own in shard.dropped(docs).items():
                gone[i] = int(own.sum())
                kept[i] = [w for w, x in zip(docs[i], own.tolist(), strict=True) if not x]
            out = [t if original and not g else b" ".join(w) for t, w, g in zip(raw, kept, gone, strict=True)]
            yield pa.record_batch([*b.columns[2:], pa.array([len(d) for d in docs], pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.binary())], [*b.schema.names[2:], *NEW])

    return run


def _by_part(df: DataFrame, name: str) -> str:
    """Write rows with a ``block`` into a folder for each part of the text table, sorted by block."""
    path = scratch(df.sparkSession, name)
    df = df.withColumn("part", F.shiftright("block", PART_BITS))
    df = df.repartition("part").sortWithinPartitions("part", "block")
    df.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).partitionBy("part").parquet(path)
    return path


NEW = ("n_words", "n_removed", "kept")


def without_recurring(docs: DataFrame, text_col: str = "text", window: int = 35, carry: tuple[str, ...] = ("doc_id",), original: bool = False, new: tuple[str, str, str] = NEW) -> DataFrame:
    """``(*carry, n_words, n_removed, kept)``: each text without the words of recurring windows.

    Words are runs of anything but the six ASCII blanks. A word goes if a window of ``window`` words
    over it also starts anywhere else, in the same text or another; windows are judged on the input.
    ``kept`` has the kept words with single blanks, or with ``original`` the text as it was if no word
    went. Null is as empty text (null with ``original``); texts shorter than a window lose nothing; an
    empty table gives no rows; of repeated rows each is another text, so that they lose all their
    windows. ``carry`` columns may have any names; ``new`` renames the three columns where one clashes.
    """
    assert window >= PHRASE
    picks, schema, back_out = carried(docs, carry)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(text_col).cast("binary").alias("bytes"), *picks)
    rows = stored(rows, "texts")
    only = rows.select("rid", "bytes")
    anchors = stored(map_arrow(only, _anchors(window), "block long, a long, lo long, hi long, n long"), "anchors")
    known = anchors.groupBy("a").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("block").alias("first")).where("n > 1")
    known = known.select("a", (F.col("lo") != F.col("hi")).alias("mixed"), F.col("lo").alias("ctx"), "first")
    back = anchors.select("block", "a").join(known, "a").select("block", "a", "ctx", "mixed", (F.col("block") == F.col("first")).alias("own"))
    back = stored(back, "recurring")
    asked = _by_part(back.where("mixed or own").select("block", "a", "mixed", "own"), "asked")
    looked = stored(map_arrow(only, _windows(window, asked), "block long, a long, w long, n long, phrase binary"), "windows")
    windows = looked.where("w is not null")
    often = windows.groupBy("a", "w").agg(F.sum("n").alias("n")).where("n > 1").select("a", "w")
    confirmed = stored(windows.join(often, ["a", "w"]).select("block", "a", F.col("w").alias("v")), "confirmed")
    needs = back.where("not mixed").select("block", "a", F.col("ctx").alias("v"))
    needs = needs.unionByName(confirmed.select("block", "a", F.lit(None).cast("long").alias("v")).distinct())
    phrases = looked.where("phrase is not null").select("a", "phrase")
    phrases = _by_part(needs.join(phrases, "a").select("block", "phrase", "v"), "phrases")
    out = map_arrow(rows, _removed(window, phrases, _by_part(confirmed, "confirmed-by-part"), original), schema_of(schema, "n_words long, n_removed long, kept binary"))
    return out.select(*back_out, F.col("n_words").alias(new[0]), F.col("n_removed").alias(new[1]), F.col("kept").cast("string").alias(new[2]))
