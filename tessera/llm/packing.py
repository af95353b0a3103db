"""Best-fit packing of tokenised documents, hierarchically.

Each task tokenises its documents, cuts those over the capacity, and packs its pieces best-fit,
longest first. Bins that are nearly full are final. The others are items of the next round, in which
fewer tasks pack the bins of several tasks each; and so on up the tree, until what is left has been in
one task or a round merges nothing. A bin carries its pieces, at most one for each token.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, slices, stored

#: Token ids of words that a worker keeps.
CACHE = 300_000
#: Items that one task packs in the rounds after the first; and children of a node of the merge tree.
TASK_ITEMS, FAN_IN = 20_000, 4

PIECE = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>"


#: Letters below code point 256; their lower case is one to one.
LETTERS = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


class TokenIds:
    """Token ids by words between blanks and line ends.

    The tokenizer splits at white space, and letters from punctuation, before it merges, so a text's
    ids are its words' ids one after the other, and a word's those of its letters and of the
    punctuation after them. Both are kept as little-endian 32-bit bytes, up to a number; any other
    white space stays in its word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a letter or punctuation run
        for token, at in vocabulary.items():
            self.last[at] = token.endswith("</w>")
        self.known, self.parts = {"": b""}, {"": b""}

    def encode(self, text: str) -> np.ndarray:
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)  # without offsets
        return np.array(found.ids, "<u4")

    def runs(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of letter runs and punctuation runs, many at a call."""
        out = {}
        for at in range(0, len(parts), 256):
            own = parts[at : at + 256]
            ids = self.encode(" ".join(own))
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            raw, begin = ids.tobytes(), 0
            for w, end in zip(own, ends, strict=True):
                out[w] = raw[begin:end]
                begin = end
        return out

    def learned(self, words: list[str]) -> list[bytes]:
        """Ids of words that are not kept yet."""
        parts, cut, fresh = self.parts, [], {}
        for w in words:
            stem = w.rstrip(string.punctuation)
            cut.append((stem.lower(), w[len(stem) :]) if LETTERS.fullmatch(stem) else None)
        fresh = self.runs(list({p for pair in cut if pair for p in pair if p not in parts}))
        if len(parts) < CACHE:
            parts |= fresh
        of = lambda p: parts[p] if p in parts else fresh[p]
        return [of(pair[0]) + of(pair[1]) if pair else self.encode(w).tobytes() for w, pair in zip(words, cut, strict=True)]

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's end. Distinct words are looked up once."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = pc.dictionary_encode(lists.values)
        words, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        found = list(map(self.known.get, words))
        new = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(new, self.learned([words[i] for i in new]), strict=True):
            found[i] = x
        if len(self.known) < CACHE:
            self.known.update((words[i], found[i]) for i in new)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin, n = np.cumsum(size) - size, size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(begin[at] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[lists.offsets.to_numpy()[1:]]


_TOKENS: dict[str, TokenIds] = {}


def token_ids(path: str) -> TokenIds:
    """The tokenizer of this worker, which keeps its caches from task to task."""
    if path not in _TOKENS:
        _TOKENS[path] = TokenIds(path)
    return _TOKENS[path]


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin, and each bin's fill. Ties go to the earlier item."""
    order = np.argsort(-lengths, kind="stable")
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: some bin has r tokens of room
    where, fill = np.empty(len(lengths), np.int64), []
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = open_ >> n
        if n and fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ ^= 1 << r
        else:
            b, r = len(fill), capacity
            fill.append(0)
        where[i] = b
        fill[b] += n
        if r > n:
            room[r - n].append(b)
            open_ |= 1 << (r - n)
    return where, np.array(fill, np.int64)


BINS = f"bin long, fill long, final boolean, pieces array<{PIECE}>"


def _batch(base: int, where: np.ndarray, fill: np.ndarray, slack: int, capacity: int, members: pa.StructArray, counts: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Bins of a task as batches. ``members``: pieces of all items in item order, ``counts`` of each item."""
    order = np.argsort(where, kind="stable")
    if counts is None:
        counts = np.ones(len(where), np.int64)
    begin = np.cumsum(counts) - counts
    size = counts[order]
    take = np.repeat(begin[order] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    per_bin = np.bincount(where, weights=counts, minlength=len(fill)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(per_bin)])
    pieces = members.take(pa.array(take))
    for at in range(0, len(fill), 8192):
        upto = min(len(fill), at + 8192)
        part = pieces.slice(int(offsets[at]), int(offsets[upto] - offsets[at]))
        lists = pa.ListArray.from_arrays(pa.array((offsets[at : upto + 1] - offsets[at]).astype(np.int32)), part)
        yield pa.record_batch([pa.array(base + np.arange(at, upto)), pa.array(fill[at:upto]), pa.array(fill[at:upto] >= capacity - slack), lists], ["bin", "fill", "final", "pieces"])


def _first_round(path: str, capacity: int, end_id: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = token_ids(path)
        cols: list[list[np.ndarray]] = [[] for _ in range(5)]
        null: list[np.ndarray] = []
        end = np.array([end_id], "<u4").tobytes()
        for b in slices(batches, 2048, 16 << 20):
            got: list[tuple[int, int, int, int, int]] = []
            ids, ends = tokens.of(b.column(1))
            raw, begin = memoryview(ids.tobytes()), 0
            for row, stop in enumerate((4 * ends).tolist()):
                n = (stop - begin) // 4 + 1  # with the end's id
                for piece, at in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - at)
                    own = raw[begin + 4 * at : min(stop, begin + 4 * (at + size))]
                    crc = zlib.crc32(own) if at + size < n else zlib.crc32(end, zlib.crc32(own))
                    got.append((row, piece, at, size, crc))
                begin = stop
            table = np.array(got, np.int64).reshape(-1, 5)
            ids_, valid = b.column(0).fill_null(0).to_numpy(), b.column(0).is_valid().to_numpy(zero_copy_only=False)
            cols[0].append(ids_[table[:, 0]])
            null.append(~valid[table[:, 0]])
            for k in range(1, 5):
                cols[k].append(table[:, k])
        if not null:
            return
        doc, piece, start, length, crc = (np.concatenate(c) for c in cols)
        members = pa.StructArray.from_arrays([pa.array(doc, mask=np.concatenate(null)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        where, fill = best_fit(length, capacity)
        yield from _batch(TaskContext.get().partitionId() << 32, where, fill, slack, capacity, members)

    return run


def _next_round(capacity: int, slack: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by("bin")  # the same bins whatever order a shuffle brings them in
        lists = table.column("pieces").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        where, fill = best_fit(table.column("fill").to_numpy(), capacity)
        counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        yield from _batch((level << 56) | (TaskContext.get().partitionId() << 32), where, fill, slack, capacity, lists.flatten(), counts)

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bins to pieces, each with its place: the lengths before it in its bin."""
    for b in batches:
        lists = b.column(1)
        pieces = lists.flatten()
        counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        length = pieces.field(3).to_numpy()
        before = np.cumsum(length) - length
        first = np.cumsum(counts) - counts
        base = np.repeat(before[first[counts > 0]], counts[counts > 0])
        fields = pieces.flatten()
        yield pa.record_batch([*fields, pa.array(np.repeat(b.column(0).to_numpy(), counts)), pa.array(before - base)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def packed(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", slack: int | None = None) -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its token ids and then ``end_id``; only one over ``capacity`` is cut, into full
    pieces and a rest. Null text is as empty (``end_id`` alone); repeated rows and null ids are
    documents of their own; an empty table gives no rows; other columns, whatever their names, are not
    read. A long text's ids are in one task's memory. ``slack``: tokens of room up to which a bin
    counts as full before the last round (default: a hundredth of the capacity).
    """
    slack = capacity // 100 if slack is None else slack
    path = tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bins = stored(map_arrow(rows, _first_round(path, capacity, end_id, slack), BINS), "bins")
    full = [bins.where("final")]
    left = bins.where("not final").drop("final")
    count, parts = left.count(), None
    for level in range(1, 64):
        most = -(-count // TASK_ITEMS)
        parts = max(1, most) if parts is None or parts <= FAN_IN * most else -(-parts // FAN_IN)
        if not count:
            break
        if parts == 1 and count <= 2 * TASK_ITEMS:
            spread = left.coalesce(1) if count <= 64 else left.repartition(1)
        else:
            spread = left.repartition(parts, F.xxhash64("bin", F.lit(level)))
        bins = stored(map_arrow(spread, _next_round(capacity, slack, level), BINS), "bins")
        full.append(bins.where("final"))
        left = bins.where("not final").drop("final")
        before, count = count, left.count()
        if parts == 1 or count + bins.where("final").count() == before:
            break
    out = full[0].select("bin", "pieces")
    for more in full[1:]:
        out = out.unionByName(more.select("bin", "pieces"))
    out = out.unionByName(left.select("bin", "pieces"))
    return map_arrow(out, _placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
