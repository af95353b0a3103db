"""Tokens of two tokenizers over the same text, aligned by byte ranges.

The B tokens' ends, in order, are a static interval index: two bisections stab it with an A token's begin
and last byte and give the run of B tokens that it overlaps. Ends of A that are ends of B, gaps which no
token spans, bound the groups. No token crosses a chunk's begin (``chunks``), so alignment is done once for
each distinct chunk of a block of documents, and documents are sums over their chunks.

How many documents hold a linked pair of ids is counted over the corpus: distinct pairs of a block with
their documents there, summed by pair, and joined back to the blocks. A pair is one row a block, however
common, and nothing of the pairs is broadcast but each A id's highest count, a row for each entry of A's
vocabulary at most.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.chunks import BLOCK_ROWS, PORTION, Frequencies, cut, per_row, place, portions, ragged, summed, sums, values
from tessera.llm.common import map_arrow, slices, stored
from tessera.llm.token_counts import ModelPieces, by_block, by_key, cell_of, first_block

#: Chunks whose ids a worker keeps, characters of the longest of these, and chunks and bytes tokenised at a call.
CACHE, CACHED_CHARS, AT_ONCE, AT_ONCE_BYTES = 80_000, 32, 256, 1 << 16

OWN = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
BLOCKS = f"block long, pairs array<bigint>, holders array<int>, {', '.join(f'{c} array<bigint>' for c in OWN[:5])}, groups_sha256 array<string>, {Frequencies.schema}"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as they are and the others from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Ids of both tokenizers by chunk. A: byte-level, by ``tokenizers``; B: a ``sentencepiece`` model that
    doesn't normalise and adds a blank. Strings of special tokens are plain text to both."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core; each thread would keep memory of its own
        from tokenizers import Tokenizer

        self.a, other = Tokenizer.from_file(a), ModelPieces(b)
        self.a.encode_special_tokens = True
        self.b, self.at = other.model, other.at
        if not other.prefix or self.a.normalizer is not None or "ByteLevel" not in repr(self.a.pre_tokenizer):
            raise ValueError("A must be byte-level and B must keep texts as they are")
        letters, vocabulary = _byte_letters(), self.a.get_vocab()
        names = {i: t for t, i in vocabulary.items()}
        added = self.a.get_added_tokens_decoder()
        spelled = lambda i: names[i].encode() if i in added else bytes(letters[c] for c in names[i])
        self.a_bytes = pa.array([spelled(i) if i in names else b"" for i in range(max(names) + 1)], pa.binary())
        b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.b_bytes = pa.array(b_bytes, pa.binary())
        self.sizes = tuple(pc.binary_length(x).to_numpy().astype(np.int64) for x in (self.a_bytes, self.b_bytes))
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.most = most
        self.strings = pa.array([mark + str(i) for mark in ";,|" for i in range(most)])
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text that begins with a white space, behind an anchor that takes B's own blank."""
        (found,) = self.a.encode_batch_fast(["a" + text], add_special_tokens=False)
        a, b = np.array(found.ids, np.int32), np.array(self.b.encode("a" + text, num_threads=1), np.int32)
        if self.sizes[0][a[0]] != 1 or self.sizes[1][b[0]] != 2:
            raise ValueError("a token crosses a chunk's begin")
        return a[1:], b[1:]

    def learned(self, chunks: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Both ids of chunks; None where B's bytes are others than the chunk's."""
        out: list[tuple[bytes, bytes] | None] = [None] * len(chunks)
        group: list[int] = []
        size = 0
        for i, chunk in enumerate([*chunks, ""]):
            if not chunk or size + len(chunk) > AT_ONCE_BYTES or len(group) == AT_ONCE:
                self._grouped(chunks, group, out)
                group, size = [], 0
            if chunk and chunk[-1:].strip():
                group.append(i)
                size += len(chunk)
            elif chunk:  # white space at its end belongs to what follows
                self._grouped(chunks, [i], out)
        return out

    def _grouped(self, chunks: list[str], group: list[int], out: list) -> None:
        if not group:
            return
        own = [chunks[i].encode() for i in group]
        a, b = self.ids("".join(chunks[i] for i in group))
        ends = np.cumsum([len(x) for x in own])
        places, raws = [], []
        for ids, size in zip((a, b), self.sizes, strict=True):
            at = np.cumsum(size[ids])
            stop = np.searchsorted(at, ends)
            if not len(at) or stop[-1] >= len(at) or at[-1] != ends[-1] or (at[stop] != ends).any():
                places = []
                break
            places.append(4 * np.concatenate([[0], stop + 1]))
            raws.append(ids.tobytes())
        if places and b"".join(self.b_bytes.take(pa.array(b)).to_pylist()) == b"".join(own):
            (pa_, pb), (ra, rb) = (x.tolist() for x in places), raws
            for k, i in enumerate(group):
                out[i] = (ra[pa_[k] : pa_[k + 1]], rb[pb[k] : pb[k + 1]])
        elif len(group) > 1:
            for i in group:
                self._grouped(chunks, [i], out)

    def of(self, chunks: list[str]) -> list[tuple[bytes, bytes] | None]:
        known = self.known
        found = [known.get(c, 0) for c in chunks]
        new = [i for i, x in enumerate(found) if x == 0]
        for i, x in zip(new, self.learned([chunks[i] for i in new]), strict=True):
            found[i] = x
            if len(chunks[i]) <= CACHED_CHARS and len(known) < CACHE:
                known[chunks[i]] = x
        return found


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(a: str, b: str) -> Pair:
    """The tokenizers of this worker."""
    if (a, b) not in _PAIRS:
        _PAIRS[a, b] = Pair(a, b)
    return _PAIRS[a, b]


class Aligned:
    """Alignment of chunks: numbers, links and groups of each. Chunks without ids have none of them."""

    def __init__(self, both: Pair, found: list[tuple[bytes, bytes] | None]):
        kept = [x or (b"", b"") for x in found]
        self.bad = np.array([x is None for x in found], bool)
        a, b = (np.frombuffer(b"".join(x[k] for x in kept), np.int32).astype(np.int64) for k in (0, 1))
        self.n_a, self.n_b = (np.array([len(x[k]) // 4 for x in kept], np.int64) for k in (0, 1))
        a_end, b_end = np.cumsum(both.sizes[0][a]), np.cumsum(both.sizes[1][b])  # chunk after chunk: one axis of bytes
        first = np.searchsorted(b_end, a_end - both.sizes[0][a], "right")
        last = np.searchsorted(b_end, a_end, "left")
        links = last - first + 1
        link_a = np.repeat(np.arange(len(a)), links)
        self.pairs = (a[link_a] << 32) | b[ragged(first, links)]
        chunk_a = np.repeat(np.arange(len(found)), self.n_a)
        self.n_links = np.bincount(chunk_a, weights=links, minlength=len(found)).astype(np.int64)
        closes_a = b_end[last] == a_end if len(b_end) else np.zeros(len(a), bool)
        closes_b = np.isin(b_end, a_end[closes_a])
        self.n_groups = np.bincount(chunk_a, weights=closes_a, minlength=len(found)).astype(np.int64)
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        size_a, size_b = np.bincount(group_a), np.bincount(group_b)
        written = np.empty(len(a) + len(b), np.int64)  # a group's A ids, then its B ids
        if len(a):
            before_a, before_b = np.cumsum(size_a), np.cumsum(size_b) - size_b
            new_a, new_b = np.concatenate([[True], closes_a[:-1]]), np.concatenate([[True], closes_b[:-1]])
            written[np.arange(len(a)) + before_b[group_a]] = np.where(new_a, 0, both.most) + a
            written[np.arange(len(b)) + before_a[group_b]] = np.where(new_b, 2 * both.most, both.most) + b
        said = both.strings.take(pa.array(written))
        data, ends = values(said)
        bounds = ends[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])].astype(np.int32)
        self.said = pa.StringArray.from_buffers(len(found), pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes()))


def _blocks(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both = pair(a, b)
        block = first_block(TaskContext.get().partitionId())
        for batch in slices(batches, BLOCK_ROWS, PORTION):
            n_rows = batch.num_rows
            totals = {k: np.zeros(n_rows, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
            digests: list = [None] * n_rows
            bad, parts = np.zeros(n_rows, bool), [(np.empty(0, np.int64),) * 3]
            for rows, texts in portions(batch.column(1), both.at, PORTION // 2):
                chunks, ends = cut(texts, both.at)
                coded = chunks.dictionary_encode()
                idx = coded.indices.to_numpy().astype(np.int64)
                done = Aligned(both, both.of(coded.dictionary.to_pylist()))
                for name, total in totals.items():
                    total[rows] += sums(getattr(done, name)[idx], ends)
                bad[rows] |= sums(done.bad[idx].astype(np.int64), ends) > 0
                data, at = values(done.said.take(pa.array(idx)))
                said = memoryview(data.tobytes())
                for row, begin, end in zip(rows.tolist(), at[ends[:-1]].tolist(), at[ends[1:]].tolist(), strict=True):
                    if begin < end and digests[row] is None:
                        digests[row], begin = hashlib.sha256(), begin + 1  # without the first mark
                    if begin < end:
                        digests[row].update(said[begin:end])
                row, chunk, freq = per_row(idx, ends, len(done.bad))
                size, begin = done.n_links[chunk], (np.cumsum(done.n_links) - done.n_links)[chunk]
                parts.append((np.repeat(rows[row], size), done.pairs[ragged(begin, size)], np.repeat(freq, size)))
            row, link, freq = (np.concatenate(x) for x in zip(*parts, strict=True))
            good = ~bad[row]
            pairs, pid = np.unique(link[good], return_inverse=True)
            key, freq = summed(row[good] * max(1, len(pairs)) + pid, freq[good])
            row, pid = key // max(1, len(pairs)), key % max(1, len(pairs))
            for total in totals.values():
                total[bad] = 0
            digest = [d.hexdigest() if d is not None and not x else "" for d, x in zip(digests, bad.tolist(), strict=True)]
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            held = np.bincount(pid, minlength=len(pairs)).astype(np.int32)
            docs = [*map(whole, (batch.column(0), *map(pa.array, totals.values()), pa.array(digest, pa.string()))), *Frequencies.columns(row, pid, freq, n_rows)]
            yield pa.record_batch([pa.array([block]), whole(pa.array(pairs)), whole(pa.array(held)), *docs], ["block", "pairs", "holders", *OWN, "cells", "n_keys", "keys", "freqs"])
            block += 1
            pa.default_memory_pool().release_unused()

    return run


def _with_counts(block: dict, found: pa.Table) -> pa.Table:
    keys, freqs, ends = Frequencies.of(block)
    whole = {c: pa.array(block[c], pa.int64()) for c in OWN[:5]}
    whole |= {"n_best": pa.array(sums(by_key(found, "best")[keys] * freqs, ends)), "count_sum": pa.array(sums(by_key(found, "n")[keys] * freqs, ends))}
    return pa.table(whole | {"groups_sha256": pa.array(block["groups_sha256"], pa.string())})


def aligned(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    Null and empty texts, and those whose characters B can't give back, have no tokens: zeros and an empty
    ``groups_sha256``. Null ids and repeated rows are documents of their own (each counts as a holder of its
    pairs); of ids with the same count all are best; other columns, whatever their names, are not read; an
    empty table gives no rows. A text longer than ``PORTION`` is worked on in portions, cut where chunks begin.
    """
    pa_, pb = place(a), place(b)
    pair(pa_, pb)  # tells of unfit tokenizers before any job
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(F.col(text_col) != "", F.concat(F.lit(" "), F.col(text_col))).otherwise("").alias("text"))
    blocks = stored(map_arrow(rows, _blocks(pa_, pb), BLOCKS), "blocks")
    heads = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("pid", "own")).select(cell_of("block", "pid"), F.col("own.pairs").alias("pair"), F.col("own.holders").alias("holders"))
    counted = stored(heads.groupBy("pair").agg(F.sum("holders").alias("n")), "pairs")
    highest = counted.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    counted = counted.join(F.broadcast(highest), F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    found = heads.join(counted, "pair").select("cell", "n", "best")
    return by_block(blocks.drop("pairs", "holders"), found, _with_counts, ALIGNED)
