"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are the paths of a binary trie. The join walks pairs of nodes down together, adds up
the bits in which their branches differ, and drops a pair as soon as the sum is over the budget.

A budget of k bits leaves one of k+1 bit blocks unchanged, so the walk need not begin at the root:
the fingerprint is rotated once for each block, and below the block's bits only the pairs (x, x) are
left. Those nodes are what is dealt out to tasks. A node with many fingerprints is dealt out again by
the blocks of its remaining bits, so that no task gets an unbounded node. A task links what it finds
in a local forest and returns at most one link for each fingerprint and node, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, release, slices, stored
from tessera.llm.components import connected_components

SEED = 42
#: Fingerprints under one node beyond which the node is dealt out again.
NODE_LIMIT = 4096
#: Node pairs that are walked at once.
FRONT = 1 << 18
#: Rows of whole nodes that are walked together; nodes over the limit that are broadcast, at most.
WALK_ROWS, BROADCAST_NODES = 1 << 18, 50_000


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Runs of ``size`` words with repeats; fewer words are one run, none is no run."""
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def hashes(items: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, items, repeat(SEED)), np.uint64, len(items))


def majority(h: np.ndarray) -> np.ndarray:
    """The 64-bit word, as an array of one, whose bits are set in over half the hashes; zero if there are none."""
    n = len(h)
    if not n:
        return np.zeros(1, np.uint64)
    bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(n, 8), axis=1)
    lanes = np.add.reduceat(bits.view(np.uint64), np.arange(0, n, 255), axis=0)  # eight byte counters in a word, none over 255
    counts = lanes.view(np.uint8).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > n).view(np.uint64)


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            # on bytes: A-Z only, and the six ASCII blanks
            prints = [majority(hashes(shingles(text.lower().split(), shingle))).tobytes() for text in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(np.frombuffer(b"".join(prints), np.int64))], ["id", "print"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, print)``: the 64-bit SimHash of each whole text as a signed long.

    Null text is as the empty one, whose fingerprint is zero. One output row for each input row, so none
    for an empty table. A long text's shingles are in one task's memory.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return map_arrow(rows, _fingerprints(shingle), "id long, print long")


# --- the walk ---------------------------------------------------------------------------------


class Forest:
    """Union-find over 0..n-1 whose root is the smallest member; unites arrays of pairs at once."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        x = self.up[x]
        while len(x) and (y := self.up[x]) is not None and (y != x).any():
            x = y
        return x

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            open_ = a != b
            a, b = np.minimum(a, b)[open_], np.maximum(a, b)[open_]
            np.minimum.at(self.up, b, a)


def walk(start: np.ndarray, end: np.ndarray, keys: np.ndarray, depth: np.ndarray, budget: int, found, forest: Forest) -> None:
    """Walk the trie of ``keys`` (sorted within each node [start, end)) from the pairs (node, node).

    ``depth``: bits at the top that the keys under a node share. ``found(i, j)`` gets pairs of
    positions at most ``budget`` bits apart, and unites those that it accepts in ``forest``. Large
    node pairs that are within one tree already are left out, and of a run of equal keys each member
    is held only against those outside its own tree.
    """
    ones = {}

    def joined(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> np.ndarray:
        root = forest.roots(np.arange(len(keys)))
        change = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
        return (root[alo] == root[blo]) & (change[ahi - 1] == change[alo]) & (change[bhi - 1] == change[blo])

    def run_of_equals(lo: int, hi: int) -> None:
        for i in range(lo, hi):
            rest = np.arange(i + 1, hi)
            rest = rest[forest.roots(rest) != forest.roots(np.array([i]))]
            found(np.full(len(rest), i), rest)
            if len(np.unique(forest.roots(np.arange(lo, hi)))) == 1:
                return

    def split(lo: np.ndarray, hi: np.ndarray, d: int) -> np.ndarray:
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)])
        return hi - (ones[d][hi] - ones[d][lo])

    live = end - start > 1
    stack = []
    for d in np.unique(depth[live]).tolist():
        s, e = start[live & (depth == d)], end[live & (depth == d)]
        stack += [(d, s[i : i + FRONT], e[i : i + FRONT], s[i : i + FRONT], e[i : i + FRONT], np.zeros(len(s[i : i + FRONT]), np.int8)) for i in range(0, len(s), FRONT)]
    while stack:
        d, alo, ahi, blo, bhi, err = stack.pop()
        size = (ahi - alo) * (bhi - blo)
        if (size > 4096).any():
            open_ = (size <= 4096) | ~joined(alo, ahi, blo, bhi)
            alo, ahi, blo, bhi, err, size = (x[open_] for x in (alo, ahi, blo, bhi, err, size))
        equal = (alo == blo) & (size > 9) & (keys[alo] == keys[ahi - 1])
        if equal.any():
            for lo, hi in zip(alo[equal].tolist(), ahi[equal].tolist(), strict=True):
                run_of_equals(lo, hi)
            alo, ahi, blo, bhi, err, size = (x[~equal] for x in (alo, ahi, blo, bhi, err, size))
        small = size <= 9
        if d >= 64:
            small[:] = True
        if small.any():
            for i, j in _leaves(alo[small], ahi[small], blo[small], bhi[small]):
                near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
                found(i[near], j[near])
            alo, ahi, blo, bhi, err = (x[~small] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        am, bm, same = split(alo, ahi, d), split(blo, bhi, d), alo == blo
        parts = [(alo, am, blo, bm, err), (am, ahi, bm, bhi, err), (alo, am, bm, bhi, err + 1)]
        other = ~same
        parts.append((am[other], ahi[other], blo[other], bm[other], err[other] + 1))
        nxt = [np.concatenate(x) for x in zip(*parts, strict=True)]
        pair = (nxt[0] == nxt[2]) & (nxt[1] - nxt[0] < 2)
        ok = (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & (nxt[4] <= budget) & ~pair
        nxt = [x[ok] for x in nxt]
        for i in range(0, len(nxt[0]), FRONT):
            stack.append((d + 1, *(x[i : i + FRONT] for x in nxt)))


def _leaves(alo, ahi, blo, bhi) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions of small node pairs, in bounded portions."""
    n = (ahi - alo) * (bhi - blo)
    at = 0
    while at < len(n):
        upto = at + max(1, int(np.searchsorted(np.cumsum(n[at : at + (1 << 20)]), 1 << 20)))
        size = n[at:upto]
        which = np.repeat(np.arange(at, at + len(size)), size)
        k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        wide = (bhi - blo)[which]
        i, j = alo[which] + k // wide, blo[which] + k % wide
        keep = i < j
        yield i[keep], j[keep]
        at += len(size)


def _walk_nodes(budget: int):
    """Rows (node, depth, key, id) sorted by node -> links (a, b) between ids; some whole nodes are held at a time."""

    def links(table: pa.Table) -> pa.RecordBatch:
        node, depth, ids = (table.column(c).to_numpy() for c in ("node", "depth", "id"))
        keys = table.column("key").to_numpy().view(np.uint64)
        order = np.lexsort((keys, node))
        node, depth, ids, keys = node[order], depth[order], ids[order], keys[order]
        start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        forest = Forest(len(ids))
        walk(start, np.append(start[1:], len(ids)), keys, depth[start], budget, forest.unite, forest)
        every = np.arange(len(ids))
        root = forest.roots(every)
        tied = (root != every) & (ids[root] != ids)
        return pa.record_batch([pa.array(ids[tied]), pa.array(ids[root[tied]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            node = b.column(0).to_numpy()
            first = int(np.searchsorted(node, node[-1]))  # the last node may go on in the next batch
            if first and rows + first >= WALK_ROWS:
                yield links(pa.Table.from_batches([*held, b.slice(0, first)]))
                held, rows = [b.slice(first)], b.num_rows - first
            elif held and rows >= WALK_ROWS and not first and held[-1].column(0)[-1].as_py() != node[0]:
                yield links(pa.Table.from_batches(held))
                held, rows = [b], b.num_rows
            else:
                held.append(b)
                rows += b.num_rows
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def _blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """(offset from the top, width) of ``parts`` blocks of near equal width."""
    cuts = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _rotated(key, offset: int, width: int, top: int = 0):
    """``key`` with the block at ``offset`` (from bit ``top``) moved up to bit ``top``; the bits above stay."""
    if not offset:
        return key
    u = F.shiftrightunsigned
    keep = ((1 << top) - 1) << (64 - top) if top else 0
    part = u(F.shiftleft(key, top + offset), 64 - width)  # the block alone
    mid = u(F.shiftleft(key, top), 64 - offset) if offset else F.lit(0)  # bits between top and the block
    low_width = 64 - top - offset - width
    low = key.bitwiseAND(F.lit((1 << low_width) - 1)) if low_width else F.lit(0)
    keep = keep - (1 << 64) if keep >= 1 << 63 else keep
    out = F.shiftleft(part, 64 - top - width).bitwiseOR(F.shiftleft(mid, low_width)).bitwiseOR(low)
    return out.bitwiseOR(key.bitwiseAND(F.lit(keep))) if top else out


def trie_links(prints: DataFrame, budget: int) -> DataFrame:
    """Links between rows whose 64-bit ``key`` differs in at most ``budget`` bits.

    ``prints(id, key)`` has distinct ids and should have distinct keys. Gives ``(a, b)``: a forest for
    each node, whose union connects exactly what all pairs would. An empty table has no links.
    """
    starts = [F.struct(F.lit(i).alias("block"), F.lit(w).alias("depth"), _rotated(F.col("key"), o, w).alias("key")) for i, (o, w) in enumerate(_blocks(64, budget + 1))]
    rows = prints.select("id", F.explode(F.array(*starts)).alias("s")).select("id", "s.*")
    top = F.expr("shiftrightunsigned(key, 64 - depth)")
    rows = rows.select(F.xxhash64("block", top).alias("node"), "depth", "key", "id")
    # Nodes over the limit go one level down: their remaining bits have budget+1 blocks as well.
    big = stored(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > NODE_LIMIT).select("node", F.lit(True).alias("big")), "big-nodes")
    few = big.count()
    if few:
        rows = rows.join(F.broadcast(big) if few <= BROADCAST_NODES else big, "node", "left")
        down = []
        for width in sorted({w for _, w in _blocks(64, budget + 1)}):
            for i, (o, w) in enumerate(_blocks(64 - width, budget + 1)):
                down.append((width, i, _rotated(F.col("key"), o, w, width), width + w))
        nest = F.array(F.struct(F.col("node"), F.col("depth"), F.col("key")))
        for width in sorted({x[0] for x in down}):
            parts = F.array(*[F.struct(F.xxhash64("node", F.lit(i), F.shiftrightunsigned(k, 64 - d)).alias("node"), F.lit(d).alias("depth"), k.alias("key")) for w, i, k, d in down if w == width])
            nest = F.when(F.col("big") & (F.col("depth") == width), parts).otherwise(nest)
        rows = rows.select("id", F.explode(nest).alias("s")).select("s.node", "s.depth", "s.key", "id")
    return map_arrow(rows.repartition("node").sortWithinPartitions("node"), _walk_nodes(budget), "a long, b long")


def near_duplicates(docs: DataFrame, max_bits: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, print, component)`` for each row: texts whose fingerprints differ in at most ``max_bits`` bits are linked.

    ``component`` is the smallest id reachable over links. Null and empty texts have fingerprint
    zero and are linked like any other; repeated rows come back repeated; rows with a null id take
    part, and have a null component only if nothing in it has an id. Whole texts count, however long;
    other columns, whatever their names, are not read; an empty table gives no rows.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "simhash")
    heads = stored(rows.groupBy("print").agg(F.min("id").alias("head")), "heads")
    roots = connected_components(trie_links(heads.select(F.col("print").alias("id"), F.col("print").alias("key")), max_bits))
    classes = heads.join(roots.withColumnRenamed("v", "print"), "print", "left").select("print", "head", F.coalesce("root", "print").alias("root"))
    classes = stored(classes, "classes")
    least = classes.groupBy("root").agg(F.min("head").alias("component"))
    of = stored(classes.join(least, "root").select("print", "component"), "class")
    return rows.join(of, "print").select("id", "print", "component")


#: Bits in which the SimHashes of two candidates may differ.
KEY_BITS = 3
#: Minima in a MinHash band; share of the pairs at the similarity itself that may share no band.
BAND_ROWS, MISSED = 5, 1e-3
#: Low bits of a shingle's hash that the first look at a pair goes by; documents looked at together.
LOW_BITS, TOGETHER = 20, 1024
#: Documents that one comparison holds in memory.
GROUP = 512


def bands_for(similarity: float) -> int:
    """Bands of which a pair with that Jaccard similarity shares one but for ``MISSED``; a nearer pair is missed less."""
    return max(1, int(np.ceil(np.log(MISSED) / np.log1p(-min(similarity, 0.999) ** BAND_ROWS))))


def band_keys(h: np.ndarray, bands: int) -> np.ndarray:
    """One hash for each band of a set of hashes: of the set's minima under ``BAND_ROWS`` multipliers."""
    rng = np.random.default_rng(SEED)
    times = rng.integers(0, 1 << 63, bands * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(len(times), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(h), 2048):
        np.minimum(least, (h[i : i + 2048, None] * times).min(0), out=least)
    each = least.reshape(bands, BAND_ROWS)
    z = (each * (each >> np.uint64(32) | np.uint64(1)) + times[:BAND_ROWS] * (each ^ np.uint64(SEED))).sum(1, dtype=np.uint64)
    z += np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(31))


def _sketches(shingle: int, bands: int):
    """(id, text's hash, digest of the shingle set, its SimHash, its band keys, 32-bit hashes of its members)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            same, prints, keyed, sets = [], [], [], []
            for text in b.column(2).to_pylist():
                h = np.unique(hashes(shingles(text.lower().split(), shingle)))
                same.append(xxhash.xxh3_128_digest(h.tobytes()))
                prints.append(majority(h).tobytes())
                keyed.append(band_keys(h, bands).view(np.int64) if len(h) else None)
                sets.append(np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes())
            prints = pa.array(np.frombuffer(b"".join(prints), np.int64))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(same, pa.binary()), prints, pa.array(keyed, pa.list_(pa.int64())), pa.array(sets, pa.binary())], ["id", "hash", "same", "print", "bands", "shingles"])

    return run


def confirmed(sets: list[np.ndarray], similarity: float, queries: int | None = None, comp: np.ndarray | None = None, keys: list[list[int]] | None = None) -> np.ndarray:
    """For each of some sets the first one reachable over pairs with at least that Jaccard similarity.

    The first ``queries`` sets (default: all) are held against all after them, but for those that are
    linked already; sets of one ``comp`` are from the start. With ``keys`` only sets with a key in common are held against each other.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    end = np.cumsum(size)
    begin = end - size
    low = (np.concatenate(sets) if n else np.zeros(0, np.uint32)) & np.uint32((1 << LOW_BITS) - 1)
    table = np.zeros(1 << LOW_BITS, bool)
    forest = Forest(n)
    if comp is not None:
        _, first, which = np.unique(comp, return_index=True, return_inverse=True)
        forest.unite(np.arange(n), first[which])
    if keys is not None:
        of = np.repeat(np.arange(n), [len(k) for k in keys])
        _, key = np.unique(np.array([k for own in keys for k in own], np.int64), return_inverse=True)
        by_key, key_ends = of[np.argsort(key, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(key))]).astype(np.int64)
        own_ends = np.searchsorted(of, np.arange(n + 1))
    for i in range(min(n - 1, n if queries is None else queries)):
        root = forest.roots(np.arange(n))
        rest = np.arange(i + 1, n)
        if keys is not None:
            near = np.zeros(n, bool)
            for k in key[own_ends[i] : own_ends[i + 1]].tolist():
                near[by_key[key_ends[k] : key_ends[k + 1]]] = True
            rest = rest[near[rest]]
        rest = rest[(root[rest] != root[i]) & (np.minimum(size[rest], size[i]) >= similarity * np.maximum(size[rest], size[i]))]
        table[low[begin[i] : end[i]]] = True
        for k in range(0, len(rest), TOGETHER):
            some = rest[k : k + TOGETHER]
            to = np.cumsum(size[some])
            entry = np.repeat(begin[some] - (to - size[some]), size[some]) + np.arange(int(to[-1]))
            hits = np.concatenate([[0], np.cumsum(table[low[entry]])])
            most = np.minimum(hits[to] - hits[to - size[some]], size[i])  # shared shingles at most
            some = some[most * (1 + similarity) >= similarity * (size[some] + size[i]) - 1e-9]
            for j in some.tolist():
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= similarity * (size[i] + size[j] - both) - 1e-9:
                    forest.unite(np.array([i]), np.array([j]))
        table[low[begin[i] : end[i]]] = False
        if not (root != root[0]).any():
            break
    return forest.roots(np.arange(n))


def _confirmed(similarity: float):
    """Rows (bucket, other, comp, v, keys, shingles) sorted by bucket, those that aren't ``other`` first -> links (a, b) of a bucket."""

    def links(held: list[tuple]) -> pa.RecordBatch:
        v, comp = (np.array([x[k] for x in held], np.int64) for k in (2, 1))
        keys = None if held[0][3] is None else [x[3] for x in held]
        root = confirmed([np.frombuffer(x[4], np.uint32) for x in held], similarity, sum(not x[0] for x in held), comp, keys)
        tied = comp[root] != comp
        pairs = np.unique(np.stack([comp[tied], comp[root[tied]]], 1), axis=0)
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for b in batches:
            for name, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if name != bucket:
                    if len(held) > 1:
                        yield links(held)
                    bucket, held = name, []
                held.append(tuple(row))
        if len(held) > 1:
            yield links(held)

    return run


def _links(asked: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between the ``comp`` of confirmed pairs of ``asked(bucket, other, comp, v, keys)``."""
    rows = asked.join(sets, "v").select("bucket", "other", "comp", "v", "keys", "shingles")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "other", "v")
    return map_arrow(rows, _confirmed(similarity), "a long, b long")


def _parts(n) -> Column:
    return F.ceil(n / F.lit(GROUP)).cast("int")


def _dealt(parts, *more) -> Column:
    return F.pmod(F.xxhash64("v", *more), parts).cast("int")


def _every(parts) -> Column:
    return F.explode(F.sequence(F.lit(0), parts - 1))


def _first_looks(candidates: DataFrame, group: DataFrame) -> DataFrame:
    """What to compare first: in groups of candidates that fit one task all pairs of a bucket; in larger ones the first of each bucket with the others."""
    none = F.lit(None).cast("array<bigint>").alias("keys")
    n = group.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    group = group.join(n, "group")
    small = group.where(F.col("n") <= GROUP)
    keyed = candidates.join(small.select("v"), "v").groupBy("v").agg(F.collect_set("bucket").alias("keys"))  # its bands and near prints
    small = small.join(keyed, "v").select(F.xxhash64("group").alias("bucket"), F.lit(False).alias("other"), F.col("v").alias("comp"), "v", "keys")
    star = candidates.join(group.where(F.col("n") > GROUP).select("v"), "v").where("v <> first").select("first", "v").distinct()
    many = star.groupBy("first").agg(_parts(F.count(F.lit(1))).alias("parts"))
    others = star.join(many, "first").select(F.xxhash64("first", _dealt(F.col("parts"))).alias("bucket"), F.lit(True).alias("other"), F.col("v").alias("comp"), "v", none)
    firsts = many.select("first", _every(F.col("parts")).alias("part")).select(F.xxhash64("first", "part").alias("bucket"), F.lit(False).alias("other"), F.col("first").alias("comp"), F.col("first").alias("v"), none)
    return small.unionByName(others).unionByName(firsts)


def _second_looks(candidates: DataFrame, comp: DataFrame) -> DataFrame:
    """What to compare then: in each bucket that is not one component yet, all outside its largest one with all of another.

    Buckets of the same members are one. Both sides are dealt out in parts.
    """
    rows = candidates.select("bucket", "v").distinct().join(comp, "v")
    own = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(F.xxhash64("v"), 32)).alias("x"), F.bit_xor(F.xxhash64("v", F.lit(1))).alias("y"))
    open_ = own.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.sum("x").alias("x"), F.bit_xor("y").alias("y")).where("main.n < n")
    open_ = open_.groupBy("n", "x", "y").agg(F.min(F.struct("bucket", F.col("main.comp").alias("main"), (F.col("n") - F.col("main.n")).alias("outside"))).alias("b"))
    open_ = open_.select("b.bucket", "b.main", _parts(F.col("n")).alias("parts"), _parts(F.col("b.outside")).alias("blocks"))
    rows = rows.join(open_, "bucket")
    outside = rows.where("comp <> main").withColumn("block", _dealt(F.col("blocks"), F.lit(2))).withColumn("part", _every(F.col("parts")))
    every = rows.withColumn("part", _dealt(F.col("parts"))).withColumn("block", _every(F.col("blocks")))
    task = F.xxhash64("bucket", "part", "block").alias("bucket")
    none = F.lit(None).cast("array<bigint>").alias("keys")
    return outside.select(task, F.lit(False).alias("other"), "comp", "v", none).unionByName(every.select(task, F.lit(True).alias("other"), "comp", "v", none))


def _with_roots(roots: DataFrame, name: str) -> DataFrame:
    """``(v, name)`` of all vertices of a forest, roots included."""
    return roots.select("v", F.col("root").alias(name)).unionByName(roots.select(F.col("root").alias("v"), F.col("root").alias(name)).distinct())


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, hash, component, kept)`` of each row: near-duplicates by Jaccard similarity of the ``shingle``-word shingle sets.

    Candidates are linked by the trie self-join of the SimHashes within 3 bits, or share a MinHash
    band of the shingles, as many bands as the similarity asks for. Links between them are confirmed
    on the shingle sets themselves (32-bit hashes), whatever a group's size: each pair of a bucket is
    compared unless it is linked by others. Groups of candidates that fit one task are compared there.
    In larger ones, each bucket's first member is compared with the others, and then, in each bucket
    that is still several components, those outside its largest with all the others, in parts of
    bounded size.

    ``hash`` is the text's xxhash64; ``component`` the smallest id of the group; ``kept`` is true for
    one of the group's texts, that of ``component`` (of several texts of that id, the one of the least
    hash). Null and empty texts, which have no shingles, are one group; null ids are left out; rows of
    one id and different texts are rows of their own; repeated rows come back repeated. A long text's
    shingles are in one task's memory; other columns are not read; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.cast("binary").alias("text")).where("id is not null")
    rows = stored(map_arrow(rows, _sketches(shingle, bands_for(similarity)), "id long, hash long, same binary, print long, bands array<long>, shingles binary"), "sketches")
    heads = rows.groupBy("same").agg(F.min(F.struct("id", "hash", "print", "bands")).alias("head")).select(F.monotonically_increasing_id().alias("v"), "same", "head.*")
    heads = stored(heads, "heads")
    equal = F.array(F.xxhash64("print", F.lit("print")))
    banded = heads.where("bands is not null").select("v", F.explode(F.concat("bands", equal)).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("first")).where("n > 1").select("bucket", "first")
    prints = heads.where("bands is not null").groupBy(F.col("print").alias("key")).agg(F.min("v").alias("id"))
    near = trie_links(prints, KEY_BITS).distinct()
    near = near.select(F.xxhash64("a", "b").alias("bucket"), F.least("a", "b").alias("first"), F.explode(F.array("a", "b")).alias("v"))
    candidates = stored(banded.join(shared, "bucket").select("bucket", "first", "v").unionByName(near), "candidates")
    group = stored(_with_roots(connected_components(candidates.where("v <> first").select(F.col("first").alias("a"), F.col("v").alias("b"))), "group"), "candidate-groups")
    asked = heads.select("v", "id", "hash", "same").join(group.select("v"), "v")
    texts = stored(rows.select("id", "hash", "same", "shingles").join(asked, ["id", "hash", "same"]).groupBy("v").agg(F.min("shingles").alias("shingles")), "sets")
    ids = stored(rows.select("id", "hash", "same"), "ids")
    release(rows)
    links = stored(_links(_first_looks(candidates, group), texts, similarity), "links")
    roots = connected_components(links)
    if not group.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).isEmpty():
        comp = group.select("v").join(roots, "v", "left").select("v", F.coalesce("root", "v").alias("comp"))
        large = group.join(group.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP), "group", "left_semi")
        comp = stored(comp.join(large, "v", "left_semi"), "components")
        more = _links(_second_looks(candidates, comp), texts, similarity)
        roots = connected_components(links.unionByName(more))
    of = heads.select("v", "id", "hash", "same").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    of = stored(of, "class")
    best = of.groupBy("root").agg(F.min(F.struct("id", "hash", "same")).alias("best"))
    of = stored(of.join(best, "root").select("same", F.col("best.id").alias("component"), F.col("best.hash").alias("__hash")), "class")
    return ids.join(of, "same").select("id", "hash", "component", ((F.col("id") == F.col("component")) & (F.col("hash") == F.col("__hash"))).alias("kept"))
