"""Token counts by pre-tokens: each distinct pre-token is tokenised once in the whole corpus.

A block is some megabytes of documents. One pass turns it into its distinct pre-tokens and, for each
document, how often each occurs (compressed, a row a block). The blocks' pre-tokens are made distinct over the corpus, the pieces of
each are counted, the counts are joined back to the blocks, and a document's tokens are a sum of
frequency times count. No ids are kept. A pre-token that all documents share is one row a block, so no
key is hot; and a block's rows bound every group.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.chunks import BLOCK_BYTES, BLOCK_ROWS, CUTS, Frequencies, cut, per_row, place, portions, ragged, summed, sums, values
from tessera.llm.common import importable, map_arrow, slices, stored

#: Chunks whose pre-tokens a worker keeps, and characters of the longest of these.
CACHE, CACHED_CHARS = 300_000, 64
#: Fixed value: a pattern of pre-tokens that don't go on behind a chunk's begin; what is between them is dropped.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Punctuation behind which such a pattern begins anew if a letter stands before it.
STOPS = ".,;:!?)"
#: The same for printable ASCII, which a byte-level step leaves as it is.
PLAIN = re.compile(WORDS.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9"), re.ASCII)

OWN = "doc_id array<long>, n_bytes array<long>, special array<long>, " + Frequencies.schema
BLOCKS = "block long, words array<string>, " + OWN
COUNTED = "doc_id long, n_bytes long, n_tokens long"


class JsonPieces:
    """Pre-tokens of a ``tokenizers`` file. Strings of added tokens inside a text are tokens, as by default."""

    prefix = ""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens with conditions are not supported")
        said = sorted((t.content for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, said))) if said else None
        self.words = self.lower = False
        self.stops = ""
        self.at = CUTS if self._apart(json.loads(self.tokenizer.to_str())) else ""
        if self.words and not any(re.search(f"[a-zA-Z][{STOPS}]", x) for x in said):
            self.stops = STOPS

    def _apart(self, kind: dict) -> bool:
        """Whether chunks can be tokenised by themselves; else a text is one chunk."""
        first, second = kind.get("normalizer"), kind.get("pre_tokenizer") or {}
        steps = first.get("normalizers", [first]) if first else []
        plain = all(s["type"] in ("NFC", "NFD", "Lowercase") or s == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} for s in steps)
        parts = second.get("pretokenizers", [second])
        bytewise = parts[-1].get("type") == "ByteLevel" and not parts[-1]["add_prefix_space"]
        split = len(parts) == 2 and parts[0].get("type") == "Split" and parts[0]["pattern"].get("Regex") == WORDS and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and not parts[1]["use_regex"]
        self.words, self.lower = plain and bytewise and split, any(s["type"] == "Lowercase" for s in steps)
        return plain and bytewise and (split or len(parts) == 1 and parts[0]["use_regex"])

    def bare(self, chunks: pa.StringArray) -> pa.StringArray:
        """Chunks without what the pattern drops."""
        return pc.utf8_ltrim(chunks, CUTS) if self.words else chunks

    def plain(self, chunks: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """Which chunks are one pre-token each, and that."""
        if not self.words:
            return chunks, np.zeros(len(chunks), bool)
        return pc.ascii_lower(chunks) if self.lower else chunks, pc.match_substring_regex(chunks, "^[a-zA-Z]+$").to_numpy(zero_copy_only=False)

    def parts(self, chunk: str) -> tuple[tuple[str, ...], int]:
        """A chunk's pre-tokens, and how many added tokens stand between them."""
        own = self.special.split(chunk) if self.special else [chunk]
        if self.words and len(own) == 1 and chunk.isascii() and chunk.strip(CUTS).isprintable():
            return tuple(PLAIN.findall(chunk.lower() if self.lower else chunk)), 0
        normal, pre = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        found: list[str] = []
        for x in own:
            x = normal.normalize_str(x) if normal and x else x
            found += ([w for w, _ in pre.pre_tokenize_str(x)] if pre else [x]) if x else []
        return tuple(found), len(own) - 1

    def count(self, word: str) -> int:
        return len(self.tokenizer.model.tokenize(word))


class ModelPieces:
    """Pre-tokens of a ``sentencepiece`` model: chunks with the blank before them, or whole texts if the model normalises."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = all(self.model.normalize(x) == "▁" + x.replace(" ", "▁") for x in ("a  b ", "ﬁ　\n x", "é"))
        inner = {c for p in pieces for c in re.findall(r"(?<=[^\s▁])[▁\n]", p)} if plain else {"▁", "\n"}
        self.at = "".join(c for c in CUTS if c.replace(" ", "▁") not in inner)
        self.prefix, self.stops = " " if plain else "", ""

    def bare(self, chunks: pa.StringArray) -> pa.StringArray:
        return chunks

    def plain(self, chunks: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        return chunks, np.ones(len(chunks), bool)

    def count(self, word: str) -> int:
        if not self.prefix:
            return len(self.model.encode(word))
        return len(self.model.encode("a" + word)) - 1  # the blank before a text is in the chunk; "a" takes the one that the model adds


_PIECES: dict[str, JsonPieces | ModelPieces] = {}


def pieces(path: str) -> JsonPieces | ModelPieces:
    """The tokenizer of this worker."""
    if path not in _PIECES:
        _PIECES[path] = ModelPieces(path) if path.endswith(".model") else JsonPieces(path)
    return _PIECES[path]


_PARTS: dict[str, dict[str, tuple[tuple[str, ...], int]]] = {}


def _frequencies(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, kept = pieces(path), _PARTS.setdefault(path, {})
        block = first_block(TaskContext.get().partitionId())
        for b in slices(batches, BLOCK_ROWS, BLOCK_BYTES):
            special, parts, heard, base = np.zeros(b.num_rows, np.int64), [(np.empty(0, np.int64),) * 3], [pa.array([], pa.string())], 0
            for rows, texts in portions(b.column(1), own.at):
                chunks, ends = cut(texts, own.at, own.stops)
                coded = own.bare(chunks).dictionary_encode()
                words, one = own.plain(coded.dictionary)
                found, other = [], np.flatnonzero(~one)
                for chunk in coded.dictionary.take(pa.array(other)).to_pylist():
                    got = kept.get(chunk)
                    if got is None:
                        got = own.parts(chunk)
                        if len(chunk) <= CACHED_CHARS and len(kept) < CACHE:
                            kept[chunk] = got
                    found.append(got)
                n, begin, extra = one.astype(np.int64), np.cumsum(one) - 1, np.zeros(len(one), np.int64)
                n[other] = [len(got) for got, _ in found]
                begin[other] = int(one.sum()) + np.cumsum(n[other]) - n[other]
                extra[other] = [s for _, s in found]
                heard += [words.filter(pa.array(one)), pa.array([w for got, _ in found for w in got], pa.string())]
                row, chunk, freq = per_row(coded.indices.to_numpy(), ends, len(one))
                np.add.at(special, rows[row], freq * extra[chunk])
                size = n[chunk]
                parts.append((np.repeat(rows[row], size), base + ragged(begin[chunk], size), np.repeat(freq, size)))
                base += len(heard[-2]) + len(heard[-1])
            row, pid, freq = (np.concatenate(x) for x in zip(*parts, strict=True))
            coded = pa.concat_arrays(heard).dictionary_encode()
            words = coded.dictionary
            key, freq = summed(row * max(1, len(words)) + coded.indices.to_numpy()[pid], freq)
            row, pid = key // max(1, len(words)), key % max(1, len(words))
            sizes = np.diff(values(b.column(1))[1])
            sizes -= len(own.prefix) * (sizes > 0)
            words = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            docs = [whole(b.column(0)), whole(pa.array(sizes)), whole(pa.array(special)), *Frequencies.columns(row, pid, freq, b.num_rows)]
            yield pa.record_batch([pa.array([block]), words, *docs], ["block", "words", "doc_id", "n_bytes", "special", "cells", "n_keys", "keys", "freqs"])
            block += 1

    return run


def first_block(partition: int) -> int:
    """The number of a task's first block. Blocks have 31 bits, so that a block and a key in it are one number."""
    if partition >= 1 << 20:
        raise ValueError("over a million partitions: read larger ones")
    return partition << 11


def by_block(blocks: DataFrame, found: DataFrame, fn: Callable[[dict, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` of each block's row and what the corpus says of its keys, ``found(cell, ...)``; both are a block's size."""
    importable(blocks.sparkSession)
    found = found.withColumn("of", F.shiftright("cell", 32))

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        return fn(block.to_pylist()[0], found)

    return blocks.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(run, schema)


def cell_of(block: str, pid: str) -> Column:
    return F.shiftleft(F.col(block), 32).bitwiseOR(F.col(pid).cast("long")).alias("cell")


def by_key(found: pa.Table, column: str) -> np.ndarray:
    """A column in the order of the keys."""
    pid = found.column("cell").to_numpy() & 0xFFFFFFFF
    out = np.zeros(int(pid.max(initial=-1)) + 1, np.int64)
    out[pid] = found.column(column).to_numpy()
    return out


def _totals(block: dict, found: pa.Table) -> pa.Table:
    keys, freqs, ends = Frequencies.of(block)
    total = sums(by_key(found, "n")[keys] * freqs, ends) + np.array(block["special"], np.int64)
    return pa.table([pa.array(block["doc_id"], pa.int64()), pa.array(block["n_bytes"], pa.int64()), pa.array(total)], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``doc_id, n_bytes, n_tokens``, the tokens as the tokenizer's library gives
    them for the whole text without begin, end or padding.

    Null text is as empty: no bytes, no tokens. Null ids and repeated rows are documents of their own; other
    columns, whatever their names, are not read; an empty table gives no rows. A text longer than
    ``PORTION`` is worked on in portions, cut where chunks begin. Tokenizers whose chunks depend on each
    other are given whole texts.
    """
    path = place(tokenizer)
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = F.when(text != "", F.concat(F.lit(pieces(path).prefix), text)).otherwise("") if pieces(path).prefix else text
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    blocks = stored(map_arrow(rows, _frequencies(path), BLOCKS), "blocks")
    words = blocks.select("block", F.posexplode("words").alias("pid", "word")).select(cell_of("block", "pid"), "word")

    @F.arrow_udf("long")
    def count(word: pa.Array) -> pa.Array:
        own = pieces(path)
        return pa.array([own.count(w) for w in word.to_pylist()], pa.int64())

    counted = words.select("word").distinct().select("word", count("word").alias("n"))
    found = words.join(counted, "word").select("cell", "n")
    return by_block(blocks.drop("words"), found, _totals, COUNTED)
