"""Problem 7: encoding a corpus with a public byte-level BPE vocabulary.

Texts are split by the vocabulary's public pattern. Every distinct piece is encoded once per
worker: pieces of like length are laid into one padded numpy matrix of token ids; in each round
every row looks up the ranks of its neighbouring pairs in an open-addressing hash table, merges
its leftmost pair of minimum rank, and is compacted by one column; rows without a mergeable pair
leave the matrix.

Defined results: null and empty texts give an empty list; white space is encoded like any other
text; strings that look like special tokens are ordinary text; lone surrogates are encoded as
U+FFFD. Extra columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docmill.runtime import prepare

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces kept in a worker's memory; beyond this the store starts anew (results don't change).
STORE_PIECES = 400_000
#: Bytes beyond which a single piece is merged with a heap instead of in a matrix (same result).
LONG_PIECE = 2048
#: Cells of one matrix.
CELLS = 4_000_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_MULT = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Hash table (left id, right id) -> merged id, by multiplicative hashing and linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a = ranks.get(token[:cut])
                if a is not None and (b := ranks.get(token[cut:])) is not None:
                    left.append(a), right.append(b), merged.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        values = np.array(merged, np.int32)
        bits = max(4, int(len(keys) * 2 + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, _EMPTY), np.full(1 << bits, -1, np.int32)
        self.probes = 0
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] == _EMPTY
            at = todo[free]
            self.keys[slot[at]] = keys[at]  # of those that share a slot the last one stays
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask
        found = self._find(keys)
        self.values[found] = values

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> self.shift).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != _EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            there = self.keys[slot[open_]]
            open_ = open_[(there != keys[open_]) & (there != _EMPTY)]
        return slot

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merged id of each pair, -1 where the pair doesn't merge."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slot = self._find(keys)
        return np.where(self.keys[slot] == keys, self.values[slot], -1)


class Encoder:
    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.pairs = PairTable(ranks)
        self.split = regex.compile(pattern).findall
        self.reset()

    def merge_all(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        order, start = np.argsort(lengths, kind="stable"), 0
        while start < len(order):  # buckets: at most a quarter longer than the shortest row
            least = int(lengths[order[start]])
            end = int(np.searchsorted(lengths[order], least + least // 4, "right"))
            end = min(end, start + max(1, CELLS // max(1, least + least // 4)))
            self._bucket(pieces, order[start:end], out)
            start = end
        return out

    def _bucket(self, pieces: list[bytes], rows: np.ndarray, out: list[np.ndarray]) -> None:
        n = np.array([len(pieces[i]) for i in rows], np.int64)
        width = int(n.max())
        if width == 0:
            return
        flat = np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)
        m = np.full((len(rows), width), -1, np.int32)
        m[np.arange(width) < n[:, None]] = self.byte_ids[flat]
        # merged[r, c]: id of the pair (c, c + 1); a pair beyond the end has no id
        merged = np.full((len(rows), width), -1, np.int32)
        if width > 1:
            has = np.arange(width - 1) < (n - 1)[:, None]
            merged[:, :-1][has] = self.pairs.lookup(m[:, :-1][has], m[:, 1:][has])
        big = np.int32(np.iinfo(np.int32).max)
        rank = np.where(merged < 0, big, merged)
        while len(rows):
            at = rank.argmin(axis=1)  # the first of equal ranks is the leftmost
            r = np.arange(len(rows))
            best = rank[r, at]
            live = best != big
            for i in np.flatnonzero(~live):
                out[rows[i]] = m[i, : n[i]].copy()
            if not live.any():
                return
            rows, n, at, best = rows[live], n[live], at[live], best[live]
            m, rank = m[live], rank[live]
            width = int(n.max())
            r = np.arange(len(rows))
            m[r, at] = best
            # compaction: every column right of the merged pair moves one to the left
            cols = np.arange(width - 1)
            src = cols + (cols > at[:, None])
            m = np.take_along_axis(m[:, :width], src, axis=1)
            rank = np.take_along_axis(rank[:, :width], src, axis=1)
            n = n - 1
            for c in (at - 1, at):
                ok = np.flatnonzero((c >= 0) & (c + 1 < n))
                gone = np.flatnonzero((c >= 0) & (c + 1 >= n) & (c < width - 1))
                rank[gone, c[gone]] = big
                new = self.pairs.lookup(m[ok, c[ok]], m[ok, c[ok] + 1])
                rank[ok, c[ok]] = np.where(new < 0, big, new)

    def _long(self, piece: bytes) -> np.ndarray:
        """The same merges for one very long piece, with a heap and a linked list: O(n log n)."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        known: dict[tuple[int, int], int] = {}

        def merged(i: int, j: int) -> int:
            pair = (ids[i], ids[j])
            if pair not in known:
                known[pair] = int(self.pairs.lookup(np.array([pair[0]]), np.array([pair[1]]))[0])
            return known[pair]

        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := merged(i, i + 1)) >= 0]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := merged(i, k)) >= 0:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := merged(h, i)) >= 0:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def _number(self, chunks: list[str]) -> None:
        """Encode chunks not yet known and give each the next number."""
        if not chunks:
            return
        words = [self.split(c) for c in chunks]
        fresh = list({w for ws in words for w in ws if w not in self.store})
        raw = [w.encode("utf-8", "replace") for w in fresh]
        short = [i for i, r in enumerate(raw) if len(r) <= LONG_PIECE]
        for i, ids in zip(short, self.merge_all([raw[i] for i in short])):
            self.store[fresh[i]] = ids
        for w, r in zip(fresh, raw):
            if len(r) > LONG_PIECE:
                self.store[w] = self._long(r)
        parts = [self.store[w] for ws in words for w in ws]
        sizes = np.array([sum(len(self.store[w]) for w in ws) for ws in words], np.int64)
        at = len(self.flat)
        self.flat = np.concatenate([self.flat, *parts])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.starts = np.concatenate([self.starts, at + np.cumsum(sizes) - sizes])

    def reset(self) -> None:
        self.store, self.index = {}, _Numbers()
        self.flat, self.sizes, self.starts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each text."""
        if len(self.index) > STORE_PIECES:
            self.reset()
        known, number = len(self.index), self.index.__getitem__
        numbers = [list(map(number, chunks(t))) if t else [] for t in texts]
        self._number(list(itertools.islice(self.index, known, None)))
        per_text = np.fromiter(map(len, numbers), np.int64, len(numbers))
        which = np.fromiter(itertools.chain.from_iterable(numbers), np.int64, int(per_text.sum()))
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.starts[which] - (ends - sizes), sizes)]
        offsets = np.zeros(len(texts) + 1, np.int64)
        offsets[1:] = np.concatenate([[0], ends])[np.cumsum(per_text)]
        return ids, offsets


class _Numbers(dict):
    """Numbers new keys in the order in which they are asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


_ODD_SPACE = re.compile(r"[^\S \n]")


def _regular(text: str) -> bool:
    """No blank stands beside another white space or at an end, and no white space is unusual."""
    return not ("  " in text or "\n " in text or " \n" in text or text[0] == " " or text[-1] == " ") and _ODD_SPACE.search(text) is None


def chunks(text: str) -> list[str]:
    """Cut before every blank that stands alone between two other characters. The pattern never
    joins what stands before such a blank with what follows, so chunks can be encoded apart. Texts
    with other blanks are cut the same way, by a slower pattern."""
    if _regular(text):
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]
    return [x for x in _SOLE.split(text) if x]


#: Before a blank that stands alone between two characters that aren't white space.
_SOLE = re.compile(r"(?<=\S)(?= \S)")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _chunks(texts: pa.Array, chars: int = 4_000_000):
    """Ranges of rows holding about so many characters, so that a batch of long texts stays small."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, s in enumerate(sizes):
        total += int(s)
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row (id_col, ids) for each row of docs. Narrow: no shuffle, two columns read."""
    prepare(docs.sparkSession)
    path = vocabulary or os.environ.get("DOCMILL_VOCABULARY", DEFAULT_VOCABULARY)
    source = docs.select(docs[id_col], docs[text_col])
    kind = source.schema[0].dataType

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in _chunks(texts):
                flat, offsets = enc.encode_batch(texts.slice(lo, hi - lo).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids], ["id", "ids"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def token_counts(docs: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The columns named in keep and n_tokens; 0 for null and empty texts."""
    prepare(docs.sparkSession)
    path = vocabulary or os.environ.get("DOCMILL_VOCABULARY", DEFAULT_VOCABULARY)
    source = docs.select(*keep, docs[text_col].alias("__text"))

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for lo, hi in _chunks(texts):
                _, offsets = enc.encode_batch(texts.slice(lo, hi - lo).to_pylist())
                cols = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(offsets))], [*keep, "n_tokens"])

    schema = T.StructType([*(source.schema[k] for k in keep), T.StructField("n_tokens", T.LongType(), False)])
    return source.mapInArrow(run, schema)
