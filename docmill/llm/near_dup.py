"""Problem 5: groups of records with small edits, by the pigeonhole principle on bits.

A page is a vector of bits, one for each three words in a row. Two pages of n and m bits are alike if at least
o = ceil((n + m) / 3) bits are common, so at most n - o bits of the first are missing in the second. In the general
principle bits are grouped into partitions with an allowance T_i >= -1 each, sum(T_i + 1) = n - o + 1 + EXTRA, and
T_i + 1 bits of partition i are probed. Here each bit is a partition of its own and the allowances follow one order of
all bits, the rarest first: a page probes its first n - o + 1 + EXTRA bits, and pages alike share at least
min(EXTRA + 1, o) of the bits that both probe. As the order is one and the same for all pages, only probed bits are
stored. Partitions of correlated bits (those that share their rarest word), with allowances from dynamic programming
for each page, were built and measured: they break that order, so that a page has to be met in all its bits, which
gives about twenty times as many meetings and more than the disk that is to be had (figures in the README). Of the
grouping what helps is kept: bits that share a rare word go to one task, where their meetings are counted together.
Candidates that share enough bits are verified on their whole sets.

Counts are estimated by arrays of counters, sized by the number of pages up to a fixed bound; a coarser estimate costs
time but loses nothing. A bit of more than HOT pages is dealt to several tasks as pairs of blocks of its pages.
Equal word sequences are one class and are probed once. Numbers of papers are compared within equal contractor, date
and amount; where such a group holds many different numbers they are cut into segments of which one must be equal.

Defined results: null texts and pages under MIN_WORDS words take no part; repeated rows of a page
count once; null keys take no part; equal numbers count as alike.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.runtime import cut, prepare, release

MIN_WORDS, THRESHOLD = 30, 0.5
#: Probed bits beyond the least number.
EXTRA = 4
#: log2 of the counters of bits (least and most) and of words.
SKETCH_BITS, WORD_BITS = (14, 26), 18
#: Counters that go through one task at a time, and their greatest value.
CHUNK, FULL = 1 << 16, 65_535
#: Pages of a partition up to which its bits go to one task together.
WIDE = 8192
#: Pages of one bit up to which they are paired in one task; and blocks that a bit's pages are dealt to, at most.
HOT, MOST_BLOCKS = 4096, 64
#: Different numbers in one group up to which they are compared directly.
WINDOW = 48

_WORDS = re.compile(r"[^\W_]+").findall
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        self[word] = h
        return h


_hash = _Hashes().__getitem__


def words_of(text: str) -> tuple[int, np.ndarray] | None:
    """(signature of the word sequence, hashes of the words); None for too few words."""
    words = _WORDS(text.lower())
    if len(words) < MIN_WORDS:
        return None
    h = np.fromiter(map(_hash, words), np.uint64, len(words))
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True), h


def threes(h: np.ndarray) -> np.ndarray:
    """Hashes of all three words in a row."""
    x = h[:-2]
    for nxt in (h[1:-1], h[2:]):
        x = (x ^ (x >> _B)) * _A + nxt
    x = (x ^ (x >> _B)) * _A
    return x ^ (x >> np.uint64(32))


def bits_of(text: str) -> tuple[int, np.ndarray] | None:
    """(signature of the word sequence, sorted hashes of the distinct threes); None for too few words."""
    got = words_of(text)
    return None if got is None else (got[0], np.unique(threes(got[1])))


def common_least(n, m):
    """Common bits that two sets of n and m bits need: ceil((n + m) t / (1 + t)) for t = 1/2."""
    return (n + m + 2) // 3


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each) of a column of lists."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(len(column)), sizes)


def _page_bits(column: pa.Array, words: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(row, bit) of the distinct bits of each row, in that order; with counters of words also the hash of the
    rarest of the three words, the least one of equally rare ones."""
    h, row = _flat(column)
    same = row[:-2] == row[2:]
    x, at = threes(h)[same], row[:-2][same]
    order = np.lexsort((x, at))
    x, at = x[order], at[order]
    first = np.r_[True, (x[1:] != x[:-1]) | (at[1:] != at[:-1])] if len(x) else np.zeros(0, bool)
    if words is None:
        return at[first], x[first]
    mask = np.uint64(len(words) - 1)
    count = words[(h & mask).astype(np.int64)]
    rare, least = h[:-2], count[:-2]
    for k in (1, 2):
        other, c = h[k : len(h) - 2 + k], count[k : len(h) - 2 + k]
        better = (c < least) | (c == least) & (other < rare)
        rare, least = np.where(better, other, rare), np.where(better, c, least)
    return at[first], x[first], rare[same][order][first]


def _counters(pages: DataFrame, log_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Counters of the pages of each bit and of each word, up to FULL; of 2 ** log_bits and 2 ** WORD_BITS entries.
    As many tasks as there are cores send theirs, whatever the number of splits."""
    sizes = (1 << log_bits, 1 << WORD_BITS)

    def run(batches):
        totals = [np.zeros(n, np.uint32) for n in sizes]
        for b in batches:
            if not b.num_rows:
                continue
            h, row = _flat(b.column(0))
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            for total, x in zip(totals, (_page_bits(b.column(0))[1], h[np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]])):
                total += np.bincount((x & np.uint64(len(total) - 1)).astype(np.int64), minlength=len(total)).astype(np.uint32)
        for kind, total in enumerate(totals):
            total = np.minimum(total, FULL).astype(np.uint16)
            for k in range(0, len(total), CHUNK):
                if total[k : k + CHUNK].any():
                    yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([k // CHUNK], pa.int32()), pa.array([total[k : k + CHUNK].tobytes()], pa.binary())], ["kind", "k", "c"])

    def merge(key, t):  # a part of every task's counters
        total = 0
        for c in t.column("c"):
            total = np.minimum(np.frombuffer(c.as_py(), np.uint16).astype(np.uint32) + total, FULL)
        return pa.table({"kind": pa.array([key[0].as_py()], pa.int32()), "k": pa.array([key[1].as_py()], pa.int32()), "c": pa.array([total.astype(np.uint16).tobytes()], pa.binary())})

    few = pages.select("h").coalesce(max(1, pages.sparkSession.sparkContext.defaultParallelism))
    out = [np.zeros(n, np.uint16) for n in sizes]
    for r in few.mapInArrow(run, "kind int, k int, c binary").groupBy("kind", "k").applyInArrow(merge, "kind int, k int, c binary").collect():
        c = np.frombuffer(bytes(r.c), np.uint16)
        out[r.kind][r.k * CHUNK : r.k * CHUNK + len(c)] = c
    return out[0], out[1]


def page_words(pages: DataFrame, key: str = "page_hash", text: str = "text") -> DataFrame:
    """(key, sig, h): the class of equal word sequences and the words of each page that takes part."""
    prepare(pages.sparkSession)

    def run(batches):
        for b in batches:
            ids, sigs, words = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if t and (x := words_of(t)) is not None:
                    ids.append(i)
                    sigs.append(x[0])
                    words.append(x[1])
            values = np.concatenate(words).view(np.int64) if words else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, words)]), pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(sigs, pa.int64()), lists], ["key", "sig", "h"])

    kind = dict(pages.dtypes)[key]
    source = pages.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    return source.mapInArrow(run, f"key {kind}, sig bigint, h array<bigint>")


#: Pairs of one bit that are looked at in one go.
BLOCK_PAIRS = 2_000_000


def _met(sig: np.ndarray, n: np.ndarray, rank: np.ndarray, block: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Of pairs of rows those of different pages where the bit is among both pages' first bits for a partner of that
    size; with the number of met bits that makes them candidates."""
    p, q = n[left], n[right]
    least = common_least(p, q)
    ok = (rank[left] <= p - least + EXTRA) & (rank[right] <= q - least + EXTRA) & (2 * p >= q) & (2 * q >= p) & (sig[left] != sig[right])
    # pairs within a block belong to the cell of that block alone
    ok &= (block[left] % 4 < 2) | (block[left] != block[right])
    a, b = sig[left[ok]], sig[right[ok]]
    return np.minimum(a, b), np.maximum(a, b), np.minimum(EXTRA + 1, least[ok])


def _meetings(batches):
    """Rows (bit, cell, sig, n, rank, block), those of a bit and cell side by side, to pairs of pages that meet in the
    bit, with counts. A run of rows of one cell is paired in parts, so it needs no more memory than its rows."""
    held: list[np.ndarray] = []

    def flush(rows: np.ndarray):
        bit, cell, sig, n, rank, block = rows
        new = np.r_[True, (bit[1:] != bit[:-1]) | (cell[1:] != cell[:-1])]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(bit)])
        ends = (starts + sizes)[np.cumsum(new) - 1]
        each = ends - np.arange(len(bit)) - 1  # a row is paired with those after it
        rows_left = np.flatnonzero(each)
        total = np.cumsum(each[rows_left])
        lo = 0
        while lo < len(rows_left):
            # as many rows as make BLOCK_PAIRS pairs, one of a longer run by itself
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + BLOCK_PAIRS, side="right")))
            some = rows_left[lo:hi]
            k = each[some]
            left = np.repeat(some, k)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(k) - k, k)
            yield _met(sig, n, rank, block, left, right)
            lo = hi

    def table(a: np.ndarray, b: np.ndarray, least: np.ndarray):
        # counted here before the shuffle
        order = np.lexsort((b, a))
        a, b, least = a[order], b[order], least[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, np.int64)
        c = np.diff(np.r_[first, len(a)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(c), pa.array(least[first].astype(np.int32))], ["sig_a", "sig_b", "c", "least"])

    def out(rows):
        parts, size = [], 0
        for x in flush(rows):
            parts.append(x)
            size += len(x[0])
            if size > BLOCK_PAIRS:
                yield table(*(np.concatenate(c) for c in zip(*parts)))
                parts, size = [], 0
        if parts:
            yield table(*(np.concatenate(c) for c in zip(*parts)))

    for b in batches:
        cols = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)])
        held.append(cols)
        if sum(x.shape[1] for x in held) < 400_000:
            continue
        rows = np.concatenate(held, axis=1)
        last = rows.shape[1] - int(np.argmax((rows[0, ::-1] != rows[0, -1]) | (rows[1, ::-1] != rows[1, -1])))
        if last == rows.shape[1] and (rows[0, 0] == rows[0, -1] and rows[1, 0] == rows[1, -1]):
            last = 0  # all one cell, which may go on in the next batch
        held = [rows[:, last:]]
        if last:
            yield from out(rows[:, :last])
    if held:
        rows = np.concatenate(held, axis=1)
        if rows.shape[1]:
            yield from out(rows)


def alike_classes(words: DataFrame, made: list[DataFrame]) -> DataFrame:
    """(sig_a, sig_b): classes of pages that are alike, each pair once, with sig_a < sig_b. words: as page_words; made
    gets the tables that the result is read from."""
    spark = prepare(words.sparkSession)
    reps = cut(words.select("sig", "h").dropDuplicates(["sig"]))
    made.append(reps)
    pages = reps.count()
    if not pages:
        return reps.select(F.col("sig").alias("sig_a"), F.col("sig").alias("sig_b"))
    log_bits = int(np.clip(np.ceil(np.log2(pages * 128)), *SKETCH_BITS))
    counters = spark.sparkContext.broadcast(_counters(reps, log_bits))

    mask = np.uint64(len(counters.value[0]) - 1)

    def probe(batches):
        bit_count, word_count = counters.value
        for b in batches:
            if not b.num_rows:
                continue
            sig = b.column(0).to_numpy(zero_copy_only=False)
            row, bit, word = _page_bits(b.column(1), word_count)
            count = bit_count[(bit & mask).astype(np.int64)].astype(np.int64)
            held = word_count[(word & np.uint64(len(word_count) - 1)).astype(np.int64)]
            n = np.bincount(row, minlength=b.num_rows)
            alone = np.bincount(row[count < 2], minlength=b.num_rows)
            order = np.lexsort((bit, count, row))
            row, bit, word, count, held = row[order], bit[order], word[order], count[order], held[order]
            rank = np.arange(len(row)) - (np.cumsum(n) - n)[row]
            # a bit counted once is in no other page; a page of more of them than it may miss for its smallest partner is like no other
            some = (count > 1) & (rank < n[row] - (n[row] + 1) // 2 + 1 + EXTRA) & (alone <= n // 2)[row]
            row, bit, word, count, held, rank = row[some], bit[some], word[some], count[some], held[some], rank[some]
            # bits that share a rare word go together, unless it is in too many pages
            place = np.where(held < WIDE, word, bit)
            blocks = np.minimum(MOST_BLOCKS, -(-count // HOT))
            mine = np.where(blocks > 1, (sig[row].view(np.uint64) % blocks.astype(np.uint64)).astype(np.int64), 0)
            # a row goes to the cell of its page's block with each block; pages of one block have one cell
            at = np.repeat(np.arange(len(row)), blocks)
            with_ = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            lo, hi = np.minimum(mine[at], with_), np.maximum(mine[at], with_)
            kind = np.where(blocks[at] == 1, 0, np.where(lo == hi, 1, 2))
            yield pa.RecordBatch.from_arrays(
                [pa.array(place[at].view(np.int64)), pa.array(bit[at].view(np.int64)), pa.array((lo * MOST_BLOCKS + hi).astype(np.int32)), pa.array(sig[row[at]]), pa.array(n[row[at]].astype(np.int32)), pa.array(rank[at].astype(np.int32)), pa.array((mine[at] * 4 + kind).astype(np.int32))],
                ["place", "bit", "cell", "sig", "n", "rank", "block"],
            )

    probes = reps.mapInArrow(probe, "place bigint, bit bigint, cell int, sig bigint, n int, rank int, block int")
    shared = probes.repartition("place", "cell").sortWithinPartitions("place", "cell", "bit").select("bit", "cell", "sig", "n", "rank", "block").mapInArrow(_meetings, "sig_a bigint, sig_b bigint, c int, least int")
    counted = shared.groupBy("sig_a", "sig_b").agg(F.sum("c").alias("c"), F.max("least").alias("least")).where("c >= least")
    candidates = cut(counted.select("sig_a", "sig_b"))
    made.append(candidates)

    def verify(batches):
        for b in batches:
            (row_p, p), (row_q, q) = _page_bits(b.column(2)), _page_bits(b.column(3))
            row, bit = np.r_[row_p, row_q], np.r_[p, q]
            order = np.lexsort((bit, row))
            row, bit = row[order], bit[order]
            twice = (row[1:] == row[:-1]) & (bit[1:] == bit[:-1])
            common = np.bincount(row[1:][twice], minlength=b.num_rows)
            union = np.bincount(row, minlength=b.num_rows) - common
            yield b.filter(pa.array(common >= THRESHOLD * union)).select(["sig_a", "sig_b"])

    pairs = candidates.join(reps.select(F.col("sig").alias("sig_a"), F.col("h").alias("p")), "sig_a").join(reps.select(F.col("sig").alias("sig_b"), F.col("h").alias("q")), "sig_b")
    return pairs.select("sig_a", "sig_b", "p", "q").mapInArrow(verify, "sig_a bigint, sig_b bigint")


def _ordered(df: DataFrame, x: str, y: str, field: str) -> DataFrame:
    a, b = F.col(x).cast("string"), F.col(y).cast("string")
    return df.select(F.lit(field).alias("field"), F.least(a, b).alias("key_a"), F.greatest(a, b).alias("key_b"))


def alike_pages(pages: DataFrame, key: str = "page_hash", text: str = "text") -> DataFrame:
    """(field, key_a, key_b): pages alike; classes of equal pages are spread out to their members."""
    words = cut(page_words(pages, key, text))
    classes = words.select("key", "sig").distinct()
    made: list[DataFrame] = []
    links = cut(alike_classes(words, made))
    release(*made)
    a = classes.select(F.col("sig").alias("sig_a"), F.col("key").alias("x"))
    b = classes.select(F.col("sig").alias("sig_b"), F.col("key").alias("y"))
    across = links.join(a, "sig_a").join(b, "sig_b").select("x", "y")
    within = a.join(b, F.col("sig_a") == F.col("sig_b")).where("x < y").select("x", "y")
    return _ordered(across.unionByName(within), "x", "y", "ocr_cache.text")


def _number_pieces(number: str, stored: bool) -> list[str]:
    """Keys of which two numbers within a quarter of the longer one's length share at least one:
    the longer one's floor(L / 4) + 1 segments, and where they may stand in the shorter one."""
    out = set()
    n = len(number)
    for size in [n] if stored else range(n, n * 4 // 3 + 1):
        slips = size // 4
        step, more = divmod(size, slips + 1)
        at = 0
        for k in range(slips + 1):
            width = step + (k >= slips + 1 - more)
            for pos in [at] if stored else range(max(0, at - slips), min(n - width, at + slips) + 1):
                out.add(f"{size}|{k}|{number[pos : pos + width]}")
            at += width
    return sorted(out)


def alike_numbers(history: DataFrame) -> DataFrame:
    """(field, key_a, key_b): papers of equal contractor, date and amount whose numbers are within a
    quarter of the longer one's length. Equal numbers are one class until the last join."""
    prepare(history.sparkSession)
    by = ["contractor_inn", "document_date", "total_amount"]
    rows = history.select("id", "document_number", *by).dropna()
    # in a group of one nothing can be alike
    many = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("document_number").alias("numbers")).where("n > 1")
    rows = cut(rows.join(many.drop("n"), by).withColumn("g", F.xxhash64(*by)))
    numbers = rows.select("g", *by, "document_number", "numbers").distinct()
    left = numbers.withColumnRenamed("document_number", "x")
    right = numbers.drop("numbers").withColumnRenamed("document_number", "y")
    narrow = left.where(F.col("numbers") <= WINDOW).join(right, ["g", *by]).select("g", *by, "x", "y")
    wide = numbers.where(F.col("numbers") > WINDOW)
    stored_keys = F.udf(lambda s: _number_pieces(s, True), "array<string>", useArrow=True)
    probe_keys = F.udf(lambda s: _number_pieces(s, False), "array<string>", useArrow=True)
    stored = wide.select("g", *by, F.col("document_number").alias("y"), F.explode(stored_keys("document_number")).alias("piece"))
    probing = wide.select("g", *by, F.col("document_number").alias("x"), F.explode(probe_keys("document_number")).alias("piece"))
    broad = probing.join(stored, ["g", *by, "piece"]).select("g", *by, "x", "y").distinct()
    pairs = narrow.unionByName(broad).where("x <> y")
    d, longer = F.levenshtein("x", "y"), F.greatest(F.length("x"), F.length("y"))
    close = pairs.select("g", *by, F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct().where(d * 4 <= longer)
    a = rows.select("g", *by, F.col("document_number").alias("x"), F.col("id").alias("k"))
    b = rows.select("g", *by, F.col("document_number").alias("y"), F.col("id").alias("l"))
    across = close.join(a, ["g", *by, "x"]).join(b, ["g", *by, "y"]).select("k", "l")
    within = a.join(b.withColumnRenamed("y", "x"), ["g", *by, "x"]).where("k < l").select("k", "l")
    return _ordered(across.unionByName(within), "k", "l", "history.document_number")
