"""Problem 6: new batches against everything accepted, by multi-key sorted-neighbourhood runs.

What was accepted lies in a folder as sorted runs. An entry stands under two sort keys: its content hash, and the
digits of its file name in order, then the name's comparable form. The keys of either kind are parted into ranges, whose
bounds are kept with the runs; a run is a table sorted within each range. A batch is keyed once, sorted and merged in as
a further run. It is compared in one sorted pass over its own ranges, of which no others are read: a window of entries
of equal hash, or of equal digits, stands around each new record. Several batches that wait may be accepted at once; an
item then also sees the waiting items of smaller item_id. When more than MAX_RUNS runs have come together they are
merged into one, and the bounds are drawn anew.

A window wider than WINDOW names isn't compared pair by pair: its names are cut into segments, of which one must be
equal if two names differ by at most two slips, and only names with an equal segment at nearly the same place are
compared. So no candidate is lost or capped.

Defined results: null or blank hashes and names without digits match nothing; of rows with equal keys each later one
is found; extra columns are ignored; an empty batch or history is fine.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.lookalikes import INVISIBLE, TO_CYRILLIC
from docmill.runtime import cut, prepare, release, shared_folder

WINDOW = 64
MAX_RUNS = 8
#: Entries of a key range, about, the most ranges of a kind, and keys looked at for each bound.
RANGE_ENTRIES, MOST_RANGES, KEYS_A_BOUND = 32_768, 4096, 32
SLIPS = 2
#: A slip that swaps two letters can touch two segments, so five hold one that is whole.
SEGMENTS = 2 * SLIPS + 1

_ALIKE = str.maketrans({**TO_CYRILLIC, **{chr(c): None for c in INVISIBLE}})
#: Words for a copy.
_MARKS = ["копия", "копії", "копія", "copy", "duplicate", "дубликат", "kopie"]


def _same_form(text: str) -> str:
    text = unicodedata.normalize("NFKC", text)
    return unicodedata.normalize("NFC", text.translate(_ALIKE).casefold())


_MARK = "|".join(re.escape(_same_form(m)) for m in _MARKS)
_GAP = r"[\s_\-–—.]*"
_EXTENSION = re.compile(r"\s*\.(?=[^.]*[^\W\d_])[^\W_]{1,5}\s*$")
_TAIL = re.compile(rf"{_GAP}(?:\(\s*\d{{1,2}}\s*\)|(?<![^\W_])(?:{_MARK}))[\s_]*$")
_HEAD = re.compile(rf"^[\s_]*(?:(?:{_MARK})(?:[\s_]+{_same_form('of')})?(?=[\s_\-–—])|\(\s*\d{{1,2}}\s*\)){_GAP}")
_BLANKS = re.compile(r"[\s_]+")
_DIGITS = re.compile(r"\d")


def name_key(name: str | None) -> tuple[str, str]:
    """(digits in order, comparable form) of a file name; ("", "") where the name says nothing."""
    if not name:
        return "", ""
    text = _EXTENSION.sub("", _same_form(name))
    while True:
        shorter = _HEAD.sub("", _TAIL.sub("", text))
        if shorter == text:
            break
        text = shorter
    text = _BLANKS.sub("", text)
    digits = "".join(_DIGITS.findall(text))
    return (digits, text) if digits else ("", "")


def osa(a: str, b: str, most: int) -> bool:
    """At most so many inserted, dropped, replaced or swapped neighbouring characters."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    lo, x, y = 0, len(a), len(b)
    while lo < x and lo < y and a[lo] == b[lo]:
        lo += 1
    while x > lo and y > lo and a[x - 1] == b[y - 1]:
        x, y = x - 1, y - 1
    a, b = a[lo:x], b[lo:y]  # what is alike at the ends costs nothing
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return False
        before, last = last, row
    return last[-1] <= most


def _two_slips(a: str, b: str):
    return F.udf(lambda x, y: osa(x, y, SLIPS), "boolean", useArrow=True)(a, b)


_ENTRY = "kind string, part int, key string, form string, ord bigint"
Bounds = dict[str, list[str]]


def keyed(df: DataFrame, order: str | None, bounds: Bounds | None = None, combine: bool = False, name: str = "original_filename", file_hash: str = "file_hash") -> DataFrame:
    """(kind, part, key, form, ord): an entry of each row for its hash (kind h) and for its name (kind n), with the key
    range it belongs to; ord is -1 where everything came before the batches. With combine, equal entries of a batch
    of rows are one, with the smallest ord."""
    prepare(df.sparkSession)
    ord_ = F.col(order).cast("bigint") if order else F.lit(-1).cast("bigint")
    source = df.select(ord_.alias("ord"), F.lower(F.trim(F.col(file_hash))).alias("hash"), F.col(name).alias("name"))
    bounds = bounds or {}

    def run(batches):
        for b in batches:
            rows: dict[tuple, int] = {}
            every = []
            for o, h, x in zip(*(b.column(i).to_pylist() for i in range(3))):
                digits, form = name_key(x)
                for at in ([("h", h, "")] if h else []) + ([("n", digits, form)] if digits else []):
                    if combine:
                        rows[at] = min(o, rows.get(at, o))
                    else:
                        every.append((*at, o))
            if combine:
                every = [(*at, o) for at, o in rows.items()]
            kinds, keys, forms, ords = ([r[k] for r in every] for k in range(4))
            parts = [bisect.bisect_right(bounds.get(k, ()), key) for k, key in zip(kinds, keys)]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(parts, pa.int32()), pa.array(keys, pa.string()), pa.array(forms, pa.string()), pa.array(ords, pa.int64())], ["kind", "part", "key", "form", "ord"])

    return source.mapInArrow(run, _ENTRY)


def _windows(batches):
    """Entries in the order of kind, key and form to (kind, key, form, first): for each new entry the smallest ord in
    its window that is the same or near; kind w with a key whose window is too wide to be compared here."""
    out: list[tuple] = []
    at, window, wide = None, {}, False

    def close():
        kind, key = at
        if wide:
            if any(new for _, new in window.values()):
                out.append(("w", key, None, None))
            return
        for form, (first, new) in window.items():
            if new:
                out.append((kind, key, form, min([first] + [o for f, (o, _) in window.items() if o < first and osa(form, f, SLIPS)])))

    def table():
        rows, out[:] = list(out), []
        cols = list(zip(*rows)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64()))], ["kind", "key", "form", "first"])

    for b in batches:
        for kind, key, form, o, new in zip(*(b.column(i).to_pylist() for i in range(5))):
            if at != (kind, key):
                if at is not None:
                    close()
                at, window, wide = (kind, key), {}, False
            have = window.get(form)
            if have is not None:
                window[form] = (min(o, have[0]), new or have[1])
            elif len(window) < WINDOW or new and not any(n for _, n in window.values()):
                window[form] = (o, new)
                wide = wide or len(window) > WINDOW
            else:
                wide = True
        if out:
            yield table()
    if at is not None:
        close()
    yield table()


class AcceptedRuns:
    """Sorted runs in a shared folder; opened again, it goes on with the runs that lie there."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = prepare(spark)
        self.folder = folder or f"{shared_folder(spark)}/accepted-{uuid.uuid4().hex}"
        self.bounds: Bounds = {}
        self.runs: list[str] = []
        names = self._names()
        if "bounds" in names:
            for r in self.spark.read.parquet(f"{self.folder}/bounds").orderBy("kind", "bound").collect():  # of the order of the ranges
                self.bounds.setdefault(r.kind, []).append(r.bound)
        self.runs = [f"{self.folder}/{n}" for n in sorted(names) if n.startswith("run-") and self._exists(f"{self.folder}/{n}/_SUCCESS")]

    def _path(self, at: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, at: str) -> bool:
        p, fs = self._path(at)
        return fs.exists(p)

    def _names(self) -> list[str]:
        p, fs = self._path(self.folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _delete(self, at: str) -> None:
        p, fs = self._path(at)
        fs.delete(p, True)

    def _draw(self, keys: DataFrame, entries: int) -> None:
        """Bounds of the ranges from (kind, key): the quantiles of a bounded sample of the different keys. They needn't be exact."""
        ranges = min(MOST_RANGES, -(-entries // RANGE_ENTRIES))
        self.bounds = {}
        for kind in "hn" if ranges > 1 else "":
            some = keys.where((F.col("kind") == kind) & (F.col("key") != "")).orderBy(F.xxhash64("key")).limit(ranges * KEYS_A_BOUND)
            got = sorted({r.key for r in some.select("key").collect()})
            self.bounds[kind] = sorted({got[len(got) * k // ranges] for k in range(1, ranges)}) if got else []
        rows = [(k, b) for k, bs in self.bounds.items() for b in bs]
        self.spark.createDataFrame(rows, "kind string, bound string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/bounds")

    def _write(self, entries: DataFrame) -> str:
        """A further run of the smallest ord of each entry, sorted within its range."""
        last = max((int(r.rpartition("run-")[2]) for r in self.runs), default=0)
        at = f"{self.folder}/run-{last + 1:09d}"
        whole = entries.repartition("kind", "part").groupBy("kind", "part", "key", "form").agg(F.min("ord").alias("ord"))
        whole.sortWithinPartitions("kind", "part", "key", "form").write.partitionBy("kind", "part").parquet(at)
        self.runs.append(at)
        return at

    def _read(self, runs: list[str], touched: list[tuple[str, int]] | None = None) -> DataFrame:
        """Entries of runs; with touched only of these ranges, whose folders alone are read."""
        read = [self.spark.read.schema(_ENTRY).parquet(r) for r in runs]
        whole = read[0]
        for r in read[1:]:
            whole = whole.unionByName(r)
        if touched is None:
            return whole
        by = {kind: sorted(p for k, p in touched if k == kind) for kind in {k for k, _ in touched}}
        wanted = F.lit(False)
        for kind, parts in by.items():
            wanted = wanted | (F.col("kind") == kind) & F.col("part").isin(parts)
        return whole.where(wanted)

    def start(self, rows: DataFrame) -> None:
        """Take in what was accepted before all batches; the bounds are drawn from its raw hashes and digits."""
        raw = rows.select(F.posexplode(F.array(F.lower(F.trim("file_hash")), F.regexp_replace("original_filename", r"\D", ""))).alias("i", "key"))
        self._draw(raw.select(F.when(F.col("i") == 0, "h").otherwise("n").alias("kind"), F.coalesce("key", F.lit("")).alias("key")), rows.count())
        self._write(keyed(rows, None, self.bounds, combine=True))

    def compact(self) -> None:
        """Merge all runs into one, in ranges drawn anew; the old runs are removed."""
        old = list(self.runs)
        whole = self._read(old)
        keep = cut(whole)
        self._draw(keep.select("kind", "key"), keep.count())
        bounds = self.bounds

        def place(batches):
            for b in batches:
                parts = [bisect.bisect_right(bounds.get(k, ()), key) for k, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.int32()), b.column(1), b.column(2), b.column(3)], ["kind", "part", "key", "form", "ord"])

        new = self._write(keep.select("kind", "key", "form", "ord").mapInArrow(place, _ENTRY))
        release(keep)
        for r in old:
            self._delete(r)
        self.runs = [new]

    def accept(self, batch: DataFrame, item: str = "item_id") -> DataFrame:
        """Take the batch's rows in, and give (item, how) of those that were there already."""
        items = cut(keyed(batch, item, self.bounds))
        older = list(self.runs)
        run = self._write(items)
        new = self._read([run])
        touched = [(r.kind, r.part) for r in new.select("kind", "part").distinct().collect()]  # of the order of the ranges
        entries = new.withColumn("new", F.lit(True))
        if older and touched:
            entries = entries.unionByName(self._read(older, touched).withColumn("new", F.lit(False)))
        met = entries.repartition("kind", "part").sortWithinPartitions("kind", "key", "form").select("kind", "key", "form", "ord", "new").mapInArrow(_windows, "kind string, key string, form string, first bigint")
        met = cut(met)
        wide = met.where("kind = 'w'").select(F.col("key").alias("digits"))
        found = met.where("kind <> 'w'")
        if not wide.isEmpty():
            names = entries.where("kind = 'n'").select(F.col("key").alias("digits"), "form", "ord", "new").join(wide, "digits", "left_semi")
            names = cut(names.groupBy("digits", "form").agg(F.min("ord").alias("first"), F.max("new").alias("new")))
            near = self._within(names.where("new").select("digits", "form"), names.select("digits", "form", "first"))
            found = found.unionByName(near.select(F.lit("n").alias("kind"), F.col("digits").alias("key"), "form", "first"))
        how = F.when(F.col("kind") == "h", "same").otherwise("near")
        out = items.join(found, ["kind", "key", "form"]).where("first < ord").select(F.col("ord").alias(item), how.alias("how"))
        out = cut(out.groupBy(item).agg(F.max("how").alias("how")))  # same comes after near
        release(items, met)
        if len(self.runs) > MAX_RUNS:
            self.compact()
        return out

    @staticmethod
    def _within(new: DataFrame, entries: DataFrame) -> DataFrame:
        """For each new (digits, form) the smallest first of the entries of equal digits within two slips."""
        e, n = entries.withColumnRenamed("form", "other"), new

        def segments(df: DataFrame, form: str) -> DataFrame:
            size = F.greatest(F.lit(1), F.floor(F.length(form) / SEGMENTS))
            cut = F.transform(
                F.sequence(F.lit(0), F.lit(SEGMENTS - 1)),
                lambda i: F.struct(i.alias("seg"), F.substring(F.col(form), (i * size + 1).cast("int"), F.when(i == SEGMENTS - 1, F.length(form)).otherwise(size).cast("int")).alias("piece")),
            )
            return df.select("*", F.length(form).alias("len"), F.explode(cut).alias("s")).select("*", "s.seg", "s.piece").drop("s")

        stored = segments(e, "other")
        # a new name meets stored ones of nearly its length; their segments may have moved by two places
        base = n.select("digits", "form", F.explode(F.sequence(F.length("form") - 2, F.length("form") + 2)).alias("len")).where("len > 0")
        size = F.greatest(F.lit(1), F.floor(F.col("len") / SEGMENTS))
        probes = (
            base.select("*", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("seg"), size.alias("size"))
            .select("*", F.explode(F.sequence(F.col("seg") * F.col("size") - 2, F.col("seg") * F.col("size") + 2)).alias("at"))
            .where("at >= 0 and at <= length(form)")
            .select("digits", "form", "len", "seg", F.expr(f"substring(form, cast(at + 1 as int), cast(case when seg = {SEGMENTS - 1} then len - seg * size else size end as int))").alias("piece"))
            .distinct()
        )
        broad = probes.join(stored, ["digits", "len", "seg", "piece"]).select("digits", "form", "other", "first").distinct()
        pairs = broad
        d = F.levenshtein("form", "other", 2 * SLIPS)
        pairs = pairs.withColumn("d", d).where("d >= 0")
        close = pairs.where(F.col("d") <= SLIPS).unionByName(pairs.where((F.col("d") > SLIPS) & _two_slips("form", "other")))
        return close.groupBy("digits", "form").agg(F.min("first").alias("first"))


def already_there(spark: SparkSession, history: DataFrame, inbox: DataFrame) -> DataFrame:
    """(item_id, how) over all batches that wait in inbox, in the order of item_id. The history is keyed and sorted
    once; the batches are merged in and compared in one pass."""
    runs = AcceptedRuns(spark)
    runs.start(history)
    return runs.accept(inbox)
