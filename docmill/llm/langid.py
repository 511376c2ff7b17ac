"""Problem 9: language of documents and of stretches in one language, by compression.

For every language and alphabet there is a zstandard raw-content dictionary; a paragraph is in the
language with whose dictionary it compresses smallest. Between close sizes the paragraph is
rejected, that is, left without a language. The dictionaries are cut from a bounded sample of
labelled documents; as labels may be wrong, the sample is cleaned first: each half of it is
classified with dictionaries cut from the other half, and paragraphs that disagree with their
label are dropped, until the choice settles. Cyrillic languages get a second dictionary of the same sample spelt
in Latin letters.

Defined results: null, empty and wordless texts have no language and give no row of segments; in
documents() they have a null language with confidence 0. Texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.runtime import prepare

#: Common codes and English names of the languages told apart here.
CODES = {
    "ru": ("ru", "rus", "russian"), "en": ("en", "eng", "english"), "uk": ("uk", "ukr", "ua", "ukrainian"),
    "be": ("be", "bel", "by", "belarusian"), "kk": ("kk", "kaz", "kz", "kazakh"), "de": ("de", "deu", "ger", "german"),
}
NAMED = {code: lang for lang, codes in CODES.items() for code in codes}
CYRILLIC = ("ru", "uk", "be", "kk")
#: Documents of each label in the training sample, about; and bytes of each dictionary, at most.
SAMPLE_DOCS = 240
DICT_BYTES = 64_000
#: Dictionaries of an alphabet are cut to the smallest of them, but not below so many bytes; rounds of cleaning, at most.
LEAST_BYTES, ROUNDS = 16_000, 8
#: A language is given only if its size is smaller than the next by this share, and by this many bytes.
MARGIN, MARGIN_BYTES = 0.02, 1
#: Bytes of a compressed frame that hold nothing of the text.
FRAME_BYTES = 6
#: A paragraph of fewer characters than SHORT takes a language that no long paragraph of its document
#: has only if it is smaller by this share, and by this many bytes.
SHORT, SHORT_MARGIN, SHORT_BYTES = 60, 0.4, 5

#: Spelling of Cyrillic letters in Latin ones.
_RU = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e yo zh z i y k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" ")))
_LATIN = {
    "ru": _RU,
    "uk": _RU | {"г": "h", "ґ": "g", "є": "ye", "і": "i", "ї": "yi", "и": "y", "й": "i"},
    "be": _RU | {"г": "h", "і": "i", "ў": "u"},
    "kk": _RU | {"ә": "a", "ғ": "g", "қ": "q", "ң": "n", "ө": "o", "ұ": "u", "ү": "u", "һ": "h", "і": "i"},
}

_PARAGRAPH = re.compile(r"\n\s*\n")
_WORDS = re.compile(r"[^\W\d_]+").findall


def label_language(label: str | None) -> str | None:
    """Language a label names, None where it names none of these."""
    return NAMED.get(re.split(r"[-_]", label.strip().lower())[0]) if label else None


def letters(text: str) -> str:
    """Lower-case words of text, one blank between them."""
    return " ".join(_WORDS(text.lower()))


def alphabet(words: str, raw: bytes) -> str:
    """Cyrillic letters take two bytes each, Latin ones mostly one."""
    return "cyr" if (len(raw) - len(words)) * 2 > len(words) - words.count(" ") else "lat"


def paragraphs(text: str | None) -> list[str]:
    return _PARAGRAPH.split(text) if text else []


class Verdict(NamedTuple):
    """Language (None: rejected or wordless), confidence in [0, 1], letters, bytes by language."""

    lang: str | None
    confidence: float
    letters: int
    sizes: dict[str, int]


class Classifier:
    def __init__(self, dictionaries: dict[str, dict[str, bytes]]):
        """dictionaries: alphabet (lat, cyr) -> language -> content."""
        plain = zstandard.ZstdCompressionParameters.from_level(
            1, source_size=600, dict_size=DICT_BYTES, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        self.coders = {}
        for side, by in dictionaries.items():
            self.coders[side] = []
            for lang, content in sorted(by.items()):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=plain)
                self.coders[side].append((lang, zstandard.ZstdCompressor(compression_params=plain, dict_data=d).compress))
        self.known: dict[str, Verdict] = {}

    def sizes(self, words: str) -> dict[str, int]:
        raw = words.encode("utf-8", "replace")
        return {lang: len(compress(raw)) for lang, compress in self.coders[alphabet(words, raw)]}

    def of(self, words: str) -> Verdict:
        if words in self.known:
            return self.known[words]
        sizes = self.sizes(words) if words else {}
        order = sorted((n, lang) for lang, n in sizes.items())
        out = Verdict(None, 0.0, len(words), sizes)
        if order:
            best, lang = order[0]
            second = order[1][0] if len(order) > 1 else best + len(words)
            share = (second - best) / max(1, second - FRAME_BYTES)
            if second - best >= MARGIN_BYTES and share >= MARGIN:
                out = Verdict(lang, round(min(1.0, 0.5 + 2.5 * share), 4), len(words), sizes)
        if len(words) < 120:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[words] = out
        return out

    def of_paragraphs(self, text: str | None) -> list[Verdict]:
        """A verdict for each paragraph. A short one, such as a title, is near to several kindred
        languages at once; it differs from the long paragraphs only where its size tells clearly."""
        out = [self.of(letters(p)) for p in paragraphs(text)]
        long = {v.lang for v in out if v.lang and v.letters >= SHORT}
        if long:
            for i, v in enumerate(out):
                if 0 < v.letters < SHORT and v.lang not in long and v.sizes:
                    near, lang = min(((v.sizes[k], k) for k in long if k in v.sizes), default=(None, None))
                    best = min(v.sizes.values())
                    if near is not None and near - best < max(SHORT_BYTES, SHORT_MARGIN * (near - FRAME_BYTES)):
                        out[i] = Verdict(lang, 0.5, v.letters, v.sizes)
        return out


def _cut_dictionaries(pieces: dict[str, dict[str, list[str]]]) -> dict[str, dict[str, bytes]]:
    """Contents of equal size within an alphabet, as a longer one would win by its length alone."""
    out: dict[str, dict[str, bytes]] = {"lat": {}, "cyr": {}}
    for side, by in pieces.items():
        for lang, texts in by.items():
            out[side][lang] = "\n".join(texts).encode("utf-8", "replace")
    for lang in CYRILLIC:
        if texts := pieces["cyr"].get(lang):
            out["lat"][lang] = "\n".join(texts).translate(str.maketrans(_LATIN[lang])).encode("utf-8", "replace")
    for by in out.values():
        most = max(LEAST_BYTES, min(map(len, by.values()), default=0))
        by.update({lang: content[-min(most, DICT_BYTES) :] for lang, content in by.items()})
    return out


def train(rows: list[tuple[str, str]], rounds: int = ROUNDS) -> dict[str, dict[str, bytes]]:
    """Dictionaries from (language of the label, text). A paragraph is learnt from only where dictionaries cut
    from the other half of the sample say what its label says; so labels are dropped and never moved, and two
    languages can't change places. Rounds go on until the choice settles. Short paragraphs, such as titles,
    are the same in many documents; they are learnt last, from documents whose long paragraphs all bear the
    label out, each for the language that nearly all of these documents are in."""
    texts = [(lang, [(alphabet(w, w.encode("utf-8", "replace")), w) for p in paragraphs(text) if (w := letters(p))]) for lang, text in rows]
    # a language in its other alphabet is learnt by respelling
    texts = [(lang, [(side, w) for side, w in ps if (side == "cyr") == (lang in CYRILLIC)]) for lang, ps in texts]
    lengthy = {lang for lang, ps in texts if any(len(w) >= SHORT for _, w in ps)}
    named: dict[tuple[str, str], Counter[str]] = {}
    for lang, ps in texts:
        for side, w in ps:
            if len(w) >= SHORT or lang not in lengthy:
                named.setdefault((side, w), Counter())[lang] += 1
    halves: list[list[tuple[str, str, str]]] = [[], []]
    for n, ((side, w), by) in enumerate(named.items()):
        if (top := _leading(by, 0.5)) is not None:
            halves[n % 2].append((side, top, w))

    def gather(some, kept) -> dict[str, dict[str, list[str]]]:
        pieces: dict[str, dict[str, list[str]]] = {"lat": {}, "cyr": {}}
        for (side, lang, w), keep in zip(some, kept):
            if keep:
                pieces[side].setdefault(lang, []).append(w)
        return pieces

    kept = [[True] * len(half) for half in halves]
    for _ in range(rounds):
        models = [Classifier(_cut_dictionaries(gather(*x))) for x in zip(halves, kept)]
        last, kept = kept, [[models[1 - h].of(w).lang == lang for _, lang, w in half] for h, half in enumerate(halves)]
        # a label of which nothing is left keeps what it had
        for h, half in enumerate(halves):
            lost = {lang for _, lang, _ in half} - {lang for (_, lang, _), k in zip(half, kept[h]) if k}
            kept[h] = [k or lang in lost for (_, lang, _), k in zip(half, kept[h])]
        if kept == last:
            break
    pieces = gather(halves[0] + halves[1], kept[0] + kept[1])
    clean = Classifier(_cut_dictionaries(pieces))
    titles: dict[tuple[str, str], Counter[str]] = {}
    for lang, ps in texts:
        long = {clean.of(w).lang for _, w in ps if len(w) >= SHORT}
        if long == {lang}:
            for at in {(side, w) for side, w in ps if len(w) < SHORT}:
                titles.setdefault(at, Counter())[lang] += 1
    for (side, w), by in titles.items():
        if (top := _leading(by, 0.8)) is not None:
            pieces[side].setdefault(top, []).append(w)
    return _cut_dictionaries(pieces)


def _leading(by: Counter[str], share: float) -> str | None:
    """The language of more than this share of the documents, if there is one."""
    lang, n = by.most_common(1)[0]
    return lang if n > share * by.total() else None


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> dict[str, dict[str, bytes]]:
    """Dictionaries from about sample_docs documents of each label, drawn by a hash of the id over the whole table."""
    codes = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    named = docs.select(id_col, text_col, codes[F.split(F.lower(F.trim(label_col)), "[-_]")[0]].alias("l")).where("l is not null")
    counts = {r.l: r.n for r in named.groupBy("l").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return {"lat": {}, "cyr": {}}
    draw = F.pmod(F.xxhash64(id_col), F.lit(1_000_000))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(min(1_000_000, 2_000_000 * sample_docs / n // 2 + 1)))])
    rows = named.where(F.length(text_col).between(1, 20_000) & (draw < share[F.col("l")])).select(id_col, "l", text_col).limit(sample_docs * len(CODES) * 2).collect()
    return train([(r.l, r[text_col]) for r in sorted(rows, key=lambda r: str(r[id_col]))])


@lru_cache(maxsize=4)
def _classifier(key: tuple) -> Classifier:
    return Classifier({side: dict(by) for side, by in key})


def _key(dictionaries: dict[str, dict[str, bytes]]) -> tuple:
    return tuple((side, tuple(sorted(by.items()))) for side, by in sorted(dictionaries.items()))


def segments_of(text: str | None, c: Classifier) -> list[tuple[int, int, str, float]]:
    """(first paragraph, last paragraph, language, confidence) of each stretch in one language;
    a paragraph without a language of its own belongs to the stretch before it, else after it."""
    runs: list[list] = []
    open_from = None
    for n, (lang, conf, size, _) in enumerate(c.of_paragraphs(text), 1):
        if lang is None:
            if runs:
                runs[-1][1] = n
            elif size and open_from is None:
                open_from = n
        elif runs and runs[-1][2] == lang:
            r = runs[-1]
            r[1], r[3], r[4] = n, r[3] + conf * size, r[4] + size
        else:
            runs.append([open_from or n, n, lang, conf * size, size])
            open_from = None
    return [(a, b, lang, round(w / size, 4)) for a, b, lang, w, size in runs]


def segments(docs: DataFrame, dictionaries: dict[str, dict[str, bytes]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each stretch of paragraphs (counted from 1) in one language."""
    prepare(docs.sparkSession)
    key = _key(dictionaries)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        c = _classifier(key)
        for batch in batches:
            ids, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for s in segments_of(text, c):
                    ids.append(i)
                    out.append(s)
            cols = [pa.array([s[k] for s in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *cols], ["id", "first_par", "last_par", "lang", "confidence"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, first_par bigint, last_par bigint, lang string, confidence double").withColumnRenamed("id", id_col)


def documents(docs: DataFrame, dictionaries: dict[str, dict[str, bytes]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of the most letters of each document, with confidence; and whether it holds several."""
    prepare(docs.sparkSession)
    key = _key(dictionaries)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        c = _classifier(key)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                weight: dict[str, float] = {}
                sure: dict[str, float] = {}
                total = 0
                for lang, conf, size, _ in c.of_paragraphs(text):
                    total += size
                    if lang:
                        weight[lang] = weight.get(lang, 0) + size
                        sure[lang] = sure.get(lang, 0) + conf * size
                best = min(weight, key=lambda k: (-weight[k], k), default=None)
                out.append((best, round(sure[best] / total, 4) if best else 0.0, len(weight)))
            cols = [pa.array([s[k] for s in out], t) for k, t in enumerate((pa.string(), pa.float64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", "lang", "confidence", "n_langs"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, lang string, confidence double, n_langs int").withColumnRenamed("id", id_col)


def unnamed(docs: DataFrame, dictionaries: dict[str, dict[str, bytes]], id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(id, lang): languages of whole paragraphs which the document's label doesn't name."""
    prepare(docs.sparkSession)
    key = _key(dictionaries)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        c = _classifier(key)
        for batch in batches:
            ids, langs = [], []
            for i, (text, label) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                have = {v.lang for v in c.of_paragraphs(text) if v.lang}
                for lang in sorted(have - {label_language(label)}):
                    ids.append(i)
                    langs.append(lang)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(langs, pa.string())], ["id", "lang"])

    return docs.select(id_col, text_col, label_col).mapInArrow(run, f"id {kind}, lang string").withColumnRenamed("id", id_col)
