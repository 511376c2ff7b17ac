"""Problem 4: one form for text that looks the same but is made of other characters.

A longest-match transducer over grapheme clusters (a base character with its marks) is compiled
from one mapping: full-width forms, letters composed of base and mark, invisible characters and
unusual spaces. For words that take a look-alike mapping there are two more, compiled from the same
mapping closed under the look-alike letters of the target alphabet; which of
them a word takes is decided from the word's own letters and, for a word made of look-alikes only,
from the letters around it. Each mapping is checked when compiled: no input is empty or has two outputs, no
output holds an input again, of whatever length. Each text is rewritten in one pass.

Defined results: null stays null and empty stays empty; nothing is dropped but invisible
characters; tabs and line ends stay; applying the operator again changes nothing.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.runtime import prepare

#: Letters that look alike, Latin and Cyrillic in the same order.
LATIN = "aceopxyijsABCEHKMOPTXYIJS"
CYRILLIC = "асеорхуіјѕАВСЕНКМОРТХУІЈЅ"
TO_CYRILLIC = dict(zip(LATIN, CYRILLIC))
TO_LATIN = dict(zip(CYRILLIC, LATIN))
#: Greek capitals and small letters that look like Latin ones.
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιν", "ABEZHIKMNOPTYXoiv"))

INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x206A, 0x2070), 0xFEFF]
SPACES = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]


def plain_mapping() -> dict[str, str]:
    """Inputs that stand for something else in any surroundings."""
    table = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
    table |= {chr(c): "" for c in INVISIBLE} | {chr(c): " " for c in SPACES}
    for code in range(0xC0, 0x2000):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            whole = unicodedata.normalize("NFD", chr(code))
            if unicodedata.normalize("NFC", whole) == chr(code):
                table["".join(chr(int(p, 16)) for p in parts)] = chr(code)
                table[whole] = chr(code)
    return table


class Transducer:
    """Trie of inputs, run as one compiled longest-match pattern."""

    def __init__(self, mapping: dict[str, str]):
        self.table = dict(mapping)
        trie: dict = {}
        for key in self.table:
            if not key:
                raise ValueError("conflict in the mapping: an empty input")
            node = trie
            for ch in key:
                node = node.setdefault(ch, {})
            node[""] = True
        self.pattern = re.compile(self._compile(trie))
        self.check()
        #: Every input holds one of these: its last character, which is a mark, or its only one.
        self.sign = re.compile("[" + "".join(map(re.escape, sorted({k[-1] for k in self.table}))) + "]")

    def check(self) -> None:
        """Conflicts: an output in which an input, of one or more characters, is found again."""
        for key, out in self.table.items():
            if self.pattern.search(out):
                raise ValueError(f"conflict in the mapping: {key!r} -> {out!r}")

    def _compile(self, node: dict) -> str:
        final, kids = "" in node, {k: v for k, v in node.items() if k}
        by_tail: dict[str, list[str]] = {}
        for ch, kid in kids.items():
            by_tail.setdefault(self._compile(kid) if len(kid) > 1 or "" not in kid else "", []).append(ch)
        parts = [f"[{''.join(map(re.escape, chs))}]{tail}" for tail, chs in sorted(by_tail.items(), reverse=True)]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
        return f"(?:{body})?" if final else body

    def run(self, text: str) -> str:
        return text if self.sign.search(text) is None else self.pattern.sub(lambda m: self.table[m.group()], text)


_CYR = "Ѐ-ԯ"
_LAT = "A-Za-zÀ-ɏＡ-Ｚａ-ｚ"
_INV = "".join(map(re.escape, map(chr, INVISIBLE)))
_IN_WORD = rf"{_CYR}{_LAT}Ͱ-Ͽ̀-ͯ{_INV}"
#: A stretch of Latin letters, and what stands between it and a letter of the other alphabet where both meet in a word.
_LAT_RUN = re.compile(f"[{_LAT}]+")
_CYR_AFTER = re.compile(rf"[̀-ͯ{_INV}]*[{_CYR}]")
_BETWEEN = frozenset([*map(chr, INVISIBLE), *map(chr, range(0x300, 0x370))])
_WORD = re.compile(rf"[{_IN_WORD}]+")
#: Words made of look-alikes only. A digit beside makes a code (A4), a degree sign a unit.
_LAT_ONLY = re.compile(rf"[{LATIN}](?<![\w°].)[{LATIN}{_INV}]*(?![\ẁ-ͯ])")
_CYR_ONLY = re.compile(rf"[{CYRILLIC}](?<![\w°].)[{CYRILLIC}{_INV}]*(?![\ẁ-ͯ])")
_GREEK = re.compile(f"[{''.join(GREEK)}]")
_SURE_LAT = re.compile(f"[bdf-hk-nqrtu-wzDFGLNQRU-WZＡ-Ｚａ-ｚ]")
_SURE_CYR = re.compile("[бвгджзийклмнптфцчшщъыьэюяёБГДЖЗИЙЛПУФЦЧШЩЪЫЬЭЮЯЁ]")
_A_CYR = re.compile(f"[{_CYR}]")
_ANY_LAT, _ANY_CYR = re.compile("[A-Za-z]"), re.compile(f"[{_CYR}]")
#: Characters looked at on either side for the alphabet of a word made of look-alikes only.
AROUND = 40


_NEAR = re.compile(r"\S+")
#: An address in the net: a mail sign, or a point right before small Latin letters; and the sign by itself.
_ADDRESS = re.compile(r"@|[A-Za-z0-9]\.[a-z]{2}")
_AT = re.compile(r"[(\[{<]?(?:@|at|dog|собака)[)\]}>]?", re.I)


def _alphabet(word: str) -> str | None:
    lat, cyr = len(_SURE_LAT.findall(word)), len(_SURE_CYR.findall(word))
    return None if lat == cyr else "lat" if lat > cyr else "cyr"


class _Chunk:
    """The string between blanks around a place, kept while the places asked for lie in it."""

    def __init__(self, text: str):
        self.text, self.lo, self.hi, self.lat, self.cyr = text, 0, -1, 0, 0

    def at(self, start: int, end: int) -> None:
        if self.lo <= start and end <= self.hi:
            return
        text, self.lo = self.text, start
        while self.lo > 0 and not text[self.lo - 1].isspace():
            self.lo -= 1
        m = _BLANK.search(text, end)
        self.hi = m.start() if m else len(text)
        whole = text[self.lo : self.hi]
        self.lat, self.cyr = len(_SURE_LAT.findall(whole)), len(_SURE_CYR.findall(whole))


_BLANK = re.compile(r"\s")


def _showing(words: list[str]) -> str | None:
    """The alphabet of the nearest word that shows one; addresses in the net show none, nor does what stands beside
    a mail sign."""
    for i, w in enumerate(words):
        if (side := _alphabet(w)) and not _ADDRESS.search(w) and not _AT.fullmatch(w) and not any(_AT.fullmatch(x) and not x.isalpha() for x in words[max(0, i - 1) : i + 2]):
            return side
    return None


def _side(text: str, start: int, end: int, chunk: _Chunk) -> str | None:
    """Alphabet of the surroundings of text[start:end]: of what is joined to it, else of the nearest
    words that show one on either side within AROUND characters, where both must agree."""
    chunk.at(start, end)
    word = text[start:end]
    lat, cyr = chunk.lat - len(_SURE_LAT.findall(word)), chunk.cyr - len(_SURE_CYR.findall(word))
    if lat != cyr:
        return "lat" if lat > cyr else "cyr"
    back = _NEAR.findall(text[max(0, chunk.lo - AROUND) : chunk.lo])[::-1]
    ahead = _NEAR.findall(text[chunk.hi : chunk.hi + AROUND])
    sides = {_showing(back), _showing(ahead)} - {None}
    return sides.pop() if len(sides) == 1 else None


def _words(text: str) -> list[tuple[int, int, str]]:
    """Stretches of text that take a look-alike mapping, in order, with the alphabet they are brought to."""
    found: dict[int, tuple[int, str]] = {}
    has_lat, has_cyr = _ANY_LAT.search(text), _ANY_CYR.search(text)
    chunk = _Chunk(text)
    if has_lat and has_cyr:
        runs = [m.span() for m in _LAT_RUN.finditer(text)]
        for start, end in runs:
            lo = start
            while lo > 0 and text[lo - 1] in _BETWEEN:
                lo -= 1
            if not (lo > 0 and _A_CYR.match(text, lo - 1)) and not _CYR_AFTER.match(text, end):
                continue
            lo = start
            while lo > 0 and _WORD.match(text, lo - 1):
                lo -= 1
            if lo in found:
                continue
            hi = _WORD.match(text, lo).end()
            word = text[lo:hi]
            lat, cyr = len(_SURE_LAT.findall(word)), len(_SURE_CYR.findall(word))
            side = "lat" if lat > cyr else "cyr" if cyr > lat else _side(text, lo, hi, chunk)
            if side is None:
                side = "lat" if len(_ANY_LAT.findall(word)) > len(_ANY_CYR.findall(word)) else "cyr"
            found[lo] = (hi, side)
        alone = [m for start, _ in runs if (m := _LAT_ONLY.match(text, start))]
        for some, other in ((alone, "cyr"), (_CYR_ONLY.finditer(text) if len(_SURE_LAT.findall(text)) >= 3 else (), "lat")):
            for m in some:
                if m.start() not in found and _side(text, m.start(), m.end(), chunk) == other:
                    found[m.start()] = (m.end(), other)
    return [(a, b, t) for a, (b, t) in sorted(found.items())]


@lru_cache(maxsize=3)
def transducer(side: str | None = None) -> Transducer:
    """The plain mapping, or for words of one alphabet that mapping closed under its look-alikes."""
    alike = {None: {}, "cyr": TO_CYRILLIC, "lat": TO_LATIN}[side]
    return Transducer({k: "".join(alike.get(c, c) for c in v) for k, v in plain_mapping().items()} | alike)


def _greek(text: str) -> str:
    """Greek look-alikes inside words of Latin letters."""
    return re.sub(r"[A-Za-zͰ-Ͽ]+", lambda m: m.group() if not _ANY_LAT.search(m.group()) else "".join(GREEK.get(c, c) for c in m.group()), text)


def has_odd(text: str) -> bool:
    """Whether text holds a character that the mapping or the Greek look-alikes are about."""
    return transducer().sign.search(text) is not None or _GREEK.search(text) is not None


def plain_already(text: str) -> bool:
    """A quick test that says True only where normalize() changes nothing."""
    return not has_odd(text) and not (_ANY_CYR.search(text) and _ANY_LAT.search(text))


def normalize(text: str | None) -> str | None:
    """The one form of text."""
    if not text or text.isascii():
        return text
    if _GREEK.search(text):
        text = _greek(text)
    run, out, at = transducer().run, [], 0
    words = _words(text)
    if not words:
        return run(text)
    for lo, hi, side in words:  # one pass: plain stretches and words in turn
        if lo < at:
            continue
        out.append(run(text[at:lo]))
        out.append(transducer(side).pattern.sub(lambda m, t=transducer(side).table: t[m.group()], text[lo:hi]))
        at = hi
    out.append(run(text[at:]))
    return "".join(out)


def one_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with each named string column brought to its one form; other columns as they are. Narrow."""
    prepare(df.sparkSession)

    @F.udf("string", useArrow=True)
    def form(x):
        return normalize(x)

    return df.withColumns({c: form(df[c]) for c in columns})


def odd_texts(df: DataFrame, key: str, column: str, field: str) -> DataFrame:
    """(field, row_key) of each row whose text differs from its one form. Rows may repeat."""
    prepare(df.sparkSession)
    source = df.select(df[key].cast("string").alias("k"), df[column].alias("t")).where(F.col("t").isNotNull() & F.col("k").isNotNull())

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            hit = [i for i, x in enumerate(texts) if normalize(x) != x]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit, pa.int64()))], ["row_key"])

    return source.mapInArrow(run, "row_key string").select(F.lit(field).alias("field"), "row_key")
