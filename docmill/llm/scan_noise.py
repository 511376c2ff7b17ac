"""Problem 1: noise in text from scanned pages, and the running text without it.

The lines of a page are labelled by a hidden Markov model: running header, page number, title, body
line, body line that begins a paragraph, table line, break in the margin and break in the body. Its
observations are layout features: the form of the line, whether another page of the same file
carries it, indents, lines that end early, blank lines. It starts from fixed probabilities and is
fitted to a bounded sample by hard expectation maximisation. From each edge the lines are labelled
inwards, as far as no two lines of prose have been met; what is left is labelled from the top, and
the running text is put together by these labels. Misread words are words hardly ever seen that turn into common ones when one
character is replaced by one it is taken for; broken words are told from true hyphens by which
spelling the corpus knows. All tests are by shares of the corpus's words, so a corpus given many
times over has the same noise. The lexicon holds the words that make up at least LEAST_SHARE of
all, so at most 1 / LEAST_SHARE.

Lines are parted by LF and counted from 1, blank ones too. Defined results: null and empty texts
have no noise; repeated rows of a page count once; a page in no file has no headers; a page in
several files has those of all; words of more than LONGEST characters are never misread or broken.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from docmill.llm import lookalikes
from docmill.runtime import cut, prepare, release

#: The least share of the corpus's words that a word of the lexicon has, and its greatest length.
LEAST_SHARE, LONGEST = 1e-6, 64
#: A common word must be so many times as frequent as the misread one.
RATIO = 12
#: A word is common that makes up one of so many words of the corpus.
COMMON = 35_000
#: Full lines from an edge that are always looked at; more are, up to the second line of prose.
EDGE = 3
SAMPLE_PAGES, ROUNDS = 2000, 3

#: What is taken for what, as (true, read).
CONFUSED = (
    "о0 О0 ес се ни ин тг гт лп пл дл в8 В8 ч4 Ч4 з3 З3 б6 Б6 й| ж* Ж* щш шщ цч шщ йи ао оа еo ыи мн "
    "o0 O0 l1 l| i! i1 I1 e c ec ce an na tf ft s5 S5 B8 b6 g9 q9 z2 nu un mn hb vy ij hn"
).split()
#: Two characters read for one, as (read, true).
PAIRS_READ = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ь1", "ы"), ("ьl", "ы"), ("1о", "ю"), ("lо", "ю"), ("i<", "к"), ("li", "h"))
_TRUE: dict[str, str] = {}
for _p in CONFUSED:
    if len(_p) == 2:
        _TRUE[_p[1]] = _TRUE.get(_p[1], "") + _p[0]
#: Characters that a misreading may bring into a word or number.
_SIGNS = "0123456789|*!"
#: One form for all characters that are taken for each other.
_ONE = {ord(c): group[-1] for group in ("0Оо", "3Зз", "8Вв", "4ЧчЦц", "6Бб", "|ЙйИиНн", "*Жж", "lI!1", "СсЕеe", "ТтГг", "ЛлПпДд", "ЩщШш", "S5s", "Аа") for c in group}

_OTHER = re.compile(r"[^\w|*!№ ]+")
_WORD = re.compile(r"[^\W_]+(?:[|*!]+[^\W_]*)*(?:-[^\W\d_]+)*|[|*!]+[^\W_]+")
_HYPHEN_END = re.compile(r"([^\W\d_][\w|*!]*|[\w|*!]*[^\W\d_])[-‐¬–­][ \t]*\r?$")
_START = re.compile(r"[ \t]*([^\W_][\w|*!]*)(\S*)")
_NUMBER = re.compile(r"\d[\dОоЗзБбlI|!SВ]*[ОоЗзБбlI|!SВ][\dОоЗзБбlI|!SВ]*|[ОЗБlI|!SВ][\dОоЗзБбlI|!SВ]*\d[\dОоЗзБбlI|!SВ]*")
#: The digits of such a number.
_DIGITS = str.maketrans("ОоЗзБбlI|!SВ", "003366111158")
_N = r"[\dОоЗзБбlI|!SВ]{1,4}"
_DRESSED = re.compile(
    rf"^\s*(?:[-–—~*=•]+\s*{_N}\s*[-–—~*=•]+|[\[({{<]\s*{_N}\s*[\])}}>]|{_N}\s*(?:/|из|of)\s*{_N}|(?:[сc]тр(?:аница|аниц[аыу])?|лист|л|page|pg|p|sheet|с|№)[.:]?\s*{_N}(?:\s*(?:из|of|/)\s*{_N})?)\s*[.]?\s*$", re.I
)
_BARE = re.compile(rf"^\s*{_N}\s*$")
_TITLE = re.compile(r"(?:№|no\.?|n)\s*\S+\s+(?:от|dated|of|from)\s+\S", re.I)
#: A line that a sentence begun on the line before goes on with.
_LOWER = frozenset("abcdefghijklmnopqrstuvwxyzабвгдежзийклмнопрстуфхцчшщъыьэюяё")
_ADDRESS = re.compile(r"@|[A-Za-z0-9]\.[a-z]{2}")
_LATIN = re.compile("[A-Za-z]")
_LETTER = re.compile(r"[^\W\d_]")
_TABLE = re.compile(r"^\s*(?:\d+\s+\S.*\s)?\d[\d ]*[.,]\d\d\s*$")
_ROW = re.compile(r"^\s*\d+\s+\S.*\s\d[\d ]*[.,]\d\d\s*$")
_GOES_ON = re.compile(r"(?:\d[\d/]*[;,]?\s+)?[a-zа-яё]")
_RUNNING = re.compile(r"«|»|\||•|\"|ооо|зао|пао|llc|ltd|приложение|annex|исх|форма|form|экземпляр|copy|конфиден|confid|внутрен|internal", re.I)


def readable(text: str) -> str:
    """Text without look-alikes and odd characters."""
    if text.isascii() or lookalikes.plain_already(text):
        return text
    return lookalikes.normalize(text) or ""


def readable_lines(text: str, soft: bool = False) -> list[str]:
    """The lines of a text, each readable by itself; with soft a soft hyphen at the end of a line becomes a hyphen."""
    lines = text.split("\n")
    if text.isascii():
        return lines
    if lookalikes.has_odd(text):
        return [readable(x.replace("­", "-") if soft and x.rstrip().endswith("­") else x) for x in lines]
    # only a line with letters of both alphabets can change
    return [lookalikes.normalize(x) or "" if _LATIN.search(x) else x for x in lines]


def same_key(line: str) -> str:
    """A line up to misreading, case and spacing."""
    return "".join(_same_words(line))


def _same_words(line: str) -> list[str]:
    return _OTHER.sub("", " ".join(line.lower().translate(_ONE).replace("ё", "с").split())).split()


# --- lexicon -----------------------------------------------------------------------------------


#: Forms of lines as one letter each.
_CODE = {"prose": "p", "plain": "l", "title": "t", "long": "g", "dressed": "d", "bare": "b", "table": "x", "blank": "_", "first": "f", "lower": "w"}
_EDGES = "lines int, top string, foot string, marks array<bigint>, less array<array<bigint>>"


def read_once(pages: DataFrame, key: str = "page_hash", text: str = "text") -> DataFrame:
    """(page, lines, top, foot, marks, less, w, k), written. Of each page its number of lines, the forms of those from
    the top and of those from the foot inwards, and the marks of both (0 for none); and for each batch of pages its words
    (w) and their counts (k). Words with their own hyphen count as one word, too; figures alone are no words."""
    prepare(pages.sparkSession)
    kind = dict(pages.dtypes)[key]

    def lists(values, sizes):
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), values)

    def run(batches):
        for b in batches:
            strings: Counter[str] = Counter()  # words are looked for in each different string between blanks once
            ids, size, sides, marks, each, less, parts = [], [], ([], []), [], [], [], []
            for i, (page, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if not t:
                    continue
                lines = readable_lines(t)
                strings.update("\n".join(lines).lower().split())
                if page is not None:
                    edge = edge_lines(lines)
                    for name, out in zip("tf", sides):
                        out.append("".join([_CODE[form] for side, _, _, form in edge if side == name]))
                    for _, _, line, form in edge:
                        mark, some = line_marks(line) if form in ("plain", "long", "title") else (None, ())
                        marks.append(mark or 0)
                        parts += some
                        less.append(len(some))
                    ids.append(i)
                    size.append(len(lines))
                    each.append(len(edge))
            count: Counter[str] = Counter()
            for string, k in strings.items():
                for w in _WORD.findall(string):
                    count[w] += k
            words = [(w, k) for w, k in count.items() if len(w) <= LONGEST and not w.isdigit()]
            n = len(ids)
            rows = [b.column(0).take(pa.array(ids, pa.int64())), pa.array(size, pa.int32()), *(pa.array(x, pa.string()) for x in sides), lists(pa.array(marks, pa.int64()), each), lists(lists(pa.array(parts, pa.int64()), less), each)]
            one = [lists(pa.array([w for w, _ in words], pa.string()), [len(words)]), lists(pa.array([k for _, k in words], pa.int64()), [len(words)])]
            full = [pa.concat_arrays([x, pa.nulls(1, x.type)]) for x in rows] + [pa.concat_arrays([pa.nulls(n, x.type), x]) for x in one]
            yield pa.RecordBatch.from_arrays(full, ["page", "lines", "top", "foot", "marks", "less", "w", "k"])

    return cut(pages.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, f"page {kind}, {_EDGES}, w array<string>, k array<bigint>"))


def lexicon(once: DataFrame) -> tuple[dict[str, int], int]:
    """(counts of the words of the lexicon, count of all words) of pages read once."""
    pairs = once.where("w is not null").select(F.explode(F.arrays_zip("w", "k")).alias("x"))
    counts = cut(pairs.groupBy("x.w").agg(F.sum("x.k").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    out = {r.w: r.n for r in counts.where(F.col("n") >= LEAST_SHARE * total).collect()}
    release(counts)
    return out, total


class Reader:
    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.counts = counts
        total = sum(counts.values()) if total is None else total
        self.common, self.least = total / COMMON, LEAST_SHARE * total
        self.known: dict[str, int] = {}
        self.fine: set[str] = set()  # strings between blanks met without a misread character

    def count(self, word: str) -> int:
        return self.counts.get(word, 0)

    def repair(self, word: str) -> tuple[str, int] | None:
        """The common word that this one is misread from, with the place of the first wrong character."""
        if len(word) > LONGEST:
            return None
        low = word.lower()
        least = RATIO * (self.count(low) + self.least)
        best: tuple[int, str, int] | None = None
        for i, c in enumerate(low):
            for true in _TRUE.get(c, ""):
                other = low[:i] + true.lower() + low[i + 1 :]
                k = self.count(other)
                if k and k >= least and (best is None or k > best[0]):
                    best = (k, other, i)
                if k == 0 and not c.isalpha():  # signs come in pairs at times
                    for j in range(i + 1, len(low)):
                        for true2 in _TRUE.get(low[j], ""):
                            twice = other[:j] + true2.lower() + other[j + 1 :]
                            k = self.count(twice)
                            if k and k >= least and (best is None or k > best[0]):
                                best = (k, twice, i)
        for read, true in PAIRS_READ:
            i = low.find(read)
            if i >= 0:
                other = low.replace(read, true, 1)
                k = self.count(other)
                if k and k >= least and (best is None or k > best[0]):
                    best = (k, other, i)
        return None if best is None else (best[1], best[2])

    def misread_at(self, word: str) -> int:
        """Place of a misread character in a word or number, -1 if there is none."""
        if len(word) > LONGEST:
            return -1
        if word in self.known:
            return self.known[word]
        out = -1
        if word.isalpha():
            letters, signs = len(word), 0
        else:
            letters, signs = len(_LETTER.findall(word)), sum(c in _SIGNS for c in word)
        if letters == 0:
            out = next((i for i, c in enumerate(word) if c in "|!*" and len(word) > 1), -1)
        elif signs:
            if signs and letters >= signs and letters >= 2 and (r := self.repair(word)) is not None:
                out = r[1]
            elif _NUMBER.fullmatch(word) and sum(c.isdigit() for c in word) >= 1:
                out = next(i for i, c in enumerate(word) if not c.isdigit())
            elif letters >= 4 and re.search(r"[^\W\d_][0-9|*!][^\W\d_]|[^\W\d_]{3}[0-9|*!]$|^[0-9|*!][^\W\d_]{3}", word) and not re.search(r"\d\d", word):
                out = next(i for i, c in enumerate(word) if c in _SIGNS)
        elif len(word) >= 3 and (r := self.repair(word)) is not None:
            out = r[1]
        if len(self.known) > 300_000:
            self.known.clear()
        self.known[word] = out
        return out

    def misread_in(self, text: str) -> bool:
        """Whether a word of the text has a misread character; parts of addresses in the net don't count."""
        for w in _WORD.finditer(text):
            word = w.group()
            if word.isdigit() or w.end() < len(text) and text[w.end()] in "@_" or w.start() > 0 and text[w.start() - 1] in "@_":
                continue
            if self.misread_at(word) >= 0 and not _in_address(w):
                return True
        return False

    def misread(self, strings: list[str]) -> bool:
        """Whether one of these strings between blanks has a misread character."""
        if self.fine.issuperset(strings):
            return False
        for x in strings:
            if x not in self.fine:
                if self.misread_in(x):
                    return True
                if len(self.fine) > 300_000:
                    self.fine.clear()
                self.fine.add(x)
        return False

    def broken(self, left: str, right: str, tail: str) -> bool:
        """Whether left-/right is one word broken at the end of a line, not one with its own hyphen."""
        if not right or not (right[0].islower() or (left.isupper() and right[0].isupper())) and not right[0] in _SIGNS:
            return False
        if len(left) + len(right) > LONGEST:
            return False
        if "@" in tail or re.match(r"\.\w", tail):
            return False
        a, b = left.lower(), right.lower()
        joined, own = self._best(a + b), self._best(f"{a}-{b}")
        if own > joined:
            return False
        return joined > 0 or min(self.count(a), self.count(b)) < max(self.common, self.least, 1e-9) or len(a) <= 3 or len(b) <= 3

    def _best(self, word: str) -> int:
        n = self.count(word)
        if n == 0 and (r := self.repair(word)) is not None:
            n = self.count(r[0])
        return n


def line_noise(text: str | None, reader: Reader) -> list[tuple[int, str]]:
    """(line, kind) of broken and misread words."""
    if not text:
        return []
    plain = readable_lines(text, soft=True)
    out: set[tuple[int, str]] = set()
    jump = 0  # characters at the start of the line that belong to a broken word
    for n, line in enumerate(plain, 1):
        carried, jump, end = jump, 0, len(line)
        tail = line.rstrip()
        m = _HYPHEN_END.search(line, max(0, len(tail) - LONGEST)) if tail[-1:] in "-‐¬–" and tail else None
        s = _START.match(plain[n]) if m and n < len(plain) else None
        if s:
            left = re.search(r"[\w|*!]+$", line[: m.end(1)])
            left_at = left.start() if left else m.start(1)
            word = line[left_at : m.end(1)]
            if not word.isdigit() and reader.broken(word, s.group(1), s.group(2)):
                out.add((n, "hyphen"))
                end = left_at
                at = reader.misread_at(word + s.group(1))
                if at >= 0:
                    out.add((n if at < len(word) else n + 1, "misread"))
                jump = s.end(1)
        # words never hold blanks, so each string between them is looked at by itself
        if reader.misread((line[carried:end] if carried or end < len(line) else line).split()):
            out.add((n, "misread"))
    return sorted(out)


# --- lines at the top and foot ----------------------------------------------------------------


def edge_lines(lines: list[str]) -> list[tuple[str, int, str, str]]:
    """(side, line number, line, form) of readable lines from the top inwards, then of those from the foot inwards;
    each run ends with its second line of prose, but has EDGE full lines at least."""
    out = []
    top = 0
    for side, some in (("t", range(len(lines))), ("f", range(len(lines) - 1, -1, -1))):
        full = prose = 0
        for i in some:
            if side == "f" and i < top:
                break  # a short page is all top
            x = lines[i]
            if not x.strip():
                form = "blank"
            else:
                form = _form(x, lines[i - 1] if i else "", lines[i + 1] if i + 1 < len(lines) else "", side, full, i, len(lines))
                full += 1
                prose += form == "prose"
            out.append((side, i + 1, x, form))
            if full >= EDGE and prose >= 2:
                break
        if side == "t":
            top = i + 1 if lines else 0
    return out


def _form(x: str, before: str, after: str, side: str, place: int, i: int, n: int) -> str:
    if len(x) < 60:
        if _DRESSED.match(x):
            # the number of a paper may be carried over to a line of its own
            carried = x.startswith("№") and before.strip() and before.rstrip()[-1] not in ".!?:"
            return "prose" if carried else "dressed"
        if _BARE.match(x):
            before, after = before.strip(), after.strip()
            apart = x.startswith("    ") or (not before and i > 0) or (not after and i + 1 < n) or (side == "t" and (i == 0 or place == 1 and after[:1].isupper())) or (side == "f" and (place == 0 or re.search(r"[.!?:]$", before) is not None))
            return "bare" if apart and re.search(r"№$|\bno\.?$|\bот$", before) is None else "plain"
    if _TABLE.match(x):
        return "table"
    body = x.strip()
    if body[0] in _LOWER:
        return "prose"  # goes on from a line before
    if len(body) < 90 and _TITLE.search(x) and not _RUNNING.search(x):
        return "title"
    ends = body[-1] in ".,;:!?‐¬-" and not body.endswith(("Г.", "г."))
    if ends or (_runs_on(body) or _GOES_ON.match(after) and not _DRESSED.match(after)) and not _RUNNING.search(x):
        return "prose"
    return "long" if len(body) > 72 else "plain"


def _runs_on(body: str) -> bool:
    """Whether a sentence can't end with this line: with a number sign or a short word."""
    last = body.rsplit(None, 1)[-1]
    return body[-1] == "№" or len(last) <= 3 and last.isalpha() and last.islower()


#: Header, number, title, body line, first line of a paragraph, table line, break in the margin, break in the body.
STATES = "HNTBPXEK"
FORMS = tuple(_CODE)
#: Where the fit starts; what isn't named is unlikely.
_START_P = {"H": 0.3, "N": 0.2, "T": 0.2, "B": 0.14, "P": 0.1, "X": 0.02, "E": 0.04}
_STEP_P = {
    "H": {"H": 0.1, "N": 0.2, "T": 0.16, "B": 0.12, "P": 0.12, "X": 0.01, "E": 0.29}, "N": {"H": 0.25, "N": 0.01, "T": 0.16, "B": 0.2, "P": 0.12, "X": 0.01, "E": 0.25},
    "T": {"H": 0.03, "N": 0.02, "T": 0.02, "B": 0.2, "P": 0.2, "X": 0.03, "E": 0.02, "K": 0.48}, "B": {"H": 0.005, "N": 0.005, "T": 0.005, "B": 0.8, "P": 0.045, "X": 0.02, "K": 0.12},
    "P": {"H": 0.005, "N": 0.005, "T": 0.005, "B": 0.8, "P": 0.045, "X": 0.02, "K": 0.12}, "X": {"H": 0.002, "N": 0.002, "T": 0.002, "B": 0.05, "P": 0.2, "X": 0.6, "K": 0.144},
    "E": {"H": 0.25, "N": 0.2, "T": 0.25, "B": 0.1, "P": 0.17, "X": 0.02, "E": 0.01}, "K": {"H": 0.005, "N": 0.005, "T": 0.005, "B": 0.03, "P": 0.82, "X": 0.115, "K": 0.02},
}
_EMIT_P = {
    "H": {"prose": 0.001, "plain": 0.799, "title": 0.02, "long": 0.17, "dressed": 0.005, "bare": 0.005}, "N": {"dressed": 0.7, "bare": 0.298, "plain": 0.0009, "title": 0.0005, "long": 0.0005, "prose": 0.0001},
    "T": {"title": 0.9, "plain": 0.089, "long": 0.008, "prose": 0.001, "dressed": 0.001, "bare": 0.001}, "B": {"prose": 0.4, "plain": 0.3, "long": 0.28, "title": 0.01, "dressed": 0.005, "bare": 0.004, "first": 0.001, "lower": 0.4, "table": 0.02},
    "P": {"prose": 0.2, "plain": 0.15, "long": 0.14, "title": 0.005, "dressed": 0.0025, "bare": 0.0025, "first": 0.5, "lower": 0.004, "table": 0.002}, "X": {"table": 0.97, "plain": 0.01, "bare": 0.01, "prose": 0.01}, "E": {"blank": 1.0}, "K": {"blank": 1.0},
}
_CARRIED_P = {"H": 0.995, "N": 0.3, "T": 0.1}
_RARE = 1e-6


def _start_emission(state: str, form: str, rep: bool) -> float:
    carried = _CARRIED_P.get(state, 0.02)
    return _EMIT_P[state].get(form, _RARE) * (carried if rep else 1 - carried)


class Model:
    def __init__(self):
        self.start = {s: _START_P.get(s, _RARE) for s in STATES}
        self.step = {a: {b: _STEP_P[a].get(b, _RARE) for b in STATES} for a in STATES}
        self.emit = {s: {(_CODE[f], r): _start_emission(s, f, r) for f in FORMS for r in (False, True)} for s in STATES}
        self._ready()

    def _ready(self) -> None:
        self.log_step = [[math.log(self.step[a][b]) for a in STATES] for b in STATES]
        self.log_emit = {o: [math.log(self.emit[s][o]) for s in STATES] for o in self.emit["H"]}
        self.done: dict[tuple, tuple] = {}
        self.whole: dict[tuple, str] = {}

    def labels(self, forms: str, again: tuple[bool, ...]) -> str:
        """The likeliest labels of a side; few different ones occur."""
        got = self.whole.get((forms, again))
        if got is None:
            if len(self.whole) > 100_000:
                self.whole.clear()
            got = self.whole[forms, again] = self.label(list(zip(forms, again)))
        return got

    def label(self, seen: list[tuple[str, bool]], before: str | None = None) -> str:
        """The likeliest labels of the lines, one after another, after a line labelled before. Scores are kept
        relative to the best one, so that few different steps occur, and each is computed once."""
        if not seen:
            return ""
        e = self.log_emit[seen[0]]
        first = [math.log(self.start[s]) if before is None else self.log_step[k][STATES.index(before)] for k, s in enumerate(STATES)]
        at = self._relative([a + b for a, b in zip(first, e)])
        back = []
        for o in seen[1:]:
            got = self.done.get((at, o))
            if got is None:
                got = self._next(at, o)
            back.append(got[1])
            at = got[0]
        k = max(range(len(STATES)), key=at.__getitem__)
        path = [k]
        for came in reversed(back):
            path.append(came[path[-1]])
        return "".join(STATES[k] for k in reversed(path))

    @staticmethod
    def _relative(scores: list[float]) -> tuple[float, ...]:
        top = max(scores)
        return tuple(round(x - top, 6) for x in scores)

    def _next(self, at: tuple[float, ...], o: tuple[str, bool]) -> tuple:
        came = [max(range(len(STATES)), key=lambda j: at[j] + row[j]) for row in self.log_step]
        scores = [at[j] + row[j] + e for j, row, e in zip(came, self.log_step, self.log_emit[o])]
        if len(self.done) > 100_000:
            self.done.clear()
        got = self.done[at, o] = (self._relative(scores), came)
        return got

    def fit(self, sample: list[list[tuple[str, bool]]]) -> Model:
        prior = Model.__new__(Model)
        Model.__init__(prior)
        for _ in range(ROUNDS):
            start, step, emit = Counter(), Counter(), Counter()
            for seen in sample:
                path = self.label(seen)
                start[path[0]] += 1
                step.update(zip(path, path[1:]))
                emit.update(zip(path, seen))
            weight = 50.0  # the fixed start counts as so many observations
            for s in STATES:
                self.start[s] = (start[s] + weight * prior.start[s]) / (sum(start.values()) + weight)
                n1, n2 = sum(step[s, t] for t in STATES), sum(emit[s, o] for o in self.emit[s])
                self.step[s] = {t: (step[s, t] + weight * prior.step[s][t]) / (n1 + weight) for t in STATES}
                total = sum(prior.emit[s].values())
                self.emit[s] = {o: (emit[s, o] + weight * prior.emit[s][o] / total) / (n2 + weight) for o in self.emit[s]}
            self._ready()
        return self


def _digest(key: str) -> int:
    return xxh3_64_intdigest(key.encode("utf-8", "replace")) - (1 << 63)


def line_marks(line: str) -> tuple[int | None, list[int]]:
    """Digests of a line up to misreading, case and spacing: of the whole, and of the whole without one of
    its words (of a single word, without one of its characters), so that lines with one word misread beyond
    the common confusions still meet."""
    words = _same_words(line)
    whole = "".join(words)
    if len(_LETTER.findall(whole)) < 3:
        return None, []
    # the place of what is left out is part of the digest
    parts = words if len(words) > 1 else list(whole) if len(whole) > 5 else []
    return _digest(whole), [_digest(f"{i} {' '.join(parts[:i] + parts[i + 1 :])}") for i in range(len(parts))]


_NAMES = {"H": "header", "N": "page_number"}
_NUMBERED = re.compile("[db]")


def _labelled(once: DataFrame, files: DataFrame) -> tuple[DataFrame, Model]:
    """(page, rep, lines, top, foot, marks): the lines near the edges of each page and which of their marks other pages
    of the file carry; and the model fitted to a sample of them."""
    # rows of one page are alike, as they hold the same text; the lexicon is collected, so nothing else needs them
    edges = cut(once.where("page is not null").drop("w", "k").dropDuplicates(["page"]).withColumn("pid", F.xxhash64("page")))
    release(once)
    where = files.where("file_hash is not null and page_hash is not null").select(F.xxhash64("page_hash").alias("pid"), F.xxhash64("file_hash").alias("file")).distinct()
    placed = cut(edges.select("pid", F.explode(F.arrays_zip("marks", "less")).alias("o")).where("o.marks <> 0").select("pid", F.col("o.marks").alias("mark"), "o.less").join(where, "pid"))
    # how many pages of a file carry a line: counted before anything is brought together
    carried = cut(placed.groupBy("file", "mark").agg(F.count_distinct("pid").alias("pages"), F.first("less").alias("less")).where("pages > 1").drop("pages"))
    exact = placed.join(carried.select("file", "mark"), ["file", "mark"]).select("pid", "mark")
    # a line carried by no other page as it stands is held against its own file's carried lines, one word aside
    rest = placed.join(carried.select("file", "mark"), ["file", "mark"], "left_anti").select("pid", "mark", "file", F.explode("less").alias("part"))
    near = rest.join(carried.select("file", F.explode("less").alias("part")).distinct(), ["file", "part"]).select("pid", "mark")
    rep = exact.unionByName(near).groupBy("pid").agg(F.collect_set("mark").alias("rep"))  # at most the lines near a page's edges
    chains = edges.join(rep, "pid", "left").select("page", F.coalesce("rep", F.array().cast("array<bigint>")).alias("rep"), "lines", "top", "foot", "marks")
    some = chains.orderBy(F.xxhash64("page")).limit(SAMPLE_PAGES).collect()
    sides = [x for r in some for x in _sides(r.top, r.foot, r.marks, r.rep)]
    return chains, Model().fit([list(zip(forms, again)) for forms, again in sides if forms])


def _sides(top: str, foot: str, marks, rep) -> list[tuple[str, tuple[bool, ...]]]:
    """(forms, whether each line is carried) of either side."""
    rep = set(rep)
    again = [m != 0 and m in rep for m in marks] if rep else [False] * len(marks)
    return [(top, tuple(again[: len(top)])), (foot, tuple(again[len(top) :]))]


def _edge_labels(lines: int, top: str, foot: str, marks, rep, model: Model):
    """(line number, noise) of the running headers and page numbers among a page's lines near the edges."""
    if not rep and not _NUMBERED.search(top) and not _NUMBERED.search(foot):
        return  # no line is carried, none looks like a number
    for at, (forms, again) in enumerate(_sides(top, foot, marks, rep)):
        for i, s in enumerate(model.labels(forms, again)):
            if s == "H" and again[i] or s == "N" and forms[i] in "db":
                yield (lines - i if at else i + 1), _NAMES[s]


def edge_noise(once: DataFrame, files: DataFrame, key: str = "page_hash") -> DataFrame:
    """(key, line_no, noise) of running headers and page numbers of pages read once."""
    kind = dict(once.dtypes)["page"]
    chains, model = _labelled(once, files)

    def label(batches):
        for b in batches:
            ids, at, noise = [], [], []
            rep, lines, top, foot, marks = (b.column(i).to_pylist() for i in range(1, 6))
            for i, x in enumerate(zip(lines, top, foot, marks, rep)):
                for n, name in _edge_labels(*x, model):
                    ids.append(i)
                    at.append(n)
                    noise.append(name)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(at, pa.int64()), pa.array(noise, pa.string())], [key, "line_no", "noise"])

    return chains.mapInArrow(label, f"{key} {kind}, line_no bigint, noise string")


def find(pages: DataFrame, files: DataFrame, key: str = "page_hash", text: str = "text") -> DataFrame:
    """(key, line_no, noise) of all kinds."""
    once = read_once(pages, key, text)
    counts = pages.sparkSession.sparkContext.broadcast(lexicon(once))
    kind = dict(pages.dtypes)[key]

    def run(batches):
        reader = Reader(*counts.value)
        for b in batches:
            ids, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for r in line_noise(t, reader):
                    ids.append(i)
                    rows.append(r)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], [key, "line_no", "noise"])

    source = pages.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    inner = source.mapInArrow(run, f"{key} {kind}, line_no bigint, noise string").distinct()
    return inner.unionByName(edge_noise(once, files, key))


def running_text(pages: DataFrame, files: DataFrame, key: str = "page_hash", text: str = "text") -> DataFrame:
    """(key, text): headers and page numbers dropped, broken words joined, misread words repaired, lines
    of a paragraph put together as the model labels them; table lines and titles stay by themselves."""
    once = read_once(pages, key, text)
    counts = pages.sparkSession.sparkContext.broadcast(lexicon(once))
    chains, model = _labelled(once, files)
    readers: list[Reader] = []  # one for each task, as it remembers words

    def rebuild(t, rep, lines, top, foot, marks):
        if t is None:
            return None
        if not readers:
            readers.append(Reader(*counts.value))
        drop = {n for n, _ in _edge_labels(lines, top, foot, marks, rep, model)} if lines is not None else set()
        return reassemble(t, drop, readers[0], model)

    texts = pages.select(F.col(key).alias("page"), F.col(text).alias("t")).distinct()
    return texts.join(chains, "page", "left").select(F.col("page").alias(key), F.udf(rebuild, "string", useArrow=True)("t", "rep", "lines", "top", "foot", "marks").alias(text))


def body_labels(lines: list[str], drop: set[int], model: Model) -> str:
    """A label for each line (counted from 1) that isn't dropped, from the top: P, T and X begin a paragraph."""
    kept = [(n, x) for n, x in enumerate(lines, 1) if n not in drop]
    width = max((len(x.rstrip()) for _, x in kept), default=0)
    seen = []
    last = ""
    for k, (n, x) in enumerate(kept):
        body = x.strip()
        if not body:
            form = "blank"
        elif _ROW.match(x):
            form = "table"
        elif body[0].islower():
            form = "lower"
        elif x.startswith("    ") or last and len(last) < 0.6 * width and last[-1] in ".!?:" and body[0].isupper():
            form = "first"  # indented, or after a line that ended early
        elif k < 2 and _TITLE.search(x) and not _RUNNING.search(x) and len(body) < 90:
            form = "title"
        else:
            form = "prose" if body[-1] in ".,;:!?‐¬-" else "plain"
        seen.append((_CODE[form], False))
        last = body
    return model.label(seen, "K")


def reassemble(text: str, drop: set[int], reader: Reader, model: Model | None = None) -> str:
    lines = readable_lines(text)
    broken = {n for n, k in line_noise(text, reader) if k == "hyphen"}  # soft hyphens are read in another way there
    labels = iter(body_labels(lines, drop, model or Model()))
    paragraphs: list[str] = []
    last, glue = "K", False
    for n, line in enumerate(lines, 1):
        if n in drop:
            continue
        label, body = next(labels), line.strip()
        if not body:
            last = "K"
            continue
        if n in broken:
            body = body.rstrip().rstrip("-‐¬–­")
        if glue:
            paragraphs[-1] += body
        elif paragraphs and label not in "PTX" and last not in "KTX":
            paragraphs[-1] += "\n" + body
        else:
            paragraphs.append(body)
        last, glue = label, n in broken
    # words are repaired once broken ones are whole; a line of strings met without misread characters stays
    fix = lambda line: line if not reader.misread(line.split()) else _WORD.sub(lambda m: _like(m, reader), line)
    return "\n\n".join(" ".join(map(fix, p.split("\n"))) for p in paragraphs)


def _like(m: re.Match, reader: Reader) -> str:
    word = m.group()
    if reader.misread_at(word) < 0:
        return word
    r = reader.repair(word)
    letters, signs = sum(c.isalpha() for c in word), sum(c in _SIGNS for c in word)
    if _NUMBER.fullmatch(word) and (r is None or letters < max(2, signs)):
        # an address in the net keeps its characters; the mark at the end of a sentence is no digit
        return word if _in_address(m) else word.rstrip("!").translate(_DIGITS) + "!" * (len(word) - len(word.rstrip("!")))
    if r is None:
        return word
    true = r[0]
    if len(true) != len(word):
        return true.upper() if word.isupper() else true
    return "".join(t.upper() if w.isupper() else t for w, t in zip(word, true))


def _in_address(m: re.Match) -> bool:
    """Whether a word is part of an address in the net: a mail sign, or a dot right before Latin letters."""
    text = m.string
    start, end = m.span()
    while start > 0 and not text[start - 1].isspace():
        start -= 1
    while end < len(text) and not text[end].isspace():
        end += 1
    return _ADDRESS.search(text, start, end) is not None
