"""Correction of recognised text: rule tables as data, characters by context, words by a dictionary."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.runtime import prepare

#: Latin letters and digits that are read for Cyrillic letters.
TO_CYRILLIC = str.maketrans("AaBCcEeHKMOoPpTXxy036", "АаВСсЕеНКМОоРрТХхуОЗб")


#: Scraps that recognition leaves, whatever the type: single letters and figures between blanks, short
#: stretches with points, words with a mark, three short words in a row; dates with colons; decimal commas; blanks.
GARBAGE = (
    (r"\s+[A-Za-zА-Яа-я]\s+", " "),
    (r"\b[A-Za-zА-Яа-я]{1,2}\.[A-Za-zА-Яа-я]{1,2}\.\b", ""),
    (r"\b[A-Za-zА-Яа-я]{1,2}\.\s+[а-яА-Я]\b", ""),
    (r"\b\d{4,}\+?\.\b", ""),
    (r"\b[A-Za-zА-Яа-я]{5,}!\b", ""),
    (r"\s+[а-яА-Яa-zA-Z0-9]\s+", " "),
    (r"\b[а-яА-Яa-zA-Z]{1,2}\s+[а-яА-Яa-zA-Z]{1,2}\s+[а-яА-Яa-zA-Z]{1,2}\b", ""),
    (r"(\d{1,2}):(\d{2}):(\d{4})", r"\1.\2.\3"),
    (r"(\d+),(\d{2})", r"\1.\2"),
)
#: Words of each type that are put into their usual form, whatever their case and look-alikes.
FORMS = {
    "invoice": ("счет", "счёт", "инвойс", "поставщик", "покупатель", "НДС", "итого"),
    "payment_order": ("платежное поручение", "платёжное поручение", "БИК", "р/с", "к/с"),
    "upd": ("УПД", "универсальный передаточный документ", "статус"),
    "torg12": ("ТОРГ-12", "товарная накладная", "грузоотправитель", "грузополучатель"),
    "medical_report": ("лаборатория", "пациент", "исследование", "результат"),
    "contract": ("договор", "контракт", "стороны", "предмет договора"),
}
_ALIKE = {"а": "аa", "в": "вb", "е": "еe", "к": "кk", "м": "мm", "н": "нh", "о": "оo0", "р": "рp", "с": "сc", "т": "тt", "у": "уy", "х": "хx"}


def form_rule(words: str) -> tuple[str, str]:
    """A pattern for the words with look-alike letters, and the words themselves."""
    spelt = "".join(r"\s+" if c == " " else "[- ]?" if c == "-" else f"[{_ALIKE[c]}]" if c in _ALIKE else re.escape(c) for c in words.lower())
    return rf"(?<!\w){spelt}(?!\w)", words.replace("\\", r"\\")


BY_TYPE = {kind: tuple(map(form_rule, words)) for kind, words in FORMS.items()}


@dataclass(frozen=True)
class Rules:
    """Ordered (pattern, replacement) pairs for all texts and for one type each, and the words that are known."""

    everywhere: tuple[tuple[str, str], ...] = ((r"(\d{1,2})[. ]+(\d{1,2})[. ]+(\d{4})", r"\1.\2.\3"), (r"[№N]\s*(\d+)", r"№ \1"))
    by_type: dict[str, tuple[tuple[str, str], ...]] = field(default_factory=lambda: BY_TYPE)
    garbage: tuple[tuple[str, str], ...] = field(default_factory=lambda: GARBAGE)
    words: tuple[str, ...] = ("акт", "сверки", "договор", "счет", "сальдо", "дебет", "кредит", "оборот", "итого", "накладная", "поставщик", "покупатель", "плательщик", "получатель", "директор", "бухгалтер")
    likeness: float = 0.7


def likeness(a: str, b: str) -> float:
    """0.7 of the overlap of letters, 0.3 of the likeness of lengths; anagrams are alike."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = set(a), set(b)
    return 0.7 * len(x & y) / len(x | y) + 0.3 * (1 - abs(len(a) - len(b)) / max(len(a), len(b)))


class Corrector:
    def __init__(self, rules: Rules):
        compile_ = lambda pairs: [(re.compile(p, re.I), r) for p, r in pairs]
        self.rules, self.everywhere = rules, compile_(rules.everywhere)
        self.by_type = {k: compile_(v) for k, v in rules.by_type.items()}
        self.garbage = [(re.compile(p), r) for p, r in rules.garbage]
        self.known: dict[str, str] = {w: w for w in rules.words}

    def characters(self, token: str) -> str:
        if re.search("[а-яё]", token, re.I):
            return token.translate(TO_CYRILLIC) if re.search("[A-Za-z]", token) else token
        if re.fullmatch(r"[0-9OIl|]+", token) and re.search(r"\d", token):
            return token.replace("O", "0").replace("I", "1").replace("l", "1").replace("|", "1")
        return token

    def word(self, token: str) -> str:
        core = re.sub(r"\W", "", token).lower()
        if len(core) < 3 or core.isdigit():
            return token
        if core not in self.known:
            if len(self.known) > 200_000:
                self.known = {w: w for w in self.rules.words}
            score, best = max(((likeness(core, w), w) for w in self.rules.words), key=lambda s: s[0], default=(0.0, ""))
            self.known[core] = best if score > self.rules.likeness and abs(len(best) - len(core)) <= 1 and best[:1] == core[:1] else core
        new = self.known[core]
        if new == core:
            return token
        shaped = new.upper() if core.upper() in token else new.capitalize() if token[:1].isupper() else new
        return token.replace(next((m for m in re.findall(r"\w+", token)), core), shaped, 1)

    def __call__(self, text: str | None, kind: str | None = None) -> str | None:
        if not text:
            return text
        lines = []
        for line in text.split("\n"):  # lines are kept, as later steps vote on them
            line = re.sub(r"[^\S\n]+", " ", line).strip()
            for pattern, new in self.everywhere:
                line = pattern.sub(new, line)
            line = re.sub(r"\w+", lambda m: self.characters(m.group()), line)
            line = " ".join(self.word(w) for w in line.split(" "))
            for pattern, new in self.by_type.get(kind or "", ()):
                line = pattern.sub(new, line)
            for pattern, new in self.garbage:
                line = pattern.sub(new, line)
            lines.append(self.finish(line))
        return "\n".join(lines)

    @staticmethod
    def finish(line: str) -> str:
        """One blank between words, none before punctuation, one kind of quotation mark and dash."""
        line = re.sub(r"\s+([.,;:!?])", r"\1", re.sub(r"\s+", " ", line))
        return line.translate(str.maketrans("«»„“”−–—", '"""""---')).strip()


def correct(df: DataFrame, text: str, kind: str | None = None, rules: Rules | None = None) -> DataFrame:
    """df with its text corrected; kind is the column of the type, whose rules are used too. Narrow; in Arrow batches,
    with the rules compiled once."""
    prepare(df.sparkSession)
    fix = Corrector(rules or Rules())
    if kind is None:
        return df.withColumn(text, F.udf(lambda t: fix(t), "string", useArrow=True)(text))
    return df.withColumn(text, F.udf(lambda t, k: fix(t, k), "string", useArrow=True)(text, kind))


def keep_by_confidence(lines: Column, least: float = 0.1) -> tuple[Column, Column]:
    """(text, mean confidence) of array<struct<text, confidence>>: the lines surer than least, one to a line."""
    kept = F.filter(lines, lambda s: s["confidence"] > least)
    mean = F.aggregate(kept, F.lit(0.0), lambda a, s: a + s["confidence"]) / F.size(kept)
    return F.array_join(F.transform(kept, lambda s: s["text"]), "\n"), F.when(F.size(kept) > 0, mean).otherwise(0.0)


#: Words of requisites, those that name a column by themselves, and words of common columns.
REQUISITES = ("банк", "бik", "бик", "сч.", "счет", "р/с", "к/с", "получатель", "отправитель")
LABELS = ("бик", "бik", "сч.", "счет", "р/с", "к/с")


def header_like(cell: Column, value: Column, used: Column) -> Column:
    """Whether a cell names a column, by rules in this order: an empty or long one doesn't; a word of requisites does by
    itself, but not within a longer text; figures alone don't, nor a longer text in quotation marks; above an empty
    value it does if the rows below use it; any other does."""
    low = F.lower(cell)
    bank = reduce(lambda a, b: a | b, (low.contains(w) for w in REQUISITES))
    return (
        F.when(cell.isNull() | (cell == ""), F.lit(False)).when(F.length(cell) > 50, False).when(bank & low.isin(list(LABELS)), True).when(bank & (F.length(cell) > 15), False)
        .when(F.trim(cell).rlike("^[0-9]+$"), False).when((cell.contains("«") | cell.contains("»")) & (F.length(cell) > 20), False).when(value.isNull() | (F.trim(value) == ""), F.coalesce(used, F.lit(False))).otherwise(True)
    )


def preferred_order(fields: DataFrame, kind: str, name: str, preferred: dict[str, list[str]]) -> DataFrame:
    """fields with a rank for each type: the preferred names in their order, then the rest by name."""
    pairs = [F.when((F.col(kind) == k) & (F.col(name) == n), i) for k, names in preferred.items() for i, n in enumerate(names)]
    return fields.withColumn("rank", F.coalesce(*pairs, F.lit(1_000_000)))
