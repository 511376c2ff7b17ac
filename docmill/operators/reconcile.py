"""Key-value reading of reconciliation acts, on native columns over the lines of a text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.runtime import once

#: How the number of an act is written, misread signs among them, the surest way first.
NUMBERS = (r"[№НN]\s*(?:ЦБ|ЛБ|ТЗ|АС|АСВ)[\s\-]*([0-9]+)", r"[№NН]\s*([0-9]{4,})", r"номер[:\s]+([0-9]{4,})", r"[№NН][oо]?\s*([0-9]{4,})")
#: How its date is written; a month by its name gives none.
DATES = (r"[оo][тt]\s+([0-9]{1,2})[.\s]+([0-9]{1,2})[.\s]+([0-9]{4})", r"([0-9]{1,2})[.\s]+([0-9]{1,2})[.\s]+([0-9]{4})\s+г")
#: Words before the balance at the end.
BALANCES = (r"исходящее\s+сальдо", r"конечное\s+сальдо", r"на\s+[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}\s+остаток", r"итого\s+задолженность", r"остаток\s+на\s+конец", r"всего\s+по\s+акту", r"итого\s+по\s+акту")
#: How organisations are named, and words that one follows.
NAMED = (r"(?:ООО|ПАО|ЗАО|АО|ИП|ОБЩЕСТВО)\s*[«\"]([^«»\"]+)[»\"]", r"[«\"]([А-ЯЁа-яё][А-ЯЁа-яё ]{5,30})[»\"]")
ANCHORS = (r"мы,?\s+нижеподписавшиеся", r"с\s+одной\s+стороны", "организация", r"с\s+другой\s+стороны", r"в\s+лице", r"взаимных\s+расч[её]тов\s+с", r"акционерное\s+общество")
_AFTER = r"[:\s]+([А-ЯЁа-яё][А-ЯЁа-яё ]{4,49}?)(?:\s+ИНН|\s+г\.|\s+адрес|$)"
FIRST_LINES, LAST_LINES, MOST_NAMES = 5, 50, 3


def act_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, "(?iu)" + pattern, group), F.lit(""))


def _all(text: Column, pattern: str, flags: str = "(?iu)") -> Column:
    return F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(1))


def _amount(raw: Column) -> Column:
    return F.replace(F.replace(F.trim(raw), F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def act_number(head: Column) -> Column:
    return F.coalesce(*[_first(head, p) for p in NUMBERS])


def act_date(head: Column) -> Column:
    """dd.mm.yyyy."""
    one = lambda p: F.when(_first(head, p).isNotNull(), F.concat_ws(".", F.lpad(_first(head, p, 1), 2, "0"), F.lpad(_first(head, p, 2), 2, "0"), _first(head, p, 3)))
    return F.coalesce(*[one(p) for p in DATES])


def organisations(text: Column) -> Column:
    """The first different names of 5 to 100 characters, by the ways of naming and then after the anchors."""
    every = F.concat(*[_all(text, p) for p in NAMED], *[_all(text, a + _AFTER, "(?ium)") for a in ANCHORS])
    return F.slice(F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: F.length(x).between(5, 100))), 1, MOST_NAMES)


def counterparty(names: Column, own: str | None) -> Column:
    """Of several names the first that isn't our own, else the second; a single one if it isn't ours."""
    ours = (lambda x: F.upper(x).contains(own.upper())) if own else (lambda x: F.lit(False))
    other = F.get(F.filter(names, lambda x: ~ours(x)), F.lit(0))
    return F.when(F.size(names) >= 2, F.coalesce(other, F.get(names, F.lit(1)))).otherwise(other)


def counterparty_inn(text: Column, own: str | None) -> Column:
    """The first tax number, the second if the first is our own and there is one; check digits don't count."""
    inns = _all(text, r"ИНН[\s:]*([0-9]{10,12})")
    first, second = F.get(inns, F.lit(0)), F.get(inns, F.lit(1))
    return F.when((first == own) & second.isNotNull(), second).otherwise(first) if own else first


def final_balance(tail: Column) -> Column:
    """The largest amount after a word for the balance; without any the largest number from a thousand to a thousand
    millions; else 0."""
    named = reduce(lambda a, b: F.concat(a, b), [_all(tail, k + r"[\s:]*([0-9][0-9 ,.]*)") for k in BALANCES])
    top = F.coalesce(F.array_max(F.transform(named, _amount)), F.lit(0.0))
    numbers = F.transform(F.regexp_extract_all(tail, F.lit(r"([0-9][0-9 ,.]*)"), F.lit(1)), _amount)
    return F.when(top > 0, top).otherwise(F.coalesce(F.array_max(F.filter(numbers, lambda x: x.between(1000, 1e9))), F.lit(0.0)))


def we_owe(text: Column, other: Column, own: str | None) -> Column:
    """False only where "по данным" names the counterparty before it names us."""
    if not own:
        return F.lit(True)
    said = F.transform(_all(text, r"по\s+данным\s+([^.]+)"), lambda x: F.upper(x))
    us = lambda x: x.contains(own.upper())
    them = lambda x: F.coalesce(x.contains(F.substring(F.upper(other), 1, 15)), F.lit(False))
    first = F.get(F.filter(said, lambda x: us(x) | them(x)), F.lit(0))
    return F.coalesce(us(first), F.lit(True))


def parse_act(docs: DataFrame, key: str, text: str, own_name: str | None = None, own_inn: str | None = None) -> DataFrame:
    """(key, act_number, act_date, counterparty, counterparty_inn, final_balance, we_owe, confidence): number and date
    stand in the first lines, the balance in the last ones. Null and empty texts have no values, balance 0 and
    confidence 0. Narrow; each part is computed once."""
    d = once(docs.select(key, F.coalesce(text, F.lit("")).alias("__t")), __lines=act_lines(F.col("__t")))
    head = F.array_join(F.slice("__lines", 1, FIRST_LINES), " ")
    tail = F.array_join(F.when(F.size("__lines") > LAST_LINES, F.slice("__lines", -LAST_LINES, LAST_LINES)).otherwise(F.col("__lines")), "\n")
    d = once(d, act_number=act_number(head), act_date=act_date(head), __names=organisations(F.col("__t")), counterparty_inn=counterparty_inn(F.col("__t"), own_inn), final_balance=final_balance(tail))
    d = once(d, counterparty=counterparty(F.col("__names"), own_name))
    d = once(d, we_owe=we_owe(F.col("__t"), F.col("counterparty"), own_name))
    given = lambda c, w: F.when(c.isNotNull(), w).otherwise(0.0)
    conf = given(F.col("act_number"), 0.15) + given(F.col("act_date"), 0.15) + given(F.col("counterparty"), 0.25) + given(F.col("counterparty_inn"), 0.20) + F.when(F.col("final_balance") > 0, 0.25).otherwise(0.0)
    return d.select(key, "act_number", "act_date", "counterparty", "counterparty_inn", "final_balance", "we_owe", F.round(F.least(conf, F.lit(1.0)), 2).alias("confidence"))


def money(c: Column) -> Column:
    """1234567.5 as "1 234 567,50"."""
    return F.translate(F.format_number(c, 2), ",.", " ,")


def card(acts: DataFrame) -> DataFrame:
    """acts with formatted_text, a card of lines in Russian, lines of what is missing left out."""
    c, balance = F.col("counterparty"), money(F.col("final_balance"))
    number, date = F.col("act_number"), F.col("act_date")
    title = F.concat(F.lit("Акт сверки"), F.coalesce(F.concat(F.lit(" № "), number), F.lit("")), F.coalesce(F.concat(F.lit(" от "), date), F.lit("")))
    owed = F.col("final_balance") > 0
    lines = F.array(
        title, F.concat(F.lit("Контрагент: "), c), F.concat(F.lit("ИНН: "), F.col("counterparty_inn")), F.concat(F.lit("По данным "), c, F.when(F.col("we_owe"), " (наша организация)").otherwise(" (контрагент)")),
        F.when(owed, F.concat(F.lit("Остаток: "), balance, F.lit(" руб."))), F.when(owed, F.concat(F.when(F.col("we_owe"), "Вы должны поставщику ").otherwise("Вам должны "), balance, F.lit(" руб."))),
    )
    return acts.withColumn("formatted_text", F.array_join(F.array_compact(lines), "\n"))


def act_fields(acts: DataFrame, key: str) -> DataFrame:
    """Tall rows (key, field_name, value, confidence) of what was found, each with 0.9; the balance only if over nought.
    Number and date also stand under the names that the history reads, so that duplicates of acts are found."""
    names = {"act_number": "act_number", "act_date": "act_date", "counterparty": "counterparty", "counterparty_inn": "counterparty_inn", "document_number": "act_number", "date": "act_date"}
    rows = [F.struct(F.lit(n).alias("field_name"), F.col(c).alias("value")) for n, c in names.items()]
    rows.append(F.struct(F.lit("final_balance").alias("field_name"), F.when(F.col("final_balance") > 0, F.format_string("%.2f", "final_balance")).alias("value")))
    return acts.select(key, F.explode(F.array(*rows)).alias("x")).select(key, "x.field_name", "x.value", F.lit(0.9).alias("confidence")).where("value is not null")
