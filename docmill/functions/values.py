"""Parsing and checking of field values as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the check digits of tax numbers, and months.
W10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
W11 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
W12 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _control(c: Column, weights: tuple[int, ...]) -> Column:
    total = sum((F.substring(c, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))
    return F.pmod(F.pmod(total, F.lit(11)), F.lit(10))


def _digit(c: Column, place: int) -> Column:
    return F.substring(c, place, 1).cast("int")


def inn_valid(c: Column) -> Column:
    """Check digits of a tax number of 10 or 12 digits, signs left out; null for null."""
    d = digits(c)
    ten = _control(d, W10) == _digit(d, 10)
    twelve = (_control(d, W11) == _digit(d, 11)) & (_control(d, W12) == _digit(d, 12))
    return F.when(c.isNull(), F.lit(None)).when(F.length(d) == 10, ten).when(F.length(d) == 12, twelve).otherwise(False)


def inn_adjusted(value: Column, confidence: Column) -> tuple[Column, Column]:
    """Value and confidence after the check: +0.1 up to 1, or no value and -0.2 down to 0."""
    ok = inn_valid(value)
    return F.when(ok, value), F.when(ok, F.least(F.lit(1.0), confidence + 0.1)).otherwise(F.greatest(F.lit(0.0), confidence - 0.2))


def parse_float(c: Column) -> Column:
    """Decimal comma, blanks and signs of money allowed; null where that gives no number."""
    text = F.regexp_replace(F.regexp_replace(F.translate(c, ",", "."), r"[\s\x{a0}]", ""), r"[^\d.\-]", "")
    return F.when(text.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), text.try_cast("double"))


def parse_date(c: Column) -> Column:
    """ISO date of the first of dd.mm.yyyy, dd mm yyyy, yyyy-mm-dd, dd-mm-yyyy, "d month yyyy"; else null."""

    def one(pattern: str, order: str) -> Column:
        found = F.regexp_extract(c, pattern, 0)
        return F.when(found != "", F.date_format(F.try_to_timestamp(found, F.lit(order)), "yyyy-MM-dd"))

    named = F.lower(F.trim(c))
    for i, month in enumerate(MONTHS, 1):
        named = F.replace(named, F.lit(f" {month} "), F.lit(f".{i:02d}."))
    spelt = F.when(named.rlike(r"^\d{1,2}\.\d{2}\.\d{4}$"), F.date_format(F.try_to_timestamp(F.lpad(named, 10, "0"), F.lit("dd.MM.yyyy")), "yyyy-MM-dd"))
    return F.coalesce(
        one(r"\d{2}\.\d{2}\.\d{4}", "dd.MM.yyyy"), one(r"\d{2} \d{2} \d{4}", "dd MM yyyy"), one(r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"), one(r"\d{2}-\d{2}-\d{4}", "dd-MM-yyyy"), spelt
    )


def parse_text(c: Column) -> Column:
    text = F.trim(F.regexp_replace(c, r"[\s\x{a0}]+", " "))
    return F.when(text != "", text)


def parse_digits(c: Column, least: int = 1, most: int = 40) -> Column:
    """Exactly so many digits as a string, leading noughts kept; null otherwise."""
    return F.when(c.rlike(rf"^\d{{{least},{most}}}$"), c)


PARSERS = {
    "digits_10_12": lambda c: parse_digits(c, 10, 12), "digits_9": lambda c: parse_digits(c, 9, 9), "digits_20": lambda c: parse_digits(c, 20, 20),
    "digits": lambda c: F.when(digits(c) != "", digits(c)), "float": parse_float, "date": parse_date, "text": parse_text,
}


def vat_check(with_vat: Column, without: Column, vat: Column, confidence: Column) -> Column:
    """struct(warning, auto_corrected, confidence) where all three are given and differ by more than a cent."""
    off = (with_vat != 0) & (without != 0) & (vat != 0) & (F.abs(with_vat - (without + vat)) > 0.01)
    return F.when(off, F.struct(F.lit("vat_mismatch").alias("warning"), (without + vat).alias("auto_corrected"), F.greatest(F.lit(0.5), confidence - 0.2).alias("confidence"))).otherwise(
        F.struct(F.lit(None).cast("string").alias("warning"), F.lit(None).cast("double").alias("auto_corrected"), confidence.alias("confidence"))
    )


def saldo_expected(start: Column, debit: Column, credit: Column, end: Column) -> Column:
    """The balance that should stand where the one given is off by more than a cent; else null."""
    expected = F.bround(start + debit - credit, 2)
    return F.when(F.abs(expected - end) > 0.01, expected)


def date_warning(iso: Column, now: Column, years: int = 20) -> Column:
    """Future dates and dates older than years * 365 days."""
    d = F.try_to_date(iso, "yyyy-MM-dd")
    return F.when(d > now, "future").when(d < F.date_sub(now, 365 * years), "too_old")


def amount_penalty(amount: Column, with_vat: Column, without: Column) -> Column:
    return F.when((amount < 0) | (with_vat < 0) | (without < 0), 0.3).otherwise(0.0) + F.when(with_vat < without, 0.2).otherwise(0.0)
