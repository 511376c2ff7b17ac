"""Parsing of whole documents: by type, fields, organisations and particulars of invoices, filled from tables, and
checked against each other. Everything but the extraction itself is one native projection of each document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.values import digits, inn_valid, parse_float
from docmill.operators.extract import FIELDS, FOUND, Field, extract_each
from docmill.runtime import once


@dataclass(frozen=True)
class Plan:
    """What is read beside fields and tables."""

    organisations: bool = False
    invoice: bool = False


#: Types with more than fields and tables; any other known type has these two alone, an unknown one is generic.
PLANS = {"invoice": Plan(True, True), **dict.fromkeys(("generic", "payment_order", "act", "invoice_factura", "upd", "torg12", "contract", "reconciliation_act"), Plan(True))}
FIELD_ONLY = ("medical_report", "dismissal", "receipt", "advance_report", "transport_invoice", "corrective_invoice", "corrective_upd", "power_of_attorney", "cash_in", "cash_out", "payroll", "employment", "tax", "ticket")

#: Legal forms, and the characters of a party's name.
_FORM = "(?:ООО|ОАО|ЗАО|ИП|ПАО|АО)"
_NAME = "[А-ЯЁа-яё][А-ЯЁа-яё «»\\-,.]"
_FOUND = f"array<struct<{FOUND}>>"


def found(name: str, value: Column, confidence: float, source: Column | None = None, number: Column | None = None) -> Column:
    """A found value, null where it has none."""
    none = F.lit(None)
    row = F.struct(F.lit(name).alias("field_name"), value.alias("value"), (number if number is not None else none.cast("double")).alias("value_num"), F.lit(confidence).alias("confidence"), (source if source is not None else value).alias("source"))
    return F.when(value.isNotNull(), row)


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, "(?iu)" + pattern, 1), F.lit(""))


def _party(text: Column, role: str) -> Column:
    """The name after a role: up to what can't belong to it."""
    name = _first(text, rf"(?:{role})[:\s]+({_NAME}+?)(?:\n|ИНН|КПП|адрес|тел|БИК|р/с|$)")
    name = F.regexp_replace(F.trim(name), ",+$", "")
    return F.when(F.length(name) > 2, name)


def organisations(text: Column, most: int = 2) -> Column:
    """organization_1, organization_2: the first names with a legal form, of more than three characters."""
    names = F.transform(F.slice(F.regexp_extract_all(text, F.lit(rf"(?u){_FORM}\s*[«\"]([^«»\"\n]+)[»\"]"), F.lit(1)), 1, most), lambda x: F.trim(x))
    kept = F.filter(names, lambda x: F.length(x) > 3)
    row = lambda x, i: F.struct(F.concat(F.lit("organization_"), i + 1).alias("field_name"), x.alias("value"), F.lit(None).cast("double").alias("value_num"), F.lit(0.7).alias("confidence"), x.alias("source"))
    return F.coalesce(F.transform(kept, row), F.array().cast(_FOUND))


def invoice_particulars(text: Column) -> Column:
    """Values that take the place of the general ones: number, parties and their tax numbers, bank, tax."""
    number = _first(text, r"сч[её]т\s*(?:на\s+оплату)?\s*[№N]?\s*[:\-]?\s*[_\s№]*(\d+)")
    vat = _first(text, r"(?:ндс|н\s*д\s*с)[\s:\-/]*(?:в\s+том\s+числе\s+)?([\d ]+[.,]?\d*)")
    amount = parse_float(vat)
    rows = [
        found("document_number", F.when(number != "0", number), 0.9), found("supplier", _party(text, "поставщик"), 0.8), found("buyer", _party(text, "покупатель|заказчик"), 0.8),
        found("supplier_inn", _first(text, r"(?:поставщик[:\s]+[А-ЯЁ\s«»,.\-]+?ИНН|ИНН\s+поставщика)[\s:\-]*(\d{10,12})"), 0.9),
        found("buyer_inn", _first(text, r"(?:(?:покупатель|заказчик)[:\s]+[А-ЯЁ\s«»,.\-]+?ИНН|ИНН\s+(?:покупателя|заказчика))[\s:\-]*(\d{10,12})"), 0.9),
        found("bic", _first(text, r"БИК\s*[:\-]?\s*(\d{9})"), 0.9), found("vat", F.when(amount != 0, F.format_string("%.2f", amount)), 0.8, vat, amount),
    ]
    return F.array_compact(F.array(*rows))


def _row(rows: Column, name: str) -> Column:
    return F.get(F.filter(rows, lambda x: x["field_name"] == name), F.lit(0))


def _value(rows: Column, name: str) -> Column:
    return _row(rows, name)["value"]


def _over(low: Column, high: Column) -> Column:
    """low with what high holds put in its place."""
    names = F.transform(high, lambda x: x["field_name"])
    return F.concat(high, F.filter(low, lambda x: ~F.array_contains(names, x["field_name"])))


def _fill(rows: Column, more: Column) -> Column:
    """rows with those of more that they lack."""
    return _over(more, rows)


def _invoice_fallbacks(rows: Column, text: Column) -> Column:
    """Parties from the organisations, tax numbers beside the names, and a loosely written date, where these lack."""
    trimmed = lambda c: F.nullif(F.regexp_replace(F.trim(c), "[»,]+$", ""), F.lit(""))
    supplier = F.coalesce(_value(rows, "supplier"), F.when(F.length(_value(rows, "organization_1")) > 2, trimmed(_value(rows, "organization_1"))))
    buyer = F.coalesce(_value(rows, "buyer"), F.when(F.length(_value(rows, "organization_2")) > 2, trimmed(_value(rows, "organization_2"))))

    def beside(name: Column) -> Column:
        """The tax number that follows the name's first twenty characters, with no figure between."""
        place = F.instr(text, F.substring(name, 1, 20))
        return F.when(place > 0, F.nullif(F.regexp_extract(F.substr(text, place + F.least(F.lit(20), F.length(name))), r"(?iu)^\D*ИНН\s*[:\-]?\s*(\d{10,12})", 1), F.lit("")))

    date = _first(text, r"(\d{1,2}[./ ]\d{1,2}[./ ]\d{4}|\d{1,2}\s+[а-яё]+\s+20\d{2})")
    return _fill(rows, F.array_compact(F.array(found("supplier", supplier, 0.7), found("buyer", buyer, 0.7), found("supplier_inn", beside(supplier), 0.8), found("buyer_inn", beside(buyer), 0.8), found("date", date, 0.7))))


#: The values that the checks look at, as a struct of columns; names that a table lacks are null.
CHECKED = ("total_with_vat", "total_without_vat", "vat", "amount", "supplier", "supplier_inn", "buyer", "buyer_inn", "date")


def check(values: dict[str, Column], confidences: dict[str, Column], now: Column, years: int = 20) -> dict[str, Column]:
    """Checks between fields, in this order, later warnings in place of earlier ones: the amount with tax is the sum
    of the other two; the parties' tax numbers have sound check digits; the date is neither to come nor too old;
    amounts aren't negative, and with tax isn't less than without. Gives for each checked field f the columns
    f_warning and f_confidence, and total_with_vat_corrected."""
    v = {k: values.get(k, F.lit(None)) for k in CHECKED}
    num = {k: v[k].cast("double") for k in ("total_with_vat", "total_without_vat", "vat", "amount")}
    given = lambda c: F.coalesce(c != 0, F.lit(False))
    text = lambda c: F.coalesce(c.cast("string") != "", F.lit(False))
    conf = {k: confidences.get(k, F.lit(0.8)) for k in CHECKED}
    total = num["total_without_vat"] + num["vat"]
    off = given(num["total_with_vat"]) & given(num["total_without_vat"]) & given(num["vat"]) & (F.abs(num["total_with_vat"] - total) > 0.01)
    negative, less = F.coalesce(num["total_with_vat"] < 0, F.lit(False)), given(num["total_with_vat"]) & given(num["total_without_vat"]) & (num["total_with_vat"] < num["total_without_vat"])
    c = F.when(off, F.greatest(F.lit(0.5), conf["total_with_vat"] - 0.2)).otherwise(conf["total_with_vat"])
    c = F.when(negative, F.greatest(F.lit(0.0), c - 0.3)).otherwise(c)
    c = F.when(less, F.greatest(F.lit(0.0), c - 0.2)).otherwise(c)
    out = {
        "total_with_vat_warning": F.when(less, "less_than_without_vat").when(negative, "negative").when(off, "vat_mismatch"),
        "total_with_vat_corrected": F.when(off, F.round(total, 2)), "total_with_vat_confidence": c,
    }
    below = F.coalesce(num["amount"] < 0, F.lit(False))
    out |= {"amount_warning": F.when(below, "negative"), "amount_confidence": F.when(below, F.greatest(F.lit(0.0), conf["amount"] - 0.3)).otherwise(conf["amount"])}
    for who in ("supplier", "buyer"):
        bad = text(v[who]) & text(v[f"{who}_inn"]) & ~F.coalesce(inn_valid(v[f"{who}_inn"].cast("string")), F.lit(False))
        out |= {f"{who}_inn_warning": F.when(bad, "unsound_inn"), f"{who}_inn_confidence": F.when(bad, F.greatest(F.lit(0.0), conf[f"{who}_inn"] - 0.3)).otherwise(conf[f"{who}_inn"])}
    raw = v["date"].cast("string")
    day = F.coalesce(*[F.when(raw.rlike(p), F.try_to_timestamp(raw, F.lit(f)).cast("date")) for p, f in ((r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{2}\.\d{2}\.\d{4}$", "dd.MM.yyyy"), (r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"))])
    future, old = F.coalesce(day > now, F.lit(False)), F.coalesce(day < F.date_sub(now, 365 * years), F.lit(False))
    out |= {"date_warning": F.when(old, "too_old").when(future, "future"), "date_confidence": F.when(future, F.greatest(F.lit(0.0), conf["date"] - 0.2)).when(old, F.greatest(F.lit(0.0), conf["date"] - 0.1)).otherwise(conf["date"])}
    return out


def parse_documents(docs: DataFrame, key: str, text: str, kind: str, table_fields: DataFrame | None = None, now: Column | None = None, fields: tuple[Field, ...] = FIELDS, plans: dict[str, Plan] | None = None) -> DataFrame:
    """Tall rows (key, kind, field_name, value, confidence, warning, auto_corrected). The plan goes by the document's
    type, a type that is neither known nor field-only is generic. table_fields: (key, field_name, value, confidence)
    read from tables, for what the text lacks. Narrow but for the join with these."""
    plans = plans or PLANS
    base = docs.select(F.col(key).alias("__k"), F.col(text).alias("__t"), F.col(kind).alias("__kind"))
    d = extract_each(base, "__k", "__t", fields, keep=("__t", "__kind"))
    if table_fields is not None:
        row = F.struct("field_name", "value", F.lit(None).cast("double").alias("value_num"), "confidence", F.lit("table").alias("source"))
        grouped = table_fields.groupBy(F.col(key).alias("__k")).agg(F.collect_list(row).alias("__tables"))  # a few fields a document
        d = d.join(grouped, "__k", "left")
    else:
        d = d.withColumn("__tables", F.lit(None).cast(_FOUND))
    t = F.coalesce("__t", F.lit(""))
    invoice = F.col("__kind").isin([k for k, p in plans.items() if p.invoice])
    plain = F.coalesce(F.col("__kind").isin(list(FIELD_ONLY)), F.lit(False))
    empty = F.array().cast(_FOUND)
    d = once(d, __orgs=F.when(plain, empty).otherwise(organisations(t)), __own=F.when(invoice, invoice_particulars(t)).otherwise(empty))
    d = once(d, __rows=_over(_over(F.col("found"), F.col("__orgs")), F.col("__own")))
    d = once(d, __full=F.when(invoice, _invoice_fallbacks(F.col("__rows"), t)).otherwise(F.col("__rows")))
    d = once(d, __all=_fill(F.col("__full"), F.coalesce("__tables", empty)))
    at = {k: _row(F.col("__all"), k) for k in CHECKED}
    d = once(d, **{f"__v_{k}": c for k, c in at.items()})
    figures = ("total_with_vat", "total_without_vat", "vat", "amount")
    d = once(d, **{f"__n_{k}": parse_float(F.col(f"__v_{k}.value")) for k in figures}, **{f"__n_{k}": digits(F.col(f"__v_{k}.value")) for k in ("supplier_inn", "buyer_inn")})
    values = {k: F.col(f"__n_{k}" if k in figures or k.endswith("_inn") else f"__v_{k}.value") for k in CHECKED}
    d = once(d, **{f"__c_{n}": c for n, c in check(values, {k: F.col(f"__v_{k}.confidence") for k in CHECKED}, now if now is not None else F.current_date()).items()})
    d = d.select("__k", "__kind", F.explode("__all").alias("x"), *[c for c in d.columns if c.startswith("__c_")])
    name = F.col("x.field_name")
    warned = [c.removesuffix("_warning").removeprefix("__c_") for c in d.columns if c.endswith("_warning")]
    return d.select(
        F.col("__k").alias(key), F.col("__kind").alias(kind), name.alias("field_name"), F.col("x.value").alias("value"),
        F.round(F.coalesce(*[F.when(name == w, F.col(f"__c_{w}_confidence")) for w in warned], F.col("x.confidence")), 6).alias("confidence"),
        F.coalesce(*[F.when(name == w, F.col(f"__c_{w}_warning")) for w in warned]).alias("warning"),
        F.when(name == "total_with_vat", F.col("__c_total_with_vat_corrected")).alias("auto_corrected"),
    )


def fields_of_tables(tall: DataFrame, key: str) -> DataFrame:
    """(key, field_name, value, confidence) from table columns, by words of their headers: of each column the first
    sound tax number, the supplier's, then another column's as the buyer's; the first code of nine digits of kpp and
    bank columns; and the last number of all-numeric sum columns, if over nought, as amount, a second column's as total."""
    v = F.trim("value")
    n = F.regexp_replace(F.translate(v, ",", "."), r"[\s\x{a0}]", "").try_cast("double")
    place = F.struct("table_no", "row_no")
    per = tall.where("value is not null").groupBy(key, "table_no", "col_no", F.col("header")).agg(
        F.min_by(digits(v), F.when(F.coalesce(inn_valid(digits(v)), F.lit(False)), place)).alias("inn"), F.min_by(v, F.when(v.rlike(r"^\d{9}$"), place)).alias("nine"),
        F.when(F.every(n.isNotNull()), F.max_by(n, place)).alias("last"),
    )
    hl = F.lower("header")
    role = F.when(hl.contains("инн"), "inn").when(hl.contains("кпп"), "kpp").when(hl.contains("бик"), "bic").when(hl.rlike("сумма|итого|всего|к оплате|стоимость"), "sum")
    value = F.when(F.col("role") == "inn", F.col("inn")).when(F.col("role") == "sum", F.when(F.col("last") > 0, F.format_string("%.2f", "last"))).otherwise(F.col("nine"))
    got = per.withColumn("role", role).where("role is not null").select(key, "role", F.struct("table_no", "col_no").alias("at"), value.alias("value")).where("value is not null")
    first = got.groupBy(key, "role").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "value"))), 1, 2).alias("two"))  # columns of one document
    names = F.create_map(*[F.lit(x) for x in ("inn", "supplier_inn", "kpp", "kpp", "bic", "bic", "sum", "amount")])
    seconds = F.create_map(*[F.lit(x) for x in ("inn", "buyer_inn", "sum", "total_with_vat")])
    some = first.select(key, "role", F.posexplode("two").alias("i", "x"))
    field = F.when(F.col("i") == 0, F.try_element_at(names, F.col("role"))).otherwise(F.try_element_at(seconds, F.col("role")))
    return some.select(key, field.alias("field_name"), "x.value", F.when(F.col("role") == "sum", 0.9).otherwise(0.8).alias("confidence")).where("field_name is not null")
