"""Field extraction from a pattern table, and the checks between fields.

Matching needs the places of matches, so a text goes once through an Arrow batch in which its fields are found,
parsed, checked and chosen; everything after that is native. A pattern table comes from a configuration file or is
the small one below.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import normalize_for_ocr
from docmill.functions.values import MONTHS, W10, W11, W12
from docmill.runtime import prepare


@dataclass(frozen=True)
class Pattern:
    pattern: str
    priority: int = 5
    context_keywords: tuple[str, ...] = ()


@dataclass(frozen=True)
class Field:
    name: str
    patterns: tuple[Pattern, ...]
    validate: str = "text"
    checked_inn: bool = False


#: What stands near a field, within NEAR characters.
CONTEXT = {
    "supplier": "поставщик|продавец", "buyer": "покупатель|заказчик", "amount": r"сумма|итого|всего\s+к\s+оплате", "date": r"дата|от\s+[0-9]",
    "document_number": r"счет|счёт|документ|№|N\s*[0-9]", "inn": "инн", "bic": "бик",
}
NEAR = 200
#: Fields whose tax number must have sound check digits.
CHECKED = ("inn", "supplier_inn", "buyer_inn", "payer_inn", "recipient_inn", "seller_inn", "executor_inn", "customer_inn", "party1_inn", "party2_inn")

#: A small table for the papers of the test tables; larger ones come from a configuration file.
FIELDS = (
    Field("document_number", (Pattern(r"№\s*([^\s,;]+)", 8),)),
    Field("date", (Pattern(r"[\s(]от\s+([0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})", 9), Pattern(r"dated\s+([0-9]{2}\.[0-9]{2}\.[0-9]{4})", 7)), "date"),
    Field("amount", (Pattern(r"на сумму\s+([0-9 ]+[.,][0-9]{2})", 8), Pattern(r"в размере\s+([0-9 ]+[.,][0-9]{2})", 6, ("руб",))), "float"),
    Field("inn", (Pattern(r"ИНН[\s:]*([0-9]{10,12})", 8),), "digits_10_12", True),
    Field("bic", (Pattern(r"БИК[\s:]*([0-9]{9})", 8),), "digits_9"),
    Field("account_number", (Pattern(r"р/с[\s:]*([0-9]{20})", 8), Pattern(r"Account\s+([0-9]{20})", 6)), "digits_20"),
    Field("contract_number", (Pattern(r"договор[ауе]?\s+№\s*([^\s,;]+)", 7),)),
)


def fields_from_config(config: dict, checked: tuple[str, ...] = CHECKED) -> tuple[Field, ...]:
    """From a configuration: fields with a list of patterns, or the older single pattern (priority 5, no context
    words); other shapes are left out. checked: the fields whose check digits count."""
    out = []
    for name, spec in config.items():
        raw = spec.get("patterns") or ([{"pattern": spec["pattern"]}] if "pattern" in spec else [])
        pats = []
        for p in raw:
            text = p["pattern"]
            if text[:2] in ("r'", 'r"') and text[-1:] == text[1]:
                text = text[2:-1]
            pats.append(Pattern(text, p.get("priority", 5), tuple(p.get("context_keywords", ()))))
        if pats:
            out.append(Field(name, tuple(pats), spec.get("validate", "text"), name in checked))
    return tuple(out)


# --- values ----------------------------------------------------------------------------------------


def sound_inn(value: str) -> bool:
    """Check digits of a tax number of 10 or 12 digits; other signs are left out."""
    d = [int(c) for c in value if c in "0123456789"]

    def digit(weights):
        return sum(w * x for w, x in zip(weights, d)) % 11 % 10

    if len(d) == 10:
        return digit(W10) == d[9]
    return len(d) == 12 and digit(W11) == d[10] and digit(W12) == d[11]


_DATES = ((r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}", "%d.%m.%Y"), (r"[0-9]{2} [0-9]{2} [0-9]{4}", "%d %m %Y"), (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "%Y-%m-%d"), (r"[0-9]{2}-[0-9]{2}-[0-9]{4}", "%d-%m-%Y"))
_DATES = tuple((re.compile(p), f) for p, f in _DATES)
_SPELT = re.compile(r"([0-9]{1,2})\s+(" + "|".join(MONTHS) + r")\s+([0-9]{4})", re.I)
_DIGITS = {"digits_10_12": re.compile("[0-9]{10,12}"), "digits_9": re.compile("[0-9]{9}"), "digits_20": re.compile("[0-9]{20}")}


def _date(raw: str) -> str | None:
    for pattern, form in _DATES:
        if m := pattern.search(raw):
            try:
                return datetime.strptime(m.group(), form).strftime("%Y-%m-%d")
            except ValueError:
                continue
    if m := _SPELT.fullmatch(raw.strip()):
        try:
            return datetime(int(m.group(3)), MONTHS.index(m.group(2).lower()) + 1, int(m.group(1))).strftime("%Y-%m-%d")
        except ValueError:
            return None
    return None


def parse_value(kind: str, raw: str) -> tuple[str | None, float | None]:
    """(value, number): the value of a raw match by the kind of its field, None if it has none. A number is spelt
    with two decimals. Figures lose their blanks first, other kinds have one kind of blank."""
    raw = re.sub(r"\s", "", raw) if kind != "text" and kind != "date" else re.sub(r"[\xa0\t\n]", " ", raw)
    if kind in _DIGITS:
        return (raw, None) if _DIGITS[kind].fullmatch(raw) else (None, None)
    if kind == "digits":
        return re.sub("[^0-9]", "", raw) or None, None
    if kind == "float":
        text = re.sub(r"[^0-9.\-]", "", raw.replace(",", "."))
        if not re.fullmatch(r"-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", text):
            return None, None
        return f"{float(text):.2f}", float(text)
    if kind == "date":
        return _date(raw), None
    return " ".join(raw.split()) or None, None


# --- candidates ------------------------------------------------------------------------------------

#: (field, value, number, confidence, source) of one value that was found.
Found = tuple[str, str, float | None, float, str]


def _base(kind: str, whole: str) -> float:
    if kind in ("digits_10_12", "float"):
        return min(1.0, len(whole) / 20)
    return 0.5 if kind == "digits_9" else 0.9 if kind == "date" else 0.7


def single_field(f: Field, norm: str, text: str, compiled: dict[str, re.Pattern], context: dict[str, re.Pattern]) -> Found | None:
    """The best match of a field: of the highest confidence, the first of equally good ones in the order of priority."""
    out: Found | None = None
    for p in sorted(f.patterns, key=lambda p: -p.priority):
        for m in compiled[p.pattern].finditer(norm):
            raw = m.group(1) if m.groups() else m.group()
            if raw is None:
                continue
            if p.context_keywords or f.name in context:
                around = norm[max(0, m.start() - NEAR) : m.end() + NEAR]
                low = around.lower()
                if p.context_keywords and not any(k.lower() in low for k in p.context_keywords):
                    continue
            value, number = parse_value(f.validate, raw)
            if value is None or f.checked_inn and not sound_inn(value):
                continue
            score = 0.1 * (m.start() / len(norm) < 0.3) + (0.15 if f.name in context and context[f.name].search(around) else 0) + 0.1 * (text.count(raw) == 1)
            conf = min(1.0, min(1.0, max(0.0, _base(f.validate, m.group()) + score)) + p.priority / 100)
            conf = round(min(1.0, conf + 0.1 * f.checked_inn), 6)
            if out is None or conf > out[3]:
                out = (f.name, value, number, conf, m.group())
    return out


def resolve(found: list[Found]) -> Found:
    """Of several sources' values: the surest, but of those within a tenth of it the one of the longest source."""
    top = max(x[3] for x in found)
    return max((x for x in sorted(found, key=lambda x: -x[3]) if x[3] >= 0.9 * top), key=lambda x: len(x[4]))


def document_fields(norm: str | None, text: str | None, fields: tuple[Field, ...], compiled: dict, context: dict, recognise: Callable[[str], list[Found]] | None = None) -> list[Found]:
    """The value of each field. recognise: an optional recogniser of names, whose values count if surer than a half."""
    if not norm:
        return []
    seen = [x for x in (recognise(norm) if recognise else ()) if x[3] > 0.5]
    out = []
    for f in fields:
        own = [x for x in seen if x[0] == f.name]
        if (best := single_field(f, norm, text or "", compiled, context)) is not None:
            own.append(best)
        if own:
            out.append(resolve(own))
    return out


def compile_fields(fields: tuple[Field, ...]) -> tuple[dict[str, re.Pattern], dict[str, re.Pattern]]:
    return {p.pattern: re.compile(p.pattern, re.I | re.M) for f in fields for p in f.patterns}, {k: re.compile(v, re.I) for k, v in CONTEXT.items()}


FOUND = "field_name string, value string, value_num double, confidence double, source string"
_FOUND = pa.struct([("field_name", pa.string()), ("value", pa.string()), ("value_num", pa.float64()), ("confidence", pa.float64()), ("source", pa.string())])


def extract_each(docs: DataFrame, key: str, text: str, fields: tuple[Field, ...] = FIELDS, recognise: Callable[[str], list[Found]] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, found) and the columns to keep: the fields of each document as a list. Narrow; the patterns are compiled
    once a task."""
    prepare(docs.sparkSession)
    kinds = dict(docs.dtypes)
    names = ("field_name", "value", "value_num", "confidence", "source")

    def run(batches):
        compiled, context = compile_fields(fields)
        for b in batches:
            rows = [[dict(zip(names, x)) for x in document_fields(n, t, fields, compiled, context, recognise)] for n, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[3:], pa.array(rows, pa.list_(_FOUND))], [key, *keep, "found"])

    source = docs.select(key, normalize_for_ocr(F.col(text)).alias("__norm"), F.col(text).alias("__text"), *keep)
    return source.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in (key, *keep)), f"found array<struct<{FOUND}>>"]))


def extract(docs: DataFrame, key: str, text: str, fields: tuple[Field, ...] = FIELDS, recognise: Callable[[str], list[Found]] | None = None) -> DataFrame:
    """Tall rows (key, field_name, value, value_num, confidence)."""
    each = extract_each(docs, key, text, fields, recognise)
    return each.select(key, F.explode("found").alias("b")).select(key, "b.field_name", "b.value", "b.value_num", "b.confidence")


# --- after extraction ------------------------------------------------------------------------------


def coverage(fields: DataFrame, documents: int | Column | DataFrame, key: str) -> DataFrame:
    """(field_name, docs, coverage, accuracy): share of documents with a value, and mean confidence; fields whose
    name begins with _ don't count. documents: their number, or a table of them, which is counted in the same plan."""
    per = fields.where(F.col("value").isNotNull() & ~F.col("field_name").startswith("_")).groupBy("field_name").agg(F.count_distinct(key).alias("docs"), F.round(F.avg("confidence"), 6).alias("accuracy"))
    if isinstance(documents, DataFrame):
        per = per.crossJoin(F.broadcast(documents.agg(F.count("*").alias("__n"))))  # one row
        documents = F.col("__n")
    n = F.lit(documents) if isinstance(documents, int) else documents
    return per.select("field_name", "docs", F.round(F.col("docs") / n, 6).alias("coverage"), "accuracy")


def summary(classified: DataFrame, fields: DataFrame, key: str) -> DataFrame:
    """One row: documents, uncertain share, mean coverage and accuracy, corrections, overall score and
    recommendations. An empty batch has noughts and no recommendations."""
    n = classified.agg(F.count("*").alias("documents"), F.count_if(F.col("confidence") <= 0.5).alias("uncertain"))
    corrected = F.count_if(F.coalesce(F.col("auto_corrected"), F.lit(0.0)) != 0) if "auto_corrected" in fields.columns else F.lit(0).cast("bigint")
    per = fields.where("value is not null").groupBy("field_name").agg(F.count_distinct(key).alias("docs"), F.avg("confidence").alias("acc"), corrected.alias("fixed"))
    cov = per.agg(F.avg("acc").alias("mean_accuracy"), F.min("docs").alias("least_docs"), F.count("*").alias("fields"), F.coalesce(F.sum("fixed"), F.lit(0)).alias("auto_corrections"))
    out = n.crossJoin(F.broadcast(cov))  # one row each
    share = F.coalesce(F.try_divide("uncertain", "documents"), F.lit(0.0))
    rec = F.array(F.when(share > 0.1, "label more documents"), F.when(F.col("least_docs") < 0.5 * F.col("documents"), "add patterns for rare fields"))
    score = F.when(F.col("documents") == 0, 0.0).when(F.col("fields") > 0, 0.8 * F.col("mean_accuracy") + 0.2 * (1 - share)).otherwise(0.5)
    return out.select(
        "documents", "uncertain", "fields", "auto_corrections", F.round(F.coalesce("mean_accuracy", F.lit(0.0)), 6).alias("mean_accuracy"), F.round(score, 6).alias("score"), F.array_compact(rec).alias("recommendations"),
    )


def in_reading_order(mapping: dict[str, str]) -> list[str]:
    """Cells of an export mapping in the order of their references read as (figures, letters)."""
    return sorted(mapping, key=lambda ref: (ref[1:], ref[0]))


def project_mapping(docs: DataFrame, mapping: dict[str, str], key: str, fields: str = "fields", table_fields: str | None = None, columns: str | None = None, filename: str | None = None) -> DataFrame:
    """One row a document with a column for each cell of an export mapping (cell -> field). fields and table_fields:
    maps of values; a field that is there but null is null and isn't looked for further. A name table_<column> is
    looked up in columns, a map of the first values of table columns; _filename in the file name."""
    out = []
    for cell in in_reading_order(mapping):
        name = mapping[cell]
        value = F.lit(None).cast("string")
        if name == "_filename" and filename:
            value = F.coalesce(F.col(filename), F.lit(""))
        if name.startswith("table_") and columns:
            value = F.try_element_at(F.col(columns), F.lit(name.removeprefix("table_")))
        if table_fields:
            value = F.when(F.map_contains_key(table_fields, name), F.try_element_at(F.col(table_fields), F.lit(name))).otherwise(value)
        value = F.when(F.map_contains_key(fields, name), F.try_element_at(F.col(fields), F.lit(name))).otherwise(value)
        out.append(value.alias(cell))
    return docs.select(key, *out)


def first_values(tall: DataFrame, key: str, rows: int = 5) -> DataFrame:
    """(key, columns): for each document a map of the first value that isn't empty among the first rows of each column."""
    some = tall.where((F.col("row_no") < rows) & F.col("value").isNotNull() & ~F.col("value").isin("", "NaN", "nan"))
    per = some.groupBy(key, "header").agg(F.min_by("value", F.struct("row_no", "col_no")).alias("v"))
    return per.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("header", "v")))).alias("columns"))


def register_regex_matches(spark, name: str = "regex_matches") -> None:
    """A table function for SQL: regex_matches(text, pattern) gives pos (from 1), whole and group1 of each match."""

    class Matches:
        def eval(self, text: str, pattern: str):
            if text is not None and pattern is not None:
                for m in re.finditer(pattern, text):
                    yield m.start() + 1, m.group(), m.group(1) if m.groups() else None

    spark.udtf.register(name, F.udtf(Matches, returnType="pos int, whole string, group1 string"))
