"""The processing history: upsert, filters, pages, statistics, duplicates and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.runtime import cut

#: Names that aren't a contractor's, and words of payment that make a short one doubtful.
NOT_A_NAME = [
    "", "наличныйрасчет", "наличный расчет", "наличный", "расчет", "безналичный", "безналичный расчет", "безналичныйрасчет", "оплата", "способ оплаты",
    "способоплаты", "н/д", "н/а", "не указано", "не указан", "не указана", "-", "—", "–", "нет", "отсутствует",
]
PAYMENT = "наличн|безналичн|карт|перевод|электронн"
#: The fields that name a contractor, in this order; of a medical report the laboratory comes first.
PARTIES = ("supplier", "buyer", "seller", "payer", "recipient", "executor", "customer", "counterparty", "party1", "party2")


def acceptable_name(name: Column) -> Column:
    low = F.lower(F.trim(name))
    doubtful = low.rlike(PAYMENT) & (F.length(low) < 20)
    return F.coalesce(~low.isin(NOT_A_NAME) & (F.length(low) >= 3) & ~doubtful, F.lit(False))


def contractor(fields: Column, kind: Column) -> tuple[Column, Column]:
    """(name, tax number) of a map of field values: the first acceptable name of the parties, and the first number of 10
    or 12 digits, blanks and hyphens aside."""
    at = lambda name: F.trim(F.try_element_at(fields, F.lit(name)))
    named = lambda name: F.when(acceptable_name(at(name)), at(name))
    plain = lambda name: F.regexp_replace(at(f"{name}_inn"), "[ -]", "")
    inn = lambda name: F.when(plain(name).rlike("^([0-9]{10}|[0-9]{12})$"), plain(name))
    return F.coalesce(F.when(kind == "medical_report", named("laboratory_name")), *[named(p) for p in PARTIES]), F.coalesce(*[inn(p) for p in PARTIES])


def field_amount(value: Column) -> Column:
    """A number of a field's value, decimal comma and blanks allowed; empty values and noughts of figures alone give none."""
    return F.when(value != "", F.replace(F.replace(value, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double"))


def amount(total: Column, with_vat: Column, without: Column) -> Column:
    """The total, else the amount with tax unless it is nought, else the one without."""
    return F.coalesce(total, F.when(with_vat != 0, with_vat), without)


def status(error: Column, fields: Column) -> Column:
    return F.when(error.isNotNull() & (error != ""), "error").when(fields == 0, "partial").otherwise("success")


def upsert(old: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """The latest row of each (original_filename, file_hash). Nulls make a key of their own; equal times are
    settled by id. One aggregation with partial maxima, so a hot key sends one row a task."""
    both = old if new is None else old.unionByName(new)
    cols = both.columns
    latest = both.groupBy("original_filename", "file_hash").agg(F.max_by(F.struct(*cols), F.struct("processed_at", "id")).alias("r"))
    return latest.select("r.*")


def with_new_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new upserted; a row that takes the place of an older one has an id of its own, as all new rows: they are
    numbered from the largest id there is on, in the order of time and file."""
    from pyspark.sql.window import Window as W

    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))  # one row
    # numbered in ranges: a row's place in its range and the rows of the ranges before it
    cols = [c for c in new.columns if c != "id"]
    ranged = new.drop("id").repartitionByRange("processed_at", "original_filename", "file_hash").withColumn("__p", F.spark_partition_id())
    ranged = cut(ranged)
    before = ranged.groupBy("__p").agg(F.count("*").alias("__n")).withColumn("__before", F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)))  # a row a range
    placed = ranged.withColumn("__r", F.row_number().over(W.partitionBy("__p").orderBy("processed_at", "original_filename", "file_hash", *[c for c in cols if c not in ("processed_at", "original_filename", "file_hash")])))
    numbered = placed.join(F.broadcast(before), "__p").crossJoin(F.broadcast(top)).withColumn("id", (F.col("__top") + F.coalesce("__before", F.lit(0)) + F.col("__r")).cast("bigint"))
    return upsert(old, numbered.select(*new.columns))


def search(
    history: DataFrame, text: str | None = None, kind: str | None = None, state: str | None = None, inn: str | None = None, date_from: str | None = None, date_to: str | None = None,
    processed_from: str | None = None, processed_to: str | None = None,
) -> DataFrame:
    """Conjunction of the filters given; each one that can reaches the scan."""
    out = history
    for name, want in (("document_type", kind), ("status", state), ("contractor_inn", inn)):
        if want is not None:
            out = out.where(F.col(name) == want)
    for name, low, high in (("document_date", date_from, date_to), ("processed_at", processed_from, processed_to)):
        typed = lambda v, n=name: F.lit(v).cast("timestamp") if n == "processed_at" else F.lit(v)
        if low is not None:
            out = out.where(F.col(name) >= typed(low))
        if high is not None:
            out = out.where(F.col(name) <= typed(high))
    if text is not None:
        like = f"%{text}%"
        out = out.where(F.col("original_filename").ilike(like) | F.col("contractor_name").ilike(like) | F.col("document_number").ilike(like) | F.col("contractor_inn").ilike(like))
    return out


def page(history: DataFrame, number: int, size: int) -> DataFrame:
    """A page, newest first; ties by id. Planned as a top-k of the rows up to the page's end."""
    return history.orderBy(F.desc_nulls_last("processed_at"), "id").offset((number - 1) * size).limit(size)


def page_count(history: DataFrame, size: int) -> DataFrame:
    """One row: the rows there are and the pages they make."""
    return history.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size))


def get(history: DataFrame, id: int) -> DataFrame:
    return history.where(F.col("id") == id)


def delete(history: DataFrame, ids: list[int]) -> DataFrame:
    """The history without these rows; the ids reach the scan."""
    return history.where(~F.col("id").isin(ids))


def to_reprocess(history: DataFrame, ids: list[int]) -> DataFrame:
    """(id, original_path, original_filename) of the documents that are to be read again; their rows are replaced by the
    upsert of what comes of it."""
    return history.where(F.col("id").isin(ids) & F.col("original_path").isNotNull()).select("id", "original_path", "original_filename")


#: The columns of an export of the history, and the most rows that it has.
EXPORT = {
    "original_filename": "Исходное имя файла", "document_type": "Тип документа", "status": "Статус обработки", "contractor_name": "Контрагент", "contractor_inn": "ИНН контрагента",
    "document_date": "Дата документа", "document_number": "Номер документа", "total_amount": "Сумма", "amount_with_vat": "Сумма с НДС", "amount_without_vat": "Сумма без НДС",
    "processed_at": "Дата обработки", "confidence": "Уверенность", "error_message": "Ошибка",
}
EXPORT_ROWS = 10_000


def export(history: DataFrame, names: dict[str, str] | None = None, most: int = EXPORT_ROWS) -> DataFrame:
    """The first page of most rows under the names of the export, missing texts empty."""
    kinds = dict(history.dtypes)
    return page(history, 1, most).select(*[(F.coalesce(c, F.lit("")) if kinds[c] == "string" else F.col(c)).alias(n) for c, n in (names or EXPORT).items()])


def statistics(history: DataFrame, today: str) -> DataFrame:
    """One row: total, today's, errors, their share in per cent, and the contractor met most."""
    one = history.agg(
        F.count("*").alias("total"), F.count_if(F.to_date("processed_at") == F.lit(today).cast("date")).alias("today"), F.count_if(F.col("status") == "error").alias("errors")
    ).withColumn("error_percent", F.when(F.col("total") > 0, F.round(F.col("errors") * 100.0 / F.col("total"), 1)).otherwise(0.0))
    names = history.where("contractor_name is not null").groupBy("contractor_name").agg(F.count("*").alias("n"))
    top = names.agg(F.min_by("contractor_name", F.struct((-F.col("n")).alias("m"), "contractor_name")).alias("top_contractor"), F.max("n").alias("top_count"))
    return one.crossJoin(F.broadcast(top))  # one row each


def by_type(history: DataFrame) -> DataFrame:
    return history.where("document_type is not null").groupBy("document_type").agg(F.count("*").alias("docs"))


def contractors(history: DataFrame) -> DataFrame:
    return history.where("contractor_name is not null").select("contractor_name", "contractor_inn").distinct()


def duplicate_key(number: Column, date: Column, inn: Column, file_hash: Column) -> Column:
    """Number, date and tax number where all are given; else the content hash; else none."""
    given = lambda c: c.isNotNull() & (c != "")
    return F.when(given(number) & given(date) & given(inn), F.concat_ws("|", F.lit("n"), number, date, inn)).when(given(file_hash), F.concat(F.lit("h|"), file_hash))


def duplicates(history: DataFrame) -> DataFrame:
    """(id, class_id, copies) of each row with at least one duplicate: its class's smallest id, and its
    links. Keys are counted first, so a hot key never makes pairs."""
    keyed = history.select("id", duplicate_key(F.col("document_number"), F.col("document_date"), F.col("contractor_inn"), F.col("file_hash")).alias("k")).where("k is not null")
    classes = keyed.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("class_id")).where("n > 1")
    return keyed.join(classes, "k").select("id", "class_id", (F.col("n") - 1).alias("copies"))


def retained(history: DataFrame, now: str, days: int, time: str = "processed_at") -> DataFrame:
    """Rows not older than so many days before now; rows without a time stay."""
    return history.where(F.col(time).isNull() | (F.col(time) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")))


def output_files(history: DataFrame) -> DataFrame:
    """(id, files): the number of files of the JSON column; broken JSON holds none."""
    return history.select("id", F.coalesce(F.size(F.map_keys(F.from_json("output_files", "map<string,string>"))), F.lit(0)).alias("files"))


def groups(history: DataFrame, examples: int = 3) -> DataFrame:
    """A row for each type: documents, mean confidence, filled fields, and the first few names."""
    seen = history.where("document_type is not null")
    base = seen.groupBy("document_type").agg(
        F.count("*").alias("docs"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.count("contractor_name").alias("with_name"), F.count("document_number").alias("with_number"), F.count("total_amount").alias("with_amount")
    )
    # the few smallest names of a type: ranks over distinct names with few rows a task kept
    names = seen.where("original_filename is not null").select("document_type", "original_filename").distinct()
    w = Window.partitionBy("document_type").orderBy("original_filename")
    few = names.withColumn("r", F.row_number().over(w)).where(F.col("r") <= examples).groupBy("document_type").agg(F.array_join(F.array_sort(F.collect_list("original_filename")), "; ").alias("examples"))
    return base.join(few, "document_type", "left")


def type_of(classified: Column, own: Column, nested: Column) -> Column:
    """A document's type: of its classification, else its own, else that of a classification kept inside it."""
    return F.coalesce(classified, own, nested, F.lit("unknown"))


def field_groups(fields: DataFrame, key: str, kind: str, examples: int = 3, preferred: dict[str, list[str]] | None = None) -> DataFrame:
    """(kind, field_name, filled, total, examples, rank) of tall fields: for each type and field the documents that have
    a value and all that have the field, the first few different values, and its rank: the preferred fields in their
    order, then the others as they are first met (by key). Names that begin with _ don't count."""
    some = fields.where(~F.col("field_name").startswith("_"))
    base = some.groupBy(kind, "field_name").agg(F.count("value").alias("filled"), F.count("*").alias("total"), F.min(key).alias("first_seen"))
    values = some.where("value is not null").groupBy(kind, "field_name", "value").agg(F.min(key).alias("__k"))
    w = Window.partitionBy(kind, "field_name").orderBy("__k", "value")
    few = values.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= examples).groupBy(kind, "field_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", "value"))), lambda x: x["value"]), "; ").alias("examples"))
    places = [F.when((F.col(kind) == k) & (F.col("field_name") == n), i) for k, names in (preferred or {}).items() for i, n in enumerate(names)]
    place = F.coalesce(*places, F.lit(1_000_000)) if places else F.lit(1_000_000)
    ranked = base.withColumn("rank", F.row_number().over(Window.partitionBy(kind).orderBy(place, "first_seen", "field_name")))  # as many rows as a type has fields
    return ranked.join(few, [kind, "field_name"], "left").select(kind, "field_name", "filled", "total", "examples", "rank")


def cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new pages in the place of those of the same hash; a cache of older columns gets the missing ones
    as nulls."""
    both = cache.unionByName(new, allowMissingColumns=True)
    return both.groupBy("page_hash").agg(F.max_by(F.struct(*both.columns), F.struct("ts", "text")).alias("r")).select("r.*")


def cache_expired(cache: DataFrame, now: float, days: int = 30) -> DataFrame:
    """The pages that aren't older than so many days; those without a time stay."""
    return cache.where(F.col("ts").isNull() | (F.col("ts") >= now - days * 86_400))


def mapping_saved(mappings: DataFrame, new: DataFrame, key: str = "doc_type") -> DataFrame:
    """The export mappings with the new ones in the place of those of the same type."""
    return mappings.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def feedback_saved(feedback: DataFrame, new: DataFrame) -> DataFrame:
    """The feedback with the new rows; a row without a document or a right type isn't taken."""
    return feedback.unionByName(new.where("document is not null and correct_type is not null"))


def cache_lookup(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """(page_hash, text, hit): the newest cached text of each page asked for."""
    newest = cache.groupBy("page_hash").agg(F.max_by("text", F.struct("ts", "text")).alias("text"))
    return wanted.select("page_hash").distinct().join(newest.withColumn("hit", F.lit(True)), "page_hash", "left").select("page_hash", "text", F.coalesce("hit", F.lit(False)).alias("hit"))


def feedback_labels(feedback: DataFrame) -> DataFrame:
    """(document, correct_type): the newest correction of each document."""
    return feedback.where("document is not null and correct_type is not null").groupBy("document").agg(F.max_by("correct_type", F.struct("ts", "correct_type")).alias("correct_type"))
