"""Tables inside documents: header, typing, and fields read from columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.runtime import once


def has_header(first_row: Column) -> Column:
    """The first row is a header if fewer than half of its cells hold a digit."""
    return F.size(F.filter(first_row, lambda c: c.rlike(r"\d"))) < F.size(first_row) / 2


def cells(tables: DataFrame, key: str, rows: str, table_no: str | None = None) -> DataFrame:
    """Tall cells of array<array<string>> tables: key, table_no, row_no, col_no, header, value. Rows and columns of
    nulls alone go ("" is none); header names that repeat get the column's number, so no table fails on them."""
    full = F.filter(rows, lambda r: F.exists(r, lambda c: c.isNotNull()))
    t = tables.select(key, (F.col(table_no) if table_no else F.lit(0)).cast("int").alias("table_no"), full.alias("rows")).where(F.size("rows") > 0)
    width = F.array_max(F.transform("rows", lambda r: F.size(r)))
    used = F.filter(F.sequence(F.lit(0), width - 1), lambda i: F.exists("rows", lambda r: F.get(r, i).isNotNull()))
    t = once(t, used=used)
    t = once(t, body=F.transform("rows", lambda r: F.transform("used", lambda i: F.get(r, i))))
    t = t.withColumn("head", has_header(F.col("body")[0]))
    raw = F.transform(F.col("body")[0], lambda c, i: F.when(F.col("head") & c.isNotNull(), F.lower(F.trim(c))).otherwise(F.concat(F.lit("col"), i.cast("string"))))
    t = once(t, raw=raw)
    names = F.transform("raw", lambda c, i: F.when(F.array_position("raw", c) < i + 1, F.concat(c, F.lit("_"), i.cast("string"))).otherwise(c))
    t = t.select(key, "table_no", names.alias("names"), F.posexplode(F.when(F.col("head"), F.slice("body", 2, F.size("body"))).otherwise(F.col("body"))).alias("row_no", "row"))
    return t.select(key, "table_no", "row_no", "names", F.posexplode("row").alias("col_no", "value")).select(key, "table_no", "row_no", "col_no", F.get("names", F.col("col_no")).alias("header"), "value")


def _number(value: Column) -> Column:
    return F.regexp_replace(F.translate(value, ",", "."), r"[\s\x{a0}]", "").try_cast("double")


def numeric_columns(tall: DataFrame, key: str) -> DataFrame:
    """(key, table_no, col_no, header, numeric, total, last): all or nothing; whether the last value is the sum of the rest."""
    num = _number(F.col("value"))
    return (
        tall.where("value is not null")
        .groupBy(key, "table_no", "col_no", "header")
        .agg(F.every(num.isNotNull()).alias("numeric"), F.round(F.sum(num), 2).alias("total"), F.max_by(num, "row_no").alias("last"))
        .withColumn("sum_row", F.col("numeric") & (F.abs(F.col("total") - 2 * F.col("last")) <= 0.01))
    )


def operations(tall: DataFrame, key: str) -> DataFrame:
    """(key, table_no, row_no, values): the numbers of each row of tables that have a cell "сальдо" or "дебет" and at
    least two columns of numbers; values holds (header, number) in the order of the columns."""
    w = F.lower("value").isin("сальдо", "дебет")
    columns = numeric_columns(tall, key).where("numeric").select(key, "table_no", "col_no")
    wanted = tall.groupBy(key, "table_no").agg(F.bool_or(F.coalesce(w, F.lit(False))).alias("said")).where("said").select(key, "table_no")
    enough = columns.groupBy(key, "table_no").agg(F.count("*").alias("n")).where("n >= 2").select(key, "table_no")
    some = tall.join(wanted, [key, "table_no"], "left_semi").join(enough, [key, "table_no"], "left_semi").join(columns, [key, "table_no", "col_no"], "left_semi")
    values = F.array_sort(F.collect_list(F.struct("col_no", "header", _number(F.col("value")).alias("number"))))  # the columns of one row
    return some.groupBy(key, "table_no", "row_no").agg(F.transform(values, lambda v: F.struct(v["header"].alias("header"), v["number"].alias("number"))).alias("values"))


def lines_as_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines "no name code quantity unit price" of a text as a table: array<array<string>> rows."""
    pattern = r"^\s*(\d{1,4}) (.+?) (\d{3}) (\d+) (\S+) ([\d ]*\d[.,]\d\d)$"
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(pattern))
    row = lambda x: F.array(*[F.regexp_extract(x, pattern, i) for i in range(1, 7)])
    return docs.select(key, F.transform(lines, row).alias("rows")).where(F.size("rows") > 0)
