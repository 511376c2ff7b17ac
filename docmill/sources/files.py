"""Folders of files as tables, and sinks: JSON, CSV for each group, and workbooks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.runtime import cut, prepare

#: Suffixes that are read, and the largest size of a PDF and of an image.
SUFFIXES = ("pdf", "jpg", "jpeg", "png", "tif", "tiff", "bmp", "webp")
PDF_BYTES, IMAGE_BYTES = 10 * 1024 * 1024, 50 * 1024 * 1024


def folder(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """(path, filename, suffix, rank, length, content, error) of the files of one flat folder; rank puts papers before
    images. Files over the limit carry an error instead of failing the batch."""
    wanted = "{" + ",".join([*(f"*.{s}" for s in SUFFIXES), *(f"*.{s.upper()}" for s in SUFFIXES)]) + "}"
    reader = (spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary") if streaming else spark.read).format("binaryFile").option("pathGlobFilter", wanted)
    files = reader.load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    limit = F.when(suffix == "pdf", PDF_BYTES).otherwise(IMAGE_BYTES)
    return files.select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), suffix.alias("suffix"), F.when(suffix == "pdf", 0).otherwise(1).alias("rank"), "length", "content", F.when(F.col("length") > limit, F.lit("file too large")).alias("error")
    )


def read_texts(files: DataFrame, reader: Callable[[bytes, str], str], fallback: Callable[[bytes, str], str] | None = None, least: int = 300, ocr: Callable[[bytes, str], str] | None = None) -> DataFrame:
    """files with full_text by a pluggable reader; a second reader where it fails, and recognition where the
    text is short. A file that can't be read keeps its row, with an error. One file at a time is held."""
    prepare(files.sparkSession)
    keep = [c for c in files.columns if c not in ("content", "error")]
    kinds = dict(files.dtypes)

    def one(content, suffix, error):
        if error is not None or content is None:
            return None, error or "no content"
        text, why = None, None
        for r in (reader, fallback):
            if r is None:
                continue
            try:
                text = r(content, suffix)
                break
            except Exception as e:  # noqa: BLE001  any reader's failure is the row's error
                why = f"{type(e).__name__}: {e}"
        if ocr is not None and (text is None or len(text.strip()) < least):
            try:
                text = ocr(content, suffix)
            except Exception as e:  # noqa: BLE001
                why = why or f"{type(e).__name__}: {e}"
        return text, None if text is not None else why

    def run(batches):
        for b in batches:
            got = [one(c.as_py(), s, e) for c, s, e in zip(b.column("content"), b.column("suffix").to_pylist(), b.column("error").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], [*keep, "full_text", "error"])

    return files.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "full_text string, error string"]))


#: A page as structured readers give it: text, words with their boxes, and tables of cells.
PAGE = "struct<page_no: int, text: string, words: array<struct<text: string, x0: double, y0: double, x1: double, y1: double>>, tables: array<array<array<string>>>>"


def read_pages(files: DataFrame, reader: Callable[[bytes, str], list[dict]]) -> DataFrame:
    """files with pages (as PAGE), full_text (a line end after each page's text) and error, by a pluggable reader that
    gives a list of pages. Tables and words come along for what works on them."""
    def one(content, suffix, error):
        if error is not None or content is None:
            return {"pages": None, "error": error or "no content"}
        try:
            pages = [{"page_no": i, "text": p.get("text"), "words": p.get("words", []), "tables": p.get("tables", [])} for i, p in enumerate(reader(bytes(content), suffix), 1)]
        except Exception as e:  # noqa: BLE001
            return {"pages": None, "error": f"{type(e).__name__}: {e}"}
        return {"pages": pages, "error": None}

    prepare(files.sparkSession)
    f = F.udf(one, f"struct<pages: array<{PAGE}>, error: string>", useArrow=True)
    d = files.withColumn("__r", f("content", "suffix", "error"))
    text = F.array_join(F.transform("__r.pages", lambda p: F.concat(F.coalesce(p["text"], F.lit("")), F.lit("\n"))), "")
    return d.select(*[c for c in files.columns if c not in ("content", "error")], "__r.pages", text.alias("full_text"), "__r.error")


def measure_images(files: DataFrame, decode: Callable[[bytes], object], text: str | None = None) -> DataFrame:
    """files with the measures of each image, by a pluggable decoder to a matrix: source, height, width, channels, blur,
    contrast, noise, brightness, skew, level_score and is_photo; text names a column of text found without recognition.
    An image that can't be decoded keeps its row, with an error."""
    from docmill.functions import images

    prepare(files.sparkSession)
    kind = "height int, width int, channels int, blur double, contrast double, noise double, brightness double, skew double, level_score double, is_photo boolean, error string"

    def one(content, known, error):
        if error is not None or content is None:
            return {"error": error or "no content"}
        try:
            m = decode(bytes(content))
            grey = images.rgb_to_grey(m)
            return {
                "height": grey.shape[0], "width": grey.shape[1], "channels": 1 if m.ndim == 2 else m.shape[2], "blur": images.blur(grey), "contrast": images.contrast(grey), "noise": images.noise(grey), "brightness": float(grey.mean()),
                "skew": images.skew(grey), "level_score": images.level_score(m, known or ""), "is_photo": bool(images.is_photo(m, len(known or ""))), "error": None,
            }
        except Exception as e:  # noqa: BLE001
            return {"error": f"{type(e).__name__}: {e}"}

    f = F.udf(one, f"struct<{', '.join(x.replace(' ', ': ') for x in kind.split(', '))}>", useArrow=True)
    d = files.withColumn("__r", f("content", F.col(text) if text else F.lit(None).cast("string"), "error"))
    return d.select(*[c for c in files.columns if c not in ("content", "error")], F.lit("image").alias("source"), "__r.*")


def recognise_cached(pages: DataFrame, cache: DataFrame, ocr: Callable[[bytes], list[tuple[str, float]]], now: float, lang: str = "ru") -> tuple[DataFrame, DataFrame]:
    """((page_hash, text, hit), new cache rows) of pages (page_hash, content): cached texts as they are, the others by a
    pluggable recogniser that gives (line, confidence); strong lines are kept. The new rows are for cache_put()."""
    from docmill.operators.history import cache_lookup
    from docmill.operators.quality import kept_ocr_lines

    prepare(pages.sparkSession)
    known = cache_lookup(pages, cache)
    missing = pages.dropDuplicates(["page_hash"]).join(known.where("hit").select("page_hash"), "page_hash", "left_anti")
    read = F.udf(lambda c: [{"text": t, "confidence": float(p)} for t, p in ocr(bytes(c))] if c is not None else [], "array<struct<text: string, confidence: double>>", useArrow=True)
    text = F.array_join(F.transform(kept_ocr_lines(F.col("lines")), lambda s: s["text"]), "\n")
    new = cut(missing.select("page_hash", read("content").alias("lines")).select("page_hash", text.alias("text"), F.lit(lang).alias("lang"), F.lit(float(now)).alias("ts")))
    return known.where("hit").unionByName(new.select("page_hash", "text", F.lit(False).alias("hit"))), new


def page_tables(read: DataFrame, key: str) -> DataFrame:
    """(key, table_no, rows) of all tables of all pages, numbered on, empty ones left out."""
    every = F.filter(F.flatten(F.transform("pages", lambda p: p["tables"])), lambda t: F.size(t) > 0)
    return read.select(key, F.posexplode(every).alias("table_no", "rows"))


def counts(spark: SparkSession, *folders: str, pattern: str = "*.pdf") -> DataFrame:
    """(folder, files) without reading any file: the files of each folder that fit the pattern."""
    out = []
    for f in folders:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{f}/{pattern}")
        found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
        out.append((f, len(found) if found is not None else 0))
    return spark.createDataFrame(out, "folder string, files bigint")


def results(spark: SparkSession, folder: str, names: tuple[str, ...] = ("processing_results.json", "results.json")) -> DataFrame | None:
    """The first of these result files that there is."""
    for n in names:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}")
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return spark.read.option("multiLine", True).json(f"{folder}/{n}")
    return None


def to_copy(parsed: DataFrame, fields: str = "fields", error: str = "error") -> DataFrame:
    """The documents that are copied to the processed ones: those with fields and without an error."""
    return parsed.where(F.col(error).isNull() & (F.size(fields) > 0))


def copy_files(files: DataFrame, target: str) -> DataFrame:
    """(path, copied) where the executors wrote each file's content to a folder they share; a file is put in place whole."""
    prepare(files.sparkSession)

    def run(batches):
        import os
        from pathlib import Path

        for b in batches:
            done = []
            for path, name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                part = Path(target) / f".{name}.{os.getpid()}"
                part.write_bytes(content.as_py())
                part.replace(Path(target) / name)
                done.append(str(Path(target) / name))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.string())], ["path", "copied"])

    return files.where("content is not null").select("path", "filename", "content").mapInArrow(run, "path string, copied string")


def first_table_csv(cells: DataFrame, key: str) -> DataFrame:
    """(key, content): the first table of each document as CSV text that begins with a byte order mark."""
    first = cells.where("table_no = 0")
    quoted = lambda c: F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    rows = first.groupBy(key, "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", quoted(F.col("header")).alias("h"), quoted(F.col("value")).alias("v")))).alias("cs"))  # the cells of one row
    lines = rows.select(key, "row_no", F.array_join(F.transform("cs", lambda c: c["h"]), ",").alias("head"), F.array_join(F.transform("cs", lambda c: c["v"]), ",").alias("line"))
    whole = lines.groupBy(key).agg(F.min_by("head", "row_no").alias("head"), F.array_sort(F.collect_list(F.struct("row_no", "line"))).alias("ls"))
    return whole.select(key, F.concat(F.lit("\ufeff"), "head", F.lit("\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("\n")).alias("content"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(by) if by else w).csv(path)


def _column(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def workbook(names: list[str], rows: list[tuple], sheet: str) -> bytes:
    """A workbook of one sheet with a header, filter and column widths, from the standard library."""
    widths = [min(max([len(n), *(len(str(r[i])) for r in rows if r[i] is not None)], default=0) + 2, 50) for i, n in enumerate(names)]

    def cell(v, r, c):
        ref = f"{_column(c)}{r}"
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{ref}"><v>{v}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    body = "".join(f'<row r="{i}">{"".join(cell(v, i, c) for c, v in enumerate(r, 1))}</row>' for i, r in enumerate([tuple(names), *rows], 1))
    cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    filt = f'<autoFilter ref="A1:{_column(len(names))}{len(rows) + 1}"/>' if names else ""
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="{escape(sheet[:31])}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet {ns}><cols>{cols}</cols><sheetData>{body}</sheetData>{filt}</worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{text}')
    return out.getvalue()


def workbooks(df: DataFrame, group: str, rows_each: int = 50_000) -> DataFrame:
    """(group, part, content): workbooks of at most so many rows, made where the rows are. Hot groups are
    dealt to parts by row, so no task holds a whole group."""
    names = [c for c in df.columns if c != group]
    counts = df.groupBy(group).agg(F.ceil(F.count("*") / rows_each).alias("__parts"))
    salted = df.join(counts, group).withColumn("part", F.pmod(F.xxhash64(*names), F.col("__parts")).cast("int"))

    def make(pdf):
        import pandas as pd

        rows = [tuple(None if pd.isna(v) else v for v in r) for r in pdf[names].itertuples(index=False)]
        return pd.DataFrame({group: [pdf[group].iloc[0]], "part": [pdf["part"].iloc[0]], "n_rows": [len(rows)], "content": [workbook(names, rows, str(pdf[group].iloc[0]))]})

    return salted.groupBy(group, "part").applyInPandas(make, f"{group} string, part int, n_rows bigint, content binary")


def appended(content: bytes, rows: list[tuple], sheet: str | None = None) -> bytes:
    """A workbook of workbook() with rows after its last one; missing values leave their cells out."""
    import re
    from xml.etree import ElementTree as ET

    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("xl/worksheets/sheet1.xml"))
        name = re.search(r'<sheet name="([^"]*)"', z.read("xl/workbook.xml").decode()).group(1)
    table = []
    for row in body.iter(f"{ns}row"):
        cells: dict[int, object] = {}
        for c in row.iter(f"{ns}c"):
            at = 0
            for ch in re.match("[A-Z]+", c.get("r")).group():
                at = at * 26 + ord(ch) - 64
            v, t = c.find(f"{ns}v"), c.find(f"{ns}is/{ns}t")
            cells[at - 1] = float(v.text) if v is not None else t.text
        table.append(cells)
    width = max([max(c, default=-1) + 1 for c in table] + [len(r) for r in rows], default=0)
    whole = [tuple(c.get(i) for i in range(width)) for c in table]
    names = [str(x) if x is not None else "" for x in whole[0]] if whole else []
    return workbook(names, [tuple(None if v is None or v != v else v for v in r) + (None,) * (width - len(r)) for r in [*whole[1:], *rows]], sheet or name)


def mapped_workbooks(rows: DataFrame, group: str, mappings: dict[str, dict[str, str]], error: str | None = None) -> DataFrame:
    """workbooks() by the export mapping of each group (group -> cell -> column): the columns in reading order of the
    cells; documents with an error are left out, and so are groups without a mapping. Names of sheets are cut to 31."""
    from docmill.operators.extract import in_reading_order

    some = rows.where(F.col(error).isNull()) if error else rows
    out = None
    for name, mapping in mappings.items():  # a few mappings
        part = workbooks(some.where(F.col(group) == name).select(group, *[F.col(mapping[c]).cast("string").alias(c) for c in in_reading_order(mapping)]), group)
        out = part if out is None else out.unionByName(part)
    return out
