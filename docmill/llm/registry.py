"""Queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docmill.llm import batch_dedup, langid, lookalikes, mixing, names, near_dup, personal, scan_noise, tokenize
from docmill.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.find(table(spark, d, "ocr_cache"), table(spark, d, "scan_pages"))


def p1_running_text(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.running_text(table(spark, d, "ocr_cache"), table(spark, d, "scan_pages"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.find(table(spark, d, "ocr_cache")).select("page_hash", "kind", "start_pos")


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redact(table(spark, d, "ocr_cache"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_contractor(table(spark, d, "history"))


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    return names.members(table(spark, d, "history"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pages = lookalikes.odd_texts(table(spark, d, "ocr_cache"), "page_hash", "text", "ocr_cache.text")
    names = lookalikes.odd_texts(table(spark, d, "history"), "id", "contractor_name", "history.contractor_name")
    return pages.unionByName(names).distinct()


def p4_normalized_names(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.one_form(table(spark, d, "history").select("id", "contractor_name"), ["contractor_name"])


def p4_normalized_texts(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.one_form(table(spark, d, "ocr_cache").select("page_hash", "text"), ["text"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.alike_pages(table(spark, d, "ocr_cache")).unionByName(near_dup.alike_numbers(table(spark, d, "history")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return batch_dedup.already_there(spark, table(spark, d, "history"), table(spark, d, "inbox"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return langid.unnamed(docs, langid.fit(docs))


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return langid.documents(docs, langid.fit(docs))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return langid.segments(docs, langid.fit(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_running_text, p2_found, p2_redacted, p3_found, p3_members, p4_found, p4_normalized_names, p4_normalized_texts, p5_found, p6_found, p7_ids, p8_mix, p8_shares, p9_found, p9_documents, p9_segments)
}

#: The pages by brute force over all pairs that share three words, the numbers over all pairs of equal papers; letters
#: beyond ASCII are put in place of signs first, as the edit distance of SQL counts bytes.
_LETTERS = "".join(map(chr, [*range(0x410, 0x450), 0x401, 0x451])) + "№–—"
_SIGNS = "".join(map(chr, [*range(1, 32), *range(0x61, 0x7B)])) + "~!@#$%^&{}[]"
_BYTES = f"translate(document_number, '{_LETTERS}', '{_SIGNS[: len(_LETTERS)]}')"
SQL: dict[str, str] = {
    "p5_found": rf"""WITH w AS (SELECT page_hash, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM (SELECT DISTINCT page_hash, text FROM ocr_cache WHERE page_hash IS NOT NULL)),
    s AS (SELECT DISTINCT page_hash, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT *, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 30)), n AS (SELECT page_hash, count(*) AS n FROM s GROUP BY 1),
    j AS (SELECT a.page_hash AS x, b.page_hash AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.page_hash < b.page_hash GROUP BY 1, 2),
    h AS (SELECT id::varchar AS id, {_BYTES} AS d, contractor_inn, document_date, total_amount FROM history WHERE document_number IS NOT NULL)
    SELECT 'ocr_cache.text' AS field, x AS key_a, y AS key_b FROM j JOIN n p ON p.page_hash = x JOIN n q ON q.page_hash = y WHERE 2 * c >= p.n + q.n - c
    UNION ALL SELECT 'history.document_number', a.id, b.id FROM h a JOIN h b USING (contractor_inn, document_date, total_amount) WHERE a.id < b.id AND 4 * levenshtein(a.d, b.d) <= greatest(length(a.d), length(b.d))""",
}
