"""Named queries over the core operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as tx
from docmill.functions import values as vl
from docmill.operators import classify, correct, extract, history, parse, quality, reconcile, tables
from docmill.runtime import prepare, shared_folder, table
from docmill.sources import files
from docmill.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# --- pieces of SQL ----------------------------------------------------------------------------------

_SP = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WD = r"\p{L}\p{N}_"


def _norm(c: str) -> str:
    lower = f"translate(lower({c}), 'ёЁ', 'еЕ')"
    return rf"trim(regexp_replace(regexp_replace({lower}, '[{_SP}]+', ' ', 'g'), '[^{_WD}{_SP}.,\-+()\[\]{{}}/\\=:;]', ' ', 'g'), ' ')"


def _norm_cls(c: str) -> str:
    return rf"regexp_replace({_norm(c)}, '[^{_WD}{_SP}.,\-+]', '', 'g')"


def _collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{_SP}]+', ' ', 'g'), ' ')"


def _any_sql(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def _score_sql(text: str, kw: int, pat: int, exc: int, prefer: classify.Preference | None = None) -> str:
    """struct list of (score, type) in the order of the signatures."""
    out = []
    for kind, s in classify.SIGNATURES.items():
        terms = [f"{kw} * contains({text}, '{t}')::int" for t in dict.fromkeys(s["keywords"])]
        terms += [f"{pat} * regexp_matches({text}, '{t}')::int" for t in dict.fromkeys(s["patterns"])]
        terms += [f"-{exc} * contains({text}, '{t}')::int" for t in dict.fromkeys(s["exclude"])]
        if prefer is not None and kind == prefer.kind:
            terms += [f"{points} * {_any_sql(text, words)}::int" for words, points in prefer.bonuses]
        out.append(f"{{'score': greatest(0, {' + '.join(terms)}), 'type': '{kind}'}}")
    return f"[{', '.join(out)}]"


def _best_sql(source: str, key: str, prefer: classify.Preference | None = None) -> str:
    """(key, doc_type, score) of (key, t, s)."""
    first = "list_filter(s, lambda x: x.score = top)[1].type"
    if prefer is not None:
        own = f"list_filter(s, lambda x: x.type = '{prefer.kind}')[1].score"
        cued = f"({own} + CASE WHEN {own} > 0 AND {_any_sql('t', prefer.cues)} THEN {prefer.cue_points} ELSE 0 END)"
        first = f"CASE WHEN (len(list_filter(s, lambda x: x.score = top)) > 1 AND {own} = top) OR ({cued} >= top AND {cued} > {prefer.least}) THEN '{prefer.kind}' ELSE {first} END"
    kind = f"(SELECT *, CASE WHEN top > 0 THEN {first} ELSE 'unknown' END AS kind FROM (SELECT *, list_max(list_transform(s, lambda x: x.score)) AS top FROM ({source})))"
    return f"SELECT {key}, kind AS doc_type, coalesce(list_filter(s, lambda x: x.type = kind)[1].score, 0) AS score FROM {kind}"


_LADDER = "CASE WHEN score >= 3 THEN 1.0 WHEN score >= 2 THEN 0.95 WHEN score >= 1 THEN 0.8 ELSE 0.0 END::double"
_CLASSIFIED = f"""
  SELECT doc_id, doc_type, score AS rule_score, {_LADDER} AS confidence
  FROM ({_best_sql(f"SELECT doc_id, t, {_score_sql('t', 1, 2, 1, classify.ACTS)} AS s FROM (SELECT doc_id, coalesce({_norm_cls('text')}, '') AS t FROM documents)", 'doc_id', classify.ACTS)})
"""
_NAME_CONF = "CASE WHEN score > 0 THEN least(0.9, 0.5 + score / 10.0) ELSE 0.0 END::double"


def _by_name_sql(source: str, key: str, name: str) -> str:
    return _best_sql(f"SELECT {key}, t, {_score_sql('t', 2, 3, 2)} AS s FROM (SELECT {key}, coalesce(lower(translate({name}, 'ёЁ_', 'еЕ ')), '') AS t FROM {source})", key)


def _inn_sql(c: str) -> str:
    def control(weights, d="d"):
        return "(((" + " + ".join(f"substr({d}, {i + 1}, 1)::int * {w}" for i, w in enumerate(weights)) + ") % 11) % 10)"

    return f"""(SELECT CASE WHEN {c} IS NULL THEN NULL WHEN length(d) = 10 THEN {control(vl.W10)} = substr(d, 10, 1)::int
       WHEN length(d) = 12 THEN {control(vl.W11)} = substr(d, 11, 1)::int AND {control(vl.W12)} = substr(d, 12, 1)::int ELSE false END
       FROM (SELECT regexp_replace({c}, '[^0-9]', '', 'g') AS d))"""


# --- text -------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_norm('text')} AS norm FROM documents")
def text_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.normalize(F.col("text")).alias("norm"))


@query(f"SELECT doc_id, {_norm_cls('text')} AS norm FROM documents")
def text_normalize_for_classification(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.normalize_for_classification(F.col("text")).alias("norm"))


@query("SELECT page_hash, ts, " + _collapse("translate(text, '«»„−–—', '\"\"\"---')") + " AS norm FROM ocr_cache")
def text_normalize_for_ocr(spark, d):
    return table(spark, d, "ocr_cache").select("page_hash", "ts", tx.normalize_for_ocr(F.col("text")).alias("norm"))


@query(f"SELECT page_hash, ts, {_collapse('text')} AS clean FROM ocr_cache")
def text_clean_whitespace(spark, d):
    return table(spark, d, "ocr_cache").select("page_hash", "ts", tx.collapse(F.col("text")).alias("clean"))


@query("SELECT page_hash, ts, replace(replace(translate(text, '“”«»–—', '\"\"\"\"--'), '  ', ' '), chr(9), ' ') AS clean FROM ocr_cache")
def text_clean_ocr(spark, d):
    return table(spark, d, "ocr_cache").select("page_hash", "ts", tx.clean_ocr_text(F.col("text")).alias("clean"))


@query(f"SELECT page_hash, ts, trim(regexp_replace(lower(regexp_replace(text, '[{_SP}]+', ' ', 'g')), '[^{_WD}{_SP}]', '', 'g'), ' ') AS norm FROM ocr_cache")
def text_normalize_for_comparison(spark, d):
    return table(spark, d, "ocr_cache").select("page_hash", "ts", tx.normalize_for_comparison(F.col("text")).alias("norm"))


@query(
    r"""SELECT id, CASE WHEN coalesce(safe, '') = '' THEN 'unnamed_file' WHEN length(safe) > 200 THEN substr(safe, 1, 190) || regexp_extract(safe, '(\.[^.]*)$', 1) ELSE safe END AS safe,
    coalesce(length(f) BETWEEN 1 AND 255 AND NOT regexp_matches(f, '[<>:"/\\|?*\x00-\x1f]') AND upper(regexp_extract(f, '^([^.]*)', 1)) NOT IN ('CON','PRN','AUX','NUL','COM1','COM2','COM3','COM4','COM5','COM6','COM7','COM8','COM9','LPT1','LPT2','LPT3','LPT4','LPT5','LPT6','LPT7','LPT8','LPT9'), false) AS valid
    FROM (SELECT id, original_path || '?' AS p, original_filename AS f, regexp_replace(regexp_replace(regexp_replace(original_path || '?', '^.*[/\\]', ''), '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS safe FROM history)"""
)
def filename_sanitize(spark, d):
    return table(spark, d, "history").select("id", tx.sanitize_filename(F.concat("original_path", F.lit("?"))).alias("safe"), tx.valid_filename(F.col("original_filename")).alias("valid"))


@query("SELECT p.page_hash, p.page_no, md5(p.file_hash) AS md5, sha256(p.file_hash || p.page_no::varchar) AS sha FROM scan_pages p")
def content_hashes(spark, d):
    p = table(spark, d, "scan_pages")
    return p.select("page_hash", "page_no", tx.content_md5(F.col("file_hash")).alias("md5"), tx.page_sha256(F.col("file_hash"), F.col("page_no")).alias("sha"))


@query(
    """WITH w AS (SELECT document, ts, coalesce(original_type, '') AS a, coalesce(correct_type, '') AS b FROM feedback),
    v AS (SELECT *, list_distinct(string_split(a, '')) AS x, list_distinct(string_split(b, '')) AS y FROM w)
    SELECT document, ts, a AS original_type, b AS correct_type, round(CASE WHEN a = b THEN 1.0 WHEN a = '' OR b = '' THEN 0.0 ELSE
      0.7 * len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) + 0.3 * (1 - abs(length(a) - length(b))::double / greatest(length(a), length(b))) END, 9) AS similarity FROM v"""
)
def word_similarity(spark, d):
    f = table(spark, d, "feedback").select("document", "ts", F.coalesce("original_type", F.lit("")).alias("original_type"), F.coalesce("correct_type", F.lit("")).alias("correct_type"))
    return f.withColumn("similarity", F.round(tx.word_similarity(F.col("original_type"), F.col("correct_type")), 9))


@query(r"SELECT page_hash, ts, regexp_replace(text, '[№N]\s*(\d+)', '№ \1', 'g') AS fixed FROM ocr_cache")
def text_fix_number_sign(spark, d):
    return table(spark, d, "ocr_cache").select("page_hash", "ts", tx.fix_number_sign(F.col("text")).alias("fixed"))


_FIX = r"regexp_replace({}, '(^|[^\p{{L}}\p{{N}}_])(\d{{1,2}})[.\s]+(\d{{1,2}})[.\s]+(\d{{4}})($|[^\p{{L}}\p{{N}}_])', '\1\2.\3.\4\5', 'g')"


@query(f"SELECT page_hash, ts, {_FIX.format(_FIX.format('text'))} AS fixed FROM ocr_cache")  # twice, as neighbours share the sign between them
def text_fix_dates(spark, d):
    return table(spark, d, "ocr_cache").select("page_hash", "ts", tx.fix_dates(F.col("text")).alias("fixed"))


@query("SELECT item_id, n_bytes <= 1000000 AS fits, round(n_bytes / 1048576.0::double, 9) AS megabytes FROM inbox")
def file_sizes(spark, d):
    fits, mb = tx.safe_size(F.col("n_bytes"), 1_000_000)
    return table(spark, d, "inbox").select("item_id", fits.alias("fits"), F.round(mb, 9).alias("megabytes"))


@query("SELECT id, coalesce(CASE WHEN json_valid(output_files) AND json_type(output_files) = 'OBJECT' THEN list_contains(json_keys(output_files), 'json') END, false) AS has_json FROM history")
def json_structure(spark, d):
    return table(spark, d, "history").select("id", tx.has_keys(F.col("output_files"), ["json"]).alias("has_json"))


# --- values -----------------------------------------------------------------------------------------


@query(
    f"""SELECT id, CASE WHEN ok THEN 'valid' WHEN NOT ok THEN 'invalid' END AS valid, CASE WHEN ok THEN contractor_inn END AS inn, round(CASE WHEN ok THEN least(1.0, confidence + 0.1) ELSE greatest(0.0, confidence - 0.2) END, 9) AS adjusted
    FROM (SELECT id, contractor_inn, confidence, {_inn_sql('contractor_inn')} AS ok FROM history)"""
)
def inn_checksum(spark, d):
    inn, conf = vl.inn_adjusted(F.col("contractor_inn"), F.col("confidence"))
    ok = vl.inn_valid(F.col("contractor_inn"))
    return table(spark, d, "history").select("id", F.when(ok, "valid").when(~ok, "invalid").alias("valid"), inn.alias("inn"), F.round(conf, 9).alias("adjusted"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CASE WHEN l_linenumber % 3 = 1 THEN l_quantity::bigint * 1000 + 234.5 ELSE -l_quantity::bigint END END::double AS v FROM lineitem"""
)
def value_parse_float(spark, d):
    li = table(spark, d, "lineitem")
    n = F.col("l_quantity").cast("bigint").cast("string")
    raw = F.when(F.col("l_linenumber") % 3 == 1, F.concat(n, F.lit(" 234,50 руб"))).when(F.col("l_linenumber") % 3 == 2, F.concat(F.lit("-"), n)).otherwise(F.concat(n, F.lit(".5.1")))
    return li.select("l_orderkey", "l_linenumber", vl.parse_float(raw).alias("v"))


@query(
    r"""SELECT id, CASE WHEN regexp_full_match(contractor_inn, '[0-9]{10,12}') THEN contractor_inn END AS inn, CASE WHEN regexp_full_match(document_number, '[0-9]{9}') THEN document_number END AS nine, CASE WHEN regexp_full_match(contractor_inn || contractor_inn, '[0-9]{20}') THEN contractor_inn || contractor_inn END AS twenty,
    nullif(regexp_replace(document_number, '[^0-9]', '', 'g'), '') AS digits, nullif(trim(regexp_replace(contractor_name, '[\s\x{a0}]+', ' ', 'g'), ' '), '') AS text FROM history"""
)
def value_parse_digits_and_text(spark, d):
    p, inn = vl.PARSERS, F.col("contractor_inn")
    return table(spark, d, "history").select(
        "id", p["digits_10_12"](inn).alias("inn"), p["digits_9"](F.col("document_number")).alias("nine"), p["digits_20"](F.concat(inn, inn)).alias("twenty"), p["digits"](F.col("document_number")).alias("digits"), p["text"](F.col("contractor_name")).alias("text")
    )


@query(
    r"""SELECT id, document_date AS raw, coalesce(
      strftime(try_strptime(nullif(regexp_extract(document_date, '\d{2}\.\d{2}\.\d{4}'), ''), '%d.%m.%Y'), '%Y-%m-%d'),
      strftime(try_strptime(nullif(regexp_extract(document_date, '\d{2} \d{2} \d{4}'), ''), '%d %m %Y'), '%Y-%m-%d'),
      strftime(try_strptime(nullif(regexp_extract(document_date, '\d{4}-\d{2}-\d{2}'), ''), '%Y-%m-%d'), '%Y-%m-%d'),
      strftime(try_strptime(nullif(regexp_extract(document_date, '\d{2}-\d{2}-\d{4}'), ''), '%d-%m-%Y'), '%Y-%m-%d'),
      CASE WHEN regexp_matches(lower(document_date), '^\d{1,2} [а-я]+ \d{4}$') THEN strftime(try_strptime(regexp_extract(document_date, '\d+') || '.' || list_position(['января','февраля','марта','апреля','мая','июня','июля','августа','сентября','октября','ноября','декабря'], regexp_extract(lower(document_date), '[а-я]+'))::varchar || '.' || regexp_extract(document_date, '\d{4}'), '%d.%m.%Y'), '%Y-%m-%d') END) AS iso FROM history"""
)
def value_parse_date(spark, d):
    return table(spark, d, "history").select("id", F.col("document_date").alias("raw"), vl.parse_date(F.col("document_date")).alias("iso"))


@query(
    """SELECT id, CASE WHEN off THEN 'vat_mismatch' END AS warning, CASE WHEN off THEN round(amount_without_vat + vat, 2) END AS auto_corrected, round(CASE WHEN off THEN greatest(0.5, confidence - 0.2) ELSE confidence END, 9) AS confidence
    FROM (SELECT *, coalesce(amount_with_vat <> 0 AND amount_without_vat <> 0 AND vat <> 0 AND abs(amount_with_vat - (amount_without_vat + vat)) > 0.01, false) AS off FROM (SELECT *, total_amount - amount_without_vat AS vat FROM history))"""
)
def vat_consistency(spark, d):
    h = table(spark, d, "history").withColumn("vat", F.col("total_amount") - F.col("amount_without_vat"))
    s = vl.vat_check(F.col("amount_with_vat"), F.col("amount_without_vat"), F.col("vat"), F.col("confidence"))
    return h.select("id", s.alias("s")).select("id", "s.warning", F.round("s.auto_corrected", 2).alias("auto_corrected"), F.round("s.confidence", 9).alias("confidence"))


@query(
    """SELECT id, (coalesce(CASE WHEN amount_with_vat < 0 OR amount_without_vat < 0 OR total_amount < 0 THEN 0.3 END, 0.0) + coalesce(CASE WHEN amount_with_vat < amount_without_vat THEN 0.2 END, 0.0))::double AS penalty,
      CASE WHEN dd > DATE '2024-06-30' THEN 'future' WHEN dd < DATE '2024-06-30' - 7300 THEN 'too_old' END AS date_warning
    FROM (SELECT *, CASE WHEN regexp_matches(document_date, '^\\d{4}-\\d{2}-\\d{2}$') THEN try_cast(document_date AS DATE) END AS dd FROM history)"""
)
def amount_and_date_sanity(spark, d):
    return table(spark, d, "history").select(
        "id", vl.amount_penalty(F.col("total_amount"), F.col("amount_with_vat"), F.col("amount_without_vat")).alias("penalty"), vl.date_warning(F.col("document_date"), F.lit("2024-06-30").cast("date")).alias("date_warning")
    )


@query(
    """SELECT o_orderkey, CASE WHEN abs(e - o_totalprice) > 0.01 THEN e END AS expected FROM (SELECT o_orderkey, o_totalprice, round_even(s + 50 - 30, 2) AS e
    FROM (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice - 20 ELSE o_totalprice END AS s FROM orders))"""
)
def saldo_check(spark, d):
    o = table(spark, d, "orders")
    start = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") - 20).otherwise(F.col("o_totalprice"))
    return o.select("o_orderkey", vl.saldo_expected(start, F.lit(50), F.lit(30), F.col("o_totalprice")).alias("expected"))


# --- classification ---------------------------------------------------------------------------------


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return classify_stats(spark, d)


@query(f"SELECT doc_id, doc_type, rule_score, round(confidence, 9) AS confidence FROM ({_CLASSIFIED})")
def rule_classify(spark, d):
    return classify.rule_classify(table(spark, d, "documents")).select("doc_id", "doc_type", "rule_score", F.round("confidence", 9).alias("confidence"))


@query(
    f"""SELECT doc_type, count(*) AS docs, count(*) FILTER (confidence > 0.5) AS classified, count(*) FILTER (confidence <= 0.5) AS uncertain, round(avg(confidence), 6) AS avg_confidence FROM ({_CLASSIFIED}) GROUP BY doc_type"""
)
def classify_stats(spark, d):
    return classify.stats(classify.rule_classify(table(spark, d, "documents")))


@query(f"SELECT id, doc_type, score, round({_NAME_CONF}, 9) AS confidence FROM ({_by_name_sql('history', 'id', 'original_filename')})")
def filename_classify(spark, d):
    return classify.filename_classify(table(spark, d, "history"), "original_filename").select("id", "doc_type", "score", F.round("confidence", 9).alias("confidence"))


_FILES = "(SELECT file_hash, min(original_filename) AS filename FROM history WHERE file_hash <> '' GROUP BY file_hash)"


def _classify_sql(mode: str) -> str:
    conf = "r.confidence" if mode == "rules_only" else "0.3::double * r.confidence"
    kind = "r.doc_type"
    return f"""WITH docs AS (SELECT d.doc_id, d.text, f.filename FROM documents d LEFT JOIN {_FILES} f USING (file_hash)),
    r AS ({_CLASSIFIED}), n AS (SELECT doc_id, doc_type, score, {_NAME_CONF} AS confidence FROM ({_by_name_sql('docs', 'doc_id', 'filename')})),
    j AS (SELECT doc_id, length(trim(coalesce(text, ''), ' ')) < 10 AND n.score > 0 AS by_name, n.doc_type AS nk, n.confidence AS nc, {kind} AS rk, {conf} AS c, r.confidence AS rc FROM docs JOIN r USING (doc_id) JOIN n USING (doc_id))
    SELECT doc_id, CASE WHEN by_name THEN nk ELSE rk END AS doc_type, round(CASE WHEN by_name THEN nc ELSE c END, 9) AS confidence, round(CASE WHEN by_name THEN nc ELSE rc END, 9) AS rule_score,
      CASE WHEN by_name THEN 'filename_based' ELSE '{'rules_only_mode' if mode == 'rules_only' else 'ensemble_mode'}' END AS explanation FROM j"""


def _classified(spark, d, mode):
    names = table(spark, d, "history").where("file_hash <> ''").groupBy("file_hash").agg(F.min("original_filename").alias("filename"))
    docs = table(spark, d, "documents").select("doc_id", "text", "file_hash").join(names, "file_hash", "left")
    c = classify.classify(docs, "text", "filename", mode)
    return c.select("doc_id", "doc_type", F.round("confidence", 9).alias("confidence"), F.round("rule_score", 9).alias("rule_score"), "explanation")


@query(_classify_sql("rules_only"))
def classify_rules_only(spark, d):
    return _classified(spark, d, "rules_only")


@query(_classify_sql("ensemble"))
def classify_ensemble(spark, d):
    return _classified(spark, d, "ensemble")


@query(
    f"""WITH c AS ({_CLASSIFIED}), v AS (SELECT doc_id, least(1.0, rule_score / 5.0) AS r, confidence AS m, coalesce(least(1.0, n_chars / 4000.0), 0.0) AS b0 FROM c JOIN documents USING (doc_id)),
    w AS (SELECT *, CASE WHEN b0 > 0.5 THEN least(1.0, b0 * 1.5) ELSE b0 END AS b FROM v)
    SELECT doc_id, CASE WHEN r = greatest(r, m, b) THEN 'rule' WHEN m = greatest(r, m, b) THEN 'ml' ELSE 'vector' END AS winner, round(0.3 * r + 0.3 * m + 0.4 * b, 6) AS score FROM w"""
)
def ensemble_score(spark, d):
    c = classify.rule_classify(table(spark, d, "documents"))
    winner, score = classify.ensemble(F.least(F.lit(1.0), F.col("rule_score") / 5.0), F.col("confidence"), F.coalesce(F.least(F.lit(1.0), F.col("n_chars") / 4000.0), F.lit(0.0)))
    return c.select("doc_id", winner.alias("winner"), F.round(score, 6).alias("score"))


_CASES = [("reconciliation_act", ["акт сверки", "reconciliation"]), ("invoice", ["счёт на оплату", "invoice"]), ("payment_order", ["платёжное поручение"]), ("upd", ["передаточный документ"]), ("torg12", ["товарная накладная"]), ("contract", ["договор"])]
_CASE_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(lower(text), '{t}')''' for t in terms)} THEN '{k}'" for k, terms in _CASES) + " END"


@query(f"SELECT page_hash, ts, {_CASE_SQL} AS doc_type FROM ocr_cache")
def detect_type(spark, d):
    return table(spark, d, "ocr_cache").select("page_hash", "ts", classify.detect_type(F.col("text"), _CASES).alias("doc_type"))


@query(
    """WITH e AS (SELECT vec_id, label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS c FROM e WHERE label IS NOT NULL GROUP BY label, i),
    s AS (SELECT e.vec_id, m.label, sum(x * c) AS dot, sqrt(sum(x * x)) AS nx, sqrt(sum(c * c)) AS nc FROM e JOIN m USING (i) GROUP BY e.vec_id, m.label),
    r AS (SELECT vec_id, label, round(CASE WHEN nx = 0 OR nc = 0 THEN 0.0 ELSE (dot / (nx * nc) + 1) / 2 END, 9) AS score FROM s)
    SELECT vec_id, label, round(score, 6) AS score FROM r QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) = 1"""
)
def embedding_classify(spark, d):
    return classify.nearest_centroid(table(spark, d, "embeddings"), "vec_id", "embedding", "label").select("vec_id", F.col("label").cast("int").alias("label"), F.round("score", 6).alias("score"))


@query()
def ml_classify(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", "document_type")
    model = classify.train(docs.where("document_type is not null"), "text", "document_type", "doc_id")
    return classify.predict(model, docs, "doc_id").select("doc_id", "doc_type", F.round(1 - F.col("confidence"), 6).alias("uncertainty"))


@query("SELECT vec_id, label::int AS label, score FROM (SELECT a.vec_id, b.label, round((list_cosine_similarity(a.embedding, b.embedding)::double + 1) / 2, 4) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::double[], b.embedding::double[]) DESC, b.label) AS r FROM embeddings a, (SELECT label, embedding FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings WHERE label IS NOT NULL) WHERE n = 1) b) WHERE r = 1")
def embedding_references(spark, d):
    e = table(spark, d, "embeddings")
    refs = e.where("label is not null").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return classify.by_references(e, refs, "vec_id", "embedding", "label").select("vec_id", F.col("label").cast("int").alias("label"), F.round("score", 4).alias("score"))


# --- quality ----------------------------------------------------------------------------------------

_W = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
_QUALITY = rf"""SELECT page_hash, ts, round(ls, 6) AS length_score, round(ws, 6) AS word_score, round(gs, 6) AS garbage_score, ss::double AS script_score, round(st, 6)::double AS structure_score,
  round(least(1.0, greatest(0.0, 0.2 * ls + 0.2 * ws + 0.25 * gs + 0.2 * ss + 0.15 * st)), 6) AS quality FROM (
  SELECT page_hash, ts, least(1.0, length(text) / 500.0) AS ls, least(1.0, len(list_filter(w, lambda x: length(x) >= 2)) / 50.0) AS ws,
    CASE WHEN len(w) > 0 THEN 1 - least(1.0, 2.0 * len(list_filter(w, lambda x: regexp_matches(x, '^([\p{{L}}]{{1,2}}|[0-9]{{1,2}}|[^\p{{L}}\p{{N}}_\s]{{1,3}})$'))) / len(w)) ELSE 0.0 END AS gs,
    CASE WHEN every = 0 THEN 0.5 WHEN own / every::double > 0.7 THEN 1.0 WHEN own / every::double > 0.5 THEN 0.7 WHEN own / every::double > 0.3 THEN 0.5 ELSE 0.3 END AS ss,
    CASE WHEN regexp_matches(text, '[.,;:!?]') THEN 0.3 ELSE 0.0 END + CASE WHEN regexp_matches(text, '[0-9]') THEN 0.2 ELSE 0.0 END + CASE WHEN regexp_matches(text, '[A-ZА-ЯЁ]') THEN 0.2 ELSE 0.0 END + CASE WHEN contains(text, ' ') THEN 0.3 ELSE 0.0 END AS st
  FROM (SELECT page_hash, ts, text, {_W} AS w, length(regexp_replace(text, '[^а-яА-ЯёЁ]', '', 'g')) AS own, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS every FROM ocr_cache WHERE text IS NOT NULL))"""


@query(_QUALITY)
def ocr_quality(spark, d):
    t = F.col("text")
    return table(spark, d, "ocr_cache").where("text is not null").select(
        "page_hash", "ts", F.round(quality.length_score(t), 6).alias("length_score"), F.round(quality.word_score(t), 6).alias("word_score"), F.round(quality.garbage_score(t), 6).alias("garbage_score"),
        quality.script_score(t).alias("script_score"), F.round(quality.structure_score(t), 6).alias("structure_score"), F.round(quality.quality(t), 6).alias("quality"),
    )


@query(
    rf"""WITH p AS (SELECT DISTINCT s.file_hash, c.page_hash, c.text FROM ocr_cache c JOIN (SELECT DISTINCT page_hash, file_hash FROM scan_pages) s USING (page_hash) WHERE c.text IS NOT NULL AND s.file_hash IS NOT NULL),
    l AS (SELECT file_hash, unnest(string_split(text, chr(10))) AS line FROM p),
    n AS (SELECT file_hash, line, trim(regexp_replace(lower({_collapse('line')}), '^[.,;:!?]+|[.,;:!?]+$', '', 'g'), ' ') AS norm FROM l)
    SELECT file_hash, norm, max(line) AS line, count(*) AS votes FROM n WHERE length(norm) >= 3 GROUP BY ALL HAVING count(*) >= 2"""
)
def line_voting(spark, d):
    pages = table(spark, d, "scan_pages").where("file_hash is not null").select("page_hash", "file_hash").distinct()
    texts = table(spark, d, "ocr_cache").where("text is not null").select("page_hash", "text").distinct()
    return quality.vote_lines(texts.join(pages, "page_hash"), "file_hash", "text", F.lit(0.5), F.lit(0.5)).drop("score")


@query(
    """SELECT id, CASE WHEN blur < 50 OR contrast < 30 THEN [3.0, 4.0, 5.0] WHEN blur < 100 OR contrast < 50 OR scanned THEN [3.0, 4.0, 5.0] WHEN blur < 200 OR contrast < 70 THEN [2.5, 3.5, 4.0] ELSE [2.0] END::varchar AS ladder
    FROM (SELECT id, id % 400 AS blur, id % 150 AS contrast, contains(original_filename, 'scan') AS scanned FROM history WHERE original_filename IS NOT NULL)"""
)
def resolution_ladder(spark, d):
    h = table(spark, d, "history").where("original_filename is not null")
    r = quality.resolution_ladder(quality.resolution(F.col("id") % 400, F.col("id") % 150, F.col("original_filename").contains("scan")))
    return h.select("id", F.concat(F.lit("["), F.array_join(F.transform(r, lambda x: x.cast("string")), ", "), F.lit("]")).alias("ladder"))


# --- fields and tables ------------------------------------------------------------------------------

_D = ((r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}", "%d.%m.%Y"), ("[0-9]{2} [0-9]{2} [0-9]{4}", "%d %m %Y"), ("[0-9]{4}-[0-9]{2}-[0-9]{2}", "%Y-%m-%d"), ("[0-9]{2}-[0-9]{2}-[0-9]{4}", "%d-%m-%Y"))


def _date_sql(c: str) -> str:
    return "coalesce(" + ", ".join(f"strftime(try_strptime(nullif(regexp_extract({c}, '{p}'), ''), '{f}'), '%Y-%m-%d')" for p, f in _D) + ")"


def _value_sql(kind: str, raw: str) -> str:
    tight = f"regexp_replace({raw}, '[{_SP}]', '', 'g')"
    if kind in ("digits_10_12", "digits_9", "digits_20"):
        return f"CASE WHEN regexp_full_match({tight}, '[0-9]{{{kind.removeprefix('digits_').replace('_', ',')}}}') THEN {tight} END"
    if kind == "float":
        number = f"regexp_replace(replace({tight}, ',', '.'), '[^0-9.\\-]', '', 'g')".replace("\\\\", "\\")
        return f"CASE WHEN regexp_full_match({number}, '-?([0-9]+[.]?[0-9]*|[.][0-9]+)') THEN printf('%.2f', {number}::double) END"
    return _date_sql(raw) if kind == "date" else f"nullif({_collapse(raw)}, '')"


def _fields_sql(source: str = "documents", key: str = "doc_id") -> str:
    """(key, field_name, value, value_num, confidence): the matches of each pattern with their places, from the gaps between them."""
    parts = []
    for f in extract.FIELDS:
        for i, p in enumerate(sorted(f.patterns, key=lambda p: -p.priority)):
            pat = p.pattern.replace("'", "''")
            base = {"digits_10_12": "least(1.0::double, length(w) / 20.0::double)", "float": "least(1.0::double, length(w) / 20.0::double)", "digits_9": "0.5::double", "date": "0.9::double"}.get(f.validate, "0.7::double")
            near = f"CASE WHEN regexp_matches(around, '(?i){extract.CONTEXT[f.name]}') THEN 0.15::double ELSE 0::double END" if f.name in extract.CONTEXT else "0::double"
            words = " OR ".join(f"contains(lower(around), '{k.lower()}')" for k in p.context_keywords) or "true"
            inn = _inn_sql("value") if f.checked_inn else "true"
            parts.append(f"""SELECT {key}, '{f.name}' AS field_name, value, {'value::double' if f.validate == 'float' else 'NULL::double'} AS value_num, {p.priority} AS prio, {i} AS pat, k,
              round(least(1.0::double, least(1.0::double, least(1.0::double, greatest(0.0::double, {base} + (0.1::double * (pos / length(norm)::double < 0.3::double)::int + {near} + 0.1::double * (raw <> '' AND (length(text) - length(replace(text, raw, ''))) / length(raw) = 1)::int))) + {p.priority} / 100.0::double) + 0.1::double * {int(f.checked_inn)}), 6) AS confidence
              FROM (SELECT *, {_value_sql(f.validate, 'raw')} AS value, substr(norm, (greatest(0, pos - 200) + 1)::bigint, (pos + length(w) + 200 - greatest(0, pos - 200))::bigint) AS around FROM (
                SELECT {key}, text, norm, k, whole[k] AS w, grp[k] AS raw, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:k - 1], lambda x: length(x))), 0) AS pos
                FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS k FROM (SELECT {key}, text, norm, regexp_extract_all(norm, '(?im){pat}', 0) AS whole, regexp_extract_all(norm, '(?im){pat}', 1) AS grp, regexp_split_to_array(norm, '(?im){pat}') AS gaps FROM n))))
              WHERE value IS NOT NULL AND ({words}) AND {inn}""")
    norm = _collapse("translate(text, '«»„−–—', '\"\"\"---')")
    return f"""(WITH n AS (SELECT {key}, text, {norm} AS norm FROM {source} WHERE text IS NOT NULL)
    SELECT {key}, field_name, value, value_num, confidence FROM ({' UNION ALL '.join(parts)}) QUALIFY row_number() OVER (PARTITION BY {key}, field_name ORDER BY confidence DESC, prio DESC, pat, k) = 1)"""


_FIELDS = _fields_sql()


@query(f"SELECT * FROM {_FIELDS}")
def extract_fields(spark, d):
    return extract.extract(table(spark, d, "documents"), "doc_id", "text")


@query(f"SELECT field_name, count(DISTINCT doc_id) AS docs, round(count(DISTINCT doc_id) / (SELECT count(*) FROM documents)::double, 6) AS coverage, round(avg(confidence), 6) AS accuracy FROM {_FIELDS} GROUP BY field_name")
def field_coverage(spark, d):
    docs = table(spark, d, "documents")
    return extract.coverage(extract.extract(docs, "doc_id", "text"), docs, "doc_id")


@query(
    f"""WITH c AS ({_CLASSIFIED}), p AS (SELECT field_name, count(DISTINCT doc_id) AS docs, avg(confidence) AS acc FROM {_FIELDS} GROUP BY 1),
    n AS (SELECT count(*) AS documents, count(*) FILTER (confidence <= 0.5) AS uncertain FROM c), f AS (SELECT count(*) AS fields, avg(acc) AS a, min(docs) AS least_docs FROM p)
    SELECT documents, uncertain, fields, 0 AS auto_corrections, round(a, 6) AS mean_accuracy, round(0.8 * a + 0.2 * (1 - uncertain / documents::double), 6) AS score,
      concat_ws('; ', CASE WHEN uncertain / documents::double > 0.1 THEN 'label more documents' END, CASE WHEN least_docs < 0.5 * documents THEN 'add patterns for rare fields' END) AS recommendations FROM n, f"""
)
def batch_summary(spark, d):
    docs = table(spark, d, "documents")
    return extract.summary(classify.rule_classify(docs), extract.extract(docs, "doc_id", "text"), "doc_id").withColumn("recommendations", F.array_join("recommendations", "; "))


@query(
    f"""WITH h AS {_FILES}, f AS (SELECT doc_id, max(value) FILTER (field_name = 'document_number') AS a1, max(value) FILTER (field_name = 'date') AS b1, max(value) FILTER (field_name = 'amount') AS c1, max(value) FILTER (field_name = 'inn') AS a2 FROM {_FIELDS} GROUP BY doc_id)
    SELECT d.doc_id, f.a1 AS "A1", f.b1 AS "B1", f.c1 AS "C1", f.a2 AS "A2", coalesce(h.filename, '') AS "B2" FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN h USING (file_hash)"""
)
def export_mapping(spark, d):
    names = table(spark, d, "history").where("file_hash <> ''").groupBy("file_hash").agg(F.min("original_filename").alias("filename"))
    each = extract.extract_each(table(spark, d, "documents").select("doc_id", "text", "file_hash"), "doc_id", "text", keep=("file_hash",))
    docs = each.join(names, "file_hash", "left").withColumn("fields", F.map_from_entries(F.transform("found", lambda x: F.struct(x["field_name"], x["value"]))))
    return extract.project_mapping(docs, {"A1": "document_number", "B1": "date", "C1": "amount", "A2": "inn", "B2": "_filename"}, "doc_id", filename="filename")


def _first_sql(pattern: str, c: str = "t") -> str:
    return f"nullif(regexp_extract({c}, '(?i){pattern.replace(chr(39), chr(39) * 2)}', 1), '')"


def _party_sql(role: str) -> str:
    name = f"regexp_replace(trim({_first_sql(rf'(?:{role})[:{chr(92)}s]+({parse._NAME}+?)(?:{chr(92)}n|ИНН|КПП|адрес|тел|БИК|р/с|$)')}, ' '), ',+$', '')"
    return f"CASE WHEN length({name}) > 2 THEN {name} END"


def _parsed_sql() -> str:
    invoice = ", ".join(f"'{k}'" for k, p in parse.PLANS.items() if p.invoice)
    plain = ", ".join(f"'{k}'" for k in parse.FIELD_ONLY)
    inn = lambda role, of: _first_sql(rf"(?:(?:{role})[:\s]+[А-ЯЁ\s«»,.\-]+?ИНН|ИНН\s+(?:{of}))[\s:\-]*(\d{{10,12}})")
    beside = lambda n: f"CASE WHEN instr(t, substr({n}, 1, 20)) > 0 THEN nullif(regexp_extract(substr(t, instr(t, substr({n}, 1, 20)) + least(20, length({n}))), '(?i)^\\D*ИНН\\s*[:\\-]?\\s*(\\d{{10,12}})', 1), '') END"
    number = _first_sql(r"сч[её]т\s*(?:на\s+оплату)?\s*[№N]?\s*[:\-]?\s*[_\s№]*(\d+)")
    vat = "regexp_replace(replace(" + _first_sql(r"(?:ндс|н\s*д\s*с)[\s:\-/]*(?:в\s+том\s+числе\s+)?([\d ]+[.,]?\d*)") + ", ',', '.'), ' ', '', 'g')"
    trimmed = lambda c: f"CASE WHEN length({c}) > 2 THEN nullif(regexp_replace(trim({c}, ' '), '[»,]+$', ''), '') END"
    own = {"document_number": f"CASE WHEN {number} <> '0' THEN {number} END", "supplier": _party_sql("поставщик"), "buyer": _party_sql("покупатель|заказчик"), "supplier_inn": inn("поставщик", "поставщика"), "buyer_inn": inn("покупатель|заказчик", "покупателя|заказчика"), "bic": _first_sql(r"БИК\s*[:\-]?\s*(\d{9})"), "vat": f"CASE WHEN try_cast({vat} AS DOUBLE) <> 0 THEN printf('%.2f', {vat}::double) END"}
    conf = {"document_number": 0.9, "supplier": 0.8, "buyer": 0.8, "supplier_inn": 0.9, "buyer_inn": 0.9, "bic": 0.9, "vat": 0.8}
    rows = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS field_name, {c} AS value, {conf[n]}::double AS confidence, 0 AS prio FROM d WHERE kind IN ({invoice})" for n, c in own.items())
    orgs = _ORG.replace("text", "t")
    loose = _first_sql(r"(\d{1,2}[./ ]\d{1,2}[./ ]\d{4}|\d{1,2}\s+[а-яё]+\s+20\d{2})")
    bad = lambda who: f"f.{who} <> '' AND f.{who}_inn <> '' AND NOT coalesce({_inn_sql(f'f.{who}_inn')}, false)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, document_type AS kind FROM documents),
    o AS (SELECT doc_id, list_filter(list_transform(list_slice({orgs}, 1, 2), lambda x: trim(x, ' ')), lambda x: length(x) > 3) AS os FROM d WHERE kind IS NULL OR kind NOT IN ({plain})),
    r AS (SELECT doc_id, field_name, value, confidence, 1 AS prio FROM {_FIELDS} UNION ALL SELECT doc_id, 'organization_' || i, os[i], 0.7, 1 FROM (SELECT doc_id, os, unnest(range(1, len(os) + 1)) AS i FROM o) UNION ALL {rows}),
    a AS (SELECT * FROM r WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, field_name ORDER BY prio) = 1),
    w AS (SELECT d.doc_id, t, max(value) FILTER (field_name = 'supplier') AS s0, max(value) FILTER (field_name = 'buyer') AS b0, max(value) FILTER (field_name = 'organization_1') AS o1, max(value) FILTER (field_name = 'organization_2') AS o2 FROM d LEFT JOIN a USING (doc_id) WHERE kind IN ({invoice}) GROUP BY ALL),
    x AS (SELECT doc_id, t, coalesce(s0, {trimmed('o1')}) AS s, coalesce(b0, {trimmed('o2')}) AS b FROM w),
    z AS (SELECT doc_id, 'supplier' AS field_name, s AS value, 0.7::double AS confidence FROM x UNION ALL SELECT doc_id, 'buyer', b, 0.7 FROM x UNION ALL SELECT doc_id, 'supplier_inn', {beside('s')}, 0.8 FROM x UNION ALL SELECT doc_id, 'buyer_inn', {beside('b')}, 0.8 FROM x UNION ALL SELECT doc_id, 'date', {loose}, 0.7 FROM x),
    e AS (SELECT doc_id, field_name, value, confidence FROM a UNION ALL SELECT * FROM z WHERE value IS NOT NULL AND (doc_id, field_name) NOT IN (SELECT doc_id, field_name FROM a)),
    f AS (SELECT doc_id, max(value) FILTER (field_name = 'supplier') AS supplier, max(value) FILTER (field_name = 'supplier_inn') AS supplier_inn, max(value) FILTER (field_name = 'buyer') AS buyer, max(value) FILTER (field_name = 'buyer_inn') AS buyer_inn, max(value) FILTER (field_name = 'date') AS date FROM e GROUP BY 1),
    g AS (SELECT doc_id, {bad('supplier')} AS bs, {bad('buyer')} AS bb, CASE WHEN regexp_full_match(date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_strptime(date, '%Y-%m-%d') WHEN regexp_full_match(date, '[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}}') THEN try_strptime(date, '%d.%m.%Y') WHEN regexp_full_match(date, '[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}') THEN try_strptime(date, '%d-%m-%Y') END::date AS dd FROM f)
    SELECT e.doc_id, d.kind AS document_type, field_name, value, CASE WHEN field_name = 'supplier_inn' AND bs OR field_name = 'buyer_inn' AND bb THEN 'unsound_inn' WHEN field_name = 'date' AND dd < DATE '2024-06-30' - 7300 THEN 'too_old' WHEN field_name = 'date' AND dd > DATE '2024-06-30' THEN 'future' END AS warning,
      round(greatest(0.0, confidence - CASE WHEN field_name = 'supplier_inn' AND bs OR field_name = 'buyer_inn' AND bb THEN 0.3 WHEN field_name = 'date' AND dd > DATE '2024-06-30' THEN 0.2 WHEN field_name = 'date' AND dd < DATE '2024-06-30' - 7300 THEN 0.1 ELSE 0.0 END::double), 6) AS confidence
    FROM e JOIN d USING (doc_id) JOIN g USING (doc_id)"""


_ORG = r"regexp_extract_all(text, '(?:ООО|ОАО|ЗАО|ИП|ПАО|АО)\s*[«\"]([^«»\"\n]+)[»\"]', 1)"


@query(_parsed_sql())
def parse_documents(spark, d):
    p = parse.parse_documents(table(spark, d, "documents"), "doc_id", "text", "document_type", now=F.lit("2024-06-30").cast("date"))
    return p.drop("auto_corrected")  # only with fields of tables


_REL = f"""SELECT id, tw, tv, am, dd, nm, inn, conf, abs(tw - (tn + tv)) > 0.01 AND tw <> 0 AND tn <> 0 AND tv <> 0 AS off, tw < 0 AS neg, tw < tn AND tw <> 0 AND tn <> 0 AS less, tn FROM (
    SELECT id, amount_with_vat AS tw, amount_without_vat AS tn, round(total_amount - amount_without_vat, 2) AS tv, total_amount AS am, contractor_name AS nm, contractor_inn AS inn, confidence AS conf,
      CASE WHEN regexp_full_match(document_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_strptime(document_date, '%Y-%m-%d') WHEN regexp_full_match(document_date, '[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}}') THEN try_strptime(document_date, '%d.%m.%Y')
        WHEN regexp_full_match(document_date, '[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}') THEN try_strptime(document_date, '%d-%m-%Y') END::date AS dd FROM history)"""
_RELATIONS = f"""SELECT id, CASE WHEN less THEN 'less_than_without_vat' WHEN neg THEN 'negative' WHEN off THEN 'vat_mismatch' END AS total_warning, CASE WHEN off THEN round(tn + tv, 2) END AS auto_corrected,
    CASE WHEN am < 0 THEN 'negative' END AS amount_warning, CASE WHEN nm <> '' AND inn <> '' AND NOT coalesce({_inn_sql('inn')}, false) THEN 'unsound_inn' END AS inn_warning,
    CASE WHEN dd < DATE '2024-06-30' - 7300 THEN 'too_old' WHEN dd > DATE '2024-06-30' THEN 'future' END AS date_warning,
    round(CASE WHEN dd > DATE '2024-06-30' THEN greatest(0.0, conf - 0.2) WHEN dd < DATE '2024-06-30' - 7300 THEN greatest(0.0, conf - 0.1) ELSE conf END, 6) AS date_confidence FROM ({_REL})"""


def _relations(spark, d):
    h = table(spark, d, "history")
    values = {"total_with_vat": h.amount_with_vat, "total_without_vat": h.amount_without_vat, "vat": F.round(h.total_amount - h.amount_without_vat, 2), "amount": h.total_amount, "supplier": h.contractor_name, "supplier_inn": h.contractor_inn, "date": h.document_date}
    c = parse.check(values, dict.fromkeys(values, F.coalesce(h.confidence, F.lit(None).cast("double"))), F.lit("2024-06-30").cast("date"))
    return h.select(
        "id", c["total_with_vat_warning"].alias("total_warning"), c["total_with_vat_corrected"].alias("auto_corrected"), c["amount_warning"].alias("amount_warning"), c["supplier_inn_warning"].alias("inn_warning"),
        c["date_warning"].alias("date_warning"), F.round(c["date_confidence"], 6).alias("date_confidence"),
    )


@query(_RELATIONS)
def field_relationships(spark, d):
    return _relations(spark, d)


@query(f"SELECT count(*) FILTER (auto_corrected <> 0) AS auto_corrections, count(*) FILTER (total_warning IS NOT NULL OR amount_warning IS NOT NULL OR inn_warning IS NOT NULL OR date_warning IS NOT NULL) AS warned FROM ({_RELATIONS})")
def auto_corrections(spark, d):
    r = _relations(spark, d)
    warned = F.coalesce("total_warning", "amount_warning", "inn_warning", "date_warning").isNotNull()
    return r.agg(F.count_if(F.coalesce(F.col("auto_corrected"), F.lit(0.0)) != 0).alias("auto_corrections"), F.count_if(warned).alias("warned"))


@query(
    r"""SELECT page_hash, count(*) AS lines, round(sum(replace(replace(regexp_extract(x, '([\d ]*\d[.,]\d\d)$', 1), ' ', ''), ',', '.')::double), 2) AS total
    FROM (SELECT page_hash, unnest(string_split(text, chr(10))) AS x FROM (SELECT DISTINCT page_hash, text FROM ocr_cache)) WHERE regexp_matches(x, '^\s*(\d{1,4}) (.+?) (\d{3}) (\d+) (\S+) ([\d ]*\d[.,]\d\d)$') GROUP BY page_hash"""
)
def table_rows(spark, d):
    pages = table(spark, d, "ocr_cache").select("page_hash", "text").distinct()
    rows = tables.lines_as_rows(pages, "page_hash", "text").select("page_hash", F.explode("rows").alias("r"))
    price = F.regexp_replace(F.translate(F.element_at("r", 6), ",", "."), r"\s", "").try_cast("double")
    return rows.groupBy("page_hash").agg(F.count("*").alias("lines"), F.round(F.sum(price), 2).alias("total"))


_TABLES = r"""(SELECT page_hash, row_no - 1 AS row_no, unnest(range(0, 6)) AS col_no, unnest([regexp_extract(x, p, 1), regexp_extract(x, p, 2), regexp_extract(x, p, 3), regexp_extract(x, p, 4), regexp_extract(x, p, 5), regexp_extract(x, p, 6)]) AS value
    FROM (SELECT page_hash, x, p, row_number() OVER (PARTITION BY page_hash ORDER BY nth) AS row_no FROM (SELECT page_hash, '^\s*(\d{1,4}) (.+?) (\d{3}) (\d+) (\S+) ([\d ]*\d[.,]\d\d)$' AS p, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS nth
      FROM (SELECT DISTINCT page_hash, text FROM ocr_cache)) WHERE regexp_matches(x, p)))"""
_NUM = r"try_cast(regexp_replace(replace(value, ',', '.'), '\s', '', 'g') AS DOUBLE)"


@query(
    f"""SELECT page_hash, 0 AS table_no, col_no::int AS col_no, 'col' || col_no AS header, bool_and({_NUM} IS NOT NULL) AS numeric, round(sum({_NUM}), 2) AS total, max_by({_NUM}, row_no) AS last,
      bool_and({_NUM} IS NOT NULL) AND abs(round(sum({_NUM}), 2) - 2 * max_by({_NUM}, row_no)) <= 0.01 AS sum_row FROM {_TABLES} GROUP BY page_hash, col_no"""
)
def table_columns(spark, d):
    pages = table(spark, d, "ocr_cache").select("page_hash", "text").distinct()
    return tables.numeric_columns(tables.cells(tables.lines_as_rows(pages, "page_hash", "text"), "page_hash", "rows"), "page_hash")


_ITEMS = ("№", "Наименование", "Код", "Количество", "Ед.", "Сумма")


def _item_tables(spark, d):
    """The item lines of a page as a table with a header; and as a second one its sums by kind, where there is an act."""
    pages = table(spark, d, "ocr_cache").select("page_hash", "text").distinct()
    rows = tables.lines_as_rows(pages, "page_hash", "text")
    head = F.array(F.array(*[F.lit(x) for x in _ITEMS]))
    first = rows.select("page_hash", F.lit(0).alias("table_no"), F.concat(head, F.col("rows")).alias("rows"))
    second = rows.select("page_hash", F.lit(1).alias("table_no"), F.array(F.array(F.lit("Вид"), F.lit("Оборот"), F.lit("Итого")), F.array(F.lit("сальдо"), F.lit("5"), F.element_at("rows", 1)[3]), F.array(F.lit("дебет"), F.lit("7,5"), F.lit("1"))).alias("rows"))
    return tables.cells(first.unionByName(second), "page_hash", "rows", "table_no")


@query(
    f"""SELECT page_hash, 1 AS table_no, r AS row_no, CASE WHEN r = 0 THEN 'оборот=5.0;итого=' || q ELSE 'оборот=7.5;итого=1.0' END AS numbers
    FROM (SELECT page_hash, value::double AS q, unnest([0, 1]) AS r FROM {_TABLES} WHERE row_no = 0 AND col_no = 3)"""
)
def table_operations(spark, d):
    o = tables.operations(_item_tables(spark, d), "page_hash")
    return o.select("page_hash", "table_no", "row_no", F.array_join(F.transform("values", lambda v: F.concat(v["header"], F.lit("="), v["number"].cast("string"))), ";").alias("numbers"))


@query(
    f"""WITH t AS {_TABLES}, a AS (SELECT page_hash, printf('%.2f', max_by({_NUM}, row_no)) AS v, max_by({_NUM}, row_no) AS n FROM t WHERE col_no = 5 GROUP BY 1)
    SELECT page_hash, 'amount' AS field_name, v AS value, 0.9::double AS confidence FROM a WHERE n > 0 UNION ALL SELECT a.page_hash, CASE WHEN n > 0 THEN 'total_with_vat' ELSE 'amount' END, '1.00', 0.9::double FROM a"""
)
def table_fields(spark, d):
    return parse.fields_of_tables(_item_tables(spark, d), "page_hash")


@query(f"SELECT page_hash, max(CASE WHEN col_no = 1 THEN value END) AS name, max(CASE WHEN col_no = 5 THEN value END) AS amount FROM {_TABLES} WHERE row_no = 0 GROUP BY page_hash")
def table_lookup(spark, d):
    first = extract.first_values(_item_tables(spark, d).where("table_no = 0"), "page_hash")
    return first.select("page_hash", F.try_element_at("columns", F.lit("наименование")).alias("name"), F.try_element_at("columns", F.lit("сумма")).alias("amount"))


_OWN = "РОМАШКА"


def _re(s: str) -> str:
    return s.replace("'", "''")


def _acts_sql() -> str:
    num = "coalesce(" + ", ".join(f"nullif(regexp_extract(head, '(?i){_re(p)}', 1), '')" for p in reconcile.NUMBERS) + ")"
    date = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(head, '(?i){_re(p)}') THEN concat_ws('.', lpad(regexp_extract(head, '(?i){_re(p)}', 1), 2, '0'), lpad(regexp_extract(head, '(?i){_re(p)}', 2), 2, '0'), regexp_extract(head, '(?i){_re(p)}', 3)) END" for p in reconcile.DATES) + ")"
    orgs = [f"regexp_extract_all(t, '(?i){_re(p)}', 1)" for p in reconcile.NAMED] + [f"regexp_extract_all(t, '(?im){_re(a + reconcile._AFTER)}', 1)" for a in reconcile.ANCHORS]
    dist = f"list_filter(list_transform({' || '.join(orgs)}, lambda x: trim(x, ' ')), lambda x: length(x) BETWEEN 5 AND 100)"
    named = " || ".join(f"regexp_extract_all(tail, '(?i){_re(k)}[\\s:]*([0-9][0-9 ,.]*)', 1)" for k in reconcile.BALANCES)
    amt = lambda c: f"list_transform({c}, lambda x: try_cast(replace(replace(trim(x, ' '), ' ', ''), ',', '.') AS DOUBLE))"
    return f"""WITH d AS (SELECT doc_id, text AS t, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls FROM documents WHERE lower(text) LIKE '%акт сверки%'),
    h AS (SELECT *, array_to_string(ls[1:5], ' ') AS head, array_to_string(CASE WHEN len(ls) > 50 THEN ls[-50:] ELSE ls END, chr(10)) AS tail FROM d),
    p AS (SELECT doc_id, t, {num} AS act_number, {date} AS act_date, {dist} AS every, regexp_extract_all(t, '(?i)ИНН[\\s:]*([0-9]{{10,12}})', 1) AS inns, coalesce(list_max({amt(named)}), 0.0) AS named,
      coalesce(list_max(list_filter({amt("regexp_extract_all(tail, '([0-9][0-9 ,.]*)', 1)")}, lambda x: x BETWEEN 1000 AND 1e9)), 0.0) AS loose FROM h),
    o AS (SELECT *, list_transform(list_filter(list_zip(every, range(1, len(every) + 1)), lambda x: list_position(every, x[1]) = x[2]), lambda x: x[1])[1:3] AS names, CASE WHEN named > 0 THEN named ELSE loose END AS final_balance FROM p),
    c AS (SELECT *, list_filter(names, lambda x: NOT contains(upper(x), '{_OWN}')) AS others FROM o)
    SELECT doc_id, act_number, act_date, CASE WHEN len(names) >= 2 THEN coalesce(others[1], names[2]) ELSE others[1] END AS counterparty, inns[1] AS counterparty_inn, final_balance FROM c"""


def _acts(spark, d):
    return reconcile.parse_act(table(spark, d, "documents").where("lower(text) like '%акт сверки%'"), "doc_id", "text", own_name=_OWN)


@query(_acts_sql())
def reconciliation_acts(spark, d):
    return _acts(spark, d).select("doc_id", "act_number", "act_date", "counterparty", "counterparty_inn", "final_balance")


@query(
    f"""SELECT doc_id, round((act_number IS NOT NULL)::int * 0.15 + (act_date IS NOT NULL)::int * 0.15 + (counterparty IS NOT NULL)::int * 0.25 + (counterparty_inn IS NOT NULL)::int * 0.2 + (final_balance > 0)::int * 0.25, 2)::double AS confidence,
      'Акт сверки' || coalesce(' № ' || act_number, '') || coalesce(' от ' || act_date, '') AS title FROM ({_acts_sql()})"""
)
def reconciliation_cards(spark, d):
    return reconcile.card(_acts(spark, d)).select("doc_id", "confidence", F.split("formatted_text", "\n")[0].alias("title"))


@query(
    f"""SELECT doc_id, x.f AS field_name, x.v AS value FROM (SELECT doc_id, unnest([{{'f': 'act_number', 'v': act_number}}, {{'f': 'act_date', 'v': act_date}}, {{'f': 'counterparty', 'v': counterparty}}, {{'f': 'counterparty_inn', 'v': counterparty_inn}},
      {{'f': 'document_number', 'v': act_number}}, {{'f': 'date', 'v': act_date}}, {{'f': 'final_balance', 'v': CASE WHEN final_balance > 0 THEN printf('%.2f', final_balance) END}}]) AS x FROM ({_acts_sql()})) WHERE x.v IS NOT NULL"""
)
def reconciliation_fields(spark, d):
    return reconcile.act_fields(_acts(spark, d), "doc_id").select("doc_id", "field_name", "value")


@query()
def ocr_correct(spark, d):
    return correct.correct(table(spark, d, "ocr_cache").select("page_hash", "ts", "text"), "text")


@query()
def ocr_correct_by_type(spark, d):
    pages = table(spark, d, "ocr_cache").select("page_hash", "ts", "text")
    return correct.correct(pages.withColumn("doc_type", classify.detect_type(F.col("text"), _CASES)), "text", "doc_type")


_ORG = r"regexp_extract_all(text, '(?:ООО|ОАО|ЗАО|ИП|ПАО|АО)\s*[«\"]([^«»\"\n]+)[»\"]', 1)"


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform(list_slice({_ORG}, 1, 2), lambda x: trim(x, ' ')), lambda x: length(x) > 3), '; ') AS organisations FROM documents WHERE text IS NOT NULL")
def additional_organisations(spark, d):
    o = parse.organisations(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(F.transform(o, lambda x: x["value"]), "; ").alias("organisations"))


_BANK = " OR ".join(f"contains(low, '{w}')" for w in correct.REQUISITES)


@query(
    f"""SELECT id, CASE WHEN c IS NULL OR c = '' THEN false WHEN length(c) > 50 THEN false WHEN ({_BANK}) AND low IN ({', '.join(f"'{w}'" for w in correct.LABELS)}) THEN true WHEN ({_BANK}) AND length(c) > 15 THEN false
    WHEN regexp_full_match(trim(c, ' '), '[0-9]+') THEN false WHEN (contains(c, '«') OR contains(c, '»')) AND length(c) > 20 THEN false WHEN v IS NULL OR trim(v, ' ') = '' THEN used ELSE true END AS is_header
    FROM (SELECT id, contractor_name AS c, lower(contractor_name) AS low, document_number AS v, total_amount IS NOT NULL AS used FROM history)"""
)
def header_test(spark, d):
    h = table(spark, d, "history")
    return h.select("id", correct.header_like(F.col("contractor_name"), F.col("document_number"), F.col("total_amount").isNotNull()).alias("is_header"))


# --- history ----------------------------------------------------------------------------------------


@query(
    """SELECT id, original_filename, contractor_name, processed_at FROM history WHERE document_type = 'invoice' AND status = 'success' AND document_date >= '2024-01-01' AND document_date <= '2024-12-31'
    AND (original_filename ILIKE '%счёт%' OR contractor_name ILIKE '%счёт%' OR document_number ILIKE '%счёт%' OR contractor_inn ILIKE '%счёт%')"""
)
def history_search(spark, d):
    return history.search(table(spark, d, "history"), text="счёт", kind="invoice", state="success", date_from="2024-01-01", date_to="2024-12-31").select("id", "original_filename", "contractor_name", "processed_at")


@query("SELECT id, original_filename, processed_at FROM history ORDER BY processed_at DESC NULLS LAST, id LIMIT 50 OFFSET 50")
def history_page(spark, d):
    return history.page(table(spark, d, "history"), 2, 50).select("id", "original_filename", "processed_at")


@query(
    """WITH t AS (SELECT contractor_name, count(*) AS n FROM history WHERE contractor_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1)
    SELECT count(*) AS total, count(*) FILTER (processed_at::date = DATE '2024-03-01') AS today, count(*) FILTER (status = 'error') AS errors, round(count(*) FILTER (status = 'error') * 100.0 / count(*), 1) AS error_percent,
    (SELECT contractor_name FROM t) AS top_contractor, (SELECT n FROM t) AS top_count FROM history"""
)
def history_statistics(spark, d):
    return history.statistics(table(spark, d, "history"), "2024-03-01")


@query("SELECT document_type, count(*) AS docs FROM history WHERE document_type IS NOT NULL GROUP BY 1")
def history_by_type(spark, d):
    return history.by_type(table(spark, d, "history"))


@query("SELECT DISTINCT contractor_name, contractor_inn FROM history WHERE contractor_name IS NOT NULL")
def history_contractors(spark, d):
    return history.contractors(table(spark, d, "history"))


_DUP = """SELECT id, CASE WHEN document_number <> '' AND document_date <> '' AND contractor_inn <> '' THEN 'n|' || document_number || '|' || document_date || '|' || contractor_inn WHEN file_hash <> '' THEN 'h|' || file_hash END AS k FROM history"""


@query(f"SELECT id, min(id) OVER (PARTITION BY k) AS class_id, count(*) OVER (PARTITION BY k) - 1 AS copies FROM ({_DUP}) WHERE k IS NOT NULL QUALIFY copies > 0")
def history_duplicates(spark, d):
    return history.duplicates(table(spark, d, "history"))


@query("SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY original_filename, file_hash ORDER BY processed_at DESC NULLS LAST, id DESC) = 1")
def history_upsert(spark, d):
    return history.upsert(table(spark, d, "history"))


@query("SELECT id, processed_at FROM history WHERE processed_at IS NULL OR processed_at >= TIMESTAMP '2024-06-01' - INTERVAL 90 DAY")
def history_retention(spark, d):
    return history.retained(table(spark, d, "history"), "2024-06-01", 90).select("id", "processed_at")


@query(
    """SELECT id, CASE WHEN error_message IS NOT NULL AND error_message <> '' THEN 'error' WHEN f = 0 THEN 'partial' ELSE 'success' END AS derived
    FROM (SELECT *, (contractor_name IS NOT NULL)::int + (document_date IS NOT NULL)::int + (document_number IS NOT NULL)::int + (total_amount IS NOT NULL)::int AS f FROM history)"""
)
def history_status(spark, d):
    n = sum((F.col(c).isNotNull().cast("int") for c in ("contractor_name", "document_date", "document_number", "total_amount")), F.lit(0))
    return table(spark, d, "history").select("id", history.status(F.col("error_message"), n).alias("derived"))


@query(
    "SELECT id, CASE WHEN " + ("(low NOT IN (%s) AND length(low) >= 3 AND NOT (regexp_matches(low, '%s') AND length(low) < 20))" % (", ".join(f"'{n}'" for n in history.NOT_A_NAME), history.PAYMENT)) + """ THEN contractor_name END AS contractor,
    coalesce(total_amount, CASE WHEN amount_with_vat <> 0 THEN amount_with_vat END, amount_without_vat) AS amount FROM (SELECT *, lower(trim(contractor_name, ' ')) AS low FROM history)"""
)
def history_contractor_and_amount(spark, d):
    h = table(spark, d, "history")
    return h.select("id", F.when(history.acceptable_name(F.col("contractor_name")), F.col("contractor_name")).alias("contractor"), history.amount(F.col("total_amount"), F.col("amount_with_vat"), F.col("amount_without_vat")).alias("amount"))


@query("SELECT id, coalesce(CASE WHEN json_valid(output_files) THEN len(json_keys(output_files)) END, 0)::int AS files FROM history")
def history_output_files(spark, d):
    return history.output_files(table(spark, d, "history"))


@query(
    """WITH g AS (SELECT document_type, count(*) AS docs, round(avg(confidence), 6) AS avg_confidence, count(contractor_name) AS with_name, count(document_number) AS with_number, count(total_amount) AS with_amount FROM history WHERE document_type IS NOT NULL GROUP BY 1),
    n AS (SELECT DISTINCT document_type, original_filename FROM history WHERE document_type IS NOT NULL AND original_filename IS NOT NULL),
    e AS (SELECT document_type, string_agg(original_filename, '; ' ORDER BY original_filename) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY document_type ORDER BY original_filename) AS r FROM n) WHERE r <= 3 GROUP BY 1)
    SELECT g.*, e.examples FROM g LEFT JOIN e USING (document_type)"""
)
def document_groups(spark, d):
    return history.groups(table(spark, d, "history"))


@query(
    """WITH n AS (SELECT page_hash, text FROM ocr_cache QUALIFY row_number() OVER (PARTITION BY page_hash ORDER BY ts DESC NULLS LAST, text DESC NULLS LAST) = 1)
    SELECT DISTINCT p.page_hash, n.text, n.page_hash IS NOT NULL AS hit FROM scan_pages p LEFT JOIN n USING (page_hash)"""
)
def ocr_cache_lookup(spark, d):
    return history.cache_lookup(table(spark, d, "scan_pages"), table(spark, d, "ocr_cache"))


@query("SELECT document, correct_type FROM feedback WHERE document IS NOT NULL AND correct_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document ORDER BY ts DESC NULLS LAST, correct_type DESC) = 1")
def feedback_labels(spark, d):
    return history.feedback_labels(table(spark, d, "feedback"))


@query(
    """SELECT h.document_type, f.correct_type, count(*) AS docs FROM history h JOIN (SELECT document, correct_type FROM feedback WHERE document IS NOT NULL AND correct_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document ORDER BY ts DESC NULLS LAST, correct_type DESC) = 1) f
    ON h.original_filename = f.document GROUP BY ALL"""
)
def feedback_confusion(spark, d):
    labels = history.feedback_labels(table(spark, d, "feedback")).withColumnRenamed("document", "original_filename")
    return table(spark, d, "history").select("original_filename", "document_type").join(labels, "original_filename").groupBy("document_type", "correct_type").agg(F.count("*").alias("docs"))


_EXPORT = ", ".join((f"coalesce({c}, '') AS \"{n}\"" if c not in ("total_amount", "amount_with_vat", "amount_without_vat", "processed_at", "confidence") else f'{c} AS "{n}"') for c, n in history.EXPORT.items())


@query(f"SELECT {_EXPORT} FROM (SELECT * FROM history ORDER BY processed_at DESC NULLS LAST, id LIMIT {history.EXPORT_ROWS})")
def history_export(spark, d):
    return history.export(table(spark, d, "history"))


@query("SELECT count(*) AS total, ceil(count(*) / 50.0)::bigint AS total_pages FROM history WHERE processed_at >= TIMESTAMP '2024-01-01' AND processed_at <= TIMESTAMP '2024-12-31'")
def history_page_count(spark, d):
    return history.page_count(history.search(table(spark, d, "history"), processed_from="2024-01-01", processed_to="2024-12-31"), 50)


@query("SELECT * FROM history WHERE id IN (SELECT min(id) FROM history)")
def history_get(spark, d):
    h = table(spark, d, "history")
    return history.get(h, h.agg(F.min("id")).first()[0])


@query("SELECT id FROM history WHERE id NOT IN (SELECT min(id) FROM history UNION SELECT max(id) FROM history)")
def history_delete(spark, d):
    h = table(spark, d, "history")
    return history.delete(h, list(h.agg(F.min("id"), F.max("id")).first())).select("id")


@query(
    """WITH n AS (SELECT * EXCLUDE (id), (SELECT max(id) FROM history) + row_number() OVER (ORDER BY processed_at, original_filename, file_hash, original_path, document_type, status, contractor_name, contractor_inn, document_date, document_number, total_amount, amount_with_vat, amount_without_vat,
      output_folder, output_files, error_message, confidence) AS id FROM (SELECT * REPLACE (coalesce(processed_at, TIMESTAMP '2000-01-01') + INTERVAL 1 DAY AS processed_at, coalesce(original_filename, '') AS original_filename, coalesce(file_hash, '') AS file_hash) FROM history WHERE status = 'error' AND original_filename IS NOT NULL AND file_hash IS NOT NULL AND processed_at IS NOT NULL))
    SELECT original_filename, file_hash, count(*) AS rows, min(id) > (SELECT max(id) FROM history) AS is_new FROM (SELECT * FROM (SELECT * FROM history UNION ALL BY NAME SELECT * FROM n) QUALIFY row_number() OVER (PARTITION BY original_filename, file_hash ORDER BY processed_at DESC NULLS LAST, id DESC) = 1) GROUP BY ALL"""
)
def history_new_ids(spark, d):
    h = table(spark, d, "history")
    again = h.where("status = 'error' and original_filename is not null and file_hash is not null and processed_at is not null").withColumn("processed_at", F.col("processed_at") + F.expr("INTERVAL 1 DAY"))
    top = h.agg(F.max("id").alias("top"))
    out = history.with_new_ids(h, again).crossJoin(F.broadcast(top))  # one row
    return out.groupBy("original_filename", "file_hash").agg(F.count("*").alias("rows"), (F.min("id") > F.max("top")).alias("is_new"))


_NOT = ", ".join(f"'{n}'" for n in history.NOT_A_NAME)
_ACCEPT = f"(lower(trim(%s, ' ')) NOT IN ({_NOT}) AND length(trim(%s, ' ')) >= 3 AND NOT (regexp_matches(lower(%s), '{history.PAYMENT}') AND length(trim(%s, ' ')) < 20))"


@query(
    f"""SELECT id, coalesce(CASE WHEN document_type = 'medical_report' AND {_ACCEPT.replace('%s', 'document_number')} THEN trim(document_number, ' ') END, CASE WHEN {_ACCEPT.replace('%s', 'contractor_name')} THEN trim(contractor_name, ' ') END, CASE WHEN {_ACCEPT.replace('%s', 'original_filename')} THEN trim(original_filename, ' ') END) AS contractor,
    CASE WHEN regexp_full_match(regexp_replace(trim(contractor_inn, ' '), '[ -]', '', 'g'), '[0-9]{{10}}|[0-9]{{12}}') THEN regexp_replace(trim(contractor_inn, ' '), '[ -]', '', 'g') END AS inn FROM history"""
)
def history_contractor(spark, d):
    h = table(spark, d, "history")
    fields = F.map_from_arrays(F.array(*[F.lit(x) for x in ("laboratory_name", "buyer", "party2", "buyer_inn")]), F.array("document_number", "contractor_name", "original_filename", "contractor_inn"))
    name, inn = history.contractor(fields, F.col("document_type"))
    return h.select("id", name.alias("contractor"), inn.alias("inn"))


@query(
    f"""WITH t AS (SELECT d.document_type, f.* FROM {_FIELDS} f JOIN documents d USING (doc_id) WHERE d.document_type IS NOT NULL),
    b AS (SELECT document_type, field_name, count(value) AS filled, count(*) AS total, min(doc_id) AS fs FROM t GROUP BY 1, 2), v AS (SELECT document_type, field_name, value, min(doc_id) AS k FROM t GROUP BY 1, 2, 3),
    e AS (SELECT document_type, field_name, string_agg(value, '; ' ORDER BY k, value) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY document_type, field_name ORDER BY k, value) AS r FROM v) WHERE r <= 3 GROUP BY 1, 2)
    SELECT document_type, field_name, filled, total, examples, row_number() OVER (PARTITION BY document_type ORDER BY CASE WHEN document_type = 'invoice' AND field_name = 'amount' THEN 0 WHEN document_type = 'invoice' AND field_name = 'date' THEN 1 ELSE 1000000 END, fs, field_name) AS rank FROM b LEFT JOIN e USING (document_type, field_name)"""
)
def field_groups(spark, d):
    each = extract.extract_each(table(spark, d, "documents").where("document_type is not null").select("doc_id", "text", "document_type"), "doc_id", "text", keep=("document_type",))
    fields = each.select("doc_id", "document_type", F.explode("found").alias("x")).select("doc_id", "document_type", "x.field_name", "x.value")
    return history.field_groups(fields, "doc_id", "document_type", preferred={"invoice": ["amount", "date"]})


@query(f"SELECT doc_id, coalesce(CASE WHEN c.doc_type <> 'unknown' THEN c.doc_type END, document_type, lang, 'unknown') AS doc_type FROM ({_CLASSIFIED}) c JOIN documents USING (doc_id)")
def document_types(spark, d):
    c = classify.rule_classify(table(spark, d, "documents"))
    return c.select("doc_id", history.type_of(F.nullif(F.col("doc_type"), F.lit("unknown")), F.col("document_type"), F.col("lang")).alias("doc_type"))


@query(
    """SELECT page_hash, text, lang, ts FROM (SELECT * FROM ocr_cache UNION ALL SELECT page_hash, text || '!', lang, ts + 1 FROM ocr_cache WHERE lang = 'en') QUALIFY row_number() OVER (PARTITION BY page_hash ORDER BY ts DESC NULLS LAST, text DESC NULLS LAST, lang DESC NULLS LAST) = 1"""
)
def ocr_cache_put(spark, d):
    c = table(spark, d, "ocr_cache")
    return history.cache_put(c, c.where("lang = 'en'").withColumns({"text": F.concat("text", F.lit("!")), "ts": F.col("ts") + 1}))


@query("SELECT page_hash, ts FROM ocr_cache WHERE ts IS NULL OR ts >= 1711929600 - 30 * 86400")
def ocr_cache_expired(spark, d):
    return history.cache_expired(table(spark, d, "ocr_cache"), 1711929600.0).select("page_hash", "ts")


@query("SELECT * FROM feedback UNION ALL SELECT document, original_type, 'act', ts FROM feedback WHERE document IS NOT NULL AND original_type = 'invoice'")
def feedback_append(spark, d):
    f = table(spark, d, "feedback")
    return history.feedback_saved(f, f.where("original_type = 'invoice'").withColumn("correct_type", F.lit("act")))


@query("SELECT mix_name, source, weight, max_repeats FROM mix_target WHERE mix_name NOT IN (SELECT min(mix_name) FROM mix_target) UNION ALL SELECT mix_name, source, 1.0, max_repeats FROM mix_target WHERE mix_name IN (SELECT min(mix_name) FROM mix_target)")
def mapping_save(spark, d):
    m = table(spark, d, "mix_target")
    first = m.agg(F.min("mix_name").alias("mix_name"))  # any keyed table of settings
    return history.mapping_saved(m, m.join(F.broadcast(first), "mix_name", "left_semi").withColumn("weight", F.lit(1.0)), "mix_name")


# --- readings of one page, and decisions on images ----------------------------------------------------


def _readings(spark, d):
    """Three readings of each page: as it is, with plain signs, and its first half."""
    pages = table(spark, d, "ocr_cache").groupBy("page_hash").agg(F.max_by("text", F.struct("ts", "text")).alias("text")).where("text is not null")
    t = F.col("text")
    half = F.substr(t, F.lit(1), (F.length(t) / 2).cast("int"))
    return pages.select("page_hash", F.inline(F.array(*[F.struct(x.alias("text"), F.lit(c).alias("conf")) for x, c in ((t, 0.55), (tx.clean_ocr_text(t), 0.5), (half, 0.4))])))


def _combine_sql() -> str:
    quality_of = _QUALITY.replace("page_hash, ts,", "page_hash, v, conf,").replace("FROM ocr_cache WHERE text IS NOT NULL", "FROM (SELECT * REPLACE (trim(text, ' ') AS text) FROM v)")
    return f"""WITH p AS (SELECT page_hash, text FROM ocr_cache QUALIFY row_number() OVER (PARTITION BY page_hash ORDER BY ts DESC NULLS LAST, text DESC NULLS LAST) = 1),
    v AS (SELECT page_hash, 1 AS v, 0.55::double AS conf, text FROM p WHERE text IS NOT NULL UNION ALL SELECT page_hash, 2, 0.5, replace(replace(translate(text, '“”«»–—', '\"\"\"\"--'), '  ', ' '), chr(9), ' ') FROM p WHERE text IS NOT NULL UNION ALL SELECT page_hash, 3, 0.4, substr(text, 1, (length(text) / 2)::int - CASE WHEN length(text) % 2 = 1 AND (length(text) / 2)::int > length(text) / 2 THEN 1 ELSE 0 END) FROM p WHERE text IS NOT NULL),
    q AS (SELECT page_hash, v, 0.6 * conf + 0.4 * quality AS score, conf FROM ({quality_of.replace("round(least(1.0, greatest(0.0, ", "(least(1.0, greatest(0.0, ").replace("0.15 * st)), 6) AS quality", "0.15 * st))) AS quality")})),
    t AS (SELECT v.page_hash, v.text, q.score, q.conf FROM v JOIN q USING (page_hash, v) WHERE trim(regexp_replace(v.text, '\\s+', ' ', 'g'), ' ') <> ''),
    l AS (SELECT page_hash, text, score, conf, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM t),
    n AS (SELECT *, trim(raw, ' ') AS line, trim(regexp_replace(lower({_collapse("trim(raw, ' ')")}), '^[.,;:!?]+|[.,;:!?]+$', '', 'g'), ' ') AS norm FROM l WHERE length(trim(raw, ' ')) >= 3),
    g AS (SELECT page_hash, norm, count(*) AS votes, avg(conf) AS c, round(avg(score), 9) AS s, min({{'a': -score, 'b': text, 'c': place}}) AS first, min_by(line, {{'a': -score, 'b': text, 'c': place}}) AS line FROM n GROUP BY 1, 2),
    j AS (SELECT page_hash, string_agg(line, chr(10) ORDER BY s DESC, first) AS voted FROM g WHERE votes >= 2 OR c > 0.6 OR s > 0.7 GROUP BY 1), w AS (SELECT page_hash, count(*) AS variants, max(text) AS single FROM t GROUP BY 1)
    SELECT page_hash, CASE WHEN variants = 1 THEN single ELSE coalesce(voted, '') END AS text, variants FROM w LEFT JOIN j USING (page_hash)"""


@query(_combine_sql())
def combine_readings(spark, d):
    return quality.combine(_readings(spark, d), "page_hash", "text", "conf")


@query()
def reading_similarity(spark, d):
    r = _readings(spark, d).groupBy("page_hash").agg(F.max_by("text", "conf").alias("a"), F.min_by("text", "conf").alias("b"))
    s = quality.similarity(r, "a", "b")
    return s.select("page_hash", F.round("similarity", 6).alias("similarity"), F.round(quality.quality_with(F.trim("a"), F.col("similarity")), 6).alias("quality"))


@query(
    """SELECT id, round((CASE WHEN id % 500 < 300 THEN 0.3 ELSE 0 END + CASE WHEN id % 170 < 100 THEN 0.25 ELSE 0 END + CASE WHEN id % 90 < 50 THEN 0.25 ELSE 0 END + CASE WHEN id % 33 > 20 THEN 0.2 ELSE 0 END)::double, 6) AS photo,
    CASE WHEN id % 100 < 35 THEN 'light' WHEN id % 100 < 70 THEN 'medium' ELSE 'heavy' END AS level FROM history"""
)
def image_decisions(spark, d):
    i = F.col("id")
    return table(spark, d, "history").select("id", F.round(quality.photo_score(i % 500, i % 170, i % 90, i % 33), 6).alias("photo"), quality.level(i % 100).alias("level"))


@query(
    """WITH p AS (SELECT file_hash, page_no AS step, page_hash, (page_no * 37 % 100) / 100.0::double AS q, (page_no * 53 % 100) / 100.0::double AS s FROM (SELECT DISTINCT file_hash, page_no, page_hash FROM scan_pages WHERE file_hash IS NOT NULL)),
    f AS (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY CASE WHEN q > 0.7 OR s > 0.75 THEN 0 ELSE 1 END, CASE WHEN q > 0.7 OR s > 0.75 THEN step ELSE 0 END, s DESC, step) AS r FROM p)
    SELECT file_hash, step, s < 0.5 AS retry FROM f WHERE r = 1"""
)
def best_reading(spark, d):
    p = table(spark, d, "scan_pages").where("file_hash is not null").select("file_hash", "page_no", "page_hash").distinct()
    passes = p.select("file_hash", F.col("page_no").alias("step"), F.col("page_hash").alias("text"), (F.col("page_no") * 37 % 100 / F.lit(100.0)).alias("quality"), (F.col("page_no") * 53 % 100 / F.lit(100.0)).alias("score"))
    return quality.best_pass(passes, "file_hash").select("file_hash", "step", "retry")


# --- sinks and streams ------------------------------------------------------------------------------


@query("SELECT document_type, count(*) AS n_rows FROM history WHERE document_type IS NOT NULL GROUP BY 1")
def export_workbooks(spark, d):
    h = table(spark, d, "history").where("document_type is not null").select("document_type", "original_filename", "contractor_name", "document_date", "total_amount")
    return files.workbooks(h, "document_type").groupBy("document_type").agg(F.sum("n_rows").alias("n_rows"))


@query("SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL")
def events_sliding(spark, d):
    return ingest.windowed(table(spark, d, "events"), "ts", "1 hour", "1 day", "event_type", slide="15 minutes")


@query(
    """WITH e AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE AS gap FROM events WHERE ts IS NOT NULL), s AS (SELECT *, sum(coalesce(gap::int, 0)) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM e)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, g"""
)
def events_sessions(spark, d):
    return ingest.sessions(table(spark, d, "events"), "ts", "30 minutes", "1 day", "user_id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_windowed(spark, d):
    return ingest.windowed(table(spark, d, "events"), "ts", "1 hour", "1 day", "event_type")


@query("SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY original_filename, file_hash ORDER BY processed_at DESC NULLS LAST, id DESC) = 1")
def stream_upsert(spark, d):
    import uuid

    prepare(spark)
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return ingest.upsert_stream(spark, f"{d}/history.parquet*", table(spark, d, "history").schema, f"{at}/table", f"{at}/progress")
