import datetime as dt

import pytest
from pyspark.sql import functions as F

from docmill.functions import text as tx
from docmill.functions import values as vl
from docmill.operators import classify, extract, history, quality, reconcile, tables
from docmill.sources import config, files
from docmill.streaming import ingest


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "f, text, want",
    [
        (tx.normalize, "Счёт  на оплату № 15 от «05.02.2024» (р/с)", "счет на оплату   15 от  05.02.2024  (р/с)"),
        (tx.normalize_for_classification, "Счёт  на оплату № 15 от «05.02.2024» (р/с)", "счет на оплату   15 от  05.02.2024  рс"),
        (tx.normalize_for_ocr, "«А» —\n б", '"А" - б'),
        (tx.normalize_line, "  Итого:  5. ", "итого: 5"),
        (tx.sanitize_filename, "/a/b: c?.pdf ", "b_ c_.pdf"),
        (tx.sanitize_filename, "...", "unnamed_file"),
        (tx.fix_dates, "от 05. 02 2024 г", "от 05.02.2024 г"),
        (vl.parse_float, "1 234,50", 1234.5),
        (vl.parse_float, "1.234.50", None),
        (vl.parse_float, "-", None),
        (vl.parse_date, "05.02.2024", "2024-02-05"),
        (vl.parse_date, "05 02 2024", "2024-02-05"),
        (vl.parse_date, "5 февраля 2024", "2024-02-05"),
        (vl.parse_date, "31.02.2024", None),
        (vl.parse_date, "5.2.2024", None),
        (vl.inn_valid, "7707083893", True),
        (vl.inn_valid, "1650364490", False),
        (vl.inn_valid, "500100732259", True),
        (vl.inn_valid, "123456789012", False),
        (vl.inn_valid, "12345678901", False),
        (vl.inn_valid, None, None),
    ],
)
def test_scalars(spark, f, text, want):
    assert one(spark, text, f) == want


def test_word_similarity(spark):
    df = spark.createDataFrame([("кат", "акт"), ("сврки", "сверки"), ("дебит", "дебет"), ("", "a")], "a string, b string")
    got = [round(r[0], 4) for r in df.select(tx.word_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.8333, 0.86, 0.0]


def test_checks(spark):
    df = spark.createDataFrame([(121.0, 100.0, 20.0, 0.8), (120.0, 100.0, 20.0, 0.8), (None, 100.0, 20.0, 0.8)], "w double, o double, v double, c double")
    got = [r.s.asDict() for r in df.select(vl.vat_check(F.col("w"), F.col("o"), F.col("v"), F.col("c")).alias("s")).collect()]
    assert got[0] == {"warning": "vat_mismatch", "auto_corrected": 120.0, "confidence": pytest.approx(0.6)}
    assert got[1]["warning"] is None and got[2]["warning"] is None
    assert df.select(vl.saldo_expected(F.lit(100), F.lit(50), F.lit(30), F.lit(125))).first()[0] == 120


def test_classification(spark):
    df = spark.createDataFrame([(1, "Акт сверки взаимных расчётов № 15"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: (r.doc_type, r.rule_score) for r in classify.rule_classify(df).collect()}
    assert got == {1: ("reconciliation_act", 9), 2: ("unknown", 0), 3: ("unknown", 0)}
    # rules are data: points for terms, ties and cues of the preferred type, and the ladder of confidences
    table = {"invoice": {"keywords": ["счет"]}, "reconciliation_act": {"keywords": ["акт"]}, "waybill": {"keywords": ["груз", "накладн"], "exclude": ["счет"]}}
    texts = ["акт сверки взаиморасчетов №123", "счет и акт", "счет, груз", "груз по накладной", "сальдо, счет"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.doc_type, r.rule_score, r.confidence) for r in classify.rule_classify(d, signatures=table).collect()}
    assert got == {0: ("reconciliation_act", 6, 1.0), 1: ("reconciliation_act", 1, 0.8), 2: ("invoice", 1, 0.8), 3: ("waybill", 2, 0.95), 4: ("reconciliation_act", 3, 1.0)}
    assert classify.rule_classify(d.limit(1).select("doc_id", F.lit("нет").alias("text")), signatures=table, compat=True).first().doc_type == "reconciliation_act"
    e = spark.createDataFrame([(1, "", "Счёт на оплату 5.pdf", "act", 0.9, "x"), (2, "договор поставки 5", "a.pdf", "act", 0.9, "x"), (3, None, None, None, None, "x")], "doc_id long, text string, name string, k string, c double, confidence string")
    e = e.drop("confidence")
    rules = {r.doc_id: (r.doc_type, r.explanation) for r in classify.classify(e, "text", "name", "rules_only").collect()}
    assert rules == {1: ("invoice", "filename_based"), 2: ("contract", "rules_only_mode"), 3: ("unknown", "rules_only_mode")}
    both = {r.doc_id: (r.doc_type, round(r.confidence, 4)) for r in classify.classify(e, "text", "name", vector=("k", "c")).collect()}
    assert both[2] == ("contract", 0.7) and both[3] == ("unknown", 0.0)
    plan = classify.rule_classify(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") <= 3  # the text is normalised once
    assert classify.stats(classify.rule_classify(df.limit(0))).count() == 0
    row = df.limit(1).select(*[c.alias(n) for n, c in zip("wc", classify.ensemble(F.lit(0.8), F.lit(0.4), F.lit(0.6)))]).first()
    assert row.w == "vector" and row.c == pytest.approx(0.72)


def test_quality(spark):
    text = "Акт сверки № 15 от 05.02.2024"
    assert one(spark, text, quality.length_score) == pytest.approx(0.058)
    assert one(spark, text, quality.word_score) == pytest.approx(0.1)
    df = spark.createDataFrame([("k", "Итого 5\nшум"), ("k", "итого 5.\nиное"), ("k", None)], "k string, t string")
    assert [(r.norm, r.votes) for r in quality.vote_lines(df, "k", "t", F.lit(0.5), F.lit(0.5)).collect()] == [("итого 5", 2)]
    lines = spark.sql("select array(named_struct('text', 'a', 'confidence', 0.3), named_struct('text', 'bb', 'confidence', 0.25)) l")
    assert [x.text for x in lines.select(quality.kept_ocr_lines(F.col("l"))).first()[0]] == ["bb"]


def test_extraction(spark):
    rows = [(1, "Счёт № 77 от 05.02.2024. ИНН 7707083893, на сумму 1 234,50 руб."), (2, "ИНН 123456789012"), (3, None)]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {(r.id, r.field_name): r.value for r in extract.extract(df, "id", "t").collect()}
    assert got == {(1, "document_number"): "77", (1, "date"): "2024-02-05", (1, "inn"): "7707083893", (1, "amount"): "1234.50"}
    fields = extract.extract(df, "id", "t")
    assert {r.field_name: r.coverage for r in extract.coverage(fields, 3, "id").collect()}["date"] == pytest.approx(1 / 3, abs=1e-5)
    m = spark.sql("select 1 id, map('inn', '5', 'date', cast(null as string)) fields, map('date', 'x', 'items', 'y') more, map('sum', '7') cols, 'f.pdf' name")
    assert extract.project_mapping(m, {"B2": "table_sum", "A1": "inn", "A2": "date", "B1": "items", "C1": "_filename", "C2": "none"}, "id", "fields", "more", "cols", "name").first()[1:] == ("5", "y", "f.pdf", None, "7", None)
    # the best match is the surest, the first of equally sure ones; values are parsed and checked
    two = spark.createDataFrame([(1, "р/с 11111111111111111111 и Account 22222222222222222222, ИНН 123456789012, ИНН 500100732259")], "id long, t string")
    assert {(r.field_name, r.value) for r in extract.extract(two, "id", "t").collect()} == {("account_number", "1" * 20), ("inn", "500100732259")}
    seen = lambda t: [("bic", "044525225", None, 0.85, "БИК"), ("amount", "5.00", 5.0, 0.4, "x")]
    got = {(r.field_name, r.value) for r in extract.extract(two, "id", "t", recognise=seen).collect()}
    assert ("bic", "044525225") in got and ("amount", "5.00") not in got
    assert extract.resolve([("a", "1", None, 0.9, "long source"), ("a", "2", None, 0.95, "short")])[1] == "1"
    assert [extract.parse_value(k, v)[0] for k, v in (("digits", "№ 12-3"), ("float", "1.234.50"), ("date", "5 февраля 2024"), ("date", "31.02.2024"), ("digits_9", "044 525 225"), ("text", "\xa0а\tб "))] == ["123", None, "2024-02-05", None, "044525225", "а б"]
    assert extract.extract(df.limit(0), "id", "t").count() == 0
    lifted = extract.fields_from_config({"payer_inn": {"pattern": "r'(\\d+)'", "validate": "digits"}, "x_inn": {"pattern": "y"}, "odd": {"regex": "z"}})
    assert lifted[0].patterns[0].pattern == "(\\d+)" and lifted[0].patterns[0].priority == 5 and [f.checked_inn for f in lifted] == [True, False]
    assert extract.summary(classify.rule_classify(df.select(F.col("id"), F.col("t").alias("text"))), fields, "id").first().documents == 3
    empty = extract.summary(classify.rule_classify(df.limit(0).select(F.col("id"), F.col("t").alias("text"))), fields.limit(0), "id").first()
    assert (empty.documents, empty.score, empty.recommendations) == (0, 0.0, [])


def test_table_function(spark):
    extract.register_regex_matches(spark)
    got = spark.sql(r"SELECT t.* FROM VALUES ('ИНН 12, ИНН 34'), (NULL) AS v(x), LATERAL regex_matches(x, 'ИНН ([0-9]+)') t").collect()
    assert sorted((r.pos, r.group1) for r in got) == [(1, "12"), (9, "34")]


def test_tables(spark):
    from docmill.operators import parse

    df = spark.createDataFrame([(1, [["ИНН", "Сумма", None], ["7707083893", "10,5", None], [None, None, None], [None, "5", None]]), (2, [["h1", "h2"], ["a", "b"]]), (3, [["Сумма", "Сумма"], ["", "3"]]), (4, [])], "id long, rows array<array<string>>")
    tall = tables.cells(df, "id", "rows")
    assert {r.header for r in tall.where("id = 1").collect()} == {"инн", "сумма"}
    assert {r.header for r in tall.where("id = 2").collect()} == {"col0", "col1"}
    assert {r.header for r in tall.where("id = 3").collect()} == {"сумма", "сумма_1"}
    assert {(r.id, r.field_name, r.value) for r in parse.fields_of_tables(tall, "id").collect()} == {(1, "supplier_inn", "7707083893"), (1, "amount", "5.00"), (3, "amount", "3.00")}
    assert tables.numeric_columns(tall, "id").where("id = 1 and numeric").count() == 2
    ops = spark.createDataFrame([(1, [["вид", "было", "стало"], ["сальдо", "100", "300"], ["дебет", "200", "400"]]), (2, [["вид", "было", "стало"], ["иное", "1", "2"]])], "id long, rows array<array<string>>")
    got = tables.operations(tables.cells(ops, "id", "rows"), "id").orderBy("row_no").collect()
    assert [[v.number for v in r["values"]] for r in got] == [[100.0, 300.0], [200.0, 400.0]]
    assert tables.cells(df.limit(0), "id", "rows").count() == 0
    assert extract.first_values(tall, "id").where("id = 3").first().columns == {"сумма_1": "3"}


def test_parse_documents(spark):
    from docmill.operators import parse

    text = "СЧЕТ НА ОПЛАТУ N __10 от 05.02.2034\nПоставщик: Ромашка ИНН 7707083893\nПокупатель: Василёк ИНН 123456789012\nБИК 044525225, НДС: 20,00 руб., на сумму 120,00"
    other = "Договор № 5 от 05.02.2024. ООО «Ромашка» и АО «Василёк», ИНН 7707083893"
    rows = [(1, text, "invoice", 0), (2, other, "contract", 0), (3, other, "receipt", 0), (4, None, "act", 0), (5, other, None, 0), (6, "СЧЕТ № 7 от 1.2.2024, ООО «Ромашка» ИНН 7707083893, ООО «Василёк»", "invoice", 0)]
    df = spark.createDataFrame(rows, "id long, t string, kind string, confidence int")
    tf = spark.createDataFrame([(1, "amount", "7.00", 0.9), (1, "total_with_vat", "150.00", 0.9), (1, "total_without_vat", "100.00", 0.9), (4, "kpp", "770701001", 0.8)], "id long, field_name string, value string, confidence double")
    got = {(r.id, r.field_name): r for r in parse.parse_documents(df, "id", "t", "kind", tf, F.lit("2024-06-30").cast("date")).collect()}
    assert {n: got[1, n].value for n in ("document_number", "supplier", "buyer", "supplier_inn", "buyer_inn", "bic", "vat", "amount")} == {"document_number": "10", "supplier": "Ромашка", "buyer": "Василёк", "supplier_inn": "7707083893", "buyer_inn": "123456789012", "bic": "044525225", "vat": "20.00", "amount": "120.00"}
    assert got[1, "buyer_inn"].warning == "unsound_inn" and got[1, "buyer_inn"].confidence == pytest.approx(0.6) and got[1, "supplier_inn"].warning is None
    assert got[1, "date"].warning == "future" and got[1, "total_with_vat"].warning == "vat_mismatch" and got[1, "total_with_vat"].auto_corrected == 120.0
    assert got[2, "organization_1"].value == "Ромашка" and (3, "organization_1") not in got and got[5, "organization_2"].value == "Василёк"
    assert got[4, "kpp"].value == "770701001" and {i for i, _ in got} == {1, 2, 3, 4, 5, 6}
    assert (got[6, "supplier"].value, got[6, "buyer"].value, got[6, "supplier_inn"].value, got[6, "date"].value) == ("Ромашка", "Василёк", "7707083893", "1.2.2024")
    assert parse.parse_documents(df.limit(0), "id", "t", "kind").count() == 0


def test_reconciliation(spark):
    text = "Акт сверки № АС-4711 от 5.2.2024\nмежду ООО «Ромашка» ИНН 7707083893 и АО «Василёк и сын» ИНН 500100732259\nПо данным АО «Василёк и сын» на конец\nКонечное сальдо: 1 234,50\n5000"
    df = spark.createDataFrame([(1, text), (2, None), (3, "Акт\nвсего 12 345,6")], "id long, t string")
    acts = reconcile.parse_act(df, "id", "t", "Ромашка", "7707083893")
    r = acts.orderBy("id").collect()
    assert tuple(r[0])[1:] == ("4711", "05.02.2024", "Василёк и сын", "500100732259", 1234.5, False, 1.0)
    assert (r[1].confidence, r[1].final_balance, r[1].we_owe) == (0, 0, True) and r[2].final_balance == 12345.6
    card = reconcile.card(acts).orderBy("id").collect()
    assert card[0].formatted_text.split("\n") == ["Акт сверки № 4711 от 05.02.2024", "Контрагент: Василёк и сын", "ИНН: 500100732259", "По данным Василёк и сын (контрагент)", "Остаток: 1 234,50 руб.", "Вам должны 1 234,50 руб."]
    assert card[1].formatted_text == "Акт сверки"
    assert {r.field_name for r in reconcile.act_fields(acts, "id").where("id = 3").collect()} == {"final_balance"}


H = "id long, original_filename string, file_hash string, document_number string, document_date string, contractor_inn string, contractor_name string, document_type string, status string, total_amount double, confidence double, processed_at timestamp, error_message string, output_files string"


def rows(spark, items):
    base = {c.split()[0]: None for c in H.split(", ")}
    return spark.createDataFrame([tuple((base | x).values()) for x in items], H)


def test_history(spark):
    t = dt.datetime(2024, 1, 1)
    df = rows(
        spark,
        [
            {"id": 1, "original_filename": "a", "file_hash": "x", "processed_at": t, "document_type": "act", "output_files": '{"json": "p"}'},
            {"id": 2, "original_filename": "a", "file_hash": "x", "processed_at": t, "document_type": "act", "output_files": "{broken"},
            {"id": 3, "original_filename": "b", "document_number": "1", "document_date": "d", "contractor_inn": "i", "processed_at": t - dt.timedelta(days=100)},
            {"id": 4, "original_filename": None, "document_number": "1", "document_date": "d", "contractor_inn": "i"},
            {"id": 5, "original_filename": "Счёт", "contractor_name": "н/д", "file_hash": ""},
        ],
    )
    assert sorted(r.id for r in history.upsert(df).collect()) == [2, 3, 4, 5]
    assert {r.id: (r.class_id, r.copies) for r in history.duplicates(df).collect()} == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (3, 1)}
    assert [r.id for r in history.page(df, 1, 2).collect()] == [1, 2]
    assert [r.id for r in history.search(df, text="счёт").collect()] == [5]
    assert {r.id for r in history.retained(df, "2024-01-02", 30).collect()} == {1, 2, 4, 5}
    assert {r.id: r.files for r in history.output_files(df).collect()}[1] == 1 and {r.id: r.files for r in history.output_files(df).collect()}[2] == 0
    assert df.where(history.acceptable_name(F.col("contractor_name"))).count() == 0
    empty = df.limit(0)
    assert history.statistics(empty, "2024-01-01").first().total == 0 and history.duplicates(empty).count() == 0 and history.upsert(empty).count() == 0


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.PDF").write_bytes("Акт".encode())
    (tmp_path / "in" / "b.pdf").write_bytes(b"\xff")
    (tmp_path / "in" / "c.txt").write_bytes(b"no")
    read = files.read_texts(files.folder(spark, str(tmp_path / "in")), lambda raw, kind: raw.decode("utf-8"))
    got = {r.filename: (r.full_text, r.error is None) for r in read.collect()}
    assert got == {"a.PDF": ("Акт", True), "b.pdf": (None, False)}
    df = spark.createDataFrame([("x", "Ж<&", 1.5), ("x", None, 2.0), ("y", "b", None)], "g string, a string, n double")
    assert {r.g: r.n_rows for r in files.workbooks(df, "g").collect()} == {"x": 2, "y": 1}
    files.write_json(df, str(tmp_path / "j"))
    files.write_csv(df, str(tmp_path / "c"), "g")
    assert spark.read.json(str(tmp_path / "j")).count() == 3 and spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"document_signatures": {"a": {"keywords": ["k"], "patterns": ["r\'x\'"]}}}')
    c = config.load(str(tmp_path / "c.json"))
    assert config.signatures(c)["a"] == {"keywords": ["k"], "patterns": ["x"], "exclude": []}
    assert config.signatures(c, compat=True)["a"]["patterns"] == ["r'x'"]
    assert config.signatures(config.load(None)) == classify.SIGNATURES and extract.fields_from_config(config.load(None)["field_patterns"]) == extract.FIELDS


def test_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    old = rows(spark, [{"id": i, "original_filename": f"f{i % 3}", "file_hash": "h", "processed_at": t + dt.timedelta(days=i)} for i in range(6)])
    old.repartition(3).write.parquet(str(tmp_path / "in"))
    out = ingest.upsert_stream(spark, str(tmp_path / "in"), old.schema, str(tmp_path / "t"), str(tmp_path / "p"))
    assert sorted(r.id for r in out.collect()) == [3, 4, 5]
    assert ingest.first_of_each(old, ["file_hash"], "processed_at", "1 day").count() == 1


def test_entry_works_without_the_optional_package(spark, monkeypatch):
    import __spark_entry__ as e

    assert any(n.startswith("p") and n[1].isdigit() for n in e.queries()) or e._llm() is None
    monkeypatch.setattr(e, "_llm", lambda: None)
    q = e.queries()
    assert q and set(e.oracle_sql()) <= set(q) and not any(n[1].isdigit() for n in q)


def test_correction(spark):
    from docmill.operators import correct

    df = spark.createDataFrame([(1, "Aкт сверkи N 15 от 05 02 2024\nсальдо 1O5 .", "act"), (2, None, "act"), (3, "", "act"), (4, "CЧET «Ромашка» — 12,50 ы и", "invoice"), (5, "с а ндс", None)], "id long, t string, k string")
    got = {r.id: r.t for r in correct.correct(df, "t", "k").collect()}
    assert got == {1: "Акт сверки № 15 от 05.02.2024\nсальдо 105.", 2: None, 3: "", 4: 'счет "Ромашка" - 12.50 и', 5: "с ндс"}
    assert correct.Corrector(correct.Rules(garbage=(), by_type={"x": (("а", "б"),)}))("а б", "x") == "б б"
    assert correct.likeness("сврки", "сверки") == pytest.approx(0.8333, abs=1e-4)
    ranked = correct.preferred_order(spark.createDataFrame([("act", "b"), ("act", "a")], "k string, n string"), "k", "n", {"act": ["a"]})
    assert {r.n: r["rank"] for r in ranked.collect()} == {"a": 0, "b": 1_000_000}
    cells = [("1234", "x", None), ("БИК", None, None), ("цена", "x", None), ("цена", None, True), ("цена", None, None), ("я" * 51, "x", None), ("КБ «Банк» г. Москва", "x", None), ("", "x", None)]
    heads = spark.createDataFrame(cells, "c string, v string, u boolean").select(correct.header_like(F.col("c"), F.col("v"), F.col("u")).alias("h")).collect()
    assert [r.h for r in heads] == [False, True, True, True, False, False, False, False]
    lines = spark.sql("select array(named_struct('text', 'a', 'confidence', 0.3D), named_struct('text', 'b', 'confidence', 0.05D), named_struct('text', 'c', 'confidence', 0.5D)) l")
    assert tuple(lines.select(*correct.keep_by_confidence(F.col("l"))).first()) == ("a\nc", 0.4)


def test_combining_readings(spark):
    from difflib import SequenceMatcher

    good = "Главный бухгалтер подписал акт сверки.\nИтого 5 рублей"
    rows = [("a", good, 0.9), ("a", "Главный бухгалтер подписал акт сверки\nшум", 0.2), ("a", " ", 0.9), ("a", None, 0.9), ("b", "один\nдва", 0.1), ("c", "", 0.5)]
    df = spark.createDataFrame(rows, "k string, t string, c double")
    got = {r.k: (r.text, r.variants) for r in quality.combine(df, "k", "t", "c").collect()}
    assert got == {"a": ("Итого 5 рублей\nГлавный бухгалтер подписал акт сверки.", 2), "b": ("один\nдва", 1)}
    pair = spark.createDataFrame([("Акт, сверки", "акт  сверкн", "x"), (None, "а", "x")], "a string, b string, similarity string").drop("similarity")
    s = [r.similarity for r in quality.similarity(pair, "a", "b").collect()]
    assert s == [pytest.approx(SequenceMatcher(None, "акт сверки", "акт сверкн").ratio()), 0.0]
    passes = spark.createDataFrame([("a", 1, "x", 0.5, 0.6), ("a", 2, "y", 0.8, 0.7), ("a", 3, "z", 0.9, 0.9), ("b", 1, "x", 0.1, 0.3), ("b", 2, "y", 0.1, 0.4)], "k string, step int, text string, quality double, score double")
    assert {r.k: (r.step, r.retry) for r in quality.best_pass(passes, "k").collect()} == {"a": (2, False), "b": (2, True)}


def test_model_is_saved_and_asked(spark, tmp_path):
    rows = [(i, "счет на оплату товара" if i % 2 else "акт сверки расчетов", "invoice" if i % 2 else "act") for i in range(24)]
    df = spark.createDataFrame(rows, "id long, t string, k string")
    model, asked = classify.active_learning(df, "id", "t", "k", seed=6, queries=2)
    assert len(asked) == len(set(asked)) == 2
    classify.save_model(model, str(tmp_path / "m"))
    got = classify.predict(classify.load_model(str(tmp_path / "m")), df, "id")
    assert {r.id: r.doc_type for r in got.collect()} == {i: k for i, _, k in rows}
    assert classify.predict(None, df, "id").first().doc_type == "unknown"
    fixed = classify.taught(df, spark.createDataFrame([(1, "act"), (2, "odd"), (99, "act")], "id long, k string"), "id", "k", ["act", "invoice"])
    assert {r.id: r.k for r in fixed.where("id in (1, 2, 99)").collect()} == {1: "act", 2: "act", 99: "act"}
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "id long, v array<double>")
    refs = spark.createDataFrame([("a", [1.0, 0.1]), ("b", [0.0, 1.0])], "kind string, v array<double>")
    assert {r.id: r.label for r in classify.by_references(vectors, refs, "id", "v").collect()} == {1: "a", 2: "a"}


def test_folders_results_and_workbooks(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.pdf").write_bytes(b"x")
    (tmp_path / "results.json").write_text('{"a": 1}')
    assert [r.files for r in files.counts(spark, str(tmp_path), str(tmp_path / "none")).collect()] == [3, 0]
    assert files.results(spark, str(tmp_path)).first().a == 1 and files.results(spark, str(tmp_path / "none")) is None
    pages = files.read_pages(files.folder(spark, str(tmp_path)), lambda raw, kind: [{"text": "Акт", "tables": [[["a", "b"], ["1", '2,"x']], []]}, {"text": None}])
    row = pages.orderBy("filename").first()
    assert row.full_text == "Акт\n\n" and row.error is None
    cells = tables.cells(files.page_tables(pages, "filename"), "filename", "rows", "table_no")
    assert files.first_table_csv(cells, "filename").orderBy("filename").first().content == '\ufeffa,b\n1,"2,""x"\n'
    (tmp_path / "done").mkdir()
    copied = files.copy_files(files.folder(spark, str(tmp_path)), str(tmp_path / "done")).collect()
    assert len(copied) == 3 and (tmp_path / "done" / "0.pdf").read_bytes() == b"x"
    book = files.appended(files.workbook(["имя", "n"], [("а", 1.0), (None, 2.0)], "Лист"), [("б", None), ("в", 4.0)])
    assert files.appended(book, []) == book and book != files.workbook(["имя", "n"], [], "Лист")
    df = spark.createDataFrame([("x", "a", 1, None), ("x", "b", 2, "bad"), ("y", "c", 3, None)], "g string, name string, n int, error string")
    got = files.mapped_workbooks(df, "g", {"x": {"B1": "n", "A1": "name"}}, "error").collect()
    assert [(r.g, r.n_rows) for r in got] == [("x", 1)]
    assert {r.name for r in files.to_copy(spark.sql("select * from values ('a', array(1), cast(null as string)), ('b', array(1), 'bad'), ('c', cast(array() as array<int>), null) t(name, fields, error)")).collect()} == {"a"}


def test_images_are_measured_and_pages_read_once(spark, tmp_path):
    import numpy as np

    (tmp_path / "a.png").write_bytes(bytes(range(256)) * 4)
    (tmp_path / "b.png").write_bytes(b"bad")
    got = files.measure_images(files.folder(spark, str(tmp_path)), lambda raw: np.frombuffer(raw, np.uint8).reshape(32, 32)).orderBy("filename").collect()
    assert (got[0].height, got[0].channels, got[0].source, got[0].error) == (32, 1, "image", None) and got[0].contrast > 0 and got[1].error.startswith("ValueError")
    pages = spark.createDataFrame([("p", b"x"), ("q", b"y"), ("q", b"y"), ("r", None)], "page_hash string, content binary")
    cache = spark.createDataFrame([("p", "old", "ru", 1.0)], "page_hash string, text string, lang string, ts double")
    texts, new = files.recognise_cached(pages, cache, lambda raw: [("строка", 0.9), ("ш", 0.3), ("шум", 0.1)], 5.0)
    assert {(r.page_hash, r.text, r.hit) for r in texts.collect()} == {("p", "old", True), ("q", "строка", False), ("r", "", False)}
    assert history.cache_put(cache, new).count() == 3
    stream = files.folder(spark, str(tmp_path), streaming=True)
    seen = []
    ingest.drain(stream, str(tmp_path / "progress"), lambda batch, n: seen.extend(r.filename for r in batch.select("filename").collect()))
    ingest.drain(files.folder(spark, str(tmp_path), streaming=True), str(tmp_path / "progress"), lambda batch, n: seen.extend(r.filename for r in batch.select("filename").collect()))
    assert sorted(seen) == ["a.png", "b.png"]  # each file once


def test_paths_and_retries(tmp_path):
    from docmill.runtime import logger, retried

    (tmp_path / "a.pdf").write_bytes(b"")
    assert tx.path_within(str(tmp_path / "a.pdf"), str(tmp_path), (".pdf",)) and not tx.path_within(str(tmp_path / ".." / "b.pdf"), str(tmp_path)) and not tx.path_within(str(tmp_path / "a.pdf"), str(tmp_path), (".png",))
    assert tx.is_folder(str(tmp_path)) and not tx.is_folder("") and not tx.is_folder(str(tmp_path / "a.pdf"))
    calls, failed = [], []

    def odd(x):
        calls.append(x)
        if len(calls) < 3:
            raise ValueError(x)
        return x

    assert retried(odd)(5) == 5 and len(calls) == 3
    with pytest.raises(ZeroDivisionError):
        retried(lambda: 1 / 0, 2, on_failure=failed.append)()
    assert len(failed) == 1
    assert logger("t", path=str(tmp_path / "log")) is logger("t", path=str(tmp_path / "log")) and len(logger("t", path=str(tmp_path / "log")).handlers) == 2


def test_cut_tables_are_released(spark):
    from docmill.runtime import cut, once, release, shared_folder

    t = cut(spark.range(5))
    kept = cut(t.where("id > 2"))
    p = spark._jvm.org.apache.hadoop.fs.Path(t._cut_path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(p) and t._cut_path.startswith(shared_folder(spark))
    release(t, spark.range(1))
    assert not fs.exists(p) and kept.count() == 2
    # a column that is used many times is computed once
    d = once(spark.createDataFrame([("а",), (None,)], "t string"), u=F.regexp_replace("t", "а", "б"))
    d = d.select("t", *[F.concat("u", F.lit(str(i))).alias(f"c{i}") for i in range(5)])
    assert d._jdf.queryExecution().executedPlan().toString().count("regexp_replace") == 1 and [r.c4 for r in d.collect()] == ["б4", None]


def test_history_changes(spark):
    t = dt.datetime(2024, 1, 1)
    old = rows(spark, [{"id": 5, "original_filename": "a", "file_hash": "x", "processed_at": t}, {"id": 9, "original_filename": "b", "file_hash": "y", "processed_at": t}])
    new = rows(spark, [{"id": None, "original_filename": "a", "file_hash": "x", "processed_at": t + dt.timedelta(days=1)}, {"id": None, "original_filename": "c", "file_hash": "z", "processed_at": t}])
    assert sorted((r.original_filename, r.id) for r in history.with_new_ids(old, new).collect()) == [("a", 11), ("b", 9), ("c", 10)]
    assert history.get(old, 5).count() == 1 and [r.id for r in history.delete(old, [5]).collect()] == [9]
    assert tuple(history.page_count(old, 1).first()) == (2, 2) and history.export(old.withColumns({"amount_with_vat": F.lit(1.0), "amount_without_vat": F.lit(1.0)}), most=1).count() == 1
    cache = spark.createDataFrame([("p", "old", 1.0)], "page_hash string, text string, ts double")
    more = spark.createDataFrame([("p", "new", "ru", 2.0), ("q", "x", "ru", None)], "page_hash string, text string, lang string, ts double")
    put = history.cache_put(cache, more)
    assert {(r.page_hash, r.text, r.lang) for r in put.collect()} == {("p", "new", "ru"), ("q", "x", "ru")}  # a cache of older columns
    assert {r.page_hash for r in history.cache_expired(put, 3e6, 30).collect()} == {"q"}
    fields = spark.sql("select map('supplier', 'оплата картой', 'buyer', ' Ромашка ', 'buyer_inn', '770-708 3893', 'laboratory_name', 'Анализ') f")
    name, inn = history.contractor(F.col("f"), F.lit("invoice"))
    lab, _ = history.contractor(F.col("f"), F.lit("medical_report"))
    assert tuple(fields.select(name, inn, lab).first()) == ("Ромашка", "7707083893", "Анализ")
    groups = spark.createDataFrame([(1, "act", "b", "x"), (2, "act", "b", "y"), (2, "act", "a", None), (3, "act", "_m", "z")], "id long, k string, field_name string, value string")
    assert {(r.field_name, r.filled, r.total, r.examples, r["rank"]) for r in history.field_groups(groups, "id", "k", preferred={"act": ["a"]}).collect()} == {("b", 2, 2, "x; y", 2), ("a", 0, 1, None, 1)}


def test_images():
    import numpy as np

    from docmill.functions import images

    flat = np.full((32, 32), 128, np.uint8)
    busy = np.tile(np.array([[0, 255], [255, 0]], np.uint8), (16, 16))
    assert images.blur(flat) == 0 < images.blur(busy) and images.contrast(flat) == 0 and images.noise(flat) == 0
    assert images.needs_preprocessing(flat) and not images.needs_preprocessing(busy)
    assert set(np.unique(images.preprocess(np.arange(1024, dtype=np.int64).reshape(32, 32).astype(np.uint8), "heavy"))) <= {0, 255}
    page = np.full((120, 160), 255, np.uint8)
    page[20:100:10, 20:140] = 0
    assert images.skew(page) == 0.0 and images.deskew(page) is page
    y, x = np.mgrid[:120, :160]
    leaning = np.where(((y - (x - 80) * np.tan(np.radians(4))).round() % 10 < 2) & (x > 20) & (x < 140), 0, 255).astype(np.uint8)
    assert abs(abs(images.skew(leaning)) - 4) <= 1 and abs(images.skew(images.deskew(leaning))) <= 1
    colour = np.stack([page] * 3, axis=-1)
    colour[40:60, 40:60] = (30, 60, 200)
    mask = images.seal_mask(colour)
    assert mask[50, 50] and not mask[5, 5] and not images.seal_mask(images.remove_seals(colour)).any()
    assert images.seal_mask(np.zeros((4, 4, 3), np.uint8)).sum() == 0
    for name in images.LEVELS:
        out = images.preprocess(page, name)
        assert out.dtype == np.uint8 and out.ndim == 2
    assert set(images.variants(page)) == {"standard", "aggressive", "otsu", "morphology", "scaled"} and images.scale(page, 2).shape == (240, 320)
    assert all(0 <= v <= 1 for v in images.degradation(page).values()) and images.universal(page).shape == page.shape
    assert images.level_score(np.zeros((20, 20), np.uint8)) == 100.0 and 0 <= images.level_score(page, "я" * 500) <= 100
    assert images.is_photo(np.random.default_rng(0).integers(100, 130, (40, 40, 3)).astype(np.uint8), 10) and not images.is_photo(np.stack([busy] * 3, axis=-1), 1000)
    assert images.from_samples(bytes(range(12)), 2, 2, 3)[0, 0].tolist() == [2, 1, 0] and images.rgb_to_grey(colour).shape == page.shape
