from docmill.llm import personal as P
from docmill.llm import scan_noise as S


def items(text):
    return {(k, text[a - 1 : z]) for k, a, z, s, _ in P.instances(text) if s >= P.ACCEPT}


def test_instances():
    assert ("email", "buh-zalitnev @ sklad.example") in items("на buh-zalitnev @ sklad.example.")
    assert ("phone", "+7 (280) 5О7-27-67") in items("тел. +7 (280) 5О7-27-67.")
    assert ("identity", "95 57 № 547608") in items("паспорт 95 57 № 547608 предъявлены")
    assert ("identity", "438-686-362 14") in items("СНИЛС 438-686-362 14")
    assert ("address", "961801, г. Верхнеозёрск,\nул. Заводская, д. 80") in items("жительства: 961801, г. Верхнеозёрск,\nул. Заводская, д. 80")
    assert ("name", "Полужкова Софья Фёдоровна") in items("Водитель Полужкова Софья Фёдоровна, удостоверение")
    for decoy in ("Цена 45 руб. @ шт., партия № 8-276-48027.", "Страница @galastov\nне является", "item 426-346-68-32", "со склада в Зареченске", "р/с 25322151378047601338"):
        assert items(decoy) == set()
    assert P.instances(None) == [] and P.instances("") == []
    # positions are those of the raw text
    text = "о​т Мо​хова Елена Глебовна"
    (kind, a, z, *_), = P.instances(text)
    assert kind == "name" and text[a - 1] == "М"


def test_patterns_vouch_for_unproved_instances(spark):
    proved = ["Полужкова Софья Фёдоровна", "Карапкин Лев Егорович", "Шибажков Глеб Олегович", "Тихова Анна Павловна", "Мохов Иван Ильич", "Ракова Инна Львовна"]
    pages = [(f"p{i}", f"Рейс выполнил. Водитель {n}, удостоверение есть.", 0) for i, n in enumerate(proved * 3)]
    pages += [("q", "Рейс выполнил. Водитель Д. П. Лопудумов, удостоверение есть.", 0), ("r", "Форма № 5 Агросветкров Лист", 0), ("e", "", 0), ("n", None, 0), ("q", "Рейс выполнил. Водитель Д. П. Лопудумов, удостоверение есть.", 1)]
    df = spark.createDataFrame(pages, "page_hash string, text string, kind int")
    got = [(r.page_hash, r.kind, r.start_pos) for r in P.find(df).collect()]
    assert ("q", "name", 25) in got and len(got) == len(set(got)) and not any(k == "r" for k, *_ in got)
    red = {r.page_hash: r.text for r in P.redact(df).collect()}
    assert red["q"] == "Рейс выполнил. Водитель [NAME], удостоверение есть." and red["n"] is None and red["e"] == ""
    assert P.find(df.limit(0)).count() == 0


def test_patterns_find_what_no_form_foresaw(spark):
    texts = [f"Отгрузка прошла. Звонить по номеру +7 (280) 507-27-{i:02d} до обеда, водитель Полужков Лев Егорович." for i in range(30)]
    texts += ["Отгрузка прошла. Звонить по номеру 280 507 31 19 до обеда, водитель Ингмар Свен."]
    texts += [f"Деталь по чертежу 280 507 31 {i} и склад Нижний Парк." for i in range(10, 40)]
    texts += [f"Код {a}{b} (280) 507-31-19 в таблице." for a in "абв" for b in "гд"]  # seeds in company that nothing is known of
    df = spark.createDataFrame([(f"{i:03d}", t, 1.0, True) for i, t in enumerate(texts)], "page_hash string, text string, score double, wide boolean")
    got = {(r.page_hash, r.kind, texts[int(r.page_hash)][r.start_pos - 1 : r.end_pos]) for r in P.find(df).collect()}
    assert {("030", "phone", "280 507 31 19"), ("030", "name", "Ингмар Свен")} <= got
    assert {k for k, *_ in got if k > "030"} == {f"{i:03d}" for i in range(61, 67)}


def test_instances_have_no_fixed_reach():
    far = "Водитель " + "- " * 60 + "Полужков Лев Егорович"
    assert any("name<водитель" in p for *_, pats in P.instances(far) for p in pats)
    many = "Присутствовали Мохов Иван Ильич, Раков Пётр Львович, Тихов Олег Глебович, Карапкин Лев Егорович"
    assert len([1 for k, *_ in P.instances(many) if k == "name"]) == 4


def body(i):
    return f"Агент принял товар по накладной № {i}5 в присутствии представителя\nсклада. Кассир утвердил ведомость начисления заработной платы за\nмесяц и подписал акт сверки взаимных расчётов.\nГлавный бух-\nгалтер проверил расчётно-\nкассовый ордер.\n"


def test_scan_noise(spark):
    full = "Главный бухгалтер утвердил ведомость. Расчётно-кассовый ордер подписал главный бухгалтер.\n" * 3
    pages = [(f"w{i}", full, 0) for i in range(30)]
    for i in range(8):
        pages.append((f"p{i}", ("ФОРМА 13 ЛИСТ УЧЁТА РОМАШКА" if i != 3 else "Форма 13 лист учёта Ром4шка") + f"\n- {i} -\n{body(i)}", 0))
    pages += [("m", "Накладная № 5 от 05.02.2024\nГлавный бухгалтср проверил 1О7 рублей", 0), ("e", "", 0), ("n", None, 0), ("m", "Накладная № 5 от 05.02.2024\nГлавный бухгалтср проверил 1О7 рублей", 1)]
    df = spark.createDataFrame(pages, "page_hash string, text string, noise int")
    files = spark.createDataFrame([(f"p{i}", "f", i) for i in range(8)] + [("p0", "f", 0), ("m", None, 1), (None, "f", 2)], "page_hash string, file_hash string, page_no int")
    got = [(r.page_hash, r.line_no, r.noise) for r in S.find(df, files).collect()]
    assert len(got) == len(set(got))
    for i in range(8):
        assert {(n, z) for k, n, z in got if k == f"p{i}" and z != "misread"} == {(1, "header"), (2, "page_number"), (6, "hyphen")}
    assert {(n, z) for k, n, z in got if k == "m"} == {(2, "misread")}
    assert not any(k in ("e", "n") or k.startswith("w") for k, *_ in got)
    text = {r.page_hash: r.text for r in S.running_text(df, files).collect()}
    assert "Главный бухгалтер проверил расчётно-кассовый" in text["p1"].replace("расчётно- ", "расчётно-") and "ФОРМА" not in text["p1"]
    assert text["n"] is None and text["e"] == ""
    assert S.find(df.limit(0), files).count() == 0 and S.find(df, files.limit(0)).where("noise = 'header'").count() == 0
