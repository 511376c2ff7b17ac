from docmill.llm import scan_noise as S


def test_rows_do_not_depend_on_the_size_of_the_corpus(spark):
    full = "Главный бухгалтер утвердил ведомость. Главный бухгалтер подписал приказ.\n" * 4
    texts = [full] * 30 + ["Главный бухгалтср проверил"] * 5 + ["Глааный бухгалтер. Приказ подпнсал", "Утвердил ведомость-\nглавный"]
    files = spark.createDataFrame([], "page_hash string, file_hash string, page_no int")

    def rows(times):
        df = spark.createDataFrame([(f"{i}/{k}", t) for i, t in enumerate(texts) for k in range(times)], "page_hash string, text string")
        return {(r.page_hash.split("/")[1], r.page_hash.split("/")[0], r.line_no, r.noise) for r in S.find(df, files).collect()}

    once, ten = rows(1), rows(10)
    assert {x[1:] for x in once} == {(str(i), 1, "misread") for i in range(30, 36)}
    assert ten == {(str(k), *x[1:]) for x in once for k in range(10)}


def test_running_text_repairs_lines_with_broken_words_and_numbers():
    reader = S.Reader(dict.fromkeys(("главный", "бухгалтер", "проверил", "ведомость", "склад", "за"), 500))
    assert S.reassemble("Главиый бухгал-\nтср провернл склад", set(), reader) == "Главный бухгалтер проверил склад"
    assert S.reassemble("Провернл ведо-\nмос-\nть. Провернл", set(), reader) == "Проверил ведомость. Проверил"
    assert S.reassemble("Склад 5О7 рублей, 3О дней, l22 листа, тел. 8О0-77-89", set(), reader) == "Склад 507 рублей, 30 дней, 122 листа, тел. 800-77-89"
    assert S.reassemble("На 15! Провернл\nbuh 1О@sklad.example", set(), reader) == "На 15! Проверил buh 1О@sklad.example"


def test_counts_given_many_times_over_change_no_row():
    counts = {"главный": 500, "глааный": 30, "бухгалтер": 900, "бухгалтср": 8, "склад": 300, "скпад": 40, "отчёт": 6}
    page = "Глааный бухгалтср проверил скпад\nи отчст, отчёт и бух-\nгалтср"
    rows = [S.line_noise(page, S.Reader({w: n * k for w, n in counts.items()}, 40_000 * k)) for k in (1, 10, 100, 10_000)]
    assert rows[0] and all(r == rows[0] for r in rows)


def test_edges_have_no_fixed_depth_and_long_words_are_let_be():
    top = ["ООО «Ромашка»", "Отдел учёта", "Архив", "Том второй", "Опись"]
    body = ["Агент принял товар,", "кассир утвердил ведомость."] * 4
    seen = edge = S.edge_lines(top + body)
    assert [n for side, n, _, form in seen if side == "t" and form == "plain"] == [1, 2, 3, 4, 5]
    model = S.Model()
    top = "".join(S._CODE[form] for side, *_, form in edge if side == "t")
    foot = "".join(S._CODE[form] for side, *_, form in edge if side == "f")
    marks = [n if form == "plain" else 0 for _, n, _, form in edge]
    assert {n for n, noise in S._edge_labels(13, top, foot, marks, [1, 2, 3, 4, 5], model) if noise == "header"} == {1, 2, 3, 4, 5}
    assert S.line_noise("1" + "а" * 100_000 + "-\nб", S.Reader({"аа": 5})) == []
    assert S.edge_lines([""]) == [("t", 1, "", "blank")] and S.Model().label([]) == ""


def test_paragraphs_follow_the_labels():
    lines = ["Накладная № 5 от 05.02.2024", "", "    Агент принял товар по накладной и отвёз его на склад", "покупателя в срок.", "    Кассир утвердил ведомость начисления заработной платы", "за месяц.", "1 Фильтры 222 87 шт. 351 344,68", "2 Арматура 402 8 шт. 1 862,53", "Итого:", "353 207,21", "", "Агент ушёл."]
    assert S.body_labels(lines, set(), S.Model()) == "TKPBPBXXPBKP"
    got = S.reassemble("\n".join(lines), {12}, S.Reader({}))
    assert got.split("\n\n") == ["Накладная № 5 от 05.02.2024", "Агент принял товар по накладной и отвёз его на склад покупателя в срок.", "Кассир утвердил ведомость начисления заработной платы за месяц.", *lines[6:8], "Итого: 353 207,21"]
