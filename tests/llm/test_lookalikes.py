import pytest

from docmill.llm import lookalikes as L


@pytest.mark.parametrize(
    "text, want",
    [
        ("прoдлил", "продлил"),
        ("ｓｔｅｅｌ ６４", "steel 64"),
        ("о​рдер\xa0№", "ордер №"),
        ("йод ёж", "йод ёж"),
        ("Тhe соst оf", "The cost of"),
        ("учёт c отсрочкой", "учёт с отсрочкой"),
        ("OOO «Новасвердом»", "ООО «Новасвердом»"),
        ("charged а penalty", "charged a penalty"),
        ("температура −5 °C", "температура −5 °C"),
        ("формат A4, разъём USB", "формат A4, разъём USB"),
        ('OOO "Sirinstroygran"', 'OOO "Sirinstroygran"'),
        ("№ § ° ² — - «a»", "№ § ° ² — - «a»"),
        ("пере\xadнос  два пробела\tтаб", "перенос  два пробела\tтаб"),
        ("аванс Щекотнев Т.А.,\nbuh-s@sklad.test", "аванс Щекотнев Т.А.,\nbuh-s@sklad.test"),
        ("", ""),
        (None, None),
    ],
)
def test_one_form(text, want):
    assert L.normalize(text) == want
    assert L.normalize(want) == want


def test_conflicts_are_refused():
    with pytest.raises(ValueError):
        L.Transducer({"a": "b", "b": "c"})
    with pytest.raises(ValueError):
        L.Transducer({"": "b"})


def test_longest_match():
    assert L.Transducer({"1": "x", "12": "y", "124": "z"}).run("1 12 123 124 2") == "x y y3 z 2"


def test_frames(spark):
    df = spark.createDataFrame([(1, "прoдлил", "k"), (1, "прoдлил", "k"), (2, None, "k"), (3, "", None), (4, "акт " * 50000, "k")], "id long, t string, field string")
    assert L.odd_texts(df, "id", "t", "f").distinct().collect() == [("f", "1")]
    assert L.odd_texts(df.limit(0), "id", "t", "f").count() == 0
    out = L.one_form(df, ["t"])
    assert out.columns == df.columns and out.where("id = 1").first().t == "продлил" and out.count() == 5
