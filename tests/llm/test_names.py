from docmill.llm import names as N


def test_names_without_a_number_are_connected_over_others(spark):
    chain = ["ООО «Ладогранторгаааааа»", "ООО «Ладогранторгббаааа»", "ООО «Ладогранторгббббаа»", "ООО «Ладогранторгбббббб»"]
    df = spark.createDataFrame([(n, None) for n in [*chain, "ООО «Сирень»"]], "contractor_name string, contractor_inn string")
    got = {(r.name_a, r.name_b) for r in N.same_contractor(df).collect()}
    assert got == {(x, y) for x in chain for y in chain if x < y}


def test_a_sound_slip_is_led_back_however_often_it_is_repeated(spark):
    right, slip = "1144269420", "6144269420"
    assert N.sound(right) and N.sound(slip)
    rows = [("ООО «Ромашка»", right)] * 30 + [("Ромашка, ООО", right)] * 10 + [("ООО «Ромашка»", slip)] * 4 + [("ООО «Сирень»", slip)] * 6
    got = {(r.name_a, r.name_b) for r in N.same_contractor(spark.createDataFrame(rows, "contractor_name string, contractor_inn string")).collect()}
    assert ("ООО «Сирень»", "Ромашка, ООО") in got
