import random

import numpy as np
import pytest

from docmill.llm import mixing as M
from docmill.llm import names as N
from docmill.llm import near_dup as D


def brute_pages(pages):
    bits = {k: x[1] for k, t in pages if t and (x := D.bits_of(t)) is not None}
    out = set()
    for a in bits:
        for b in bits:
            if a < b:
                common = len(np.intersect1d(bits[a], bits[b]))
                if 2 * common >= len(bits[a]) + len(bits[b]) - common:
                    out.add((a, b))
    return out


@pytest.mark.parametrize("hot, wide, pairs", [(4096, 8192, 2_000_000), (2, 2, 7)])
def test_alike_pages_against_brute_force(spark, monkeypatch, hot, wide, pairs):
    monkeypatch.setattr(D, "BLOCK_PAIRS", pairs)
    monkeypatch.setattr(D, "HOT", hot)
    monkeypatch.setattr(D, "WIDE", wide)
    rng = random.Random(5)
    words = [f"слово{i}" for i in range(60)]
    pages = []
    for i in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(28, 90))]
        pages.append((f"k{i:03d}a", " ".join(base)))
        for j in range(rng.randrange(3)):
            edited = list(base)
            for _ in range(rng.randrange(0, 14)):
                at = rng.randrange(len(edited))
                edited[at : at + 1] = rng.choice([[], [rng.choice(words)], [edited[at], rng.choice(words)]])
            pages.append((f"k{i:03d}{'bcd'[j]}", " ".join(edited)))
    # pages of few different bits, and one passage that a third of all pages share
    pages += [("r1", "раз " * 30), ("r2", "раз " * 31), ("r3", "раз два " * 16), ("r4", "раз два " * 17)]
    pages += [(f"h{i:02d}", " ".join(words[:40] + [words[(i * 7 + j) % 60] for j in range(i % 9)])) for i in range(30)]
    pages += [("z1", None), ("z2", ""), ("z3", "мало слов"), pages[0], pages[0], ("k000x", pages[0][1].upper())]
    df = spark.createDataFrame([(k, t, "x") for k, t in pages], "page_hash string, text string, sig string")
    got = [(r.key_a, r.key_b) for r in D.alike_pages(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pages(dict(pages).items())
    assert ("k000a", "k000x") in set(got)
    assert D.alike_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("window", [0, 48])
def test_alike_numbers_against_brute_force(spark, monkeypatch, window):
    monkeypatch.setattr(D, "WINDOW", window)
    rng = random.Random(6)
    rows = []
    for i in range(120):
        number = "".join(rng.choice("01-А") for _ in range(rng.randrange(1, 12)))
        rows.append((i, rng.choice(["п1", "п2", None]), rng.choice(["d", "e"]), rng.choice([1.5, 1.5, None]), rng.choice([number, None, "571/23-КР", "571/23-KP", "0571/23-КР", ""])))
    df = spark.createDataFrame(rows, "id long, contractor_inn string, document_date string, total_amount double, document_number string")
    want = set()
    for a in rows:
        for b in rows:
            if str(a[0]) < str(b[0]) and None not in a and None not in b and a[1:4] == b[1:4] and N._edits(a[4], b[4]) * 4 <= max(len(a[4]), len(b[4])):
                want.add((str(a[0]), str(b[0])))
    got = [(r.key_a, r.key_b) for r in D.alike_numbers(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert D.alike_numbers(df.limit(0)).count() == 0


@pytest.mark.parametrize("pivots, compiled", [(None, 64), (["", "ааааааа"], 64), (["", "а", "бб", "ввв", "абв"], 3)])
def test_radius_join_is_exact(spark, monkeypatch, pivots, compiled):
    monkeypatch.setattr(N, "COMPILED", compiled)
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("абв") for _ in range(rng.randrange(0, 9))) for _ in range(150)})
    left, right = spark.createDataFrame([(w,) for w in words[::2]], "q string"), spark.createDataFrame([(w,) for w in words], "x string")
    got = {(r.q, r.x, r.d) for r in N.radius_join(left, right, 2, pivots).collect()}
    assert got == {(a, b, e) for a in words[::2] for b in words if (e := N._edits(a, b)) <= 2}
    assert N.radius_join(left, right.limit(0)).count() == 0


def test_names():
    key = N.parts("ООО «Торговый дом Ладогранторг Север»")[:2]
    for other in ("ТД Ладогранторг Север, ООО", "JJJ NL Kfljuhfynjhu Ctdth", 'OOO "TD Ladograntorg Sever"', "ООО ТДЛАДОГРАНТОРГ СЕВЕР", "ОООТД Ладогранторг Север", "Общество с ограниченной ответственностью «ТД Ладогранторг Север» (г. Тихоборск)"):
        assert N.parts(other)[:2] == key
    assert N.parts("ИП Галашкина П.Г.")[:2] == N.parts("Полина Глебовна Галашкина")[:2] == ("person", "galashkina")
    assert N.given_fit("p g", "polina glebovna") and not N.given_fit("d", "polina")
    assert all(N.nobody(x) for x in (None, "", "—", "н/д", "Наличный расчёт", "не указано")) and not N.nobody("ИП Ян")


def test_same_contractor(spark):
    a, b = "7707083893", "500100732259"
    rows = [("ООО «Ромашка»", a), ("Ромашка, ООО", "770 708 3893"), ("OOO Romashka", "7707083894"), ("ООО «Ромашкаа»", None), ("н/д", a), ("н/д", b), ("ИП Иванов Пётр Ильич", b), ("ИП Иванов П.И.", None), (None, a), ("ООО «Ромашка»", a), ("ООО «Сирень»", None)]
    df = spark.createDataFrame([(n, i, 0) for n, i in rows], "contractor_name string, contractor_inn string, n int")
    got = {(r.name_a, r.name_b) for r in N.same_contractor(df).collect()}
    rom = sorted(["ООО «Ромашка»", "Ромашка, ООО", "OOO Romashka", "ООО «Ромашкаа»"])
    assert got == {(x, y) for x in rom for y in rom if x < y} | {("ИП Иванов П.И.", "ИП Иванов Пётр Ильич")}
    assert N.same_contractor(df.limit(0)).count() == 0


def test_mixing(spark):
    docs = [(i, "слово " * (3 + i % 7), "big", 1) for i in range(300)] + [(1000 + i, "слово " * (5 + i % 3), "small", 1) for i in range(12)] + [(2000, None, "big", 1), (2001, "", "small", 1), (2002, "x", None, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n int")
    t = spark.createDataFrame([("m", "big", 3.0, 1), ("m", "small", 1.0, 4), ("m", "gone", 1.0, 2), ("m", "zero", None, 1), ("n", "small", 1.0, None)], "mix_name string, source string, weight double, max_repeats int")
    got = {(r.mix_name, r.source): r for r in M.shares(df, t).collect()}
    assert abs(got["m", "big"].actual_share - 0.75) < 0.02 and abs(got["m", "small"].actual_share - 0.25) < 0.02
    assert got["m", "small"].most_repeats <= 4 and got["m", "big"].most_repeats <= 1 and got["n", "small"].most_repeats == 1
    assert got["m", "gone"].tokens == 0
    chosen = M.mix(df, t)
    assert chosen.where("doc_id >= 2000").count() == 0 and chosen.count() == chosen.select("mix_name", "doc_id").distinct().count()
    assert M.mix(df.limit(0), t).count() == 0 and M.mix(df, t.limit(0)).count() == 0
