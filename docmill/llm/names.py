"""Problem 3: variant spellings of contractors' names.

Values typed with a sound tax number belong to its contractor; a number with a slip (one digit
wrong or two swapped) is led back to the number it is near to. Values that never stand with such a
number are linked by their name: names are brought to a comparable spelling (one alphabet, keyboard
layout undone, legal forms dropped, abbreviations spelt out), and joined within a radius of a true
edit metric by metric-space partitioning. Every name belongs to the cell of its nearest pivot; a
searched name is replicated to all cells that the triangle inequality leaves open, and inside a
cell only to the rings around the pivot, and around a second one, in which a name within the radius
can lie. The join is exact for any choice of pivots; pivots are drawn from a bounded sample.

Defined results: null names and values that name nobody (no letters, "not given", ways of payment)
take no part; equal names with different sound numbers stay different; a name that fits several
contractors equally well is linked to none; repeated rows count once.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.lookalikes import TO_CYRILLIC, normalize
from docmill.runtime import cut, prepare, release

#: The radius in edits; the sample that pivots are drawn from, the least number of pivots, by what the root of the
#: number of names is divided to give it, and the number up to which distances are compiled.
RADIUS, PIVOT_SAMPLE, LEAST_PIVOTS, NAMES_A_PIVOT, COMPILED = 2, 600, 12, 6, 64

#: Cyrillic letters in Latin spelling, and the keys of a Russian keyboard.
SPELL = str.maketrans(dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e yo zh z i y k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" "))))
KEYS = str.maketrans("`qwertyuiop[]asdfghjkl;'zxcvbnm,.~QWERTYUIOP{}ASDFGHJKL:\"ZXCVBNM<>", "ёйцукенгшщзхъфывапролджэячсмитьбюЁЙЦУКЕНГШЩЗХЪФЫВАПРОЛДЖЭЯЧСМИТЬБЮ")
#: Legal forms, their long spellings, abbreviations in names, and values that name nobody.
FORMS = {"ооо", "оао", "ао", "пао", "зао", "муп", "гуп", "ип", "ooo", "oao", "ao", "pao", "zao", "mup", "gup", "ip"}
LONG_FORMS = {
    "общество с ограниченной ответственностью": "ооо", "публичное акционерное общество": "пао", "закрытое акционерное общество": "зао",
    "открытое акционерное общество": "оао", "акционерное общество": "ао", "муниципальное унитарное предприятие": "муп", "индивидуальный предприниматель": "ип",
}
SHORT_WORDS = {
    "тд": "торговый дом", "зд": "завод", "фка": "фабрика", "пк": "производственная компания", "нпо": "научно производственное объединение",
    "гк": "группа компаний", "су": "строительное управление", "тк": "транспортная компания",
}
NOBODY = {
    "не указано", "не указан", "не указана", "нет", "нет данных", "н д", "нд", "неизвестно", "неизвестен", "отсутствует", "без названия", "без наименования", "прочее", "прочие",
    "наличный расчет", "наличные", "наличными", "безналичный расчет", "безнал", "нал", "карта", "картой", "банковская карта", "банковский перевод", "оплата", "оплата картой", "физлицо", "частное лицо",
    "контрагент", "поставщик", "покупатель", "клиент", "test", "тест", "none", "null", "nan", "unknown", "n a", "na", "cash",
}
_FORMS_TYPED = {f.upper().translate({v: k for k, v in KEYS.items()}) for f in ("ооо", "ао", "пао", "зао", "муп", "ип", "оао", "гуп")}
_CITY = re.compile(r"\(\s*г[.\s][^)]*\)")
_WORD = re.compile(r"[^\W_]+")
_LONG = [(re.compile(r"\b" + a.replace(" ", r"\s*") + r"\b"), b) for a, b in LONG_FORMS.items()]
_SHORT = {a.translate(SPELL): b.translate(SPELL).replace(" ", "") for a, b in SHORT_WORDS.items()}
_STUCK = re.compile(r"^(ооо|зао|пао|муп|ао|ип|нпо|тд|пк|гк|су|тк)(?=[а-яё]{4})")

#: A legal form and an abbreviation written as one word.
_GLUED = re.compile(r"^(ооо|зао|пао|муп|ао)(нпо|тд|пк|гк|су|тк)$")


def plain(name: str) -> str:
    """The name in one alphabet where it was typed on the wrong layout or with look-alikes."""
    text = normalize(name)
    first = text.split(" ", 1)[0]
    if first.upper() in _FORMS_TYPED and first == first.upper():
        text = text.translate(KEYS)
    elif re.search("[а-яё]", text, re.I):
        text = "".join(TO_CYRILLIC.get(c, c) for c in text)
    return " ".join(text.split())


def nobody(name: str | None) -> bool:
    if not name:
        return True
    words = " ".join(_WORD.findall(plain(name).casefold().replace("ё", "е")))
    return not re.search(r"[^\W\d_]", words) or words in NOBODY


def parts(name: str) -> tuple[str, str, str, str]:
    """(kind, key, given, legal form): org with the whole spelling as key, or person with the surname as key and
    given names or initials."""
    text = _CITY.sub(" ", plain(name)).casefold()
    for pattern, short in _LONG:
        text = pattern.sub(f" {short} ", text)
    text = re.sub(r"\bи\.\s*п\.", " ип ", text)
    dotted = bool(re.search(r"\b[^\W\d_]\.", text))
    words = _WORD.findall(re.sub(r"(?<=[^\W\d_])[-‐](?=[^\W\d_])", "", text))
    forms = [w for w in words if w in FORMS]
    words = [w for w in words if w not in FORMS]
    if words and (m := _GLUED.match(words[0])):
        words[:1] = m.groups()
        forms, words = [*forms, words[0]], words[1:]
    while words and (m := _STUCK.match(words[0])) and not (forms and m.group() in FORMS):
        words[0] = words[0][m.end() :]
        if m.group() in FORMS:
            forms = [m.group()]
        else:
            words.insert(0, m.group())
            break
    form = (forms[0] if forms else "").translate(SPELL)
    spelt = [w.translate(SPELL) for w in words]
    person = any(f in ("ип", "ip") for f in forms) or (not forms and (dotted or len(spelt) in (2, 3) and not any(c.isdigit() for w in spelt for c in w) and any(re.search(r"(ovich|evich|ich|ovna|evna|ichna)$", w) for w in spelt)))
    if not forms and len(spelt) == 2 and not person:
        # a surname with a pet name has no form either
        person = any(re.search(r"(ov|ev|in|kin|yov|ova|eva|ina)$", w) for w in spelt) and not any(w in _SHORT for w in spelt)
    if person and spelt:
        family = max((w for w in spelt if re.search(r"(ov|ev|yov|in|ova|eva|yova|ina|ulin|tev|nev)$", w)), key=len, default=max(spelt, key=len))
        given = [w for w in spelt if w != family]
        given.sort(key=lambda w: bool(re.search(r"(ovich|evich|ich|ovna|evna|ichna)$", w)))
        return "person", family, " ".join(given), form
    return "org", "".join(_SHORT.get(w, w) for w in spelt), "", form


def given_fit(a: str, b: str) -> bool:
    """Given names that may be the same: each spelt, cut short, an initial or a pet name."""
    x, y = a.split(), b.split()
    return bool(x and y) and all(p[0] == q[0] and (len(p) < 3 or len(q) < 3 or p[:2] == q[:2] or len(p) < 6 or len(q) < 6) for p, q in zip(x, y))


def sound(inn: str) -> bool:
    """Check digits of a tax number of 10 or 12 digits."""
    d = [int(c) for c in inn]

    def digit(weights):
        return sum(w * x for w, x in zip(weights, d)) % 11 % 10

    if len(d) == 10:
        return digit((2, 4, 10, 3, 5, 9, 4, 6, 8)) == d[9]
    return len(d) == 12 and digit((7, 2, 4, 10, 3, 5, 9, 4, 6, 8)) == d[10] and digit((3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)) == d[11]


def _distances(c: Column, pivots: list[str]) -> Column:
    """Edits to each pivot; up to COMPILED of them as single expressions, which are compiled."""
    if len(pivots) <= COMPILED:
        return F.array(*[F.levenshtein(c, F.lit(p)) for p in pivots])
    return F.transform(F.array(*[F.lit(p) for p in pivots]), lambda p: F.levenshtein(c, p))


def radius_join(left: DataFrame, right: DataFrame, radius: int = RADIUS, pivots: list[str] | None = None) -> DataFrame:
    """(q, x, d): all pairs of left.q and right.x within the radius of the Levenshtein metric. Exact for any
    pivots; their number grows with the root of the number of names, so that cells stay small. The distances
    to the pivots are computed once for each different name and written."""
    both = left.select(F.col("q").alias("x"), F.lit(True).alias("asks"), F.lit(False).alias("held")).unionByName(right.select("x", F.lit(False).alias("asks"), F.lit(True).alias("held")))
    both = cut(both.where("x is not null").groupBy("x").agg(F.max("asks").alias("asks"), F.max("held").alias("held")))
    if pivots is None:
        sample = [r.x for r in both.where("held").orderBy(F.xxhash64("x"), "x").limit(PIVOT_SAMPLE).collect()]
        pivots = farthest(sample, max(LEAST_PIVOTS, math.isqrt(both.count()) // NAMES_A_PIVOT))
    if not pivots:
        return both.select(F.col("x").alias("q"), "x", F.lit(0).alias("d")).limit(0)
    # a name's cell is its nearest pivot; its rings are the distances to that pivot and to the two after it
    n = len(pivots)
    distinct = both
    both = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x")  # few bytes but much work: not to be put together
    near = cut(both.select("x", "asks", "held", _distances(F.col("x"), pivots).alias("ds")).withColumn("least", F.array_min("ds")))
    release(distinct)
    homes = near.where("held").select("x", (F.array_position("ds", F.col("least")) - 1).cast("int").alias("cell"), "ds").select(
        "x", "cell", F.expr("ds[cell]").alias("r1"), F.expr(f"ds[(cell + 1) % {n}]").alias("r2"), F.expr(f"ds[(cell + 2) % {n}]").alias("r3")
    )
    around = F.sequence(F.lit(-radius), F.lit(radius))
    asked = (
        near.where("asks").select(F.col("x").alias("q"), "ds", "least", F.posexplode("ds").alias("cell", "d1"))
        .where(F.col("d1") <= F.col("least") + 2 * radius)
        .select("q", "cell", "d1", F.expr(f"ds[(cell + 1) % {n}]").alias("d2"), F.expr(f"ds[(cell + 2) % {n}]").alias("d3"))
        .select("q", "cell", F.explode(F.transform(around, lambda i: F.col("d1") + i)).alias("r1"), "d2", "d3")
        .where("r1 >= 0")
        .select("q", "cell", "r1", F.explode(F.transform(around, lambda i: F.col("d2") + i)).alias("r2"), "d3")
    )
    met = asked.join(homes, ["cell", "r1", "r2"]).where(F.abs(F.col("r3") - F.col("d3")) <= radius)
    # a name stands in one cell and one ring of it, so a pair meets once
    return met.select("q", "x", F.levenshtein("q", "x", radius).alias("d")).where("d >= 0")


def farthest(sample: list[str], k: int) -> list[str]:
    """Pivots far from each other: each next one is the farthest from those before."""
    sample = sorted(set(sample))
    if not sample:
        return []
    out = [sample[0]]
    least = [_edits(s, out[0]) for s in sample]
    while len(out) < min(k, len(sample)):
        at = max(range(len(sample)), key=lambda i: (least[i], sample[i]))
        out.append(sample[at])
        least = [min(d, _edits(s, sample[at])) for d, s in zip(least, sample)]
    return out


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _described(history: DataFrame) -> DataFrame:
    """A row for each (name, digits of the number): count, sound, kind, key, given."""
    source = (
        history.select(F.col("contractor_name").alias("name"), F.regexp_replace("contractor_inn", r"\D", "").alias("inn"))
        .where("name is not null")
        .groupBy("name", "inn")
        .agg(F.count("*").alias("n"))
    )

    def run(batches):
        for b in batches:
            rows = []
            for name, inn, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                if not nobody(name):
                    rows.append((name, inn or None, n, bool(inn) and sound(inn), *parts(name)))
            cols = list(zip(*rows)) if rows else [()] * 8
            kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["name", "inn", "n", "ok", "kind", "key", "given", "form"])

    return source.mapInArrow(run, "name string, inn string, n bigint, ok boolean, kind string, key string, given string, form string")


def _slips(d: DataFrame) -> DataFrame:
    """(inn, right): numbers that are one digit or one swap away from a single sound number; a sound one only
    if that stands in many more rows and shares a name's key with it. Keys are looked up for such pairs alone."""
    inns = cut(d.where("inn is not null").groupBy("inn").agg(F.sum("n").alias("n"), F.first("ok").alias("ok")))
    at = F.explode(F.sequence(F.lit(1), F.length("inn")))
    masks = inns.select("*", at.alias("p")).select("*", F.concat(F.expr("substring(inn, 1, p - 1)"), F.lit("*"), F.expr("substring(inn, p + 1)")).alias("mask")).drop("p")
    swaps = inns.select("*", at.alias("p")).where(F.col("p") < F.length("inn")).select("inn", "n", "ok", F.expr("concat(substring(inn, 1, p - 1), substring(inn, p + 1, 1), substring(inn, p, 1), substring(inn, p + 2))").alias("mask"))
    whole = inns.where("ok").select(F.col("inn").alias("right"), F.col("n").alias("m"))
    wrong = masks.join(masks.where("ok").select(F.col("inn").alias("right"), F.col("n").alias("m"), "mask"), "mask")
    swapped = swaps.join(whole.withColumn("mask", F.col("right")), "mask")
    cols = ["inn", "ok", "right"]
    near = wrong.unionByName(swapped).where("inn <> right and (not ok or m >= 4 * n)").select(cols)
    near = cut(near)
    keys = d.where("ok").select("inn", "key").distinct()
    shared = near.where("ok").join(keys, "inn").join(keys.withColumnRenamed("inn", "right"), ["right", "key"], "left_semi").select(cols)
    return near.where("not ok").unionByName(shared).groupBy("inn").agg(F.min("right").alias("right"), F.count_distinct("right").alias("k")).where("k = 1").select("inn", "right")


def _connected(links: DataFrame) -> DataFrame:
    """(who, least): the smallest node that each node is connected with; links go both ways."""
    label = cut(links.groupBy("who").agg(F.least("who", F.min("to")).alias("least")))
    while True:
        met = links.join(label.select(F.col("who").alias("to"), "least"), "to").groupBy("who").agg(F.min("least").alias("met"))
        new = cut(label.join(met, "who").select("who", F.least("least", "met").alias("least"), (F.col("met") < F.col("least")).alias("moved")))
        label = new.drop("moved")
        if new.where("moved").isEmpty():
            return label


def members(history: DataFrame) -> DataFrame:
    """(contractor, name), distinct: under which contractors each raw name occurs."""
    prepare(history.sparkSession)
    d = cut(_described(history))
    slips = _slips(d)
    known = d.join(slips, "inn", "left").withColumn("contractor", F.coalesce("right", F.when(F.col("ok"), F.col("inn")))).drop("right")
    known = cut(known)
    release(d)
    sure = known.where("contractor is not null")
    orphans = known.join(sure.select("name").distinct(), "name", "left_anti").select("name", "kind", "key", "given", "form").distinct()
    # every key that a contractor is known by; an orphan's key is a contractor of its own if none fits
    keyed = sure.select("contractor", "kind", "key", "given", "form").distinct()
    asked = orphans.select(F.concat_ws(" ", "kind", "key").alias("q")).distinct()
    held = keyed.select(F.concat_ws(" ", "kind", "key").alias("x")).unionByName(asked.select(F.col("q").alias("x"))).distinct()
    near = cut(radius_join(asked, held))
    # short keys allow less; figures in a name must agree; a word more at the end is another name
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    short = F.least(F.length("q"), F.length("x"))
    near = near.where(
        (digits("q") == digits("x")) & (F.substring("q", 1, 3) == F.substring("x", 1, 3)) & (F.col("d") <= F.when(short < 14, 1).otherwise(2)) & ~((F.col("d") == 2) & (F.col("q").startswith(F.col("x")) | F.col("x").startswith(F.col("q"))))
    )
    o = orphans.withColumn("q", F.concat_ws(" ", "kind", "key")).join(near, "q")
    fit = F.udf(given_fit, "boolean", useArrow=True)
    k = keyed.select("contractor", F.col("given").alias("given2"), F.col("form").alias("form2"), F.concat_ws(" ", "kind", "key").alias("x"))
    hits = o.join(k, "x").where((F.col("kind") == "org") | fit("given", "given2"))
    # the best fit, where another legal form counts half an edit; of two equally good ones none
    cost = F.col("d") * 2 + F.when((F.col("form") != "") & (F.col("form2") != "") & (F.col("form") != F.col("form2")), 1).otherwise(0)
    fits = hits.groupBy("name", "contractor").agg(F.min(cost).alias("d")).groupBy("name", "d").agg(F.count("*").alias("k"), F.min("contractor").alias("contractor"))
    best = cut(fits.groupBy("name").agg(F.min(F.struct("d", "k", "contractor")).alias("b")).select("name", "b.k", "b.contractor"))
    linked = best.where("k = 1")
    rest = orphans.join(best.select("name"), "name", "left_anti").withColumn("q", F.concat_ws(" ", "kind", "key"))
    # those left are contractors without a number: the smallest key that a key is connected with names it
    initial = F.when(F.col("kind") == "person", F.substring("given", 1, 1)).otherwise("")
    rest = cut(rest.select("name", "q", F.concat_ws("|", "q", initial).alias("who"), F.coalesce(initial, F.lit("")).alias("initial")))
    nodes = rest.select("q", "who", "initial").distinct()
    links = near.where("q <> x").join(nodes, "q").join(nodes.select(F.col("q").alias("x"), F.col("who").alias("to"), "initial"), ["x", "initial"]).select("who", "to")
    alone = rest.join(_connected(cut(links)), "who", "left").select("name", F.concat_ws("|", F.lit("name"), F.coalesce("least", "who")).alias("contractor"))
    return sure.select("contractor", "name").unionByName(linked.select("contractor", "name")).unionByName(alone.select("contractor", "name")).distinct()


def same_contractor(history: DataFrame) -> DataFrame:
    """(name_a, name_b): different raw names with a contractor in common."""
    m = cut(members(history))
    a, b = m.withColumnRenamed("name", "name_a"), m.withColumnRenamed("name", "name_b")
    return a.join(b, "contractor").where("name_a < name_b").select("name_a", "name_b").distinct()
