"""Problem 2: personal information in free text, by bootstrapped contextual extraction.

Shapes propose instances of each kind: strict ones, whose form speaks for them (a number with its
country sign, a tax number with sound check digits, a name with a patronymic), and wide ones that
take in any number of the right length, any two capitalised words and any word with a mail sign.
The strict ones are seeds, but no seed is accepted by itself. Each instance also carries lexical
patterns: the words before it and, for names, the stem of the given name. Spark scores the graph of patterns and
instances in rounds: a pattern is as good as the share of its instances that are believed, an
instance as its seed and its patterns together. A seed is accepted only if its patterns vouch for it, so one in the
company of unbelieved instances isn't.
Wide instances have no seed: only patterns of high confidence find them, and so bring in identifiers whose form
no rule foresaw. Instances of
equal patterns are one weighted node, so the rounds run over far fewer rows than there are texts.

Positions count code points of the raw text from 1. Look-alikes, full-width forms, invisible
characters, misread digits and words broken over a line end are seen through. Defined results: null
and empty texts have no items; repeated rows of a key count once; extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.llm import lookalikes
from docmill.llm.names import sound
from docmill.runtime import cut, prepare

ROUNDS, ACCEPT, SMOOTH = 4, 0.6, 1.5
#: What patterns must at least say for a seed, and for a wide instance.
VOUCH, VOUCH_WIDE = 0.35, 0.9

_DROP = set(map(chr, lookalikes.INVISIBLE)) | {"̆", "̈", "́"}
_TO_PLAIN = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | {chr(c): " " for c in lookalikes.SPACES} | {"−": "-", "‐": "-", "¬": "-", "–": "-"}
_DROPPED = re.compile("[" + "".join(map(re.escape, _DROP)) + "]")
_PLAIN = str.maketrans(_TO_PLAIN)
_SIDES = {"cyr": str.maketrans(lookalikes.TO_CYRILLIC), "lat": str.maketrans(lookalikes.TO_LATIN)}
_SPECIAL = re.compile("[" + "".join(map(re.escape, [*_DROP, *_TO_PLAIN])) + "]")


def readable(text: str) -> tuple[str, list[int] | None]:
    """Text in plain characters, and for each the position in the raw text (None: the same)."""
    words = lookalikes._words(text)
    if not words and _SPECIAL.search(text) is None:
        return text, None
    pieces, at = [], 0
    for lo, hi, side in words:  # letters are put in place of letters, so places stay
        pieces += [text[at:lo], text[lo:hi].translate(_SIDES[side])]
        at = hi
    plain = "".join([*pieces, text[at:]]).translate(_PLAIN)
    if _DROPPED.search(plain) is None:
        return plain, None
    keep = [i for i, c in enumerate(plain) if c not in _DROP]
    return "".join(plain[i] for i in keep), keep


#: Letters and signs that digits are misread as.
_AS_DIGIT = str.maketrans("OОoоЗзlI|!БбSВ", "00003311166658"[:14])
D = r"[0-9OОoоЗзlI|!Бб]"
#: The first digit is a digit, or misread beside one.
D1 = r"(?:[0-9]|[OОoоЗзlI|!Бб](?=[0-9]))"
_GAP = r"[ \t]*\n?[ \t]*"
_AT = r"(?:@|©|[(\[{<]\s?(?:at|AT|а[тt]|собака|СОБАКА|dog)\s?[)\]}>])"
EMAIL = re.compile(rf"(?<![\w.@])[\w+][\w.+]*(?:-\n?[\w.+]+)*{_GAP}{_AT}{_GAP}[\w]+(?:-\n?\s?[\w]+)*(?:\.(?:\n(?=[a-zа-я]))?[\w-]+)+")
_AT_SIGN = re.compile(_AT)
PHONE = re.compile(
    rf"(?:\+(?<![\w.,/№-].)(?<!№ .){_GAP}{D}{{1,3}}|8(?<![\w.,/+№-].)(?<!№ .)|(?=\()(?<!\w))[\s.\-]{{0,2}}\(?{D}{{3}}\)?[\s.\-]{{0,2}}{D}{{3}}[\s.\-]{{0,2}}{D}{{2}}[\s.\-]{{0,2}}{D}{{2}}(?![\w])(?!-\d)"
)
PASSPORT = re.compile(rf"{D1}(?<![\w.,/+-].){D}\s?{D}{{2}}\s*(?:№|N|номер|no\.?)?\s*{D}{{6}}(?![\w])(?![.,]\d)")
INSURANCE = re.compile(rf"{D1}(?<![\w.,/+-].){D}{{2}}-\n?{D}{{3}}-\n?{D}{{3}}[\s-]{D}{{2}}(?![\w-])")
PERSON_TAX = re.compile(rf"{D1}(?<![\w.,/+-].){D}{{11}}(?!\w)")
_CAP = r"[А-ЯЁA-Z][а-яёa-z|!*0-9]*(?:-[ \t]*\n[ \t]*[а-яё]+)?[а-яёa-z]*"
_TOWN = rf"(?:г(?:ор)?\.\s*{_CAP}|{_CAP})"
_KIND = r"(?:ул|пер|пр-т|просп|пр|б-р|бул|наб|ш|пл|туп|проезд|улица|переулок|проспект|бульвар|шоссе|набережная|площадь|тупик|аллея)"
_HOUSE = rf"(?:,?\s*(?:д|дом|вл\w*|зд)\.?\s*)?,?\s*(?:{D1}{D}{{0,3}}(?!\d)|владе-)"
ADDRESS = re.compile(
    rf"(?<![\w-])(?:(?P<post>{D}{{6}}),?\s+)?(?:(?P<region>{_CAP}\s+(?:край|обл\.|область|респ\.|республика|район|р-н)),?\s+)?(?:(?P<town>{_TOWN}),?\s+)?"
    rf"(?:{_KIND}\.?\s+{_CAP}(?:\s{_CAP})?{_HOUSE}|{_CAP}\s+(?:проезд|переулок|проспект|бульвар|тупик|шоссе|улица|ул\.|пер\.|аллея|набережная){_HOUSE})"
)
ADDRESS_EN = re.compile(rf"{D1}(?<![\w/.-].){D}{{0,3}}(?:/{D}{{1,4}})?,?\s+[A-Z][\w|!*]+\s+(?:Lane|Street|Avenue|Road|Square|Drive|St\.|Ave\.)(?!\w)|(?<!\w)[A-Z][\w|!*]+\s+(?:ul|per|pr-t|pr|proezd|pereulok|ulitsa)\.?,?\s+(?:d\.\s*)?[0-9]|(?<!\w)(?:ul|per|pr-t|pr)\.\s*[A-Z][\w|!*]+,?\s+(?:d\.\s*)?[0-9]")

#: Each word begins with a letter by which it is looked for.
_STREET = re.compile(
    r"у(?<!\w.)л(?:ица)?(?!\w)|п(?<!\w.)(?:ер(?:еулок)?|р-т|росп(?:ект)?|роезд|р|л(?:ощадь)?)(?!\w)|б(?<!\w.)(?:-р|ул(?:ьвар)?)(?!\w)|н(?<!\w.)аб(?:ережная)?(?!\w)|ш(?<!\w.)(?:оссе)?(?!\w)|т(?<!\w.)уп(?:ик)?(?!\w)|а(?<!\w.)ллея(?!\w)"
    r"|Lane|Street|Avenue|Road|Square|Drive|u(?<!\w.)(?:l\.|litsa(?!\w))|p(?<!\w.)(?:er\.|r-t\.|r\.|roezd(?!\w)|ereulok(?!\w))|S(?<=\sS)t\.|A(?<=\sA)ve\."
)

_W = r"[А-ЯЁ][А-ЯЁа-яё|!*0-9]*(?:-[ \t]*\n[ \t]*[а-яёА-ЯЁ]+)?[а-яёА-ЯЁ]*|[A-Z][A-Za-z|!*0-9]*(?:-[ \t]*\n[ \t]*[a-z]+)?[a-z]*"
TOKENS = re.compile(rf"[A-ZА-ЯЁ](?<![\w-].)(?:(?<=(.))(?=[\w.|!*-])|(?=\.))[^\W_]*(?:[|!*][^\W_]*)*(?:-[ \t]*\n[ \t]*[^\W_]+)?\.?(?:,?[ \t]*\n?[ \t]*[A-ZА-ЯЁ][^\W_]*(?:[|!*][^\W_]*)*(?:-[ \t]*\n[ \t]*[^\W_]+)?\.?)+")
TOKEN = re.compile(rf"(?:{_W})\.?")
_PATRONYMIC = re.compile(r"(?:[оеё]вич|ьич|ич)(?:а|у|ем|ом|е)?$|(?:[оеё]вн|ичн|иничн)(?:а|ы|е|у|ой|ою)$|(?:ovich|evich|ovna|evna|ichna)$", re.I)
_FAMILY = re.compile(r"(?:[оеё]в|[иы]н)(?:а|у|ым|е|ой|ою|ы)?$|(?:ск|цк)(?:ий|ого|ому|им|ая|ой|ую)$|(?:enko|ov|ev|yov|in|yn|ova|eva|yova|ina|yna|sky|skaya)$|(?:енко|чук|юк)$", re.I)


def _join(word: str) -> str:
    return re.sub(r"-\s*\n\s*", "", word)


_AS_LETTER = str.maketrans("0|!*13", "оллезз")


def _class(token: str) -> str:
    """I initial, P patronymic, S family name, W any other word."""
    if token in "|,":
        return token
    word = _join(token) if "\n" in token else token
    if len(word.rstrip(".")) == 1:
        return "I" if word.endswith(".") else "X"
    if word.endswith("."):
        word = word[:-1]
    plain = word.lower()
    if not plain.isalpha():
        plain = plain.translate(_AS_LETTER)
    if len(plain) >= 6 and _PATRONYMIC.search(plain):
        return "P"
    return "S" if len(plain) >= 4 and _FAMILY.search(plain) else "W"


#: Orders of a name's parts, the longest first; F is a W that stands for a given name.
_ORDERS = ("SWP", "WPS", "SSP", "SPS", "SII", "IIS", "WIS", "SIS", "SI", "IS", "S,W", "S,S", "WS", "SW", "WP", "SS")


def _stretches(text: str) -> list[list[tuple[int, int, str]]]:
    """Stretches of capitalised words: (start, end, word) of each; a comma and | for the end of a sentence stand
    between them."""
    out = []
    for m in TOKENS.finditer(text):
        tokens, last, whole = [], 0, m.group()
        comma = "," in whole
        for t in TOKEN.finditer(whole):
            word = t.group()
            if comma and "," in whole[last : t.start()]:
                tokens.append((0, 0, ","))
            last = t.end()
            tokens.append((m.start() + t.start(), m.start() + last, word))
            if len(word) > 2 and word[-1] == ".":
                tokens.append((0, 0, "|"))
        out.append(tokens)
    return out


def _names(stretches):
    """(start, end, proved, order, given name) of each part of a stretch that may be a name."""
    for tokens in stretches:
        at = 0
        classes = "".join([_class(t[2]) for t in tokens])
        while at < len(tokens):
            for order in _ORDERS:
                if classes.startswith(order, at):
                    # a role before a name is a W too: of W S W, W S I and W W S the first W isn't part of it
                    if order == "WS" and classes[at + 2 : at + 3] in ("W", "I", "P", "S"):
                        continue
                    span = tokens[at : at + len(order)]
                    given = next((_join(span[k][2]).rstrip(".").lower() for k in range(len(order)) if order[k] == "W"), "")
                    if order in ("SSP", "SPS", "SS"):
                        given = _join(span[order != "SS"][2]).lower()
                    proved = order in ("SWP", "WPS", "SSP", "WP", "SPS")
                    end = span[-1][1] - (order[-1] != "I" and span[-1][2].endswith("."))
                    yield span[0][0], end, proved, order, given
                    at += len(order)
                    break
            else:
                at += 1


_LEFT = re.compile(r"[^\W_]+|№|[:@]")


#: Any number of ten to twelve digits, however parted; any word with a mail sign; two capitalised words.
WIDE_NUMBER = re.compile(rf"[0-9+(](?<![\w.,/№+(-].)(?:(?:[ ()\-]{{0,2}}|\n){D}){{9,12}}(?![\w-])(?![.,]\d)")
_WIDE_BEFORE, _WIDE_AFTER = re.compile(r"(?<![\w.@])[\w+][\w.+-]*$"), re.compile(r"[\w][\w-]*(?:\.[\w-]+)*")


def _left(text: str, start: int) -> list[str]:
    """The last three words before a place that aren't figures, however far away."""
    reach = 48
    while True:
        words = [w.lower() for w in _LEFT.findall(text[max(0, start - reach) : start]) if not w.isdigit()]
        if len(words) > 3 or start <= reach:  # the first of them may be cut
            return words[-3:]
        reach *= 2


def _around(pattern: re.Pattern, text: str, start: int, end: int):
    """Matches over a place; where one reaches the edge of what was looked at, more is."""
    reach = 96
    while True:
        lo, hi = max(0, start - reach), min(len(text), end + reach)
        found = [m for m in pattern.finditer(text, lo, hi) if m.end() > start and m.start() < end]
        if not any(lo > 0 and m.start() < lo + 32 or hi < len(text) and m.end() > hi - 8 for m in found):
            return found
        reach *= 2


def instances(text: str | None) -> list[tuple[str, int, int, float, list[str]]]:
    """(kind, start, end, seed, patterns) of all that may be personal in a text; positions of the raw text."""
    if not text:
        return []
    plain, raw = readable(text)
    out: list[tuple[str, int, int, float, list[str]]] = []
    taken: list[tuple[int, int]] = []

    def add(kind: str, a: int, b: int, seed: float, extra: list[str]) -> None:
        if any(a < y and x < b for x, y in taken):
            return
        taken.append((a, b))
        words = _left(plain, a)
        shape = extra[0].split("-")[0] if kind == "identity" else kind
        pats = [f"{shape}<{w}" for w in (" ".join(words[-2:]) or "^", " ".join(words[-1:])) if w] + [f"{kind}:{e}" for e in extra if e and not e.endswith(("-plain", "-other"))]
        lo, hi = (a, b - 1) if raw is None else (raw[a], raw[b - 1])
        out.append((kind, lo + 1, hi + 1, seed, pats))

    for at in _AT_SIGN.finditer(plain):
        for m in _around(EMAIL, plain, at.start(), at.end()):
            add("email", m.start(), m.end(), 1.0, [])
    for m in INSURANCE.finditer(plain):
        add("identity", m.start(), m.end(), 0.9, ["insurance"])
    for m in PHONE.finditer(plain):
        digits = re.sub(r"\D", "", m.group().translate(_AS_DIGIT))
        if sum(c.isdigit() for c in m.group()) < 8:
            continue
        sign = m.group()[0]
        if sign == "+" and len(digits) >= 11 or sign in "8(" and len(digits) in (10, 11):
            add("phone", m.start(), m.end(), 1.0 if sign == "+" else 0.7 if sign == "8" and not m.group()[1] == " " else 0.6 if "(" in m.group() else 0.0, [f"{sign}{len(digits)}"])
    for m in PERSON_TAX.finditer(plain):
        if sum(c.isdigit() for c in m.group()) >= 9:
            digits = m.group().translate(_AS_DIGIT)
            ok = digits.isdigit() and sound(digits)
            add("identity", m.start(), m.end(), 0.9 if ok else 0.0, ["tax-sound" if ok else "tax-other"])
    for m in PASSPORT.finditer(plain):
        if sum(c.isdigit() for c in m.group()) >= 7:
            sure = re.search(r"(?i)па[сc]п[оo]рт|passport", plain[max(0, m.start() - 30) : m.start()])
            marked = re.search(r"№|номер|no", m.group())
            add("identity", m.start(), m.end(), 0.95 if sure else 0.0, ["passport-marked" if marked else "passport-plain"])
    for near in _STREET.finditer(plain):
        pattern = ADDRESS_EN if near.group().isascii() else ADDRESS
        for m in _around(pattern, plain, near.start(), near.end()):
            start = m.start()
            if pattern is ADDRESS and m.group("town") and not m.group("town").startswith("г") and not m.group("post") and not m.group("region"):
                # a capitalised word before the street is a town unless it is a name's part
                word = m.group("town")
                if not plain[m.end("town") :].startswith(",") and _class(word) != "W":
                    start = m.end("town") + len(re.match(r"[,\s]*", plain[m.end("town") :]).group())
            add("address", start, m.end(), 0.9, [])
    stretches = _stretches(plain)
    for a, b, proved, order, given in _names(stretches):
        stem = given[: max(3, len(given) - 2)][:4]
        add("name", a, b, 0.9 if proved else 0.0, [f"given {stem}" if given else f"form {order}"])
    wide: list[tuple[str, int, int, float, list[str]]] = []
    at = plain.find("@")
    while at >= 0:
        before, after = _WIDE_BEFORE.search(plain, max(0, at - 64), at), _WIDE_AFTER.match(plain, at + 1)
        if before and after:
            wide.append(("email", before.start(), after.end(), -1.0, []))
        at = plain.find("@", at + 1)
    for m in WIDE_NUMBER.finditer(plain):
        digits = re.sub(r"\D", "", m.group().translate(_AS_DIGIT))
        if 10 <= len(digits) <= 12 and sum(c.isdigit() for c in m.group()) >= len(digits) - 2:
            wide.append(("phone", m.start(), m.end(), -1.0, []))
            wide += [("identity", m.start(), m.end(), -1.0, [shape]) for shape in ("passport", "insurance", "tax")]
    for a, b in _wide_names(stretches):
        wide.append(("name", a, b, -1.0, []))
    for kind, a, b, seed, extra in wide:
        if not any(a < y and x < b for x, y in taken):
            words = _left(plain, a)
            shape = extra[0] if extra else kind
            lo, hi = (a, b - 1) if raw is None else (raw[a], raw[b - 1])
            if any(c.isalpha() for w in words[-2:] for c in w):
                out.append((kind, lo + 1, hi + 1, seed, [f"{shape}<{' '.join(words[-2:])}"]))
    return out


def _wide_names(stretches):
    """Two capitalised words side by side, neither of which is an initial."""
    for tokens in stretches:
        for (a, end, t), (_, b, u) in zip(tokens, tokens[1:]):
            if len(t) > 2 and len(u) > 2 and t[-1] != "." and t[1:].islower() and u.rstrip(".")[1:].islower():
                yield a, b - (u[-1] == ".")


def candidates(pages: DataFrame, key: str = "page_hash", text: str = "text") -> DataFrame:
    """A row for each instance: key, kind, start_pos, end_pos, node (its seed and patterns as one string)."""
    prepare(pages.sparkSession)
    kind_of_key = dict(pages.dtypes)[key]

    def run(batches):
        for b in batches:
            ids, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for kind, a, z, seed, pats in instances(t):
                    ids.append(i)
                    rows.append((kind, a, z, f"{seed}\t" + "\t".join(pats)))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), *cols], ["key", "kind", "start_pos", "end_pos", "node"])

    source = pages.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    return source.mapInArrow(run, f"key {kind_of_key}, kind string, start_pos bigint, end_pos bigint, node string")


def believed(found: DataFrame) -> DataFrame:
    """(node, score): the nodes whose instances are accepted, after ROUNDS rounds over the graph."""
    nodes = found.groupBy("node").agg(F.count("*").alias("w"))
    nodes = cut(nodes.select("node", "w", F.split("node", "\t")[0].cast("double").alias("seed"), F.expr("slice(split(node, '\t'), 2, 9)").alias("pats")))
    edges = cut(nodes.select("node", "w", "seed", F.explode("pats").alias("pat")).where("pat <> ''"))
    scores = nodes.select("node", F.greatest(F.col("seed"), F.lit(0.0)).alias("score"))
    for _ in range(ROUNDS):
        # a pattern is worth the share of believed instances, the more the more it has seen; wide instances are found
        # by patterns and say nothing on them
        pats = edges.where("seed >= 0").join(scores.select("node", "score"), "node").groupBy("pat").agg((F.sum(F.col("w") * F.col("score")) / (F.sum("w") + SMOOTH)).alias("conf"))
        vouched = edges.join(pats, "pat").groupBy("node").agg((1 - F.product(1 - 0.9 * F.col("conf"))).alias("by"), F.max("conf").alias("best"))
        by = F.coalesce("by", F.lit(0.0))
        score = F.when(F.col("seed") < 0, F.coalesce("best", F.lit(0.0))).otherwise(1 - (1 - F.col("seed")) * (1 - by))
        scores = cut(nodes.join(vouched, "node", "left").select("node", "seed", score.alias("score"), by.alias("by")))
    wide = F.col("seed") < 0
    return scores.where(F.when(wide, F.col("score") >= VOUCH_WIDE).otherwise((F.col("score") >= ACCEPT) & (F.col("by") >= VOUCH))).select("node", "score", wide.alias("wide"))


def _accepted(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, start_pos, end_pos) of each accepted item, once for each key and place; of several kinds of a wide
    one the surest, and of wide ones that overlap the first."""
    found = cut(candidates(pages, key, text))
    some = found.join(believed(found), "node").select("key", "kind", "start_pos", "end_pos", "score", "wide")
    sure = some.where("not wide").select("key", "kind", "start_pos", "end_pos").distinct()
    rest = some.where("wide").groupBy("key", "start_pos").agg(F.max_by(F.struct("kind", "end_pos"), F.struct("score", "kind")).alias("x")).select("key", "x.kind", "start_pos", "x.end_pos")
    before = Window.partitionBy("key").orderBy("start_pos").rowsBetween(Window.unboundedPreceding, -1)  # the few wide ones of one page
    rest = rest.withColumn("taken", F.max("end_pos").over(before)).where("taken is null or taken < start_pos").drop("taken")
    return sure.unionByName(rest)


def find(pages: DataFrame, key: str = "page_hash", text: str = "text") -> DataFrame:
    """(key, kind, start_pos, end_pos) of each accepted item."""
    return _accepted(pages, key, text).select(F.col("key").alias(key), "kind", "start_pos", "end_pos")


def redact(pages: DataFrame, key: str = "page_hash", text: str = "text") -> DataFrame:
    """(key, text): each different text of a key with its items replaced by [EMAIL], [PHONE] and so on."""
    spans = _accepted(pages, key, text).select("key", F.struct("start_pos", "end_pos", "kind").alias("s")).groupBy("key").agg(F.collect_list("s").alias("spans"))

    def put(t, spans):
        if t is None or not spans:
            return t
        at, out = 0, []
        for s in sorted(spans, key=lambda s: s["start_pos"]):
            if s["start_pos"] - 1 < at or s["end_pos"] > len(t):
                continue
            out += [t[at : s["start_pos"] - 1], f"[{s['kind'].upper()}]"]
            at = s["end_pos"]
        return "".join(out) + t[at:]

    texts = pages.select(F.col(key).alias("key"), F.col(text).alias("text")).distinct()
    return texts.join(spans, "key", "left").select(F.col("key").alias(key), F.udf(put, "string", useArrow=True)("text", "spans").alias(text))
