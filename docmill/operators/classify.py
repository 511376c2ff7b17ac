"""Rule classification from a signature table, ensemble scores, embeddings and a trainable classifier."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import normalize_for_classification
from docmill.runtime import once

Signatures = dict[str, dict[str, list[str]]]

#: Signatures for the document types of the test tables; any other table is passed as a parameter.
SIGNATURES: Signatures = {
    "act": {"keywords": ["акт", "выполненных работ", "принял работы"], "patterns": ["акт № ?[0-9]+"], "exclude": ["сверки взаимных"]},
    "contract": {"keywords": ["договор", "арендодатель", "поставки"], "patterns": ["договор [а-я]+ [0-9]+"], "exclude": ["счет на оплату"]},
    "invoice": {"keywords": ["счет на оплату", "invoice", "плательщик"], "patterns": ["счет на оплату +[0-9]+", "invoice no"], "exclude": ["счет-фактура"]},
    "payment_order": {"keywords": ["платежное поручение", "кассовый ордер", "payment"], "patterns": ["поручение +[0-9]+"], "exclude": ["накладная"]},
    "reconciliation_act": {"keywords": ["акт сверки", "взаимных расчетов", "сальдо", "reconciliation"], "patterns": ["сверки взаимных расчетов +[0-9]+"], "exclude": []},
    "torg12": {"keywords": ["товарная накладная", "накладной", "delivery note"], "patterns": ["накладная +[0-9]+"], "exclude": ["поручение"]},
}


@dataclass(frozen=True)
class Preference:
    """A type that wins ties and gets points of its own: for any of some terms, and for a cue when it is compared."""

    kind: str
    bonuses: tuple[tuple[tuple[str, ...], int], ...] = ()
    cues: tuple[str, ...] = ()
    cue_points: int = 2
    least: int = 3


#: Terms of acts of reconciliation, misread ones among them, with their points.
ACTS = Preference(
    "reconciliation_act",
    (
        (("акт сверки", "акт сврки", "акт сверк", "сверка взаиморасчетов", "заимных расчетов", "взаимных расчетов"), 5),
        (("сальдо", "дебет", "кредит", "обороты"), 3),
        (("платежное поручение", "латежное поручение"), 2),
        (("нижеподписавшиеся", "нижеподлисавшися"), 1),
    ),
    ("акт", "сверк", "заимных", "взаимных", "сальдо", "дебет", "кредит"),
)


def _any(text: Column, terms: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(t) for t in terms))


def _hits(text: Column, terms: list[str], regex: bool = False) -> Column:
    test = (lambda t: text.rlike(t)) if regex else (lambda t: text.contains(t))
    return reduce(lambda a, b: a + b, (test(t).cast("int") for t in dict.fromkeys(terms)), F.lit(0))


def scores(text: Column, signatures: Signatures, keyword: int = 1, pattern: int = 2, exclude: int = 1, prefer: Preference | None = None) -> Column:
    """array<struct<score, type>> of every type: one expression, each distinct term counts once, floor 0."""
    parts = []
    for kind, s in signatures.items():
        raw = keyword * _hits(text, s.get("keywords", [])) + pattern * _hits(text, s.get("patterns", []), True) - exclude * _hits(text, s.get("exclude", []))
        if prefer is not None and kind == prefer.kind:
            for terms, points in prefer.bonuses:
                raw = raw + F.when(_any(text, terms), points).otherwise(0)
        parts.append(F.struct(F.greatest(F.lit(0), raw).alias("score"), F.lit(kind).alias("type")))
    return F.array(*parts)


def ladder(score: Column) -> Column:
    return F.when(score >= 3, 1.0).when(score >= 2, 0.95).when(score >= 1, 0.8).otherwise(0.0)


def best(scored: Column, text: Column, prefer: Preference | None = None, unknown: str = "unknown", compat: bool = False) -> tuple[Column, Column]:
    """(type, its score). The first type of the largest score; the preferred one if it ties, or if it reaches the
    largest score, with its cue points, and has more than its least. Where nothing scores: unknown, in compat the
    preferred type, as it ties with all others."""
    top = F.array_max(F.transform(scored, lambda s: s["score"]))
    kind = F.get(F.filter(scored, lambda s: s["score"] == top), F.lit(0))["type"]
    if prefer is not None:
        own = F.coalesce(F.get(F.filter(scored, lambda s: s["type"] == prefer.kind), F.lit(0))["score"], F.lit(-1))
        ties = F.size(F.filter(scored, lambda s: s["score"] == top)) > 1
        cued = own + F.when((own > 0) & _any(text, prefer.cues), prefer.cue_points).otherwise(0)
        kind = F.when((ties & (own == top)) | ((cued >= top) & (cued > prefer.least)), prefer.kind).otherwise(kind)
    kind = kind if compat else F.when(top > 0, kind).otherwise(unknown)
    return kind, F.coalesce(F.get(F.filter(scored, lambda s: s["type"] == kind), F.lit(0))["score"], F.lit(0))


def rule_classify(docs: DataFrame, text: str = "text", signatures: Signatures | None = None, prefer: Preference | None = ACTS, compat: bool = False) -> DataFrame:
    """docs with doc_type, rule_score and confidence. Narrow; the text is normalised and scored once. Null texts are
    unknown with 0."""
    d = once(docs, __t=F.coalesce(normalize_for_classification(F.col(text)), F.lit("")))
    d = once(d, __s=scores(F.col("__t"), signatures or SIGNATURES, prefer=prefer))
    kind, score = best(F.col("__s"), F.col("__t"), prefer, compat=compat)
    d = once(d, doc_type=kind, rule_score=score)
    return d.withColumn("confidence", ladder(F.col("rule_score"))).drop("__s", "__t")


def filename_classify(files: DataFrame, name: str, signatures: Signatures | None = None) -> DataFrame:
    """By the file name: keywords count 2, patterns 3, excludes -2; confidence min(0.9, 0.5 + score / 10)."""
    d = once(files, __t=F.coalesce(F.lower(F.translate(name, "ёЁ_", "еЕ ")), F.lit("")))
    d = once(d, __s=scores(F.col("__t"), signatures or SIGNATURES, 2, 3, 2))
    kind, score = best(F.col("__s"), F.col("__t"))
    d = once(d, doc_type=kind, score=score)
    return d.withColumn("confidence", F.when(F.col("score") > 0, F.least(F.lit(0.9), 0.5 + F.col("score") / 10)).otherwise(0.0)).drop("__s", "__t")


def classify(docs: DataFrame, text: str, name: str, mode: str = "ensemble", ml: tuple[str, str] | None = None, vector: tuple[str, str] | None = None, signatures: Signatures | None = None, least: int = 10) -> DataFrame:
    """docs with doc_type, confidence, rule_score, ml_score, vector_score and explanation. A text of fewer than least
    characters goes by its file name, if that tells anything; else by the rules alone (mode rules_only) or by the
    ensemble, in which a classifier that isn't given scores 0. ml and vector: columns of type and confidence."""
    base = docs.columns
    d = filename_classify(docs, name, signatures).withColumnsRenamed({"doc_type": "__fk", "score": "__fs", "confidence": "__fc"})
    d = rule_classify(d, text, signatures).withColumnsRenamed({"doc_type": "__rk", "rule_score": "__rs", "confidence": "__rc"})
    by_name = (F.length(F.trim(F.coalesce(text, F.lit("")))) < least) & (F.col("__fs") > 0)
    zero = F.lit(0.0)
    if mode == "rules_only":
        kind, conf, m, v, why = F.col("__rk"), F.col("__rc"), zero, zero, "rules_only_mode"
    else:
        m, v = (F.coalesce(F.col(c[1]), zero) if c else zero for c in (ml, vector))
        winner, conf = ensemble(F.col("__rc"), m, v)
        unknown = F.lit("unknown")
        kinds = {"rule": F.col("__rk"), "ml": F.col(ml[0]) if ml else unknown, "vector": F.col(vector[0]) if vector else unknown}
        kind, why = F.coalesce(*[F.when(winner == k, c) for k, c in kinds.items()]), "ensemble_mode"
    pick = lambda a, b: F.when(by_name, a).otherwise(b)
    return d.select(
        *base, pick(F.col("__fk"), kind).alias("doc_type"), pick(F.col("__fc"), conf).alias("confidence"), pick(F.col("__fc"), F.col("__rc")).alias("rule_score"),
        pick(zero, m).alias("ml_score"), pick(zero, v).alias("vector_score"), pick(F.lit("filename_based"), F.lit(why)).alias("explanation"),
    )


def ensemble(rule: Column, ml: Column, vector: Column, weights: tuple[float, float, float] = (0.3, 0.3, 0.4)) -> tuple[Column, Column]:
    """(winner, confidence): vector scores over one half count one and a half times, up to 1; the first largest wins."""
    lifted = F.when(vector > 0.5, F.least(F.lit(1.0), vector * 1.5)).otherwise(vector)
    top = F.greatest(rule, ml, lifted)
    return F.when(rule == top, "rule").when(ml == top, "ml").otherwise("vector"), weights[0] * rule + weights[1] * ml + weights[2] * lifted


def stats(classified: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents, sure ones and mean confidence of each type; partial sums before the shuffle."""
    return classified.groupBy("doc_type").agg(
        F.count("*").alias("docs"), F.count_if(F.col("confidence") > least).alias("classified"), F.count_if(F.col("confidence") <= least).alias("uncertain"), F.round(F.avg("confidence"), 6).alias("avg_confidence")
    )


def detect_type(text: Column, cases: list[tuple[str, list[str]]]) -> Column:
    """The first type one of whose terms the text contains."""
    low = F.lower(text)
    return F.coalesce(*[F.when(reduce(lambda a, b: a | b, (low.contains(t) for t in terms)), kind) for kind, terms in cases])


def cosine01(a: Column, b: Column) -> Column:
    """(cos + 1) / 2 of two vectors; 0 where one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise((dot / (norm(a) * norm(b)) + 1) / 2)


def nearest_centroid(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, score): the label whose mean vector is nearest by cosine. The centroids are a table of
    labels, held side by side as one row, so no vector leaves its place."""
    size = F.posexplode(vector)
    means = vectors.where(F.col(label).isNotNull()).select(label, size.alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("m"))
    centroids = means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    one = centroids.agg(F.collect_list(F.struct(F.col(label).alias("l"), "c")).alias("cs"))  # as many as there are labels
    scored = vectors.crossJoin(F.broadcast(one)).select(key, F.transform("cs", lambda s: F.struct(F.round(cosine01(F.col(vector), s["c"]), 9).alias("score"), (-s["l"]).alias("neg"))).alias("s"))
    top = F.array_max("s")
    return scored.select(key, (-top["neg"]).alias("label"), top["score"].alias("score"))


def by_references(vectors: DataFrame, references: DataFrame, key: str, vector: str, kind: str = "kind") -> DataFrame:
    """(key, label, score): the kind whose reference vector is nearest by cosine; a kind with several takes its
    nearest. references: a small table of one row a reference text, held side by side as one row."""
    one = references.agg(F.collect_list(F.struct(F.col(kind).alias("l"), F.col(vector).alias("c"))).alias("cs"))
    scored = vectors.crossJoin(F.broadcast(one)).select(key, F.transform("cs", lambda s: F.struct(F.round(cosine01(F.col(vector), s["c"]), 9).alias("score"), s["l"].alias("label"))).alias("s"))
    top = F.array_max(F.transform("s", lambda x: x["score"]))
    first = F.array_min(F.transform(F.filter("s", lambda x: x["score"] == top), lambda x: x["label"]))
    return scored.select(key, first.alias("label"), top.alias("score"))


def train(labelled: DataFrame, text: str, label: str, key: str, features: int = 1000, sample: int = 20_000):
    """TF-IDF over words and pairs of words with logistic regression: the features most frequent terms, fitted on at
    most about sample rows drawn by a hash of the key."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, SQLTransformer, StringIndexer

    n = labelled.count()
    some = labelled.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1e6 * min(1.0, sample / max(1, n))) + 1)
    steps = [
        StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="skip", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol=text, outputCol="words", pattern=r"[^\p{L}\p{N}]+"),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__"),
        CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=features),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(labelCol="label_index", maxIter=15, regParam=0.01),
    ]
    return Pipeline(stages=steps).fit(some)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def predict(model, docs: DataFrame, key: str) -> DataFrame:
    """(key, doc_type, confidence, probability) of a fitted model; with none, unknown with 0."""
    if model is None:
        return docs.select(key, F.lit("unknown").alias("doc_type"), F.lit(0.0).alias("confidence"), F.lit(None).cast("array<double>").alias("probability"))
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    scored = PipelineModel(model.stages[1:]).transform(docs).withColumn("probability", vector_to_array("probability"))
    return scored.select(key, F.get(names, F.col("prediction").cast("int")).alias("doc_type"), F.array_max("probability").alias("confidence"), "probability")


def uncertainty(predicted: DataFrame, key: str, probability: str = "probability") -> DataFrame:
    """(key, uncertainty): 1 less the largest probability, for choosing what to label next."""
    return predicted.select(key, (1 - F.array_max(probability)).alias("uncertainty"))


def active_learning(pool: DataFrame, key: str, text: str, label: str, seed: int = 10, queries: int = 5, ask: int = 1):
    """(model, keys asked for): starts with seed rows, and asks queries times for the labels of the ask most uncertain
    rows. Only the chosen keys come to the driver; ties go by the key."""
    chosen = [r[0] for r in pool.where(F.col(label).isNotNull()).orderBy(F.xxhash64(key), key).limit(seed).select(key).collect()]
    asked: list = []
    for step in range(queries + 1):
        model = train(pool.where(F.col(key).isin(chosen)), text, label, key)
        if step == queries:
            return model, asked
        rest = pool.where(~F.col(key).isin(chosen) & F.col(label).isNotNull() & F.col(text).isNotNull())
        new = [r[0] for r in uncertainty(predict(model, rest, key), key).orderBy(F.desc("uncertainty"), key).limit(ask).collect()]
        asked, chosen = asked + new, chosen + new


def taught(labels: DataFrame, feedback: DataFrame, key: str, label: str, known: list[str]) -> DataFrame:
    """(key, label): labels, corrected by feedback of a known type; what is corrected but had no label is added. The
    model is fitted anew to the result."""
    fixed = feedback.where(F.col(label).isin(known)).select(key, F.col(label).alias("__new")).dropDuplicates([key])
    return labels.select(key, label).join(fixed, key, "full").select(key, F.coalesce("__new", label).alias(label))
