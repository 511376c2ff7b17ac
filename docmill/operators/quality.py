"""Scores of recognised text and voting between variants of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import normalize_line
from docmill.runtime import once, prepare


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def length_score(c: Column) -> Column:
    return F.least(F.lit(1.0), F.length(c) / 500)


def word_score(c: Column) -> Column:
    return F.least(F.lit(1.0), F.size(F.filter(_words(c), lambda w: F.length(w) >= 2)) / 50)


def garbage_score(c: Column) -> Column:
    """1 for no scraps: tokens of one or two letters or digits, or of up to three other signs."""
    words = _words(c)
    scraps = F.size(F.filter(words, lambda w: w.rlike(r"^([\p{L}]{1,2}|[0-9]{1,2}|[^\p{L}\p{N}_\s]{1,3})$")))
    return F.when(F.size(words) > 0, 1 - F.least(F.lit(1.0), 2.0 * scraps / F.size(words))).otherwise(0.0)


def script_score(c: Column, letters: str = "а-яА-ЯёЁ") -> Column:
    """How much of the letters is in the script expected."""
    own, every = F.length(F.regexp_replace(c, f"[^{letters}]", "")), F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    share = own / F.when(every > 0, every)
    return F.when(every == 0, 0.5).when(share > 0.7, 1.0).when(share > 0.5, 0.7).when(share > 0.3, 0.5).otherwise(0.3)


def structure_score(c: Column) -> Column:
    has = lambda p, v: F.when(c.rlike(p), v).otherwise(0.0)
    return has("[.,;:!?]", 0.3) + has("[0-9]", 0.2) + has("[A-ZА-ЯЁ]", 0.2) + has(" ", 0.3)


def quality(c: Column) -> Column:
    total = 0.20 * length_score(c) + 0.20 * word_score(c) + 0.25 * garbage_score(c) + 0.20 * script_score(c) + 0.15 * structure_score(c)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def quality_with(c: Column, likeness: Column) -> Column:
    """The score where a text to compare with is at hand; likeness as similarity() gives it."""
    total = 0.15 * length_score(c) + 0.15 * word_score(c) + 0.20 * garbage_score(c) + 0.15 * script_score(c) + 0.15 * structure_score(c) + 0.20 * likeness
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def similarity(df: DataFrame, a: str, b: str, name: str = "similarity") -> DataFrame:
    """df with the likeness of two texts up to case, blanks and punctuation: twice what stands in common blocks over
    both lengths. In Arrow batches, as no native function looks for longest blocks; null counts as empty."""
    from docmill.functions.text import normalize_for_comparison

    prepare(df.sparkSession)

    def ratio(x, y):
        from difflib import SequenceMatcher

        return float(SequenceMatcher(None, x or "", y or "").ratio())

    return df.withColumn(name, F.udf(ratio, "double", useArrow=True)(normalize_for_comparison(F.col(a)), normalize_for_comparison(F.col(b))))


def combine(variants: DataFrame, key: str, text: str, confidence: str) -> DataFrame:
    """(key, text, variants): one text of each key's variants. Empty ones are dropped, a single one is taken as it is;
    else lines are voted on and put in the order of their mean score, equal ones in the order of the variants, the best
    first. A key's variants are the few readings of one page."""
    v = variants.select(key, F.col(text).alias("text"), F.col(confidence).cast("double").alias("conf")).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    v = once(v, score=0.6 * F.col("conf") + 0.4 * quality(F.trim(F.col("text"))))
    lines = v.select(key, "text", "conf", "score", F.posexplode(F.split("text", "\n")).alias("place", "raw")).select("*", F.trim("raw").alias("line"))
    lines = once(lines, norm=normalize_line(F.col("line"))).where(F.length("line") >= 3)
    first = F.struct((-F.col("score")).alias("s"), "text", "place")
    votes = lines.groupBy(key, "norm").agg(F.count("*").alias("votes"), F.avg("conf").alias("conf"), F.round(F.avg("score"), 9).alias("score"), F.min_by("line", first).alias("line"), F.min(first).alias("first"))
    kept = votes.where((F.col("votes") >= 2) | (F.col("conf") > 0.6) | (F.col("score") > 0.7))
    joined = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "first", "line"))).alias("ls")).select(key, F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("voted"))
    whole = v.groupBy(key).agg(F.count("*").alias("variants"), F.max("text").alias("only"))
    return whole.join(joined, key, "left").select(key, F.when(F.col("variants") == 1, F.col("only")).otherwise(F.coalesce("voted", F.lit(""))).alias("text"), "variants")


def vote_lines(variants: DataFrame, key: str, text: str, confidence: Column, score: Column, least: int = 3) -> DataFrame:
    """(key, line, votes, score): one row for each line of a key's variants that is kept, by at least two
    votes or high mean confidence or score. Lines are counted before they are brought together."""
    lines = variants.select(key, confidence.alias("conf"), score.alias("score"), F.explode(F.split(text, "\n")).alias("line")).withColumn("norm", normalize_line(F.col("line"))).where(F.length("norm") >= least)
    votes = lines.groupBy(key, "norm").agg(F.count("*").alias("votes"), F.avg("conf").alias("avg_conf"), F.avg("score").alias("avg_score"), F.max_by("line", F.struct("score", "line")).alias("line"))
    return votes.where((F.col("votes") >= 2) | (F.col("avg_conf") > 0.6) | (F.col("avg_score") > 0.7)).select(key, "norm", "line", "votes", F.round("avg_score", 6).alias("score"))


def resolution(blur: Column, contrast: Column, scanned: Column) -> Column:
    """Scale at which an image is rendered for recognition."""
    return F.when((blur < 50) | (contrast < 30), 5.0).when((blur < 100) | (contrast < 50) | scanned, 4.0).when((blur < 200) | (contrast < 70), 3.0).otherwise(2.0)


def resolution_ladder(scale: Column) -> Column:
    return F.when(scale >= 4, F.array(F.lit(3.0), F.lit(4.0), F.lit(5.0))).when(scale >= 3, F.array(F.lit(2.5), F.lit(3.5), F.lit(4.0))).otherwise(F.array(scale))


def kept_ocr_lines(lines: Column, strong: float = 0.4, weak: float = 0.2) -> Column:
    """Of array<struct<text, confidence>>: strong lines and weak ones of more than one character; if none, all that aren't empty."""
    keep = F.filter(lines, lambda s: (s["confidence"] >= strong) | ((s["confidence"] >= weak) & (F.length(s["text"]) > 1)))
    return F.when(F.size(keep) > 0, keep).otherwise(F.filter(lines, lambda s: F.trim(s["text"]) != ""))


# --- decisions on images, from their measures --------------------------------------------------------


def photo_score(chars: Column, blur: Column, contrast: Column, colour_std: Column) -> Column:
    """Over one half an image is taken for a photograph."""
    return F.when(chars < 300, 0.3).otherwise(0.0) + F.when(blur < 100, 0.25).otherwise(0.0) + F.when(contrast < 50, 0.25).otherwise(0.0) + F.when(colour_std > 20, 0.2).otherwise(0.0)


def level(score: Column) -> Column:
    """How much an image is worked on: light under 35, heavy from 70."""
    return F.when(score < 35, "light").when(score < 70, "medium").otherwise("heavy")


def chains(photo: Column) -> Column:
    """The chains that are tried one after another, until one is good enough."""
    return F.when(photo, F.array(F.lit("photo"))).otherwise(F.array(F.lit("light"), F.lit("universal"), F.lit("heavy")))


def best_pass(passes: DataFrame, key: str, good: float = 0.7, sure: float = 0.75, poor: float = 0.5) -> DataFrame:
    """(key, step, text, retry) of passes (key, step, text, quality, score): the first pass that is good enough, else
    the best one; retry where even that is poor, so that the original is to be read."""
    done = (F.col("quality") > good) | (F.col("score") > sure)
    row = F.struct("step", "text", "score")
    per = passes.groupBy(key).agg(F.min_by(row, F.when(done, F.col("step"))).alias("first"), F.max_by(row, F.struct("score", (-F.col("step")).alias("s"))).alias("best"))
    return per.select(key, F.coalesce("first", "best").alias("r")).select(key, "r.step", "r.text", (F.col("r.score") < poor).alias("retry"))
