"""Problem 8: mixing sources to target weights, by entropy balancing.

For each mix the rates r of the documents are as near to "every document once" as relative entropy
allows, while each source's expected tokens meet its share of the total: r = exp(a * n_tokens / m),
clipped at the source's cap, with one multiplier a for each source of each mix. The multipliers are
the maximum of the concave dual; Newton steps find it, after halving an interval while it is far, with gradient
and curvature summed by Spark over a table of (source, n_tokens) counts. The total is the tokens of
the mix's sources, or less if a capped source could not fill its share of that; a source without
documents gives its share to the others. Rates become copies by systematic rounding within buckets
of bounded size, in the order of length, so that no document exceeds its cap and the error of a
bucket stays under one document.

Defined results: documents of null or empty text count no tokens and aren't chosen; null sources are
in no mix; weights that are null or not above 0 are left out; a null cap is 1; rows of one source in a mix add
their weights and take the smallest cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docmill.llm.tokenize import token_counts
from docmill.runtime import cut, prepare

STEPS, TOLERANCE = 40, 1e-4
#: Share of a capped source's capacity that a mix may count on, as rates reach the cap only slowly.
FILL = 0.97
#: Rows of a bucket in which rates are rounded one after another, about.
BUCKET_ROWS = 20_000


def goals(targets: DataFrame, lengths: DataFrame) -> DataFrame:
    """(mix_name, source, share, cap, goal, mean): tokens each source is to give. One row a target row."""
    wanted = (
        targets.where("mix_name is not null and source is not null and weight > 0")
        .groupBy("mix_name", "source")
        .agg(F.sum("weight").alias("weight"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("cap"))
        .where("cap > 0")
    )
    have = lengths.where("n_tokens > 0").groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"), F.sum("n").alias("docs"))
    w = Window.partitionBy("mix_name")  # as many rows as the mix names sources
    return (
        wanted.join(have, "source")
        .withColumn("share", F.col("weight") / F.sum("weight").over(w))
        .withColumn("room", F.col("cap") * F.col("tokens") / F.col("share") * F.when(F.col("cap") > 1, FILL).otherwise(1.0))
        .withColumn("total", F.least(F.sum("tokens").over(w).cast("double"), F.min("room").over(w)))
        .select("mix_name", "source", "share", F.col("cap").cast("int").alias("cap"), (F.col("share") * F.col("total")).alias("goal"), (F.col("tokens") / F.col("docs")).alias("mean"))
    )


def _rate(a, n_tokens, mean, cap):
    return F.least(cap.cast("double"), F.exp(F.least(F.lit(50.0), a * n_tokens / mean)))


def multipliers(goal: DataFrame, lengths: DataFrame) -> DataFrame:
    """goal with the multiplier a of each row. The driver holds one number for each row of the targets."""
    spark = prepare(goal.sparkSession)
    goal = cut(goal)
    rows = goal.collect()  # a few rows: the targets don't grow with the corpus
    lengths = lengths.where("n_tokens > 0")
    schema = T.StructType([*goal.schema.fields, T.StructField("a", T.DoubleType())])
    a = {(r.mix_name, r.source): 0.0 for r in rows}
    low = {k: -32.0 for k in a}
    high = {k: 32.0 for k in a}

    def with_a() -> DataFrame:
        return spark.createDataFrame([(*r, a[r.mix_name, r.source]) for r in rows], schema)

    for _ in range(STEPS if rows else 0):
        j = lengths.join(F.broadcast(with_a()), "source")  # as many rows as the targets
        rate = _rate(F.col("a"), F.col("n_tokens"), F.col("mean"), F.col("cap"))
        t = F.col("n") * F.col("n_tokens")
        free = F.when(rate < F.col("cap"), rate).otherwise(0.0)
        sums = j.groupBy("mix_name", "source").agg(F.sum(t * rate).alias("got"), F.sum(t * free * F.col("n_tokens") / F.col("mean")).alias("slope"), F.first("goal").alias("goal")).collect()
        worst = 0.0
        for s in sums:
            k = (s.mix_name, s.source)
            gap = s.got - s.goal
            worst = max(worst, abs(gap) / s.goal)
            if gap > 0:
                high[k] = min(high[k], a[k])
            else:
                low[k] = max(low[k], a[k])
            step = a[k] - gap / s.slope if s.slope > 1e-12 else None
            # far from the goal, and where the step leaves the known interval, the interval is halved instead
            near = step is not None and abs(gap) < 0.3 * s.goal and low[k] < step < high[k]
            a[k] = step if near else (low[k] + high[k]) / 2
        if worst < TOLERANCE:
            break
    return with_a()


def mix(docs: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(mix_name, source, doc_id, n_tokens, repeats): the chosen documents of each mix."""
    prepare(docs.sparkSession)
    sized = cut(token_counts(docs.where("source is not null and text is not null"), ["doc_id", "source"], vocabulary=vocabulary).where("n_tokens > 0"))
    lengths = cut(sized.groupBy("source", "n_tokens").agg(F.count("*").alias("n")))
    m = multipliers(goals(targets, lengths), lengths)
    buckets = lengths.groupBy("source").agg(F.ceil(F.sum("n") / BUCKET_ROWS).alias("buckets"))
    rated = (
        sized.join(F.broadcast(m), "source")
        .join(F.broadcast(buckets.join(F.broadcast(m.select("source").distinct()), "source")), "source")  # no more rows than targets
        .select("mix_name", "source", "doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id"), F.col("buckets")).alias("bucket"), _rate(F.col("a"), F.col("n_tokens"), F.col("mean"), F.col("cap")).alias("rate"))
    )
    w = Window.partitionBy("mix_name", "source", "bucket").orderBy("n_tokens", F.xxhash64("doc_id", "mix_name"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.round(F.sum("rate").over(w) + 0.5, 9)
    return rated.withColumn("upto", upto).select("mix_name", "source", "doc_id", "n_tokens", (F.floor("upto") - F.floor(F.round(F.col("upto") - F.col("rate"), 9))).cast("int").alias("repeats")).where("repeats > 0")


def shares(docs: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(mix_name, source, target_share, actual_share, documents, tokens, most_repeats, cap): a row for each
    source a mix names, also those without documents."""
    chosen = mix(docs, targets, vocabulary)
    got = chosen.groupBy("mix_name", "source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    wanted = targets.where("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.sum("weight").alias("weight"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("cap"))
    w = Window.partitionBy("mix_name")
    out = wanted.join(got, ["mix_name", "source"], "left").fillna(0, ["documents", "tokens", "most_repeats"])
    return out.select(
        "mix_name", "source", (F.col("weight") / F.sum("weight").over(w)).alias("target_share"), F.try_divide(F.col("tokens"), F.sum("tokens").over(w)).alias("actual_share"),
        "documents", "tokens", "most_repeats", "cap",
    )
