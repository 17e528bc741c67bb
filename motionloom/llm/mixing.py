"""Mixing to target weights: soft domain membership of every document, and rates that bring the token totals to target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionloom.session import staged

from .common import BROADCAST_ROWS, ascii_lower, row_key, small, words

#: The classifier's words are hashed to so many buckets: the model's size, whatever the corpus.
BUCKETS = 1 << 22
SHRINK, CLEAR = 10.0, 25.0
EVIDENCE, STEPS, CELL = 1.0, 12, 5.0
DOMAINS = ("good", "low", "toxic")
#: Production targets: shares of the tokens of the mix.
TARGETS = {"good": 0.95, "low": 0.05, "toxic": 0.0}
ITERATIONS, TOLERANCE = 25, 1e-6


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 1, "good").otherwise("low")


def buckets(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_tokens, b): the word count of each row and its distinct word buckets."""
    w = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "doc_id", words(ascii_lower(F.col("text"))).alias("w"))
    return w.select("row", "doc_id", F.size("w").cast("long").alias("n_tokens"), F.array_distinct(F.transform("w", lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)))).alias("b"))


def fit_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The naive Bayes table (bucket, w0, w1, w2): log of each domain's likelihood of a bucket against the whole's, all labelled rows counted.

    A bucket's share of a domain is drawn to the domain's share of all words by SHRINK words, so that rare
    words say little and a small domain is at no disadvantage; buckets whose counts differ from the domains' shares
    by no more than chance (chi-squared up to CLEAR) say nothing.

    Bucket -1 holds the log priors. At most BUCKETS + 1 rows, those that say nothing left out. A document with
    conflicting labels counts as its worst: toxic before low before good.
    """
    marks = staged(marked(labels), "mixing-labels")
    if marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # then only labelled texts are cut into words, and none is shuffled
        marks = F.broadcast(marks)
        docs = docs.join(marks.select("doc_id"), "doc_id", "left_semi")
    seen = buckets(docs).select("doc_id", "b").join(marks, "doc_id")
    each = seen.select(F.explode_outer(F.concat(F.array(F.lit(-1).cast("long")), "b")).alias("bucket"), "n0", "n1", "n2")
    counts = each.groupBy("bucket").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(3)])
    counts = staged(counts, "mixing-counts")
    t = counts.agg(*[F.sum(F.when(F.col("bucket") >= 0, F.col(f"n{k}"))).alias(f"t{k}") for k in range(3)], *[F.max(F.when(F.col("bucket") < 0, F.col(f"n{k}"))).alias(f"d{k}") for k in range(3)]).first()
    totals, docs_of = [t[f"t{k}"] or 0 for k in range(3)], [t[f"d{k}"] or 0 for k in range(3)]
    all_ = F.col("n0") + F.col("n1") + F.col("n2")
    share = [x / max(sum(totals), 1) for x in totals]
    off = [(F.col(f"n{k}") - all_ * share[k]) * (F.col(f"n{k}") - all_ * share[k]) / F.greatest(all_ * share[k], F.lit(1.0)) for k in range(3)]
    telling = F.greatest(*off) > CLEAR  # otherwise chance differences of many words add up
    rest = [F.log((F.col(f"n{k}") + SHRINK * share[k]) / ((all_ + SHRINK) * share[k])) if share[k] else F.lit(0.0) for k in range(3)]
    prior = [F.log((F.col(f"n{k}") + 1) / F.lit(float(sum(docs_of) + 3))) for k in range(3)]
    return counts.where((F.col("bucket") < 0) | telling).select("bucket", *[F.when(F.col("bucket") < 0, prior[k]).otherwise(rest[k]).alias(f"w{k}") for k in range(3)])


def marked(labels: DataFrame) -> DataFrame:
    """(doc_id, n0, n1, n2): 1 for the domain of each labelled document; conflicting labels count as the worst."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return marks.select("doc_id", *[(domain(F.col("quality"), F.col("toxic")) == d).cast("long").alias(f"n{k}") for k, d in enumerate(DOMAINS)])


def posteriors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, doc_id, n_tokens, p_good, p_low, p_toxic) of every document row.

    The two log-odds of the fitted table, in steps of EVIDENCE up to STEPS either way, give a cell; the labelled
    documents of each cell correct its posteriors (they weigh as CELL documents). Buckets that no labelled
    text has are left out; a text without words has the priors' log-odds; without any label the three are equal.
    """
    model = small(fit_domains(docs, labels))
    b = buckets(docs)
    each = b.select("row", F.explode_outer(F.concat(F.array(F.lit(-1).cast("long")), "b")).alias("bucket"))
    sums = each.join(model, "bucket").groupBy("row").agg(*[F.sum(f"w{k}").alias(f"s{k}") for k in range(3)], F.count(F.when(F.col("bucket") == -1, 1)).alias("times"))
    out = b.select("row", "doc_id", "n_tokens").join(sums, "row", "left").fillna(0.0, ["s0", "s1", "s2"])
    step = lambda c: F.greatest(F.lit(-STEPS), F.least(F.lit(STEPS), F.round((F.col(c) - F.col("s0")) / F.greatest(F.col("times"), F.lit(1)) / EVIDENCE).cast("int")))
    top = F.greatest("s0", "s1", "s2")
    e = [F.exp(F.col(f"s{k}") - top) for k in range(3)]
    q = [e[k] / (e[0] + e[1] + e[2]) for k in range(3)]
    out = staged(out.select("row", "doc_id", "n_tokens", step("s1").alias("low"), step("s2").alias("toxic"), *[q[k].alias(f"q{k}") for k in range(3)]), "mixing-scores")
    cells = out.join(marked(labels), "doc_id").groupBy("low", "toxic").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(3)])  # at most (2 * STEPS + 1) squared
    out = out.join(F.broadcast(cells), ["low", "toxic"], "left").fillna(0, ["n0", "n1", "n2"])
    p = [(F.col(f"n{k}") + CELL * F.col(f"q{k}")) / (F.col("n0") + F.col("n1") + F.col("n2") + CELL) for k in range(3)]
    return out.select("row", "doc_id", "n_tokens", *[p[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)])


def fit_rates(soft: DataFrame, targets: dict[str, float] = TARGETS, iterations: int = ITERATIONS) -> tuple[Column, list[float]]:
    """The rate of a document as a column over ``soft``, and the token shares reached.

    Projected gradient on 1/2 sum_k (s_k - t_k)^2 / w_k over rates r >= 0, where s_k is the share of the
    tokens n r p_k in the mix and w_k the share of domain k in the corpus. In the metric weighted by tokens the
    gradient of a document is sum_k p_k (s_k - t_k) / w_k and the step 1 converges (the scaled Hessian is a
    stochastic matrix). So a rate depends on a document's posteriors and on a few global numbers a step: no
    state is kept per document, and each step is one aggregation.
    """
    p = [F.col(f"p_{d}") for d in DOMAINS]
    n = F.col("n_tokens").cast("double")
    first = soft.agg(F.sum(n).alias("n"), *[F.sum(n * p[k]).alias(f"s{k}") for k in range(3)]).first()
    total = first["n"] or 0.0
    rate, share = F.lit(1.0), [(first[f"s{k}"] or 0.0) / total if total else 0.0 for k in range(3)]
    weight, aim = list(share), [targets[d] for d in DOMAINS]
    for _ in range(iterations if total else 0):
        gap = [(share[k] - aim[k]) / weight[k] if weight[k] > 1e-12 else 0.0 for k in range(3)]
        if max(map(abs, gap)) < TOLERANCE:
            break
        rate = F.greatest(F.lit(0.0), rate - (p[0] * gap[0] + p[1] * gap[1] + p[2] * gap[2]))
        now = soft.agg(*[F.sum(n * rate * p[k]).alias(f"s{k}") for k in range(3)]).first()
        share = [now[f"s{k}"] / total for k in range(3)]
    return rate, share


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """row, doc_id, n_tokens, the posteriors and the rate (6 decimals) at which each document enters the mix."""
    soft = staged(posteriors(docs, labels), "mixing-soft")
    rate, _ = fit_rates(soft, targets)
    return soft.withColumn("rate", F.round(rate, 6))
