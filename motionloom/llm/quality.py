"""Quality rules with certified cutoffs: labelled documents bound how often a rule may reject a good one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionloom.session import staged

from .common import BROADCAST_ROWS, SPACES, UPPER, let, small, words

SYMBOLS = "#*$%&|<>"
#: Share of good documents that all rules together may reject in a stratum, and the chance that a stratum's bound fails anywhere.
RISK, ERROR = 0.05, 0.05
#: Each rule rejects above its cutoff; cutoffs are tried from the first to the last, fixed before the labels are seen.
RULES: dict[str, list[float]] = {
    "symbol_ratio": [2.0, 1.0, 0.5, 0.25, 0.1, 0.05],
    "dup_line_ratio": [0.9, 0.7, 0.5, 0.3, 0.2, 0.1],
    "repeat_ratio": [0.45, 0.4, 0.35, 0.3, 0.25, 0.2],
    "upper_ratio": [0.9, 0.7, 0.5, 0.3, 0.2],
    "long_words": [20.0, 15.0, 12.0, 10.0],
}


def repeat_words(ws: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text."""

    def among(w):
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.slice(w, i, 3)))

        def count(g):
            pairs = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))

            def covered(p):
                same = lambda a, b: (b >= 0) & (b < F.size(p)) & (F.get(p, b)["g"] == a["g"])
                again = F.filter(p, lambda a, j: same(a, j - 1) | same(a, j + 1))
                return F.size(F.array_distinct(F.flatten(F.transform(again, lambda a: F.array(a["i"], a["i"] + 1, a["i"] + 2)))))

            return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(pairs, covered))

        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(grams, count))

    return let(ws, among).cast("long")


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, stratum, ``keep`` and the counts and ratios of every text that the rules use.

    A null text has no words; a null ``lang`` is the empty stratum. Ratios of an empty text are 0.
    Native expressions only: one pass, no shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("stratum"), text.alias("t"), *keep)
    out = out.select("doc_id", "stratum", "t", words(F.col("t")).alias("w"), *keep)
    blank = lambda c: F.length(F.translate(c, SPACES, ""))
    lines = F.filter(F.split("t", "\n"), lambda x: blank(x) > 0)
    out = out.select(
        "doc_id", "stratum", F.size("w").cast("long").alias("n_words"), blank(F.col("t")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(F.translate("t", UPPER, ""))).cast("long").alias("n_upper"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        repeat_words(F.col("w")).alias("n_repeat_words"), *keep,
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    out = out.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_upper", "l.n_lines", "l.n_dup_lines", "n_repeat_words", *keep)
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.select(
        "*", ratio("n_symbols", "n_words").alias("symbol_ratio"), ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeat_ratio"), ratio("n_upper", "word_chars").alias("upper_ratio"), ratio("word_chars", "n_words").alias("long_words"),
    )


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1 to about 1e-11: Stirling's series at x + 8, brought down by recurrence."""
    y = x + 8
    down = F.log(x * (x + 1) * (x + 2) * (x + 3)) + F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - down


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), or 1 where k is at least the mean.

    ``<= e`` holds exactly when the upper Clopper-Pearson bound at error e is at most p. Terms are summed
    downwards from k, over 12 standard deviations and 60 terms; the rest is bounded by a geometric series and added.
    """
    k, n = k.cast("double"), n.cast("double")
    first = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    steps = F.least(k, F.ceil(12 * F.sqrt(n)) + 60).cast("int")
    ratio = lambda i: i * (1 - p) / ((n - i + 1) * p)
    start = F.struct(first.alias("sum"), first.alias("term"), k.alias("i"))
    total = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), start,
        lambda a, _: F.struct((a["sum"] + a["term"] * ratio(a["i"])).alias("sum"), (a["term"] * ratio(a["i"])).alias("term"), (a["i"] - 1).alias("i")),
        lambda a: a["sum"] + F.when((a["i"] > 0) & (ratio(a["i"]) < 1), a["term"] * ratio(a["i"]) / (1 - ratio(a["i"]))).otherwise(F.lit(0.0)),
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(total)


def certified_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The strictest certified cutoff of each rule: one row per stratum, one column per rule (null: the rule is off).

    ``measured`` holds ``features`` rows. Labelled documents of quality 1 that pass the base rules are the
    holdout: no rule was fitted on them. In each stratum each rule walks its cutoffs in their fixed order and
    stops at the first for which the exact binomial bound on its false rejections exceeds ``risk`` divided by
    the rules. The error is divided by rules and strata (Bonferroni); walking in fixed order needs no more.
    All rules together then reject at most ``risk`` of the good documents of any stratum, with 1 - ``error``.
    Repeated labels of a document count once, as good only if all are; a stratum without labels gets no row.
    """
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("good"))
    held = measured.where(~F.col("base_failed")).join(good.where("good = 1").select("doc_id"), "doc_id")
    sums = [F.sum((F.col(r) > c).cast("long")).alias(f"{r}_{i}") for r, cuts in RULES.items() for i, c in enumerate(cuts)]
    counts = staged(held.groupBy("stratum").agg(F.count("*").alias("n"), *sums), "quality-counts")
    per_test = error / len(RULES) / max(1, counts.count())
    tests = [F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cut"), F.col(f"{r}_{i}").alias("k")) for r, cuts in RULES.items() for i, c in enumerate(cuts)]
    each = counts.select("stratum", "n", F.inline(F.array(*tests)))
    each = each.withColumn("passed", binomial_tail(F.col("k"), F.col("n"), risk / len(RULES)) <= per_test)
    first_failure = F.min(F.when(~F.col("passed"), F.col("step")))
    chosen = each.groupBy("stratum", "rule").agg(first_failure.alias("stop"), F.collect_list(F.struct("step", "cut")).alias("cuts"))
    cut = F.array_max(F.filter("cuts", lambda x: F.col("stop").isNull() | (x["step"] < F.col("stop"))))["cut"]  # the last step before the first failure
    chosen = chosen.select("stratum", "rule", cut.alias("cut"))
    return chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cut"))).alias(f"cut_{r}") for r in RULES])


def verdicts(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measured`` with kept: false if the base rules fail or a certified cutoff of the stratum is exceeded."""
    cutoffs = small(cutoffs.withColumnRenamed("stratum", "__stratum"))
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return measured.join(cutoffs, F.col("stratum") == F.col("__stratum"), "left").withColumn("kept", ~F.col("base_failed") & ~over).drop("__stratum", *[f"cut_{r}" for r in RULES])


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Features and verdict of every document row. The features are written once, for counting and for judging."""
    measured = staged(features(docs), "quality-features")
    return verdicts(measured, certified_cutoffs(measured, labels, risk, error))


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns. Texts are not shuffled: they are measured where they are read."""
    cols = docs.columns
    ids = labels.where("quality = 1").select("doc_id").distinct()
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # then only their texts need measuring
    labelled = docs.join(F.broadcast(ids), "doc_id", "left_semi") if few else docs
    cutoffs = certified_cutoffs(features(labelled), labels, risk, error)
    whole = docs.select("doc_id", "lang", "text", F.struct(*[F.col(c) for c in cols]).alias("__row"))
    return verdicts(features(whole, "__row"), cutoffs).where("kept").select("__row.*")
