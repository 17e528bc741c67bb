"""Statistics over feature tables and leakage-free evaluation.

Class vocabularies are catalogs (tens of names); rows, groups and subjects may grow without bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .joins import class_pairs
from .ordered import BLOCK_ROWS, Scan, block_scan, exact_percentile, in_ranges, number_rows, one_row, spread_join


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach a one-row table to every row, spread over tasks."""
    return spread_join(df.withColumn("_one", F.lit(0)), one.withColumn("_one", F.lit(0)), ["_one"]).drop("_one")


def class_means(df: DataFrame, label: str, feats: list[str]) -> DataFrame:
    return df.groupBy(label).agg(*[F.avg(f).alias(f) for f in feats])


def effect_size(df: DataFrame, is_a: Column, is_b: Column, feats: list[str]) -> DataFrame:
    """Standardised mean difference per feature; below two values NULL, a flat pair 0."""
    long = df.select(F.when(is_a, 1).when(is_b, 0).alias("_s"), *feats).filter("_s IS NOT NULL").unpivot(["_s"], feats, "feature", "_v")
    a, b = F.when(F.col("_s") == 1, F.col("_v")), F.when(F.col("_s") == 0, F.col("_v"))
    g = long.groupBy("feature").agg(F.count(a).alias("_na"), F.count(b).alias("_nb"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
                                    F.var_samp(a).alias("_va"), F.var_samp(b).alias("_vb"))
    c = F.col
    pooled = F.sqrt(((c("_na") - 1) * c("_va") + (c("_nb") - 1) * c("_vb")) / (c("_na") + c("_nb") - 2))
    eff = F.when((c("_na") >= 2) & (c("_nb") >= 2), F.when(pooled > 1e-12, (c("mean_a") - c("mean_b")) / pooled).otherwise(0.0))
    return g.select("feature", "mean_a", "mean_b", eff.alias("effect_size"), F.abs(eff).alias("abs_effect"))


def _moments(df: DataFrame, feats: list[str]) -> DataFrame:
    return df.agg(*[F.avg(f).alias(f"_m_{f}") for f in feats], *[F.stddev_samp(f).alias(f"_s_{f}") for f in feats])


def centroid_distance(df: DataFrame, label: str, feats: list[str]) -> DataFrame:
    """RMS distance of the z-scored class centroids for each pair of classes."""
    means = with_row(class_means(df, label, feats), _moments(df, feats))
    z = lambda f: (F.col(f) - F.col(f"_m_{f}")) / F.when(F.col(f"_s_{f}") == 0, 1.0).otherwise(F.col(f"_s_{f}"))
    centers = means.select(label, *[z(f).alias(f) for f in feats])
    p = class_pairs(centers, label, feats)
    sq = [F.pow(F.col(f"{f}_a") - F.col(f"{f}_b"), 2) for f in feats]
    total = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0.0)) for s in sq])
    n = reduce(lambda a, b: a + b, [s.isNotNull().cast("int") for s in sq])
    return p.select(f"{label}_a", f"{label}_b", F.sqrt(total / n).alias("distance"))


def class_support(df: DataFrame, label: str, subject: str, session: str) -> DataFrame:
    one = lambda c, n: df.groupBy(label, c).agg(F.lit(1).alias("_o")).groupBy(label).agg(F.count(c).alias(n))
    return one(subject, "subjects").join(one(session, "sessions"), label).withColumn("singleton", F.col("sessions") < 2)


def metrics_by_dim(df: DataFrame, dim: str, group: str, actual: str, predicted: str, prob: str) -> DataFrame:
    g = df.groupBy(dim, group).agg(F.count(F.lit(1)).alias("_n"), F.min(actual).alias("_a"), F.sum((F.col(actual) == F.col(predicted)).cast("int")).alias("_ok"), F.sum(prob).alias("_p"))
    return g.groupBy(dim).agg(F.sum("_n").alias("windows"), F.count(group).alias("sessions"), F.min("_a").alias("actual"),
                              (F.sum("_ok") / F.sum("_n")).alias("accuracy"), (F.sum("_p") / F.sum("_n")).alias("mean_probability"))


def action_contrast(df: DataFrame, person: str, action: str, a, b, feats: list[str]) -> DataFrame:
    """Per feature: each person's median difference of two actions, and whether all signs agree (two people at least)."""
    long = df.unpivot([person, action], feats, "feature", "_v")
    m = exact_percentile(long, ["feature", person, action], "_v", {"m": 0.5}).groupBy("feature", person).agg(
        F.max(F.when(F.col(action) == a, F.col("m"))).alias("_a"), F.max(F.when(F.col(action) == b, F.col("m"))).alias("_b"))
    d = m.withColumn("difference", F.col("_a") - F.col("_b")).filter("difference IS NOT NULL")
    s = d.groupBy("feature").agg(F.count(F.lit(1)).alias("_p"), F.min(F.signum("difference")).alias("_lo"), F.max(F.signum("difference")).alias("_hi"))
    return spread_join(d.select("feature", person, "difference"), s, ["feature"]).select(
        "feature", person, "difference", ((F.col("_p") >= 2) & (F.col("_lo") == F.col("_hi"))).alias("direction_consistent"))


def finite(f: str) -> Column:
    return F.when(F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(f) != float("inf")), F.col(f))


def scaler(df: DataFrame, feats: list[str]) -> DataFrame:
    """One row: median of the finite values, then mean and population std after filling with it."""
    clean = df.select(*[finite(f).alias(f) for f in feats])
    med = exact_percentile(clean.unpivot([], feats, "_f", "_v"), ["_f"], "_v", {"m": 0.5}).agg(
        *[F.max(F.when(F.col("_f") == f, F.col("m"))).alias(f"_med_{f}") for f in feats])
    # mean and std follow from sums over the finite values plus the number of filled rows
    n = F.count(F.lit(1))
    fill = lambda f: n - F.count(f)
    sums = clean.agg(n.alias("_n"), *[fill(f).alias(f"_k_{f}") for f in feats], *[F.avg(f).alias(f"_a_{f}") for f in feats], *[F.var_pop(f).alias(f"_v_{f}") for f in feats])
    one, out = one_row(med, sums), {}
    for f in feats:
        k, total, a, m = F.col(f"_k_{f}"), F.col("_n"), F.col(f"_a_{f}"), F.col(f"_med_{f}")
        mean = (a * (total - k) + m * k) / total
        var = ((F.col(f"_v_{f}") + F.pow(a - mean, 2)) * (total - k) + F.pow(m - mean, 2) * k) / total
        out[f"_mean_{f}"], out[f"_sd_{f}"] = mean, F.sqrt(var)
    return one.withColumns(out).select(*[f"_{p}_{f}" for f in feats for p in ("med", "mean", "sd")])


def impute_standardize(df: DataFrame, feats: list[str]) -> DataFrame:
    """z-scored features: median for non-finite values, population std (1 where it vanishes)."""
    z = lambda f: (F.coalesce(finite(f), F.col(f"_med_{f}")) - F.col(f"_mean_{f}")) / F.when(F.col(f"_sd_{f}") < 1e-12, 1.0).otherwise(F.col(f"_sd_{f}"))
    out = with_row(df, scaler(df, feats)).withColumns({f: z(f) for f in feats})
    return out.drop(*[f"_{p}_{f}" for f in feats for p in ("med", "mean", "sd")])


def group_weights(df: DataFrame, y: str, group: str, out: str = "weight") -> DataFrame:
    """Equal weight per group, then per class, mean one."""
    n = df.groupBy(group).agg(F.count(F.lit(1)).alias("_g"))
    d = spread_join(df, n, [group]).withColumn("_w", 1.0 / F.col("_g"))
    c = d.groupBy(y).agg(F.sum("_w").alias("_c"), F.count(F.lit(1)).alias("_r"))
    total = c.agg(F.count(F.lit(1)).alias("_k"), F.sum("_r").alias("_n"))
    return with_row(spread_join(d, c.drop("_r"), [y]), total).withColumn(out, F.col("_w") / F.col("_c") * F.col("_n") / F.col("_k")).drop("_g", "_w", "_c", "_k", "_n")


def group_folds(df: DataFrame, y: str, group: str, k: int, seed: int = 0) -> DataFrame:
    """Fold of each group: groups of a class in hash order, dealt round-robin."""
    g = df.groupBy(group).agg(F.min(y).alias(y)).withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"))))
    return number_rows(g, [y], ["_h", group], F.substring("_h", 1, 2), "_i").select(group, (F.col("_i") % k).alias("fold"))


def logistic_score(df: DataFrame, feats: list[str], model: dict, out: str = "probability") -> DataFrame:
    """Apply a standardised logistic model given as plain numbers per feature."""
    z = F.lit(float(model["intercept"]))
    for i, f in enumerate(feats):
        v = F.col(f)
        filled = F.when(v.isNotNull() & ~F.isnan(f), v).otherwise(model["median"][i])
        z = z + (filled - model["mean"][i]) / model["scale"][i] * model["coefficients"][i]
    return df.withColumn(out, 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z)))))


def group_vote(df: DataFrame, group: str, y: str, prob: str) -> DataFrame:
    g = df.groupBy(group).agg(F.min(y).alias("actual"), F.avg(prob).alias("probability"))
    return g.withColumn("predicted", (F.col("probability") >= 0.5).cast("int"))


def binary_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    n = lambda a, b: F.count_if((F.col(y) == a) & (F.col(p) == b))
    g = df.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(0, 0).alias("tn"), n(1, 0).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    safe = lambda a, b: a / F.greatest(F.lit(1), b)
    r1, r0 = F.when(tp + fn > 0, tp / (tp + fn)), F.when(tn + fp > 0, tn / (tn + fp))
    both = r1.isNotNull() & r0.isNotNull()
    return g.withColumns({"accuracy": (tp + tn) / (tp + fp + tn + fn), "balanced_accuracy": F.when(both, (r1 + r0) / 2).otherwise(F.coalesce(r1, r0)),
                          "precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn), "specificity": safe(tn, tn + fp)})


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Rank-average AUC. Equal scores are counted first; running counts go over score blocks."""
    s = df.groupBy(F.col(score).alias("_s")).agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) != 1).alias("_q")).withColumn("_all", F.lit(0))
    c = block_scan(s, ["_all"], ["_s"], F.floor(F.col("_s") * 4096), [Scan("_below", F.col("_q"), "sum", inclusive=False)])
    g = c.agg(F.sum("_p").alias("positives"), F.sum("_q").alias("negatives"), F.sum(F.col("_p") * (F.coalesce("_below", F.lit(0)) + F.col("_q") / 2)).alias("_u"))
    return g.select("positives", "negatives", F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("_u") / (F.col("positives") * F.col("negatives"))).alias("roc_auc"))


def loro_nearest_centroid(df: DataFrame, group: str, label: str, feats: list[str], keep: list[str]) -> DataFrame:
    """Leave-one-group-out nearest centroid in one pass.

    The statistics without a group are the totals minus the group's own sums (taken about the global
    mean, so nothing cancels). Classes unseen in training are skipped, as are groups that leave
    fewer than two classes.
    """
    centre = df.agg(*[F.avg(f).alias(f"_c_{f}") for f in feats])
    d = with_row(df.select(group, label, *keep, *feats), centre).withColumns({f: F.col(f) - F.col(f"_c_{f}") for f in feats}).drop(*[f"_c_{f}" for f in feats])
    sums = [x for f in feats for x in (F.count(f).alias(f"_n_{f}"), F.coalesce(F.sum(f), F.lit(0.0)).alias(f"_s_{f}"), F.coalesce(F.sum(F.col(f) * F.col(f)), F.lit(0.0)).alias(f"_q_{f}"))]
    names = [f"_{p}_{f}" for f in feats for p in "nsq"]
    gc = d.groupBy(group, label).agg(F.count(F.lit(1)).alias("_rows"), *sums)
    add = lambda by: gc.groupBy(*by).agg(F.sum("_rows").alias("_rows"), *[F.sum(n).alias(n) for n in names])
    pack = F.struct(F.col(label).alias("label"), "_rows", *names)
    per_class = add([label]).agg(F.sort_array(F.collect_list(pack)).alias("_classes"))  # one entry per class of the catalog
    own = gc.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct(F.col(label).alias("k"), pack.alias("v")))).alias("_own"))
    total = gc.agg(*[F.sum(n).alias(f"_t{n}") for n in names])
    g = with_row(with_row(add([group]).drop("_rows").join(own, group), per_class), total)
    scale = {}
    for f in feats:
        n, s, q = (F.col(f"_t_{p}_{f}") - F.col(f"_{p}_{f}") for p in "nsq")
        mean, var = s / n, (q - s * s / n) / (n - 1)
        sd = F.sqrt(F.greatest(var, F.lit(0.0)))
        scale[f"_mean_{f}"], scale[f"_sd_{f}"] = mean, F.when((sd > 0) & (n > 1), sd).otherwise(1.0)
    g = g.withColumns(scale)

    def center(c: Column) -> Column:
        mine = F.element_at(F.col("_own"), c["label"])
        less = lambda x, zero: c[x] - F.coalesce(mine[x], F.lit(zero))
        value = lambda f: F.when(less(f"_n_{f}", 0) > 0, (less(f"_s_{f}", 0.0) / less(f"_n_{f}", 0) - F.col(f"_mean_{f}")) / F.col(f"_sd_{f}"))
        return F.struct(c["label"].alias("label"), (c["_rows"] - F.coalesce(mine["_rows"], F.lit(0))).alias("rows"), F.array(*[value(f) for f in feats]).alias("at"))

    g = g.withColumn("_centers", F.filter(F.transform("_classes", center), lambda c: c["rows"] > 0))
    g = g.filter(F.size("_centers") >= 2).select(group, "_centers", *scale)
    t = spread_join(d, g, [group], "inner")
    z = F.array(*[(F.col(f) - F.col(f"_mean_{f}")) / F.col(f"_sd_{f}") for f in feats])
    t = t.withColumn("_z", z).filter(F.exists("_centers", lambda c: c["label"] == F.col(label)))
    dist = F.transform("_centers", lambda c: F.struct(
        F.aggregate(F.zip_with(F.col("_z"), c["at"], lambda a, b: F.coalesce((a - b) * (a - b), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v).alias("d"), c["label"].alias("label")))
    return t.select(group, *keep, F.col(label).alias("actual"), F.array_min(dist)["label"].alias("predicted"))


def median_without(df: DataFrame, group: str, feats: list[str], parts: int | None = None) -> DataFrame:
    """Median of each feature over all other groups, one row per (feature, group).

    All values share one order. Left out, a group's own values below the wanted rank push it up by
    their number: those with at most that many others before them. So every group asks for one or two positions of the
    shared order, and a running scan over values and questions answers all of them: the work is linear
    in values and groups. A group that holds all values has no row.
    """
    long = df.select(group, *feats).unpivot([group], feats, "_f", "_v").filter("_v IS NOT NULL")
    v = in_ranges(long.groupBy("_f", group, "_v").agg(F.count(F.lit(1)).alias("_k")), ["_f", "_v", group], parts)
    before = lambda d, key, order, out: block_scan(d, key, order, F.col("_bin"), [Scan(out, F.col("_k"), "sum", inclusive=False)]).withColumn(out, F.coalesce(out, F.lit(0)))
    placed = staged(before(before(v, ["_f"], ["_v", group], "_pos"), ["_f", group], ["_v"], "_mine").drop("_bin"), "placed")
    who = placed.groupBy("_f", group).agg(F.sum("_k").alias("_own"))
    rest = spread_join(who, who.groupBy("_f").agg(F.sum("_own").alias("_n")), ["_f"]).withColumn("_n", F.col("_n") - F.col("_own")).filter("_n > 0")
    lo, hi = F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)
    pushed = lambda rank: rank + F.sum(F.when(F.col("_pos") - F.col("_mine") <= rank, F.col("_k")).otherwise(0))
    asked = spread_join(placed, rest.select("_f", group, lo.alias("_lo"), hi.alias("_hi")), ["_f", group], "inner").groupBy("_f", group, "_lo", "_hi").agg(
        F.array(pushed(F.col("_lo")), pushed(F.col("_hi"))).alias("_at"))
    asked = asked.select("_f", group, F.posexplode("_at").alias("_ask", "_pos"))
    both = placed.select("_f", group, "_pos", "_v", F.lit(-1).alias("_ask")).unionByName(asked.withColumn("_v", F.lit(None).cast(dict(placed.dtypes)["_v"])))
    told = block_scan(both, ["_f"], ["_pos", "_ask", group], F.floor(F.col("_pos") / BLOCK_ROWS), [Scan("_found", F.col("_v"), "last")])
    return told.filter("_ask >= 0").groupBy(F.col("_f").alias("feature"), group).agg(F.avg("_found").alias("median"))


def lopo_two_action(df: DataFrame, person: str, action: str, a, b, feats: list[str]) -> DataFrame:
    """Leave-one-person-out nearest centroid of two actions: recalls and balanced accuracy per person.

    Centred on the training median, scaled by the population std of the others (totals minus own
    sums). Needs rows without missing features.
    """
    med = median_without(df, person, feats).groupBy(person).agg(*[F.max(F.when(F.col("feature") == f, F.col("median"))).alias(f"_m_{f}") for f in feats])
    centre = df.agg(*[F.avg(f).alias(f"_c_{f}") for f in feats])
    d = with_row(df.select(person, action, *feats), centre)
    d = d.withColumns({f"_x_{f}": F.col(f) - F.col(f"_c_{f}") for f in feats})
    sums = [x for f in feats for x in (F.sum(f"_x_{f}").alias(f"_s_{f}"), F.sum(F.col(f"_x_{f}") * F.col(f"_x_{f}")).alias(f"_q_{f}"))]
    pa = d.groupBy(person, action).agg(F.count(F.lit(1)).alias("_n"), *sums)
    cols = ["_n"] + [f"_{p}_{f}" for f in feats for p in "sq"]
    side = lambda s, v: [F.coalesce(F.sum(F.when(F.col(action) == v, F.col(c))), F.lit(0)).alias(f"{c}{s}") for c in cols]
    own = pa.groupBy(person).agg(*side("_1", a), *side("_2", b))
    tot = pa.agg(*side("_t1", a), *side("_t2", b))
    g = with_row(own, tot)
    c, out = F.col, {}
    n1, n2 = c("_n_t1") - c("_n_1"), c("_n_t2") - c("_n_2")
    for f in feats:
        s1, s2 = c(f"_s_{f}_t1") - c(f"_s_{f}_1"), c(f"_s_{f}_t2") - c(f"_s_{f}_2")
        q = c(f"_q_{f}_t1") - c(f"_q_{f}_1") + c(f"_q_{f}_t2") - c(f"_q_{f}_2")
        n = n1 + n2
        sd = F.sqrt(F.greatest(q / n - F.pow((s1 + s2) / n, 2), F.lit(0.0)))
        out[f"_sd_{f}"] = F.when(sd < 1e-9, 1.0).otherwise(sd)
        out[f"_k1_{f}"], out[f"_k2_{f}"] = s1 / n1, s2 / n2
    g = with_row(g.withColumns(out).select(person, *out).join(med, person), centre)
    t = spread_join(df.select(person, action, *feats), g, [person], "inner")
    zed = lambda f: (c(f) - c(f"_m_{f}")) / c(f"_sd_{f}")
    mid = lambda k, f: (c(f"_k{k}_{f}") + c(f"_c_{f}") - c(f"_m_{f}")) / c(f"_sd_{f}")
    dist = lambda k: reduce(lambda x, y: x + y, [F.pow(zed(f) - mid(k, f), 2) for f in feats])
    t = t.withColumn("_p", F.when(dist(1) <= dist(2), F.lit(a)).otherwise(F.lit(b)))
    rec = lambda v: F.avg(F.when(c(action) == v, (c("_p") == v).cast("double")))
    r = t.groupBy(person).agg(F.count(F.lit(1)).alias("windows"), rec(a).alias("recall_a"), rec(b).alias("recall_b"))
    return r.withColumn("balanced_accuracy", (c("recall_a") + c("recall_b")) / 2)


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts and row shares in long form."""
    n = df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))
    t = n.groupBy(actual).agg(F.sum("n").alias("_t"))
    return n.join(t, actual).select(actual, predicted, "n", (F.col("n") / F.col("_t")).alias("share"))


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """precision, recall, F1, support per class, and rows for accuracy and the two macro means."""
    n = df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))
    tp = F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0)
    a = n.groupBy(F.col(actual).cast("string").alias("label")).agg(F.sum("n").alias("support"), F.sum(tp).alias("_tp"))
    p = n.groupBy(F.col(predicted).cast("string").alias("label")).agg(F.sum("n").alias("_pred"))
    j = a.join(p, "label", "full").fillna(0)
    c = F.col
    j = j.withColumns({"precision": F.when(c("_pred") > 0, c("_tp") / c("_pred")).otherwise(0.0), "recall": F.when(c("support") > 0, c("_tp") / c("support")).otherwise(0.0)})
    j = j.withColumn("f1", F.when(c("precision") + c("recall") > 0, 2 * c("precision") * c("recall") / (c("precision") + c("recall"))).otherwise(0.0))
    per = j.select("label", "precision", "recall", "f1", "support")
    none = F.lit(None).cast("double")
    s = j.agg((F.sum("_tp") / F.sum("support")).alias("acc"), F.avg("f1").alias("all"), F.avg(F.when(c("support") > 0, c("f1"))).alias("present"), F.sum("support").alias("support"))
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), c(y).alias("f1")) for x, y in (("_accuracy", "acc"), ("_macro_f1", "all"), ("_macro_f1_present", "present"))]))
    return per.unionByName(s.select("support", rows.alias("_r")).select(c("_r.label").alias("label"), none.alias("precision"), none.alias("recall"), c("_r.f1").alias("f1"), "support"))


def rare_class_collapse(df: DataFrame, activity: str, motion: str, subject: str, minimum: int = 5) -> DataFrame:
    support = df.groupBy(activity, subject).agg(F.lit(1).alias("_o")).groupBy(activity).agg(F.count(subject).alias("_sub"))
    d = spread_join(df, support, [activity])
    return d.withColumn("action_id", F.when(F.col(motion) == "non_motion", "other_non_motion").when(
        (F.col("_sub") < minimum) & (F.col(motion) == "motion"), "other_motion").otherwise(F.col(activity).cast("string"))).drop("_sub")


def _candidates(subjects: DataFrame, subject: str, share: float, candidates: int, seed: int) -> DataFrame:
    """(candidate, subject) rows of random holdouts: the first subjects in each candidate's hash order."""
    n = subjects.agg(F.count(F.lit(1)).alias("_s"))
    take = F.least(F.col("_s") - 1, F.greatest(F.lit(1), F.bround(F.col("_s") * share, 0))).cast("long")
    s = with_row(subjects, n).withColumn("_take", F.when(F.col("_s") < 3, F.raise_error(F.lit("a subject split needs at least three subjects")).cast("long")).otherwise(take))
    s = s.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1)))).withColumn("_h", F.xxhash64(F.lit(seed), "candidate", subject))
    return number_rows(s, ["candidate"], ["_h", subject], F.shiftright("_h", 60), "_i").filter("_i < _take").select("candidate", subject)


def subject_holdout(df: DataFrame, subject: str, label: str, share: float, candidates: int = 4096, seed: int = 7) -> DataFrame:
    """Subjects of the best holdout: training keeps every class; then most classes held, then closest class shares."""
    cell = df.groupBy(subject, label).agg(F.count(F.lit(1)).alias("_k"))
    glob = cell.groupBy(label).agg(F.sum("_k").alias("_kt"), F.count(F.lit(1)).alias("_subs"))
    size = glob.agg(F.sum("_kt").alias("_all"), F.count(F.lit(1)).alias("_classes"), F.count_if(F.col("_subs") >= 2).alias("_feasible"))
    held = _candidates(cell.select(subject).distinct(), subject, share, candidates, seed)
    h = held.join(cell, subject).groupBy("candidate", label).agg(F.sum("_k").alias("_kh"), F.count(F.lit(1)).alias("_sh"))
    tot = h.groupBy("candidate").agg(F.sum("_kh").alias("_hall"))
    j = with_row(spread_join(h, glob, [label]).join(tot, "candidate"), size)
    c = F.col
    ok2 = c("_subs") >= 2
    err = F.when(ok2, F.abs(c("_kh") / c("_hall") - c("_kt") / c("_all")) - c("_kt") / c("_all")).otherwise(0.0)
    s = j.groupBy("candidate").agg(F.count_if(c("_sh") == c("_subs")).alias("_lost"), F.count_if(ok2).alias("coverage"), F.sum(err).alias("_e"))
    base = with_row(glob, size).agg(F.sum(F.when(ok2, c("_kt") / c("_all")).otherwise(0.0)).alias("_b"))
    best = with_row(s.filter("_lost = 0"), base).agg(F.max_by("candidate", F.struct("coverage", -F.round(c("_e") + c("_b"), 12), -c("candidate"))).alias("candidate"))
    return held.join(found(best, "no candidate holdout keeps every class in training"), "candidate").select(subject)


def found(best: DataFrame, message: str) -> DataFrame:
    """The chosen candidate, or an error where there is none: a split must not be silently empty."""
    return best.select(F.coalesce(F.col("candidate"), F.raise_error(F.lit(message)).cast("int")).alias("candidate"))


def three_way_split(df: DataFrame, subject: str, label: str, candidates: int = 4096, seed: int = 7) -> DataFrame:
    test = staged(subject_holdout(df, subject, label, 0.15, candidates, seed), "holdout")
    rest = df.join(test, subject, "left_anti")
    val = subject_holdout(rest, subject, label, 0.1765, candidates, seed + 1)
    marks = test.withColumn("split", F.lit("test")).unionByName(val.withColumn("split", F.lit("validation")))
    return spread_join(df, marks, [subject]).withColumn("split", F.coalesce("split", F.lit("train")))


def class_cover_split(df: DataFrame, subject: str, label: str, candidates: int = 200, share: float = 0.25, seed: int = 7) -> DataFrame:
    """First of the random subject splits where both sides hold every class."""
    cell = df.groupBy(subject, label).agg(F.count(F.lit(1)).alias("_k"))
    glob = cell.groupBy(label).agg(F.count(F.lit(1)).alias("_subs"))
    n = glob.agg(F.count(F.lit(1)).alias("_classes"))
    held = _candidates(cell.select(subject).distinct(), subject, share, candidates, seed)
    h = spread_join(held.join(cell, subject).groupBy("candidate", label).agg(F.count(F.lit(1)).alias("_sh")), glob, [label])
    ok = with_row(h.groupBy("candidate").agg(F.count(F.lit(1)).alias("_in"), F.count_if(F.col("_sh") == F.col("_subs")).alias("_lost")), n).filter("_in = _classes AND _lost = 0")
    return held.join(found(ok.agg(F.min("candidate").alias("candidate")), "no candidate split has every class on both sides"), "candidate").select(subject)


TEMPERATURES = [0.5 + i * 0.025 for i in range(101)]


def temperature_fit(df: DataFrame, probs: list[str], label: str) -> DataFrame:
    """Grid temperature with the smallest negative log-likelihood; the first one wins a tie.

    Every Arrow batch adds up the losses of all temperatures in whole vectors; the batches' 101 sums meet in one aggregation.
    """
    d = df.select(*[F.col(p).cast("double").alias(f"p{i}") for i, p in enumerate(probs)], F.col(label).cast("int").alias("y"))
    grid = np.array(TEMPERATURES)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(grid)), 0
        for b in batches:
            p = np.stack([b.column(f"p{i}").to_numpy(zero_copy_only=False) for i in range(len(probs))], 1)
            y = b.column("y").to_numpy(zero_copy_only=False)
            real = ~np.isnan(p).any(1) & (y >= 0) & (y < len(probs))
            logs, y = np.log(np.clip(p[real], 1e-9, 1.0)), y[real].astype(int)
            rows += len(y)
            for i, t in enumerate(grid):
                z = logs / t
                e = np.exp(z - z.max(1, keepdims=True))
                total[i] -= np.log(e[np.arange(len(y)), y] / e.sum(1) + 1e-12).sum()
        yield pa.record_batch([pa.array(range(len(grid)), pa.int32()), pa.array(total), pa.array([rows] * len(grid), pa.int64())], names=["i", "total", "n"])

    sums = d.mapInArrow(losses, "i int, total double, n bigint").groupBy("i").agg((F.sum("total") / F.sum("n")).alias("loss"))
    at = F.element_at(F.array(*[F.lit(float(t)) for t in TEMPERATURES]), F.col("i") + 1)
    return sums.agg(F.min(F.struct("loss", at.alias("temperature"))).alias("_b")).select("_b.temperature", "_b.loss")


def temperature_apply(df: DataFrame, probs: list[str], t: Column) -> DataFrame:
    z = [F.log(F.greatest(F.lit(1e-9), F.least(F.lit(1.0), F.col(p)))) / t for p in probs]
    d = df.withColumns({f"_z{i}": e for i, e in enumerate(z)})
    m = F.greatest(*[F.col(f"_z{i}") for i in range(len(probs))])
    e = [F.exp(F.col(f"_z{i}") - m) for i in range(len(probs))]
    total = reduce(lambda a, b: a + b, e)
    return d.withColumns({p: v / total for p, v in zip(probs, e)}).drop(*[f"_z{i}" for i in range(len(probs))])


GATES = {"validation_motion_f1": 0.90, "motion_f1": 0.90, "motion_recall": 0.90, "motion_specificity": 0.90, "macro_f1": 0.80}


def acceptance_gate(metrics: DataFrame) -> DataFrame:
    """Release gate; needs the GATES columns, min_class_recall, min_class_support and formal."""
    ok = F.col("formal")
    for name, limit in GATES.items():
        ok = ok & (F.col(name) >= limit)
    return metrics.withColumn("accepted", ok & (F.col("min_class_recall") >= 0.70) & (F.col("min_class_support") > 0))


def promotion_decision(pairs: DataFrame) -> DataFrame:
    """Candidate against champion (champion scores NULL when there is none)."""
    c = F.col
    worse = (c("candidate_motion_f1") < c("champion_motion_f1")) | (c("candidate_macro_f1") < c("champion_macro_f1"))
    why = F.when(~c("accepted"), "failed_acceptance_gate").when(~c("formal"), "no_formal_evaluation").when(F.coalesce(worse, F.lit(False)), "regressed").otherwise("promoted")
    return pairs.withColumns({"reason": why, "promote": why == "promoted"})


def weak_session_eval(df: DataFrame, expected: str, predicted: str, expected_sets: str, predicted_sets: str) -> DataFrame:
    """Coverage, order score and set error; activity lists are arrays on the session's row."""
    from ..functions.scalar import lcs_length

    e, p = F.col(expected), F.col(predicted)
    distinct = F.size(F.array_distinct(e))
    return df.withColumns({"activity_coverage": F.when(distinct > 0, F.size(F.array_intersect(e, p)) / distinct),
                           "order_score": F.when(F.size(e) > 0, lcs_length(e, p) / F.size(e)), "set_count_error": F.col(predicted_sets) - F.col(expected_sets)})


def cache_valid(table: DataFrame, required: list[str], versions: dict[str, str]) -> DataFrame:
    """One row: may a stored feature table be reused? Columns exist and every version matches."""
    if [c for c in [*required, *versions] if c not in table.columns]:
        return table.limit(0).agg(F.lit(False).alias("reusable"), F.count(F.lit(1)).alias("rows"))
    match = F.lit(True)
    for c, v in versions.items():
        match = match & F.coalesce(F.col(c) == v, F.lit(False))
    return table.agg(F.coalesce(F.bool_and(match), F.lit(False)).alias("reusable"), F.count(F.lit(1)).alias("rows"))
