"""Queries: feature statistics, model building and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import rounded as r
from ..operators import evaluate as E
from ..operators import models as M
from ..session import staged
from .registry import query
from .views import FEATURES, SCORES, features, scores, table

#: Fits and centroids expand expressions per feature; with all 64, centroids gave no result in 50 seconds on the smallest tables.
NARROW = FEATURES[:4]
BEST_SQL = "CASE greatest(s0, s1, s2, s3) WHEN s0 THEN 0 WHEN s1 THEN 1 WHEN s2 THEN 2 ELSE 3 END"
PRED_SQL = f", p AS (SELECT *, label % 4 AS actual, {BEST_SQL} AS predicted FROM features)"


def each(form: str, sep: str = ", ") -> str:
    """SQL over all features: ``form`` with ``$`` as the feature and ``#`` as its number."""
    return sep.join(form.replace("$", f).replace("#", str(i)) for i, f in enumerate(FEATURES))


LONG_SQL = f"UNNEST([{each(chr(39) + '$' + chr(39))}]) AS feature, UNNEST([{each('$')}]) AS v"


def predicted(spark, sf):
    a = [F.col(s) for s in SCORES]
    top = F.greatest(*a)
    best = F.when(a[0] == top, 0).when(a[1] == top, 1).when(a[2] == top, 2).otherwise(3)
    return features(spark, sf).withColumns({"actual": F.col("label") % 4, "predicted": best})


def rounded_all(df, keep, digits=6):
    return df.select(*keep, *[r(F.col(c), digits).alias(c) for c in df.columns if c not in keep])


@query("class_feature_means", uses="features", sql=f"SELECT label, {each('round(avg($), 7) + 0.0 AS $')} FROM features GROUP BY 1")
def q_means(spark, sf):
    return rounded_all(E.class_means(features(spark, sf), "label", FEATURES), ["label"], 7)


@query("effect_size", uses="features", sql=f", l AS (SELECT label, {LONG_SQL} FROM features)," + """
g AS (SELECT feature, count(v) FILTER (label < 3) AS na, count(v) FILTER (label > 6) AS nb, avg(v) FILTER (label < 3) AS ma, avg(v) FILTER (label > 6) AS mb, var_samp(v) FILTER (label < 3) AS va, var_samp(v) FILTER (label > 6) AS vb FROM l GROUP BY 1),
e AS (SELECT *, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS es FROM g)
SELECT feature, round(ma, 7) + 0.0 AS mean_a, round(mb, 7) + 0.0 AS mean_b, round(es, 6) + 0.0 AS effect_size, round(abs(es), 6) + 0.0 AS abs_effect FROM e""")
def q_effect(spark, sf):
    e = E.effect_size(features(spark, sf), F.col("label") < 3, F.col("label") > 6, FEATURES).orderBy(F.desc("abs_effect"))
    return e.select("feature", r(F.col("mean_a"), 7).alias("mean_a"), r(F.col("mean_b"), 7).alias("mean_b"), r(F.col("effect_size")).alias("effect_size"), r(F.col("abs_effect")).alias("abs_effect"))


@query("centroid_distance", uses="features", sql=""", s AS (SELECT avg(f0) a0, avg(f1) a1, avg(f2) a2, avg(f3) a3, stddev_samp(f0) d0, stddev_samp(f1) d1, stddev_samp(f2) d2, stddev_samp(f3) d3 FROM features),
c AS (SELECT label, avg((f0 - a0) / d0) AS z0, avg((f1 - a1) / d1) AS z1, avg((f2 - a2) / d2) AS z2, avg((f3 - a3) / d3) AS z3 FROM features, s GROUP BY 1)
SELECT a.label AS label_a, b.label AS label_b, round(sqrt(((a.z0-b.z0)**2 + (a.z1-b.z1)**2 + (a.z2-b.z2)**2 + (a.z3-b.z3)**2) / 4), 6) + 0.0 AS distance FROM c a JOIN c b ON a.label < b.label""")
def q_centroid(spark, sf):
    return rounded_all(E.centroid_distance(features(spark, sf), "label", NARROW), ["label_a", "label_b"])


@query("metrics_by_dim", uses="scores", sql="""SELECT dim, count(*) AS windows, count(DISTINCT grp) AS sessions, min(y) AS actual, round(avg(CASE WHEN y = CASE WHEN score >= 0.5 THEN 1 ELSE 0 END THEN 1.0 ELSE 0 END), 6) + 0.0 AS accuracy,
 round(avg(score), 6) + 0.0 AS mean_probability FROM scores GROUP BY 1""")
def q_by_dim(spark, sf):
    d = scores(spark, sf).withColumn("p", (F.col("score") >= 0.5).cast("int"))
    return rounded_all(E.metrics_by_dim(d, "dim", "grp", "y", "p", "score"), ["dim", "windows", "sessions", "actual"])


@query("class_support", uses="features", sql="SELECT label, count(DISTINCT subject) AS subjects, count(DISTINCT grp) AS sessions, count(DISTINCT grp) < 2 AS singleton FROM features GROUP BY 1")
def q_support(spark, sf):
    return E.class_support(features(spark, sf), "label", "subject", "grp")


@query("action_contrast", uses="features", sql=f", l AS (SELECT subject, label % 2 AS action, {LONG_SQL} FROM features)," + """
m AS (SELECT feature, subject, median(v) FILTER (action = 0) - median(v) FILTER (action = 1) AS d FROM l GROUP BY 1, 2), k AS (SELECT * FROM m WHERE d IS NOT NULL)
SELECT feature, subject, round(d, 7) + 0.0 AS difference, count(*) OVER (PARTITION BY feature) >= 2 AND min(sign(d)) OVER (PARTITION BY feature) = max(sign(d)) OVER (PARTITION BY feature) AS direction_consistent FROM k""")
def q_contrast(spark, sf):
    d = features(spark, sf).withColumn("action", F.col("label") % 2)
    return E.action_contrast(d, "subject", "action", 0, 1, FEATURES).withColumn("difference", r(F.col("difference"), 7))


@query("impute_standardize", uses="features", sql=""", h AS (SELECT vec_id, CASE WHEN vec_id % 11 = 3 THEN NULL ELSE f0 END AS f0, CASE WHEN vec_id % 13 = 5 THEN NULL ELSE f1 END AS f1 FROM features),
m AS (SELECT median(f0) AS m0, median(f1) AS m1 FROM h), i AS (SELECT vec_id, coalesce(f0, m0) AS f0, coalesce(f1, m1) AS f1 FROM h, m), s AS (SELECT avg(f0) a0, avg(f1) a1, stddev_pop(f0) d0, stddev_pop(f1) d1 FROM i)
SELECT vec_id, round((f0 - a0) / d0, 6) + 0.0 AS f0, round((f1 - a1) / d1, 6) + 0.0 AS f1 FROM i, s""")
def q_standardize(spark, sf):
    v = F.col("vec_id")
    d = features(spark, sf).select("vec_id", F.when(v % 11 != 3, F.col("f0")).alias("f0"), F.when(v % 13 != 5, F.col("f1")).otherwise(float("nan")).alias("f1"))
    return rounded_all(E.impute_standardize(d, ["f0", "f1"]), ["vec_id"])


WEIGHT_SQL = """, g AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY grp) AS w FROM scores), c AS (SELECT *, w / sum(w) OVER (PARTITION BY y) AS v FROM g)"""


@query("group_weights", uses="scores", sql=WEIGHT_SQL + " SELECT doc_id, round(v / avg(v) OVER (), 6) + 0.0 AS weight FROM c")
def q_weights(spark, sf):
    return E.group_weights(scores(spark, sf), "y", "grp").select("doc_id", r(F.col("weight")).alias("weight"))


def standardised(spark, sf):
    d = E.group_weights(features(spark, sf).withColumn("y", (F.col("label") < 5).cast("int")), "y", "grp")
    return staged(E.impute_standardize(d, NARROW), "standardised")


@query("logistic_l2_fit")
def q_fit(spark, sf):
    z = standardised(spark, sf)
    model = M.fit_logistic(z, NARROW, "y", "weight", 1.0)
    return spark.createDataFrame([(float(model.intercept), *[float(c) for c in model.coefficients])], ["intercept", *NARROW])


@query("coefficient_table")
def q_coefficients(spark, sf):
    return M.coefficient_table(spark, M.fit_logistic(standardised(spark, sf), NARROW, "y", "weight", 1.0), NARROW)


#: A fixed model over all features: the place of a fitted model's numbers.
MODEL = {"intercept": 0.25, "median": [i % 4 / 100 for i in range(64)], "mean": [i % 5 / 100 - 0.02 for i in range(64)],
         "scale": [0.11 + i % 4 / 100 for i in range(64)], "coefficients": [(i * 7 % 11 - 5) / 40 for i in range(64)]}
LOGIT_SQL = "CAST(0.25 AS DOUBLE) + " + " + ".join(
    f"(coalesce(CASE WHEN vec_id % 9 <> {i % 9} THEN {f} END, CAST({m!r} AS DOUBLE)) - CAST({a!r} AS DOUBLE)) / CAST({s!r} AS DOUBLE) * CAST({c!r} AS DOUBLE)"
    for i, (f, m, a, s, c) in enumerate(zip(FEATURES, MODEL["median"], MODEL["mean"], MODEL["scale"], MODEL["coefficients"])))


@query("logistic_score", uses="features", sql=f", p AS (SELECT vec_id, 1 / (1 + exp(-greatest(-35, least(35, {LOGIT_SQL})))) AS p FROM features) SELECT vec_id, round(p, 7) + 0.0 AS probability, p >= 0.5 AS exercise FROM p")
def q_score(spark, sf):
    d = features(spark, sf).withColumns({f: F.when(F.col("vec_id") % 9 != i % 9, F.col(f)) for i, f in enumerate(FEATURES)})
    return E.logistic_score(d, FEATURES, MODEL).select("vec_id", r(F.col("probability"), 7).alias("probability"), (F.col("probability") >= 0.5).alias("exercise"))


@query("group_folds", sql="""
, g AS (SELECT o_custkey AS grp, min(o_orderkey % 2) AS y FROM orders GROUP BY 1) SELECT grp, (row_number() OVER (PARTITION BY y ORDER BY md5('7:' || grp), grp) - 1) % 5 AS fold FROM g""")
def q_folds(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("grp"), (F.col("o_orderkey") % 2).alias("y"))
    return E.group_folds(d, "y", "grp", 5, 7)


@query("nested_cv")
def q_nested(spark, sf):
    d = features(spark, sf).select("vec_id", (F.col("label") < 5).cast("int").alias("y"), F.col("subject").alias("grp"), *NARROW)
    d = d.withColumn("y", (F.col("grp") % 2).cast("int"))
    _, folds = M.nested_cv(d, NARROW, "y", "grp", grid=[0.1, 10.0], outer=2, inner=2)
    return folds


@query("group_mean_vote", uses="scores", sql="SELECT grp, min(y) AS actual, round(avg(score), 6) + 0.0 AS probability, CASE WHEN avg(score) >= 0.5 THEN 1 ELSE 0 END AS predicted FROM scores GROUP BY 1")
def q_vote(spark, sf):
    return E.group_vote(scores(spark, sf), "grp", "y", "score").withColumn("probability", r(F.col("probability")))


@query("binary_metrics", uses="scores", sql=""", c AS (SELECT count_if(y = 1 AND score >= 0.5) AS tp, count_if(y = 0 AND score >= 0.5) AS fp, count_if(y = 0 AND score < 0.5) AS tn, count_if(y = 1 AND score < 0.5) AS fn FROM scores)
SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) + 0.0 AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) + 0.0 AS balanced_accuracy, round(tp / greatest(1, tp + fp), 6) + 0.0 AS "precision",
 round(tp / greatest(1, tp + fn), 6) + 0.0 AS recall, round(tn / greatest(1, tn + fp), 6) + 0.0 AS specificity FROM c""")
def q_binary(spark, sf):
    m = E.binary_metrics(scores(spark, sf).withColumn("p", (F.col("score") >= 0.5).cast("int")), "y", "p")
    return rounded_all(m, ["tp", "fp", "tn", "fn"])


@query("roc_auc", uses="scores", sql=""", k AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM scores), n AS (SELECT count_if(y = 1) AS p, count_if(y <> 1) AS q, sum(rk) FILTER (y = 1) AS s FROM k)
SELECT p AS positives, q AS negatives, round((s - p * (p + 1) / 2) / (p * q), 7) + 0.0 AS roc_auc FROM n""")
def q_auc(spark, sf):
    return E.roc_auc(scores(spark, sf), "y", "score").select("positives", "negatives", r(F.col("roc_auc"), 7).alias("roc_auc"))


LORO_SQL = """, d AS (SELECT vec_id, grp, label, CASE WHEN vec_id % 17 = 2 THEN NULL ELSE f0 END AS f0, f1 FROM features), h AS (SELECT DISTINCT grp AS held FROM d),
s AS (SELECT held, avg(f0) AS m0, avg(f1) AS m1, stddev_samp(f0) AS s0, stddev_samp(f1) AS s1 FROM h JOIN d ON grp <> held GROUP BY 1),
c AS (SELECT s.held, label, avg((f0 - m0) / s0) AS c0, avg((f1 - m1) / s1) AS c1 FROM s JOIN d ON grp <> s.held GROUP BY 1, 2),
t AS (SELECT s.held, vec_id, label AS actual, (f0 - m0) / s0 AS z0, (f1 - m1) / s1 AS z1 FROM s JOIN d ON grp = s.held),
k AS (SELECT t.held, vec_id, actual, label, coalesce((z0 - c0) ** 2, 0) + coalesce((z1 - c1) ** 2, 0) AS dist FROM t JOIN c ON c.held = t.held)
"""


@query("loro_nearest_centroid", uses="features", sql=LORO_SQL + " SELECT held AS grp, vec_id, actual, arg_min(label, (dist, label)) AS predicted FROM k WHERE EXISTS (SELECT 1 FROM c WHERE c.held = k.held AND c.label = k.actual) GROUP BY 1, 2, 3")
def q_loro(spark, sf):
    d = features(spark, sf).withColumn("f0", F.when(F.col("vec_id") % 17 != 2, F.col("f0")))
    return E.loro_nearest_centroid(d, "grp", "label", ["f0", "f1"], ["vec_id"])


@query("lopo_two_action", uses="features", sql=""", d AS (SELECT subject, label % 2 AS action, f0, f1, f2 FROM features), h AS (SELECT DISTINCT subject AS held FROM d),
s AS (SELECT held, median(f0) AS m0, median(f1) AS m1, median(f2) AS m2, stddev_pop(f0) AS s0, stddev_pop(f1) AS s1, stddev_pop(f2) AS s2 FROM h JOIN d ON subject <> held GROUP BY 1),
c AS (SELECT s.held, action, avg((f0 - m0) / s0) AS c0, avg((f1 - m1) / s1) AS c1, avg((f2 - m2) / s2) AS c2 FROM s JOIN d ON subject <> s.held GROUP BY 1, 2),
t AS (SELECT s.held, action, (f0 - m0) / s0 AS z0, (f1 - m1) / s1 AS z1, (f2 - m2) / s2 AS z2 FROM s JOIN d ON subject = s.held),
p AS (SELECT t.held, t.action, CASE WHEN (z0-a.c0)**2 + (z1-a.c1)**2 + (z2-a.c2)**2 <= (z0-b.c0)**2 + (z1-b.c1)**2 + (z2-b.c2)**2 THEN 0 ELSE 1 END AS pred FROM t JOIN c a ON a.held = t.held AND a.action = 0 JOIN c b ON b.held = t.held AND b.action = 1),
q AS (SELECT held, count(*) AS windows, avg(CASE WHEN pred = 0 THEN 1.0 ELSE 0 END) FILTER (action = 0) AS ra, avg(CASE WHEN pred = 1 THEN 1.0 ELSE 0 END) FILTER (action = 1) AS rb FROM p GROUP BY 1)
SELECT held AS subject, windows, round(ra, 6) + 0.0 AS recall_a, round(rb, 6) + 0.0 AS recall_b, round((ra + rb) / 2, 6) + 0.0 AS balanced_accuracy FROM q""")
def q_lopo(spark, sf):
    d = features(spark, sf).withColumn("action", F.col("label") % 2)
    return rounded_all(E.lopo_two_action(d, "subject", "action", 0, 1, NARROW[:3]), ["subject", "windows"])


@query("confusion_matrix", uses="features", sql=PRED_SQL + ", n AS (SELECT actual, predicted, count(*) AS n FROM p GROUP BY 1, 2) SELECT actual, predicted, n, round(n / sum(n) OVER (PARTITION BY actual), 6) + 0.0 AS share FROM n")
def q_confusion(spark, sf):
    return rounded_all(E.confusion(predicted(spark, sf), "actual", "predicted"), ["actual", "predicted", "n"])


REPORT_SQL = PRED_SQL + """, c AS (SELECT k AS label, (SELECT count(*) FROM p WHERE actual = k) AS support, (SELECT count(*) FROM p WHERE predicted = k) AS pred, (SELECT count(*) FROM p WHERE predicted = k AND actual = k) AS tp FROM (SELECT DISTINCT actual AS k FROM p UNION SELECT predicted FROM p) u),
m AS (SELECT label, support, tp, CASE WHEN pred > 0 THEN tp / pred ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS re FROM c), f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM m)
"""


@query("classification_report", uses="features", sql=REPORT_SQL + """
SELECT CAST(label AS VARCHAR) AS label, round(pr, 6) + 0.0 AS "precision", round(re, 6) + 0.0 AS recall, round(f1, 6) + 0.0 AS f1, support FROM f
UNION ALL SELECT '_accuracy', NULL, NULL, round(sum(tp) / sum(support), 6) + 0.0, CAST(sum(support) AS BIGINT) FROM f UNION ALL SELECT '_macro_f1', NULL, NULL, round(avg(f1), 6) + 0.0, CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT '_macro_f1_present', NULL, NULL, round(avg(f1) FILTER (support > 0), 6) + 0.0, CAST(sum(support) AS BIGINT) FROM f""")
def q_report(spark, sf):
    return rounded_all(E.classification_report(predicted(spark, sf), "actual", "predicted"), ["label", "support"])


@query("motion_metrics", uses="features", sql=""", p AS (SELECT CASE WHEN label < 5 THEN 1 ELSE 0 END AS y, CASE WHEN (s0 + s2) / (s0 + s1 + s2 + s3) >= 0.5 THEN 1 ELSE 0 END AS p FROM features WHERE label <> 9),
c AS (SELECT count_if(y = 1 AND p = 1) AS tp, count_if(y = 0 AND p = 1) AS fp, count_if(y = 0 AND p = 0) AS tn, count_if(y = 1 AND p = 0) AS fn FROM p)
SELECT tp + fp + tn + fn AS samples, round((tp + tn) / (tp + fp + tn + fn), 6) + 0.0 AS accuracy, round((2 * tp / greatest(1, 2 * tp + fp + fn) + 2 * tn / greatest(1, 2 * tn + fp + fn)) / 2, 6) + 0.0 AS macro_f1, round(tp / greatest(1, tp + fp), 6) + 0.0 AS precision_exercise,
 round(tp / greatest(1, tp + fn), 6) + 0.0 AS recall_exercise, round(tn / greatest(1, tn + fp), 6) + 0.0 AS specificity_non_exercise FROM c""")
def q_motion(spark, sf):
    from .q_quality import class_probabilities

    d = class_probabilities(features(spark, sf)).withColumn("motion_state", F.when(F.col("label") < 5, "motion").when(F.col("label") < 9, "non_motion"))
    return rounded_all(motion_metrics(d, "probabilities", ["run", "squat"], "motion_state"), ["samples"])


def motion_metrics(d, probabilities, motion_classes, state):
    """Binary metrics of summed motion-class probabilities over rows with a motion state."""
    from ..functions.scalar import map_sum_subset

    e = d.filter(F.col(state).isin("motion", "non_motion")).select(
        (F.col(state) == "motion").cast("int").alias("y"), (map_sum_subset(F.col(probabilities), motion_classes) >= 0.5).cast("int").alias("p"))
    c = F.col
    f1 = lambda hit: 2 * c(hit) / F.greatest(F.lit(1), 2 * c(hit) + c("fp") + c("fn"))
    return E.binary_metrics(e, "y", "p").select((c("tp") + c("fp") + c("tn") + c("fn")).alias("samples"), "accuracy", ((f1("tp") + f1("tn")) / 2).alias("macro_f1"),
                                                c("precision").alias("precision_exercise"), c("recall").alias("recall_exercise"), c("specificity").alias("specificity_non_exercise"))


@query("rare_class_collapse", uses="features", sql=""", s AS (SELECT label, count(DISTINCT subject) AS k FROM features WHERE f0 > 0.1 GROUP BY 1)
SELECT vec_id, CASE WHEN label % 3 = 0 THEN 'other_non_motion' WHEN k < 15 THEN 'other_motion' ELSE CAST(label AS VARCHAR) END AS action_id FROM features JOIN s USING (label) WHERE f0 > 0.1""")
def q_rare(spark, sf):
    d = features(spark, sf).filter("f0 > 0.1").withColumn("motion_state", F.when(F.col("label") % 3 == 0, "non_motion").otherwise("motion"))
    return E.rare_class_collapse(d, "label", "motion_state", "subject", 15).select("vec_id", "action_id")


@query("subject_holdout")
def q_holdout(spark, sf):
    return E.subject_holdout(features(spark, sf), "subject", "label", 0.15)


@query("three_way_split")
def q_three(spark, sf):
    return E.three_way_split(features(spark, sf), "subject", "label").select("vec_id", "subject", "split")


@query("class_cover_split")
def q_cover(spark, sf):
    return E.class_cover_split(features(spark, sf), "subject", "label")


def trained(spark, sf):
    d = E.group_weights(features(spark, sf).withColumn("y", F.col("label").cast("int")), "y", "grp")
    return d, M.fit_forest(d, NARROW, "y", "weight")


@query("train_multiclass")
def q_train(spark, sf):
    d, model = trained(spark, sf)
    return E.classification_report(M.score_forest(model, d, NARROW), "y", "predicted")


@query("feature_importance")
def q_importance(spark, sf):
    return M.feature_importance(spark, trained(spark, sf)[1], NARROW)


PR_SQL = ", p AS (SELECT vec_id, label % 4 AS y, s0/s AS p0, s1/s AS p1, s2/s AS p2, s3/s AS p3 FROM (SELECT *, s0 + s1 + s2 + s3 AS s FROM features) z)"
PROBS = ["p0", "p1", "p2", "p3"]


def probabilities(spark, sf):
    a = [F.col(s) for s in SCORES]
    total = a[0] + a[1] + a[2] + a[3]
    return features(spark, sf).select("vec_id", (F.col("label") % 4).alias("y"), *[(x / total).alias(p) for x, p in zip(a, PROBS)])


@query("temperature_fit", uses="features", sql=PR_SQL + """, t AS (SELECT 0.5 + i * 0.025 AS t FROM (SELECT UNNEST(generate_series(0, 100)) AS i) q),
l AS (SELECT t, y, ln(greatest(1e-9, p0)) / t AS a, ln(greatest(1e-9, p1)) / t AS b, ln(greatest(1e-9, p2)) / t AS c, ln(greatest(1e-9, p3)) / t AS d FROM p, t),
n AS (SELECT t, -avg(ln(exp(CASE y WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN c ELSE d END) / (exp(a) + exp(b) + exp(c) + exp(d)) + 1e-12)) AS loss FROM l GROUP BY 1)
SELECT CAST(arg_min(t, (loss, t)) AS DOUBLE) AS temperature, round(min(loss), 7) + 0.0 AS loss FROM n""")
def q_temperature(spark, sf):
    return E.temperature_fit(probabilities(spark, sf), PROBS, "y").select("temperature", r(F.col("loss"), 7).alias("loss"))


@query("temperature_apply", uses="features", sql=PR_SQL + """, e AS (SELECT vec_id, pow(greatest(1e-9, p0), 1 / 1.7) AS a, pow(greatest(1e-9, p1), 1 / 1.7) AS b, pow(greatest(1e-9, p2), 1 / 1.7) AS c, pow(greatest(1e-9, p3), 1 / 1.7) AS d FROM p)
SELECT vec_id, round(a / (a + b + c + d), 7) + 0.0 AS p0, round(b / (a + b + c + d), 7) + 0.0 AS p1, round(c / (a + b + c + d), 7) + 0.0 AS p2, round(d / (a + b + c + d), 7) + 0.0 AS p3 FROM e""")
def q_apply(spark, sf):
    d = E.temperature_apply(probabilities(spark, sf), PROBS, F.lit(1.7))
    return d.select("vec_id", *[r(F.col(p), 7).alias(p) for p in PROBS])


GATE_SQL = """, g AS (SELECT grp, avg(score) AS a, max(score) AS b, avg(y) AS c, min(score) AS d, count(*) AS n FROM scores GROUP BY 1), m AS (SELECT grp, b AS v, b - 0.02 AS mf, b - 0.01 AS mr, 1 - d AS ms, b - 0.1 AS f, a + 0.25 AS lo, n AS sup, c > 0.2 AS formal FROM g),
k AS (SELECT *, formal AND v >= 0.9 AND mf >= 0.9 AND mr >= 0.9 AND ms >= 0.9 AND f >= 0.8 AND lo >= 0.7 AND sup > 0 AS accepted FROM m)
"""


def model_reports(spark, sf):
    """One metrics row per group, standing for the reports of many model versions."""
    g = scores(spark, sf).groupBy("grp").agg(F.avg("score").alias("a"), F.max("score").alias("b"), F.avg("y").alias("c"), F.min("score").alias("d"), F.count(F.lit(1)).alias("n"))
    c = F.col
    return g.select("grp", c("b").alias("validation_motion_f1"), (c("b") - 0.02).alias("motion_f1"), (c("b") - 0.01).alias("motion_recall"), (1 - c("d")).alias("motion_specificity"),
                    (c("b") - 0.1).alias("macro_f1"), (c("a") + 0.25).alias("min_class_recall"), c("n").alias("min_class_support"), (c("c") > 0.2).alias("formal"))


@query("acceptance_gate", uses="scores", sql=GATE_SQL + "SELECT grp, formal, accepted FROM k")
def q_accept(spark, sf):
    return E.acceptance_gate(model_reports(spark, sf)).select("grp", "formal", "accepted")


@query("promotion_decision", uses="scores", sql=GATE_SQL + """, o AS (SELECT a.grp, a.accepted, a.formal, a.mf < b.mf OR a.f < b.f AS worse FROM k a LEFT JOIN k b ON b.grp = 'src' || (CAST(substr(a.grp, 4) AS INT) + 1)),
z AS (SELECT grp, CASE WHEN NOT accepted THEN 'failed_acceptance_gate' WHEN NOT formal THEN 'no_formal_evaluation' WHEN coalesce(worse, false) THEN 'regressed' ELSE 'promoted' END AS reason FROM o) SELECT grp, reason, reason = 'promoted' AS promote FROM z""")
def q_promote(spark, sf):
    k = E.acceptance_gate(model_reports(spark, sf))
    c = F.col
    champ = k.select(F.concat(F.lit("src"), (F.substring("grp", 4, 9).cast("int") - 1).cast("string")).alias("grp"), c("motion_f1").alias("champion_motion_f1"), c("macro_f1").alias("champion_macro_f1"))
    p = k.withColumnsRenamed({"motion_f1": "candidate_motion_f1", "macro_f1": "candidate_macro_f1"}).join(champ, "grp", "left")
    return E.promotion_decision(p).select("grp", "reason", "promote")


@query("weak_session_eval")
def q_weak(spark, sf):
    name = lambda a, b: F.transform(F.slice("embedding", a, b), lambda x: F.when(x > 0.1, "squat").when(x < -0.1, "run").when(x > 0, "plank").otherwise("press"))
    d = table(spark, sf, "embeddings").select("vec_id", name(1, 40).alias("e"), name(25, 40).alias("p"), (F.col("vec_id") % 5).alias("es"), (F.col("label") % 6).alias("ps"))
    return E.weak_session_eval(d, "e", "p", "es", "ps").select("vec_id", "activity_coverage", "order_score", "set_count_error")


@query("feature_cache_guard", sql="SELECT bool_and(event_type = 'view') AS reusable, count(*) AS rows FROM events")
def q_cache(spark, sf):
    d = table(spark, sf, "events").withColumn("taxonomy_version", F.col("event_type"))
    return E.cache_valid(d, ["event_id", "value"], {"taxonomy_version": "view"})
