"""Block-wise operators give the same result whatever the block size, also for a hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motionloom.operators import clean as C
from motionloom.operators import evaluate as E
from motionloom.operators import joins as J
from motionloom.operators import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    keys = np.where(rng.random(1500) < 0.5, 0, rng.integers(1, 6, 1500))  # key 0 holds half of the rows
    pdf = pd.DataFrame({"k": keys, "ts": rng.integers(0, 4000, 1500), "id": np.arange(1500), "x": rng.normal(size=1500).round(1)})
    pdf.loc[rng.random(1500) < 0.2, "x"] = np.nan
    pdf = pdf.sort_values(["k", "ts", "id"]).reset_index(drop=True)
    pdf["idx"] = pdf.groupby("k").cumcount()
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None))).persist()
    return pdf, df


def collect(df, *cols):
    return df.select("id", *cols).toPandas().sort_values("id").reset_index(drop=True)


def test_number_rows(rows):
    pdf, df = rows
    got = collect(O.number_rows(df.drop("idx"), ["k"], ["ts", "id"], F.floor(F.col("ts") / 100)), "idx")
    assert (got["idx"].to_numpy() == pdf.sort_values("id")["idx"].to_numpy()).all()


def test_block_scan_all_kinds(rows):
    pdf, df = rows
    x = F.col("x")
    scans = [O.Scan("s", x, "sum"), O.Scan("m", x, "max", inclusive=False), O.Scan("l", x, "last"), O.Scan("n", x, "last", reverse=True)]
    got = collect(O.block_scan(df, ["k"], ["idx"], O.index_block("idx", 37), scans), "s", "m", "l", "n")
    g = pdf.groupby("k")["x"]
    want = pdf.assign(s=g.transform(lambda v: v.expanding().sum()), m=g.transform(lambda v: v.expanding().max().shift()).groupby(pdf["k"]).ffill(), l=g.ffill(), n=g.bfill()).sort_values("id")
    for c in "smln":
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=1e-9)


def test_halo_frames_equal_pandas(rows):
    pdf, df = rows
    w = O.block_window(["k"])
    d = O.with_halo(df, "idx", 4, 4, 19).withColumn("r", C.rolling_median(F.col("x"), w, 9))
    got = collect(O.keep_core(d), "r")
    want = pdf.assign(r=pdf.groupby("k")["x"].transform(lambda v: v.rolling(9, center=True, min_periods=3).median())).sort_values("id")
    np.testing.assert_allclose(got["r"].astype(float), want["r"], atol=1e-12)


def test_exact_percentile(rows):
    pdf, df = rows
    got = O.exact_percentile(df, ["k"], "x", {"a": 0.5, "b": 0.95, "c": 0.0}, parts=7).toPandas().set_index("k").sort_index()
    want = pdf.groupby("k")["x"].quantile([0.5, 0.95, 0.0]).unstack()
    np.testing.assert_allclose(got[["a", "b", "c"]], want[[0.5, 0.95, 0.0]], atol=1e-12)


def test_ranges_are_even_beside_outliers(spark):
    """Far outliers on both sides and a hot key do not gather the other values in one range."""
    rng = np.random.default_rng(5)
    v = np.r_[-1e300, rng.normal(1e6, 1e-3, 20000), 1e300]
    df = spark.createDataFrame(pd.DataFrame({"k": np.where(np.arange(len(v)) % 3 == 1, 1, 0), "x": v}))
    cut = O.in_ranges(df, ["k", "x"], parts=8)
    held = [r["count"] for r in cut.groupBy("_bin").count().collect()]
    assert len(held) == 8 and max(held) <= 2 * sum(held) / len(held)
    edges = cut.groupBy("k", "_bin").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("k", "lo").toPandas()
    assert edges["_bin"].is_monotonic_increasing
    for _, e in edges.groupby("k"):
        assert (e["lo"].to_numpy()[1:] > e["hi"].to_numpy()[:-1]).all()
    got = O.exact_percentile(df, [], "x", {"a": 0.5, "b": 0.99}, parts=8).first()
    assert (got["a"], got["b"]) == tuple(np.quantile(v, [0.5, 0.99]))


def test_percentile_of_nothing_and_of_copies(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0), ("b", 2.0), ("b", float("nan")), ("c", 1.0)], "k string, x double")
    assert {tuple(r) for r in O.exact_percentile(df, ["k"], "x", {"m": 0.5}, parts=3).collect()} == {("b", 2.0), ("c", 1.0)}
    assert O.exact_percentile(df.filter("x > 9"), ["k"], "x", {"m": 0.5}).filter("k <> 'b'").count() == 0
    assert O.exact_percentile(df.limit(0), [], "x", {"m": 0.5}).count() == 0


@pytest.mark.parametrize("limit", [1, 2, 5])
def test_fill_equals_pandas_interpolate(rows, limit):
    pdf, df = rows
    gaps = df.withColumn("x", F.when(F.col("idx") % 9 < 3, F.col("x")))
    got = collect(C.fill_short_gaps(gaps, ["k"], "idx", ["x"], limit, size=23), "x")
    g = pdf.assign(x=pdf["x"].where(pdf["idx"] % 9 < 3))
    want = g.assign(x=g.groupby("k")["x"].transform(lambda v: v.interpolate("linear", limit=limit, limit_direction="both"))).sort_values("id")
    np.testing.assert_allclose(got["x"].astype(float), want["x"], atol=1e-9)


def clean_reference(x, fs):
    """The cleaning rules written with pandas for one key."""
    width, limit, sw = C.hampel_width(fs), C.gap_limit(fs), C.smooth_width(fs)
    l, r = x.shift(1), x.shift(-1)
    base = (l + r) / 2
    zero = x.eq(0) & np.sign(l).eq(np.sign(r)) & ((l - r).abs() <= (0.2 * base.abs()).clip(lower=0.01)) & (base.abs() > 0.02)
    y = x.mask(zero)
    med = y.rolling(width, center=True, min_periods=max(3, width // 3)).median()
    dev = (y - med).abs()
    lim = 8 * 1.4826 * dev.rolling(width, center=True, min_periods=max(3, width // 3)).median()
    spike = (dev > lim) & (lim > 1e-12) & ((y.shift(1) - y.shift(-1)).abs() <= (0.25 * dev).clip(lower=1e-9))
    y = y.mask(spike).interpolate("linear", limit=limit, limit_direction="both")
    return zero, spike, y.rolling(sw, center=True, min_periods=1).mean()


def test_clean_channels_equals_pandas(spark):
    rng = np.random.default_rng(5)
    n = 700
    x = pd.Series(np.sin(np.arange(n) / 9) + 1.5 + rng.normal(scale=0.01, size=n))
    x[[50, 200, 411]] = 0.0
    x[[80, 300, 555]] += 9.0
    x[120:130] = np.nan
    x[600:680] = np.nan  # longer than the fill reaches from both sides
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "idx": np.arange(n), "x": x})).withColumn("x", F.nanvl("x", F.lit(None)))
    zero, spike, want = clean_reference(x, 60.0)
    for size in (64, 100000):
        got = C.clean_channels(df, ["k"], "idx", ["x"], 60.0, size=size).orderBy("idx").toPandas()
        assert (got["x_zero"] == zero).all() and zero.sum() == 3
        assert (got["x_spike"] == spike).all() and spike.sum() >= 3
        np.testing.assert_allclose(got["x"].astype(float), want, atol=1e-9)


def test_clean_by_rate_uses_each_keys_width(spark):
    d = spark.range(0, 400).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("idx"), F.sin(F.col("id") / 7.0).alias("x")).withColumn(
        "fs", F.when(F.col("k") == 0, 49.6).otherwise(200.0))
    got = C.clean_by_rate(d, ["k"], "idx", ["x"], "fs").orderBy("k", "idx").toPandas()
    for k, fs in ((0, 49.6), (1, 200.0)):
        part = d.filter(F.col("k") == k).orderBy("idx").toPandas()
        np.testing.assert_allclose(got[got["k"] == k]["x"], clean_reference(part["x"], fs)[2], atol=1e-9)


def test_longest_runs_small_blocks(rows):
    pdf, df = rows
    got = C.longest_runs(df, ["k"], "idx", {"n": F.col("x") > 0}, size=11).toPandas().set_index("k")["n"]
    for k, g in pdf.groupby("k"):
        best = cur = 0
        for v in g["x"] > 0:
            cur = cur + 1 if v else 0
            best = max(best, cur)
        assert got[k] == best


def test_constant_channel_has_no_outliers(spark):
    d = spark.range(30).select(F.lit(1).alias("k"), F.when(F.col("id") == 3, 99.0).otherwise(5.0).alias("x"))
    assert C.robust_outlier(d, ["k"], "x").filter("outlier").count() == 0


def test_contains_first_answers_each_row(spark):
    docs = spark.createDataFrame([(1, "the quick fox"), (2, "slow ox"), (3, "zzz"), (4, ""), (5, None), (1, "lazy zz"), (1, "lazy zz")], "id int, text string")
    terms = spark.createDataFrame([(0, "ox", "O"), (1, "fox", "F"), (2, "zz", "Z")], "ordinal int, term string, value string")
    want = [(1, "O"), (2, "O"), (3, "Z"), (4, None), (5, None), (1, "Z"), (1, "Z")]
    assert sorted(((r["id"], r["value"]) for r in J.contains_first(docs, "text", terms).collect()), key=str) == sorted(want, key=str)
    many = terms.unionByName(spark.range(10, 3000).select(F.col("id").cast("int").alias("ordinal"), F.concat(F.lit("term"), "id").alias("term"), F.lit("N").alias("value")))
    assert sorted(((r["id"], r["value"]) for r in J.contains_first(docs, "text", many).collect()), key=str) == sorted(want, key=str)


def test_interval_join_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    p = pd.DataFrame({"k": rng.integers(0, 2, 200), "t": rng.random(200).round(3) * 50, "i": range(200)})
    s = pd.DataFrame({"k": rng.integers(0, 2, 30), "lo": rng.random(30).round(2) * 45, "s": range(30)})
    s["hi"] = s["lo"] + rng.random(30) * 20
    got = {(r["i"], r["s"]) for r in J.interval_join(spark.createDataFrame(p), spark.createDataFrame(s), ["k"], "t", "lo", "hi", 3.0).collect()}
    m = p.merge(s, on="k")
    assert got == set(map(tuple, m[(m["t"] >= m["lo"]) & (m["t"] < m["hi"])][["i", "s"]].to_numpy().tolist()))


def test_median_without(spark):
    rng = np.random.default_rng(1)
    p = pd.DataFrame({"g": rng.integers(0, 4, 301), "f": rng.normal(size=301)})
    got = E.median_without(spark.createDataFrame(p), "g", ["f"], parts=7).toPandas().set_index("g")["median"]
    for g in range(4):
        assert got[g] == pytest.approx(p[p["g"] != g]["f"].median(), abs=1e-12)


def test_median_without_ties_and_hot_group(spark):
    """Repeated values, a group with most rows, one with a single row, and a feature that one group alone has."""
    rng = np.random.default_rng(2)
    p = pd.DataFrame({"g": np.r_[np.where(rng.random(400) < 0.7, 0, rng.integers(1, 6, 400)), 9], "f": np.r_[rng.integers(0, 7, 400), 3].astype(float)})
    p["only"] = np.where(p["g"] == 1, p["f"], None)
    d = spark.createDataFrame(list(p.itertuples(index=False, name=None)), "g long, f double, only double")
    got = {(r["feature"], r["g"]): r["median"] for r in E.median_without(d, "g", ["f", "only"], parts=5).collect()}
    assert got == {("f", g): p[p["g"] != g]["f"].median() for g in p["g"].unique()}


def test_segment_assign_closes_last_segment(spark):
    rows = spark.createDataFrame([(1, float(i), i) for i in range(11)], "k int, t double, row int")
    seg = spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 5.0, 10.0)], "k int, s int, lo double, hi double")
    got = {r["s"]: (r["start_row"], r["end_row"], r["row_count"]) for r in J.segment_assign(rows, seg, ["k"], "t", "row", "s", "lo", "hi", 4.0).collect()}
    assert got == {0: (0, 4, 5), 1: (5, 10, 6)}


def test_block_entries_in_a_tree(spark):
    """Maps over three states composed in groups of two and of 64 give what a plain fold gives."""
    rng = np.random.default_rng(3)
    rows = [(k, int(s), rng.integers(0, 3, 3).tolist(), 1) for k in ("a", None) for s in np.r_[-4, np.sort(rng.choice(900, 70, replace=False))]]
    df = spark.createDataFrame(rows, "k string, seq long, m array<int>, begin int").repartition(5)
    want, state = {}, {}
    for k, s, m, first in rows:
        want[k, s] = state.setdefault(k, first)
        state[k] = m[state[k]]
    for fan in (8, 64):
        out = O.block_entries(df, ["k"], "seq", ["m"], "begin", lambda a, b: [[int(b[0][i]) for i in a[0]]], lambda m, x: int(m[0][int(x)]), fan).collect()
        assert {(r["k"], r["seq"]): r["entry"] for r in out} == want
    assert O.block_entries(df.where("seq > 10000"), ["k"], "seq", ["m"], "begin", None, None).count() == 0
