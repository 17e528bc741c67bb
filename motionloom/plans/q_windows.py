"""Queries: sliding windows and their features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.scalar import rounded as r
from ..functions.spectral import autocorr_period, spectral
from ..operators import ordered as O
from ..operators import posture as P
from ..operators import windows as WN
from ..session import staged
from .registry import query
from .views import AXES, imu6, windows1

DEV = ["device"]
MAP = dict(zip(WN.AXES, AXES))
MAP9 = {**MAP, "angle_x": "roll", "angle_y": "pitch", "angle_z": "yaw"}


def long(df, ids, digits=6):
    """Feature columns as rows (feature, value), rounded."""
    cols = [c for c in df.columns if c not in ids]
    pairs = [F.struct(F.lit(c).alias("feature"), r(F.col(c), 8 if c == "acc_sma" else digits).alias("value")) for c in cols]
    return df.select(*ids, F.inline(F.array(*pairs)))


def win_sql(n, step):
    """Rows of full windows as a CTE ``w`` (device, win, idx, columns of imu6 with magnitudes)."""
    return f""", m AS (SELECT *, sqrt(ax*ax+ay*ay+az*az) AS am, sqrt(gx*gx+gy*gy+gz*gz) AS gm FROM imu6), z AS (SELECT device, max(idx) + 1 AS n FROM imu6 GROUP BY 1),
g AS (SELECT device, UNNEST(generate_series(0, (n - {n}) // {step})) AS win FROM z WHERE n >= {n}),
w AS (SELECT m.*, win FROM m JOIN g ON m.device = g.device AND idx >= win * {step} AND idx < win * {step} + {n})
"""


LONG_V2 = win_sql(200, 50) + """
, md AS (SELECT device, win, median(am) AS med FROM w GROUP BY 1, 2),
c AS (SELECT w.device, w.win, idx, UNNEST(['acc_x','acc_y','acc_z','gyro_x','gyro_y','gyro_z','acc_mag','dynamic_acc','gyro_mag']) AS ch, UNNEST([ax, ay, az, gx, gy, gz, am, abs(am - med), gm]) AS x FROM w JOIN md ON md.device = w.device AND md.win = w.win),
d AS (SELECT *, x - lag(x) OVER (PARTITION BY device, win, ch ORDER BY idx) AS dx FROM c)
"""
STATS_V2 = """SELECT device, win, ch || '_mean' AS feature, avg(x) AS value FROM d GROUP BY device, win, ch UNION ALL SELECT device, win, ch || '_std', stddev_pop(x) FROM d GROUP BY device, win, ch
UNION ALL SELECT device, win, ch || '_rms', sqrt(avg(x * x)) FROM d GROUP BY device, win, ch UNION ALL SELECT device, win, ch || '_range', max(x) - min(x) FROM d GROUP BY device, win, ch
UNION ALL SELECT device, win, ch || '_iqr', quantile_cont(x, 0.75) - quantile_cont(x, 0.25) FROM d GROUP BY device, win, ch UNION ALL SELECT device, win, ch || '_jerk_rms', sqrt(avg(dx * dx)) * 50 FROM d GROUP BY device, win, ch
UNION ALL SELECT w.device, w.win, 'acc_sma', avg(abs(ax - mx) + abs(ay - my) + abs(az - mz)) FROM w JOIN (SELECT device, win, avg(ax) AS mx, avg(ay) AS my, avg(az) AS mz FROM w GROUP BY 1, 2) q ON q.device = w.device AND q.win = w.win GROUP BY 1, 2"""
CORR = {f"{f}_corr_{a}{b}": (f"{p}{a}", f"{p}{b}") for f, p in (("acc", "a"), ("gyro", "g")) for a, b in ("xy", "xz", "yz")}
CORR_SQL = " UNION ALL ".join(f"""SELECT device, win, '{n}' AS feature, CASE WHEN stddev_pop({x}) * stddev_pop({y}) * 200 > 1e-12 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) ELSE 0 END AS value FROM w GROUP BY 1, 2""" for n, (x, y) in CORR.items())
GRAV_SQL = " UNION ALL ".join(f"SELECT device, win, 'gravity_{a}' AS feature, avg(a{a}) / greatest(sqrt(avg(ax)*avg(ax)+avg(ay)*avg(ay)+avg(az)*avg(az)), 1e-9) AS value FROM w GROUP BY 1, 2" for a in "xyz")


def dft_sql(n, low, high, src="d", floor="1e-15", entropy_floor=1.0):
    """Discrete Fourier transform in plain SQL: CTE ``f`` (device, win, ch, dominant, entropy)."""
    bins = [k for k in range(n // 2 + 1) if low <= k * 50.0 / n <= min(high, 25.0)]
    import math

    scale = max(math.log2(len(bins)), entropy_floor)
    return f""", ls AS (SELECT device, win, ch, list(x - mu ORDER BY idx) AS xs FROM (SELECT *, avg(x) OVER (PARTITION BY device, win, ch) AS mu FROM {src}) q GROUP BY 1, 2, 3),
tr AS (SELECT k, list(cos(2 * pi() * ((j * k) % {n}) / {n}) ORDER BY j) AS cs, list(sin(2 * pi() * ((j * k) % {n}) / {n}) ORDER BY j) AS sn FROM (SELECT UNNEST(generate_series({bins[0]}, {bins[-1]})) AS k) a, (SELECT UNNEST(generate_series(0, {n - 1})) AS j) b GROUP BY 1),
pw AS (SELECT device, win, ch, k, pow(list_dot_product(xs, cs), 2) + pow(list_dot_product(xs, sn), 2) AS p FROM ls, tr),
pt AS (SELECT device, win, ch, sum(p) AS total FROM pw GROUP BY 1, 2, 3),
f AS (SELECT pw.device, pw.win, pw.ch, CASE WHEN any_value(total) > {floor} THEN arg_max(k, p) * 50.0 / {n} ELSE 0 END AS dominant,
 CASE WHEN any_value(total) > {floor} THEN -sum(CASE WHEN total > 0 THEN p / total * log2(p / total + 1e-15) ELSE 0 END) / {scale!r} ELSE 0 END AS entropy FROM pw JOIN pt ON pt.device = pw.device AND pt.win = pw.win AND pt.ch = pw.ch GROUP BY 1, 2, 3)
"""


PERIOD_SQL = """, lg AS (SELECT device, win, ch, lag, list_dot_product(xs[1:200 - lag], xs[1 + lag:200]) AS c, list_dot_product(xs, xs) AS c0 FROM ls, (SELECT UNNEST(generate_series(12, 165)) AS lag) q),
sd AS (SELECT device, win, ch, stddev_pop(x) AS s FROM d GROUP BY 1, 2, 3),
lm AS (SELECT *, max(c) OVER (PARTITION BY device, win, ch) AS mx FROM lg),
pe AS (SELECT lg.device, lg.win, lg.ch, CASE WHEN any_value(s) < 1e-8 THEN 0 ELSE min(lag) FILTER (c >= mx - 1e-9 * c0) / 50.0 END AS period FROM lm lg JOIN sd ON sd.device = lg.device AND sd.win = lg.win AND sd.ch = lg.ch GROUP BY 1, 2, 3)
"""


def spectra_sql(src, rate="50.0"):
    """Spectra of series of any length in ``src`` (device, win, ch, idx, x): CTE ``f`` (device, win, ch, dominant, entropy); entropy over the bins that there are."""
    return f""", ls AS (SELECT device, win, ch, m, fs, list(x - mu ORDER BY idx) AS xs FROM (SELECT *, avg(x) OVER q AS mu, count(*) OVER q AS m, {rate} AS fs FROM {src} WINDOW q AS (PARTITION BY device, win, ch)) z GROUP BY 1, 2, 3, 4, 5),
tr AS (SELECT m, k, list(cos(2 * pi() * ((j * k) % m) / m) ORDER BY j) AS cs, list(sin(2 * pi() * ((j * k) % m) / m) ORDER BY j) AS sn FROM (SELECT m, UNNEST(generate_series(0, m // 2)) AS k FROM (SELECT DISTINCT m FROM ls) a) b, LATERAL (SELECT UNNEST(generate_series(0, m - 1)) AS j) c GROUP BY 1, 2),
pw AS (SELECT device, win, ch, k * (fs / ls.m) AS hz, pow(list_dot_product(xs, cs), 2) + pow(list_dot_product(xs, sn), 2) AS p FROM ls JOIN tr ON tr.m = ls.m WHERE k * (fs / ls.m) >= 0.2 AND k * (fs / ls.m) <= least(15.0, fs / 2)),
pt AS (SELECT device, win, ch, sum(p) AS total, count(*) AS bins FROM pw GROUP BY 1, 2, 3),
f AS (SELECT pw.device, pw.win, pw.ch, CASE WHEN any_value(total) > 0 THEN arg_max(hz, p) ELSE 0 END AS dominant,
 CASE WHEN any_value(total) > 0 AND any_value(bins) > 1 THEN -sum(p / total * log2(p / total + 1e-15)) / log2(any_value(bins)) ELSE 0 END AS entropy FROM pw JOIN pt ON pt.device = pw.device AND pt.win = pw.win AND pt.ch = pw.ch GROUP BY 1, 2, 3)
"""


def v2(spark, sf, names=None):
    return WN.window_stats_v2(imu6(spark, sf), DEV, "idx", MAP, names=names)


def pick(spark, sf, names, digits=6):
    return v2(spark, sf, names).select("device", "win", *[r(F.col(n), 8 if n == "acc_sma" else digits).alias(n) for n in names])


@query("sliding_windows", uses="imu6", sql=win_sql(200, 50) + """
SELECT device, win, round(win * 50 / 50.0, 4) + 0.0 AS start_s, round((win * 50 + 199) / 50.0, 4) + 0.0 AS end_s, count(*) AS n, CAST(sum(CAST(gx AS BIGINT)) AS BIGINT) AS gx_sum FROM w GROUP BY 1, 2""")
def q_sliding(spark, sf):
    g = WN.sliding_windows(imu6(spark, sf), DEV, "idx", 200, 50, [F.count(F.lit(1)).alias("n"), F.sum(F.col("gx").cast("long")).alias("gx_sum")])
    return g.select("device", "win", r(F.col("win") * 50 / F.lit(50.0), 4).alias("start_s"), r((F.col("win") * 50 + 199) / F.lit(50.0), 4).alias("end_s"), "n", "gx_sum")


@query("window_stats_v2", uses="imu6", sql=LONG_V2 + dft_sql(200, 0.2, 15.0) + PERIOD_SQL + f""", a AS ({STATS_V2} UNION ALL {CORR_SQL} UNION ALL {GRAV_SQL}
UNION ALL SELECT device, win, ch || '_dominant_hz', dominant FROM f UNION ALL SELECT device, win, ch || '_spectral_entropy', entropy FROM f UNION ALL SELECT device, win, ch || '_period_s', period FROM pe)
SELECT device, win, feature, round(value, CASE WHEN feature = 'acc_sma' THEN 8 ELSE 6 END) + 0.0 AS value FROM a""")
def q_v2(spark, sf):
    return long(v2(spark, sf), ["device", "win"])


@query("spectral", uses="imu6", sql=win_sql(200, 50) + ", d AS (SELECT device, win, idx, UNNEST(['acc_mag','gyro_mag']) AS ch, UNNEST([am, gm]) AS x FROM w)" + dft_sql(200, 0.2, 15.0) + """
SELECT device, win, round(max(dominant) FILTER (ch = 'acc_mag'), 5) + 0.0 AS acc_mag_dominant_hz, round(max(entropy) FILTER (ch = 'acc_mag'), 5) + 0.0 AS acc_mag_spectral_entropy,
 round(max(dominant) FILTER (ch = 'gyro_mag'), 5) + 0.0 AS gyro_mag_dominant_hz, round(max(entropy) FILTER (ch = 'gyro_mag'), 5) + 0.0 AS gyro_mag_spectral_entropy FROM f GROUP BY 1, 2""")
def q_spectral(spark, sf):
    g = window_arrays(imu6(spark, sf))
    for c in ("acc_mag", "gyro_mag"):
        g = g.withColumn(f"_{c}", spectral(F.col(c), 50.0))
    return g.select("device", "win", *[r(F.col(f"_{c}.{a}"), 5).alias(f"{c}_{b}") for c in ("acc_mag", "gyro_mag") for a, b in (("dominant_hz", "dominant_hz"), ("entropy", "spectral_entropy"))])


def window_arrays(d, n=200, step=50):
    """Magnitude arrays of each window in row order."""
    d = d.select("device", "idx", S.norm(*[F.col(c) for c in AXES[:3]]).alias("acc_mag"), S.norm(*[F.col(c) for c in AXES[3:]]).alias("gyro_mag"))
    g = WN.sliding_windows(d, DEV, "idx", n, step, [F.sort_array(F.collect_list(F.struct("idx", "acc_mag", "gyro_mag"))).alias("s")])
    return g.select("device", "win", *[F.col("s")[c].alias(c) for c in ("acc_mag", "gyro_mag")])


@query("autocorr_period", uses="imu6", sql=win_sql(200, 50) + ", d AS (SELECT device, win, idx, 'acc_mag' AS ch, am AS x FROM w), ls AS (SELECT device, win, ch, list(x - mu ORDER BY idx) AS xs FROM (SELECT *, avg(x) OVER (PARTITION BY device, win, ch) AS mu FROM d) q GROUP BY 1, 2, 3)" + PERIOD_SQL + """
SELECT device, win, round(period, 5) + 0.0 AS period_s FROM pe""")
def q_period(spark, sf):
    return window_arrays(imu6(spark, sf)).select("device", "win", r(autocorr_period(F.col("acc_mag"), 50.0), 5).alias("period_s"))


@query("axis_correlation", uses="imu6", sql=win_sql(200, 50) + f"SELECT device, win, feature, round(value, 6) + 0.0 AS value FROM ({CORR_SQL}) q")
def q_corr(spark, sf):
    return pick(spark, sf, list(CORR)).unpivot(["device", "win"], list(CORR), "feature", "value")


@query("gravity_direction", uses="imu6", sql=win_sql(200, 50) + f"SELECT device, win, feature, round(value, 6) + 0.0 AS value FROM ({GRAV_SQL}) q")
def q_gravity(spark, sf):
    names = ["gravity_x", "gravity_y", "gravity_z"]
    return pick(spark, sf, names).unpivot(["device", "win"], names, "feature", "value")


@query("sma", uses="imu6", sql=win_sql(200, 50) + """
, q AS (SELECT device, win, avg(ax) AS mx, avg(ay) AS my, avg(az) AS mz FROM w GROUP BY 1, 2)
SELECT w.device, w.win, round(avg(abs(ax - mx) + abs(ay - my) + abs(az - mz)), 8) + 0.0 AS acc_sma FROM w JOIN q ON q.device = w.device AND q.win = w.win GROUP BY 1, 2""")
def q_sma(spark, sf):
    return pick(spark, sf, ["acc_sma"])


V1_SQL = win_sql(100, 50).replace("FROM imu6)", "FROM (SELECT * REPLACE (CASE WHEN idx % 37 = 5 THEN NULL ELSE gx END AS gx) FROM imu6) i6)", 1)
V1 = V1_SQL + """, c AS (SELECT device, win, idx, UNNEST(['acc_x','acc_y','acc_z','gyro_x','gyro_y','gyro_z','angle_x','angle_y','angle_z','acc_mag','gyro_mag','dynamic_acc']) AS ch,
 UNNEST([ax, ay, az, gx, gy, gz, roll, pitch, yaw, am, gm, abs(am - 1)]) AS x FROM w),
d AS (SELECT *, x - lag(x) OVER (PARTITION BY device, win, ch ORDER BY idx) AS dx FROM c WHERE x IS NOT NULL), md AS (SELECT device, win, ch, median(x) AS med FROM d GROUP BY 1, 2, 3),
s AS (SELECT device, win, ch, avg(x) AS mean, stddev_samp(x) AS std, sqrt(avg(x * x)) AS rms, max(x) - min(x) AS rng, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, sqrt(avg(dx * dx)) * 50 AS jerk, median(abs(x - med)) AS mad
 FROM d JOIN md USING (device, win, ch) GROUP BY 1, 2, 3),
u AS (SELECT device, win, ch || '_' || UNNEST(['mean', 'std', 'rms', 'range', 'iqr', 'jerk_rms', 'mad']) AS feature, UNNEST([mean, std, rms, rng, iqr, jerk, mad]) AS value FROM s
 UNION ALL SELECT w.device, w.win, 'acc_sma', avg(abs(ax - mx) + abs(ay - my) + abs(az - mz)) FROM w JOIN (SELECT device, win, avg(ax) AS mx, avg(ay) AS my, avg(az) AS mz FROM w GROUP BY 1, 2) q ON q.device = w.device AND q.win = w.win GROUP BY 1, 2)
"""
V1 += spectra_sql("d") + """
SELECT device, win, feature, round(value, CASE WHEN feature = 'acc_sma' THEN 8 ELSE 6 END) + 0.0 AS value FROM (SELECT * FROM u
 UNION ALL SELECT device, win, ch || '_dom_freq_hz', dominant FROM f UNION ALL SELECT device, win, ch || '_spec_entropy', entropy FROM f) q"""


def holes(spark, sf):
    return imu6(spark, sf).withColumn("gx", F.when(F.col("idx") % 37 != 5, F.col("gx")))


@query("window_stats_v1", uses="imu6", sql=V1)
def q_v1(spark, sf):
    w = WN.window_stats_v1(holes(spark, sf), DEV, "idx", MAP9)
    return long(w.drop("window_start_s", "window_end_s"), ["device", "win"])


LIVE_SQL = win_sql(100, 50) + """, d AS (SELECT device, win, idx, t, UNNEST(['acc_x','acc_y','acc_z','gyro_x','gyro_y','gyro_z','acc_mag','gyro_mag','dynamic_acc']) AS ch, UNNEST([ax, ay, az, gx, gy, gz, am, gm, abs(am - 1)]) AS x FROM w)
""" + spectra_sql("d", "99 / greatest(max(t) OVER q - min(t) OVER q, 1e-6)") + """, s AS (SELECT device, win, ch, avg(x) AS a, stddev_samp(x) AS b, sqrt(avg(x * x)) AS c, any_value(99 / greatest(mt - nt, 1e-6)) AS fs FROM (SELECT *, max(t) OVER q AS mt, min(t) OVER q AS nt FROM d WINDOW q AS (PARTITION BY device, win, ch)) z GROUP BY 1, 2, 3),
u AS (SELECT device, win, ch || '_' || UNNEST(['mean', 'std', 'rms']) AS feature, UNNEST([a, b, c]) AS value FROM s UNION ALL SELECT device, win, 'fs', max(fs) FROM s GROUP BY 1, 2
 UNION ALL SELECT device, win, ch || '_dom_freq_hz', dominant FROM f UNION ALL SELECT device, win, ch || '_spec_entropy', entropy FROM f
 UNION ALL SELECT w.device, w.win, 'acc_sma', avg(abs(ax - mx) + abs(ay - my) + abs(az - mz)) FROM w JOIN (SELECT device, win, avg(ax) AS mx, avg(ay) AS my, avg(az) AS mz FROM w GROUP BY 1, 2) q ON q.device = w.device AND q.win = w.win GROUP BY 1, 2)
SELECT device, win, feature, round(value, CASE WHEN feature = 'acc_sma' THEN 8 ELSE 6 END) + 0.0 AS value FROM u"""


@query("live_features_v1", uses="imu6", sql=LIVE_SQL)
def q_live(spark, sf):
    d = imu6(spark, sf)
    return long(WN.live_features_v1(d, DEV, "idx", "t", MAP, 100, 50), ["device", "win"])


CONTRAST_SQL = """, d AS (SELECT device, win, idx, UNNEST(['acc', 'gyro']) AS ch, UNNEST([am, gm]) AS x FROM w)""" + dft_sql(100, 0.15, 3.0, floor="-1") + """
, md AS (SELECT device, win, median(am) AS med FROM w GROUP BY 1, 2),
s AS (SELECT w.device, w.win, stddev_pop(am) AS a1, quantile_cont(abs(am - med), 0.95) AS a2, avg(gm) AS a3, stddev_pop(gm) AS a4, quantile_cont(gm, 0.95) AS a5, stddev_pop(ax) AS b1, stddev_pop(ay) AS b2, stddev_pop(az) AS b3, stddev_pop(gx) AS b4,
 stddev_pop(gy) AS b5, stddev_pop(gz) AS b6, quantile_cont(roll, 0.95) - quantile_cont(roll, 0.05) AS c1, quantile_cont(pitch, 0.95) - quantile_cont(pitch, 0.05) AS c2, quantile_cont(yaw, 0.95) - quantile_cont(yaw, 0.05) AS c3
 FROM w JOIN md ON md.device = w.device AND md.win = w.win GROUP BY 1, 2),
u AS (SELECT device, win, UNNEST(['acc_mag_std','acc_dynamic_p95','gyro_mag_mean','gyro_mag_std','gyro_mag_p95','acc_x_std','acc_y_std','acc_z_std','gyro_x_std','gyro_y_std','gyro_z_std','angle_x_range_p90','angle_y_range_p90','angle_z_range_p90']) AS feature,
 UNNEST([a1,a2,a3,a4,a5,b1,b2,b3,b4,b5,b6,c1,c2,c3]) AS value FROM s UNION ALL SELECT device, win, ch || '_dominant_hz', dominant FROM f)
SELECT device, win, feature, round(value, 6) + 0.0 AS value FROM u"""


@query("contrast_window_features", uses="imu6", sql=win_sql(100, 50) + CONTRAST_SQL)
def q_contrast(spark, sf):
    return long(WN.contrast_windows(imu6(spark, sf), DEV, "idx", MAP9), ["device", "win"])


@query("recording_contrast_summary", uses="imu6", sql=""", w AS (SELECT *, sqrt(ax*ax+ay*ay+az*az) AS am, sqrt(gx*gx+gy*gy+gz*gz) AS gm, count(*) OVER (PARTITION BY device) AS n FROM imu6),
md AS (SELECT device, median(am) AS med, avg(am) AS ma, avg(gm) AS mg FROM w GROUP BY 1),
bk AS (SELECT device, n, UNNEST(generate_series(CAST(ceil(0.15 * n / 50 - 1e-9) AS BIGINT), CAST(floor(3.0 * n / 50 + 1e-9) AS BIGINT))) AS k FROM (SELECT DISTINCT device, n FROM w) q),
pw AS (SELECT w.device, k, w.n, pow(sum((am - ma) * cos(2*pi()*((idx*k) % w.n)/w.n)), 2) + pow(sum((am - ma) * sin(2*pi()*((idx*k) % w.n)/w.n)), 2) AS pa,
  pow(sum((gm - mg) * cos(2*pi()*((idx*k) % w.n)/w.n)), 2) + pow(sum((gm - mg) * sin(2*pi()*((idx*k) % w.n)/w.n)), 2) AS pg FROM w JOIN md USING (device) JOIN bk ON bk.device = w.device GROUP BY 1, 2, 3),
s AS (SELECT device, any_value(n) AS a0, stddev_pop(am) AS a1, quantile_cont(abs(am - med), 0.95) AS a2, avg(gm) AS a3, stddev_pop(gm) AS a4, quantile_cont(gm, 0.95) AS a5, stddev_pop(ax) AS b1, stddev_pop(ay) AS b2, stddev_pop(az) AS b3, stddev_pop(gx) AS b4,
 stddev_pop(gy) AS b5, stddev_pop(gz) AS b6, quantile_cont(roll, 0.95) - quantile_cont(roll, 0.05) AS c1, quantile_cont(pitch, 0.95) - quantile_cont(pitch, 0.05) AS c2, quantile_cont(yaw, 0.95) - quantile_cont(yaw, 0.05) AS c3
 FROM w JOIN md USING (device) GROUP BY 1),
u AS (SELECT device, UNNEST(['n','acc_mag_std','acc_dynamic_p95','gyro_mag_mean','gyro_mag_std','gyro_mag_p95','acc_x_std','acc_y_std','acc_z_std','gyro_x_std','gyro_y_std','gyro_z_std','angle_x_range_p90','angle_y_range_p90','angle_z_range_p90']) AS feature,
 UNNEST([a0,a1,a2,a3,a4,a5,b1,b2,b3,b4,b5,b6,c1,c2,c3]) AS value FROM s UNION ALL SELECT device, 'acc_dominant_hz', arg_max(k, pa) * 50.0 / any_value(n) FROM pw GROUP BY 1 UNION ALL SELECT device, 'gyro_dominant_hz', arg_max(k, pg) * 50.0 / any_value(n) FROM pw GROUP BY 1)
SELECT device, feature, round(value, 6) + 0.0 AS value FROM u""")
def q_recording(spark, sf):
    d = staged(imu6(spark, sf), "imu6")
    c = WN.recording_contrast(d, DEV, "idx", MAP9)
    return long(c.withColumn("n", F.col("n").cast("double")), DEV)


BASE_SQL = """, nb AS (SELECT device, median(ax) AS m1, median(ay) AS m2, median(az) AS m3, degrees(atan2(avg(sin(radians(roll))), avg(cos(radians(roll))))) AS br,
 degrees(atan2(avg(sin(radians(pitch))), avg(cos(radians(pitch))))) AS bp, degrees(atan2(avg(sin(radians(yaw))), avg(cos(radians(yaw))))) AS by_ FROM mid GROUP BY 1)
"""


def middle(spark, sf):
    d = imu6(spark, sf)
    lo = F.floor(F.col("idx") / 200) * 200
    return P.middle_of_segments(d, "idx", lo, lo + 200)


@query("neutral_baseline", uses="imu6", sql=", mid AS (SELECT * FROM imu6 WHERE idx % 200 >= 30 AND idx % 200 < 170)" + BASE_SQL + """
SELECT device, round(m1 / greatest(sqrt(m1*m1+m2*m2+m3*m3), 1e-9), 5) + 0.0 AS base_ax, round(m2 / greatest(sqrt(m1*m1+m2*m2+m3*m3), 1e-9), 5) + 0.0 AS base_ay, round(m3 / greatest(sqrt(m1*m1+m2*m2+m3*m3), 1e-9), 5) + 0.0 AS base_az,
 round(br, 4) + 0.0 AS base_roll, round(bp, 4) + 0.0 AS base_pitch, round(by_, 4) + 0.0 AS base_yaw FROM nb""")
def q_neutral(spark, sf):
    m = staged(middle(spark, sf).select("device", "ax", "ay", "az", "roll", "pitch", "yaw"), "middle")
    b = P.neutral_baseline(m, DEV, ["ax", "ay", "az"], ["roll", "pitch", "yaw"])
    return b.select("device", *[r(F.col(f"base_{a}"), 5).alias(f"base_{a}") for a in ("ax", "ay", "az")], *[r(F.col(f"base_{a}"), 4).alias(f"base_{a}") for a in ("roll", "pitch", "yaw")])


def with_quats(d):
    q = S.quat_from_euler(F.col("roll"), F.col("pitch"), F.col("yaw"))
    return d.withColumns({f"q{i}": e for i, e in enumerate(q)})


POSTURE_SQL = win_sql(150, 25) + """
, a AS (SELECT *, ((yaw - 30.5 + 180) % 360 + 360) % 360 - 180 AS ry, ((roll - 10.5 + 180) % 360 + 360) % 360 - 180 AS rr, ((pitch + 20.5 + 180) % 360 + 360) % 360 - 180 AS rp FROM w),
s AS (SELECT device, win, avg(rr) AS r1, median(rr) AS r2, stddev_pop(rr) AS r3, arg_max(rr, idx) AS r4, max(rr) - min(rr) AS r5, avg(rp) AS p1, median(rp) AS p2, stddev_pop(rp) AS p3, arg_max(rp, idx) AS p4, max(rp) - min(rp) AS p5,
 avg(ry) AS y1, median(ry) AS y2, stddev_pop(ry) AS y3, arg_max(ry, idx) AS y4, max(ry) - min(ry) AS y5, avg(gm) AS g1, quantile_cont(gm, 0.95) AS g2, sqrt(avg(gm*gm)) AS g3, stddev_pop(am) AS d1, max(am) - min(am) AS d2, avg(ax) AS ux, avg(ay) AS uy, avg(az) AS uz FROM a GROUP BY 1, 2),
t AS (SELECT *, greatest(sqrt(ux*ux+uy*uy+uz*uz), 1e-9) AS l FROM s),
h AS (SELECT device, win, idx, radians(roll) / 2 AS a, radians(pitch) / 2 AS b, radians(yaw) / 2 AS c, radians(10.5) / 2 AS a0, radians(-20.5) / 2 AS b0, radians(30.5) / 2 AS c0 FROM w),
qq AS (SELECT device, win, idx, cos(a)*cos(b)*cos(c)+sin(a)*sin(b)*sin(c) AS w2, sin(a)*cos(b)*cos(c)-cos(a)*sin(b)*sin(c) AS x2, cos(a)*sin(b)*cos(c)+sin(a)*cos(b)*sin(c) AS y2, cos(a)*cos(b)*sin(c)-sin(a)*sin(b)*cos(c) AS z2,
 cos(a0)*cos(b0)*cos(c0)+sin(a0)*sin(b0)*sin(c0) AS w1, -(sin(a0)*cos(b0)*cos(c0)-cos(a0)*sin(b0)*sin(c0)) AS x1, -(cos(a0)*sin(b0)*cos(c0)+sin(a0)*cos(b0)*sin(c0)) AS y1, -(cos(a0)*cos(b0)*sin(c0)-sin(a0)*sin(b0)*cos(c0)) AS z1 FROM h),
rq AS (SELECT device, win, idx, w1*w2-x1*x2-y1*y2-z1*z2 AS q0, w1*x2+x1*w2+y1*z2-z1*y2 AS q1, w1*y2-x1*z2+y1*w2+z1*x2 AS q2, w1*z2+x1*y2-y1*x2+z1*w2 AS q3 FROM qq),
rn AS (SELECT device, win, idx, CASE WHEN q0 < 0 THEN -1 ELSE 1 END AS s, abs(q0) AS q0, q1, q2, q3, sqrt(q1*q1+q2*q2+q3*q3) AS m FROM rq),
rv AS (SELECT device, win, idx, UNNEST(['x', 'y', 'z']) AS ax, degrees(UNNEST([q1, q2, q3]) * s * CASE WHEN m > 1e-9 THEN 2 * atan2(m, least(q0, 1)) / m ELSE 2 END) AS v, degrees(m * CASE WHEN m > 1e-9 THEN 2 * atan2(m, least(q0, 1)) / m ELSE 2 END) AS d FROM rn),
rs AS (SELECT device, win, ax, avg(v) AS v1, median(v) AS v2, stddev_pop(v) AS v3, arg_max(v, idx) AS v4, avg(d) AS d1, quantile_cont(d, 0.95) AS d2 FROM rv GROUP BY 1, 2, 3),
u AS (SELECT device, win, 'rotation_vector_' || ax || '_' || UNNEST(['mean', 'median', 'std', 'last']) AS feature, UNNEST([v1, v2, v3, v4]) AS value FROM rs UNION ALL SELECT device, win, UNNEST(['rotation_degrees_mean', 'rotation_degrees_p95']), UNNEST([d1, d2]) FROM rs WHERE ax = 'x'
UNION ALL SELECT device, win, UNNEST(['relative_roll_mean','relative_roll_median','relative_roll_std','relative_roll_last','relative_roll_range','relative_pitch_mean','relative_pitch_median','relative_pitch_std','relative_pitch_last','relative_pitch_range',
 'relative_yaw_mean','relative_yaw_median','relative_yaw_std','relative_yaw_last','relative_yaw_range','gyro_mean_dps','gyro_p95_dps','gyro_rms_dps','dynamic_acc_std_g','dynamic_acc_range_g','gravity_change_degrees','relative_gravity_x','relative_gravity_y','relative_gravity_z','window_seconds']) AS feature,
 UNNEST([r1,r2,r3,r4,r5,p1,p2,p3,p4,p5,y1,y2,y3,y4,y5,g1,g2,g3,d1,d2,degrees(acos(least(1, greatest(-1, (ux*0.6+uz*0.8)/l)))), ux/l - 0.6, uy/l, uz/l - 0.8, 149/50.0]) AS value FROM t)
SELECT device, win, feature, round(value, 4) + 0.0 AS value FROM u"""


@query("posture_window_features", uses="imu6", sql=POSTURE_SQL)
def q_posture(spark, sf):
    return long(posture_features(with_quats(imu6(spark, sf))), ["device", "win"], 4)


def posture_features(d):
    base = {"ax": F.lit(0.6), "ay": F.lit(0.0), "az": F.lit(0.8), "roll": F.lit(10.5), "pitch": F.lit(-20.5), "yaw": F.lit(30.5)}
    base.update({f"q{i}": e for i, e in enumerate(S.quat_from_euler(base["roll"], base["pitch"], base["yaw"]))})
    return P.posture_windows(d, DEV, "idx", base)


@query("cap_windows_linspace", uses="windows1", sql="""
, n AS (SELECT device, count(*) AS n FROM windows1 GROUP BY 1), k AS (SELECT device, n, UNNEST(generate_series(0, 39)) AS k FROM n WHERE n > 40),
q AS (SELECT device, CAST(round_even(k * ((n - 1) / 39.0), 0) AS BIGINT) AS t FROM k) SELECT device, t, p_motion FROM windows1 SEMI JOIN (SELECT * FROM q UNION ALL SELECT device, t FROM windows1 JOIN n USING (device) WHERE n <= 40) z USING (device, t)""")
def q_cap(spark, sf):
    w = windows1(spark, sf)
    n = w.groupBy("device").agg(F.count(F.lit(1)).alias("n"))
    return O.spread_join(w, n, DEV).filter(WN.keep_linspace(F.col("t"), F.col("n"), 40)).select("device", "t", "p_motion")
