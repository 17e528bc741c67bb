"""Queries: packets, live path, state machines, sessions and summaries (batch forms)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import taxonomy as T
from ..functions.scalar import rounded as r
from ..operators import episodes as EP
from ..operators import evaluate as E
from ..operators import live as LV
from ..operators import packets as PK
from ..operators import posture as P
from ..operators import quality as Q
from ..operators import windows as WN
from ..operators.ordered import number_rows, spread_join
from ..session import staged
from ..streaming import scoring as SC
from .q_windows import MAP, with_quats
from .registry import query
from .views import AXES, imu6, segments1, stream1, table, windows1

DEV = ["device"]


# --- packets ---------------------------------------------------------------------------------


def _int16(v):
    """Little-endian hex of a 16-bit integer column."""
    byte = lambda b: F.lpad(F.hex(b), 2, "0")
    return F.concat(byte(v.bitwiseAND(255)), byte(F.shiftright(v, 8).bitwiseAND(255)))


def raw_axes():
    c = F.col
    scale = [(c("ax"), 2048), (c("ay"), 2048), (c("az"), 2048), (c("gx"), 16), (c("gy"), 16), (c("gz"), 16), (c("roll"), 182), (c("pitch"), 182), (c("yaw"), 182)]
    return [F.floor(x * k).cast("int") for x, k in scale]


RAW_SQL = "floor(ax * 2048) * 16 / 32768 AS ax_g, floor(gx * 16) * 2000 / 32768 AS gx_dps, floor(yaw * 182) * 180 / 32768 AS yaw_deg"


def frame_chunks(spark, sf):
    """imu6 as a byte stream: noise before some frames, every frame split over two chunks."""
    d = imu6(spark, sf)
    body = F.concat(F.lit("5561"), *[_int16(v) for v in raw_axes()])
    noise = F.when(F.col("idx") % 7 == 3, "AA55").when(F.col("idx") % 11 == 5, "0155AA").otherwise("")
    text = F.concat(noise, body)
    parts = F.array(F.struct((F.col("idx") * 2).alias("i"), F.substring(text, 1, 26).alias("h")), F.struct((F.col("idx") * 2 + 1).alias("i"), F.expr("substring(text, 27)").alias("h")))
    return d.withColumn("text", text).select("device", "t", F.explode(parts).alias("p")).select("device", F.col("p.i").alias("idx"), F.col("t").alias("arrival"), F.unhex("p.h").alias("payload"))


@query("packets_decode_fixed", uses="imu6", sql=f"""
, l AS (SELECT device, sum(CASE WHEN idx % 7 = 3 THEN 2 WHEN idx % 11 = 5 THEN 3 ELSE 0 END) AS lost FROM imu6 GROUP BY 1)
SELECT device, t AS arrival, {RAW_SQL}, CAST(lost AS BIGINT) AS discarded FROM imu6 JOIN l USING (device)""")
def q_frames(spark, sf):
    d = PK.decode_frames(staged(frame_chunks(spark, sf), "chunks"), DEV, "idx", "arrival", "payload")
    d = staged(d.select("device", "arrival", "ax_g", "gx_dps", "yaw_deg", "discarded"), "frames")
    lost = d.groupBy("device").agg(F.sum("discarded").alias("discarded"))
    return spread_join(d.filter("ax_g IS NOT NULL").select("device", "arrival", "ax_g", "gx_dps", "yaw_deg"), lost, DEV)


@query("packets_decode_batch", uses="imu6", sql=f"""
SELECT device, idx, CASE WHEN idx % 19 = 4 THEN 'unsupported_packet' WHEN idx % 17 = 3 THEN 'length_mismatch' WHEN idx % 13 = 2 THEN 'crc_failed' END AS reason,
 CASE WHEN NOT (idx % 13 = 2 OR idx % 17 = 3 OR idx % 19 = 4) THEN idx % 65536 END AS sequence_id, CASE WHEN NOT (idx % 13 = 2 OR idx % 17 = 3 OR idx % 19 = 4) THEN floor(ax * 2048) * 16 / 32768 END AS ax_g,
 CASE WHEN NOT (idx % 13 = 2 OR idx % 17 = 3 OR idx % 19 = 4) THEN floor(gz * 16) * 2000 / 32768 END AS gz_dps FROM imu6""")
def q_compact(spark, sf):
    d = PK.decode_compact(compact_packets(imu6(spark, sf)), "payload")
    s = d.withColumn("s", F.explode_outer("samples"))
    return s.select("device", "idx", "reason", F.col("s.sequence_id").cast("long").alias("sequence_id"), F.col("s.ax_g").alias("ax_g"), F.col("s.gz_dps").alias("gz_dps"))


def compact_packets(d):
    """One-sample compact packets with a CRC; some damaged."""
    i = F.col("idx")
    body = F.concat(F.when(i % 19 == 4, "494E").otherwise("494D"), F.lit("0101"), _int16((i % 65536).cast("int")), *[_int16(v) for v in raw_axes()[:6]])
    d = d.withColumn("_h", body)
    d = d.withColumn("_c", PK.crc_of(F.unhex("_h")))
    crc = F.when(i % 13 == 2, F.col("_c").bitwiseXOR(1)).otherwise(F.col("_c"))
    text = F.concat("_h", _int16(crc), F.when(i % 17 == 3, "00").otherwise(""))
    return d.select("device", "idx", F.unhex(text).alias("payload"))


# --- clocks and normalisation ----------------------------------------------------------------

CLOCK_SQL = """, n AS (SELECT device, idx, row_id % 8 + 1 AS n, idx * 0.05 + (row_id % 7) * 0.003 + floor(idx / 20) AS a FROM stream1),
p AS (SELECT *, a - lag(a) OVER (PARTITION BY device ORDER BY idx) AS e FROM n), q AS (SELECT *, coalesce(last_value(CASE WHEN e > 1e-5 AND e / n BETWEEN 0.0002 AND 0.1 THEN e / n END IGNORE NULLS) OVER (PARTITION BY device ORDER BY idx ROWS UNBOUNDED PRECEDING), 0.01) AS period FROM p),
s AS (SELECT *, period * (n - 1) AS span, CASE WHEN idx = 0 OR n = 1 THEN a ELSE a - period * (n - 1) END AS wish, sum(period * (n - 1) + 1e-6) OVER (PARTITION BY device ORDER BY idx ROWS UNBOUNDED PRECEDING) AS ss FROM q),
m AS (SELECT *, max(wish + span - ss) OVER (PARTITION BY device ORDER BY idx ROWS UNBOUNDED PRECEDING) AS mm FROM s)
"""


def notifications(spark, sf):
    i = F.col("idx")
    return stream1(spark, sf).select("device", "idx", (F.col("row_id") % 8 + 1).alias("n"), (i * 0.05 + (F.col("row_id") % 7) * 0.003 + F.floor(i / 20)).alias("arrival"))


@query("assign_batch_clock", uses="stream1", sql=CLOCK_SQL + "SELECT device, idx, round(mm + ss - span, 6) + 0.0 AS first_s, round(period, 7) + 0.0 AS period_s FROM m")
def q_clock(spark, sf):
    d = LV.assign_batch_clock(staged(notifications(spark, sf), "notify"), DEV, "idx", "n", "arrival")
    return d.select("device", "idx", r(F.col("first_s")).alias("first_s"), r(F.col("period_s"), 7).alias("period_s"))


NORM_SQL = """, j AS (SELECT device, idx, idx * 0.012 + (abs(gx) % 3) * 0.005 + floor(idx / 150) * 0.5 AS t0, ax, gx FROM imu6),
u AS (SELECT device, idx, ax, gx, max(t0 - idx * 1e-6) OVER (PARTITION BY device ORDER BY idx ROWS UNBOUNDED PRECEDING) + idx * 1e-6 AS t FROM j),
b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY device ORDER BY idx) <= 0.25 THEN NULL ELSE idx END AS st FROM u),
s AS (SELECT *, max(st) OVER (PARTITION BY device ORDER BY idx ROWS UNBOUNDED PRECEDING) AS seg FROM b),
z AS (SELECT device, seg, min(t) AS o, max(t) - min(t) AS dur FROM s GROUP BY 1, 2),
rr AS (SELECT s.device, s.seg, t - o AS rt, ax, gx, lead(t - o) OVER w AS nt, lead(ax) OVER w AS nax, lead(gx) OVER w AS ngx FROM s JOIN z ON z.device = s.device AND z.seg = s.seg WINDOW w AS (PARTITION BY s.device, s.seg ORDER BY idx)),
g AS (SELECT device, seg, o, k, k / 100.0 AS gt FROM z, LATERAL (SELECT UNNEST(generate_series(0, CAST(least(round(dur * 100), floor((dur + 1e-9) * 100)) AS BIGINT))) AS k)),
v AS (SELECT g.*, CASE WHEN nt IS NULL THEN ax ELSE ax + (nax - ax) * (gt - rt) / (nt - rt) END AS ax, CASE WHEN nt IS NULL THEN gx ELSE gx + (ngx - gx) * (gt - rt) / (nt - rt) END AS gx FROM g ASOF JOIN rr ON g.device = rr.device AND g.seg = rr.seg AND g.gt >= rr.rt)
SELECT device, seg, k, round(o + gt, 5) + 0.0 AS t, round(avg(ax) OVER w, 5) + 0.0 AS ax, round(avg(gx) OVER w, 4) + 0.0 AS gx FROM v WINDOW w AS (PARTITION BY device, seg ORDER BY k ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""


def jittered(spark, sf):
    i = F.col("idx")
    return imu6(spark, sf).withColumn("t", i * 0.012 + (F.abs("gx") % 3) * 0.005 + F.floor(i / 150) * 0.5)


@query("live_normalize", uses="imu6", sql=NORM_SQL)
def q_normalize(spark, sf):
    d = LV.live_normalize(staged(jittered(spark, sf).select("device", "idx", "t", "ax", "gx"), "jitter"), DEV, "idx", "t", ["ax", "gx"])
    return d.select("device", "seg", "k", r(F.col("t"), 5).alias("t"), r(F.col("ax"), 5).alias("ax"), r(F.col("gx"), 4).alias("gx"))


@query("sequence_gaps", uses="stream1", sql="""
, l AS (SELECT device, row_id, idx, ((sequence_id - lag(sequence_id) OVER (PARTITION BY device ORDER BY idx) - 1) % 65536 + 65536) % 65536 AS g FROM stream1)
SELECT device, row_id, CAST(coalesce(sum(g) OVER (PARTITION BY device ORDER BY idx ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS sequence_gaps FROM l""")
def q_sequence(spark, sf):
    d = LV.sequence_gaps(stream1(spark, sf), DEV, "idx", "sequence_id")
    return d.select("device", "row_id", "sequence_gaps")


def emissions(d, window, hop, **kw):
    return LV.causal_emissions(d, DEV, "t", window, hop, **kw)


def emit_sql(window, hop, keep=0.25, minimum=16, span=0.95):
    """Emission times of ``imu6`` as a CTE ``em`` (device, now), one after another in a recursion."""
    return f""", eo AS (SELECT device, t, count(*) OVER w AS n, min(t) OVER w AS o FROM imu6 WINDOW w AS (PARTITION BY device ORDER BY CAST(round(t * 1000000) AS BIGINT) RANGE BETWEEN {int((window + keep) * 1e6)} PRECEDING AND CURRENT ROW)),
ek AS (SELECT device, t FROM eo WHERE n >= {minimum} AND t - o >= {span * window!r} - 1e-9),
em AS (WITH RECURSIVE r AS (SELECT device, min(t) AS now FROM ek GROUP BY 1 UNION ALL SELECT r.device, min(ek.t) FROM r JOIN ek ON ek.device = r.device AND ek.t >= r.now + {hop!r} - 1e-9 GROUP BY r.device, r.now) SELECT device, now FROM r)
"""


@query("causal_windows", uses="imu6", sql=emit_sql(4.0, 1.0) + "SELECT em.device, em.now, count(*) AS samples, min(t) AS oldest_s FROM em JOIN imu6 ON imu6.device = em.device AND t >= now - 4.0 - 1e-9 AND t <= now GROUP BY 1, 2")
def q_causal(spark, sf):
    d = staged(imu6(spark, sf).select("device", "idx", "t"), "samples")
    e = emissions(d, 4.0, 1.0)
    w = LV.emission_windows(d, e, DEV, "t", 4.0)
    return w.select("device", "now", F.size("t").cast("long").alias("samples"), F.array_min("t").alias("oldest_s"))


LIVE_MODEL = {"intercept": -0.4, "median": [0.5, 0.3, 0.2], "mean": [0.5, 0.3, 1.0], "scale": [0.2, 0.1, 2.0], "coefficients": [0.9, 0.7, 0.1]}
LIVE_FEATURES = ["dynamic_acc_mean", "acc_mag_std", "gyro_mag_dom_freq_hz"]


def exercise_scores(d, key, model=LIVE_MODEL, hz=100.0):
    n = staged(LV.live_normalize(d, key, "idx", "t", AXES, hz, whole=True), "normalised")
    e = staged(LV.causal_emissions(n, key, "t", 2.0, 1.0, keep=0.0, minimum=160, span=0.9), "emissions")
    f = LV.window_features_live(LV.emission_windows(n, e, key, "t", 2.0, AXES), key, "t", MAP, 160)
    s = E.logistic_score(f, LIVE_FEATURES, model, "probability")
    s = number_rows(s.select(*key, "now", "probability"), key, ["now"], F.floor(F.col("now") / 600))
    s = s.withColumn("label", F.when(F.col("probability") >= 0.5, "motion").otherwise("non_motion"))
    return EP.debounce_count(staged(s, "scored"), key, "idx", "label").select(*key, "now", "probability", "stable")


@query("live_exercise_score")
def q_live_exercise(spark, sf):
    s = exercise_scores(staged(imu6(spark, sf).select("device", "idx", "t", *AXES), "samples"), DEV)
    return s.withColumn("probability", r(F.col("probability")))


CLASSES = ["run", "squat", "sitting", "standing"]
WEIGHTS = {"run": (0.8, 1.2, 0.01), "squat": (3.0, 2.0, 0.005), "sitting": (-1.0, -1.5, 0.0), "standing": (-0.8, -1.0, 0.002)}


def activity_probabilities(f):
    """A fixed softmax over three features: the place of a fitted model's numbers."""
    z = {c: a * F.col("acc_mag_mean") + b * F.col("dynamic_acc_std") + g * F.col("gyro_mag_std") for c, (a, b, g) in WEIGHTS.items()}
    e = {c: F.exp(v) for c, v in z.items()}
    total = sum((e[c] for c in CLASSES[1:]), e[CLASSES[0]])
    return f.withColumns({c: v / total for c, v in e.items()})


LIVE_SCORES = {**WEIGHTS, "other_motion": (0.9, 0.6, 0.004), "other_non_motion": (-0.2, -0.6, 0.001)}
LIVE_SOFTMAX = SC.Softmax(tuple(LIVE_SCORES), ("acc_mag_mean", "dynamic_acc_std", "gyro_mag_std"), tuple(LIVE_SCORES.values()))
LIVE_MOTION = ("run", "squat", "other_motion")


def activity_machine(t, axes, seq):
    return SC.Activity(t, axes, seq, LIVE_SOFTMAX, LIVE_MOTION, {"run": "cardio", "squat": "strength"}, temperature=1.3)


def activity_scores(d, key, m):
    """The batch twin of ``SC.activity`` with the same numbers: every column of the stream."""
    from .q_quality import confidence_fallback

    c = F.col
    e = staged(LV.causal_emissions(d, key, m.t, m.window, m.hop), "emissions")
    g = staged(LV.emission_grid(d, e, key, "idx", m.t, m.axes, m.window, m.fs), "grid")
    f = LV.window_features_v2(g, key, dict(zip(WN.AXES, m.axes)), m.fs, int(round(m.window * m.fs)), sorted(m.model.features))
    p = E.temperature_apply(f.withColumns(m.model.columns()), list(m.model.classes), F.lit(m.temperature))
    p = p.join(Q.signal_quality(LV.grid_rows(g, m.axes), [*key, "now"], m.axes[:3], m.axes[3:]), [*key, "now"])
    gaps = LV.sequence_gaps(d.select(*key, "idx", c(m.t).alias("now"), m.seq), key, "idx", m.seq).join(e.withColumnRenamed("t", "now"), [*key, "now"]).select(*key, "now", "sequence_gaps")
    p = p.join(gaps, [*key, "now"])
    named = F.map_from_arrays(F.array(*[F.lit(x) for x in m.model.classes]), F.array(*[c(x) for x in m.model.classes]))
    action, motion = confidence_fallback(named, list(m.motion), m.threshold)
    valid = c("state") != "poor"
    return p.select(*key, "now", action.alias("action"), T.activity_family(action).alias("activity_family"), F.array_max(F.map_values(named)).alias("action_probability"), motion.alias("motion_probability"),
                    sum(c(x) for x in SC.UNKNOWN if x in m.model.classes).alias("unknown_probability"), F.when(valid, F.when(motion >= 0.5, "motion").otherwise("non_motion")).alias("motion_state"),
                    F.when(valid, "valid").otherwise("invalid").alias("wear_state"), c("state").alias("signal_quality"), "sequence_gaps")


def softmax_sql(scores, features):
    """Class scores of ``LIVE_SOFTMAX`` at temperature 1.3 over a relation with its features: p0, p1, ..."""
    z = [" + ".join(f"{w!r} * {f}" for w, f in zip(ws, features)) for ws in scores.values()]
    total = " + ".join(f"exp({x})" for x in z)
    q = [f"pow(greatest(1e-9, exp({x}) / ({total})), 1 / 1.3)" for x in z]
    return [f"({x}) / ({' + '.join(q)})" for x in q]


LIVE_ACTIVITY_SQL = emit_sql(4.0, 1.0) + """, sq AS (SELECT device, idx, t, (idx + idx // 97 * 3) % 65536 AS s FROM imu6),
sg AS (SELECT device, t, sum(g) OVER (PARTITION BY device ORDER BY idx) AS gaps FROM (SELECT *, coalesce(((s - lag(s) OVER (PARTITION BY device ORDER BY idx) - 1) % 65536 + 65536) % 65536, 0) AS g FROM sq) q),
w AS (SELECT em.device, now, sqrt(ax*ax+ay*ay+az*az) AS am, sqrt(gx*gx+gy*gy+gz*gz) AS gm, (CASE WHEN abs(ax) >= 15.9 THEN 1 ELSE 0 END + CASE WHEN abs(ay) >= 15.9 THEN 1 ELSE 0 END + CASE WHEN abs(az) >= 15.9 THEN 1 ELSE 0 END
  + CASE WHEN abs(gx) >= 1990 THEN 1 ELSE 0 END + CASE WHEN abs(gy) >= 1990 THEN 1 ELSE 0 END + CASE WHEN abs(gz) >= 1990 THEN 1 ELSE 0 END) / 6.0 AS clip FROM (SELECT device, now, UNNEST(generate_series(1, 200)) AS k FROM em) em JOIN imu6 ON imu6.device = em.device AND idx = greatest(0, CAST(round(now * 50) AS BIGINT) - 200 + k)),
md AS (SELECT device, now, median(am) AS med FROM w GROUP BY 1, 2),
f AS (SELECT w.device, w.now, avg(am) AS acc_mag_mean, stddev_pop(abs(am - med)) AS dynamic_acc_std, stddev_pop(gm) AS gyro_mag_std, avg(clip) AS clip FROM w JOIN md ON md.device = w.device AND md.now = w.now GROUP BY 1, 2),
p AS (SELECT device, now, clip, """ + ", ".join(f"{x} AS p{i}" for i, x in enumerate(softmax_sql(LIVE_SCORES, LIVE_SOFTMAX.features))) + f""" FROM f),
b AS (SELECT *, greatest({", ".join(f"p{i}" for i in range(len(LIVE_SCORES)))}) AS top, least(1, {" + ".join(f"p{i}" for i, c in enumerate(LIVE_SCORES) if c in LIVE_MOTION)}) AS motion, {" + ".join(f"p{i}" for i, c in enumerate(LIVE_SCORES) if c in SC.UNKNOWN)} AS unknown FROM p),
a AS (SELECT *, CASE WHEN top >= 0.65 THEN CASE {" ".join(f"WHEN p{i} = top THEN '{c}'" for i, c in enumerate(LIVE_SCORES))} END WHEN motion >= 0.5 THEN 'other_motion' ELSE 'other_non_motion' END AS action,
  CASE WHEN clip > 0.02 THEN 'poor' WHEN clip > 0.002 THEN 'fair' ELSE 'good' END AS q FROM b)
SELECT a.device, a.now, action, CASE action WHEN 'run' THEN 'cardio' WHEN 'squat' THEN 'strength' ELSE 'other' END AS activity_family, round(top, 6) + 0.0 AS action_probability, round(motion, 6) + 0.0 AS motion_probability, round(unknown, 6) + 0.0 AS unknown_probability,
 CASE WHEN q = 'poor' THEN NULL WHEN motion >= 0.5 THEN 'motion' ELSE 'non_motion' END AS motion_state, CASE WHEN q = 'poor' THEN 'invalid' ELSE 'valid' END AS wear_state, q AS signal_quality, CAST(gaps AS BIGINT) AS sequence_gaps FROM a JOIN sg ON sg.device = a.device AND sg.t = a.now"""


@query("live_activity_score", uses="imu6", sql=LIVE_ACTIVITY_SQL)
def q_live_activity(spark, sf):
    d = imu6(spark, sf).select("device", "idx", "t", *AXES, ((F.col("idx") + F.floor(F.col("idx") / 97) * 3) % 65536).alias("seq"))
    out = activity_scores(staged(d, "samples"), DEV, activity_machine("t", AXES, "seq"))
    return out.withColumns({n: r(F.col(n)) for n in ("action_probability", "motion_probability", "unknown_probability")})


# --- orientation and posture -----------------------------------------------------------------


@query("orientation_fusion")
def q_fusion(spark, sf):
    d = imu6(spark, sf).select("device", "idx", "t", *AXES).withColumn("calibrating", F.col("t") <= 2.0)
    o = LV.orientation_fusion(staged(d, "samples"), DEV, "idx", "t", "calibrating")
    return o.select("device", "idx", *[r(F.col(c), 6).alias(c) for c in ("roll_deg", "pitch_deg", "yaw_deg", "q0")])


@query("orientation_source_pick", uses="imu6", sql="""
, h AS (SELECT device, idx, device % 3 <> 0 AS hard, device % 2 = 0 AS haveq, radians(roll)/2 AS a, radians(pitch*0.9)/2 AS b, radians(yaw)/2 AS c, roll, pitch * 0.9 AS pitch, yaw, ax, gx FROM imu6)
SELECT device, idx, CASE WHEN hard THEN 'hardware_euler' ELSE 'six_axis_relative' END AS orientation_source, CASE WHEN hard THEN 'reliable' ELSE 'degraded' END AS yaw_reliability, round(CASE WHEN hard THEN roll ELSE ax END, 6) + 0.0 AS roll,
 round(CASE WHEN hard THEN CASE WHEN haveq THEN 0.5 ELSE cos(a)*cos(b)*cos(c)+sin(a)*sin(b)*sin(c) END ELSE gx END, 6) + 0.0 AS q0 FROM h""")
def q_pick(spark, sf):
    c = F.col
    d = imu6(spark, sf)
    d = d.withColumns({"hr": c("roll"), "hp": c("pitch") * 0.9, "hy": c("yaw"), **{f"h{i}": F.when(c("device") % 2 == 0, 0.5) for i in range(4)},
                       "fr": c("ax"), "fp": c("ay"), "fy": c("az"), **{f"f{i}": c("gx") for i in range(4)}, "src": F.when(c("device") % 3 != 0, "hardware_euler")})
    o = P.orientation_source(d, F.coalesce("src", F.lit("none")), ["hr", "hp", "hy"], ["h0", "h1", "h2", "h3"], ["fr", "fp", "fy", "f0", "f1", "f2", "f3"])
    return o.select("device", "idx", "orientation_source", "yaw_reliability", r(c("roll")).alias("roll"), r(c("q0")).alias("q0"))


CALIBRATE_SQL = """, s AS (SELECT device, idx, t, sqrt(gx*gx+gy*gy+gz*gz) / 16 AS g FROM imu6),
e AS (SELECT a.device, a.t AS st, min(b.t) AS en FROM s a JOIN s b ON b.device = a.device AND b.t >= a.t + 2.0 - 1e-9 GROUP BY 1, 2),
x AS (SELECT e.*, n.t AS nx FROM e JOIN s ON s.device = e.device AND s.t = en LEFT JOIN s n ON n.device = e.device AND n.idx = s.idx + 1),
ch AS (WITH RECURSIVE r AS (SELECT device, min(t) AS st, 1 AS k FROM s GROUP BY 1 UNION ALL SELECT r.device, nx, k + 1 FROM r JOIN x ON x.device = r.device AND x.st = r.st WHERE nx IS NOT NULL) SELECT * FROM r),
tr AS (SELECT ch.device, k, ch.st, en, avg(g) AS m FROM ch JOIN x ON x.device = ch.device AND x.st = ch.st JOIN s ON s.device = ch.device AND s.t >= ch.st AND s.t <= en GROUP BY 1, 2, 3, 4),
ok AS (SELECT device, min(k) AS k FROM tr WHERE m <= 7.6 GROUP BY 1), n AS (SELECT device, max(k) AS n FROM tr GROUP BY 1), dv AS (SELECT DISTINCT device FROM s)
SELECT dv.device, ok.k IS NOT NULL AS ok, tr.st AS start, en AS "end", round(m, 6) + 0.0 AS mean_gyro, CAST(coalesce(ok.k, n, 0) AS INTEGER) AS attempts
FROM dv LEFT JOIN ok ON ok.device = dv.device LEFT JOIN tr ON tr.device = ok.device AND tr.k = ok.k LEFT JOIN n ON n.device = dv.device"""


@query("posture_calibrate", uses="imu6", sql=CALIBRATE_SQL)
def q_calibrate(spark, sf):
    d = imu6(spark, sf)
    g = S.norm(F.col("gx"), F.col("gy"), F.col("gz")) / 16
    out = LV.posture_calibrate(staged(d.select("device", "t", g.alias("g")), "cal"), DEV, "t", F.col("g"), seconds=2.0, limit=7.6)
    return out.withColumn("mean_gyro", r(F.col("mean_gyro")))


HOLD_SQL = """c AS (SELECT *, CASE WHEN lab IS NOT DISTINCT FROM lag(lab) OVER w AND idx > 0 THEN 0 ELSE 1 END AS ch FROM o WINDOW w AS (PARTITION BY device ORDER BY idx)),
ru AS (SELECT *, sum(ch) OVER (PARTITION BY device ORDER BY idx) AS run FROM c),
rn AS (SELECT device, run, any_value(lab) AS label, min(t) AS s, max(t) AS e FROM ru WHERE lab IS NOT NULL GROUP BY 1, 2),
hd AS (SELECT * FROM rn WHERE e - s >= CASE WHEN label = 'normal' THEN 5 ELSE 30 END),
tn AS (SELECT * FROM (SELECT *, coalesce(lag(label) OVER (PARTITION BY device ORDER BY run), 'normal') AS before FROM hd) q WHERE label <> before),
ep AS (SELECT *, lead(s) OVER (PARTITION BY device ORDER BY run) AS ended FROM tn)
SELECT device, label, CAST(s AS DOUBLE) AS started_at, CAST(ended AS DOUBLE) AS ended_at, CAST(ended - s AS DOUBLE) AS duration_s FROM ep WHERE label <> 'normal'"""


@query("debounce_hold", uses="windows1", sql=", o AS (SELECT device, t AS idx, t * 12.0 AS t, CASE WHEN p_motion >= 0.6 THEN 'poor' ELSE 'normal' END AS lab FROM windows1), " + HOLD_SQL)
def q_hold(spark, sf):
    d = windows1(spark, sf).select("device", F.col("t").alias("idx"), (F.col("t") * 12.0).alias("time"), F.when(F.col("p_motion") >= 0.6, "poor").otherwise("normal").alias("lab"))
    return EP.debounce_hold(staged(d, "win"), DEV, "idx", "time", "lab")


MONITOR_SQL = """, i AS (SELECT device, t AS idx, t * 12.0 AS t, p_motion, (p_motion * 100 - 50) AS pitch, abs(p_motion - 0.5) * 2 AS conf, CAST(round(p_motion * 100) AS INT) % 7 <> 3 AS stable FROM windows1),
o AS (SELECT device, idx, t, CASE WHEN conf >= 0.3 AND stable THEN CASE WHEN p_motion >= 0.5 OR abs(pitch) >= 40 THEN 'poor' ELSE 'normal' END END AS lab FROM i), """


@query("posture_monitor", uses="windows1", sql=MONITOR_SQL + HOLD_SQL)
def q_monitor(spark, sf):
    c = F.col
    d = windows1(spark, sf).select("device", c("t").alias("idx"), (c("t") * 12.0).alias("time"), (c("p_motion") * 100 - 50).alias("pitch"), (F.abs(c("p_motion") - 0.5) * 2).alias("confidence"),
                                   (F.round(c("p_motion") * 100).cast("int") % 7 != 3).alias("stable"), F.when(c("p_motion") >= 0.5, "head_down").otherwise("normal").alias("predicted"))
    return posture_monitor(staged(d, "win"), F.lit(0.0), c("pitch"), F.lit(0.0), F.lit(False), threshold=0.3, limit=40.0)


def posture_monitor(d, roll, pitch, yaw, yaw_reliable, threshold=0.6, limit=15.0):
    """Posture episodes: prediction or policy says poor, unsure or unstable windows count as no news."""
    c = F.col
    policy = T.posture_state(T.posture_deviations(roll, pitch, yaw, yaw_reliable, limit))
    seen = F.when((c("predicted") != "normal") | (policy == "poor"), "poor").otherwise("normal")
    d = d.withColumn("observed", F.when((c("confidence") >= threshold) & c("stable"), seen))
    return EP.debounce_hold(d, ["device"], "idx", "time", "observed")


@query("debounce_count", uses="windows1", sql="""
, c AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY device ORDER BY t) THEN 0 ELSE 1 END AS ch FROM windows1), u AS (SELECT *, max(CASE WHEN ch = 1 THEN t END) OVER (PARTITION BY device ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT device, t, last_value(CASE WHEN t - run >= 2 OR t = 0 THEN label END IGNORE NULLS) OVER (PARTITION BY device ORDER BY t ROWS UNBOUNDED PRECEDING) AS stable FROM u""")
def q_debounce(spark, sf):
    d = windows1(spark, sf).select("device", F.col("t").alias("idx"), "label")
    return EP.debounce_count(staged(d, "win"), DEV, "idx", "label").select("device", F.col("idx").alias("t"), "stable")


# --- workouts --------------------------------------------------------------------------------


def workout_rows(spark, sf):
    """Class probabilities with phases of squats, running and rest."""
    c = F.col
    w = windows1(spark, sf)
    phase = F.floor(c("t") / 8) % 3
    noise = c("p_motion") / 20
    return w.select("device", c("t").alias("idx"), (c("t") * 5.0).alias("time"), F.when(phase == 0, 0.8 + noise).otherwise(0.05 + noise).alias("squat"),
                    F.when(phase == 1, 0.7 + noise).otherwise(0.05 + noise).alias("run"))


def workout(spark, sf):
    return LV.workout_events(staged(workout_rows(spark, sf), "probs"), DEV, "idx", "time", ["squat", "run"], ["squat"])


@query("workout_strategy")
def q_workout(spark, sf):
    return workout(spark, sf).select("device", "type", "session_id", "timestamp", "action", "duration_seconds", r(F.col("confidence")).alias("confidence"), "sets")


@query("event_store_upsert", sql="""
, a AS (SELECT event_id AS n, user_id, event_type, sha256('{"device":' || user_id || ',"type":"' || event_type || '","value":' || CAST(floor(value / 10) AS BIGINT) || '}') AS id FROM events),
s AS (SELECT DISTINCT sha256('{"device":' || user_id || ',"type":"' || event_type || '","value":0}') AS id FROM events)
SELECT id, min(n) AS n FROM a WHERE id NOT IN (SELECT id FROM s) GROUP BY 1""")
def q_upsert(spark, sf):
    ev = table(spark, sf, "events")
    f = lambda v: S.event_id({"device": F.col("user_id"), "type": F.col("event_type"), "value": v})
    arrived = ev.select(f(F.floor(F.col("value") / 10)).alias("id"), F.col("event_id").alias("n"), "user_id", "event_type")
    store = ev.select(f(F.lit(0)).alias("id")).distinct()
    return EP.upsert_events(store, arrived, "id", "n").select("id", "n")


@query("replay_session")
def q_replay(spark, sf):
    d = staged(imu6(spark, sf).select("device", "idx", "t", *AXES), "samples")
    end = d.groupBy("device").agg(F.max("t").alias("dur"))
    g = WN.window_stats_v2(uniform(d, end), DEV, "idx", MAP)
    p = activity_probabilities(g).select("device", F.col("win").alias("idx"), (F.col("win") + 3.98).alias("time"), "squat", "run")
    ev = staged(LV.workout_events(staged(p, "probs"), DEV, "idx", "time", ["squat", "run"], ["squat"]), "events")
    seg = EP.segments_of_events(ev)
    totals = EP.session_totals(EP.sessions_of_events(ev).select("session_id", "start", "end"), seg, "session_id")
    merged = EP.merge_activities(seg, "session_id", F.floor(F.col("start") / 3600))
    return merged.join(totals.select("session_id", F.col("duration_s").alias("session_s"), "active_s"), "session_id")


def uniform(d, end):
    from ..operators.resample import uniform_resample

    g = uniform_resample(spread_join(d, end, DEV), DEV, "idx", "t", AXES, 50.0, "dur")
    return g.withColumnRenamed("k", "idx")


# --- sessions, latest state, summaries -------------------------------------------------------


@query("sessionize_gap", uses="windows1", sql="""
, a AS (SELECT device, t, t * 1.0 AS s, t + 1.0 AS e, p_motion FROM windows1 WHERE p_motion >= 0.5), l AS (SELECT *, CASE WHEN s - lag(e) OVER w > 2.5 OR lag(e) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM a WINDOW w AS (PARTITION BY device ORDER BY s)),
g AS (SELECT *, sum(n) OVER (PARTITION BY device ORDER BY s) AS sid FROM l), q AS (SELECT device, min(s) AS start_s, arg_max(e, s) - min(s) AS duration_s, round_even(avg(p_motion) * 100, 0) AS confidence, count(*) AS windows FROM g GROUP BY device, sid)
SELECT device, CAST(start_s AS DOUBLE) AS start_s, CAST(duration_s AS DOUBLE) AS duration_s, CAST(confidence AS DOUBLE) AS confidence, windows FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY start_s DESC) AS rk FROM q) z WHERE rk <= 3""")
def q_sessions(spark, sf):
    c = F.col
    a = windows1(spark, sf).filter("p_motion >= 0.5").select("device", c("t").alias("o"), c("t").cast("double").alias("s"), (c("t") + 1.0).alias("e"), "p_motion")
    s = EP.sessionize_gap(a, DEV, "o", "s", "e", "p_motion", 2.5, F.floor(c("s") / 3600))
    return EP.latest_per_key(s, DEV, [c("start_s")], 3)


@query("interval_union_duration", uses="segments1", sql="""
, s AS (SELECT device, segment_id, start_us / 1e6 AS s, start_us / 1e6 + duration_s * 200 AS e FROM segments1), c AS (SELECT *, max(e) OVER (PARTITION BY device ORDER BY s, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM s)
SELECT device, round(sum(greatest(0, e - greatest(s, coalesce(cur, s)))), 4) + 0.0 AS covered_s FROM c GROUP BY 1""")
def q_union(spark, sf):
    c = F.col
    d = segments1(spark, sf).select("device", "segment_id", (c("start_us") / 1e6).alias("s"), (c("start_us") / 1e6 + c("duration_s") * 200).alias("e"))
    return EP.interval_union(d, DEV, "segment_id", "s", "e", F.floor(c("s") / 3600)).withColumn("covered_s", r(c("covered_s"), 4))


@query("latest_per_key", sql="""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) z WHERE rk <= 5""")
def q_latest(spark, sf):
    return EP.latest_per_key(table(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], 5).select("user_id", "event_id", "event_type")


SNAP_SQL = """, la AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS label, arg_max(value, (ts, event_id)) AS value, max(epoch_us(ts)) / 1e6 AS sample_s FROM events GROUP BY 1),
st AS (SELECT c_custkey AS user_id, 1706659000.0 + c_custkey % 40 AS status_s, CASE WHEN c_custkey % 2 = 0 THEN 'connected' END AS receiver FROM customer WHERE c_custkey % 3 > 0),
j AS (SELECT la.*, coalesce(status_s, 0) AS u, receiver, greatest(sample_s, coalesce(status_s, 0)) AS seen FROM la LEFT JOIN st USING (user_id))
"""


def snapshot(spark, sf):
    c = F.col
    ev = table(spark, sf, "events")
    last = EP.latest_per_key(ev, ["user_id"], [c("ts"), c("event_id")]).select("user_id", c("event_type").alias("label"), "value", (F.unix_micros("ts") / 1e6).alias("sample_s"))
    k = c("c_custkey")
    st = table(spark, sf, "customer").filter("c_custkey % 3 > 0").select(k.alias("user_id"), (F.lit(1706659000.0) + k % 40).alias("status_s"), F.when(k % 2 == 0, "connected").alias("receiver"))
    return EP.staleness(last.join(st, "user_id", "left"), "sample_s", "status_s", F.lit(1706659030.0), "receiver", 20.0)


@query("staleness", sql=SNAP_SQL + "SELECT user_id, round(1706659030.0 - seen, 3) + 0.0 AS age_s, CASE WHEN 1706659030.0 - seen > 20 THEN 'stale' WHEN sample_s > u THEN 'file_stream' ELSE coalesce(receiver, 'waiting') END AS display_state FROM j")
def q_stale(spark, sf):
    return snapshot(spark, sf).select("user_id", r(F.col("age_s"), 3).alias("age_s"), "display_state")


@query("live_snapshot", sql=SNAP_SQL + """SELECT user_id, label, CAST(round(value) AS BIGINT) AS percent, round(value / 7, 1) + 0.0 AS gyro_dps,
 CASE WHEN 1706659030.0 - seen > 20 THEN 'stale' WHEN sample_s > u THEN 'file_stream' ELSE coalesce(receiver, 'waiting') END AS state FROM j""")
def q_snapshot(spark, sf):
    return snapshot(spark, sf).select("user_id", "label", F.round("value").cast("long").alias("percent"), r(F.col("value") / 7, 1).alias("gyro_dps"), F.col("display_state").alias("state"))


@query("device_health", sql="""
SELECT user_id, count(*) AS notifications, CAST(sum(event_id % 8 + 1) AS BIGINT) AS frames, CAST(sum(event_id % 3) AS BIGINT) AS discarded_bytes,
 round(CASE WHEN max(epoch_us(ts)) > min(epoch_us(ts)) THEN (sum(event_id % 8 + 1) - 1) / (max(epoch_us(ts)) / 1e6 - min(epoch_us(ts)) / 1e6) ELSE 0 END, 9) + 0.0 AS rate_hz, round(max(epoch_us(ts)) / 1e6, 6) + 0.0 AS last_seen FROM events GROUP BY 1""")
def q_health(spark, sf):
    e = F.col("event_id")
    d = table(spark, sf, "events").select("user_id", (e % 8 + 1).alias("frames"), (e % 3).alias("discarded"), (F.unix_micros("ts") / 1e6).alias("t"))
    return EP.device_health(d, "user_id").withColumns({"rate_hz": r(F.col("rate_hz"), 9), "last_seen": r(F.col("last_seen"))})


DAY_SQL = """, sg AS (SELECT user_id || '/' || date_trunc('day', ts) AS sid, CASE event_type WHEN 'click' THEN 'run' WHEN 'view' THEN 'other_motion' WHEN 'error' THEN 'run' ELSE 'squat' END AS action, event_type, event_id AS seq, epoch_us(ts) / 1e6 AS s, value AS d FROM events WHERE event_type <> 'signup' OR value > 5),
ss AS (SELECT user_id || '/' || date_trunc('day', ts) AS sid, min(epoch_us(ts)) / 1e6 AS s, CASE WHEN user_id % 5 > 0 THEN max(epoch_us(ts)) / 1e6 + 60 END AS e FROM events GROUP BY user_id, date_trunc('day', ts)),
kd AS (SELECT *, CASE WHEN action = 'run' THEN 'cardio' WHEN event_type IN ('purchase', 'signup') THEN 'strength' ELSE 'other' END AS kind FROM sg),
tt AS (SELECT ss.sid, ss.s, coalesce(e, arg_max(kd.s + d, (kd.s, seq))) AS e, sum(d) AS act FROM ss JOIN kd ON kd.sid = ss.sid GROUP BY ss.sid, ss.s, e),
it AS (SELECT *, CASE WHEN action = lag(action) OVER w THEN 0 ELSE 1 END AS n FROM kd WINDOW w AS (PARTITION BY sid ORDER BY s, seq)), im AS (SELECT *, sum(n) OVER (PARTITION BY sid ORDER BY s, seq) AS item FROM it)
"""


@query("daily_summary", sql=DAY_SQL + """
SELECT 'day' AS part, strftime(make_timestamp(CAST(s * 1000000 AS BIGINT)), '%Y-%m-%d') AS name, NULL AS kind, CAST(count(*) AS BIGINT) AS n, CAST(round_even(sum(greatest(0, e - s)), 0) AS BIGINT) AS seconds, CAST(round_even(sum(act), 0) AS BIGINT) AS active FROM tt GROUP BY 2
UNION ALL SELECT 'activity', arg_min(action, (s, seq)), arg_min(kind, (s, seq)), count_if(kind = 'strength'), CAST(sum(CASE WHEN kind = 'strength' THEN 0 ELSE round_even(d, 0) END) AS BIGINT), CAST(round(min(s)) AS BIGINT) FROM im GROUP BY sid, item""")
def q_daily(spark, sf):
    c = F.col
    ev = table(spark, sf, "events")
    day = F.concat(c("user_id").cast("string"), F.lit("/"), F.to_date("ts").cast("string"))
    t = c("event_type")
    action = F.when(t.isin("click", "error"), "run").when(t == "view", "other_motion").otherwise("squat")
    kind_event = F.when(t.isin("purchase", "signup"), "set_ended").otherwise("activity_ended")
    s = F.unix_micros("ts") / 1e6
    seg = ev.filter((t != "signup") | (c("value") > 5)).select(day.alias("sid"), action.alias("action"), EP.segment_kind(action, kind_event).alias("kind"), c("event_id").alias("seq"), s.alias("start"),
                                                           (s + c("value")).alias("end"), c("value").alias("duration_s"))
    ses = ev.groupBy(day.alias("sid")).agg((F.min(F.unix_micros("ts")) / 1e6).alias("start"), F.when(F.max("user_id") % 5 > 0, F.max(F.unix_micros("ts")) / 1e6 + 60).alias("end"))
    days = EP.daily_totals(EP.session_totals(ses, seg, "sid"))
    items = EP.merge_activities(seg, "sid", F.floor(c("start") / 3600))
    none = F.lit(None).cast("string")
    return days.select(F.lit("day").alias("part"), c("date").alias("name"), none.alias("kind"), c("session_count").alias("n"), c("total_workout_seconds").alias("seconds"), c("active_seconds").alias("active")).unionByName(
        items.select(F.lit("activity").alias("part"), c("action").alias("name"), "kind", c("sets").alias("n"), c("duration_seconds").alias("seconds"), F.round("start").cast("long").alias("active")))
