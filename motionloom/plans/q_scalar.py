"""Queries: time axis, scalar, vector and string functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import taxonomy as T
from ..functions.scalar import rounded as r
from ..operators import timeaxis as ta
from ..operators.ordered import exact_percentile
from .registry import query
from .views import imu6, segments1, stream1, stream_rows, table

def hour():
    return F.date_trunc("hour", "ts")
ACTIVITY_IDS = ["run", "squat", "sitting", "removed_wear", "other_motion", "elliptical", "plank", "head_turn", "incline_walk",
                "bench_press", "gaming", "unknown_motion", "other_non_motion"]
IDS_SQL = "[" + ", ".join(f"'{a}'" for a in ACTIVITY_IDS) + "]"
NAME_SQL = """CASE event_type WHEN 'signup' THEN '深蹲' || (event_id % 4) || '组' WHEN 'purchase' THEN '自由行走' WHEN 'view' THEN '坐姿'
 WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN '佩戴取下' ELSE '耳机掉落' END ELSE '其他' || (event_id % 3) END"""


def host_clock(spark, sf):
    """stream1 with host seconds (absent for every third device) and chip seconds (absent for every fifth)."""
    sec = F.unix_micros("ts") / F.lit(1e6)
    return stream1(spark, sf).withColumns({
        "host": F.when(F.col("device") % 3 != 0, F.when(F.col("x").isNotNull(), sec)),
        "chip": F.when(F.col("device") % 5 != 0, sec - 100.0)})


CLOCK_SQL = """, c AS (SELECT *, CASE WHEN device % 3 <> 0 AND x IS NOT NULL THEN epoch_us(ts) / 1e6 END AS host,
  CASE WHEN device % 5 <> 0 THEN epoch_us(ts) / 1e6 - 100 END AS chip FROM stream1),
k AS (SELECT device, count(*) AS n, count(host) AS nh, count(chip) AS nc,
  arg_max(host, idx) - arg_min(host, idx) AS sh, arg_max(chip, idx) - arg_min(chip, idx) AS sc FROM c GROUP BY 1),
u AS (SELECT device, n, CASE WHEN nh >= 2 AND sh > 0 THEN sh WHEN nc >= 2 AND sc > 0 THEN sc END AS span,
  CASE WHEN nh >= 2 AND sh > 0 THEN 'host' WHEN nc >= 2 AND sc > 0 THEN 'onboard' ELSE 'sample_index' END AS time_source FROM k)
"""


@query("parse_host_time", sql="""
, t AS (SELECT user_id AS device, event_id AS row_id, CASE WHEN event_id % 17 = 0 THEN 'bad' WHEN event_id % 19 = 0 THEN NULL
   WHEN user_id % 2 = 0 THEN strftime(ts, '%H:%M:%S.%f') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS txt, ts FROM events),
f AS (SELECT device, arg_min(txt, row_id) AS first FROM t WHERE txt IS NOT NULL GROUP BY 1)
SELECT device, row_id, CASE WHEN contains(first, ' ') THEN epoch_us(try_strptime(txt, '%Y-%m-%d %H:%M:%S.%f'))
  ELSE epoch_us(CAST(try_strptime('1970-01-01 ' || txt, '%Y-%m-%d %H:%M:%S.%f') AS TIMESTAMP)) END AS host_us
FROM t LEFT JOIN f USING (device)""")
def q_parse_host_time(spark, sf):
    e = F.col("event_id")
    txt = (F.when(e % 17 == 0, "bad").when(e % 19 == 0, None)
           .when(F.col("user_id") % 2 == 0, F.date_format("ts", "HH:mm:ss.SSSSSS"))
           .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    d = table(spark, sf, "events").select(F.col("user_id").alias("device"), e.alias("row_id"), txt.alias("txt"))
    return ta.parse_host_time(d, ["device"], "row_id", "txt").select("device", "row_id", F.unix_micros("host_ts").alias("host_us"))


@query("time_axis_rebuild", uses="stream1", sql=CLOCK_SQL + """
SELECT device, row_id, time_source, round(CASE WHEN span IS NULL THEN CAST(idx AS DOUBLE) WHEN n > 1 THEN span * idx / (n - 1) ELSE 0 END, 6) + 0.0
 AS analysis_time_s FROM c JOIN u USING (device)""")
def q_time_axis(spark, sf):
    d = ta.time_axis(host_clock(spark, sf), ["device"], "idx", "host", "chip")
    return d.select("device", "row_id", "time_source", r(F.col("analysis_time_s"), 6).alias("analysis_time_s"))


@query("sampling_info", uses="stream1", sql=CLOCK_SQL + """
SELECT device, time_source, round(coalesce(span, n - 1), 6) + 0.0 AS duration_s,
 CASE WHEN coalesce(span, n - 1) > 0 THEN round((n - 1) / coalesce(span, n - 1), 8) + 0.0 END AS sample_rate_hz FROM u""")
def q_sampling_info(spark, sf):
    rows = stream_rows(spark, sf)
    sec = F.unix_micros("ts") / F.lit(1e6)
    rows = rows.withColumns({
        "host": F.when((F.col("device") % 3 != 0) & F.col("x").isNotNull(), sec),
        "chip": F.when(F.col("device") % 5 != 0, sec - 100.0), "at": F.struct("ts", "row_id")})
    d = ta.sampling_info(rows, ["device"], "at", "host", "chip")
    return d.select("device", "time_source", r(F.col("duration_s"), 6).alias("duration_s"), r(F.col("sample_rate_hz"), 8).alias("sample_rate_hz"))


@query("recording_duration", sql="""
, t AS (SELECT user_id AS device, ts, event_id, CASE WHEN user_id % 11 <> 0 AND event_id % 7 <> 0 THEN (epoch_us(ts) % 86400000000) / 1e6 END AS tod FROM events),
g AS (SELECT device, count(*) AS n, count(tod) AS v,
  arg_max(tod, (ts, event_id)) FILTER (tod IS NOT NULL) - arg_min(tod, (ts, event_id)) FILTER (tod IS NOT NULL) AS d FROM t GROUP BY 1)
SELECT device, round(CASE WHEN v < 2 THEN greatest(0, (n - 1) / 100.0) WHEN d < 0 THEN d + 86400 ELSE d END, 6) + 0.0 AS duration_s FROM g""")
def q_recording_duration(spark, sf):
    tod = F.when((F.col("user_id") % 11 != 0) & (F.col("event_id") % 7 != 0), F.unix_micros("ts") % 86400000000 / F.lit(1e6))
    d = table(spark, sf, "events").select(F.col("user_id").alias("device"), F.struct("ts", "event_id").alias("at"), tod.alias("tod"))
    return ta.recording_duration(d, ["device"], "at", "tod").select("device", r(F.col("duration_s"), 6).alias("duration_s"))


@query("midnight_rollover", sql="""
, t AS (SELECT user_id AS device, ts, event_id, (epoch_us(ts) % 86400000000) / 1000000.0 AS tod FROM events),
l AS (SELECT *, lag(tod) OVER (PARTITION BY device ORDER BY ts, event_id) AS p FROM t),
s AS (SELECT *, sum(CASE WHEN p - tod > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY ts, event_id) AS day FROM l)
SELECT device, count(*) AS row_count, round(arg_min(tod, (ts, event_id)), 6) + 0.0 AS start_s,
 round(arg_max(tod + 86400.0 * day, (ts, event_id)), 6) + 0.0 AS end_s, CAST(max(day) AS BIGINT) AS days,
 CAST(sum(CASE WHEN tod < p AND p - tod <= 43200 THEN 1 ELSE 0 END) AS BIGINT) AS error_rows FROM s GROUP BY 1""")
def q_midnight(spark, sf):
    d = table(spark, sf, "events").select(F.col("user_id").alias("device"), "ts", "event_id",
                                          (F.unix_micros("ts") % 86400000000 / F.lit(1e6)).alias("tod"))
    u = ta.unwrap_time_of_day(d, ["device"], ["ts", "event_id"], hour(), "tod")
    at = F.struct("ts", "event_id")
    return u.groupBy("device").agg(
        F.count(F.lit(1)).alias("row_count"), r(F.min_by("tod", at), 6).alias("start_s"),
        r(F.max_by(F.col("tod") + F.col("day") * 86400.0, at), 6).alias("end_s"), F.max("day").alias("days"),
        F.sum(F.col("backwards").cast("long")).alias("error_rows"))


@query("capture_bucket_20s", sql="""
SELECT event_id, strftime(ts, '%Y-%m-%d') || '__' || event_type || '__' ||
 strftime(make_timestamp(CAST(round_even(epoch_us(ts) / 20000000.0, 0) AS BIGINT) * 20000000), '%H%M%S') AS capture_group FROM events""")
def q_bucket(spark, sf):
    return table(spark, sf, "events").select("event_id", ta.capture_bucket(F.col("ts"), F.col("event_type")).alias("capture_group"))


@query("derive_magnitudes", uses="imu6", sql="""
SELECT device, idx, round(sqrt(ax*ax+ay*ay+az*az), 6) + 0.0 AS acc_mag, round(abs(sqrt(ax*ax+ay*ay+az*az) - 1), 6) + 0.0 AS dynamic_acc,
 round(sqrt(gx*gx+gy*gy+gz*gz), 6) + 0.0 AS gyro_mag FROM imu6""")
def q_magnitudes(spark, sf):
    d = ta.derive_magnitudes(imu6(spark, sf), ["ax", "ay", "az"], ["gx", "gy", "gz"])
    return d.select("device", "idx", *[r(F.col(c)).alias(c) for c in ("acc_mag", "dynamic_acc", "gyro_mag")])


@query("to_si_units", uses="imu6", sql="""
, u AS (SELECT *, CASE WHEN device % 3 = 0 THEN 9.80665 ELSE 1 END AS ka, CASE WHEN device % 2 = 0 THEN pi() / 180 ELSE 1 END AS kg,
 CASE WHEN device % 5 = 0 THEN -1 ELSE 1 END AS sy FROM imu6)
SELECT device, idx, round(ax*ka, 6) + 0.0 AS ax, round(ay*sy*ka, 6) + 0.0 AS ay, round(az*ka, 6) + 0.0 AS az,
 round(gx*kg, 6) + 0.0 AS gx, round(gy*sy*kg, 6) + 0.0 AS gy, round(gz*kg, 6) + 0.0 AS gz FROM u""")
def q_si(spark, sf):
    d = F.col("device")
    acc_unit = F.when(d % 3 == 0, "g").when(d % 3 == 1, "m/s2").otherwise("m/s²")
    gyro_unit = F.when(d % 2 == 0, F.when(d % 4 == 0, "deg/s").otherwise("°/s")).otherwise("rad/s")
    signs = [F.lit(1), F.when(d % 5 == 0, -1).otherwise(1), F.lit(1)]
    s = ta.to_si_units(imu6(spark, sf), ["ax", "ay", "az"], ["gx", "gy", "gz"], acc_unit, gyro_unit, signs)
    return s.select("device", "idx", *[r(F.col(c)).alias(c) for c in ("ax", "ay", "az", "gx", "gy", "gz")])


@query("project_channels", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(TRY_CAST(CASE WHEN l_tax > 0.07 THEN 'x' ELSE CAST(l_quantity AS VARCHAR) END AS DOUBLE), 0) AS ax_g,
 l_discount AS gx_dps FROM lineitem WHERE l_returnflag <> 'R'""")
def q_project(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_tax") > 0.07, "x").otherwise(F.col("l_quantity").cast("string")).alias("AccX(g)"),
        F.when(F.col("l_returnflag") != "R", F.col("l_discount")).alias("AsX(dps)"))
    return ta.project_channels(raw, {"AccX(g)": "ax_g", "AsX(dps)": "gx_dps"}, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("angle_wrap_diff", uses="imu6", sql="""
SELECT device, idx, (((yaw - roll + 180) % 360) + 360) % 360 - 180 AS diff FROM imu6""")
def q_wrap(spark, sf):
    return imu6(spark, sf).select("device", "idx", S.angle_wrap_diff(F.col("yaw"), F.col("roll")).alias("diff"))


@query("circular_mean", uses="imu6", sql="""
SELECT device, round(degrees(atan2(avg(sin(radians(yaw))), avg(cos(radians(yaw))))), 5) + 0.0 AS yaw_mean,
 round(degrees(atan2(avg(sin(radians(roll))), avg(cos(radians(roll))))), 5) + 0.0 AS roll_mean FROM imu6 GROUP BY 1""")
def q_circular(spark, sf):
    return imu6(spark, sf).groupBy("device").agg(r(S.circular_mean(F.col("yaw")), 5).alias("yaw_mean"),
                                                 r(S.circular_mean(F.col("roll")), 5).alias("roll_mean"))


QUAT_SQL = """, e AS (SELECT device, idx, ax, ay, az, radians(roll)/2 AS a, radians(pitch*0.9)/2 AS b, radians(yaw)/2 AS c FROM imu6),
q AS (SELECT *, cos(a)*cos(b)*cos(c)+sin(a)*sin(b)*sin(c) AS w, sin(a)*cos(b)*cos(c)-cos(a)*sin(b)*sin(c) AS x,
  cos(a)*sin(b)*cos(c)+sin(a)*cos(b)*sin(c) AS y, cos(a)*cos(b)*sin(c)-sin(a)*sin(b)*cos(c) AS z FROM e),
k AS (SELECT cos(a)*cos(b)*cos(c)+sin(a)*sin(b)*sin(c) AS bw, -(sin(a)*cos(b)*cos(c)-cos(a)*sin(b)*sin(c)) AS bx,
  -(cos(a)*sin(b)*cos(c)+sin(a)*cos(b)*sin(c)) AS bj, -(cos(a)*cos(b)*sin(c)-sin(a)*sin(b)*cos(c)) AS bz
  FROM (SELECT radians(10.3)/2 AS a, radians(20.7)/2 AS b, radians(30.1)/2 AS c) n),
m AS (SELECT q.*, bw*w-bx*x-bj*y-bz*z AS rw, bw*x+bx*w+bj*z-bz*y AS rx, bw*y-bx*z+bj*w+bz*x AS ry, bw*z+bx*y-bj*x+bz*w AS rz FROM q, k),
v AS (SELECT *, CASE WHEN rw < 0 THEN -1 ELSE 1 END AS s, sqrt(rx*rx+ry*ry+rz*rz) AS n, sqrt(ax*ax+ay*ay+az*az) AS g FROM m),
o AS (SELECT *, CASE WHEN n > 1e-9 THEN 2*atan2(n, least(1, greatest(-1, rw*s)))/n ELSE 2 END AS f, az/greatest(g,1e-9) AS dz, ax/greatest(g,1e-9) AS dx, ay/greatest(g,1e-9) AS dy FROM v),
h AS (SELECT *, sqrt((1+dz)*(1+dz)+dy*dy+dx*dx) AS hn FROM o)
SELECT device, idx, round(w,6)+0.0 AS qw, round(x,6)+0.0 AS qx, round(degrees(rx*s*f),5)+0.0 AS vx, round(degrees(ry*s*f),5)+0.0 AS vy, round(degrees(rz*s*f),5)+0.0 AS vz,
 round(degrees(asin(least(1,greatest(-1,2*(w*y-z*x))))),5)+0.0 AS pitch, round(degrees(atan2(2*(w*x+y*z),1-2*(x*x+y*y))),5)+0.0 AS roll,
 CASE WHEN dz < -0.999999 THEN 0 ELSE round((1+dz)/greatest(hn,1e-9),6)+0.0 END AS tw, CASE WHEN dz < -0.999999 THEN 0 ELSE round(-dy/greatest(hn,1e-9),6)+0.0 END AS tx FROM h"""


@query("quat_ops", uses="imu6", sql=QUAT_SQL)
def q_quat(spark, sf):
    c = F.col
    d = imu6(spark, sf)
    q = S.quat_from_euler(c("roll"), c("pitch") * 0.9, c("yaw"))
    d = d.select("device", "idx", "ax", "ay", "az", *[e.alias(n) for e, n in zip(q, "wxyz")])
    q = tuple(c(n) for n in "wxyz")
    base = S.quat_from_euler(F.lit(10.3), F.lit(20.7), F.lit(30.1))
    rel = S.quat_product(S.quat_conjugate(base), q)
    g = F.greatest(S.norm(c("ax"), c("ay"), c("az")), F.lit(1e-9))
    d = d.withColumns({**{f"r{n}": e for n, e in zip("wxyz", rel)}, "dx": c("ax") / g, "dy": c("ay") / g, "dz": c("az") / g})
    vec = S.rotation_vector(tuple(c(f"r{n}") for n in "wxyz"))
    roll, pitch, _ = S.euler_from_quat(q)
    zero, one = F.lit(0.0), F.lit(1.0)
    tilt = S.quat_between((zero, zero, one), (c("dx"), c("dy"), c("dz")))
    return d.select("device", "idx", r(c("w")).alias("qw"), r(c("x")).alias("qx"),
                    *[r(e, 5).alias(f"v{n}") for e, n in zip(vec, "xyz")], r(pitch, 5).alias("pitch"), r(roll, 5).alias("roll"),
                    r(tilt[0]).alias("tw"), F.when(c("dz") < -0.999999, 0.0).otherwise(r(tilt[1])).alias("tx"))


@query("state_by_prefix", sql=f"""
, n AS (SELECT event_id, {NAME_SQL} AS name FROM events)
SELECT event_id, CASE WHEN name LIKE '不对称佩戴%' OR name LIKE '佩戴取下%' OR name LIKE '%掉落%' THEN 'wear_artifact'
 WHEN regexp_matches(name, '^(开合跳|弓步蹲|深蹲|卷腹|俯卧撑|平板支撑|跑步机)') THEN 'exercise'
 WHEN regexp_matches(name, '^(自由行走|慢走|快走|走路|爬楼|下楼|坐下起立|站起)') THEN 'ambiguous'
 WHEN regexp_matches(name, '^(坐姿|站立|说话|咀嚼|喝水|低头|偏头|弯腰取物)') THEN 'non_exercise' ELSE 'unlabelled' END AS state FROM n""")
def q_state(spark, sf):
    return table(spark, sf, "events").select("event_id", T.state_by_prefix(F.expr(NAME_SQL)).alias("state"))


@query("activity_family", sql=f"""
, a AS (SELECT event_id, {IDS_SQL}[event_id % 13 + 1] AS id FROM events)
SELECT event_id, CASE WHEN id IN ('run','elliptical','incline_walk') THEN 'cardio'
 WHEN id IN ('sitting','removed_wear','other_motion','head_turn','gaming','unknown_motion','other_non_motion') THEN 'other' ELSE 'strength' END AS family FROM a""")
def q_family(spark, sf):
    ids = F.array(*[F.lit(a) for a in ACTIVITY_IDS])
    return table(spark, sf, "events").select(
        "event_id", T.activity_family(F.element_at(ids, (F.col("event_id") % 13 + 1).cast("int"))).alias("family"))


@query("posture_policy", uses="imu6", sql="""
, d AS (SELECT device, idx, concat_ws(',', CASE WHEN pitch <= -15 THEN 'head_down' WHEN pitch >= 15 THEN 'head_up' END,
 CASE WHEN roll <= -15 THEN 'head_tilt_left' WHEN roll >= 15 THEN 'head_tilt_right' END,
 CASE WHEN device % 2 = 0 THEN CASE WHEN yaw <= -15 THEN 'head_turn_left' WHEN yaw >= 15 THEN 'head_turn_right' END END) AS deviations FROM imu6)
SELECT *, CASE WHEN deviations = '' THEN 'normal' ELSE 'poor' END AS state FROM d""")
def q_policy(spark, sf):
    d = imu6(spark, sf).withColumn("dev", T.posture_deviations(F.col("roll"), F.col("pitch"), F.col("yaw"), F.col("device") % 2 == 0))
    return d.select("device", "idx", F.concat_ws(",", "dev").alias("deviations"), T.posture_state(F.col("dev")).alias("state"))


@query("posture_angle_band", uses="imu6", sql="""
, a AS (SELECT device, median(CASE WHEN device % 7 <> 0 THEN coalesce(CASE WHEN device % 2 = 0 THEN pitch END, roll / 6) END) AS angle,
  avg(abs(gx) / 200) AS p FROM imu6 GROUP BY 1)
SELECT device, round(angle, 1) + 0.0 AS angle_degrees, CASE WHEN angle IS NULL THEN 'unknown' WHEN p >= 0.505 THEN 'in_motion'
 WHEN abs(angle) <= 15 THEN 'good' WHEN abs(angle) <= 30 THEN 'fair' ELSE 'attention' END AS band FROM a""")
def q_band(spark, sf):
    d = imu6(spark, sf)
    angle = F.when(F.col("device") % 7 != 0, F.coalesce(F.when(F.col("device") % 2 == 0, F.col("pitch")), F.col("roll") / 6))
    d = d.select("device", angle.alias("angle"), "gx")
    med = exact_percentile(d, ["device"], "angle", {"angle": 0.5})
    p = d.groupBy("device").agg(F.avg(F.abs("gx") / 200).alias("p"))
    a = F.col("angle")
    return p.join(med, "device", "left").select(
        "device", r(a, 1).alias("angle_degrees"),
        F.when(a.isNull(), "unknown").when(F.col("p") >= 0.505, "in_motion").when(F.abs(a) <= 15, "good")
        .when(F.abs(a) <= 30, "fair").otherwise("attention").alias("band"))


@query("safe_number", sql="""
SELECT event_id, coalesce(TRY_CAST(trim(t) AS DOUBLE), 0) AS number FROM (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'abc' WHEN event_id % 13 = 1 THEN NULL
 WHEN event_id % 13 = 2 THEN ' ' || value || ' ' ELSE CAST(value AS VARCHAR) END AS t FROM events) z""")
def q_safe(spark, sf):
    e, v = F.col("event_id"), F.col("value").cast("string")
    t = F.when(e % 13 == 0, "abc").when(e % 13 == 1, None).when(e % 13 == 2, F.concat(F.lit(" "), v, F.lit(" "))).otherwise(v)
    return table(spark, sf, "events").select("event_id", S.safe_number(t).alias("number"))


@query("event_id", sql="""
SELECT event_id AS n, sha256('{"device":' || user_id || ',"event":' || event_id || ',"type":"' || event_type || '"}') AS event_id FROM events""")
def q_event_id(spark, sf):
    f = {"type": F.col("event_type"), "device": F.col("user_id"), "event": F.col("event_id")}
    return table(spark, sf, "events").select(F.col("event_id").alias("n"), S.event_id(f).alias("event_id"))


@query("catalog_version", sql="""
, j AS (SELECT sha256('{"id":' || p_partkey || ',"name":"' || p_brand || '"}') AS h FROM part
 UNION ALL SELECT sha256('{"id":' || n_nationkey || ',"name":"' || n_name || '"}') FROM nation)
SELECT substr(sha256(count(*) || ':' || CAST(sum(CAST(('0x' || substr(h, 1, 14)) AS BIGINT)) AS VARCHAR)), 1, 16) AS version FROM j""")
def q_catalog(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return catalog_version(p.select("id", "name").unionByName(n))


def catalog_version(dims):
    """16 hex characters over all dimension rows, independent of their order; partial sums, no collection."""
    h = F.sha2(F.to_json(F.struct(*sorted(dims.columns))), 256)
    part = F.conv(F.substring(h, 1, 14), 16, 10).cast("decimal(38,0)")
    total = F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(part).cast("string"))
    return dims.agg(F.substring(F.sha2(total, 256), 1, 16).alias("version"))


@query("participant_for_device", sql="""
, f AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '单人-深蹲' WHEN event_id % 2 = 0 THEN '甲乙+丙丁-深蹲' ELSE '春夏+秋冬 走路' END AS folder,
  CASE user_id % 3 WHEN 0 THEN 'aa-' WHEN 1 THEN 'bb-' ELSE 'cc-' END || user_id AS device FROM events),
p AS (SELECT *, regexp_extract(folder, '^([\\x{4e00}-\\x{9fff}]{2,4})\\+([\\x{4e00}-\\x{9fff}]{2,4})', 1) AS a,
  regexp_extract(folder, '^([\\x{4e00}-\\x{9fff}]{2,4})\\+([\\x{4e00}-\\x{9fff}]{2,4})', 2) AS b FROM f)
SELECT event_id, CASE WHEN a = '' THEN NULL WHEN starts_with(device, 'aa') THEN a WHEN starts_with(device, 'bb') THEN b END AS participant,
 CASE WHEN a = '' THEN 'not_a_pair_folder' WHEN device[1:2] NOT IN ('aa', 'bb') THEN 'unreviewed_device' END AS reason FROM p""")
def q_participant(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    folder = F.when(e % 9 == 0, "单人-深蹲").when(e % 2 == 0, "甲乙+丙丁-深蹲").otherwise("春夏+秋冬 走路")
    device = F.concat(F.when(u % 3 == 0, "aa-").when(u % 3 == 1, "bb-").otherwise("cc-"), u.cast("string"))
    who, why = participant_for_device(folder, device, "aa", "bb")
    return table(spark, sf, "events").select("event_id", who.alias("participant"), why.alias("reason"))


def participant_for_device(folder, device, first_prefix, second_prefix):
    """Participant of a two-person folder by device prefix, and the reason when there is none."""
    pair = r"^([\x{4e00}-\x{9fff}]{2,4})\+([\x{4e00}-\x{9fff}]{2,4})"
    a, b = F.regexp_extract(folder, pair, 1), F.regexp_extract(folder, pair, 2)
    one, two = device.startswith(first_prefix), device.startswith(second_prefix)
    who = F.when(a == "", None).when(one, a).when(two, b)
    why = F.when(a == "", "not_a_pair_folder").when(~one & ~two, "unreviewed_device")
    return who, why
