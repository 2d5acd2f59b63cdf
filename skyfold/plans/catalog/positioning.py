"""Queries over telemetry, trajectories, scale and accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfold.functions import geodesy as geo, linalg as la
from skyfold.functions.linalg import rounded
from skyfold.operators import georef as gr, trajectory as tr
from skyfold.operators.ordered import running_index
from skyfold.plans import adapters as ad
from skyfold.plans.registry import query, r6

_A, _E2, _B = repr(geo.SEMI_MAJOR) + "::DOUBLE", repr(geo.ECC2) + "::DOUBLE", repr(geo.SEMI_MINOR) + "::DOUBLE"
_TOL = 3600


def _nn(lat):
    return f"({_A}/sqrt(1-{_E2}*sin(radians({lat}))*sin(radians({lat}))))"


def _ecef(lat, lon, alt):
    p, l = f"radians({lat})", f"radians({lon})"
    return (f"(({_nn(lat)}+{alt})*cos({p})*cos({l}))", f"(({_nn(lat)}+{alt})*cos({p})*sin({l}))", f"(({_nn(lat)}*(1-{_E2})+{alt})*sin({p}))")


def _enu(lat, lon, alt, lat0, lon0, alt0):
    d = [f"({a}-{b})" for a, b in zip(_ecef(lat, lon, alt), _ecef(lat0, lon0, alt0))]
    sp, cp, sl, cl = f"sin(radians({lat0}))", f"cos(radians({lat0}))", f"sin(radians({lon0}))", f"cos(radians({lon0}))"
    return (f"(-{sl}*{d[0]}+{cl}*{d[1]})", f"(-{sp}*{cl}*{d[0]}-{sp}*{sl}*{d[1]}+{cp}*{d[2]})", f"({cp}*{cl}*{d[0]}+{cp}*{sl}*{d[1]}+{sp}*{d[2]})")


@query("camera_intrinsics", "missions", f"SELECT mission_id, {r6('focal_length_mm*video_w/sensor_width_mm')} fx, {r6('focal_length_mm*video_w/sensor_width_mm')} fy, video_w/2e0 cx, video_h/2e0 cy FROM missions")
def _(spark, sf):
    out = tr.intrinsics(ad.missions(spark, sf))
    return out.select("mission_id", rounded(F.col("fx")).alias("fx"), rounded(F.col("fy")).alias("fy"), "cx", "cy")


_MATCH = f""", cand AS (SELECT k.mission_id, k.keyframe_id, k.t, k.inliers, k.value, f.fix_id, f.lat, f.lon, f.alt, f.fix_type, abs(f.t-k.t) gap, f.t ft,
 row_number() OVER (PARTITION BY k.keyframe_id ORDER BY abs(f.t-k.t), f.t, f.fix_id) rn
 FROM keyframes k JOIN telemetry f ON f.mission_id=k.mission_id AND abs(f.t-k.t)<={_TOL}),
 matched AS (SELECT k.mission_id, k.keyframe_id, k.t, k.value, k.inliers, c.fix_id, c.lat, c.lon, c.alt, c.fix_type, c.gap FROM keyframes k LEFT JOIN cand c ON c.keyframe_id=k.keyframe_id AND c.rn=1) """


def _matched(spark, sf):
    return tr.match_telemetry(ad.keyframes(spark, sf), ad.telemetry(spark, sf), float(_TOL))


@query("telemetry_match", "keyframes telemetry", _MATCH + f"SELECT mission_id, keyframe_id, fix_id, fix_type, {r6('gap',3)} time_gap FROM matched")
def _(spark, sf):
    return _matched(spark, sf).select(
        "mission_id", "keyframe_id", F.col("fix.fix_id").alias("fix_id"), F.col("fix.fix_type").alias("fix_type"),
        rounded(F.col("time_gap"), 3).alias("time_gap"),
    )


@query("telemetry_source", "keyframes telemetry", _MATCH + f""", tg AS (SELECT *, CASE WHEN mission_id%3=0 AND value<70 THEN 28e0+value/1000 END glat FROM matched),
 vt AS (SELECT mission_id, count(glat) tg, count(*) al FROM tg GROUP BY 1)
 SELECT mission_id, keyframe_id, CASE WHEN tg>0 AND tg>=al//2 THEN {r6('glat')} ELSE {r6('lat')} END lat,
 CASE WHEN tg>0 AND tg>=al//2 THEN 'KEYFRAME_MANIFEST' WHEN fix_id IS NOT NULL THEN 'FILE' ELSE 'NONE' END telemetry_source FROM tg JOIN vt USING (mission_id)""")
def _(spark, sf):
    m = _matched(spark, sf).withColumn("gps_lat", F.when((F.col("mission_id") % 3 == 0) & (F.col("value") < 70), 28.0 + F.col("value") / 1000))
    m = m.withColumn("gps_lon", F.when(F.col("gps_lat").isNotNull(), 77.0)).withColumn("gps_alt", F.lit(None).cast("double"))
    out = tr.choose_source(m.withColumn("gps_fix_type", F.lit(None).cast("string")))
    return out.select("mission_id", "keyframe_id", rounded(F.col("position.lat")).alias("lat"), "telemetry_source")


@query("telemetry_diagnostics", "keyframes telemetry", _MATCH + """SELECT mission_id, count(*) keyframes, bool_or(fix_id IS NOT NULL) gps_available, count(fix_id) matched_count,
 coalesce(arg_max(fix_type, t) FILTER (fix_id IS NOT NULL),'NONE') rtk_fix_type FROM matched GROUP BY 1""")
def _(spark, sf):
    return tr.telemetry_diagnostics(_matched(spark, sf))


@query("fix_sigma", "telemetry", "SELECT fix_type, CASE WHEN fix_type LIKE '%FIX%' THEN 0.02e0 WHEN fix_type LIKE '%FLOAT%' THEN 0.2e0 ELSE 2.5e0 END sigma, count(*) fixes FROM telemetry GROUP BY 1,2")
def _(spark, sf):
    return ad.telemetry(spark, sf).groupBy("fix_type", tr.fix_sigma(F.col("fix_type")).alias("sigma")).agg(F.count(F.lit(1)).alias("fixes"))


_ORIGIN = ", og AS (SELECT mission_id, arg_min(lat,t) lat0, arg_min(lon,t) lon0, arg_min(alt,t) alt0 FROM telemetry GROUP BY 1) "


@query("track_origin", "telemetry", _ORIGIN + "SELECT * FROM og")
def _(spark, sf):
    return tr.track_origin(ad.telemetry(spark, sf))


_ENU = _enu("lat", "lon", "alt", "lat0", "lon0", "alt0")
_ENU_CTE = _ORIGIN + f", en AS (SELECT t.*, lat0, lon0, alt0, {_ENU[0]} e, {_ENU[1]} n, {_ENU[2]} u FROM telemetry t JOIN og USING (mission_id)) "


@query("telemetry_enu", "telemetry", _ENU_CTE + f"SELECT mission_id, fix_id, {r6('e',4)} e, {r6('n',4)} n, {r6('u',4)} u FROM en")
def _(spark, sf):
    out = tr.enu_from_first(ad.telemetry(spark, sf))
    return out.select("mission_id", "fix_id", *[rounded(F.col("enu")[i], 4).alias(c) for i, c in enumerate("enu")])


_ECEF = _ecef("lat", "lon", "alt")


@query("telemetry_ecef", "telemetry", f"SELECT fix_id, {r6(_ECEF[0],4)} x, {r6(_ECEF[1],4)} y, {r6(_ECEF[2],4)} z FROM telemetry")
def _(spark, sf):
    xyz = geo.to_ecef(F.col("lat"), F.col("lon"), F.col("alt"))
    return ad.telemetry(spark, sf).select("fix_id", *[rounded(v, 4).alias(c) for v, c in zip(xyz, "xyz")])


@query("ecef_round_trip", "telemetry", f"SELECT fix_id, {r6('lat',7)} lat, {r6('lon',7)} lon, {r6('alt',4)} alt FROM telemetry")
def _(spark, sf):
    back = geo.from_ecef(*geo.to_ecef(F.col("lat"), F.col("lon"), F.col("alt")))
    return ad.telemetry(spark, sf).select("fix_id", *[rounded(v, d).alias(c) for v, c, d in zip(back, ("lat", "lon", "alt"), (7, 7, 4))])


@query("enu_round_trip", "telemetry", f"SELECT fix_id, {r6('lat',7)} lat, {r6('lon',7)} lon, {r6('alt',4)} alt FROM telemetry")
def _(spark, sf):
    out = tr.enu_from_first(ad.telemetry(spark, sf))
    back = geo.from_enu(*[F.col("enu")[i] for i in range(3)], F.col("lat0"), F.col("lon0"), F.col("alt0"))
    return out.select("fix_id", *[rounded(v, d).alias(c) for v, c, d in zip(back, ("lat", "lon", "alt"), (7, 7, 4))])


_E4, _E6 = geo.ECC2**2, geo.ECC2**3
_EP2 = repr(geo.ECC2 / (1 - geo.ECC2)) + "::DOUBLE"
_UTM = f""", u0 AS (SELECT fix_id, lat, lon, radians(lat) p, CAST(floor((lon+180)/6) AS INTEGER)+1 zone FROM telemetry),
 u1 AS (SELECT *, cos(p)*(radians(lon)-radians((zone-1)*6-177e0)) a, {_nn('lat')} n, tan(p)*tan(p) t, {_EP2}*cos(p)*cos(p) c,
 {_A}*({1 - geo.ECC2/4 - 3*_E4/64 - 5*_E6/256!r}::DOUBLE*p-{3*geo.ECC2/8 + 3*_E4/32 + 45*_E6/1024!r}::DOUBLE*sin(2*p)+{15*_E4/256 + 45*_E6/1024!r}::DOUBLE*sin(4*p)-{35*_E6/3072!r}::DOUBLE*sin(6*p)) m FROM u0) """


@query("telemetry_utm", "telemetry", _UTM + f"""SELECT fix_id, {r6(f'500000+0.9996e0*n*(a+(1-t+c)*pow(a,3)/6+(5-18*t+t*t+72*c-58*{_EP2})*pow(a,5)/120)',3)} easting,
 {r6(f'0.9996e0*(m+n*tan(p)*(a*a/2+(5-t+9*c+4*c*c)*pow(a,4)/24+(61-58*t+t*t+600*c-330*{_EP2})*pow(a,6)/720))',3)} northing, zone, 'N' hemisphere FROM u1""")
def _(spark, sf):
    u = geo.to_utm(F.col("lat"), F.col("lon"))
    return ad.telemetry(spark, sf).select(
        "fix_id", rounded(u["easting"], 3).alias("easting"), rounded(u["northing"], 3).alias("northing"),
        u["zone"].alias("zone"), u["hemisphere"].alias("hemisphere"),
    )


@query("telemetry_mercator", "telemetry", f"SELECT fix_id, {r6(f'{_A}*radians(lon)',3)} x, {r6(f'{_A}*ln(tan(pi()/4+radians(least(greatest(lat,-85.051128e0),85.051128e0))/2))',3)} y FROM telemetry")
def _(spark, sf):
    x, y = geo.to_mercator(F.col("lat"), F.col("lon"))
    return ad.telemetry(spark, sf).select("fix_id", rounded(x, 3).alias("x"), rounded(y, 3).alias("y"))


@query("geodetic_bounds", "telemetry", f"""SELECT mission_id, {r6('min(lat)-0.0005e0')} min_latitude, {r6('max(lat)+0.0005e0')} max_latitude,
 {r6('min(lon)-0.0005e0')} min_longitude, {r6('max(lon)+0.0005e0')} max_longitude FROM telemetry GROUP BY 1""")
def _(spark, sf):
    return gr.bounding_box(tr.enu_from_first(ad.telemetry(spark, sf)))


@query("track_extents", "telemetry", _ENU_CTE + ", p AS (SELECT mission_id, e x, n y, u z FROM en) SELECT mission_id, " + ", ".join(
    f"{r6(f'min({c})',3)} min_{c}, {r6(f'max({c})',3)} max_{c}, {r6(f'greatest(1,max({c})-min({c}))',3)} span_{c}" for c in "xyz") + " FROM p GROUP BY 1")
def _(spark, sf):
    pos = tr.enu_from_first(ad.telemetry(spark, sf)).select("mission_id", *[F.col("enu")[i].alias(c) for i, c in enumerate("xyz")])
    out = tr.track_extents(pos)
    return out.select("mission_id", *[rounded(F.col(c), 3).alias(c) for c in out.columns if c != "mission_id"])


def _indexed(spark, sf):
    """Keyframes with position, matched fix and a visual position per station."""
    rows = running_index(_matched(spark, sf), ["mission_id"], ["t"], F.floor(F.col("t") / 86400), "idx")
    origin = tr.track_origin(ad.telemetry(spark, sf))
    out = rows.join(origin, "mission_id", "left")
    enu = geo.to_enu(F.col("fix.lat"), F.col("fix.lon"), F.col("fix.alt"), F.col("lat0"), F.col("lon0"), F.col("alt0"))
    return out.select(
        "mission_id", "idx", "t", "inliers", F.col("fix.fix_type").alias("fix_type"),
        F.when(F.col("fix").isNotNull(), F.array(*enu)).alias("gps"),
        F.array(F.col("idx") * 1.5, F.col("value") / 10, F.sqrt(F.col("value"))).alias("visual"),
    )


_STATIONS = _MATCH + _ORIGIN + f""", st AS (SELECT m.*, row_number() OVER (PARTITION BY mission_id ORDER BY t)-1 idx, lat0, lon0, alt0 FROM matched m LEFT JOIN og USING (mission_id)),
 sv AS (SELECT mission_id, idx, t, inliers, fix_id, idx*1.5e0 vx, value/10 vy, sqrt(value) vz, {_ENU[0]} ge, {_ENU[1]} gn, {_ENU[2]} gu FROM st) """


@query("trajectory_level", "keyframes telemetry", _STATIONS + """SELECT mission_id, count(*) total_keyframes, count(fix_id) gps_points, CASE WHEN count(fix_id)>=3 THEN 'LEVEL_2_FUSED' ELSE 'LEVEL_1_VISUAL_ONLY' END "level",
 CASE WHEN count(fix_id)>=3 THEN 'FUSED_GPS_IMU' ELSE 'VISUAL_ONLY' END fusion_mode FROM sv GROUP BY 1""")
def _(spark, sf):
    return tr.trajectory_level(_indexed(spark, sf))


def _pairs(spark, sf):
    return _indexed(spark, sf).where(F.col("gps").isNotNull()).select("mission_id", F.col("visual").alias("src"), F.col("gps").alias("dst"))


_MOM = ", ".join(f"{r6(f'covar_pop({d},{s})+1e-7::DOUBLE',3)} c{i}{j}" for i, d in enumerate(("ge", "gn", "gu")) for j, s in enumerate(("vx", "vy", "vz")))


@query("alignment_moments", "keyframes telemetry", _STATIONS + f"""SELECT mission_id, count(*) n, {', '.join(f'{r6(f"avg({s})+1e-7::DOUBLE",3)} ms{i}' for i, s in enumerate(('vx','vy','vz')))},
 {', '.join(f'{r6(f"avg({s})+1e-7::DOUBLE",3)} md{i}' for i, s in enumerate(('ge','gn','gu')))}, {_MOM}, {r6('var_pop(vx)+var_pop(vy)+var_pop(vz)+1e-7::DOUBLE',3)} var_src FROM sv WHERE fix_id IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    m = tr.alignment_moments(_pairs(spark, sf), ["mission_id"])
    return m.select("mission_id", "n", *[rounded(F.col(c) + 1e-7, 3).alias(c) for c in m.columns if c not in ("mission_id", "n")])


@query("similarity_alignment")
def _(spark, sf):
    return tr.similarity_alignment(_pairs(spark, sf), ["mission_id"])


@query("aligned_residuals")
def _(spark, sf):
    pairs = _pairs(spark, sf)
    tf = tr.similarity_alignment(pairs, ["mission_id"])
    flat = pairs.select("mission_id", F.col("dst").alias("geo"), *[F.col("src")[i].alias(c) for i, c in enumerate("xyz")])
    moved = tr.apply_similarity(flat, tf, ["mission_id"]).withColumn("moved", F.array("x", "y", "z"))
    return gr.residual_report(moved)


# A known similarity: thrice ten degrees about the vertical, 2.5 times as large, moved by whole metres.
_TURN, _SHIFT = (0.8660254037844387, 0.49999999999999994), (100.0, 200.0, -50.0)


def _known_pairs(spark, sf):
    (c, s), k = _TURN, 2.5
    pairs = _indexed(spark, sf).where(F.col("gps").isNotNull()).select("mission_id", F.col("visual").alias("src"))
    x, y, z = (F.col("src")[i] for i in range(3))
    return pairs.withColumn("dst", F.array(k * (c * x - s * y) + _SHIFT[0], k * (s * x + c * y) + _SHIFT[1], k * z + _SHIFT[2]))


_KNOWN = _STATIONS + f""", kp AS (SELECT mission_id, vx, vy, vz, 2.5e0*({_TURN[0]}e0*vx-{_TURN[1]}e0*vy)+100 gx, 2.5e0*({_TURN[1]}e0*vx+{_TURN[0]}e0*vy)+200 gy, 2.5e0*vz-50 gz FROM sv WHERE fix_id IS NOT NULL),
 km AS (SELECT mission_id, count(*) n, avg(vx) a, avg(vy) b, avg(vz) d, avg(gx) p, avg(gy) q, avg(gz) r, CASE WHEN count(*)<3 THEN 1e0 ELSE {_TURN[0]}e0 END c, CASE WHEN count(*)<3 THEN 0e0 ELSE {_TURN[1]}e0 END s FROM kp GROUP BY 1) """


def _similarity_rows(found):
    at = lambda c, i, d: (rounded(F.col(c)[i] + 1e-9, d) + 0.0).alias(f"{c.lower()}{i}")
    return found.select("mission_id", "n", rounded(F.col("scale")).alias("scale"), *[at("R", i, 6) for i in (0, 1, 3, 8)], *[at("t", i, 3) for i in range(3)])


@query("recovered_similarity", "keyframes telemetry", _KNOWN + f"""SELECT mission_id, n, CASE WHEN n<3 THEN 1e0 ELSE 2.5e0 END AS "scale", {r6('c')} r0, {r6('-s')} r1, {r6('s')} r3, 1e0 r8,
 CASE WHEN n<3 THEN 0e0 ELSE 100e0 END t0, CASE WHEN n<3 THEN 0e0 ELSE 200e0 END t1, CASE WHEN n<3 THEN 0e0 ELSE -50e0 END t2 FROM km""")
def _(spark, sf):
    """The least-squares similarity of pairs that follow a known one exactly."""
    return _similarity_rows(tr.similarity_alignment(_known_pairs(spark, sf), ["mission_id"]))


@query("fixed_scale_similarity", "keyframes telemetry", _KNOWN + f"""SELECT mission_id, n, 3e0 AS "scale", {r6('c')} r0, {r6('-s')} r1, {r6('s')} r3, 1e0 r8,
 {r6('p-3*(c*a-s*b)+1e-9::DOUBLE', 3)} t0, {r6('q-3*(s*a+c*b)+1e-9::DOUBLE', 3)} t1, {r6('r-3*d+1e-9::DOUBLE', 3)} t2 FROM km""")
def _(spark, sf):
    """The same pairs with the scale given: the turn is found, and the shift follows the means."""
    moments = tr.alignment_moments(_known_pairs(spark, sf), ["mission_id"]).withColumn("given", F.lit(3.0))
    return _similarity_rows(tr.solve_similarity(moments, ["mission_id"], "given"))


@query("position_residuals", "keyframes telemetry", _STATIONS + f""", q AS (SELECT mission_id, count(*) stations, sqrt(avg(pow(ge-vx,2))) e, sqrt(avg(pow(gn-vy,2))) n, sqrt(avg(pow(gu-vz,2))) v,
 max(sqrt(pow(ge-vx,2)+pow(gn-vy,2))) mh, max(abs(gu-vz)) mv FROM sv WHERE fix_id IS NOT NULL GROUP BY 1)
 SELECT mission_id, stations, {r6('e',3)} rmse_east_m, {r6('n',3)} rmse_north_m, {r6('sqrt(e*e+n*n)',3)} rmse_horizontal_m, {r6('v',3)} rmse_vertical_m, {r6('sqrt(e*e+n*n+v*v)',3)} rmse_3d_m,
 {r6('1.5175e0*sqrt(e*e+n*n)',3)} ce90_m, {r6('1.6449e0*v',3)} le90_m, {r6('mh',3)} max_horizontal_m, {r6('mv',3)} max_vertical_m FROM q""")
def _(spark, sf):
    pairs = _pairs(spark, sf).select("mission_id", F.col("dst").alias("geo"), F.col("src").alias("moved"))
    return gr.residual_report(pairs)


@query("mean_inliers", "keyframes telemetry", _STATIONS + f""", p AS (SELECT mission_id, inliers, lead(idx) OVER (PARTITION BY mission_id ORDER BY idx) nx FROM sv)
 SELECT mission_id, {r6('avg(inliers)',1)} mean_inlier_matches FROM p WHERE nx IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    s = _indexed(spark, sf)
    following = s.select("mission_id", (F.col("idx") - 1).alias("idx"), F.col("idx").alias("frame_b"))
    pairs = s.join(following, ["mission_id", "idx"]).select("mission_id", F.col("idx").alias("frame_a"), "frame_b", "inliers")
    return tr.mean_inliers(pairs)


def _relative(spark, sf):
    return _turned(_indexed(spark, sf))


def _turned(s):
    """Relative poses: a turn about the vertical axis and a unit shift per keyframe."""
    a = F.radians(F.col("visual")[1] * 0.7130123)
    rot = F.array(F.cos(a), -F.sin(a), F.lit(0.0), F.sin(a), F.cos(a), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return s.select(
        "mission_id", F.col("idx").alias("camera_index"), rot.alias("rel_R"),
        F.array(F.lit(0.6), F.lit(0.0), F.lit(0.8)).alias("rel_t"), tr.nominal_step(F.lit(50.0)).alias("step_m"),
    )


# Turns about one axis add up, so a camera's centre is a sum over the turns before it.
_CHAIN = """, tu AS (SELECT *, CASE WHEN camera_index=0 THEN 0e0 ELSE a END a0, CASE WHEN camera_index=0 THEN 0e0 ELSE 4e0 END st FROM an),
 th AS (SELECT *, sum(a0) OVER (PARTITION BY mission_id ORDER BY camera_index) h FROM tu),
 ce AS (SELECT mission_id, camera_index, sum(-0.6e0*st*cos(h)) OVER w c0, sum(0.6e0*st*sin(h)) OVER w c1, sum(-0.8e0*st) OVER w c2 FROM th WINDOW w AS (PARTITION BY mission_id ORDER BY camera_index)) """


def _centres(chain):
    return chain.select("mission_id", "camera_index", *[rounded(F.col("c")[i] + 1e-7, 3).alias(f"c{i}") for i in range(3)])


_CENTRES = "SELECT mission_id, camera_index, " + ", ".join(f"{r6(f'c{i}+1e-7::DOUBLE', 3)} c{i}" for i in range(3)) + " FROM ce"


@query("pose_chain", "keyframes telemetry", _STATIONS + ", an AS (SELECT mission_id, idx camera_index, radians(vy*0.7130123e0) a FROM sv)" + _CHAIN + _CENTRES)
def _(spark, sf):
    return _centres(tr.chain_poses(_relative(spark, sf)))


#: Rows of a chunk in the queries over long tracks, so that their missions have many chunks on the test tables too.
LONG_CHUNK = 64


def _long_track(spark, sf):
    """Three missions that share all keyframes, with fixes near their path and some far off."""
    rows = ad.keyframes(spark, sf).select((F.col("mission_id") % 3).alias("mission_id"), "keyframe_id", "t", "inliers", "value")
    placed = running_index(rows, ["mission_id"], ["t", "keyframe_id"], F.floor(F.col("t") / 86400), "idx")
    visual = [F.col("idx") * 1.5, F.col("value") / 10, F.sqrt("value")]
    k = F.col("keyframe_id")
    off = (k % 7 - 3) * 0.1 + F.when(k % 11 == 0, 50.0).otherwise(0.0)
    kind = F.when(k % 3 == 0, "RTK_FIXED").when(k % 3 == 1, "RTK_FLOAT").otherwise("STANDALONE_GPS")
    return placed.select(
        "mission_id", "idx", "t", "inliers", kind.alias("fix_type"),
        F.when(k % 5 != 0, F.array(*[v + off for v in visual])).alias("gps"), F.array(*visual).alias("visual"),
    )


_LONG = """, kx AS (SELECT mission_id%3 mission_id, keyframe_id k, t, inliers, value, row_number() OVER (PARTITION BY mission_id%3 ORDER BY t, keyframe_id)-1 idx FROM keyframes),
 ky AS (SELECT *, idx*1.5e0 vx, value/10 vy, sqrt(value) vz, (k%7-3)*0.1e0+CASE WHEN k%11=0 THEN 50e0 ELSE 0e0 END o FROM kx),
 sv AS (SELECT mission_id, idx, t, inliers, CASE WHEN k%5<>0 THEN k END fix_id, CASE k%3 WHEN 0 THEN 'RTK_FIXED' WHEN 1 THEN 'RTK_FLOAT' ELSE 'STANDALONE_GPS' END fix_type,
 vx, vy, vz, vx+o ge, vy+o gn, vz+o gu FROM ky) """


@query("long_pose_chain", "keyframes", _LONG + ", an AS (SELECT mission_id, idx camera_index, radians(vy*0.7130123e0) a FROM sv)" + _CHAIN + _CENTRES)
def _(spark, sf):
    return _centres(tr.chain_poses(_turned(_long_track(spark, sf)), LONG_CHUNK))


@query("relative_orientation", "keyframes telemetry", _STATIONS + f", a AS (SELECT mission_id, idx camera_index, radians(vy*0.7130123e0) a FROM sv) SELECT mission_id, camera_index, {r6('degrees(a)',2)} yaw_deg, 0e0 pitch_deg, 0e0 roll_deg, {r6('cos(a/2)',5)} qw, 0e0 qx, 0e0 qy, {r6('sin(a/2)',5)} qz FROM a")
def _(spark, sf):
    out = tr.orientation(_relative(spark, sf).withColumn("R", F.col("rel_R")))
    return out.select("mission_id", "camera_index", "yaw_deg", "pitch_deg", "roll_deg", *[F.col("quaternion")[i].alias(f"q{c}") for i, c in enumerate("wxyz")])


_XV = ("x0", "x1", "x2", "v0", "v1", "v2")
_POS = ("x0", "x1", "x2")


def _kalman(z, var):
    """The columns of one update, of a subquery with a state, a fix ``z`` and its variance."""
    gap = {i: f"({z[i]}-x{i})" for i in range(3)}
    near = [f"x{i}+a/(a+{var})*{gap[i]} u{i}, v{i}+b/(a+{var})*{gap[i]} w{i}" for i in range(3)]
    far = "+".join(f"{gap[i]}*{gap[i]}" for i in range(3))
    return f"{', '.join(near)}, a-a/(a+{var})*a ua, b-a/(a+{var})*b ub, c-b/(a+{var})*b uc, ({far})/(a+{var}) far"


# Forward and backward, one station after the other; the covariance is the same on each axis.
_FUSION = f""", sm AS MATERIALIZED (SELECT mission_id, idx, t, inliers, fix_id IS NOT NULL has_gps, vx z0, vy z1, vz z2, ge g0, gn g1, gu g2, pow(0.25e0*(1+30e0/greatest(1,inliers)),2) vv,
 pow(CASE WHEN fix_type LIKE '%FIX%' THEN 0.02e0 WHEN fix_type LIKE '%FLOAT%' THEN 0.2e0 ELSE 2.5e0 END,2) gv FROM sv),
 fw AS (SELECT s.mission_id, s.idx, s.t, s.inliers, s.has_gps, {", ".join(f"CASE WHEN s.has_gps THEN s.g{i} ELSE s.z{i} END x{i}" for i in range(3))},
 {", ".join(f"coalesce((n.z{i}-s.z{i})/greatest(0.01e0,n.t-s.t),0e0) v{i}" for i in range(3))}, 10e0 a, 0e0 b, 50e0 c, false rejected,
 {", ".join(f"0e0 p{c}" for c in _XV)}, 0e0 pa, 0e0 pb, 0e0 pc, 0e0 dt FROM sm s LEFT JOIN sm n ON n.mission_id=s.mission_id AND n.idx=1 WHERE s.idx=0
 UNION ALL SELECT mission_id, idx, t, inliers, has_gps, {", ".join(f"CASE WHEN ok THEN u{i} ELSE x{i} END" for i in range(3))}, {", ".join(f"CASE WHEN ok THEN w{i} ELSE v{i} END" for i in range(3))},
 CASE WHEN ok THEN ua ELSE a END, CASE WHEN ok THEN ub ELSE b END, CASE WHEN ok THEN uc ELSE c END, has_gps AND NOT ok, {", ".join(f"p{c}" for c in _XV)}, pa, pb, pc, dt FROM (
 SELECT *, has_gps AND far<=CASE WHEN idx<=2 THEN 60e0 ELSE 16.27e0 END ok FROM (SELECT *, {_kalman(("g0", "g1", "g2"), "gv")} FROM (
 SELECT * EXCLUDE ({", ".join(_XV)}, a, b, c, u0, u1, u2, w0, w1, w2, ua, ub, uc, far), u0 x0, u1 x1, u2 x2, w0 v0, w1 v1, w2 v2, ua a, ub b, uc c FROM (SELECT *, {_kalman(("z0", "z1", "z2"), "vv")} FROM (
 SELECT *, {", ".join(f"{c} p{c}" for c in _XV)}, a pa, b pb, c pc FROM (
 SELECT mission_id, idx, t, inliers, has_gps, z0, z1, z2, g0, g1, g2, vv, gv, dt, x0+dt*v0 x0, x1+dt*v1 x1, x2+dt*v2 x2, v0, v1, v2, a+2*dt*b+dt*dt*c+0.01e0*dt a, b+dt*c b, c+0.25e0*dt c FROM (
 SELECT s.*, greatest(0.01e0, s.t-f.t) dt, {", ".join(f"f.{c}" for c in _XV)}, f.a, f.b, f.c FROM fw f JOIN sm s ON s.mission_id=f.mission_id AND s.idx=f.idx+1))))))))"""
_SMOOTH = f""", fm AS MATERIALIZED (SELECT * FROM fw), la AS (SELECT mission_id, max(idx) idx FROM fm GROUP BY 1),
 bw AS (SELECT f.* FROM fm f JOIN la USING (mission_id, idx)
 UNION ALL SELECT mission_id, idx, t, inliers, has_gps, {", ".join(f"x{i}+g00*dx{i}+g01*dv{i}" for i in range(3))}, {", ".join(f"v{i}+g10*dx{i}+g11*dv{i}" for i in range(3))},
 a+g00*g00*da+2*g00*g01*db+g01*g01*dc, b+g00*g10*da+(g00*g11+g01*g10)*db+g01*g11*dc, c+g10*g10*da+2*g10*g11*db+g11*g11*dc, rejected, {", ".join(f"p{c}" for c in _XV)}, pa, pb, pc, dt FROM (
 SELECT f.*, {", ".join(f"n.x{i}-n.px{i} dx{i}, n.v{i}-n.pv{i} dv{i}" for i in range(3))}, n.a-n.pa da, n.b-n.pb db, n.c-n.pc dc,
 ((f.a+n.dt*f.b)*n.pc-f.b*n.pb)/(n.pa*n.pc-n.pb*n.pb) g00, (f.b*n.pa-(f.a+n.dt*f.b)*n.pb)/(n.pa*n.pc-n.pb*n.pb) g01,
 ((f.b+n.dt*f.c)*n.pc-f.c*n.pb)/(n.pa*n.pc-n.pb*n.pb) g10, (f.c*n.pa-(f.b+n.dt*f.c)*n.pb)/(n.pa*n.pc-n.pb*n.pb) g11
 FROM bw n JOIN fm f ON f.mission_id=n.mission_id AND f.idx=n.idx-1)) """
_FUSED = f"""SELECT mission_id, idx, {r6('x0+1e-7::DOUBLE', 3)} x, {r6('x1+1e-7::DOUBLE', 3)} y, {r6('x2+1e-7::DOUBLE', 3)} z,
 {r6("least(0.99e0, greatest(0.15e0, greatest(0.2e0, 1e0-sqrt(greatest(0e0,3*a))/6e0)*0.6e0+least(1e0, greatest(0.3e0, inliers/100))*0.3e0+CASE WHEN has_gps THEN 0.15e0 ELSE 0e0 END))", 2)} confidence, rejected FROM bw"""
_REFUSED = """SELECT mission_id, count(*) FILTER (rejected) gps_outliers_rejected, count(*) FILTER (has_gps) gps_points FROM fw GROUP BY 1"""


def _fused(stations, chunk_rows=tr.CHUNK_ROWS):
    out = tr.smooth_backward(tr.forward_filter(stations, chunk_rows), chunk_rows)
    return out.select("mission_id", "idx", *[rounded(F.col("fused")[i] + 1e-7, 3).alias(c) for i, c in enumerate("xyz")], "confidence", "rejected")


def _refused(stations, chunk_rows=tr.CHUNK_ROWS):
    return tr.forward_filter(stations, chunk_rows).groupBy("mission_id").agg(
        F.count_if("rejected").alias("gps_outliers_rejected"), F.count_if("has_gps").alias("gps_points")
    )


@query("trajectory_fusion", "keyframes telemetry", _STATIONS.replace("inliers, fix_id,", "inliers, fix_id, fix_type,") + _FUSION + _SMOOTH + _FUSED)
def _(spark, sf):
    return _fused(_indexed(spark, sf))


@query("trajectory_outliers", "keyframes telemetry", _STATIONS.replace("inliers, fix_id,", "inliers, fix_id, fix_type,") + _FUSION + _REFUSED)
def _(spark, sf):
    return _refused(_indexed(spark, sf))


@query("long_track_fusion", "keyframes", _LONG + _FUSION + _SMOOTH + _FUSED)
def _(spark, sf):
    return _fused(_long_track(spark, sf), LONG_CHUNK)


@query("long_track_outliers", "keyframes", _LONG + _FUSION + _REFUSED)
def _(spark, sf):
    return _refused(_long_track(spark, sf), LONG_CHUNK)


_ANGLES = """, an AS (SELECT keyframe_id, CASE WHEN keyframe_id%50=0 THEN 0e0 ELSE keyframe_id*7%359-179.37e0 END ro, CASE WHEN keyframe_id%50=0 THEN 90e0 ELSE keyframe_id%178-89.21e0 END pi,
 CASE WHEN keyframe_id%50=0 THEN keyframe_id%80+0.13e0 ELSE keyframe_id%359-179.63e0 END ya FROM keyframes), hf AS (SELECT *, cos(radians(ro/2)) cr, sin(radians(ro/2)) sr, cos(radians(pi/2)) cp, sin(radians(pi/2)) sp, cos(radians(ya/2)) cy, sin(radians(ya/2)) sy FROM an),
 qu AS (SELECT *, cr*cp*cy+sr*sp*sy w, sr*cp*cy-cr*sp*sy x, cr*sp*cy+sr*cp*sy y, cr*cp*sy-sr*sp*cy z FROM hf),
 qs AS (SELECT *, CASE WHEN abs(w)>=greatest(abs(x),abs(y),abs(z))-1e-12::DOUBLE THEN sign(w) WHEN abs(x)>=greatest(abs(y),abs(z))-1e-12::DOUBLE THEN sign(x) WHEN abs(y)>=abs(z) THEN sign(y) ELSE sign(z) END s FROM qu) """


@query("general_orientation", "keyframes", _ANGLES + f"SELECT keyframe_id, {r6('ya',2)} yaw_deg, {r6('pi',2)} pitch_deg, {r6('ro',2)} roll_deg, {r6('s*w',5)} qw, {r6('s*x',5)} qx, {r6('s*y',5)} qy, {r6('s*z',5)} qz FROM qs")
def _(spark, sf):
    """Turns about all three axes, straight up included, from their angles and back."""
    k = F.col("keyframe_id")
    up = k % 50 == 0
    roll = F.when(up, 0.0).otherwise(k * 7 % 359 - 179.37)
    pitch = F.when(up, 90.0).otherwise(k % 178 - 89.21)
    yaw = F.when(up, k % 80 + 0.13).otherwise(k % 359 - 179.63)
    (cr, sr), (cp, sp), (cy, sy) = ((F.cos(F.radians(a)), F.sin(F.radians(a))) for a in (roll, pitch, yaw))
    rot = F.array(cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr, sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, -sp, cp * sr, cp * cr)
    out = tr.orientation(ad.keyframes(spark, sf).select("keyframe_id", rot.alias("R")))
    return out.select("keyframe_id", "yaw_deg", "pitch_deg", "roll_deg", *[F.col("quaternion")[i].alias(f"q{c}") for i, c in enumerate("wxyz")])


def _scale_cameras(spark, sf):
    s = _indexed(spark, sf)
    return s.select(
        "mission_id", "idx", F.col("visual").alias("rel"),
        F.when(F.col("gps").isNotNull(), F.array(*[F.col("visual")[i] * (5.0 + (F.col("idx") % 3) * 0.01) + F.col("idx") % 2 for i in range(3)])).alias("geo"),
        (F.col("mission_id") % 2 == 0).alias("is_rtk"),
    )


_GEO_V = ", ".join(f"{v}*(5e0+(idx%3)*0.01e0)+idx%2 g{i}" for i, v in enumerate(("vx", "vy", "vz")))
_PAIRS = _STATIONS + f""", cs AS (SELECT mission_id, idx, vx, vy, vz, fix_id, {_GEO_V} FROM sv WHERE fix_id IS NOT NULL),
 pr AS (SELECT a.mission_id, sqrt(pow(a.vx-b.vx,2)+pow(a.vy-b.vy,2)+pow(a.vz-b.vz,2)) dr, sqrt(pow(a.g0-b.g0,2)+pow(a.g1-b.g1,2)+pow(a.g2-b.g2,2)) dg FROM cs a JOIN cs b ON a.mission_id=b.mission_id AND a.idx<b.idx),
 ra AS (SELECT mission_id, dg/dr r FROM pr WHERE dr>0.1e0 AND dg>0.2e0), md AS (SELECT mission_id, median(r) m FROM ra GROUP BY 1),
 ma AS (SELECT mission_id, m, median(abs(r-m)) mad FROM ra JOIN md USING (mission_id) GROUP BY 1,2),
 inl AS (SELECT mission_id, r FROM ra JOIN ma USING (mission_id) WHERE abs(r-m)<=2.5e0*greatest(mad,1e-4::DOUBLE)),
 gs AS (SELECT mission_id, median(r) AS "scale", CASE WHEN count(*)>1 THEN stddev_pop(r) ELSE 0.05e0*median(r) END std, count(*) evaluated,
 CASE WHEN mission_id%2=0 THEN 'RTK_PPK_GNSS_BASELINES' ELSE 'STANDALONE_GNSS_BASELINES' END source FROM inl GROUP BY 1) """


@query("scale_from_positions", "keyframes telemetry", _PAIRS + f'SELECT mission_id, {r6("scale")} AS "scale", {r6("std")} std, evaluated, source FROM gs')
def _(spark, sf):
    out = gr.scale_from_positions(_scale_cameras(spark, sf))
    return out.select("mission_id", rounded(F.col("scale")).alias("scale"), rounded(F.col("std")).alias("std"), "evaluated", "source")


def _baselines(spark, sf):
    return _scale_cameras(spark, sf).where("idx >= 2 AND mission_id % 5 = 0").select(
        "mission_id", F.lit(0).cast("long").alias("idx_a"), F.col("idx").alias("idx_b"), (10.0 + F.col("idx") * 7).alias("distance_m")
    )


_BASE = """, bl AS (SELECT a.mission_id, (10e0+b.idx*7)/sqrt(pow(a.vx-b.vx,2)+pow(a.vy-b.vy,2)+pow(a.vz-b.vz,2)) s FROM sv a JOIN sv b ON a.mission_id=b.mission_id AND a.idx=0 AND b.idx>=2 WHERE a.mission_id%5=0
 AND sqrt(pow(a.vx-b.vx,2)+pow(a.vy-b.vy,2)+pow(a.vz-b.vz,2))>1e-4::DOUBLE),
 bs AS (SELECT mission_id, median(s) AS "scale", CASE WHEN count(*)>1 THEN stddev_pop(s) ELSE 0.02e0*median(s) END std, count(*) evaluated, 'CHECKPOINT_REFERENCE_SCALE' source FROM bl GROUP BY 1) """


@query("scale_from_baselines", "keyframes telemetry", _STATIONS + _BASE + f'SELECT mission_id, {r6("scale")} AS "scale", {r6("std")} std, evaluated, source FROM bs')
def _(spark, sf):
    out = gr.scale_from_baselines(_scale_cameras(spark, sf), _baselines(spark, sf))
    return out.select("mission_id", rounded(F.col("scale")).alias("scale"), rounded(F.col("std")).alias("std"), "evaluated", "source")


_ALT = """, al AS (SELECT mission_id, greatest(0.2e0, CASE WHEN count(*)>1 THEN max(vz)-min(vz) ELSE 1e0 END) h FROM sv GROUP BY 1),
 az AS (SELECT mission_id, greatest(0.01e0, flight_altitude_m/greatest(1e0,h*2)) AS "scale", CAST(1 AS BIGINT) evaluated, 'BAROMETRIC_LASER_ALTIMETRY' source FROM al JOIN missions USING (mission_id)),
 als AS (SELECT mission_id, "scale", 0.15e0*"scale" std, evaluated, source FROM az) """


@query("scale_from_altitude", "keyframes telemetry missions", _STATIONS + _ALT + f'SELECT mission_id, {r6("scale")} AS "scale", {r6("std")} std, evaluated, source FROM als')
def _(spark, sf):
    out = gr.scale_from_altitude(_scale_cameras(spark, sf), ad.missions(spark, sf))
    return out.select("mission_id", rounded(F.col("scale")).alias("scale"), rounded(F.col("std")).alias("std"), "evaluated", "source")


@query("scale_choice", "keyframes telemetry missions", _PAIRS + _BASE + _ALT + f""", al2 AS (SELECT *, 1 pr FROM bs UNION ALL SELECT *, 2 FROM gs UNION ALL SELECT *, 3 FROM als),
 ch AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY pr) rn FROM al2)
 SELECT mission_id, {r6("scale")} AS "scale", source, evaluated, CASE source WHEN 'CHECKPOINT_REFERENCE_SCALE' THEN 0.95e0 WHEN 'RTK_PPK_GNSS_BASELINES' THEN 0.92e0 WHEN 'STANDALONE_GNSS_BASELINES' THEN 0.78e0 WHEN 'BAROMETRIC_LASER_ALTIMETRY' THEN 0.55e0 END confidence
 FROM missions LEFT JOIN (SELECT * FROM ch WHERE rn=1) USING (mission_id)""")
def _(spark, sf):
    cams, m = _scale_cameras(spark, sf), ad.missions(spark, sf)
    out = gr.choose_scale(m, [gr.scale_from_baselines(cams, _baselines(spark, sf)), gr.scale_from_positions(cams), gr.scale_from_altitude(cams, m)])
    return out.select("mission_id", rounded(F.col("scale")).alias("scale"), "source", "evaluated", "confidence")


def _ground(spark, sf):
    """Checkpoints observed in local space with a known shift as transform."""
    s = _indexed(spark, sf).where("mission_id % 3 = 0")
    points = s.select(
        "mission_id", F.col("idx").cast("string").alias("id"), F.col("visual").alias("obs"),
        *[(2.0 * F.col("visual")[i] + 1.0 + (F.col("idx") % 4) * 0.05).alias(c) for i, c in enumerate(("east_m", "north_m", "up_m"))],
    )
    eye = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)])
    tf = s.select("mission_id").distinct().withColumn("scale", F.lit(2.0)).withColumn("R", eye).withColumn("t", F.array(*[F.lit(1.0)] * 3))
    return points, tf


_CP = ", cp AS (SELECT mission_id, CAST(idx AS VARCHAR) id, -(idx%4)*0.05e0 d FROM sv WHERE mission_id%3=0) "


@query("checkpoint_errors", "keyframes telemetry", _STATIONS + _CP + f"SELECT mission_id, id, {r6('d',3)} delta_east_m, {r6('d',3)} delta_north_m, {r6('d',3)} delta_vertical_m, {r6('sqrt(2*d*d)',3)} horizontal_error_m, {r6('sqrt(3*d*d)',3)} error_3d_m FROM cp")
def _(spark, sf):
    return gr.checkpoint_errors(*_ground(spark, sf))


@query("checkpoint_report", "keyframes telemetry missions", _STATIONS + _CP + f""", c2 AS (SELECT mission_id, count(*) n, sqrt(avg(pow({r6('sqrt(2*d*d)',3)},2))) h, sqrt(avg(d*d)) v FROM cp GROUP BY 1)
 SELECT mission_id, n IS NOT NULL checkpoints_provided, coalesce(n,0) checkpoint_count, {r6('h',3)} checkpoint_rmse_horizontal_m, {r6('v',3)} checkpoint_rmse_vertical_m FROM missions LEFT JOIN c2 USING (mission_id)""")
def _(spark, sf):
    return gr.checkpoint_report(ad.missions(spark, sf), gr.checkpoint_errors(*_ground(spark, sf)))


@query("accuracy_class", "missions", """SELECT mission_id, CASE WHEN mission_id%2=0 AND mission_id%3=0 THEN 'SURVEY_GRADE_RTK' WHEN mission_id%2=0 THEN 'ENGINEERING_PRELIMINARY' ELSE 'MAPPING_GRADE_STANDALONE' END accuracy_class,
 CAST(3+(mission_id%2<>0)::INT+(mission_id%3<>0)::INT AS INTEGER) limitations FROM missions""")
def _(spark, sf):
    k = F.col("mission_id")
    flags = ad.missions(spark, sf).select("mission_id", (k % 2 == 0).alias("rtk_available"), (k % 3 == 0).alias("checkpoints_provided"))
    return gr.accuracy_class(flags).select("mission_id", "accuracy_class", F.size("limitations").alias("limitations"))


@query("similarity_applied", "points", f"SELECT point_id, {r6('2*x+1')} x, {r6('-2*z+2')} y, {r6('2*y+3')} z FROM points")
def _(spark, sf):
    p = ad.points(spark, sf)
    turn = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 0, -1, 0, 1, 0)])
    tf = p.select("cloud_id").distinct().withColumn("scale", F.lit(2.0)).withColumn("R", turn).withColumn("t", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return tr.apply_similarity(p, tf, ["cloud_id"]).select("point_id", *[rounded(F.col(c)).alias(c) for c in "xyz"])
