"""Queries over matches, depth, clouds, meshes, views and confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfold.functions import linalg as la
from skyfold.functions.linalg import rounded
from skyfold.operators import cloud as pc, confidence as cf, dense as dn, mesh as ms, sparse as sp, views as vw
from skyfold.plans import adapters as ad
from skyfold.plans.registry import query, r6
from skyfold.session import cut_lineage


def _r(df, *names, digits=6):
    """Rounds the named columns."""
    return df.withColumns({n: rounded(F.col(n), digits) for n in names})


# ---- match pairs, descriptors, tie points ----

_PAIRS = """, n AS (SELECT mission_id, max(frame_index)+1 n FROM frames GROUP BY 1), i AS (SELECT f.mission_id, f.frame_index i, n FROM frames f JOIN n USING (mission_id)),
 pr AS (SELECT mission_id, i frame_i, i+s frame_j FROM i, (VALUES (1),(2),(3),(5)) q(s) WHERE i+s<n UNION SELECT mission_id, 0, i FROM i WHERE n>10 AND i>=10 AND i%10=0
 UNION SELECT mission_id, n-1-k, n-1 FROM n, (VALUES (1),(2),(3)) q(k) WHERE n>5) """


@query("match_pairs", "frames", _PAIRS + "SELECT * FROM pr")
def _(spark, sf):
    return sp.match_pairs(ad.frames(spark, sf).withColumnRenamed("frame_index", "idx"))


def _frame_pairs(spark, sf):
    d = ad.descriptors(spark, sf)
    return sp.match_pairs(d.select(F.lit(1).alias("mission_id"), F.col("frame").alias("idx")).distinct())


def _matches(spark, sf, ratio=0.95):
    d = ad.descriptors(spark, sf).withColumn("mission_id", F.lit(1))
    return sp.descriptor_matches(_frame_pairs(spark, sf), d, ratio)


_DESC = """, n AS (SELECT 1 m, max(frame)+1 n FROM descriptors), fi AS (SELECT DISTINCT frame i FROM descriptors), fp AS (SELECT i frame_i, i+s frame_j FROM fi, n, (VALUES (1),(2),(3),(5)) q(s) WHERE i+s<n
 UNION SELECT n-1-k, n-1 FROM n, (VALUES (1),(2),(3)) q(k) WHERE n>5),
 dd AS (SELECT frame_i, frame_j, a.kp, b.kp mk, list_distance(a.vec, b.vec) d FROM fp JOIN descriptors a ON a.frame=frame_i JOIN descriptors b ON b.frame=frame_j),
 dr AS (SELECT *, row_number() OVER (PARTITION BY frame_i, frame_j, kp ORDER BY d, mk) rn FROM dd),
 dm AS MATERIALIZED (SELECT x.frame_i, x.frame_j, x.kp, x.mk match_kp, x.d d1, y.d d2 FROM dr x JOIN dr y ON x.frame_i=y.frame_i AND x.frame_j=y.frame_j AND x.kp=y.kp AND x.rn=1 AND y.rn=2 WHERE x.d<0.95e0*y.d) """


@query("descriptor_matches", "descriptors", _DESC + f"SELECT frame_i, frame_j, kp, match_kp, {r6('d1')} d1, {r6('d2')} d2 FROM dm")
def _(spark, sf):
    return _r(_matches(spark, sf), "d1", "d2").drop("mission_id")


@query("supported_pairs", "descriptors", _DESC + "SELECT frame_i, frame_j, count(*) matches FROM dm GROUP BY 1,2 HAVING count(*)>=15")
def _(spark, sf):
    return sp.supported_pairs(_matches(spark, sf), 15).groupBy("frame_i", "frame_j").agg(F.count(F.lit(1)).alias("matches"))


@query("pair_report", "descriptors", _DESC + f""", i AS (SELECT *, d1<0.85e0*d2 ok FROM dm)
 SELECT frame_i, frame_j, count(*) raw_matches, count(*) FILTER (ok) verified_inliers, {r6('count(*) FILTER (ok)/count(*)',3)} inlier_ratio FROM i GROUP BY 1,2 HAVING count(*) FILTER (ok)>=1""")
def _(spark, sf):
    m = _matches(spark, sf)
    return sp.pair_report(m, m.where("d1 < 0.85 * d2"), 1).drop("mission_id")


_TRACKS = """, tn AS (SELECT frame_i frame, kp FROM dm UNION SELECT frame_j, match_kp FROM dm), te AS (SELECT kp a, match_kp b FROM dm UNION SELECT match_kp, kp FROM dm),
 lab AS (WITH RECURSIVE cc(kp, track) USING KEY (kp) AS (SELECT DISTINCT kp, kp FROM tn UNION SELECT e.b, min(c.track) FROM cc c JOIN te e ON e.a=c.kp JOIN recurring.cc r ON r.kp=e.b WHERE c.track<r.track GROUP BY e.b) SELECT * FROM cc),
 ln AS (SELECT track, count(DISTINCT frame) n FROM tn JOIN lab USING (kp) GROUP BY 1) """


@query("feature_track_statistics", "descriptors", _DESC + _TRACKS + f"""SELECT count(*) tracks, min(n) min_track_length, max(n) max_track_length, {r6('avg(n)',2)} mean_track_length,
 count(*) FILTER (n=2) views_2, count(*) FILTER (n=3) views_3, count(*) FILTER (n>=4) views_4_or_more FROM ln""")
def _(spark, sf):
    return sp.track_statistics(sp.feature_tracks(_matches(spark, sf))).drop("mission_id")


def _ties(spark, sf):
    """World points seen by two neighbouring cameras, from the order lines."""
    cams = ad.cameras(spark, sf)
    side = lambda s: cams.select("mesh_id", F.col("camera_id").alias(f"frame_{s}"), *[F.col(f"c{c}").alias(f"{s}{c}") for c in "xyz"])
    rows = ad.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("frame_i"), (F.col("l_suppkey") + 1).alias("frame_j"), F.col("l_linenumber").alias("line"),
        (F.col("l_partkey") % 100).cast("double").alias("wx"), (F.col("l_orderkey") % 50).cast("double").alias("wy"), (F.col("l_quantity") / 10).alias("wz"),
    )
    j = rows.join(side("i"), "frame_i").join(side("j"), ["mesh_id", "frame_j"])
    see = lambda s: (480.0 * (F.col("wx") - F.col(f"{s}x")) / (F.col(f"{s}z") - F.col("wz")) + 320.0,
                     480.0 * (F.col(f"{s}y") - F.col("wy")) / (F.col(f"{s}z") - F.col("wz")) + 240.0)
    (u1, v1), (u2, v2) = see("i"), see("j")
    return j.select("mesh_id", "frame_i", "frame_j", "line", "wx", "wy", "wz", u1.alias("u1"), v1.alias("v1"), u2.alias("u2"), v2.alias("v2"))


_TIES = """, tie AS (SELECT a.mesh_id, a.camera_id frame_i, b.camera_id frame_j, l_linenumber line, CAST(l_partkey%100 AS DOUBLE) X, CAST(l_orderkey%50 AS DOUBLE) Y, l_quantity/10 Z,
 a.cx ix, a.cy iy, a.cz iz, b.cx jx, b.cy jy, b.cz jz FROM lineitem JOIN cameras a ON a.camera_id=l_suppkey JOIN cameras b ON b.camera_id=l_suppkey+1 AND a.mesh_id=b.mesh_id),
 tu AS (SELECT *, 480*(X-ix)/(iz-Z)+320 u1, 480*(iy-Y)/(iz-Z)+240 v1, 480*(X-jx)/(jz-Z)+320 u2, 480*(jy-Y)/(jz-Z)+240 v2 FROM tie),
 ang AS (SELECT *, degrees(acos(greatest(-1e0,least(1e0,((X-ix)*(X-jx)+(Y-iy)*(Y-jy)+(Z-iz)*(Z-jz))/(sqrt((X-ix)*(X-ix)+(Y-iy)*(Y-iy)+(Z-iz)*(Z-iz))*sqrt((X-jx)*(X-jx)+(Y-jy)*(Y-jy)+(Z-jz)*(Z-jz))))))) ag FROM tu) """


@query("epipolar_distance", "cameras", _TIES + f""", e0 AS (SELECT frame_i, line, (u1-320)/480 ax, (v1-240)/480 ay, (u2-320)/480 bx, (v2+(line-4)*2e0-240)/480 b_y, ix-jx tx, jy-iy ty, jz-iz tz FROM tu),
 e1 AS (SELECT *, ty-tz*ay l0, tz*ax-tx l1, tx*ay-ty*ax l2 FROM e0)
 SELECT frame_i, line, count(*) matches, {r6('sum(abs(bx*l0+b_y*l1+l2)/sqrt(l0*l0/230400+l1*l1/230400))',3)} total_px,
 count(*) FILTER (abs(bx*l0+b_y*l1+l2)/sqrt(l0*l0/230400+l1*l1/230400)<=6.0000001e0) inliers FROM e1 GROUP BY 1,2""")
def _(spark, sf):
    noisy = _ties(spark, sf).withColumn("v2", F.col("v2") + (F.col("line") - 4) * 2.0)
    d = sp.epipolar_distance(noisy, ad.cameras(spark, sf), ["mesh_id"])
    return d.groupBy("frame_i", "line").agg(
        F.count(F.lit(1)).alias("matches"), rounded(F.sum("epipolar_px"), 3).alias("total_px"),
        F.count_if(F.col("epipolar_px") <= 6.0000001).alias("inliers"),
    )


def _verified(spark, sf):
    return sp.verified_points(sp.triangulate(_ties(spark, sf), ad.cameras(spark, sf), ["mesh_id"]))


@query("triangulated_points", "cameras", _TIES + f"SELECT frame_i, {r6('X',3)} x, {r6('Y',3)} y, {r6('Z',3)} z, {r6('ag',3)} angle_deg FROM ang WHERE ag>=2")
def _(spark, sf):
    out = _verified(spark, sf)
    return out.select("frame_i", *[rounded(F.col(c), 3).alias(c) for c in "xyz"], rounded(F.col("angle_deg"), 3).alias("angle_deg"))


@query("point_colours", "cameras pixels", _TIES + f"""SELECT frame_i, {r6('t.X',3)} wx, {r6('t.Y',3)} wy, r, g, b FROM ang t LEFT JOIN pixels p ON p.frame_id=frame_i
 AND p.x=greatest(0,least(31,CAST(round_even(u1/20,0) AS INTEGER))) AND p.y=greatest(0,least(31,CAST(round_even(v1/15,0) AS INTEGER))) WHERE ag>=2""")
def _(spark, sf):
    pts = _verified(spark, sf).withColumn("u1", F.col("u1") / 20).withColumn("v1", F.col("v1") / 15)
    pts = pts.select("frame_i", "u1", "v1", rounded(F.col("wx"), 3).alias("wx"), rounded(F.col("wy"), 3).alias("wy"))
    return sp.point_colours(pts, ad.pixels(spark, sf), 32, 32).select("frame_i", "wx", "wy", "r", "g", "b")


@query("reconstruction_metrics", "cameras", _TIES + f""", g AS (SELECT mesh_id, count(*) n, {', '.join(f'min({c}) mi{c}, max({c}) ma{c}' for c in 'XYZ')} FROM ang WHERE ag>=2 GROUP BY 1)
 SELECT m.mesh_id, coalesce(n,0) points, CASE WHEN n>=6 THEN 'ok' ELSE 'failed' END status, CASE WHEN n>=6 THEN 0e0 END mean_error_px,
 {', '.join(f"CASE WHEN n>=6 THEN {r6(f'mi{c}',2)} END min_{c.lower()}, CASE WHEN n>=6 THEN {r6(f'ma{c}',2)} END max_{c.lower()}, CASE WHEN n>=6 THEN {r6(f'ma{c}-mi{c}',2)} END span_{c.lower()}" for c in 'XYZ')},
 CASE WHEN n>=6 THEN {r6('least(0.99e0,0.5e0+0.3e0*least(1,n/300)+0.2e0)',2)} END confidence FROM (SELECT DISTINCT mesh_id FROM cameras) m LEFT JOIN g USING (mesh_id)""")
def _(spark, sf):
    return sp.reconstruction_metrics(ad.cameras(spark, sf).select("mesh_id").distinct(), _verified(spark, sf), keys=["mesh_id"])


@query("camera_centres", "cameras", f"SELECT camera_id, {r6('cx')} cx, {r6('cy')} cy, {r6('cz')} cz FROM cameras")
def _(spark, sf):
    c = la.camera_centre(la.arr9("R"), la.arr3("t"))
    return ad.cameras(spark, sf).select("camera_id", *[rounded(c[i]).alias(n) for i, n in enumerate(("cx", "cy", "cz"))])


# ---- dense ----

_FOCAL, _PP = 30.0, 16.0


def _views(spark, sf):
    optics = {"fx": _FOCAL, "fy": _FOCAL, "px": _PP, "py": _PP}
    return ad.cameras(spark, sf).select(
        F.col("camera_id").alias("frame_id"), "R", "t", *[F.lit(v).alias(k) for k, v in optics.items()],
        F.lit(32).alias("w"), F.lit(32).alias("h"), F.lit(_FOCAL).alias("focal_px"),
        (1.0 + F.col("camera_id") % 3).alias("baseline_m"), F.lit(20.0).alias("altitude_m"),
    )


_DEPTH = """, de AS (SELECT frame_id, x, y, gray, r, g, b, 30e0*(1e0+frame_id%3)/greatest(gray/3e0,0.1e0) depth FROM pixels WHERE gray/3e0>1),
 dep AS (SELECT * FROM de WHERE depth>=0.5 AND depth<=greatest(50e0,20e0*3.5e0)) """


def _depth(spark, sf):
    v = _views(spark, sf).select("frame_id", "focal_px", "baseline_m", "altitude_m")
    return dn.depth_from_disparity(ad.disparity(spark, sf), v)


@query("depth_from_disparity", "pixels", _DEPTH + f"SELECT frame_id, x, y, {r6('depth')} depth FROM dep")
def _(spark, sf):
    return _r(_depth(spark, sf).select("frame_id", "x", "y", "depth"), "depth")


from skyfold.plans.catalog.imaging import _STENCIL  # noqa: E402

_CONF = _DEPTH + _STENCIL + ", dc AS (SELECT d.*, least(greatest(0.65e0+0.35e0*least(greatest(gradient/80,0.2e0),1e0),0e0),1e0) conf FROM dep d JOIN grad USING (frame_id, x, y)) "


def _conf_depth(spark, sf):
    return dn.texture_confidence(_depth(spark, sf), ad.pixels(spark, sf), placed=True)


@query("depth_confidence", "pixels", _CONF + f"SELECT frame_id, x, y, {r6('conf')} conf FROM dc")
def _(spark, sf):
    return _r(_conf_depth(spark, sf).select("frame_id", "x", "y", "conf"), "conf")


_BACK = _CONF + """, bv AS (SELECT d.*, row_number() OVER (PARTITION BY frame_id ORDER BY y,x)-1 n FROM dc d WHERE conf>=0.75),
 bp AS (SELECT frame_id, x px_x, y px_y, conf, r, g, b, (x-16)*depth/30+cx wx, -((y-16)*depth/30)+cy wy, -depth+cz wz FROM bv JOIN cameras ON camera_id=frame_id WHERE n%2=0) """


def _back(spark, sf):
    return dn.back_project(_conf_depth(spark, sf), _views(spark, sf), 0.75, 2)


@query("back_projection", "pixels cameras", _BACK + f"SELECT frame_id, px_x, px_y, {r6('wx')} x, {r6('wy')} y, {r6('wz')} z FROM bp")
def _(spark, sf):
    return _r(_back(spark, sf).select("frame_id", "px_x", "px_y", "x", "y", "z"), "x", "y", "z")


@query("normalised_depth", "pixels", _DEPTH + f""", q AS (SELECT frame_id, quantile_cont(depth,0.05) qa, quantile_cont(depth,0.95) qb FROM dep GROUP BY 1)
 SELECT frame_id, x, y, {r6('least(greatest((depth-qa)/greatest(qb-qa,1e-3::DOUBLE),0e0),1e0)')} normalised FROM dep d JOIN q USING (frame_id)""")
def _(spark, sf):
    return _r(dn.normalised_depth(_depth(spark, sf)).select("frame_id", "x", "y", "normalised"), "normalised")


@query("stereo_partners", "cameras", f""", p AS (SELECT mesh_id, camera_id, cx, cy, cz, coalesce(lead(camera_id) OVER w, lag(camera_id) OVER w) partner_id FROM cameras WINDOW w AS (PARTITION BY mesh_id ORDER BY camera_id))
 SELECT p.camera_id, partner_id, {r6('p.cx-q.cx')} t0, {r6('q.cy-p.cy')} t1, {r6('q.cz-p.cz')} t2, {r6('sqrt(pow(p.cx-q.cx,2)+pow(p.cy-q.cy,2)+pow(p.cz-q.cz,2))')} baseline_m FROM p JOIN cameras q ON q.camera_id=partner_id""")
def _(spark, sf):
    poses = ad.cameras(spark, sf).select(F.col("mesh_id").alias("mission_id"), F.col("camera_id").alias("idx"), "camera_id", "R", "t")
    out = dn.stereo_partners(poses)
    return out.select("camera_id", "partner_id", *[rounded(F.col("rel_t")[i]).alias(f"t{i}") for i in range(3)], rounded(F.col("baseline_m")).alias("baseline_m"))


@query("depth_scale", "cameras pixels", _TIES + f""", pt AS (SELECT frame_i frame_id, iz-Z zc, CAST(round_even(30*(X-ix)/(iz-Z)+16,0) AS INTEGER) u, CAST(round_even(30*(iy-Y)/(iz-Z)+16,0) AS INTEGER) v FROM tie WHERE iz-Z>0.1),
 ok AS (SELECT *, row_number() OVER () id FROM pt WHERE u>=2 AND u<30 AND v>=2 AND v<30), md AS (SELECT id, frame_id, zc, median(gray/10e0+1) d FROM ok JOIN pixels p USING (frame_id) WHERE p.x BETWEEN u-1 AND u+1 AND p.y BETWEEN v-1 AND v+1 GROUP BY 1,2,3),
 s AS (SELECT frame_id, count(*) n, median(zc/d) m FROM md WHERE d>0.01 GROUP BY 1)
 SELECT frame_id, coalesce(n,0) samples, {r6('CASE WHEN n>=3 THEN least(greatest(m,0.1e0),1000e0) ELSE 1e0 END')} AS "scale" FROM (SELECT camera_id frame_id FROM cameras) LEFT JOIN s USING (frame_id)""")
def _(spark, sf):
    depth = ad.pixels(spark, sf).select("frame_id", "x", "y", (F.col("gray") / 10 + 1).alias("depth"))
    t = _ties(spark, sf)
    sparse = t.select(F.col("frame_i").alias("frame_id"), *[F.col(f"w{c}").alias(c) for c in "xyz"])
    return _r(dn.depth_scale(sparse, depth, _views(spark, sf)), "scale")


@query("voxel_first", "points", ", v AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, floor(x/2), floor(y/2), floor(z/2) ORDER BY point_id) rn FROM points) SELECT cloud_id, point_id, conf FROM v WHERE rn=1")
def _(spark, sf):
    return dn.voxel_filter(ad.points(spark, sf), 2.0).select("cloud_id", "point_id", "conf")


@query("voxel_most_confident", "points", ", v AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, floor(x/2), floor(y/2), floor(z/2) ORDER BY conf DESC, point_id) rn FROM points) SELECT cloud_id, point_id, conf FROM v WHERE rn=1")
def _(spark, sf):
    return dn.voxel_filter(ad.points(spark, sf), 2.0, keep="max_conf").select("cloud_id", "point_id", "conf")


@query("sigma_filter", "points", """, s AS (SELECT cloud_id, avg(x) mx, avg(y) m_y, avg(z) mz, stddev_pop(x) sx, stddev_pop(y) sy, stddev_pop(z) sz FROM points GROUP BY 1)
 SELECT cloud_id, point_id FROM points JOIN s USING (cloud_id) WHERE abs(x-mx)/sx<1.5 AND abs(y-m_y)/sy<1.5 AND abs(z-mz)/sz<1.5""")
def _(spark, sf):
    return dn.sigma_filter(ad.points(spark, sf), 1.5).select("cloud_id", "point_id")


@query("cloud_density", "points vertices", f""", d AS (SELECT cloud_id, count(*) points, max(x)-min(x) sx, max(y)-min(y) sy, max(z)-min(z) sz FROM points GROUP BY 1), sp AS (SELECT mesh_id cloud_id, count(*) n FROM vertices GROUP BY 1)
 SELECT cloud_id, points, {r6('sx',2)} span_x, {r6('sy',2)} span_y, {r6('sz',2)} span_z, {r6('points/greatest(1,sx*sy*sz)',1)} points_per_m3, {r6('CASE WHEN n>0 THEN points/n ELSE 1 END',1)} density_gain FROM d LEFT JOIN sp USING (cloud_id)""")
def _(spark, sf):
    counts = ad.vertices(spark, sf).groupBy(F.col("mesh_id").alias("cloud_id")).agg(F.count(F.lit(1)).alias("sparse_points"))
    return dn.density_metrics(ad.points(spark, sf), counts)


@query("cloud_confidence", "points", f"""SELECT cloud_id, {r6('avg(conf)',3)} mean_confidence, {r6('avg(CASE WHEN conf>=0.7e0 THEN 1e0 ELSE 0e0 END)*100',1)} high_pct,
 {r6('avg(CASE WHEN conf>=0.45e0 AND conf<0.7e0 THEN 1e0 ELSE 0e0 END)*100',1)} medium_pct, {r6('quantile_cont(conf,0.5)',3)} median_confidence FROM points GROUP BY 1""")
def _(spark, sf):
    return dn.confidence_summary(ad.points(spark, sf))


@query("cloud_output_status", "points", "SELECT cloud_id, count(*) points, CASE WHEN count(*)>=100 THEN 'ok' ELSE 'too_few_points' END status FROM points GROUP BY 1")
def _(spark, sf):
    p = ad.points(spark, sf)
    return dn.output_status(p, p)


# ---- cloud ----

@query("confidence_gate", "points", "SELECT cloud_id, point_id FROM points WHERE conf>=0.25e0")
def _(spark, sf):
    return pc.confidence_gate(ad.points(spark, sf)).select("cloud_id", "point_id")


@query("confidence_gate_fallback", "points", ", m AS (SELECT cloud_id, median(conf) t FROM points GROUP BY 1) SELECT cloud_id, point_id FROM points JOIN m USING (cloud_id) WHERE conf>=t")
def _(spark, sf):
    return pc.confidence_gate(ad.points(spark, sf), 2.0).select("cloud_id", "point_id")


_KNN = """, kn AS (SELECT a.cloud_id, a.point_id, min((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z),16) ds FROM points a JOIN points b ON a.cloud_id=b.cloud_id AND a.point_id<>b.point_id GROUP BY 1,2),
 kd AS (SELECT cloud_id, point_id, list_avg(list_transform(ds, lambda d: sqrt(d))) md FROM kn) """


@query("neighbour_distances", "points", _KNN + f"SELECT cloud_id, point_id, {r6('md')} mean_distance FROM kd")
def _(spark, sf):
    return _r(pc.neighbour_distances(ad.points(spark, sf)), "mean_distance")


@query("outlier_filter", "points", _KNN + """, st AS (SELECT cloud_id, avg(md)+1.5e0*greatest(stddev_pop(md),1e-4::DOUBLE) lim FROM kd GROUP BY 1)
 SELECT cloud_id, point_id FROM kd JOIN st USING (cloud_id) WHERE md<=lim""")
def _(spark, sf):
    return pc.outlier_filter(ad.points(spark, sf), 16, 1.5).select("cloud_id", "point_id")


@query("point_spacing", "points", f""", n1 AS (SELECT a.cloud_id, a.point_id, sqrt(min((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) d FROM points a JOIN points b ON a.cloud_id=b.cloud_id AND a.point_id<>b.point_id GROUP BY 1,2)
 SELECT cloud_id, {r6('median(d)')} spacing, {r6('least(5e0,greatest(1.5e0,median(d)*5))')} edge_limit FROM n1 GROUP BY 1""")
def _(spark, sf):
    return _r(pc.point_spacing(ad.points(spark, sf)), "spacing", "edge_limit")


@query("voxel_decimation", "points", ", v AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, round_even(x/3,0), round_even(y/3,0), round_even(z/3,0) ORDER BY point_id) rn FROM points) SELECT cloud_id, point_id FROM v WHERE rn=1")
def _(spark, sf):
    return pc.voxel_decimate(ad.points(spark, sf), 3.0).select("cloud_id", "point_id")


_COV = """, nb AS (SELECT a.cloud_id, a.point_id, min(row((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z), b.point_id<>a.point_id, b.point_id), 15) ns FROM points a JOIN points b ON a.cloud_id=b.cloud_id GROUP BY 1,2),
 nq AS (SELECT cloud_id, point_id, struct_extract_at(unnest(ns),3) id FROM nb), nu AS (SELECT nq.cloud_id, nq.point_id, [x,y,z] p FROM nq JOIN points b ON b.cloud_id=nq.cloud_id AND b.point_id=nq.id) """


@query("neighbourhood_covariance", "points", _COV + f"""SELECT point_id, {', '.join(f'{r6(f"covar_samp(p[{i+1}],p[{j+1}])+1e-8::DOUBLE",5)} c{a}{b}' for i, a in enumerate('xyz') for j, b in enumerate('xyz') if j >= i)} FROM nu GROUP BY cloud_id, point_id""")
def _(spark, sf):
    names = [f"c{a}{b}" for i, a in enumerate("xyz") for b in "xyz"[i:]]
    out = pc.neighbourhood_moments(ad.points(spark, sf)).select("point_id", *names)
    return _r(out.withColumns({n: F.col(n) + 1e-8 for n in names}), *names, digits=5)


def _normals(spark, sf):
    return pc.normals_and_curvature(pc.neighbourhood_moments(ad.points(spark, sf)))


@query("oriented_normals")
def _(spark, sf):
    cloud = F.floor(F.col("mesh_id") * ad.MESH_ROWS / ad.CLOUD_ROWS)  # a mesh's cameras look at the cloud of the same orders
    cams = ad.cameras(spark, sf).select(cloud.alias("cloud_id"), "camera_id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    return _r(pc.orient_normals(_normals(spark, sf), cams).select("point_id", "nx", "ny", "nz", "curvature"), "nx", "ny", "nz", "curvature")


@query("vertex_confidence")
def _(spark, sf):
    rows = _normals(spark, sf).join(ad.points(spark, sf).select("cloud_id", "point_id", "conf"), ["cloud_id", "point_id"])
    return _r(pc.vertex_confidence(rows).select("point_id", "vertex_conf"), "vertex_conf")


# ---- mesh ----

_FG = """, fc AS (SELECT f.*, a.x ax, a.y ay, a.z az, b.x bx, b.y b_y, b.z bz, c.x cx, c.y cy, c.z cz, a.conf ca, b.conf cb, c.conf cc FROM faces f JOIN vertices a ON a.mesh_id*1000000+a.v=f.mesh_id*1000000+v0 JOIN vertices b ON b.mesh_id*1000000+b.v=f.mesh_id*1000000+v1 JOIN vertices c ON c.mesh_id*1000000+c.v=f.mesh_id*1000000+v2),
 fn AS (SELECT *, (b_y-ay)*(cz-az)-(bz-az)*(cy-ay) gx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) gy, (bx-ax)*(cy-ay)-(b_y-ay)*(cx-ax) gz FROM fc),
 fg AS (SELECT *, sqrt(gx*gx+gy*gy+gz*gz) a2, sqrt(pow(bx-ax,2)+pow(b_y-ay,2)+pow(bz-az,2)) e0, sqrt(pow(cx-bx,2)+pow(cy-b_y,2)+pow(cz-bz,2)) e1, sqrt(pow(ax-cx,2)+pow(ay-cy,2)+pow(az-cz,2)) e2, (ax+bx+cx)/3 mx, (ay+b_y+cy)/3 m_y, (az+bz+cz)/3 mz FROM fn) """


@query("face_geometry", "vertices faces", _FG + f"SELECT mesh_id, f, {r6('e0')} e0, {r6('e1')} e1, {r6('e2')} e2, {r6('a2/2')} area, {r6('gx/a2')} nx, {r6('gy/a2')} ny, {r6('gz/a2')} nz, {r6('mz+1e-9::DOUBLE')} cz FROM fg")
def _(spark, sf):
    g = ms.face_geometry(ad.faces(spark, sf), ad.vertices(spark, sf)).withColumn("cz", F.col("cz") + 1e-9)
    return _r(g.select("mesh_id", "f", "e0", "e1", "e2", "area", "nx", "ny", "nz", "cz"), "e0", "e1", "e2", "area", "nx", "ny", "nz", "cz")


def _up(v):
    """Vertices with downward normals, so that every admitted face is turned."""
    return v.withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(-1.0)})


_ADMIT = _FG + """, ad AS (SELECT *, greatest(e0,e1,e2) lo, 0.5e0*abs((bx-ax)*(cy-ay)-(cx-ax)*(b_y-ay)) flat FROM fg),
 adm AS (SELECT mesh_id, f, v0, v2 v1, v1 v2 FROM ad WHERE lo<=3e0 AND a2>=1e-6::DOUBLE AND (flat<=1e-6::DOUBLE OR e0*e1*e2/(4*flat)<=4.5e0)) """


def _admitted(spark, sf):
    return ms.admit_faces(ad.faces(spark, sf), _up(ad.vertices(spark, sf)), 3.0)


@query("admitted_faces", "vertices faces", _ADMIT + "SELECT mesh_id, f, v0, v1, v2 FROM adm")
def _(spark, sf):
    return _admitted(spark, sf)


@query("admitted_faces_fallback", "vertices faces", _FG + """, c AS (SELECT mesh_id, quantile_cont(greatest(e0,e1,e2),0.4) q FROM fg GROUP BY 1)
 SELECT mesh_id, f, v0, v1, v2 FROM fg JOIN c USING (mesh_id) WHERE greatest(e0,e1,e2)<=q""")
def _(spark, sf):
    return ms.admit_faces(ad.faces(spark, sf), _up(ad.vertices(spark, sf)), 0.5)


@query("grid_surface", "points", """, ce AS (SELECT DISTINCT cloud_id, floor(x/2) i, floor(y/2) j FROM points)
 SELECT a.cloud_id mesh_id, count(*)*2 faces, CAST((SELECT count(*) FROM ce e WHERE e.cloud_id=a.cloud_id) AS BIGINT) vertices FROM ce a JOIN ce b ON b.cloud_id=a.cloud_id AND b.i=a.i+1 AND b.j=a.j JOIN ce c ON c.cloud_id=a.cloud_id AND c.i=a.i AND c.j=a.j+1
 JOIN ce d ON d.cloud_id=a.cloud_id AND d.i=a.i+1 AND d.j=a.j+1 GROUP BY 1""")
def _(spark, sf):
    v, f = ms.grid_surface(ad.points(spark, sf), 2.0)
    count = lambda df, n: df.groupBy("mesh_id").agg(F.count(F.lit(1)).alias(n))
    return count(f, "faces").join(count(v, "vertices"), "mesh_id")


@query("preview_surface", "cameras", _TIES + """, ok AS (SELECT mesh_id, X x, Y y FROM ang WHERE ag>=2), bx AS (SELECT mesh_id, min(x) x0, min(y) y0, greatest(max(x)-min(x), max(y)-min(y), 1e-6::DOUBLE)*1.001e0/16 cell, count(*) n FROM ok GROUP BY 1),
 ce AS (SELECT DISTINCT mesh_id, floor((x-x0)/cell) i, floor((y-y0)/cell) j FROM ok JOIN bx USING (mesh_id) WHERE n>=4), vc AS (SELECT mesh_id, count(*) vertices FROM ce GROUP BY 1),
 fc AS (SELECT a.mesh_id, count(*)*2 faces FROM ce a JOIN ce b ON b.mesh_id=a.mesh_id AND b.i=a.i+1 AND b.j=a.j JOIN ce c ON c.mesh_id=a.mesh_id AND c.i=a.i AND c.j=a.j+1 JOIN ce d ON d.mesh_id=a.mesh_id AND d.i=a.i+1 AND d.j=a.j+1 GROUP BY 1)
 SELECT mesh_id, vertices, coalesce(faces, 0) faces FROM vc LEFT JOIN fc USING (mesh_id)""")
def _(spark, sf):
    v, f = ms.preview_surface(_verified(spark, sf).withColumn("conf", F.lit(1.0)), "mesh_id", 16)
    count = lambda df, n: df.groupBy("mesh_id").agg(F.count(F.lit(1)).alias(n))
    return count(v, "vertices").join(count(f, "faces"), "mesh_id", "left").withColumn("faces", F.coalesce("faces", F.lit(0)))


@query("degenerate_faces_dropped", "vertices faces", _FG + "SELECT mesh_id, count(*) faces FROM fg WHERE a2/2>=2e0 GROUP BY 1")
def _(spark, sf):
    kept = ms.drop_degenerate(ad.faces(spark, sf), ad.vertices(spark, sf), 2.0)
    return kept.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("faces"))


def _with_fins(spark, sf):
    """Faces plus a fin on every seventh cell edge, which makes that edge non-manifold."""
    f = ad.faces(spark, sf)
    fins = f.where("f % 14 = 0").select("mesh_id", (-F.col("f") - 1).alias("f"), F.col("v1").alias("v0"), F.col("v2").alias("v1"), (F.col("v0") + 102).alias("v2"))
    return f.unionByName(fins)


_EDGES = """, fx AS (SELECT mesh_id, f, v0, v1, v2 FROM faces UNION ALL SELECT mesh_id, -f-1, v1, v2, v0+102 FROM faces WHERE f%14=0),
 ed AS (SELECT mesh_id, f, least(v0,v1) a, greatest(v0,v1) b FROM fx UNION ALL SELECT mesh_id, f, least(v1,v2), greatest(v1,v2) FROM fx UNION ALL SELECT mesh_id, f, least(v2,v0), greatest(v2,v0) FROM fx),
 ec AS (SELECT mesh_id, a, b, count(*) n FROM ed GROUP BY 1,2,3) """


@query("manifold_faces", "faces", _EDGES + "SELECT mesh_id, f, v0, v1, v2 FROM fx WHERE NOT EXISTS (SELECT 1 FROM ed JOIN ec USING (mesh_id,a,b) WHERE n>2 AND ed.mesh_id=fx.mesh_id AND ed.f=fx.f)")
def _(spark, sf):
    return ms.drop_non_manifold(_with_fins(spark, sf))


@query("boundary_edges", "faces", _EDGES + "SELECT mesh_id, a, b FROM ec WHERE n=1")
def _(spark, sf):
    return ms.boundary_edges(_with_fins(spark, sf))


_COMPACT = _ADMIT + """, us AS (SELECT mesh_id, v0 v FROM adm UNION SELECT mesh_id, v1 FROM adm UNION SELECT mesh_id, v2 FROM adm),
 nv AS (SELECT mesh_id, v, row_number() OVER (PARTITION BY mesh_id ORDER BY v)-1 w FROM us) """


@query("compact_faces", "vertices faces", _COMPACT + "SELECT adm.mesh_id, f, a.w v0, b.w v1, c.w v2 FROM adm JOIN nv a ON a.mesh_id*1000000+a.v=adm.mesh_id*1000000+v0 JOIN nv b ON b.mesh_id*1000000+b.v=adm.mesh_id*1000000+v1 JOIN nv c ON c.mesh_id*1000000+c.v=adm.mesh_id*1000000+v2")
def _(spark, sf):
    return ms.compact(ad.vertices(spark, sf), _admitted(spark, sf))[1]


_COMP = _ADMIT + """, ce AS (SELECT mesh_id, f, least(v0,v1) a, greatest(v0,v1) b FROM adm UNION ALL SELECT mesh_id, f, least(v1,v2), greatest(v1,v2) FROM adm UNION ALL SELECT mesh_id, f, least(v2,v0), greatest(v2,v0) FROM adm),
 c2 AS (SELECT mesh_id, min(f) fa, max(f) fb FROM ce GROUP BY mesh_id, a, b HAVING count(*)=2), lk AS (SELECT mesh_id, fa s, fb d FROM c2 UNION ALL SELECT mesh_id, fb, fa FROM c2),
 lab AS (WITH RECURSIVE cc(mesh_id, f, component) USING KEY (mesh_id, f) AS (SELECT mesh_id, f, f FROM adm UNION SELECT k.mesh_id, k.d, min(c.component) FROM cc c JOIN lk k ON k.mesh_id=c.mesh_id AND k.s=c.f JOIN recurring.cc r ON r.mesh_id=k.mesh_id AND r.f=k.d WHERE c.component<r.component GROUP BY 1,2) SELECT * FROM cc),
 sz AS (SELECT mesh_id, component, count(*) faces FROM lab GROUP BY 1,2) """


@query("component_sizes", "vertices faces", _COMP + "SELECT mesh_id, component, faces FROM sz")
def _(spark, sf):
    return ms.component_sizes(_admitted(spark, sf))


@query("pruned_mesh", "vertices faces", _COMP + """, tt AS (SELECT mesh_id, sum(faces) al, max(faces) mx FROM sz GROUP BY 1), lg AS (SELECT mesh_id, min(component) c FROM sz JOIN tt USING (mesh_id) WHERE faces=mx GROUP BY 1)
 SELECT l.mesh_id, l.f FROM lab l JOIN sz USING (mesh_id, component) JOIN tt USING (mesh_id) JOIN lg USING (mesh_id) WHERE faces>=CASE WHEN al>200 THEN greatest(15,floor(al*0.005e0)) ELSE 15 END OR component=lg.c""")
def _(spark, sf):
    return ms.prune_components(_admitted(spark, sf)).select("mesh_id", "f")


_RING = """, ed AS (SELECT mesh_id, least(v0,v1) a, greatest(v0,v1) b FROM faces UNION ALL SELECT mesh_id, least(v1,v2), greatest(v1,v2) FROM faces UNION ALL SELECT mesh_id, least(v2,v0), greatest(v2,v0) FROM faces),
 ec AS (SELECT mesh_id, a, b, count(*) n FROM ed GROUP BY 1,2,3), rg AS (SELECT mesh_id, a v, b o, n FROM ec UNION ALL SELECT mesh_id, b, a, n FROM ec), fx AS (SELECT DISTINCT mesh_id, v FROM rg WHERE n=1) """


def _pass(name, source):
    return f""", {name} AS (SELECT s.mesh_id, s.v, {', '.join(f's.{c}+coalesce(0.3e0*(m{c}-s.{c}),0e0) {c}' for c in 'xyz')} FROM {source} s LEFT JOIN (SELECT r.mesh_id, r.v, avg(q.x) mx, avg(q.y) m_y, avg(q.z) mz FROM rg r JOIN {source} q ON q.mesh_id*1000000+q.v=r.mesh_id*1000000+r.o
 WHERE NOT EXISTS (SELECT 1 FROM fx WHERE fx.mesh_id*1000000+fx.v=r.mesh_id*1000000+r.v) GROUP BY 1,2) m ON m.mesh_id*1000000+m.v=s.mesh_id*1000000+s.v) """.replace("my-s.y", "m_y-s.y")


@query("smoothed_mesh", "vertices faces", _RING + _pass("s1", "vertices") + _pass("s2", "s1") + f"SELECT mesh_id, v, {r6('x+1e-9::DOUBLE')} x, {r6('y+1e-9::DOUBLE')} y, {r6('z+1e-9::DOUBLE')} z FROM s2")
def _(spark, sf):
    out = ms.smooth(ad.vertices(spark, sf), ad.faces(spark, sf), 2).select("mesh_id", "v", "x", "y", "z")
    return _r(out.withColumns({c: F.col(c) + 1e-9 for c in "xyz"}), "x", "y", "z")


@query("reduced_mesh")
def _(spark, sf):
    v, f = ms.reduce_density(ad.vertices(spark, sf), ad.faces(spark, sf), "low")
    return v.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("vertices"), rounded(F.avg("conf"), 4).alias("mean_conf")).join(
        f.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("faces")), "mesh_id", "left")


@query("mesh_statistics", "vertices faces", _FG + f""", vs AS (SELECT mesh_id, count(*) vertices, {', '.join(f'{r6(f"min({c})",3)} min_{c}, {r6(f"max({c})",3)} max_{c}' for c in 'xyz')}, {r6('avg(conf)',3)} mean_conf, {r6('min(conf)',3)} min_conf, {r6('max(conf)',3)} max_conf,
 {r6('avg(CASE WHEN conf>=0.7e0 THEN 1e0 ELSE 0e0 END)*100',1)} high_pct, {r6('avg(CASE WHEN conf>=0.45e0 AND conf<0.7e0 THEN 1e0 ELSE 0e0 END)*100',1)} medium_pct, {r6('avg(CASE WHEN conf<0.45e0 THEN 1e0 ELSE 0e0 END)*100',1)} low_pct, {r6('median(conf)',3)} median_conf FROM vertices GROUP BY 1),
 fs AS (SELECT mesh_id, count(*) triangles, sum(a2/2) ar, {r6('avg((e0+e1+e2)/3)',3)} mean_edge_m, count(*) FILTER ((ca+cb+cc)/3<0.45e0) low_conf_faces FROM fg GROUP BY 1)
 SELECT vs.*, coalesce(triangles,0) triangles, {r6('coalesce(ar,0)',2)} surface_area_m2, {r6('coalesce(triangles,0)/greatest(1,coalesce(ar,0))',2)} triangles_per_m2, coalesce(mean_edge_m,0) mean_edge_m, coalesce(low_conf_faces,0) low_conf_faces FROM vs LEFT JOIN fs USING (mesh_id)""")
def _(spark, sf):
    return ms.mesh_statistics(ad.vertices(spark, sf), ad.faces(spark, sf))


_VN = """, vc AS (SELECT mesh_id, unnest([v0,v1,v2]) v, gx/a2 nx, gy/a2 ny, gz/a2 nz FROM fg WHERE a2>1e-7::DOUBLE), vm AS (SELECT mesh_id, v, sum(nx) sx, sum(ny) sy, sum(nz) s_z FROM vc GROUP BY 1,2),
 vn AS (SELECT q.*, coalesce(sx/sqrt(sx*sx+sy*sy+s_z*s_z),0) nx, coalesce(sy/sqrt(sx*sx+sy*sy+s_z*s_z),0) ny, coalesce(s_z/sqrt(sx*sx+sy*sy+s_z*s_z),0) nz FROM vertices q LEFT JOIN vm USING (mesh_id, v)) """


@query("vertex_normals", "vertices faces", _FG + _VN + f"SELECT mesh_id, v, {r6('nx')} nx, {r6('ny')} ny, {r6('nz')} nz FROM vn")
def _(spark, sf):
    return _r(ms.vertex_normals(ad.vertices(spark, sf), ad.faces(spark, sf)).select("mesh_id", "v", "nx", "ny", "nz"), "nx", "ny", "nz")


# ---- views ----

@query("camera_gate", "cameras", """, g AS (SELECT *, sharpness>=95 AND exposure>=0.8e0 ok FROM cameras), a AS (SELECT mesh_id, bool_or(ok) an, max(quality) mq FROM g GROUP BY 1), b AS (SELECT g.mesh_id, min(camera_id) bc FROM g JOIN a USING (mesh_id) WHERE quality=mq GROUP BY 1)
 SELECT camera_id, quality FROM g JOIN a USING (mesh_id) JOIN b USING (mesh_id) WHERE ok OR (NOT an AND camera_id=bc)""")
def _(spark, sf):
    return vw.camera_gate(ad.cameras(spark, sf), 95.0, 0.8).select("camera_id", "quality")


_VIEW = _FG + """, cm AS (SELECT mesh_id, camera_id, cx kx, cy ky, cz kz, quality FROM cameras),
 pv AS (SELECT t.*, camera_id, kx, ky, kz, quality, sqrt(pow(kx-mx,2)+pow(ky-m_y,2)+pow(kz-mz,2)) dist FROM fg t JOIN cm USING (mesh_id)),
 dm AS (SELECT mesh_id, greatest(0.5e0,min(dist)) dmin FROM pv GROUP BY 1),
 pq AS (SELECT *, (gx*(kx-mx)+gy*(ky-m_y)+gz*(kz-mz))/a2/dist cos_theta, 480*(mx-kx)/(kz-mz)+320 u, 480*(ky-m_y)/(kz-mz)+240 vp FROM pv WHERE kz-mz>0.1),
 vv AS (SELECT *, 0.4e0*cos_theta+0.25e0*least(greatest(dmin/dist,0.1e0),1e0)+0.2e0*quality+0.15e0*least(greatest(least(u,639-u,vp,479-vp)/240,0e0),1e0) score FROM pq JOIN dm USING (mesh_id)
 WHERE dist>=1e-4::DOUBLE AND cos_theta>0.15e0 AND u>=8 AND u<632 AND vp>=8 AND vp<472 AND kz-az>0.05e0 AND kz-bz>0.05e0 AND kz-cz>0.05e0),
 rk AS (SELECT *, row_number() OVER (PARTITION BY mesh_id, f ORDER BY score DESC, camera_id) rn FROM vv),
 best AS (SELECT q.mesh_id, q.f, camera_id, score, cos_theta, rn FROM faces q LEFT JOIN (SELECT mesh_id, f, camera_id, score, cos_theta, rn FROM rk WHERE rn<=3) r ON r.mesh_id=q.mesh_id AND r.f=q.f) """


def _views_of_faces(spark, sf):
    targets = vw.face_targets(ad.faces(spark, sf), ad.vertices(spark, sf))
    return vw.face_views(targets, ad.cameras(spark, sf))


def _best(spark, sf):
    """The best views; to be written by who reads them more than once."""
    return vw.best_views(_views_of_faces(spark, sf), ad.faces(spark, sf))


@query("face_visibility", "vertices faces cameras", _VIEW + f"SELECT mesh_id, f, camera_id, {r6('cos_theta')} cos_theta, {r6('score')} score FROM vv")
def _(spark, sf):
    return _r(_views_of_faces(spark, sf).select("mesh_id", "f", "camera_id", "cos_theta", "score"), "cos_theta", "score")


@query("best_views", "vertices faces cameras", _VIEW + f"SELECT mesh_id, f, camera_id, {r6('score')} score, rn view_rank FROM best")
def _(spark, sf):
    return _r(_best(spark, sf).select("mesh_id", "f", "camera_id", "score", "view_rank"), "score")


_COLOUR = _VIEW + """, pk AS (SELECT mesh_id, f, camera_id, score, count(*) OVER (PARTITION BY mesh_id, f) k,
 CAST(floor(CAST(floor(greatest(0e0,least((480*(ax-kx)/(kz-az)+480*(bx-kx)/(kz-bz)+480*(cx-kx)/(kz-cz))/3+320,639e0))) AS INTEGER)*0.05e0) AS INTEGER) pu,
 CAST(floor(CAST(floor(greatest(0e0,least((480*(ky-ay)/(kz-az)+480*(ky-b_y)/(kz-bz)+480*(ky-cy)/(kz-cz))/3+240,479e0))) AS INTEGER)*0.05e0) AS INTEGER) pv FROM rk WHERE rn<=3),
 tp AS (SELECT mesh_id, f, camera_id, score, pu+a x, pv+b y FROM pk, (VALUES (-1),(0),(1)) q(a), (VALUES (-1),(0),(1)) w(b) WHERE k=1 OR (a=0 AND b=0)),
 mxc AS (SELECT t.mesh_id, f, sum(score*score*r)/greatest(sum(score*score),1e-6::DOUBLE) r, sum(score*score*g)/greatest(sum(score*score),1e-6::DOUBLE) g, sum(score*score*b)/greatest(sum(score*score),1e-6::DOUBLE) b FROM tp t JOIN pixels p ON p.frame_id=t.camera_id AND p.x=t.x AND p.y=t.y GROUP BY 1,2) """


@query("face_colours", "vertices faces cameras pixels", _COLOUR + "SELECT mesh_id, f, coalesce(CAST(floor(r+1e-9::DOUBLE) AS INTEGER),100) r, coalesce(CAST(floor(g+1e-9::DOUBLE) AS INTEGER),116) g, coalesce(CAST(floor(b+1e-9::DOUBLE) AS INTEGER),139) b FROM faces LEFT JOIN mxc USING (mesh_id, f)")
def _(spark, sf):
    px = ad.pixels(spark, sf).select(F.col("frame_id").alias("camera_id"), "x", "y", "r", "g", "b")
    targets = cut_lineage(vw.face_targets(ad.faces(spark, sf), ad.vertices(spark, sf)))
    views = vw.face_views(targets, ad.cameras(spark, sf), stored=True)
    best = vw.best_views(views, ad.faces(spark, sf))
    return vw.face_colours(vw.with_optics(best, targets, ad.cameras(spark, sf)), px.withColumns({c: F.col(c) + 1e-9 for c in "rgb"}), 0.05)


@query("planar_uv", "vertices", f""", b AS (SELECT mesh_id, min(x) lx, greatest(max(x)-min(x),1e-4::DOUBLE) sx, min(y) ly, greatest(max(y)-min(y),1e-4::DOUBLE) sy FROM vertices GROUP BY 1)
 SELECT mesh_id, v, {r6('least(greatest((x-lx+0.02e0*sx)/(sx*1.04e0),0e0),1e0)')} tex_u, {r6('least(greatest((y-ly+0.02e0*sy)/(sy*1.04e0),0e0),1e0)')} tex_v FROM vertices JOIN b USING (mesh_id)""")
def _(spark, sf):
    return _r(vw.planar_uv(ad.vertices(spark, sf)).select("mesh_id", "v", "tex_u", "tex_v"), "tex_u", "tex_v")


_COVER = _VIEW + f""", cv AS (SELECT mesh_id, count(*) total_faces, count(camera_id) textured_faces, count(*)-count(camera_id) unobserved_faces, {r6('count(camera_id)/greatest(count(*),1)*100',1)} coverage_pct,
 CASE WHEN avg(cos_theta) IS NOT NULL THEN {r6('degrees(acos(least(greatest(avg(cos_theta),0e0),1e0)))',1)} ELSE 0e0 END mean_angle_deg FROM best WHERE rn=1 OR camera_id IS NULL GROUP BY 1) """


@query("texture_coverage", "vertices faces cameras", _COVER + "SELECT * FROM cv")
def _(spark, sf):
    return vw.coverage(_best(spark, sf))


@query("camera_contribution", "vertices faces cameras", _VIEW + f""", w AS (SELECT mesh_id, camera_id, count(*) n FROM best WHERE rn=1 GROUP BY 1,2), t AS (SELECT mesh_id, sum(n) al FROM w GROUP BY 1)
 SELECT c.mesh_id, c.camera_id, coalesce(n,0) faces_observed, {r6('coalesce(n,0)/greatest(coalesce(al,0),1)*100',1)} contribution_pct FROM cameras c LEFT JOIN w ON w.mesh_id=c.mesh_id AND w.camera_id=c.camera_id LEFT JOIN t ON t.mesh_id=c.mesh_id""")
def _(spark, sf):
    return vw.camera_contribution(cut_lineage(_best(spark, sf).select("mesh_id", "f", "camera_id", "view_rank")), ad.cameras(spark, sf))


@query("texture_report", "vertices faces cameras", _COVER + f""", ar AS (SELECT mesh_id, {r6('sum(a2/2)',2)} s FROM fg GROUP BY 1), un AS (SELECT *, round(s*unobserved_faces/greatest(total_faces,1),2) ua FROM cv JOIN ar USING (mesh_id))
 SELECT mesh_id, coverage_pct, total_faces, textured_faces, unobserved_faces, {r6('s',2)} total_area_m2, {r6('s-ua',2)} textured_area_m2, ua unobserved_area_m2, mean_angle_deg, {r6('4194304e0/greatest(1,s)',1)} texels_per_m2 FROM un""")
def _(spark, sf):
    stats = ms.mesh_statistics(ad.vertices(spark, sf), ad.faces(spark, sf))
    return vw.texture_report(vw.coverage(_best(spark, sf)), stats)


# ---- confidence ----

_DENS = f""", cp AS (SELECT point_id//{ad.MESH_ROWS} mesh_id, x*2 x, y y, z/5 z FROM points), cn AS (SELECT q.mesh_id, q.v, count(*) n FROM vertices q JOIN cp p ON p.mesh_id=q.mesh_id AND p.x BETWEEN q.x-1.5 AND q.x+1.5 AND (p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)<=2.25 GROUP BY 1,2),
 ds AS (SELECT q.*, coalesce(n,0) neighbour_count, least(1e0,coalesce(n,0)/0.785e0/120e0) density_score FROM vertices q LEFT JOIN cn USING (mesh_id, v)) """


def _density(spark, sf, vertices):
    # points lie about the mesh of their key's range, as its vertices do
    pts = ad.points(spark, sf).select(F.floor(F.col("point_id") / ad.MESH_ROWS).alias("mesh_id"), (F.col("x") * 2).alias("x"), "y", (F.col("z") / 5).alias("z"))
    return cf.density_score(vertices, pts, 1.5)


@query("density_score", "vertices points", _DENS + f"SELECT mesh_id, v, neighbour_count, {r6('density_score')} density_score FROM ds")
def _(spark, sf):
    return _r(_density(spark, sf, ad.vertices(spark, sf)).select("mesh_id", "v", "neighbour_count", "density_score"), "density_score")


@query("density_from_edges", "vertices faces", _RING + f""", el AS (SELECT e.mesh_id, avg(sqrt(pow(p.x-q.x,2)+pow(p.y-q.y,2)+pow(p.z-q.z,2))) m FROM ec e JOIN vertices p ON p.mesh_id*1000000+p.v=e.mesh_id*1000000+e.a JOIN vertices q ON q.mesh_id*1000000+q.v=e.mesh_id*1000000+e.b GROUP BY 1)
 SELECT mesh_id, {r6('least(1e0,1/greatest(1e-4::DOUBLE,m*m)/80)')} density_score, count(*) vertices FROM vertices LEFT JOIN el USING (mesh_id) GROUP BY 1,2""")
def _(spark, sf):
    out = _r(cf.density_from_edges(ad.vertices(spark, sf), ad.faces(spark, sf)), "density_score")
    return out.groupBy("mesh_id", "density_score").agg(F.count(F.lit(1)).alias("vertices"))


_EVID = _FG + _VN + _DENS + """, ov AS (SELECT n.mesh_id, n.v, (nx*(c.cx-x)+ny*(c.cy-y)+nz*(c.cz-z))/sqrt(pow(c.cx-x,2)+pow(c.cy-y,2)+pow(c.cz-z,2)) ct, quality, 480*(x-c.cx)/(c.cz-z)+320 u, 480*(c.cy-y)/(c.cz-z)+240 vp FROM vn n JOIN cameras c USING (mesh_id) WHERE c.cz-z>0.1),
 oa AS (SELECT mesh_id, v, count(*) n, max(ct) mc, avg(least(1e0,quality)) tq FROM ov WHERE ct>0.1e0 AND u>=12 AND u<628 AND vp>=12 AND vp<468 GROUP BY 1,2),
 ev AS (SELECT d.mesh_id, d.v, x, y, z, density_score, coalesce(n,0) n, coalesce(mc,0e0) mc, coalesce(tq,0e0) tq, CASE WHEN n>=2 THEN least(1e0,0.4e0+n*0.15e0) WHEN n=1 THEN 0.25e0 ELSE 0e0 END pa, CASE WHEN n>=2 THEN least(1e0,0.5e0+n*0.12e0) WHEN n=1 THEN 0.35e0 ELSE 0e0 END dp FROM ds d LEFT JOIN oa USING (mesh_id, v)),
 fu AS (SELECT *, CASE WHEN n=0 THEN 0.05e0 ELSE least(greatest(0.18e0+0.18e0*least(n/4,1)+0.16e0*least(greatest(mc,0e0),1e0)+0.12e0*0.8e0+0.12e0*dp+0.1e0*density_score+0.08e0*tq+0.06e0*pa,0e0),1e0) END confidence FROM ev),
 ti AS (SELECT *, CASE WHEN confidence<0.35e0 OR n=0 THEN 'UNKNOWN' WHEN confidence>=0.7e0 AND n>=2 THEN 'HIGH' WHEN confidence<0.7e0 AND n>=1 THEN 'MEDIUM' ELSE 'UNTIERED' END tier FROM fu) """


def _evidence(spark, sf):
    v = cut_lineage(ms.vertex_normals(ad.vertices(spark, sf), ad.faces(spark, sf)))
    evidence = cf.with_view_scores(cf.observation_evidence(v, cf.vertex_views(v, ad.cameras(spark, sf))))
    density = _density(spark, sf, ad.vertices(spark, sf)).select("mesh_id", "v", "density_score")
    return evidence.join(density, ["mesh_id", "v"])


def _tiered(spark, sf):
    return cut_lineage(cf.with_tier(cf.fuse(_evidence(spark, sf))))


@query("reweighted_confidence", "vertices faces cameras points", _EVID + f"""SELECT mesh_id, v, {r6("CASE WHEN n=0 THEN 0.05e0 ELSE least(greatest(0.3e0+0.18e0*least(n/4,1)+0.16e0*least(greatest(mc,0e0),1e0)+0.12e0*exp(-1.44e0/4.5e0)+0.12e0*dp+0e0*density_score+0.08e0*tq+0.06e0*pa,0e0),1e0) END")} confidence FROM ev""")
def _(spark, sf):
    """The fusion with two weights of its own and a measured mean error."""
    fused = cf.fuse(_evidence(spark, sf), {"visibility": 0.3, "point_density": 0.0}, F.lit(1.2))
    return _r(fused.select("mesh_id", "v", "confidence"), "confidence")


@query("observation_evidence", "vertices faces cameras points", _EVID + f"SELECT mesh_id, v, n observations, {r6('mc')} max_cos, {r6('tq')} texture_quality, {r6('pa')} parallax_score, {r6('dp')} depth_score FROM ev")
def _(spark, sf):
    v = ms.vertex_normals(ad.vertices(spark, sf), ad.faces(spark, sf))
    e = cf.with_view_scores(cf.observation_evidence(v, cf.vertex_views(v, ad.cameras(spark, sf))))
    names = ["max_cos", "texture_quality", "parallax_score", "depth_score"]
    return _r(e.select("mesh_id", "v", "observations", *names), *names)


@query("fused_confidence", "vertices faces cameras points", _EVID + f"SELECT mesh_id, v, {r6('confidence')} confidence, tier FROM ti")
def _(spark, sf):
    return _r(_tiered(spark, sf).select("mesh_id", "v", "confidence", "tier"), "confidence")


_T = ("HIGH", "MEDIUM", "UNKNOWN", "UNTIERED")


@query("tier_statistics", "vertices faces cameras points", _EVID + f"""SELECT mesh_id, count(*) total_vertices, {', '.join(f"count(*) FILTER (tier='{t}') {t.lower()}_vertices" for t in _T)},
 {', '.join(f'''{r6(f"count(*) FILTER (tier='{t}')/count(*)*100",2)} {t.lower()}_pct''' for t in _T)}, {r6('avg(n)',1)} mean_observations, max(n) max_observations FROM ti GROUP BY 1""")
def _(spark, sf):
    return cf.tier_statistics(_tiered(spark, sf))


@query("tier_areas", "vertices faces cameras points", _EVID + f""", fa AS (SELECT g.mesh_id, a2/2 ar, (a.confidence+b.confidence+c.confidence)/3 k FROM fg g JOIN ti a ON a.mesh_id*1000000+a.v=g.mesh_id*1000000+v0 JOIN ti b ON b.mesh_id*1000000+b.v=g.mesh_id*1000000+v1 JOIN ti c ON c.mesh_id*1000000+c.v=g.mesh_id*1000000+v2)
 SELECT mesh_id, {r6('sum(ar)',2)} total_area_m2, {r6('sum(CASE WHEN k>=0.7e0 THEN ar ELSE 0e0 END)',2)} high_area_m2, {r6('sum(CASE WHEN k>=0.35e0 AND k<0.7e0 THEN ar ELSE 0e0 END)',2)} medium_area_m2, {r6('sum(CASE WHEN k<0.35e0 THEN ar ELSE 0e0 END)',2)} unknown_area_m2 FROM fa GROUP BY 1""")
def _(spark, sf):
    return cf.tier_areas(_tiered(spark, sf), ad.faces(spark, sf))


@query("confidence_summary", "vertices faces cameras points", _EVID + f"SELECT mesh_id, {r6('avg(confidence)',3)} mean_confidence, {r6('stddev_pop(confidence)',3)} std_confidence, count(*) evaluated_points FROM ti GROUP BY 1")
def _(spark, sf):
    return cf.confidence_summary(_tiered(spark, sf))
