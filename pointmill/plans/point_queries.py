"""Queries of point transforms and point analytics (D, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointmill.operators import geom as g
from pointmill.operators import points as p
from pointmill.operators.sampling import farthest_resample
from pointmill.plans.base import again, query
from pointmill.plans.base import uniform_sql as u

XYZ = p.XYZ


def r6(df, *keys, cols=XYZ):
    """Keys and the columns rounded to 6 places. A nudge keeps exact halves apart from rounding modes; adding 0 turns -0 into 0."""
    return df.select(*keys, *((F.round(F.col(c) + F.lit(1e-10), 6) + F.lit(0.0)).alias(c) for c in cols))


def r_sql(*pairs: str) -> str:
    """``expr AS name`` items, rounded likewise."""
    return ", ".join(f"round({e.rsplit(' AS ', 1)[0]}+1e-10,6)+0.0 AS {e.rsplit(' AS ', 1)[1]}" for e in pairs)


_B = "b AS (SELECT cloud_id, min(x) nx, max(x) mx, avg(x) ax, min(y) ny, max(y) my, avg(y) ay, min(z) nz, max(z) mz, avg(z) az, count(*) n FROM big GROUP BY 1)"


@query("d1_bounds", "pts", sql="SELECT cloud_id, " + r_sql(*(f"{f}({c}) AS {n}_{c}" for c in XYZ for n, f in (("min", "min"), ("max", "max"), ("mean", "avg")))) + ", count(*) AS n_finite, count(*) AS n_points FROM pts GROUP BY 1")
def d1(pts):
    return r6(p.bounds(pts), "cloud_id", "n_finite", "n_points", cols=[f"{n}_{c}" for c in XYZ for n in ("min", "max", "mean")])


@query("d2_unit_sphere", "big", sql=f"""WITH {_B}, c AS (SELECT cloud_id, pt, x-ax x, y-ay y, z-az z FROM big JOIN b USING (cloud_id)), r AS (SELECT cloud_id, max(sqrt(x*x+y*y+z*z)) r FROM c GROUP BY 1)
SELECT cloud_id, pt, {r_sql('x/r AS x', 'y/r AS y', 'z/r AS z')} FROM c JOIN r USING (cloud_id)""")  # fmt: skip
def d2(big):
    return r6(p.unit_sphere(big), "cloud_id", "pt")


@query("d3_shared_normalise", "big", sql=f"""WITH v AS (SELECT cloud_id, min(view_id) v FROM big GROUP BY 1), b AS (SELECT cloud_id, avg(x) ax, avg(y) ay, avg(z) az FROM big JOIN v USING (cloud_id) WHERE view_id=v GROUP BY 1),
c AS (SELECT cloud_id, pt, ax, ay, az, x-ax x, y-ay y, z-az z FROM big JOIN b USING (cloud_id)), r AS (SELECT cloud_id, max(sqrt(x*x+y*y+z*z)) r FROM c GROUP BY 1)
SELECT cloud_id, pt, {r_sql('x/r AS x', 'y/r AS y', 'z/r AS z', '-ax/r AS origin_x', '-ay/r AS origin_y', '-az/r AS origin_z')} FROM c JOIN r USING (cloud_id)""")  # fmt: skip
def d3(big):
    return r6(p.shared_normalise(big), "cloud_id", "pt", cols=[*XYZ, "origin_x", "origin_y", "origin_z"])


@query("d4_pair_normalise", "big", sql=f"""WITH b AS (SELECT cloud_id, avg(x) ax, avg(y) ay, avg(z) az FROM big WHERE view_id<=2 GROUP BY 1),
c AS (SELECT cloud_id, pt, view_id, x-ax x, y-ay y, z-az z FROM big JOIN b USING (cloud_id)), r AS (SELECT cloud_id, max(sqrt(x*x+y*y+z*z)) r FROM c WHERE view_id>2 GROUP BY 1)
SELECT cloud_id, pt, {r_sql('x/r AS x', 'y/r AS y', 'z/r AS z')} FROM c JOIN r USING (cloud_id)""")  # fmt: skip
def d4(big):
    return r6(p.pair_normalise(big, F.col("view_id") <= 2), "cloud_id", "pt")


@query("d4_joint_rescale", "big", sql=f"""WITH b AS (SELECT cloud_id, avg(x) ax, avg(y) ay, avg(z) az FROM big WHERE view_id<=2 GROUP BY 1), c AS (SELECT cloud_id, pt, x-ax x, y-ay y, z-az z FROM big JOIN b USING (cloud_id)),
r AS (SELECT cloud_id, max(sqrt(x*x+y*y+z*z)) r FROM c GROUP BY 1) SELECT cloud_id, pt, {r_sql('x/r AS x', 'y/r AS y', 'z/r AS z')} FROM c JOIN r USING (cloud_id)""")  # fmt: skip
def d4j(big):
    return r6(p.joint_rescale(p.pair_normalise(big, F.col("view_id") <= 2)), "cloud_id", "pt")


@query("d5_features", "big", sql=f"""WITH {_B} SELECT cloud_id, {r_sql('(mx-nx)/50 AS size_x', '(my-ny)/100 AS size_y', '(mz-nz)/10 AS size_z', 'cloud_id%30/20.0 AS range_feature')} FROM b""")
def d5(big):
    return r6(p.object_features(big, (50.0, 100.0, 10.0), F.col("cloud_id") % 30), "cloud_id", cols=["size_x", "size_y", "size_z", "range_feature"])


@query("d6_resample", "big", dealt=True, sql=f"""WITH {_B}, k AS (SELECT big.cloud_id, pt, n, CASE WHEN mx-nx>=my-ny AND mx-nx>=mz-nz THEN x-nx WHEN my-ny>=mz-nz THEN y-ny ELSE z-nz END v, greatest(mx-nx,my-ny,mz-nz) w, md5('0::'||big.cloud_id||'::'||pt) h FROM big JOIN b USING (cloud_id)),
i AS (SELECT *, CASE WHEN w<=0 THEN 0 ELSE least(CAST(floor(v/w*8) AS BIGINT),7) END bin FROM k), nb AS (SELECT cloud_id, count(DISTINCT bin) b FROM i GROUP BY 1),
q AS (SELECT i.*, b, row_number() OVER (PARTITION BY cloud_id, bin ORDER BY h, pt) r FROM i JOIN nb USING (cloud_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY CASE WHEN r>700//b THEN 1 ELSE 0 END, h, pt)-1 p FROM q),
e AS (SELECT *, unnest(range(0, greatest(CAST(ceil(700/n::DOUBLE) AS BIGINT),1))) c FROM o)
SELECT cloud_id, pt, bin, CAST(c*n+p AS BIGINT) AS place FROM e WHERE c*n+p<700""")  # fmt: skip
def d6(big):
    return p.resample(big, 700).select("cloud_id", "pt", "bin", "place")


@query("d6_farthest", "big", dealt=True)
def d6f(big):
    """64 points of every cloud in farthest-point order; held against the sequential order in the tests."""
    return farthest_resample(big, 64).select("cloud_id", "pt", "bin", "place")


@query("d7_voxel_representative", "big", sql="""SELECT cloud_id, pt FROM (SELECT cloud_id, pt, row_number() OVER (PARTITION BY cloud_id, floor(x/5), floor(y/5), floor(z/5) ORDER BY md5(cast(pt AS varchar)), pt) r FROM big) WHERE r=1""")
def d7(big):
    return g.consolidate(big, 5.0, -1e9, [F.md5(F.col("pt").cast("string")), F.asc("pt")]).select("cloud_id", "pt")


@query("d8_dropout", "big", sql=f"""SELECT cloud_id, pt FROM (SELECT cloud_id, pt, {u("'0::'||cloud_id")}*0.4+0.2 rate, {u("'0::'||cloud_id||'::'||pt")} u FROM big) QUALIFY u>rate OR row_number() OVER (PARTITION BY cloud_id ORDER BY u DESC, pt)=1""")
def d8(big):
    return p.dropout(big, 0.2, 0.6).select("cloud_id", "pt")


@query("d9_noise", "big", sql=f"""WITH {_B}, e AS (SELECT *, unnest(range(1, CAST(round(n*0.05) AS BIGINT)+1)) i FROM b)
SELECT cloud_id, pt, {r_sql('x AS x', 'y AS y', 'z AS z')}, 0 AS is_noise FROM big UNION ALL
SELECT cloud_id, -i, """ + r_sql(*(f"(m{c}+n{c})/2+(2*{u(chr(39) + '0::' + chr(39) + '||cloud_id||' + chr(39) + '::' + chr(39) + '||i||' + chr(39) + '::' + c + chr(39))}-1)*greatest((m{c}-n{c})/2*1.1,1e-3) AS {c}" for c in XYZ)) + ", 1 FROM e")  # fmt: skip
def d9(big):
    return r6(p.add_noise(big, 0.05, 1.1), "cloud_id", "pt", "is_noise")


def _gauss(c: str, seed: str = "0") -> str:
    h = f"{seed}||'::'||cloud_id||'::'||pt||'::{c}::"
    return f"sqrt(-2*ln(greatest({u(h + 'u' + chr(39))},1e-12)))*cos(2*pi()*{u(h + 'v' + chr(39))})*0.02"


@query("d10_top_down", "big", dealt=True, sql=f"""WITH {_B}, w AS (SELECT cloud_id, pt, x, y, z, ln(greatest({u("'0::'||cloud_id||'::'||pt")},1e-12))/greatest(CASE WHEN mz-nz>1e-6 THEN 0.3+0.7*(z-nz)/(mz-nz) ELSE 1 END,1e-12) k,
greatest(1,round_even(n*(0.4+{u("'0::'||cloud_id||'::keep'")}*(0.6-0.4)),0)) q FROM big JOIN b USING (cloud_id)), s AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY cloud_id ORDER BY k DESC, pt)<=q)
SELECT cloud_id, pt, {r_sql(f'x+{_gauss("x")} AS x', f'y+{_gauss("y")} AS y', 'm+(z-m)*0.3 AS z')} FROM (SELECT *, avg(z) OVER (PARTITION BY cloud_id) m FROM s)""")  # fmt: skip
def d10(big):
    return r6(p.top_down(big, (0.4, 0.6), 0.3, 0.7, xy_sigma=0.02), "cloud_id", "pt")


_AUG = ", ".join(f"{u(chr(39) + '0::' + chr(39) + '||cloud_id||' + chr(39) + '::' + k + chr(39))} {n}" for k, n in (("a", "ua"), ("b", "ub"), ("c", "uc"), ("s", "us"), ("tx", "ux"), ("ty", "uy"), ("tz", "uz")))


@query("d11_augment", "big", sql=f"""WITH q AS (SELECT cloud_id, {_AUG} FROM (SELECT DISTINCT cloud_id FROM big)), a AS (SELECT cloud_id, (2*ua-1)*0.5 a, (2*ub-1)*0.5 b, (2*uc-1)*0.5 c, 0.9+us*(1.1-0.9) s, (2*ux-1)*0.1 tx, (2*uy-1)*0.1 ty, (2*uz-1)*0.1 tz FROM q),
i AS (SELECT cloud_id, pt, x, cos(a)*y-sin(a)*z y, sin(a)*y+cos(a)*z z, b, c, s, tx, ty, tz FROM big JOIN a USING (cloud_id)), j AS (SELECT cloud_id, pt, cos(b)*x+sin(b)*z x, y, cos(b)*z-sin(b)*x z, c, s, tx, ty, tz FROM i)
SELECT cloud_id, pt, {r_sql('s*(cos(c)*x-sin(c)*y)+tx AS x', 's*(sin(c)*x+cos(c)*y)+ty AS y', 's*z+tz AS z')} FROM j""")  # fmt: skip
def d11(big):
    return r6(p.augment(big, 0.5, (0.9, 1.1), 0.1), "cloud_id", "pt")


@query("d12_jitter", "pts", sql="SELECT cloud_id, pt, " + r_sql(*(f"{c}+greatest(least({_gauss(c)},0.05),-0.05) AS {c}" for c in XYZ)) + " FROM pts")
def d12(pts):
    return r6(p.jitter(pts, 0.02, 0.05), "cloud_id", "pt")


@query("d13_rotate_z", "pts", sql="SELECT cloud_id, pt, " + r_sql("x*cos(radians(30))-y*sin(radians(30)) AS x", "x*sin(radians(30))+y*cos(radians(30)) AS y", "z AS z") + " FROM pts")
def d13(pts):
    return r6(p.rotate_z(pts, 30.0), "cloud_id", "pt")


@query("d14_mirror", "big", sql=f"""WITH m AS (SELECT *, (min(x) OVER w+max(x) OVER w)/2 m FROM big WINDOW w AS (PARTITION BY cloud_id)), k AS (SELECT *, count(*) FILTER (x<=m) OVER w a, count(*) FILTER (x>=m) OVER w b FROM m WINDOW w AS (PARTITION BY cloud_id)),
s AS (SELECT * FROM k WHERE CASE WHEN a>=b THEN x<=m ELSE x>=m END)
SELECT cloud_id, pt, 0 AS mirrored, {r_sql('x AS x', 'y AS y', 'z AS z')} FROM s UNION ALL SELECT cloud_id, pt, 1, {r_sql('2*m-x AS x', 'y AS y', 'z AS z')} FROM s""")  # fmt: skip
def d14(big):
    return r6(p.mirror(big, "x", "larger"), "cloud_id", "pt", "mirrored")


@query("d15_target_nearest", "cat", "pts", sql="""WITH n AS (SELECT object_id, arg_min(ord, struct_pack(a:=confidence, b:=ord)) AS cloud_id FROM cat GROUP BY 1) SELECT object_id, cloud_id, pt FROM n JOIN pts USING (cloud_id)""")
def d15(cat, pts):
    return p.target_clouds(cat.withColumnRenamed("ord", "cloud_id"), pts, ["object_id"], "confidence").select("object_id", "cloud_id", "pt")


@query("d15_target_all", "cat", "pts", sql="""SELECT class_name, object_id, count(*) AS n, round(sum(x),6) AS sx FROM cat JOIN pts ON ord=cloud_id GROUP BY 1,2""")
def d15a(cat, pts):
    return p.target_clouds(cat.withColumnRenamed("ord", "cloud_id"), pts, ["class_name", "object_id"]).groupBy("class_name", "object_id").agg(F.count("*").alias("n"), F.round(F.sum("x"), 6).alias("sx"))


@query("d16_partial_view", "frm", sql="""WITH r AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY extent, frame_id) r, extent > min(extent) OVER (PARTITION BY group_key)+20 far FROM frm), a AS (SELECT *, bool_or(far) OVER (PARTITION BY group_key) hasfar FROM r)
SELECT group_key, frame_id FROM a WHERE CASE WHEN hasfar THEN far ELSE r>1 END QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY r)=1""")  # fmt: skip
def d16(frm):
    return p.partial_view(frm, 20.0, "group_key", "extent", "frame_id").select("group_key", "frame_id")


def _occ(src: str, i: int) -> str:
    return f"""c{i} AS (SELECT cloud_id, arg_min(struct_pack(x:=x,y:=y,z:=z), struct_pack(h:=md5('0::{i}::'||cloud_id||'::'||pt), p:=pt)) c FROM {src} GROUP BY 1),
o{i} AS (SELECT {src}.* REPLACE (rm-CAST(ceil(rm/{2 - i}.0::DOUBLE) AS BIGINT) AS rm) FROM {src} JOIN c{i} USING (cloud_id) QUALIFY row_number() OVER (PARTITION BY cloud_id ORDER BY round(power(y-c.y,2)+power(z-c.z,2)+power(x-c.x,2),9), pt)>ceil(rm/{2 - i}.0::DOUBLE))"""


@query("d17_occlude", "big", dealt=True, sql=f"""WITH t AS (SELECT *, CASE WHEN n>1 THEN n-greatest(1,CAST(round_even(n*(0.5+{u("'0::'||cloud_id||'::keep'")}*(0.8-0.5)),0) AS BIGINT)) ELSE 0 END rm FROM (SELECT *, count(*) OVER (PARTITION BY cloud_id) n FROM big)), {_occ('t', 0)}, {_occ('o0', 1)} SELECT cloud_id, pt FROM o1""")
def d17(big):
    return p.occlude(big, (0.5, 0.8), 2).select("cloud_id", "pt")


def _sil(a: str, b: str, n: int) -> str:
    cut = f"(SELECT *, floor(({a}-lo)/(hi-lo)*{n}) bn FROM (SELECT *, min({a}) OVER (PARTITION BY cloud_id) lo, max({a}) OVER (PARTITION BY cloud_id) hi FROM big) WHERE hi>lo)"
    return f"SELECT cloud_id, unnest([arg_min(struct_pack(x:=x,y:=y), struct_pack(v:={b},p:=pt)), arg_max(struct_pack(x:=x,y:=y), struct_pack(v:={b},p:=pt))]) s FROM {cut} WHERE bn<{n} GROUP BY cloud_id, bn"


@query("d18_silhouette", "big", dealt=True, sql=f"""SELECT DISTINCT cloud_id, s.x AS x, s.y AS y, 0.0::DOUBLE AS z FROM ({_sil('x', 'y', 120)} UNION ALL {_sil('y', 'x', 40)})""")
def d18(big):
    return p.silhouette(big, "x", "y", 120)


_POSE = "SELECT cloud_id, cloud_id%3>0 AS accepted, cos(cloud_id*0.1::DOUBLE) c, sin(cloud_id*0.1::DOUBLE) s, cloud_id%7*1.0::DOUBLE t FROM (SELECT DISTINCT cloud_id FROM big)"


def _poses(big, key="cloud_id"):
    t = big.select(key).distinct()
    c, s, d = F.cos(F.col(key) * 0.1), F.sin(F.col(key) * 0.1), F.col(key) % 7 * 1.0
    z, o = F.lit(0.0), F.lit(1.0)
    return t.select(key, (F.col(key) % 3 > 0).alias("accepted"), F.array(c, -s, z, d, s, c, z, z, z, z, o, -d).alias("transform"))


@query("d19_pose", "big", sql=f"""WITH p AS ({_POSE}) SELECT cloud_id, pt, {r_sql('c*x-s*y+t AS x', 's*x+c*y AS y', 'z-t AS z')} FROM big JOIN p USING (cloud_id) WHERE accepted""")
def d19(big):
    return r6(p.apply_pose(big, _poses(big)), "cloud_id", "pt")


@query("d19_frame_poses", "big", sql=f"""WITH p AS ({_POSE}) SELECT cloud_id, pt, {r_sql('c*x-s*y+t AS x', 's*x+c*y AS y', 'z-t AS z')} FROM big JOIN p USING (cloud_id) WHERE (cloud_id+view_id)%3>0 AND view_id<>4""")
def d19f(big):
    """Poses of frames as arrays in the metadata of the cloud, some not accepted, some without a matrix; frame ids as texts with zeros in front."""
    t = _poses(big).join(big.select("cloud_id", "view_id").distinct(), "cloud_id")
    last = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    matrix = F.when(F.col("view_id") != 4, F.concat(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.slice("transform", 4 * i + 1, 4)), F.array(last)))
    item = F.struct(F.col("view_id").alias("frame_id"), ((F.col("cloud_id") + F.col("view_id")) % 3 > 0).alias("accepted"), F.array(F.lit(0.0)).alias("pose_6d_radians"), matrix.alias("transform"))
    stem = F.concat(F.lit("run_1__object_"), F.col("cloud_id").cast("string"))
    metadata = t.groupBy(stem.alias("stem")).agg(F.collect_list(item).alias("final_frame_poses"))
    frame = F.concat(F.lit("00"), F.col("view_id").cast("string"))
    points = big.withColumn("frame_id", frame).withColumn("stem", F.concat(stem, F.lit("__frame_"), frame))
    return r6(p.apply_frame_poses(points, metadata), "cloud_id", "pt")


@query("d20_normalised_pose", "big", sql=f"""WITH p AS ({_POSE}), b AS (SELECT cloud_id, avg(x) x, avg(y) y, avg(z) z FROM big GROUP BY 1), a AS (SELECT *, cloud_id%10 grp, first_value(c) OVER w c0, first_value(s) OVER w s0, first_value(t) OVER w t0 FROM p WINDOW w AS (PARTITION BY cloud_id%10 ORDER BY cloud_id)),
r AS (SELECT cloud_id, c0*c+s0*s r00, c0*s-s0*c r10, c0*(t-t0) tx, -s0*(t-t0) ty, -(t-t0) tz FROM a)
SELECT cloud_id, {r_sql('r00 AS r00', '(r00*x-r10*y+tx-x)/4 AS tx', '(r10*x+r00*y+ty-y)/4 AS ty', 'tz/4 AS tz')} FROM r JOIN b USING (cloud_id)""")  # fmt: skip
def d20n(big):
    """The same in coordinates that are centred on the cloud's mean and divided by 4."""
    rel = p.relative_pose(_poses(big).withColumn("grp", F.col("cloud_id") % 10), "grp", "cloud_id").join(p.bounds(big), "cloud_id")
    rel = p.normalised_pose(rel, tuple(F.col("mean_" + c) for c in XYZ), F.lit(4.0))
    cell = {"r00": 0, "tx": 3, "ty": 7, "tz": 11}
    return r6(rel.withColumns({k: F.get("relative", F.lit(i)) for k, i in cell.items()}), "cloud_id", cols=list(cell))


@query("d20_relative_pose", "big", sql=f"""WITH p AS ({_POSE}), a AS (SELECT *, cloud_id%10 grp, first_value(c) OVER w c0, first_value(s) OVER w s0, first_value(t) OVER w t0 FROM p WINDOW w AS (PARTITION BY cloud_id%10 ORDER BY cloud_id))
SELECT cloud_id, {r_sql('c0*c+s0*s AS r00', 'c0*s-s0*c AS r10', 'c0*(t-t0) AS tx', '-s0*(t-t0) AS ty', '-(t-t0) AS tz')} FROM a""")  # fmt: skip
def d20(big):
    rel = p.relative_pose(_poses(big).withColumn("grp", F.col("cloud_id") % 10), "grp", "cloud_id")
    cell = {"r00": 0, "r10": 4, "tx": 3, "ty": 7, "tz": 11}
    return r6(rel.withColumns({k: F.get("relative", F.lit(i)) for k, i in cell.items()}), "cloud_id", cols=list(cell))


@query("d21_height", "big", sql="SELECT cloud_id, pt, round(z-min(z) OVER (PARTITION BY cloud_id)+1e-10,6)+0.0 AS height FROM big")
def d21(big):
    return r6(p.height(big), "cloud_id", "pt", cols=["height"])


@query("d22_colour", "pts", sql="SELECT cloud_id, pt, " + r_sql("least(greatest(y/255,0.0),1.0) AS a", "least(greatest((z/10+1)/2,0.0),1.0) AS b") + " FROM pts")
def d22(pts):
    return r6(pts.select("cloud_id", "pt", p.scale_colour(F.col("y")).alias("a"), p.scale_colour(F.col("z") / 10, True).alias("b")), "cloud_id", "pt", cols=["a", "b"])


_VOX = "CAST(floor(x/{0}) AS BIGINT) AS vx, CAST(floor(y/{0}) AS BIGINT) AS vy, CAST(floor(z/{0}) AS BIGINT) AS vz"


@query("e1_voxels", "big", sql=f"SELECT cloud_id, {_VOX.format('5.0::DOUBLE')}, count(*) AS n FROM big GROUP BY ALL")
def e1(big):
    return g.voxel_counts(big, 5.0)


@query("e2_consolidate", "big", sql=f"SELECT cloud_id, pt FROM (SELECT cloud_id, pt, conf, {_VOX.format('5.0::DOUBLE')} FROM big WHERE conf>=0.4) QUALIFY row_number() OVER (PARTITION BY cloud_id, vx, vy, vz ORDER BY conf DESC, pt)=1")
def e2(big):
    return g.consolidate(big, 5.0, 0.4).select("cloud_id", "pt")


@query("e3_passes", "pts", sql=f"""WITH v AS (SELECT cloud_id, pt, {_VOX.format('20.0::DOUBLE')} FROM pts), r AS (SELECT *, count(*) OVER w n, row_number() OVER (PARTITION BY cloud_id, vx, vy, vz ORDER BY pt)-1 r FROM v WINDOW w AS (PARTITION BY cloud_id, vx, vy, vz)),
m AS (SELECT *, max(n) OVER (PARTITION BY cloud_id) m FROM r), e AS (SELECT *, unnest(range(0,m)) AS i FROM m) SELECT cloud_id, CAST(i AS BIGINT) AS pass, pt FROM e WHERE i%n=r""")  # fmt: skip
def e3(pts):
    return g.voxel_passes(pts, 20.0)


_SEE = """WITH d AS (SELECT cloud_id, pt, x-25 dx, y-50 dy, z-5 dz, sqrt((x-25)*(x-25)+(y-50)*(y-50)+(z-5)*(z-5)) d FROM big), c AS (SELECT cloud_id, pt, d, CAST(floor(round(degrees(atan2(dy,dx)),9)/10) AS BIGINT) az, CAST(floor(round(degrees(asin(greatest(least(dz/d,1.0),-1.0))),9)/10) AS BIGINT) el FROM d WHERE d>0)
"""


@query("e4_visible_nearest", "big", sql=_SEE + "SELECT cloud_id, pt, az, el FROM c QUALIFY row_number() OVER (PARTITION BY cloud_id, az, el ORDER BY round(d,9), pt)=1")
def e4a(big):
    return g.visible(big, (25, 50, 5), 10.0).select("cloud_id", "pt", "az", "el")


@query("e4_visible_median", "big", sql=_SEE + ", m AS (SELECT *, median(d) OVER (PARTITION BY cloud_id, az, el) m FROM c) SELECT cloud_id, pt, az, el FROM m QUALIFY row_number() OVER (PARTITION BY cloud_id, az, el ORDER BY round(abs(d-m),9), pt)=1")
def e4b(big):
    return g.visible(big, (25, 50, 5), 10.0, "median").select("cloud_id", "pt", "az", "el")


@query("e4_visible_margin", "big", sql=_SEE + "SELECT cloud_id, pt, az, el FROM c QUALIFY d<=min(d) OVER (PARTITION BY cloud_id, az, el)+2.5")
def e4c(big):
    return g.visible(big, (25, 50, 5), 10.0, "margin", 2.5).select("cloud_id", "pt", "az", "el")


_NB = """nb AS (SELECT a.cloud_id, a.pt, a.x, a.y, a.z, b.pt n_pt, b.x nx, b.y ny, b.z nz, (a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)+(a.x-b.x)*(a.x-b.x) d2 FROM {0} a JOIN {0} b ON a.cloud_id=b.cloud_id AND a.pt<>b.pt
QUALIFY row_number() OVER (PARTITION BY a.cloud_id, a.pt ORDER BY round(d2,9), b.pt)<={1})"""
_ALL = "f AS (SELECT * FROM big)"


@query("e5_neighbours", "big", sql=f"WITH {_ALL}, {_NB.format('f', 8)} SELECT cloud_id, pt, n_pt, round(d2,6) AS d2 FROM nb")
def e5(big):
    return g.neighbours(big, 8, ids_only=True).select("cloud_id", "pt", "n_pt", F.round("d2", 6).alias("d2"))


again("e5_neighbours_all", "e5_neighbours")


@query("e6_curvature", "big", sql=f"""WITH {_ALL}, {_NB.format('f', 12)}, s AS (SELECT cloud_id, pt, avg(nx) mx, avg(ny) my, avg(nz) mz, avg(nx*nx)-avg(nx)*avg(nx) a, avg(ny*ny)-avg(ny)*avg(ny) b, avg(nz*nz)-avg(nz)*avg(nz) c, avg(nx*ny)-avg(nx)*avg(ny) d, avg(nx*nz)-avg(nx)*avg(nz) e, avg(ny*nz)-avg(ny)*avg(nz) f FROM nb GROUP BY 1,2),
q AS (SELECT *, (a+b+c)/3 q FROM s), pp AS (SELECT *, sqrt((power(a-q,2)+power(b-q,2)+power(c-q,2)+2*(d*d+e*e+f*f))/6) p FROM q),
rr AS (SELECT *, acos(greatest(least(((a-q)*((b-q)*(c-q)-f*f)-d*(d*(c-q)-f*e)+e*(d*f-(b-q)*e))/(2*p*p*p),1.0),-1.0))/3 phi FROM pp)
SELECT cloud_id, pt, round(greatest(CASE WHEN p<=1e-12 THEN q ELSE q+2*p*cos(phi+2.0943951023931953) END,0.0)/(a+b+c),4) AS curvature FROM rr""")  # fmt: skip
def e6(big):
    return g.point_scores(big, 12, ("curvature",)).select("cloud_id", "pt", F.round("curvature", 4).alias("curvature"))


again("e6_curvature_all", "e6_curvature")


@query("e6_normals", "big")
def e6n(big):
    normal = ("normal_x", "normal_y", "normal_z")
    return r6(g.point_scores(big, 12, normal), "cloud_id", "pt", cols=normal)


@query("e7_distance_cv", "pts", sql=f"WITH {_NB.format('pts', 3)} SELECT cloud_id, pt, round(stddev_pop(sqrt(d2))/avg(sqrt(d2))+1e-10,6) AS cv FROM nb GROUP BY 1,2")
def e7(pts):
    return r6(g.point_scores(pts, 3, ("cv",)), "cloud_id", "pt", cols=["cv"])


@query("e8_normal_difference", "big")
def e8(big):
    return g.point_scores(big, 12, ("angle",)).select("cloud_id", "pt", F.round("angle", 4).alias("angle"))


@query("e9_threshold_transfer", "big", sql="""WITH r AS (SELECT avg(CASE WHEN conf>=0.6 THEN 1.0::DOUBLE ELSE 0 END) r, list_sort(list(x)) l, count(*) n FROM big), q AS (SELECT r, l, (1-r)*(n-1) q FROM r)
SELECT round(r,6) AS ratio, round(l[CAST(floor(q) AS BIGINT)+1]+(q-floor(q))*(l[CAST(ceil(q) AS BIGINT)+1]-l[CAST(floor(q) AS BIGINT)+1]),6) AS threshold FROM q""")  # fmt: skip
def e9(big):
    return g.transfer_threshold(big, "conf", 0.6, "x")


@query("e10_sweep", "big", sql="SELECT t AS threshold, round(avg(CASE WHEN x>=t THEN 1.0::DOUBLE ELSE 0 END),6) AS share FROM big, (SELECT unnest([10.0,20.0,30.0,40.0]::DOUBLE[]) t) GROUP BY 1")
def e10(big):
    return g.sweep(big, "x", [10.0, 20.0, 30.0, 40.0])


@query("e10_quantiles", "big", sql="SELECT round(quantile_cont(y,0.1),6) AS p10, round(quantile_cont(y,0.5),6) AS p50, round(quantile_cont(y,0.9),6) AS p90, round(quantile_cont(y,0.99),6) AS p99 FROM big")
def e10q(big):
    return g.quantiles(big, "y", [0.1, 0.5, 0.9, 0.99])


@query("e11_jaccard", "big", sql="SELECT cloud_id, view_id, round(CASE WHEN sum(CASE WHEN x>25 OR y>50 THEN 1 ELSE 0 END)=0 THEN 1.0 ELSE sum(CASE WHEN x>25 AND y>50 THEN 1 ELSE 0 END)/sum(CASE WHEN x>25 OR y>50 THEN 1 ELSE 0 END) END,6) AS jaccard FROM big GROUP BY 1,2")
def e11(big):
    return g.jaccard(big, F.col("x") > 25, F.col("y") > 50, ["cloud_id", "view_id"]).withColumn("jaccard", F.round("jaccard", 6))


def _moved(c: str) -> str:
    return f"{c}+greatest(least({_gauss(c, seed='rep')},0.05),-0.05)"


_VIEWS = """v AS (SELECT cloud_id||'/'||view_id vw, cloud_id, view_id, pt, x, y, z FROM big)"""
_CV = """{0} AS (SELECT vw, rep, pt, round(stddev_pop(sqrt(d))/avg(sqrt(d)),9)>=0.5 AS flag FROM (SELECT a.vw, a.rep, a.pt, (a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)+(a.x-b.x)*(a.x-b.x) d
FROM {1} a JOIN {1} b ON a.vw=b.vw AND a.rep=b.rep AND a.pt<>b.pt QUALIFY row_number() OVER (PARTITION BY a.vw, a.rep, a.pt ORDER BY round(d,9), b.pt)<=6) GROUP BY 1,2,3)"""


@query("e11_stability", "big", sql=f"""WITH {_VIEWS}, m0 AS (SELECT *, 0 AS rep FROM v), m1 AS (SELECT vw, rep, pt, {', '.join(f'{_moved(c)} AS {c}' for c in XYZ)} FROM v, (SELECT unnest([1,2]) AS rep)),
{_CV.format('f0', 'm0')}, {_CV.format('f1', 'm1')},
j AS (SELECT vw, f1.rep, CASE WHEN sum((f0.flag OR f1.flag)::INT)=0 THEN 1.0 ELSE sum((f0.flag AND f1.flag)::INT)/sum((f0.flag OR f1.flag)::INT) END AS j FROM f0 JOIN f1 USING (vw, pt) GROUP BY 1,2)
SELECT cloud_id, view_id, 'cv' AS label, round(avg(j)+1e-10,6) AS jaccard FROM j JOIN (SELECT DISTINCT vw, cloud_id, view_id FROM v) USING (vw) GROUP BY 1,2""")  # fmt: skip
def e11s(big):
    """How far the label of the neighbour distances' variation outlives two repeats of noise, in every view of every cloud."""
    return r6(g.jitter_stability(big, 6, {"cv": 0.5}, 2, 0.02, 0.05), "cloud_id", "view_id", "label", cols=["jaccard"])


@query("e11_stability_shape", "pts")
def e11p(pts):
    """The same for curvature and normal difference, of whole clouds; held against brute force in the tests."""
    views = pts.withColumn("view_id", F.lit(0))
    return r6(g.jitter_stability(views, 4, {"curvature": 0.02, "angle": 20.0}, 2, 0.5, 1.0), "cloud_id", "label", cols=["jaccard"])


@query("e11_methods", "pts")
def e11m(pts):
    """How far labels of two scores agree in each cloud; held against brute force in the tests."""
    thresholds = {"curvature": 0.02, "cv": 0.5, "angle": 20.0}
    return r6(g.score_agreement(g.point_scores(pts, 4, tuple(thresholds)), thresholds), "cloud_id", "a", "b", cols=["jaccard"])


_SUM = "round(avg({0}),6) AS mean, round(quantile_cont({0},0.5),6) AS median, round(quantile_cont({0},0.1),6) AS p10, round(quantile_cont({0},0.9),6) AS p90 FROM cat"


@query("e12_score_summary", "cat", sql=" UNION ALL ".join(f"SELECT '{m}' AS metric, {c} AS class_name, {_SUM.format(m + '::DOUBLE')} {w}" for m in ("confidence", "point_count") for c, w in (("class_name", "GROUP BY class_name"), ("'overall'", ""))))
def e12(cat):
    return g.score_summary(cat.withColumn("point_count", F.col("point_count").cast("double")), ["confidence", "point_count"])


def _two(big, v):
    return big.filter(F.col("view_id") == v)


@query("e13_chamfer", "big", sql="""WITH d AS (SELECT a.cloud_id c, a.pt, a.view_id v, min((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) d FROM big a JOIN big b ON a.cloud_id=b.cloud_id AND a.view_id+b.view_id=3 AND a.view_id IN (1,2) GROUP BY 1,2,3)
SELECT c AS pair_id, round(avg(sqrt(d)) FILTER (v=1)+avg(sqrt(d)) FILTER (v=2)+1e-10,6) AS chamfer FROM d GROUP BY 1""")  # fmt: skip
def e13(big):
    pairs = big.selectExpr("cloud_id AS pair_id", "cloud_id AS a_id", "cloud_id AS b_id").distinct()
    return r6(g.chamfer(pairs, _two(big, 1), _two(big, 2)), "pair_id", cols=["chamfer"])


_RES = """d{0} AS (SELECT a.cloud_id, least(a.view_id,b.view_id)||'-'||greatest(a.view_id,b.view_id) AS pair, a.view_id v, a.pt, min((a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)+(a.x-b.x)*(a.x-b.x)) d FROM f a JOIN f b ON a.cloud_id=b.cloud_id AND a.view_id<>b.view_id GROUP BY a.cloud_id, 2, a.view_id, b.view_id, a.pt),
r{0} AS (SELECT cloud_id, pair, count(*) n, count(*) FILTER ({1}) AS inliers, sqrt(sum(d) FILTER ({1})/count(*) FILTER ({1})) AS rmse FROM d{0} GROUP BY 1,2)"""


@query("e14_residual", "big", sql=f"WITH {_ALL}, {_RES.format(1, 'd<=100')} SELECT cloud_id, pair, n, inliers, round(rmse+1e-10,6) AS rmse, round(inliers/n+1e-10,6) AS inlier_ratio FROM r1")
def e14(big):
    return r6(g.registration_residual(big, 10.0), "cloud_id", "pair", "n", "inliers", cols=["rmse", "inlier_ratio"])


again("e14_residual_all", "e14_residual")


@query("e15_gain", "big", sql=f"WITH {_ALL}, {_RES.format(1, 'true')}, {_RES.format(2, 'd<=100')} SELECT cloud_id, pair, round(r1.rmse+1e-10,6) AS pre, round(r2.rmse+1e-10,6) AS post, round(r1.rmse-r2.rmse+1e-10,6) AS gain, round(100*(r1.rmse-r2.rmse)/r1.rmse+1e-10,6) AS percent FROM r1 JOIN r2 USING (cloud_id, pair)")
def e15(big):
    return r6(g.residual_gain(*g.registration_residuals(big, [0.0, 10.0])), "cloud_id", "pair", cols=["pre", "post", "gain", "percent"])


again("e15_gain_all", "e15_gain")


_AX = """th AS (SELECT cloud_id, count(*) n, atan2(2*covar_samp(x,y), var_samp(x)-var_samp(y))/2 t FROM big GROUP BY 1), ax AS (SELECT cloud_id, CASE WHEN n<3 THEN 1.0 WHEN sin(t)<0 THEN -cos(t) ELSE cos(t) END ax, CASE WHEN n<3 THEN 0.0 ELSE abs(sin(t)) END ay FROM th),
pr AS (SELECT cloud_id, ax, ay, z, x*ax+y*ay u, y*ax-x*ay v FROM big JOIN ax USING (cloud_id))"""
_LINE = "SELECT cloud_id, " + r_sql("ax AS ax", "ay AS ay", "quantile_cont(u,0.01) AS u_min", "quantile_cont(u,0.99) AS u_max", "(quantile_cont(v,0.01)+quantile_cont(v,0.99))/2 AS v_mid", "quantile_cont(u,0.99)-quantile_cont(u,0.01) AS length", "quantile_cont(v,0.99)-quantile_cont(v,0.01) AS width", "min(z) AS ground") + " FROM {} GROUP BY cloud_id, ax, ay"
_LCOLS = ["ax", "ay", "u_min", "u_max", "v_mid", "length", "width", "ground"]


@query("e16_axis", "big", sql=f"WITH {_AX} SELECT cloud_id, {r_sql('ax AS ax', 'ay AS ay')} FROM ax")
def e16(big):
    return r6(g.principal_axis(big), "cloud_id", cols=["ax", "ay"])


@query("e17_centreline", "big", sql=f"WITH {_AX} " + _LINE.format("pr"))
def e17(big):
    return r6(g.centreline(big), "cloud_id", cols=_LCOLS)


_SLOPE = """q AS (SELECT cloud_id, quantile_cont(u,0.05) lo, quantile_cont(u,0.95) hi FROM pr GROUP BY 1), k AS (SELECT pr.cloud_id, u, v FROM pr JOIN q USING (cloud_id) WHERE u BETWEEN lo AND hi), m AS (SELECT cloud_id, median(u) mu, median(v) mv FROM k GROUP BY 1),
sl AS (SELECT cloud_id, CASE WHEN count(*)>=20 THEN sum((u-mu)*(v-mv))/sum((u-mu)*(u-mu)) END slope FROM k JOIN m USING (cloud_id) GROUP BY 1)"""


@query("e18_slope", "big", sql=f"WITH {_AX}, {_SLOPE} SELECT cloud_id, round(slope+1e-10,6)+0.0 AS slope FROM sl")
def e18(big):
    return r6(g.centreline_slope(big), "cloud_id", cols=["slope"])


@query("e18_straighten", "big", sql=f"WITH {_AX}, {_SLOPE}, tn AS (SELECT cloud_id, ax*cos(atan(coalesce(slope,0)))-ay*sin(atan(coalesce(slope,0))) ax, ay*cos(atan(coalesce(slope,0)))+ax*sin(atan(coalesce(slope,0))) ay FROM ax JOIN sl USING (cloud_id)), p2 AS (SELECT cloud_id, ax, ay, z, x*ax+y*ay u, y*ax-x*ay v FROM big JOIN tn USING (cloud_id)) " + _LINE.format("p2"))
def e18s(big):
    return r6(g.straighten(big), "cloud_id", cols=_LCOLS)


@query("e19_best_yaw", "big", sql=f"""WITH {_AX}, y AS (SELECT unnest([-4.0,-2.0,0.0,2.0,4.0]::DOUBLE[]) yaw), p2 AS (SELECT big.cloud_id, yaw, y*cos(atan2(ay,ax)+radians(yaw))-x*sin(atan2(ay,ax)+radians(yaw)) v FROM big JOIN ax USING (cloud_id), y), w AS (SELECT cloud_id, yaw, round(quantile_cont(v,0.99)-quantile_cont(v,0.01),6) w FROM p2 GROUP BY 1,2)
SELECT cloud_id, arg_min(yaw, struct_pack(a:=w,b:=yaw)) AS yaw, min(w) AS width FROM w GROUP BY 1""")  # fmt: skip
def e19(big):
    return g.best_yaw(big, [-4.0, -2.0, 0.0, 2.0, 4.0])


@query("e20_rigid_fit", "big")
def e20(big):
    fit = g.rigid_fit(big, p.rotate_z(big, 20.0))
    return fit.select("cloud_id", F.transform("rotation", lambda x: F.round(x, 5)).alias("rotation"), F.transform("translation", lambda x: F.round(x, 4)).alias("translation"), F.round("rmse", 4).alias("rmse"))


@query("e21_histogram", "pred", sql="SELECT CAST(greatest(least(floor(confidence*20),19),0) AS BIGINT) AS bin, count(*) AS n FROM pred GROUP BY 1")
def e21(pred):
    return g.confidence_histogram(pred)


@query("e21_summary", "pred", sql="SELECT round(avg(confidence),6) AS mean, round(median(confidence),6) AS median, count(*) FILTER (confidence<0.3) AS rejected FROM pred")
def e21s(pred):
    return g.confidence_summary(pred, 0.3)
