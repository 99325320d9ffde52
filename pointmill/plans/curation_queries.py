"""Queries of matching, curation, audit, fusion, metrics and the feed (F, G, H, I, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointmill.operators import audit, closest, curate, fuse, match, metrics
from pointmill.plans.base import again, query
from pointmill.plans.catalog_queries import _C4, _M1, _ZA, split_sql
from pointmill.plans.point_queries import _AX, _B, r6, r_sql

R = (0.7, 0.2, 0.1)
LIMIT = 7_200_000_000  # two hours in microseconds


def _sides(log):
    t = log.withColumn("us", F.expr("CASE WHEN event_id%17=0 THEN NULL ELSE us END"))
    a = t.filter("event_type='error'").select("split", "run", "user_id", "event_id", "us", "value")
    return a, t.filter("event_type IN ('view','click')").select("split", "run", "user_id", "event_id", "us", "value")


_SIDES = """t AS (SELECT * REPLACE (CASE WHEN event_id%17=0 THEN NULL ELSE us END AS us) FROM log), a AS (SELECT * FROM t WHERE event_type='error'), b AS (SELECT * FROM t WHERE event_type IN ('view','click')),
p AS (SELECT a.event_id a_event_id, b.event_id b_event_id, a.us a_us, b.us b_us, a.value a_value, b.value b_value, a.split a_split, a.run a_run FROM a JOIN b ON a.split=b.split AND a.run=b.run AND a.user_id<>b.user_id AND (a.us IS NULL OR b.us IS NULL OR abs(a.us-b.us)<=7200000000))"""


@query("f1_distances", "log", sql="""SELECT event_id, CAST(CASE WHEN event_id%3>0 AND event_id%5>0 THEN abs(epoch-user_id) WHEN event_id%7>0 THEN greatest(0, greatest(user_id-(epoch+5), epoch-(user_id+3))) END AS BIGINT) AS frames, round(abs(us-1700000000000000)*1000/1e9,3) AS seconds FROM log""")
def f1(log):
    c = lambda e: F.expr(e)
    frames = match.gap_distance(c("CASE WHEN event_id%3>0 THEN epoch END"), c("CASE WHEN event_id%5>0 THEN user_id END"), (c("epoch"), c("CASE WHEN event_id%7>0 THEN epoch+5 END")), (c("user_id"), c("user_id+3")))
    return log.select("event_id", frames.cast("bigint").alias("frames"), F.round(match.seconds_between(F.col("us") * 1000, F.lit(1700000000000000000)), 3).alias("seconds"))


_BOX = f"""{_B}, p AS (SELECT a.cloud_id a_id, b.cloud_id b_id, greatest(0.0,b.nx-a.mx,a.nx-b.mx) gx, greatest(0.0,b.ny-a.my,a.ny-b.my) gy, greatest(0.0,b.nz-a.mz,a.nz-b.mz) gz,
sqrt(power(a.ax-b.ax,2)+power(a.ay-b.ay,2)) ce FROM b a JOIN b ON b.cloud_id=a.cloud_id+1)"""


@query("f2_box_gap", "big", sql=f"WITH {_BOX} SELECT a_id, b_id, {r_sql('sqrt(gx*gx+gy*gy) AS gap_xy', 'gz AS gap_z', 'ce AS centre', 'sqrt(gx*gx+gy*gy)+0.15*ce+0.5*gz AS score')} FROM p")
def f2(big):
    ids = big.select("cloud_id").distinct()
    pairs = ids.select(F.col("cloud_id").alias("a_id"), (F.col("cloud_id") + 1).alias("b_id"))
    return r6(match.box_gap_score(pairs, big), "a_id", "b_id", cols=["gap_xy", "gap_z", "centre", "score"])


@query("f3_best_match", "log", sql=f"""WITH {_SIDES} SELECT a_event_id, b_event_id, round(abs(a_value-b_value),6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY a_event_id ORDER BY round(abs(a_value-b_value),6), b_event_id)=1""")
def f3(log):
    a, b = _sides(log)
    a, b = (df.filter("user_id IS NOT NULL").withColumnRenamed("event_id", "id") for df in (a, b))
    found = closest.closest_in_time(a, b, ["split", "run"], LIMIT, "value", 1.0, closest.value_gap(6), differ="user_id")
    return found.select(F.col("a_id").alias("a_event_id"), F.col("b_id").alias("b_event_id"), F.round("score", 6).alias("score"))


_F3B = """sd AS (SELECT ord AS cloud_id, object_id, CASE WHEN ord%9=0 THEN NULL ELSE confidence END AS confidence, CASE WHEN ord%40=0 THEN NULL ELSE epoch_us(day) END AS us, prio, class_name, CASE WHEN ord%5>0 THEN ord%97 END AS frame FROM cat)"""


@query("f3_boxes", "cat", "pts", sql=f"""WITH {_F3B}, bx AS (SELECT cloud_id, min(x) nx, max(x) mx, avg(x) ax, min(y) ny, max(y) my, avg(y) ay, min(z) nz, max(z) mz FROM pts GROUP BY 1),
c AS (SELECT a.cloud_id a_cloud_id, b.cloud_id b_cloud_id FROM sd a JOIN sd b ON a.prio=b.prio AND a.class_name='AUTOMOBILE' AND b.class_name='MACHINERY' AND a.object_id<>b.object_id AND (a.us IS NULL OR b.us IS NULL OR abs(a.us-b.us)<=432000000000)
  AND coalesce(b.confidence>=0.2,true) AND coalesce(abs(a.frame-b.frame)<=50,true)),
g AS (SELECT c.*, sqrt(power(greatest(0.0,b.nx-a.mx,a.nx-b.mx),2)+power(greatest(0.0,b.ny-a.my,a.ny-b.my),2)) gxy, greatest(0.0,b.nz-a.mz,a.nz-b.mz) gz, sqrt(power(a.ax-b.ax,2)+power(a.ay-b.ay,2)) ce FROM c JOIN bx a ON a.cloud_id=a_cloud_id JOIN bx b ON b.cloud_id=b_cloud_id)
SELECT a_cloud_id, b_cloud_id, {r_sql('gxy+0.15*ce+0.5*gz AS score')} FROM g WHERE gxy<=20 AND ce<=40 QUALIFY row_number() OVER (PARTITION BY a_cloud_id ORDER BY gxy+0.15*ce+0.5*gz, b_cloud_id)=1""")  # fmt: skip
def f3b(cat, pts):
    """Box-gap matching with limits on confidence, time, frames, gap and centres; unknown ones pass."""
    t = cat.selectExpr("ord AS cloud_id", "object_id", "CASE WHEN ord%9=0 THEN NULL ELSE confidence END AS confidence", "CASE WHEN ord%40=0 THEN NULL ELSE unix_micros(cast(day AS timestamp)) END AS us", "prio", "class_name", "CASE WHEN ord%5>0 THEN ord%97 END AS frame")
    a, b = t.filter("class_name='AUTOMOBILE'"), t.filter("class_name='MACHINERY'")
    limits = {"b_confidence": 0.2, "frames": 50, "gap_xy": 20.0, "centre": 40.0}
    found = match.closest_boxes(a, b, pts, ["prio"], 432_000_000_000, limits, "frame")
    return r6(found, "a_cloud_id", "b_cloud_id", cols=["score"])


_H = "('0x'||substr(md5({}),1,8))::BIGINT"
_HM = f"""a AS (SELECT bucket, stem FROM cat WHERE source='curated'), b AS (SELECT bucket, stem, row_number() OVER (PARTITION BY bucket ORDER BY md5('9::'||stem), stem)-1 i FROM cat WHERE prio<'4'), n AS (SELECT bucket, count(*) n FROM b GROUP BY 1)"""


def _two(cat):
    return cat.filter("source='curated'").select("bucket", F.col("stem").alias("a_stem")), cat.filter("prio<'4'").select("bucket", F.col("stem").alias("b_stem"))


@query("f4_hash_match", "cat", sql=f"WITH {_HM} SELECT a.stem AS a_stem, b.stem AS b_stem FROM a JOIN n USING (bucket) JOIN b ON b.bucket=a.bucket AND b.i={_H.format(chr(39) + '9::' + chr(39) + '||a.stem')}%n")
def f4(cat):
    a, b = _two(cat)
    return match.hash_match(a, b, ["bucket"], "a_stem", "b_stem", 9).select("a_stem", "b_stem")


@query("f5_draws", "cat", sql=f"""WITH {_HM}, ar AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('9::'||stem), stem)-1 i FROM a), an AS (SELECT bucket, count(*) n, unnest(range(40)) AS draw FROM a GROUP BY 1),
d AS (SELECT an.bucket, draw, stem FROM an JOIN ar ON ar.bucket=an.bucket AND ar.i={_H.format("'9::'||an.bucket||'::'||draw")}%n)
SELECT CAST(draw AS INT) AS draw, d.stem AS a_stem, b.stem AS b_stem FROM d JOIN n USING (bucket) JOIN b ON b.bucket=d.bucket AND b.i={_H.format("'9::'||d.stem||'::'||draw")}%n""")  # fmt: skip
def f5(cat):
    a, b = _two(cat)
    return match.draw_pairs(a, b, ["bucket"], "a_stem", "b_stem", 40, 9).select("draw", "a_stem", "b_stem")


@query("f6_unmatched", "log", sql=f"WITH {_SIDES.replace('p AS (', 'p0 AS (')}, p AS (SELECT * FROM p0 WHERE a_us IS NOT NULL AND b_us IS NOT NULL) SELECT event_id AS a_event_id, 'no_candidate' AS reason FROM a WHERE event_id NOT IN (SELECT a_event_id FROM p)")
def f6(log):
    a, b = _sides(log)
    pairs = match.candidates_in_time(a, b, ["split", "run"], LIMIT).filter("a_user_id <> b_user_id AND a_us IS NOT NULL AND b_us IS NOT NULL")
    return match.unmatched(a.select(F.col("event_id").alias("a_event_id")), pairs, "a_event_id")


@query("f7_align", "big", sql=f"""WITH {_AX}, ln AS (SELECT cloud_id, ax, ay, quantile_cont(u,0.01) rear, (quantile_cont(v,0.01)+quantile_cont(v,0.99))/2 mid, min(z) vg FROM pr GROUP BY 1,2,3),
pp AS (SELECT a.cloud_id a_id, b.cloud_id b_id, b.ax vax, b.ay vay, b.rear, b.mid, b.vg, atan2(b.ay,b.ax)-atan2(a.ay,a.ax) d FROM ln a JOIN ln b ON b.cloud_id=a.cloud_id+1),
o AS (SELECT a_id, b_id, pt, vax, vay, rear, mid, vg, x*cos(d)-y*sin(d) x, x*sin(d)+y*cos(d) y, z FROM pp JOIN big ON cloud_id=a_id),
f AS (SELECT a_id, any_value(vax) vax, any_value(vay) vay, any_value(rear)-0.5-quantile_cont(x*vax+y*vay,0.99) du, any_value(mid)-(quantile_cont(y*vax-x*vay,0.01)+quantile_cont(y*vax-x*vay,0.99))/2 dv, any_value(vg)-min(z) dz FROM o GROUP BY 1)
SELECT a_id AS pair_id, a_id AS source_id, pt, {r_sql('x+du*f.vax-dv*f.vay AS x', 'y+du*f.vay+dv*f.vax AS y', 'z+dz AS z')} FROM o JOIN f USING (a_id)
UNION ALL SELECT a_id, b_id, pt, {r_sql('x AS x', 'y AS y', 'z AS z')} FROM pp JOIN big ON cloud_id=b_id""")  # fmt: skip
def f7(big):
    """Every cloud behind the one of the next id."""
    pairs = big.select("cloud_id").distinct().selectExpr("cloud_id AS pair_id", "cloud_id AS a_id", "cloud_id+1 AS b_id")
    return r6(match.align_pairs(pairs, big, 0.5), "pair_id", "source_id", "pt")


again("f7_align_all", "f7_align")


@query("f7_report", "big", sql=f"""WITH {_AX}, ln AS (SELECT cloud_id, ax, ay, quantile_cont(u,0.01) rear, (quantile_cont(v,0.01)+quantile_cont(v,0.99))/2 mid, min(z) vg FROM pr GROUP BY 1,2,3),
pp AS (SELECT a.cloud_id a_id, b.cloud_id b_id, b.ax vax, b.ay vay, b.rear, b.mid, b.vg, atan2(b.ay,b.ax)-atan2(a.ay,a.ax)+pi() d FROM ln a JOIN ln b ON b.cloud_id=a.cloud_id+1),
o AS (SELECT a_id, b_id, d, vax, vay, rear, mid, vg, x*cos(d)-y*sin(d) x, x*sin(d)+y*cos(d) y, z FROM pp JOIN big ON cloud_id=a_id)
SELECT a_id AS pair_id, b_id, {r_sql('degrees(atan2(sin(any_value(d)),cos(any_value(d)))) AS turn', 'any_value(rear)-0.5-quantile_cont(x*vax+y*vay,0.99) AS along', 'any_value(mid)-(quantile_cont(y*vax-x*vay,0.01)+quantile_cont(y*vax-x*vay,0.99))/2 AS across', 'any_value(vg)-min(z) AS up')},
round(degrees(acos(least(1.0,abs(cos(atan2(2*covar_samp(x,y),var_samp(x)-var_samp(y))/2)*any_value(vax)+sin(atan2(2*covar_samp(x,y),var_samp(x)-var_samp(y))/2)*any_value(vay))))),3)+0.0 AS angle_error FROM o GROUP BY a_id, b_id""")  # fmt: skip
def f7r(big):
    """Every cloud turned round behind the next one."""
    pairs = big.select("cloud_id").distinct().selectExpr("cloud_id AS pair_id", "cloud_id AS a_id", "cloud_id+1 AS b_id")
    found = match.alignment_report(pairs, big, 0.5, flipped=True).withColumn("angle_error", F.round("angle_error", 3) + F.lit(0.0))
    return r6(found, "pair_id", "b_id", "angle_error", cols=["turn", "along", "across", "up"])


@query("f8_merged_class", "cat", sql="SELECT ord, CASE WHEN ord%3=0 THEN 'truck_with_trailer' ELSE 'car_with_trailer' END AS merged FROM cat")
def f8(cat):
    return cat.select("ord", match.merged_class(F.expr("CASE WHEN ord%3=0 THEN 'Box Truck' ELSE class_name END")).alias("merged"))


_GT = "CASE page_id%3 WHEN 0 THEN path WHEN 1 THEN replace(path,'gt-pred-diff','pred_v1') ELSE replace(path,'gt-pred-diff','misc') END"


@query("f9_ground_truth_score", "paths", sql="SELECT page_id, CAST(CASE page_id%3 WHEN 0 THEN 120 WHEN 1 THEN -100 ELSE 0 END+CASE WHEN page_id%4=0 THEN 80 ELSE 0 END+CASE WHEN page_id%5=0 THEN 100 ELSE 0 END+CASE WHEN page_id%2=0 THEN 10 ELSE 0 END AS BIGINT) AS score FROM paths")
def f9(paths):
    t = paths.selectExpr("page_id", f"{_GT} AS path")
    return t.select("page_id", match.ground_truth_score(F.col("path"), F.expr("CASE WHEN page_id%4=0 THEN path END"), F.expr("CASE WHEN page_id%5=0 THEN 'ground_truth' END"), F.expr("page_id%2=0")).alias("score"))


_F10 = """s AS (SELECT stem, 'run_'||(ord%20) run_id, object_id, class_name FROM cat WHERE source='review'), t AS (SELECT stem, 'run_'||(ord%20) run_id, object_id, CASE WHEN ord%5=0 THEN 'BUILDING' ELSE class_name END AS class_name, 'gt/'||stem||'.pcd' AS path, CASE WHEN ord%5=0 THEN 120 ELSE ord%2*10 END AS score FROM cat WHERE source='curated' OR prio<'3'),
c1 AS (SELECT s.stem ss, s.class_name sc, t.* FROM s JOIN t ON t.stem=s.stem), c2 AS (SELECT s.stem ss, s.class_name sc, t.* FROM s JOIN t ON t.run_id=s.run_id AND t.object_id=s.object_id WHERE s.stem NOT IN (SELECT ss FROM c1)),
c3 AS (SELECT s.stem ss, s.class_name sc, t.* FROM s JOIN t ON t.object_id=s.object_id AND t.class_name=s.class_name WHERE s.stem NOT IN (SELECT ss FROM c1 UNION ALL SELECT ss FROM c2) QUALIFY count(*) OVER (PARTITION BY s.stem)=1),
m AS (SELECT 1 tier, * FROM c1 UNION ALL SELECT 2, * FROM c2 UNION ALL SELECT 3, * FROM c3), k AS (SELECT *, bool_or(class_name=sc) OVER (PARTITION BY ss) own FROM m), f AS (SELECT * FROM k WHERE NOT own OR class_name=sc),
b AS (SELECT ss, any_value(tier) tier, max(score) score, arg_max(path, struct_pack(a:=score, b:=path)) path FROM f GROUP BY 1), z AS (SELECT b.*, (SELECT count(*) FROM f WHERE f.ss=b.ss AND f.score=b.score)>1 AS ambiguous FROM b),
res AS (SELECT s.stem, s.class_name, z.path, CAST(z.tier AS BIGINT) AS tier, z.ambiguous FROM s LEFT JOIN z ON z.ss=s.stem)"""


def _truth(cat):
    """Reviewed samples, curated and urgent clouds as candidates. A fifth of the candidates is of another class with a better score: only samples without one of their own class take them."""
    c = cat.withColumn("run_id", F.expr("concat('run_', ord%20)"))
    truth = c.filter("source='curated' OR prio<'3'").withColumn("path", F.expr("concat('gt/',stem,'.pcd')")).withColumn("class_name", F.expr("CASE WHEN ord%5=0 THEN 'BUILDING' ELSE class_name END"))
    return match.resolve_ground_truth(c.filter("source='review'"), truth.withColumn("score", F.expr("CASE WHEN ord%5=0 THEN 120 ELSE ord%2*10 END")))


@query("f10_ground_truth", "cat", sql=f"WITH {_F10} SELECT * FROM res")
def f10(cat):
    return _truth(cat)


@query("f10_report", "cat", sql=f"WITH {_F10} SELECT class_name, count(*) FILTER (path IS NULL) AS missing, count(*) FILTER (ambiguous) AS ambiguous FROM res GROUP BY 1")
def f10r(cat):
    return match.ground_truth_report(_truth(cat))


@query("f11_tracks", "frm", sql="WITH g AS (SELECT group_key, object_id AS track, max(frame_id) f FROM frm WHERE class_name IN ('view','click') GROUP BY ALL), l AS (SELECT track, arg_max(group_key, f) AS group_key FROM g GROUP BY 1) SELECT s.class_name, track, group_key FROM (SELECT DISTINCT class_name, object_id AS track FROM frm) s JOIN l USING (track)")
def f11(frm):
    """Every (class, object) as an aggregate, the groups of two classes as raw ones."""
    groups = frm.filter("class_name IN ('view','click')").groupBy("group_key", F.col("object_id").alias("track")).agg(F.max("frame_id").alias("f"))
    samples = frm.select("class_name", F.col("object_id").alias("track")).distinct()
    return match.match_tracks(samples, groups, "track", "f").select("class_name", "track", "group_key")


RULES = """{"target_column": "predicted_class", "source_column": "class_name", "rules": {"AUTOMOBILE": ["AUTOMOBILE", "MACHINERY"], "BUILDING": {"disallow_sources": "AUTOMOBILE"},
 "FURNITURE": {"sources": ["*"], "must_equal": ["class_name", "folder_class"], "mode": "OR"}, "HOUSEHOLD": {"allowed_sources": "HOUSEHOLD", "require_equal": "folder_class", "match_mode": "and"},
 "MACHINERY": {"allow_sources": null}, "*": []}}"""
_PASS = """(predicted_class='AUTOMOBILE' AND current_class IN ('AUTOMOBILE','MACHINERY') OR predicted_class='BUILDING' AND current_class<>'AUTOMOBILE' OR predicted_class='FURNITURE' AND (current_class=predicted_class OR folder_class=predicted_class)
 OR predicted_class='HOUSEHOLD' AND current_class='HOUSEHOLD' AND folder_class='HOUSEHOLD')"""


def rules_of(df):
    return curate.rule_table(df.sparkSession.createDataFrame([(RULES,)], "text string"))


@query("g1_rule_table", "pred", sql="""SELECT * FROM (VALUES ('AUTOMOBILE','AUTOMOBILE,MACHINERY','','','and','current_class'), ('BUILDING','*','AUTOMOBILE','','and','current_class'), ('FURNITURE','*','','current_class,folder_class','or','current_class'),
 ('HOUSEHOLD','HOUSEHOLD','','folder_class','and','current_class'), ('MACHINERY','','','','and','current_class')) t(target, allow, deny, require_equal, mode, source) WHERE target IN (SELECT DISTINCT predicted_class FROM pred)""")
def g1(pred):
    """The rules of the classes that the table predicts."""
    texts = pred.sparkSession.createDataFrame([(RULES,)], "text string")
    rules = curate.rule_table(texts).withColumn("source", F.lit(curate.rule_columns(texts)["source"])).join(pred.select(F.col("predicted_class").alias("target")).distinct(), "target")
    return rules.select("target", *(F.array_join(c, ",").alias(c) for c in ("allow", "deny", "require_equal")), "mode", "source")


@query("g2_rule_filter", "pred", sql=f"SELECT ord FROM pred WHERE {_PASS}")
def g2(pred):
    return curate.apply_rules(pred, rules_of(pred)).select("ord")


@query("g3_selection", "pred", sql=f"SELECT ord FROM pred WHERE bucket='gt-pred-diff' AND is_match=1 AND confidence>=0.2 AND {_PASS} ORDER BY ord LIMIT 500")
def g3(pred):
    return curate.select_rows(pred, rules_of(pred), ["gt-pred-diff"], "matches", 0.2, 500).select("ord")


@query("g4_folder_class", "paths", sql="SELECT page_id, CASE WHEN page_id%2=0 THEN split_part(path,'/',3) ELSE 'gt-pred-diff' END AS folder_class FROM paths")
def g4(paths):
    return paths.select("page_id", curate.folder_class(F.expr("CASE WHEN page_id%2=0 THEN path ELSE regexp_replace(path,'/[a-z]+/pcds','') END")).alias("folder_class"))


_BUILD = f"""f AS (SELECT * FROM pred WHERE confidence>=0.1 AND {_PASS} QUALIFY row_number() OVER (PARTITION BY predicted_class ORDER BY md5('11::'||stem), stem)<=1000)"""
_G5 = split_sql(_ZA, "f", "predicted_class, object_id", "predicted_class", "predicted_class||'::'||object_id")[4:]


def _built(pred):
    return curate.curated_build(pred, rules_of(pred), 1000, R, 11, 0.1)


@query("g5_curated_build", "pred", sql=f"WITH {_BUILD}, {_G5} SELECT ord, predicted_class AS dataset_class, split, object_id||CASE WHEN r2>1 THEN '__dup'||(r2-1) ELSE '' END AS output_name FROM (SELECT f.ord, f.predicted_class, f.object_id, s.split, row_number() OVER (PARTITION BY s.split, f.predicted_class, f.object_id ORDER BY f.stem) r2 FROM f JOIN s USING (predicted_class, object_id))")
def g5(pred):
    return _built(pred).select("ord", "dataset_class", "split", "output_name")


@query("curate_counts", "pred", sql=f"WITH {_BUILD}, {_G5} SELECT split, predicted_class AS dataset_class, count(*) AS n FROM f JOIN s USING (predicted_class, object_id) GROUP BY 1,2")
def curate_counts(pred):
    return curate.summary(_built(pred), ["split", "dataset_class"])


@query("g6_review_build", "cat", sql="WITH c AS (SELECT * REPLACE (CASE class_name WHEN 'BUILDING' THEN 'HOUSEHOLD' ELSE class_name END AS class_name) FROM cat WHERE class_name<>'FURNITURE')," + _C4.replace("FROM cat", "FROM c").replace("cat.", "c.") + "SELECT ord, class_name, split FROM s")
def g6(cat):
    return curate.review_build(cat, R, ["FURNITURE"], {"BUILDING": "HOUSEHOLD"}).select("ord", "class_name", "split")


@query("g7_flat_build", "cat", sql=split_sql(_M1, "cat") + "SELECT ord, s.split, object_id||CASE WHEN q>1 THEN '__dup'||(q-1) ELSE '' END AS output_name FROM (SELECT cat.ord, cat.object_id, s.split, row_number() OVER (PARTITION BY s.split, class_name, cat.object_id ORDER BY stem) q FROM cat JOIN s USING (object_id)) s")
def g7(cat):
    return curate.flat_build(cat, R).select("ord", "split", "output_name")


_ST = f"""{_B}, st AS (SELECT cloud_id, n, mx-nx ex, my-ny ey, mz-nz ez, greatest((mx-nx)*(my-ny)*(mz-nz),1e-9) vol FROM b)"""
_SCOLS = ["x_extent", "y_extent", "z_extent", "volume", "density", "aspect_xy", "aspect_xz"]


@query("h1_shape_stats", "big", sql=f"WITH {_ST} SELECT cloud_id, {r_sql('ex AS x_extent', 'ey AS y_extent', 'ez AS z_extent', 'vol AS volume', 'n/vol AS density', 'greatest(ex,ey)/greatest(least(ex,ey),1e-9) AS aspect_xy', 'greatest(ex,ey)/greatest(ez,1e-9) AS aspect_xz')} FROM st")
def h1(big):
    return r6(audit.shape_stats(big), "cloud_id", cols=_SCOLS)


@query("h2_hard_checks", "cat", "pts", sql="""WITH p AS (SELECT cloud_id, count(*) n, count(*) FILTER (cloud_id%11>0 AND NOT (cloud_id%13=0 AND pt=1)) k FROM pts WHERE cloud_id%7>0 GROUP BY 1),
q AS (SELECT ord, n, k, ord%17=0 e FROM cat LEFT JOIN p ON cloud_id=ord) SELECT ord, (CASE WHEN e OR n IS NULL THEN 100 WHEN k=0 THEN 120 WHEN k<n THEN 20 ELSE 0 END)::DOUBLE AS hard_score,
CASE WHEN e THEN 'pcd_read_error' WHEN n IS NULL THEN 'missing_pcd' WHEN k=0 THEN 'non_finite_xyz;empty_or_invalid_xyz' WHEN k<n THEN 'non_finite_xyz' ELSE '' END AS reasons FROM q""")  # fmt: skip
def h2(cat, pts):
    bad = pts.filter("cloud_id%7>0").withColumn("x", F.expr("CASE WHEN cloud_id%11=0 OR (cloud_id%13=0 AND pt=1) THEN double('NaN') ELSE x END"))
    m = cat.select("ord", F.col("ord").alias("cloud_id"), F.expr("ord%17=0").alias("read_error"))
    return audit.join_reasons(audit.hard_checks(m, audit.shape_stats(bad)), ["hard_reasons"]).select("ord", "hard_score", "reasons")


@query("h3_label_checks", "pred", sql="""SELECT ord, round(CASE WHEN predicted_class<>class_name THEN 80.0 ELSE 0 END+CASE WHEN confidence<0.3 THEN 25+(0.3-confidence)*50 ELSE 0 END+CASE WHEN point_count<50 THEN 25 ELSE 0 END+CASE WHEN ord%90<20 THEN 25 ELSE 0 END+1e-10,6) AS label_score,
concat_ws(';', CASE WHEN predicted_class<>class_name THEN 'dataset_class_ne_predicted_class' END, CASE WHEN confidence<0.3 THEN 'low_confidence' END, CASE WHEN point_count<50 THEN 'low_manifest_point_count' END, CASE WHEN ord%90<20 THEN 'low_pcd_point_count' END) AS reasons FROM pred""")  # fmt: skip
def h3(pred):
    return audit.join_reasons(_labelled(pred), ["label_reasons"]).select("ord", F.round(F.col("label_score") + 1e-10, 6).alias("label_score"), "reasons")


def _labelled(pred):
    t = pred.withColumn("dataset_class", F.col("class_name")).withColumn("file_points", F.expr("CASE WHEN ord%90<20 THEN 10 ELSE 1000 END"))
    return audit.label_checks(t, 0.3, 50)


_LOGS = "SELECT cloud_id, cloud_id%5 AS g, unnest(['point_count','x_extent','y_extent','z_extent','volume','density','aspect_xy','aspect_xz']) field, unnest(range(8)) i, ln(1+greatest(unnest([n::DOUBLE,ex,ey,ez,vol,n/vol,greatest(ex,ey)/greatest(least(ex,ey),1e-9),greatest(ex,ey)/greatest(ez,1e-9)]),0)) v FROM st"
_Z = f"""l AS ({_LOGS}), md AS (SELECT g, field, median(v) m, count(*) k FROM l GROUP BY 1,2), dv AS (SELECT l.*, k, abs(v-m) d FROM l JOIN md USING (g, field)), sd AS (SELECT g, field, greatest(median(d)*1.4826,1e-9) s FROM dv GROUP BY 1,2),
zz AS (SELECT cloud_id, field, i, round(d/s,6) z FROM dv JOIN sd USING (g, field) WHERE k>=8 AND round(d/s,6)>=2.5)"""


def _outliers(big):
    stats = audit.shape_stats(big).withColumn("g", F.col("cloud_id") % 5).withColumn("point_count", F.col("n_points"))
    return audit.robust_z(stats, "cloud_id", "g", audit.FIELDS, 2.5)


@query("h4_robust_z", "big", sql=f"WITH {_ST}, {_Z} SELECT cloud_id, round(sum(least(40.0,4*z)),6) AS outlier_score, string_agg(field||'_outlier_z'||printf('%.1f',z), ';' ORDER BY i) AS reasons FROM zz GROUP BY 1")
def h4(big):
    return audit.join_reasons(_outliers(big), ["outlier_reasons"]).select("cloud_id", "outlier_score", "reasons")


@query("h5_reasons", "pred", sql="SELECT ord, CASE WHEN predicted_class<>class_name AND ord%2=0 THEN 'dataset_class_ne_predicted_class;seen' WHEN ord%2=0 THEN 'seen' WHEN predicted_class<>class_name THEN 'dataset_class_ne_predicted_class' ELSE '' END AS reasons FROM pred")
def h5(pred):
    t = pred.withColumn("a", F.expr("CASE WHEN predicted_class<>class_name THEN array('dataset_class_ne_predicted_class') END")).withColumn("b", F.expr("CASE WHEN ord%2=0 THEN array('seen','seen') END"))
    return audit.join_reasons(t.withColumn("c", F.col("a")), ["a", "b", "c"]).select("ord", "reasons")


_REASONS = "CASE ord%6 WHEN 0 THEN 'low_pcd_point_count' WHEN 1 THEN 'volume_outlier_z5.0' WHEN 2 THEN 'missing_pcd' WHEN 3 THEN 'low_manifest_point_count' WHEN 4 THEN 'low_manifest_point_count;non_finite_xyz' ELSE '' END"
_Q = f"""q AS (SELECT ord, class_name, {_REASONS} reasons, CASE WHEN ord%6=5 THEN 0 ELSE ord%200 END score FROM cat),
qq AS (SELECT *, score>0 AS suspicious, score>0 AND (ord%6 IN (0,4) OR (ord%6=1 AND score>=80)) AS high_priority, row_number() OVER (ORDER BY score DESC, class_name, ord) AS rank FROM q)"""


def _queued(cat):
    t = cat.select("ord", "class_name", F.expr(_REASONS).alias("reasons"), F.expr("CASE WHEN ord%6=5 THEN 0 ELSE ord%200 END").alias("score"))
    return audit.queue(t, "score", "class_name", "ord")


@query("h6_queue", "cat", sql=f"WITH {_Q} SELECT ord, suspicious, high_priority, rank FROM qq")
def h6(cat):
    return _queued(cat).select("ord", "suspicious", "high_priority", "rank")


@query("h7_reason_report", "cat", sql=f"WITH {_Q} SELECT r AS reason, count(*) AS n FROM (SELECT unnest(string_split(reasons,';')) r FROM qq WHERE suspicious AND reasons<>'') GROUP BY 1 ORDER BY n DESC, reason LIMIT 20")
def h7(cat):
    return audit.report(_queued(cat))


@query("h7_class_report", "cat", sql=f"WITH {_Q} SELECT class_name, count(*) AS n, count(*) FILTER (suspicious) AS suspicious, count(*) FILTER (high_priority) AS high_priority FROM qq GROUP BY 1")
def h7c(cat):
    return audit.class_report(_queued(cat), "class_name")


@query("h7_top_samples", "cat", sql=f"WITH {_Q} SELECT rank, ord, class_name, score, reasons FROM qq WHERE suspicious AND rank<=25")
def h7t(cat):
    return audit.top_samples(_queued(cat)).select("rank", "ord", "class_name", "score", "reasons")


def _logits(e, a=1):
    return e.select("vec_id", "label", F.transform(F.slice("embedding", a, 10), lambda x: x.cast("double")).alias("logits"))


_EMB = "e AS (SELECT vec_id, label, [x::DOUBLE for x in embedding[1:10]] l, [x::DOUBLE for x in embedding[11:20]] l2 FROM embeddings), p AS (SELECT *, list_position(l, list_max(l))-1 AS pred FROM e)"


@query("i1_predict", "embeddings", sql=f"WITH {_EMB} SELECT vec_id, CAST(pred AS BIGINT) AS pred, round(1/list_sum([exp(x-list_max(l)) for x in l]),6) AS confidence FROM p")
def i1(e):
    return fuse.predict(_logits(e)).select("vec_id", "pred", F.round("confidence", 6).alias("confidence"))


@query("i2_mismatches", "embeddings", sql=f"WITH {_EMB} SELECT vec_id, CAST(pred AS BIGINT) AS pred FROM p WHERE pred<>label")
def i2(e):
    return fuse.mismatches(fuse.predict(_logits(e)), "label").select("vec_id", "pred")


def _mean(k: str, n: int) -> str:
    return f"WITH {_EMB}, u AS (SELECT vec_id%{n} AS {k}, unnest(l) v, unnest(range(10)) i FROM e), m AS (SELECT {k}, i, round(avg(v),9) m FROM u GROUP BY 1,2) SELECT {k}, CAST(arg_max(i, struct_pack(a:=m,b:=-i)) AS BIGINT) AS pred, round(max(m),6) AS top FROM m GROUP BY 1"


@query("i3_scatter_mean", "embeddings", sql=_mean("point", 100))
def i3(e):
    return fuse.mean_logits(_logits(e).withColumn("point", F.col("vec_id") % 100), ["point"])


@query("i4_projection", "big", sql="SELECT cloud_id, pt, first_value(pt) OVER (PARTITION BY cloud_id, floor(x/5), floor(y/5), floor(z/5) ORDER BY conf DESC, pt) AS projected FROM big")
def i4(big):
    return fuse.project(big, 5.0, "pt").select("cloud_id", "pt", "projected")


@query("i5_late_fusion", "embeddings", sql=_mean("object", 120))
def i5(e):
    return fuse.mean_logits(_logits(e).withColumn("object", F.col("vec_id") % 120), ["object"])


@query("i6_votes", "embeddings", sql=_mean("sample", 125))
def i6(e):
    return fuse.mean_logits(_logits(e).withColumn("sample", F.col("vec_id") % 125), ["sample"])


@query("i7_part_refinement", "pts", dealt=True, sql="""WITH n AS (SELECT cloud_id, label, count(*) n FROM pts GROUP BY 1,2), k AS (SELECT *, count(*) OVER (PARTITION BY cloud_id) k FROM n), w AS (SELECT cloud_id, label FROM k WHERE k>1 AND n<2),
nb AS (SELECT a.cloud_id, a.pt, a.label own, b.label near FROM (SELECT pts.* FROM pts JOIN w USING (cloud_id, label)) a JOIN pts b ON a.cloud_id=b.cloud_id AND a.pt<>b.pt QUALIFY row_number() OVER (PARTITION BY a.cloud_id, a.pt ORDER BY round((a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)+(a.x-b.x)*(a.x-b.x),9), b.pt)<=3),
v AS (SELECT cloud_id, pt, near, count(*) v FROM nb WHERE near<>own GROUP BY 1,2,3), r AS (SELECT cloud_id, pt, arg_max(near, struct_pack(a:=v,b:=-near)) r FROM v GROUP BY 1,2)
SELECT cloud_id, pt, coalesce(r, label) AS refined FROM pts LEFT JOIN r USING (cloud_id, pt)""")  # fmt: skip
def i7(pts):
    return fuse.refine_parts(pts, "label", 2).select("cloud_id", "pt", "refined")


@query("i8_remap", "pts", sql="SELECT cloud_id, pt, CASE label WHEN 65 THEN 1 WHEN 78 THEN 2 WHEN 82 THEN 3 END AS mapped FROM pts")
def i8(pts):
    return fuse.remap_ids(pts, "label", {65: 1, 78: 2, 82: 3}).select("cloud_id", "pt", "mapped")


@query("i9_agreement", "embeddings", sql=f"WITH {_EMB}, q AS (SELECT label, pred a, list_position(l2, list_max(l2))-1 b FROM p) SELECT round(avg((a=label)::INT),6) AS acc_a, round(avg((b=label)::INT),6) AS acc_b, round(avg((b=label)::INT)-avg((a=label)::INT),6) AS diff, count(*) FILTER (a<>b) AS changed, round(count(*) FILTER (a<>b)/count(*),6) AS changed_share FROM q")
def i9(e):
    both = fuse.predict(_logits(e)).select("vec_id", "label", F.col("pred").alias("a")).join(fuse.predict(_logits(e, 11)).select("vec_id", F.col("pred").alias("b")), "vec_id")
    return fuse.agreement(both, "a", "b", "label")


_CM = "c AS (SELECT a.c AS t, b.c AS p, (SELECT count(*) FROM pred WHERE current_class=a.c AND predicted_class=b.c) n FROM (SELECT DISTINCT current_class c FROM pred) a, (SELECT DISTINCT current_class c FROM pred) b)"
CLASSES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _cm(pred):
    return metrics.confusion(pred, "current_class", "predicted_class")


@query("j1_confusion", "pred", sql=f'WITH {_CM} SELECT t AS "true", p AS pred, n FROM c')
def j1(pred):
    return _cm(pred)


@query("j2_normalised", "pred", sql=f'WITH {_CM} SELECT t AS "true", ' + ", ".join(f"round(sum(n) FILTER (p='{c}')/greatest(sum(n),1),4) AS {c}" for c in CLASSES) + " FROM c GROUP BY 1")
def j2(pred):
    return metrics.pivoted(_cm(pred), CLASSES)


_ACC = "SELECT {0}round(sum(a*n)/sum(n),6) AS oa, round(avg(a),6) AS macc{1} FROM (SELECT {0}current_class, avg((current_class=predicted_class)::INT) a, count(*) n FROM pred GROUP BY ALL) {2}"


@query("j3_accuracy", "pred", sql=_ACC.format("", ", CAST(sum(n) AS BIGINT) AS n", ""))
def j3(pred):
    return metrics.accuracy(pred, "current_class", "predicted_class")


_PR = "pr AS (SELECT t, CAST(s AS BIGINT) AS support, tp/k AS p, tp/s AS r FROM (SELECT t, sum(n) s, sum(n) FILTER (t=p) tp FROM c GROUP BY 1) JOIN (SELECT p, sum(n) k FROM c GROUP BY 1) x ON x.p=t)"


@query("j4_precision_recall", "pred", sql=f"WITH {_CM}, {_PR} SELECT t AS class_name, support, round(p,6) AS precision, round(r,6) AS recall, round(2*p*r/(p+r),6) AS f1 FROM pr")
def j4(pred):
    return metrics.precision_recall(_cm(pred))


@query("j4_macro", "pred", sql=f"WITH {_CM}, {_PR} SELECT round(avg(round(p,6)),6) AS macro_precision, round(avg(round(r,6)),6) AS macro_recall, round(avg(round(2*p*r/(p+r),6)),6) AS macro_f1 FROM pr")
def j4m(pred):
    return metrics.macro(metrics.precision_recall(_cm(pred)))


_IOU = "SELECT {0}round(avg(100*tp/(s+k-tp)),6) AS miou, round(avg(100*tp/s),6) AS macc, round(100*sum(tp)/sum(s),6) AS oa FROM (SELECT {0}t, sum(n) s, coalesce(sum(n) FILTER (t=p),0) tp FROM {1} GROUP BY ALL) JOIN (SELECT {0}p AS t, sum(n) k FROM {1} GROUP BY ALL) USING ({0}t) {2}"


@query("j5_iou", "pred", sql=f"WITH {_CM} " + _IOU.format("", "(SELECT * FROM c WHERE t<>'MACHINERY')", ""))
def j5(pred):
    return metrics.iou(_cm(pred), ignore="MACHINERY")


@query("j6_folds", "pred", sql="WITH c AS (SELECT CAST(area AS VARCHAR) AS area, current_class t, predicted_class p, count(*) n FROM pred GROUP BY ALL UNION ALL SELECT 'all', current_class, predicted_class, count(*) FROM pred GROUP BY ALL) " + _IOU.format("area, ", "c", "GROUP BY area"))
def j6(pred):
    return metrics.pooled_folds(pred, "area", "current_class", "predicted_class")


_PARTS = "pa AS (SELECT unnest([0,1,2,3,4]) cat, unnest([[65,70],[65,78],[78,79],[82,70],[65,82]]) parts), pl AS (SELECT cat, unnest(parts) part FROM pa)"
_SH = f"{_PARTS}, sh AS (SELECT cloud_id, cloud_id%4 cat FROM big GROUP BY 1), cr AS (SELECT cloud_id, cat, part FROM sh JOIN pl USING (cat)), iu AS (SELECT cr.cloud_id, cat, part, count(*) FILTER (label=part AND part_pred=part) i, count(*) FILTER (label=part OR part_pred=part) u FROM cr JOIN big USING (cloud_id) GROUP BY 1,2,3), pi AS (SELECT cloud_id, cat, avg(CASE WHEN u=0 THEN 100.0 ELSE 100*i/u END) iou FROM iu GROUP BY 1,2)"


def _shapes(big):
    rows = [(c, p) for c, ps in enumerate([[65, 70], [65, 78], [78, 79], [82, 70], [65, 82]]) for p in ps]
    parts = big.sparkSession.createDataFrame(rows, "cat long, part int")
    return metrics.shape_iou(big.withColumn("cat", F.col("cloud_id") % 4), "cloud_id", "cat", "label", "part_pred", parts)


@query("j7_shape_iou", "big", sql=f"WITH {_SH} SELECT cloud_id, round(iou,6) AS iou FROM pi")
def j7(big):
    return _shapes(big)[0].select("cloud_id", F.round("iou", 6).alias("iou"))


@query("j7_shape_totals", "big", sql=f"WITH {_SH} SELECT round((SELECT avg(iou) FROM pi),6) AS instance_miou, round(avg(coalesce(c,0)),6) AS category_miou FROM pa LEFT JOIN (SELECT cat, avg(iou) c FROM pi GROUP BY 1) USING (cat)")
def j7t(big):
    return _shapes(big)[1]


@query("j8_by_source", "pred", sql=_ACC.format("source, ", ", CAST(sum(n) AS BIGINT) AS n", "GROUP BY source"))
def j8(pred):
    return metrics.accuracy(pred, "current_class", "predicted_class", ["source"])


@query("j9_weighted_means", "log", sql="SELECT epoch, round(sum(secs*user_id)/sum(user_id) FILTER (secs IS NOT NULL),6) AS secs, round(sum(value*user_id)/sum(user_id),6) AS value FROM log GROUP BY 1")
def j9(log):
    return metrics.weighted_means(log.withColumn("epoch", F.col("epoch").cast("bigint")), ["secs", "value"], "user_id", ["epoch"])


_EP = "ep AS (SELECT split, epoch, round(avg(value),6) v FROM log GROUP BY 1,2)"


def _epochs(log):
    return log.groupBy("split", F.col("epoch").cast("bigint").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("v"))


@query("j10_running_best", "log", sql=f"WITH {_EP} SELECT split, epoch, max(v) OVER (PARTITION BY split ORDER BY epoch) AS best, coalesce(v>max(v) OVER (PARTITION BY split ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM ep")
def j10(log):
    return metrics.running_best(_epochs(log), "epoch", "v", ["split"]).drop("v")


@query("j10_best_epoch", "log", sql=f"WITH {_EP} SELECT split, arg_max(epoch, struct_pack(a:=v,b:=-epoch)) AS best_epoch, max(v) AS best FROM ep GROUP BY 1")
def j10b(log):
    return metrics.best_epoch(_epochs(log), "epoch", "v", ["split"])


_LAT = "round(quantile_cont({0},0.5),6) AS median, round(quantile_cont({0},0.95),6) AS p95, round(stddev_pop({0}),6) AS std, count({0}) AS n"


@query("j11_latency", "log", sql=f"SELECT run, {_LAT.format('secs')} FROM log GROUP BY 1")
def j11(log):
    return metrics.latency(log, "secs", ["run"])


@query("j12_timing", "log", sql=f"SELECT run, {_LAT.format('s')}, count(*)-count(s) AS missing FROM (SELECT run, coalesce(secs, CASE WHEN event_id%2=0 THEN value END) s FROM log) GROUP BY 1")
def j12(log):
    return metrics.timing_summary(log.withColumn("other", F.expr("CASE WHEN event_id%2=0 THEN value END")), "secs", "other", ["run"])


@query("j13_result_table", "pred", sql="WITH a AS (SELECT area, current_class, avg((current_class=predicted_class)::INT) a, count(*) n FROM pred GROUP BY 1,2) SELECT area, round(sum(a*n)/sum(n),6) AS oa, round(avg(a),6) AS macc, " + ", ".join(f"round(max(a) FILTER (current_class='{c}'),6) AS {c}" for c in CLASSES) + " FROM a GROUP BY 1")
def j13(pred):
    return metrics.result_table(pred, "area", "current_class", "predicted_class", CLASSES)


@query("j14_export_manifest", "big", sql="""WITH k AS (SELECT cloud_id, conf FROM big WHERE conf>=0.4 QUALIFY row_number() OVER (PARTITION BY cloud_id, floor(x/5), floor(y/5), floor(z/5) ORDER BY conf DESC, pt)=1), a AS (SELECT cloud_id, count(*) kept, round(avg(conf)+1e-10,6) AS mean_conf FROM k GROUP BY 1)
SELECT cloud_id, count(DISTINCT view_id) AS views, count(*) AS fused, count(*) FILTER (conf<0.4) AS rejected, coalesce(any_value(kept),0) AS kept, any_value(mean_conf) AS mean_conf FROM big LEFT JOIN a USING (cloud_id) GROUP BY 1""")  # fmt: skip
def j14(big):
    return metrics.export_manifest(big, 5.0, 0.4)


@query("j14_capped", "big", sql="""WITH k AS (SELECT cloud_id, conf FROM big WHERE conf>=0.4 QUALIFY row_number() OVER (PARTITION BY cloud_id, floor(x/5), floor(y/5), floor(z/5) ORDER BY conf DESC, pt)=1), a AS (SELECT cloud_id, count(*) kept FROM k GROUP BY 1)
SELECT cloud_id, cloud_id%5 AS class_name, count(*) AS fused, coalesce(any_value(kept),0) AS kept FROM big LEFT JOIN a USING (cloud_id) GROUP BY 1 QUALIFY row_number() OVER (PARTITION BY cloud_id%5 ORDER BY cloud_id)<=7""")  # fmt: skip
def j14c(big):
    """At most seven clouds of a class, the first ones."""
    classes = big.select("cloud_id", (F.col("cloud_id") % 5).alias("class_name")).distinct()
    return metrics.export_manifest(big, 5.0, 0.4, classes, 7).select("cloud_id", "class_name", "fused", "kept")


_RUNS = "WITH r AS (SELECT area AS run, avg((current_class=predicted_class)::INT) a FROM pred WHERE area<>3 GROUP BY 1), x AS (SELECT m AS run, CASE WHEN m<>5 THEN round(a,6) END AS oa, CASE WHEN m<>5 AND a IS NOT NULL THEN 'done' WHEN m=5 THEN 'failed' ELSE 'missing' END AS status FROM (SELECT unnest([1,2,3,4,5,6,7]::BIGINT[]) m) LEFT JOIN r ON run=m) "


def _runs(pred):
    runs = pred.sparkSession.range(1, 8).withColumnRenamed("id", "run")
    done = metrics.accuracy(pred.filter("area<>3"), "current_class", "predicted_class", ["area"]).selectExpr("area AS run", "CASE WHEN area<>5 THEN oa END AS oa", "CASE WHEN area=5 THEN 'out of memory' END AS error")
    return metrics.run_matrix(runs, done, "run")


@query("j15_run_matrix", "pred", sql=_RUNS + "SELECT * FROM x")
def j15(pred):
    return _runs(pred)[0].select("run", "oa", "status")


@query("j15_run_status", "pred", sql=_RUNS + "SELECT status, count(*) AS n FROM x GROUP BY 1")
def j15s(pred):
    return _runs(pred)[1]
