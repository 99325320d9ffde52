"""Queries of scans, catalogue preparation and splits (A, B, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointmill.operators import catalog as b
from pointmill.functions.scratch import scratch_folder
from pointmill.operators import curate, points, split
from pointmill.plans.base import again, query
from pointmill.plans.base import uniform_sql as u
from pointmill.sources import ingest

R = (0.7, 0.2, 0.1)
_LAYOUTS = """SELECT page_id, CASE page_id%7 WHEN 0 THEN 'root/train/'||c||'/'||i||'.pcd' WHEN 1 THEN 'root/gt-pred-diff/'||c||'/'||i||'.pcd' WHEN 2 THEN 'root/gt-pred-diff/'||c||'/pcds/'||i||'.pcd'
  WHEN 3 THEN 'root/'||c||'/pcds/'||i||'.pcd' WHEN 4 THEN 'root/'||c||'/2024-01-0'||(page_id%9+1)||'/gt/'||'s1/'||i||'.pcd' WHEN 5 THEN 'root/'||c||'/obj'||i||'/__frame_'||i||'.pcd' ELSE 'root/'||c||'/test/'||i||'.off' END AS path
FROM (SELECT page_id, split_part(path,'/',3) AS c, split_part(split_part(path,'/',5),'.',1) AS i FROM paths)"""


@query("a3_layout", "paths", sql=f"""
WITH l AS ({_LAYOUTS}), p AS (SELECT page_id, path, string_split(path,'/') AS s, page_id%7 AS k FROM l)
SELECT page_id, path, ['flat','bucket_first','bucket_pcds','class_pcds','day_bucket_source','raw_frames','mesh'][k+1] AS layout,
  CASE k WHEN 0 THEN s[-2] WHEN 1 THEN s[-2] WHEN 2 THEN s[-3] WHEN 3 THEN s[-3] WHEN 4 THEN s[-5] WHEN 5 THEN s[-3] ELSE s[-3] END AS class_name,
  CASE k WHEN 1 THEN s[-3] WHEN 2 THEN s[-4] WHEN 4 THEN s[-3] END AS bucket, CASE k WHEN 0 THEN s[-3] WHEN 6 THEN s[-2] END AS split FROM p""")  # fmt: skip
def a3(paths):
    made = paths.sparkSession.sql(_LAYOUTS.replace("FROM paths", "FROM {paths}"), paths=paths)
    return ingest.layout(made)


@query("a3_validation", "paths", sql=f"""WITH l AS ({_LAYOUTS.replace("'root/train/'", "CASE WHEN page_id%2=0 THEN 'root/val/' ELSE 'root/train/' END").replace("'/test/'", "CASE WHEN page_id%3=0 THEN '/train/' ELSE '/test/' END")}) SELECT page_id, path FROM l WHERE page_id%14=0 OR (page_id%7=6 AND page_id%3>0)""")
def a3v(paths):
    """The files that validation reads: val of flat folders, test of mesh folders."""
    sql = _LAYOUTS.replace("'root/train/'", "CASE WHEN page_id%2=0 THEN 'root/val/' ELSE 'root/train/' END").replace("'/test/'", "CASE WHEN page_id%3=0 THEN '/train/' ELSE '/test/' END")
    made = paths.sparkSession.sql(sql.replace("FROM paths", "FROM {paths}"), paths=paths)
    return ingest.of_split(made, "val").select("page_id", "path")


@query("a4_discovery", "paths", sql="""
SELECT path, page_id%3=0 AS is_frame FROM (SELECT page_id, CASE page_id%5 WHEN 0 THEN 'wandb/' WHEN 1 THEN '.git/' ELSE '' END || replace(path,'.pcd', CASE WHEN page_id%3=0 THEN '__frame_1.pcd' ELSE '.pcd' END) AS path FROM paths)
WHERE page_id%5 > 1""")  # fmt: skip
def a4(paths):
    made = paths.select("page_id", F.concat(F.expr("CASE page_id%5 WHEN 0 THEN 'wandb/' WHEN 1 THEN '.git/' ELSE '' END"), F.expr("replace(path,'.pcd', CASE WHEN page_id%3=0 THEN '__frame_1.pcd' ELSE '.pcd' END)")).alias("path"))
    return made.filter(~ingest.ignored(F.col("path"))).select("path", ingest.is_frame(F.col("path")).alias("is_frame"))


_CLOUD = "'root/k'||(event_id%3)||'/pcds/s'||(event_id%500)||'__frame_'||event_id||'.pcd'"
_SIDECAR = "'root/k'||(event_id%3)||CASE WHEN event_id%2=0 THEN '/json/s'||(event_id%500) ELSE '/pcds/s'||(event_id%500)||'__frame_'||event_id END||'.json'"
_BESIDE = """{0} SELECT c.event_id, coalesce(a.k, b.k) AS k FROM c LEFT JOIN m a ON a.path=replace(c.path,'.pcd','.json') LEFT JOIN m b ON b.path=replace(regexp_replace(c.path,'__frame_[^_]+$','.json'),'/pcds/','/json/')"""
_SIDES = "WITH c AS (SELECT event_id, {0} AS path FROM events), m AS (SELECT {1} AS path, cast(json_extract_string(min(props),'$.k') AS int) AS k FROM events {2} GROUP BY 1)"


@query("a5_sidecars", "events", sql=_BESIDE.format(_SIDES.format(_CLOUD, _SIDECAR, "WHERE event_id%5<>2 AND event_id%7<>3")))
def a5(events):
    """Folders share stems. A fifth of the sidecars is missing and a seventh is no JSON: these are the cases under test."""
    text = F.expr("CASE WHEN event_id%7=3 THEN '{\"k\": 1, broken' ELSE props END").alias("text")
    return _beside(events, events.filter("event_id%5<>2").select(F.expr(_SIDECAR).alias("path"), text))


@query("a5_sidecars_all", "events", sql=_BESIDE.format(_SIDES.format(_CLOUD, _SIDECAR, "")))
def a5_all(events):
    """Every event as a sidecar, none missing or broken."""
    return _beside(events, events.select(F.expr(_SIDECAR).alias("path"), F.col("props").alias("text")))


def _beside(events, meta):
    clouds = events.select("event_id", F.expr(_CLOUD).alias("path"))
    return ingest.attach_sidecars(clouds, meta, "k int").select("event_id", F.col("meta.k").alias("k"))


def _files(big, name: str) -> str:
    """A folder of ascii PCD files made of the clouds: split/class/<cloud>.txt, one file a cloud, written by the tasks."""
    head = F.concat(F.lit("VERSION .7\nFIELDS x y z\nSIZE 8 8 8\nTYPE F F F\nCOUNT 1 1 1\nWIDTH "), F.col("n").cast("string"), F.lit("\nHEIGHT 1\nPOINTS "), F.col("n").cast("string"), F.lit("\nDATA ascii\n"))
    line = F.concat_ws(" ", *(F.col(c).cast("string") for c in "xyz"))
    body = big.groupBy("cloud_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pt", line.alias("l")))), lambda p: p["l"]), "\n").alias("body"), F.count("*").alias("n"))
    folder = scratch_folder(big.sparkSession, name)
    name = F.concat(F.lit("split=train/class=c"), F.col("cloud_id") % 5, F.lit("/cloud_id="), F.col("cloud_id"), F.lit(".txt"))
    ingest.write_texts(body.select(name.alias("name"), F.concat(head, "body", F.lit("\n")).alias("text")), folder)
    return folder


@query("a1_cloud_files", "big", dealt=True, sql="SELECT cloud_id, count(*) AS n, 0::BIGINT AS errors, round(sum(x)+1e-6,3) AS sx, round(sum(y)+1e-6,3) AS sy, round(sum(z)+1e-6,3) AS sz FROM big GROUP BY 1")
def a1(big):
    """Every cloud written as a file and read back."""
    read = ingest.read_clouds(big.sparkSession, _files(big, "clouds"), glob="*.txt", kind="pcd")
    by = read.groupBy(F.regexp_extract("path", "cloud_id=([0-9]+)", 1).cast("bigint").alias("cloud_id"))
    return by.agg(F.count("pt").alias("n"), F.count("error").alias("errors"), *(F.round(F.sum(c) + 1e-6, 3).alias("s" + c) for c in "xyz"))


@query("a2_header_counts", "big", dealt=True, sql="SELECT cloud_id, count(*) AS n_points FROM big GROUP BY 1")
def a2(big):
    counts = ingest.header_counts(big.sparkSession, _files(big, "headers"), glob="*.txt")
    return counts.select(F.regexp_extract("path", "cloud_id=([0-9]+)", 1).cast("bigint").alias("cloud_id"), "n_points")


@query("a8_manifest", "cat", sql="SELECT source AS split, class_name AS dataset_class, stem AS sample_id FROM cat")
def a8(cat):
    """A manifest written as JSON lines and read back."""
    folder = scratch_folder(cat.sparkSession, "manifest")
    cat.select(F.col("source").alias("split"), F.col("class_name").alias("dataset_class"), F.col("stem").alias("sample_id")).write.json(f"{folder}/manifest.jsonl")
    return ingest.read_manifest(cat.sparkSession, folder, "split string, dataset_class string, sample_id string")


@query("a10_dataset", "cat", sql="SELECT split, dataset_class, count(*) AS n FROM (SELECT source AS split, class_name AS dataset_class FROM cat) GROUP BY ALL")
def a10(cat):
    """A dataset written as a split/class tree and counted by its folders."""
    folder = scratch_folder(cat.sparkSession, "dataset")
    curate.write_dataset(cat.withColumns({"split": F.col("source"), "dataset_class": F.col("class_name")}), folder)
    return cat.sparkSession.read.parquet(folder).groupBy("split", "dataset_class").agg(F.count("*").alias("n"))


@query("a6_identity", "cat", sql="""SELECT ord, object_id AS p_object, object_id AS p_track, split_part(stem,'__track_',1) AS p_run, cast(ord AS varchar) AS p_frame, split_part(stem,'__frame_',1) AS p_group FROM cat""")
def a6(cat):
    return cat.select("ord", *(c.alias(n) for n, c in ingest.identity(F.col("stem")).items()))


@query("a7_predictions", "pred", sql="""SELECT ord, CASE WHEN ord%11=0 THEN 0.0 ELSE confidence END AS confidence, is_match=1 AS is_match FROM pred""")
def a7(pred):
    text = pred.select("ord", F.expr("CASE WHEN ord%11=0 THEN 'n/a' ELSE cast(confidence AS string) END").alias("confidence"), F.expr("CASE WHEN is_match=1 THEN ' Yes' ELSE '0' END").alias("is_match"))
    return ingest.parse_predictions(text)


_DRAWS = f"""
WITH v AS (SELECT cloud_id AS m, (pt-1)//3 AS f, (pt-1)%3 AS i, x, y, z FROM big),
t AS (SELECT a.m, a.f, a.x x0,a.y y0,a.z z0,b.x x1,b.y y1,b.z z1,c.x x2,c.y y2,c.z z2 FROM v a JOIN v b ON a.m=b.m AND a.f=b.f AND a.i=0 AND b.i=1 JOIN v c ON a.m=c.m AND a.f=c.f AND c.i=2),
w AS (SELECT *, sqrt(power((y1-y0)*(z2-z0)-(z1-z0)*(y2-y0),2)+power((z1-z0)*(x2-x0)-(x1-x0)*(z2-z0),2)+power((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0),2))/2 AS area FROM t),
c0 AS (SELECT *, sum(area) OVER (PARTITION BY m ORDER BY f ROWS UNBOUNDED PRECEDING)/sum(area) OVER (PARTITION BY m) AS hi, f=max(f) OVER (PARTITION BY m) AS tail FROM w WHERE area > 1e-12),
c AS (SELECT * REPLACE (CASE WHEN tail THEN 1.0 ELSE hi END AS hi) FROM c0),
g AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY m ORDER BY f),0.0) AS lo FROM c),
d AS (SELECT m, pt, {u("'0::'||m||'::'||pt")} AS u, sqrt({u("'0::'||m||'::'||pt||'::a'")}) AS r1, {u("'0::'||m||'::'||pt||'::b'")} AS r2 FROM (SELECT DISTINCT m FROM g), (SELECT unnest(range(16)) AS pt))
SELECT g.m AS mesh_id, CAST(d.pt AS BIGINT) AS pt, round((1-r1)*x0+r1*(1-r2)*x1+r1*r2*x2,6) AS x, round((1-r1)*y0+r1*(1-r2)*y1+r1*r2*y2,6) AS y, round((1-r1)*z0+r1*(1-r2)*z1+r1*r2*z2,6) AS z
FROM d JOIN g ON d.m=g.m AND u>=lo AND u<hi"""  # fmt: skip


@query("a9_surface", "big", sql=_DRAWS)
def a9(big):
    return _surface(big)


again("a9_surface_all", "a9_surface")


def _surface(big):
    v = big.select(F.col("cloud_id").alias("mesh_id"), (F.col("pt") - 1).alias("v"), "x", "y", "z")
    f = v.filter("v % 3 = 0").select("mesh_id", (F.col("v") / 3).cast("long").alias("face"), F.col("v").alias("v0"), (F.col("v") + 1).alias("v1"), (F.col("v") + 2).alias("v2"))
    return ingest.sample_surface(v, f, 16).select("mesh_id", "pt", *(F.round(c, 6).alias(c) for c in "xyz"))


def _off_files(big) -> str:
    """A folder of OFF files made of the clouds: a triangle for each three points and a square for each five, one file a cloud, written by the tasks."""
    name = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pt", F.concat_ws(" ", *(F.col(c).cast("string") for c in "xyz")).alias("l")))), lambda p: p["l"]), "\n")
    clouds = big.groupBy("cloud_id").agg(F.count("*").cast("int").alias("n"), name.alias("body")).filter("n >= 3")
    face = lambda k, i: F.concat_ws(" ", F.lit(str(k)), *((i * 3 + j).cast("string") for j in range(k)))
    threes = F.transform(F.expr("sequence(0, cast(n / 3 - 1 AS int))"), lambda i: F.when((i % 2 == 1) & (i * 3 + 3 < F.col("n")), face(4, i)).otherwise(face(3, i)))
    text = F.concat(F.lit("OFF\n# made of a cloud\n"), F.concat_ws(" ", F.col("n").cast("string"), F.size(threes).cast("string"), F.lit("0")), F.lit("\n"), "body", F.lit("\n"), F.array_join(threes, "\n"), F.lit("\n"))
    folder = scratch_folder(big.sparkSession, "meshes")
    ingest.write_texts(clouds.select(F.concat(F.lit("cloud_id="), F.col("cloud_id"), F.lit(".txt")).alias("name"), text.alias("text")), folder)
    return folder


@query("a9_off_meshes", "big", dealt=True, sql=f"""
WITH v AS (SELECT cloud_id AS m, pt-1 AS i, x, y, z, count(*) OVER (PARTITION BY cloud_id) AS n FROM big),
q AS (SELECT a.m, a.i//3 AS f, a.n, unnest(CASE WHEN a.i//3%2=1 AND a.i+3<a.n THEN [0, 1] ELSE [0] END) AS t, a.i FROM v a WHERE a.i%3=0 AND a.i+2<a.n),
k AS (SELECT m, max(1+(f%2=1 AND i+3<n)::INT) AS most FROM q GROUP BY 1),
t0 AS (SELECT q.m, q.f*most+t AS f, a.x x0,a.y y0,a.z z0,b.x x1,b.y y1,b.z z1,c.x x2,c.y y2,c.z z2 FROM q JOIN k USING (m) JOIN v a ON a.m=q.m AND a.i=q.i JOIN v b ON b.m=q.m AND b.i=q.i+1+t JOIN v c ON c.m=q.m AND c.i=q.i+2+t),
ce AS (SELECT m, (avg(x0)+avg(x1)+avg(x2))/3 cx, (avg(y0)+avg(y1)+avg(y2))/3 cy, (avg(z0)+avg(z1)+avg(z2))/3 cz FROM t0 GROUP BY 1),
t1 AS (SELECT m, f, x0-cx x0,y0-cy y0,z0-cz z0,x1-cx x1,y1-cy y1,z1-cz z1,x2-cx x2,y2-cy y2,z2-cz z2 FROM t0 JOIN ce USING (m)),
sc AS (SELECT m, max(sqrt(greatest(x0*x0+y0*y0+z0*z0,x1*x1+y1*y1+z1*z1,x2*x2+y2*y2+z2*z2))) s FROM t1 GROUP BY 1),
t AS (SELECT m, f, x0/s x0,y0/s y0,z0/s z0,x1/s x1,y1/s y1,z1/s z1,x2/s x2,y2/s y2,z2/s z2 FROM t1 JOIN sc USING (m)),
w AS {_DRAWS.split("w AS ", 1)[1].replace("'0::'||m||'::'||pt", "'0::'||'c'||m||'::'||pt").replace("g.m AS mesh_id", "g.m AS cloud_id")}""")  # fmt: skip
def a9_off(big):
    """Every cloud written as an OFF file of triangles and squares, read back, scaled and sampled."""
    v, f, _ = ingest.read_meshes(big.sparkSession, _off_files(big), glob="*.txt")
    v, f = (df.withColumn("mesh_id", F.concat(F.lit("c"), F.regexp_extract("mesh_id", "cloud_id=([0-9]+)", 1))) for df in (v, f))
    drawn = ingest.sample_surface(v, f, 16, scaled=True)
    return drawn.select(F.substring("mesh_id", 2, 20).cast("bigint").alias("cloud_id"), "pt", *(F.round(c, 6).alias(c) for c in "xyz"))


@query("a11_unique_names", "cat", sql="""SELECT ord, CAST(ord%50 AS VARCHAR)||CASE WHEN r>1 THEN '__dup'||(r-1) ELSE '' END AS output_name FROM (SELECT ord, row_number() OVER (PARTITION BY class_name, ord%50 ORDER BY ord) r FROM cat)""")
def a11(cat):
    return curate.unique_names(cat.withColumn("s", (F.col("ord") % 50).cast("string")), ["class_name"], "s", "ord").select("ord", "output_name")


@query("a12_manifest", "cat", sql="""SELECT '{"ord":'||ord||',"stem":"'||stem||'","class_name":"'||class_name||'"}' AS json FROM cat""")
def a12(cat):
    return curate.manifest_json(cat, ["ord", "stem", "class_name"])


@query("a13_summary", "cat", sql="""SELECT class_name, source, count(*) AS n FROM cat GROUP BY ALL""")
def a13(cat):
    return curate.summary(cat, ["class_name", "source"])


@query("b1_since", "cat", sql="""SELECT ord FROM cat WHERE day >= DATE '1996-01-01'""")
def b1(cat):
    return b.since(cat, "1996-01-01").select("ord")


@query("b1_since_undated", "cat", sql="""SELECT ord FROM cat WHERE ord%9=0 OR day >= DATE '1996-01-01'""")
def b1u(cat):
    text = cat.withColumn("day", F.expr("CASE WHEN ord%9=0 THEN 'misc' ELSE cast(day AS string) END"))
    return b.since(text, "1996-01-01", keep_undated=True).select("ord")


@query("b2_min_points", "cat", sql="""SELECT ord FROM cat WHERE point_count>=100 OR class_name='MACHINERY'""")
def b2(cat):
    return b.min_points(cat, 100, ["MACHINERY"]).select("ord")


@query("b3_remap", "cat", sql="""SELECT ord, CASE class_name WHEN 'BUILDING' THEN 'HOUSEHOLD' ELSE class_name END AS class_name FROM cat WHERE class_name <> 'FURNITURE'""")
def b3(cat):
    return b.remap_classes(cat, ["FURNITURE"], mapping={"BUILDING": "HOUSEHOLD"}).select("ord", "class_name")


@query("b4_class_index", "cat", sql="""SELECT class_name, row_number() OVER (ORDER BY CASE class_name WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END, class_name)-1 AS class_id FROM (SELECT DISTINCT class_name FROM cat)""")
def b4(cat):
    return b.class_index(cat, ["MACHINERY", "BUILDING"])


@query("b5_label_union", "cat", "frm", sql="""
WITH a AS (SELECT class_name, object_id, stem, 'cat' AS source_dataset FROM cat UNION ALL SELECT class_name, object_id, '' AS stem, 'frm' FROM frm), i AS (SELECT class_name, row_number() OVER (ORDER BY class_name)-1 AS class_id FROM (SELECT DISTINCT class_name FROM a))
SELECT a.*, class_id FROM a JOIN i USING (class_name)""")  # fmt: skip
def b5(cat, frm):
    return b.union_labels({"cat": cat, "frm": frm}, ["class_name", "object_id", "stem"])


@query("b6_labels", "cat", sql="""SELECT ord, CASE WHEN ord%6 IN (3,5) THEN 'MACHINERY' WHEN ord%6=4 THEN 'BUILDING' ELSE class_name END AS label,
CASE ord%6 WHEN 0 THEN 'final_class_name' WHEN 1 THEN 'gt_class_name' WHEN 2 THEN 'predicted_class_name_pseudo' WHEN 3 THEN 'gt_obj_class' WHEN 4 THEN 'gt_class_name' ELSE 'path' END AS label_source FROM cat""")
def b6(cat):
    """final before class_name; class_name before gt_class_name for the label but behind it for the provenance, which a field that names nothing fills too; path."""
    known = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    t = cat.selectExpr(
        "ord", "CASE WHEN ord%6=0 THEN lower(class_name) END AS final_class_name", "CASE ord%6 WHEN 0 THEN 'BUILDING' WHEN 1 THEN concat(' ',class_name,'-') WHEN 4 THEN 'building' END AS class_name",
        "CASE ord%6 WHEN 1 THEN 'unknown' WHEN 4 THEN class_name END AS gt_class_name", "CASE WHEN ord%6=3 THEN 'AUTOMOBILE' END AS gt_obj_class", "CASE WHEN ord%6=2 THEN class_name ELSE '' END AS predicted_class_name", "'root/furniture/Machinery/x.pcd' AS path",
    )
    return b.resolve_label(t, known, "path").select("ord", "label", "label_source")


@query("b7_pseudo_guard", "cat", sql="""SELECT bucket, bool_and(ord%4 > 0 OR bucket='gt-pred-same') AS all_pseudo FROM cat GROUP BY bucket""")
def b7(cat):
    return b.all_pseudo(cat.withColumn("label_source", F.expr("CASE WHEN ord%4=0 AND bucket<>'gt-pred-same' THEN 'final' WHEN ord%2=0 THEN 'path' ELSE 'gt_pseudo' END")), ["bucket"])


_CAP = "SELECT ord FROM (SELECT ord, row_number() OVER (PARTITION BY class_name ORDER BY {}) r FROM cat) WHERE r<=100"


@query("b8_cap", "cat", sql=_CAP.format("md5(stem), stem"))
def b8(cat):
    return b.cap_hashed(cat, 100, "stem").select("ord")


@query("b9_cap_summary", "pred", sql="""SELECT predicted_class, count(*) AS n_before, least(count(*),150) AS n_after FROM pred GROUP BY 1""")
def b9(pred):
    return b.cap_summary(pred, b.cap_hashed(pred, 150, "stem", "predicted_class", 7), "predicted_class")


@query("b10_cap_arrival", "cat", sql=_CAP.format("ord"))
def b10(cat):
    return b.cap(cat, 100, "class_name", ["ord"]).select("ord")


@query("b11_first_groups", "frm", sql="""
WITH g AS (SELECT class_name, group_key, min(frame_id) f FROM frm GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY f, group_key) r FROM g)
SELECT frame_id FROM frm JOIN k USING (class_name, group_key) WHERE r<=20""")  # fmt: skip
def b11(frm):
    return b.first_groups(frm, 20, "class_name", "group_key", "frame_id").select("frame_id")


@query("b12_sample", "cat", sql=_CAP.format("md5('5::'||stem), stem"))
def b12(cat):
    first = b.sample_per_class(cat, 100, "stem", "class_name", 5)
    return b.sample_per_class(cat, 100, "stem", "class_name", 5, earlier=first).select("ord")


@query("b13_best_frame", "frm", sql=f"""SELECT group_key, arg_max(frame_id, struct_pack(a:=extent, b:=point_count, c:=md5(cast(frame_id AS varchar)), d:=frame_id)) AS frame_id FROM frm GROUP BY 1""")
def b13(frm):
    return b.best_frame(frm, "group_key", "frame_id").select("group_key", "frame_id")


_FRAMES = "CASE WHEN frame_id%7=0 THEN 'f'||frame_id ELSE cast(frame_id AS varchar(20)) END"


@query("b14_views_uniform", "frm", sql=f"""
WITH t AS (SELECT group_key, {_FRAMES} AS frame FROM frm), o AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY TRY_CAST(frame AS BIGINT) IS NULL, TRY_CAST(frame AS BIGINT), frame)-1 i, count(*) OVER (PARTITION BY group_key) n FROM t)
SELECT group_key, frame, row_number() OVER (PARTITION BY group_key ORDER BY i)-1 AS view_idx FROM o WHERE n<=5 OR i IN (0, (n-1)*1//4, (n-1)*2//4, (n-1)*3//4, n-1)""")  # fmt: skip
def b14(frm):
    """Frame ids as texts, some of them no numbers: 9 comes before 10, and f7 behind all numbers."""
    return b.views_uniform(frm.withColumn("frame", F.expr(_FRAMES)), 5, "group_key", "frame").select("group_key", "frame", "view_idx")


@query("b15_views_largest", "frm", sql="""
WITH r AS (SELECT group_key, frame_id, row_number() OVER (PARTITION BY group_key ORDER BY extent DESC, point_count DESC, md5(cast(frame_id AS varchar)) DESC, frame_id DESC) r FROM frm)
SELECT group_key, frame_id, row_number() OVER (PARTITION BY group_key ORDER BY frame_id)-1 AS view_idx FROM r WHERE r<=4""")  # fmt: skip
def b15(frm):
    return b.views_largest(frm, 4, "group_key", "frame_id").select("group_key", "frame_id", "view_idx")


@query("b16_objects", "frm", sql="""SELECT group_key, string_agg(cast(frame_id AS varchar), ',' ORDER BY frame_id) AS frames, count(*) AS n_views, arg_max(frame_id, struct_pack(a:=extent, b:=point_count, c:=md5(cast(frame_id AS varchar)), d:=frame_id)) AS representative, round(avg(extent),6) AS distance FROM frm GROUP BY 1""")
def b16(frm):
    return b.assemble_objects(frm, "group_key", "frame_id", "extent")


@query("b17_distance_extent", "log", "big", sql="""
WITH s AS (SELECT cloud_id, greatest(max(x)-min(x),max(y)-min(y),max(z)-min(z)) s FROM big GROUP BY 1)
SELECT event_id, round(coalesce(abs(secs),abs(value),0.0),6) AS distance, round(coalesce(CASE WHEN event_id%2=0 THEN greatest(abs(value),abs(secs)) END, s, 0.0),6) AS extent FROM log LEFT JOIN s ON cloud_id=event_id%200""")  # fmt: skip
def b17(log, big):
    t = log.selectExpr("event_id", "event_id%200 AS cloud_id", "secs", "value", "CASE WHEN event_id%2=0 THEN value END AS ex", "CASE WHEN event_id%2=0 THEN secs END AS ey")
    return b.distance_and_extent(t, "secs", "value", ["ex", "ey"], points.bounds(big)).select("event_id", F.round("distance", 6).alias("distance"), F.round("extent", 6).alias("extent"))


_SIDE = "CASE WHEN prio<'2' THEN 'val' WHEN prio<'3' THEN 'test' ELSE 'train' END"


@query("b18_overview", "cat", sql=f"""SELECT class_name, count(*) FILTER (s='train') AS train, count(*) FILTER (s='val') AS val, count(*) FILTER (s='test') AS test, count(*) AS total FROM (SELECT class_name, {_SIDE} s FROM cat) GROUP BY 1""")
def b18(cat):
    return b.class_overview(cat.withColumn("split", F.expr(_SIDE)))


@query("b19_round_robin", "cat", sql="""SELECT ord, turn FROM (SELECT ord, class_name, row_number() OVER (PARTITION BY class_name ORDER BY ord) AS turn FROM cat) ORDER BY turn, class_name LIMIT 23""")
def b19(cat):
    return b.round_robin(cat, 23, "class_name", "ord").select("ord", "turn")


_LR = """SELECT *, b1+CASE WHEN (CASE WHEN f2>f1 THEN 1 ELSE 0 END)+(CASE WHEN f3>f1 THEN 1 ELSE 0 END)<rest THEN 1 ELSE 0 END AS tr, b2+CASE WHEN (CASE WHEN f1>=f2 THEN 1 ELSE 0 END)+(CASE WHEN f3>f2 THEN 1 ELSE 0 END)<rest THEN 1 ELSE 0 END AS va
FROM (SELECT *, n-b1-b2-b3 AS rest, round(n*0.7::DOUBLE-b1,9) f1, round(n*0.2::DOUBLE-b2,9) f2, round(n*0.1::DOUBLE-b3,9) f3 FROM (SELECT *, cast(floor(n*0.7::DOUBLE+1e-9) AS BIGINT) b1, cast(floor(n*0.2::DOUBLE+1e-9) AS BIGINT) b2, cast(floor(n*0.1::DOUBLE+1e-9) AS BIGINT) b3 FROM n))"""
_M1 = """SELECT *, CASE WHEN n<=2 THEN 1 WHEN t+v>=n THEN greatest(1,n-2) ELSE t END AS tr, CASE WHEN n<=2 THEN 0 WHEN t+v>=n THEN 1 ELSE v END AS va FROM (SELECT *, greatest(cast(floor(n*0.7::DOUBLE+1e-9) AS BIGINT),1) t, greatest(cast(floor(n*0.2::DOUBLE+1e-9) AS BIGINT),1) v FROM n)"""
_ZA = """SELECT *, n-va-least(s,greatest(0,n-1-va)) AS tr FROM (SELECT *, greatest(0, v-greatest(0, v+s+1-n)) AS va FROM (SELECT *, greatest(cast(floor(n*0.2::DOUBLE+1e-9) AS BIGINT),1) v, greatest(cast(floor(n*0.1::DOUBLE+1e-9) AS BIGINT),1) s FROM n))"""


def split_sql(counts: str, table: str, group: str = "object_id", stratum: str = "string_agg(DISTINCT class_name, '::' ORDER BY class_name)", key: str = "object_id") -> str:
    """CTEs ending in s(group, split)."""
    return f"""WITH o AS (SELECT {group}, {stratum} AS st FROM {table} GROUP BY {group}),
n AS (SELECT *, count(*) OVER (PARTITION BY st) AS n, row_number() OVER (PARTITION BY st ORDER BY md5({key}), {group}) AS r FROM o), c AS ({counts}),
s AS (SELECT *, CASE WHEN r<=tr THEN 'train' WHEN r<=tr+va THEN 'val' ELSE 'test' END AS split FROM c)
"""


@query("c1_split", "frm", sql=split_sql(_LR, "frm") + "SELECT frame_id, split FROM frm JOIN s USING (object_id)")
def c1(frm):
    return split.split_objects(frm, split.largest_remainder, R, ["object_id"]).select("frame_id", "split")


@query("c2_split_minimum", "frm", sql=split_sql(_M1, "frm") + "SELECT frame_id, split FROM frm JOIN s USING (object_id)")
def c2(frm):
    return split.split_objects(frm, split.with_minimum, R, ["object_id"]).select("frame_id", "split")


@query("c3_split_class_object", "pred", sql=split_sql(_ZA, "pred", "predicted_class, object_id", "predicted_class", "predicted_class||'::'||object_id") + "SELECT ord, split FROM pred JOIN s USING (predicted_class, object_id)")
def c3(pred):
    return split.split_objects(pred, split.zero_aware, R, ["predicted_class", "object_id"], "predicted_class").select("ord", "split")


_C4 = """
n AS (SELECT class_name, count(*) n FROM cat GROUP BY 1), r AS (SELECT cat.*, n, row_number() OVER (PARTITION BY cat.class_name, source ORDER BY md5(stem), stem) r FROM cat JOIN n USING (class_name)),
s AS (SELECT *, CASE WHEN source='curated' THEN 'train' WHEN r<=floor(n*0.2::DOUBLE+1e-9) THEN 'val' WHEN r<=floor(n*0.2::DOUBLE+1e-9)+floor(n*0.1::DOUBLE+1e-9) THEN 'test' ELSE 'train' END AS split FROM r)
"""


@query("c4_split_review", "cat", sql="WITH" + _C4 + "SELECT ord, split FROM s")
def c4(cat):
    return split.split_review(cat, R, "stem").select("ord", "split")


@query("c5_split_report", "cat", sql="WITH" + _C4 + "SELECT split, class_name, count(*) AS n, round(count(*)/sum(count(*)) OVER (PARTITION BY class_name),6) AS share, round(CASE split WHEN 'train' THEN 0.7 WHEN 'val' THEN 0.2 ELSE 0.1 END::DOUBLE,6) AS requested FROM s GROUP BY 1,2")
def c5(cat):
    return split.split_report(split.split_review(cat, R, "stem"), R)


@query("c6_leaks", "cat", sql="WITH" + _C4 + "SELECT object_id, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(DISTINCT split) AS n FROM s GROUP BY 1 HAVING count(DISTINCT split)>1")
def c6(cat):
    return split.leaks(split.split_review(cat, R, "stem"), ["object_id"])


@query("c7_overlap", "cat", sql="""SELECT count(*) AS n_shared FROM (SELECT class_name, object_id FROM cat WHERE source='curated' INTERSECT SELECT class_name, object_id FROM cat WHERE source='review')""")
def c7(cat):
    return split.overlap(cat.filter("source='curated'"), cat.filter("source='review'"), ["class_name", "object_id"])


_EPOCH = """
n AS (SELECT *, count(*) OVER (PARTITION BY class_name) n, row_number() OVER (PARTITION BY class_name ORDER BY md5(stem), stem)-1 r FROM (SELECT * REPLACE (CASE WHEN prio<'3' THEN class_name ELSE 'AUTOMOBILE' END AS class_name) FROM cat)),
h AS (SELECT max(n) hi, min(n) lo FROM n), t AS (SELECT n.*, {} AS t FROM n, h), e AS (SELECT ord, class_name, t, c*n+r AS place FROM (SELECT *, unnest(range(0, cast(ceil(t/n) AS BIGINT))) AS c FROM t))
"""


def _uneven(cat):
    """All rows, most of them of one class."""
    return cat.withColumn("class_name", F.expr("CASE WHEN prio<'3' THEN class_name ELSE 'AUTOMOBILE' END"))


@query("c8_balanced", "cat", sql="WITH" + _EPOCH.format("20*least(ceil(hi/20.0),floor(lo*2/20.0))::BIGINT") + "SELECT ord, CAST(place AS BIGINT) AS place, CAST(place//20 AS BIGINT) AS batch FROM e WHERE place<t")
def c8(cat):
    return split.balanced_epoch(_uneven(cat), 100, 5, 2, "stem").select("ord", "place", "batch")


@query("c9_oversampled", "cat", sql="WITH" + _EPOCH.format("least(hi, n*3)") + "SELECT ord, CAST(place AS BIGINT) AS place FROM e WHERE place<t")
def c9(cat):
    return split.oversampled_epoch(_uneven(cat), 3, "stem").select("ord", "place")


@query("c10_weights", "cat", sql="""SELECT class_name, n, round((1/sqrt(n))/avg(1/sqrt(n)) OVER (),6) AS weight FROM (SELECT class_name, count(*) n FROM cat GROUP BY 1)""")
def c10(cat):
    return split.class_weights(cat)


@query("c10_effective", "cat", sql="WITH" + _EPOCH.format("20*least(ceil(hi/20.0),floor(lo*2/20.0))::BIGINT") + "SELECT class_name, n, round((1/sqrt(n))/avg(1/sqrt(n)) OVER (),6) AS weight FROM (SELECT class_name, count(*) n FROM e WHERE place<t GROUP BY 1)")
def c10e(cat):
    """Weights from the rows of an epoch, after balancing; every class must have some."""
    epoch = split.balanced_epoch(_uneven(cat), 100, 5, 2, "stem")
    return split.class_weights(epoch, classes=["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


@query("c11_permuted", "cat", sql="""
SELECT a.ord, b.class_name AS random_label FROM (SELECT ord, row_number() OVER (ORDER BY md5(stem), stem) i FROM cat) a JOIN (SELECT class_name, row_number() OVER (ORDER BY md5('3::'||stem), stem) i FROM cat) b USING (i)""")  # fmt: skip
def c11(cat):
    return split.permute_labels(cat, "stem", 3).select("ord", "random_label")


@query("c12_uniform_labels", "cat", sql=f"""SELECT ord, CAST(floor({u("'4::'||stem")}*5) AS BIGINT) AS random_class FROM cat""")
def c12(cat):
    return split.uniform_labels(cat, "stem", 4, 5).select("ord", "random_class")
