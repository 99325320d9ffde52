"""Catalogue, prediction, point, frame, log, logit and path tables as views over the test tables.

Every view is one SELECT that Spark and DuckDB both run; ``{K}`` is the spelling of the JSON key and ``{US}`` that of microseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "cat": """SELECT o_orderkey AS ord,
  concat('run_',cast(o_custkey%20 AS varchar(20)),'__track_',cast(o_custkey AS varchar(20)),'__object_',cast(o_custkey AS varchar(20)),'__frame_',cast(o_orderkey AS varchar(20))) AS stem,
  cast(o_custkey AS varchar(20)) AS object_id, c_mktsegment AS class_name,
  CASE WHEN o_orderstatus='F' THEN 'gt-pred-same' ELSE 'gt-pred-diff' END AS bucket,
  CASE WHEN o_orderstatus='F' THEN 'curated' ELSE 'review' END AS source,
  cast(o_orderdate AS date) AS day, cast(o_orderkey%400 AS int) AS point_count,
  o_totalprice/500000 AS confidence, o_orderpriority AS prio
FROM orders JOIN customer ON o_custkey=c_custkey""",
    "pred": """SELECT c.*, class_name AS current_class,
  CASE WHEN prio<'4' THEN class_name ELSE nxt END AS predicted_class,
  CASE WHEN ord%7=0 THEN nxt ELSE class_name END AS folder_class,
  CASE WHEN prio<'4' THEN 1 ELSE 0 END AS is_match, ord%6+1 AS area
FROM (SELECT q.*, CASE class_name WHEN 'AUTOMOBILE' THEN 'BUILDING' WHEN 'BUILDING' THEN 'FURNITURE'
        WHEN 'FURNITURE' THEN 'HOUSEHOLD' WHEN 'HOUSEHOLD' THEN 'MACHINERY' ELSE 'AUTOMOBILE' END AS nxt FROM cat q) c""",
    "pts": """SELECT l_orderkey AS cloud_id,
  cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice) AS bigint) AS pt,
  l_linenumber AS view_id, l_quantity AS x, l_extendedprice/1000 AS y, l_discount*100+0.0 AS z, 1-l_tax*10 AS conf,
  ascii(l_returnflag) AS label, ascii(l_linestatus) AS part_pred
FROM lineitem""",
    "big": """SELECT l_suppkey AS cloud_id,
  cast(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey,l_partkey,l_linenumber,l_extendedprice) AS bigint) AS pt,
  l_linenumber AS view_id, l_quantity AS x, l_extendedprice/1000 AS y, l_discount*100+0.0 AS z, 1-l_tax*10 AS conf,
  ascii(l_returnflag) AS label, ascii(l_linestatus) AS part_pred
FROM lineitem""",
    "frm": """SELECT event_type AS class_name, cast(user_id AS varchar(20)) AS object_id,
  concat(event_type,'::',cast(user_id AS varchar(20))) AS group_key, event_id AS frame_id, ts,
  value AS extent, {K} AS point_count FROM events""",
    "log": """SELECT event_id, ts, {US} AS us, hour(ts) AS epoch, CASE WHEN {K}%10=0 THEN NULL ELSE value END AS secs,
  user_id%3 AS split, user_id%10 AS run, user_id, event_type, props, value FROM events""",
    "paths": """SELECT page_id, concat('root/gt-pred-diff/', regexp_extract(url,'^https?://[^/]+/([a-z]+)/([0-9]+)',1),
  '/pcds/', regexp_extract(url,'^https?://[^/]+/([a-z]+)/([0-9]+)',2), '.pcd') AS path FROM pages""",
}
_NEEDS = {"pred": ("cat",)}
_TABLES = {"cat": ("orders", "customer"), "pts": ("lineitem",), "big": ("lineitem",), "frm": ("events",), "log": ("events",), "paths": ("pages",)}
_SPARK = {"K": "cast(get_json_object(props,'$.k') AS int)", "US": "unix_micros(cast(ts AS timestamp))"}
_DUCK = {"K": "cast(json_extract_string(props,'$.k') AS int)", "US": "epoch_us(ts)"}


def _spelled(sql: str, names: dict[str, str]) -> str:
    for key, text in names.items():
        sql = sql.replace("{" + key + "}", text)
    return sql


#: Keys of the clouds of a view, and rows of a shuffle partition, about.
_CLOUDS = {"pts": "l_orderkey", "big": "l_suppkey"}
PARTITION = 131_072


def view(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> DataFrame:
    """The view over the tables of a folder, as a lazy DataFrame. ``dealt``: points lie by cloud in as many partitions as their number asks for, which the joins, windows and aggregates by
    cloud that follow keep; so a task's memory does not grow with the table."""
    if name in _NEEDS:
        parts = {n: view(spark, sf_dir, n) for n in _NEEDS[name]}
    else:
        parts = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES.get(name, (name,))}
    if name not in VIEWS:
        return parts[name]
    if dealt and name in _CLOUDS:
        n = max(spark.sparkContext.defaultParallelism, -(-parts["lineitem"].count() // PARTITION))
        parts["lineitem"] = parts["lineitem"].repartition(n, _CLOUDS[name])
    sql = _spelled(VIEWS[name], _SPARK)
    for part in parts:
        sql = sql.replace(f"FROM {part}", f"FROM {{{part}}}").replace(f"JOIN {part}", f"JOIN {{{part}}}")
    return spark.sql(sql, **parts)


def oracle(sql: str, *names: str) -> str:
    """``sql`` for DuckDB with the views it names in front."""
    order = list(dict.fromkeys(n for name in names for n in (*_NEEDS.get(name, ()), name)))
    heads = [f"{n} AS ({_spelled(VIEWS[n], _DUCK)})" for n in order if n in VIEWS]
    body = sql.strip()
    if not heads:
        return body
    return "WITH " + ",\n".join(heads) + ((",\n" + body[4:]) if body[:4].upper() == "WITH" else "\n" + body)
