"""Queries of source paths, line ranges, inventories and line mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import scalars
from weftgraph.operators import provenance
from weftgraph.plans.registry import query


@query("""SELECT DISTINCT array_to_string(parts[1:i - 1], '/') AS parent, parts[i] AS name, i = len(parts) AS is_file FROM
 (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT string_split(concat(source, '/', doc_id, '.txt'), '/') AS parts FROM documents WHERE source IS NOT NULL))""", view=False)
def source_tree(x):
    return provenance.source_tree(x.sources().where("path is not null"))


_EDIT = """WITH ref AS (SELECT doc_id, concat(source, '/', doc_id, '.txt') AS path, sha256(text) AS sha FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
cand AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'moved/' || path ELSE path END AS path, CASE WHEN doc_id % 19 = 0 THEN sha256(sha) ELSE sha END AS sha FROM ref WHERE doc_id % 23 <> 0)"""


@query(_EDIT + """, f AS (SELECT r.path AS rp, c.path AS cp, r.sha AS rs, c.sha AS cs FROM ref r FULL JOIN cand c ON r.path = c.path),
gone AS (SELECT rp, rs AS sha, count(*) OVER (PARTITION BY rs) AS n FROM f WHERE cp IS NULL), new AS (SELECT cp, cs AS sha, count(*) OVER (PARTITION BY cs) AS m FROM f WHERE rp IS NULL),
ren AS (SELECT rp, cp FROM gone JOIN new USING (sha) WHERE n = 1 AND m = 1)
SELECT rp AS ref_path, cp AS cand_path, CASE WHEN rs = cs THEN 'unchanged' ELSE 'modified' END AS status FROM f WHERE rp IS NOT NULL AND cp IS NOT NULL
UNION ALL SELECT rp, cp, 'renamed' FROM ren UNION ALL SELECT rp, NULL, 'removed' FROM gone WHERE rp NOT IN (SELECT rp FROM ren) UNION ALL SELECT NULL, cp, 'added' FROM new WHERE cp NOT IN (SELECT cp FROM ren)""", view=False)
def inventory_compare(x):
    ref = x.sources().where("path is not null and sha256 is not null").select("doc_id", "path", "sha256")
    cand = ref.where("doc_id % 23 <> 0").select(
        F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), F.when(F.col("doc_id") % 19 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256")
    )
    return provenance.inventory_compare(ref, cand)


@query("""SELECT DISTINCT s_suppkey AS hunk, c_custkey AS origin FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey % 500 <= c_custkey % 600 + c_custkey % 5 AND s_suppkey % 500 + s_suppkey % 7 >= c_custkey % 600""", view=False)
def line_overlap(x):
    spans = lambda t, key, path, wrap, most: x.raw(t).select(F.col(path).alias("path"), (F.col(key) % wrap).alias("start"), (F.col(key) % wrap + F.col(key) % most).alias("end"), F.col(key).alias("id"))
    return provenance.line_overlap(spans("supplier", "s_suppkey", "s_nationkey", 500, 7), spans("customer", "c_custkey", "c_nationkey", 600, 5))


@query("""SELECT key, line, "at", distance FROM (SELECT c_nationkey AS key, c_custkey AS line, s_suppkey * 13 AS "at", abs(c_custkey - s_suppkey * 13) AS distance, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_custkey - s_suppkey * 13), s_suppkey) AS r FROM customer JOIN supplier ON c_nationkey = s_nationkey) WHERE r = 1""", view=False)
def nearest_line(x):
    asked = x.raw("customer").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("line"))
    return provenance.nearest_line(asked, x.raw("supplier").select(F.col("s_nationkey").alias("key"), (F.col("s_suppkey") * 13).alias("at")))


@query("""SELECT event_type, min(event_id) AS start, max(event_id) AS "end", count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - row_number() OVER (PARTITION BY event_type, value > 50 ORDER BY event_id) AS g FROM events) WHERE value > 50 GROUP BY event_type, g""", view=False)
def change_islands(x):
    return provenance.islands(x.raw("events").withColumn("flag", F.coalesce(F.col("value") > 50, F.lit(False))), "event_type", "event_id", "flag").select("event_type", "start", "end", "n")


@query("SELECT c_custkey AS id, max(c_custkey % 600 + c_custkey % 9) OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 600, c_custkey % 600 + c_custkey % 9, c_custkey ROWS UNBOUNDED PRECEDING) AS reach FROM customer", view=False)
def prefix_maximum(x):
    c = x.raw("customer").select(F.col("c_custkey").alias("id"), "c_nationkey", (F.col("c_custkey") % 600).alias("s"), F.struct((F.col("c_custkey") % 600 + F.col("c_custkey") % 9).alias("e"), F.col("c_custkey").alias("k")).alias("end"))
    return provenance.prefix_maximum(c, "c_nationkey", "s", "end").select("id", F.col("reach")["e"].alias("reach"))


@query("""WITH p AS (SELECT concat(source, '/', doc_id, '.txt') AS path, doc_id FROM documents WHERE source IS NOT NULL), w AS (SELECT concat(doc_id, '.txt') AS wanted FROM p WHERE doc_id % 3 = 0 UNION SELECT './' || path FROM p WHERE doc_id % 3 = 1 UNION SELECT 'build/' || path FROM p WHERE doc_id % 7 = 2)
SELECT wanted, min(path) AS path FROM w JOIN p ON './' || path = wanted OR ends_with(path, '/' || wanted) OR ends_with(wanted, '/' || path) GROUP BY wanted HAVING count(DISTINCT path) = 1""", view=False)
def path_match(x):
    p = x.sources().where("path is not null")
    wanted = p.where("doc_id % 3 = 0").select(F.concat("doc_id", F.lit(".txt"))).union(p.where("doc_id % 3 = 1").select(F.concat(F.lit("./"), "path"))).union(p.where("doc_id % 7 = 2").select(F.concat(F.lit("build/"), "path"))).toDF("wanted")
    return provenance.unique_path_match(wanted, p)


@query("""SELECT suffix, min(path) AS path FROM (SELECT path, array_to_string(parts[i:], '/') AS suffix FROM (SELECT path, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT path, string_split(path, '/') AS parts FROM (SELECT concat(p_brand, '/', p_type, '/', p_size, '.sv') AS path FROM part)))) GROUP BY suffix HAVING count(DISTINCT path) = 1""", view=False)
def path_index(x):
    return provenance.suffix_index(x.raw("part").select(F.concat_ws("/", "p_brand", "p_type", F.concat(F.col("p_size").cast("string"), F.lit(".sv"))).alias("path")))


@query("SELECT CAST(doc_id AS VARCHAR) AS key, len(string_split(text, chr(10))) - CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS n FROM documents WHERE contains(text, chr(10))", view=False)
def line_mapping(x):
    d = x.raw("documents").where(F.contains("text", F.lit("\n")))
    pairs = d.select(F.col("doc_id").alias("key"), F.col("text").alias("ref_text"), F.when(F.col("doc_id") % 7 == 0, F.regexp_replace("text", r"^[^\n]*\n", "")).otherwise(F.col("text")).alias("cand_text"))
    return provenance.line_mapping(pairs).groupBy("key").agg(F.count("*").alias("n"))


@query("""SELECT event_id AS id, (s.l < e.l2 OR (s.l = e.l2 AND 3 < 5)) AND (e.l1 < s.l OR (e.l1 = s.l AND 2 < 9)) AS overlap, (e.l2 - e.l1) * 1000 + CASE WHEN e.l1 = e.l2 THEN 3 ELSE 0 END AS size
 FROM (SELECT event_id, struct_pack(l := event_id % 40) AS s, struct_pack(l1 := user_id % 40, l2 := user_id % 40 + event_id % 4) AS e FROM events)""", view=False)
def range_predicates(x):
    a, b, n = F.col("event_id") % 40, F.col("user_id") % 40, F.col("event_id") % 4
    over = scalars.overlaps((a, F.lit(3), a, F.lit(9)), (b, F.lit(2), b + n, F.lit(5)))
    return x.raw("events").select(F.col("event_id").alias("id"), over.alias("overlap"), scalars.range_size(b, F.lit(2), b + n, F.lit(5)).alias("size"))
