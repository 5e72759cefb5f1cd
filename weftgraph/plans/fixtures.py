"""A graph view of the driver's tables: a reference snapshot and an edited candidate, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.operators.matching import Graph


class Fixture:
    """Lazy tables of both snapshots for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def ref_nodes(self) -> DataFrame:
        def rows(table: str, prefix: str, key: str, kind: str, label: str, definition, parent, width) -> DataFrame:
            none = F.lit(None).cast("string")
            return self.raw(table).select(
                F.concat(F.lit(prefix), key).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("label"), (none if definition is None else definition).alias("definition_name"),
                (none if parent is None else parent).alias("parent_id"), width.cast("long").alias("width"),
            )

        up = lambda prefix, key: F.concat(F.lit(prefix), F.col(key))
        return (
            rows("region", "region:", "r_regionkey", "module", "r_name", F.lit("region"), None, F.lit(0))
            .union(rows("nation", "nation:", "n_nationkey", "module", "n_name", F.lit("nation"), up("region:", "n_regionkey"), F.lit(0)))
            .union(rows("customer", "customer:", "c_custkey", "module", "c_name", F.col("c_mktsegment"), up("nation:", "c_nationkey"), F.lit(1)))
            .union(rows("supplier", "supplier:", "s_suppkey", "input", "s_name", None, up("nation:", "s_nationkey"), F.lit(1)))
            .union(rows("part", "part:", "p_partkey", "operator", "p_type", F.col("p_brand"), None, F.col("p_size")))
            .union(rows("orders", "order:", "o_orderkey", "register", "o_orderpriority", F.col("o_orderstatus"), up("customer:", "o_custkey"), F.lit(1)))
        )

    @staticmethod
    def _key(c: str, prefix: str):
        return F.when(F.col(c).startswith(prefix), F.expr(f"try_cast(substring({c}, {len(prefix) + 1}) as bigint)"))

    def cand_nodes(self) -> DataFrame:
        n = self.ref_nodes()
        cust = lambda c: F.when(self._key(c, "customer:") % 10 == 3, F.concat(F.lit("v2-"), F.col(c))).otherwise(F.col(c))
        op = F.col("kind") == "operator"
        kept = n.where(~F.coalesce(self._key("id", "order:") % 50 == 7, F.lit(False))).select(
            cust("id").alias("id"), "kind", F.when(op & (F.col("width") % 7 == 0), F.concat("label", F.lit("_X"))).otherwise(F.col("label")).alias("label"), "definition_name",
            cust("parent_id").alias("parent_id"), F.when(op & (F.col("width") % 5 == 0), F.col("width") + 1).otherwise(F.col("width")).alias("width"),
        )
        new = n.where(self._key("id", "order:") % 100 == 11).select(F.concat(F.lit("order:new-"), F.substring("id", 7, 30)).alias("id"), "kind", "label", "definition_name", cust("parent_id").alias("parent_id"), "width")
        return kept.union(new)

    def ref_edges(self, parts: int | None = None) -> DataFrame:
        lines = self.raw("lineitem").select("l_orderkey", "l_partkey")
        e = (lines.repartition(parts, "l_orderkey", "l_partkey") if parts else lines).groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("width"))
        return self._named(e.select(F.concat(F.lit("order:"), "l_orderkey").alias("source_node"), F.concat(F.lit("part:"), "l_partkey").alias("target_node"), "width"))

    @staticmethod
    def _named(e: DataFrame) -> DataFrame:
        return e.select(F.concat(F.lit("e:"), "source_node", F.lit(">"), "target_node").alias("id"), "source_node", "target_node", F.col("width").cast("long").alias("width"))

    def cand_edges(self) -> DataFrame:
        parts = self.raw("part").select(F.col("p_partkey").alias("next"))
        e = self.ref_edges().withColumns({"o": self._key("source_node", "order:"), "p": self._key("target_node", "part:")}).where("o % 50 <> 7")
        e = e.withColumn("next", F.when(F.col("p") % 11 == 0, F.col("p") + 1)).join(parts.withColumn("there", F.lit(1)), "next", "left")
        e = e.withColumn("target_node", F.when(F.col("there") == 1, F.concat(F.lit("part:"), F.col("next"))).otherwise(F.col("target_node")))
        return self._named(e.groupBy("source_node", "target_node").agg(F.sum("width").alias("width")))

    def ports(self, side: str) -> DataFrame:
        p, k = self.raw("part"), F.col("p_partkey")
        width = F.col("p_size").cast("long") + (F.when(F.col("p_size") % 5 == 0, 1).otherwise(0) if side == "cand" else 0)
        a, b = (F.when(k % 13 == 0, "A2").otherwise("A"), F.when(k % 17 == 0, "B9").otherwise("B")) if side == "cand" else (F.lit("A"), F.lit("B"))
        port = lambda pid, name, direction, index: F.struct(pid.alias("port_id"), name.alias("name"), F.lit(direction).alias("direction"), F.lit(index).cast("long").alias("index"), F.lit("data").alias("role"), width.alias("width"))
        three = F.array(port(a, F.lit("A"), "input", 0), port(b, b, "input", 1), port(F.lit("Y"), F.lit("Y"), "output", None))
        return p.select(F.concat(F.lit("part:"), k).alias("node_id"), F.explode(three).alias("x")).select("node_id", "x.*")

    def _renamed(self, c: str) -> Column:
        """Ids that the candidate's module graph gives to some orders and suppliers."""
        hit = F.coalesce(self._key(c, "order:") % 50 == 13, F.lit(False)) | F.coalesce(self._key(c, "supplier:") % 8 == 5, F.lit(False))
        return F.when(hit, F.concat(F.lit("v2-"), F.col(c))).otherwise(F.col(c))

    def graph(self, side: str) -> Graph:
        """Module graphs of one side: ``top``, made of all tables, and ``aux``, chains of the nations of a region."""
        cand, nodes = side == "cand", self.cand_nodes() if side == "cand" else self.ref_nodes()
        part, own_id = self._key("id", "part:"), F.regexp_replace("id", "^v2-", "").alias("own")
        nodes = nodes.select("*", part.alias("p"), own_id).withColumns({"c": self._key("own", "customer:"), "s": self._key("id", "supplier:")})
        # The guard is needed: the element at a null place of a literal array is not null everywhere.
        glyph = F.when(F.col("p").isNotNull(), F.element_at(F.array(*map(F.lit, ("+", "−", "&", "|"))), (F.col("p") % 4 + 1).cast("int")))
        width = F.col("c") % 7 + (F.when(F.col("c") % 12 == 5, 1).otherwise(0) if cand else 0)
        label = F.when(F.col("s") % 8 == 5, F.concat(F.lit("S"), F.col("s"))).otherwise(F.col("label")) if cand else F.col("label")
        top = nodes.select(
            F.lit("top").alias("scope"), (self._renamed("id") if cand else F.col("id")).alias("id"), "kind", label.alias("label"),
            (F.when(F.col("p") % 23 == 1, "×").otherwise(glyph) if cand else glyph).alias("glyph"), "definition_name",
            F.when(F.col("c").isNotNull(), F.concat(F.lit('{"A":1,"W":"'), width, F.lit('"}')) if cand else F.concat(F.lit('{"W":"'), width, F.lit('","A":1}'))).alias("parameters_json"),
        )
        w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
        chain = self.raw("nation").select("*", F.row_number().over(w).alias("r"), F.lead("n_nationkey").over(w).alias("next"))
        name = lambda k, first: F.concat(F.when(first, F.lit("")).otherwise(F.lit("m-")) if cand else F.lit(""), F.lit("nation:"), k)
        none = F.lit(None).cast("string")
        aux = chain.select(F.lit("aux").alias("scope"), name(F.col("n_nationkey"), F.col("r") == 1).alias("id"), F.lit("register").alias("kind"), F.col("n_name").alias("label"), none.alias("glyph"), none.alias("definition_name"), (F.lit("{}") if cand else none).alias("parameters_json"))
        links = chain.where("next is not null").select(
            F.lit("aux").alias("scope"), F.concat(F.lit("c:"), "n_nationkey").alias("id"), name(F.col("n_nationkey"), F.col("r") == 1).alias("source_node"), none.alias("source_port"), name(F.col("next"), F.lit(False)).alias("target_node"), none.alias("target_port"),
            F.lit("q").alias("label"), F.lit(1).cast("long").alias("width"), F.lit("logic").alias("signal_type"), F.lit("data").alias("role"),
        )
        e = self.raw("lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("l")).agg(F.count("*").alias("width"))
        o, p, q, ln = F.col("o"), F.col("p"), F.col("p"), F.col("l")
        own = F.concat_ws(":", F.lit("e"), o, p, ln)
        a, b, label, kind = F.lit("A"), F.lit("B"), F.concat(F.lit("n"), p % 10), F.lit("logic")
        if cand:
            there = self.raw("part").select(F.col("p_partkey").alias("next"), F.lit(1).alias("there"))
            # Every row has a key, so that none gathers in one task; those that don't move have their own, which counts for nothing.
            e = e.where("o % 50 <> 7").withColumn("next", F.when(p % 11 == 0, p + 1).otherwise(-1 - p)).join(there, "next", "left")
            q = F.when((F.col("there") == 1) & (p % 11 == 0), F.col("next")).otherwise(p)
            own = F.when((ln == 3) & (o % 9 == 2), F.concat(F.lit("v2-"), own)).otherwise(own)
            a, b = F.when(q % 13 == 0, "A2").otherwise("A"), F.when(q % 17 == 0, "B9").otherwise("B")
            label, kind = F.when(o % 40 == 1, "x").otherwise(label), F.when(o % 40 == 2, "bit").otherwise("logic")
        source = F.concat(F.when(o % 50 == 13, "v2-order:").otherwise("order:") if cand else F.lit("order:"), o)
        wires = e.select(
            F.lit("top").alias("scope"), own.alias("id"), source.alias("source_node"), none.alias("source_port"), F.concat(F.lit("part:"), q).alias("target_node"),
            F.when(ln % 2 == 0, a).otherwise(b).alias("target_port"), label.alias("label"), F.col("width").cast("long").alias("width"), kind.alias("signal_type"), F.lit("data").alias("role"),
        )
        s = F.col("s_suppkey")
        place = self.raw("supplier").select(F.lit("top").alias("scope"), F.concat(F.when(s % 8 == 5, "v2-supplier:").otherwise("supplier:") if cand else F.lit("supplier:"), s).alias("id"), F.concat(F.lit("sup/"), "s_nationkey", F.lit(".sv")).alias("file"), (s + (3 if cand else 0)).alias("line"))
        return Graph(top.union(aux), self.ports(side).withColumn("scope", F.lit("top")), wires.unionByName(links), place)

    def line_map(self) -> DataFrame:
        s, path = F.col("s_suppkey"), F.concat(F.lit("./sup/"), "s_nationkey", F.lit(".sv"))
        return self.raw("supplier").where(s % 16 != 13).select(path.alias("ref_path"), s.alias("ref_line"), path.alias("cand_path"), (s + 3).alias("cand_line"))

    def groups(self, side: str) -> DataFrame:
        k = F.col("n_nationkey")
        cand = side == "cand"
        gid = F.concat(F.when(k % 5 == 0, "group:v2-").otherwise("group:") if cand else F.lit("group:"), k.cast("string"))
        value = F.concat(F.lit('"W":'), k + F.when(k % 6 == 1, 1).otherwise(0) if cand else k)
        given = F.concat(F.lit('{"A":[1],'), value, F.lit("}")) if cand else F.concat(F.lit("{"), value, F.lit(',"A": [1]}'))
        base = [gid.alias("group_id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("definition_name")]
        top = self.raw("nation").select(F.lit("top").alias("scope"), *base, given.alias("parameters_json"))
        # The same ids in another module pair; some groups are new there.
        aux = self.raw("nation").where(F.lit(True) if cand else k % 4 != 3).select(F.lit("aux").alias("scope"), *base, F.lit("{}" if cand else None).cast("string").alias("parameters_json"))
        return top.union(aux)

    def children(self, side: str) -> DataFrame:
        n, c = F.col("c_nationkey"), F.col("c_custkey")
        gid = F.concat(F.when(n % 5 == 0, "group:v2-").otherwise("group:") if side == "cand" else F.lit("group:"), n.cast("string"))
        kid = F.concat(F.when(c % 10 == 3, "v2-customer:").otherwise("customer:") if side == "cand" else F.lit("customer:"), c.cast("string"))
        rows = self.raw("customer")
        return (rows.where(~((n % 7 == 0) & (c % 10 == 1))) if side == "cand" else rows).select(F.lit("top").alias("scope"), gid.alias("group_id"), kid.alias("child_node_id"))

    def sources(self) -> DataFrame:
        return self.raw("documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.sha2("text", 256).alias("sha256"), "doc_id", "text")


CTES = """
ref_nodes AS (
  SELECT concat('region:', r_regionkey) AS id, 'module' AS kind, r_name AS label, 'region' AS definition_name, CAST(NULL AS VARCHAR) AS parent_id, CAST(0 AS BIGINT) AS width FROM region
  UNION ALL SELECT concat('nation:', n_nationkey), 'module', n_name, 'nation', concat('region:', n_regionkey), 0 FROM nation
  UNION ALL SELECT concat('customer:', c_custkey), 'module', c_name, c_mktsegment, concat('nation:', c_nationkey), 1 FROM customer
  UNION ALL SELECT concat('supplier:', s_suppkey), 'input', s_name, NULL, concat('nation:', s_nationkey), 1 FROM supplier
  UNION ALL SELECT concat('part:', p_partkey), 'operator', p_type, p_brand, NULL, p_size FROM part
  UNION ALL SELECT concat('order:', o_orderkey), 'register', o_orderpriority, o_orderstatus, concat('customer:', o_custkey), 1 FROM orders),
keyed AS (SELECT *, CASE WHEN id LIKE 'customer:%' THEN TRY_CAST(substring(id, 10) AS BIGINT) END AS ck, CASE WHEN parent_id LIKE 'customer:%' THEN TRY_CAST(substring(parent_id, 10) AS BIGINT) END AS pck,
  CASE WHEN id LIKE 'order:%' THEN TRY_CAST(substring(id, 7) AS BIGINT) END AS ok FROM ref_nodes),
cand_nodes AS (
  SELECT CASE WHEN ck % 10 = 3 THEN 'v2-' || id ELSE id END AS id, kind, CASE WHEN kind = 'operator' AND width % 7 = 0 THEN label || '_X' ELSE label END AS label, definition_name,
    CASE WHEN pck % 10 = 3 THEN 'v2-' || parent_id ELSE parent_id END AS parent_id, CASE WHEN kind = 'operator' AND width % 5 = 0 THEN width + 1 ELSE width END AS width
  FROM keyed WHERE ok IS NULL OR ok % 50 <> 7
  UNION ALL SELECT 'order:new-' || substring(id, 7), kind, label, definition_name, CASE WHEN pck % 10 = 3 THEN 'v2-' || parent_id ELSE parent_id END, width FROM keyed WHERE ok % 100 = 11),
ref_pairs AS (SELECT l_orderkey AS o, l_partkey AS p, count(*) AS width FROM lineitem GROUP BY 1, 2),
ref_edges AS (SELECT concat('e:order:', o, '>part:', p) AS id, concat('order:', o) AS source_node, concat('part:', p) AS target_node, width FROM ref_pairs),
cand_pairs AS (SELECT o, CASE WHEN p % 11 = 0 AND p + 1 IN (SELECT p_partkey FROM part) THEN p + 1 ELSE p END AS q, CAST(sum(width) AS BIGINT) AS width FROM ref_pairs WHERE o % 50 <> 7 GROUP BY 1, 2),
cand_edges AS (SELECT concat('e:order:', o, '>part:', q) AS id, concat('order:', o) AS source_node, concat('part:', q) AS target_node, width FROM cand_pairs),
sources AS (SELECT concat(source, '/', doc_id, '.txt') AS path, sha256(text) AS sha256, doc_id, text FROM documents)
"""


#: Rounds of the structural stage that the SQL spells out; the fixture needs four.
ROUNDS = 5


def _round(k: int) -> str:
    """One synchronous round: keys of unmatched nodes from the matches before it, held once on each side."""

    def keyed(side: str, own: str) -> str:
        toks = f"""SELECT n.scope, n.id, n.kind, n.glyph, n.sig, string_agg(concat_ws('/', x.dir, m.cand_id, x.own, x.far), ';' ORDER BY concat_ws('/', x.dir, m.cand_id, x.own, x.far)) AS toks FROM {side}n n
   JOIN {side}x x ON x.scope = n.scope AND x.id = n.id JOIN m{k - 1} m ON m.scope = x.scope AND m.{own} = x.other WHERE NOT EXISTS (SELECT 1 FROM m{k - 1} t WHERE t.scope = n.scope AND t.{own} = n.id) GROUP BY ALL"""
        return f"SELECT scope, kind, glyph, sig, toks, min(id) AS id FROM ({toks}) GROUP BY scope, kind, glyph, sig, toks HAVING count(*) = 1"

    return f"""m{k} AS MATERIALIZED (SELECT * FROM m{k - 1} UNION ALL SELECT r.scope, r.id, c.id, 'structural', 0.9::DOUBLE FROM ({keyed("r", "ref_id")}) r JOIN ({keyed("c", "cand_id")}) c
  ON r.scope = c.scope AND r.kind = c.kind AND r.glyph IS NOT DISTINCT FROM c.glyph AND r.sig = c.sig AND r.toks = c.toks)"""


_LEFT = lambda side, own, m: f"(SELECT n.* FROM {side}n n WHERE NOT EXISTS (SELECT 1 FROM {m} t WHERE t.scope = n.scope AND t.{own} = n.id))"
_ONCE = lambda rows, keys: f"(SELECT {keys}, min(id) AS id FROM {rows} GROUP BY {keys} HAVING count(*) = 1)"
_CHAIN = "(SELECT *, row_number() OVER w AS r, lead(n_nationkey) OVER w AS nx FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey))"
_NAMED = "scope, kind, label, CASE WHEN kind = 'module' THEN definition_name END AS d, sig"

#: Module graphs of both sides, the four certain stages, and the pairs of nodes, ports and edges.
MODULES = f""",
rn AS MATERIALIZED (SELECT 'top' AS scope, id, kind, label, CASE WHEN kind = 'operator' THEN (['+', '−', '&', '|'])[CAST(substring(id, 6) AS BIGINT) % 4 + 1] END AS glyph, definition_name,
   CASE WHEN ck IS NOT NULL THEN concat('{{"W":"', ck % 7, '","A":1}}') END AS parameters_json, CASE WHEN kind = 'operator' THEN 'P' ELSE '' END AS sig FROM keyed
  UNION ALL SELECT 'aux', concat('nation:', n_nationkey), 'register', n_name, NULL, NULL, NULL, '' FROM nation),
cand_keyed AS (SELECT *, CASE WHEN id LIKE '%customer:%' THEN CAST(string_split(id, ':')[2] AS BIGINT) END AS ck, CASE WHEN id LIKE 'order:%' THEN TRY_CAST(substring(id, 7) AS BIGINT) END AS ok,
   CASE WHEN id LIKE 'supplier:%' THEN CAST(substring(id, 10) AS BIGINT) END AS sk, CASE WHEN id LIKE 'part:%' THEN CAST(substring(id, 6) AS BIGINT) END AS pk FROM cand_nodes),
cn AS MATERIALIZED (SELECT 'top' AS scope, CASE WHEN ok % 50 = 13 OR sk % 8 = 5 THEN 'v2-' || id ELSE id END AS id, kind, CASE WHEN sk % 8 = 5 THEN concat('S', sk) ELSE label END AS label,
   CASE WHEN pk % 23 = 1 THEN '×' WHEN kind = 'operator' THEN (['+', '−', '&', '|'])[pk % 4 + 1] END AS glyph, definition_name,
   CASE WHEN ck IS NOT NULL THEN concat('{{"A":1,"W":"', ck % 7 + CASE WHEN ck % 12 = 5 THEN 1 ELSE 0 END, '"}}') END AS parameters_json, CASE WHEN kind = 'operator' THEN 'P' ELSE '' END AS sig FROM cand_keyed
  UNION ALL SELECT 'aux', concat(CASE WHEN r = 1 THEN '' ELSE 'm-' END, 'nation:', n_nationkey), 'register', n_name, NULL, NULL, '{{}}', '' FROM {_CHAIN}),
lines AS (SELECT l_orderkey AS o, l_partkey AS p, l_linenumber AS l, count(*) AS width FROM lineitem GROUP BY ALL),
re AS MATERIALIZED (SELECT 'top' AS scope, concat('e:', o, ':', p, ':', l) AS id, concat('order:', o) AS s, concat('part:', p) AS t, CASE WHEN l % 2 = 0 THEN 'A' ELSE 'B' END AS tp, concat('n', p % 10) AS label, width, 'logic' AS signal_type FROM lines
  UNION ALL SELECT 'aux', concat('c:', n_nationkey), concat('nation:', n_nationkey), concat('nation:', nx), NULL, 'q', 1, 'logic' FROM {_CHAIN} WHERE nx IS NOT NULL),
ce AS MATERIALIZED (SELECT 'top' AS scope, concat(CASE WHEN l = 3 AND o % 9 = 2 THEN 'v2-' ELSE '' END, 'e:', o, ':', p, ':', l) AS id, concat(CASE WHEN o % 50 = 13 THEN 'v2-' ELSE '' END, 'order:', o) AS s, concat('part:', q) AS t,
   CASE WHEN l % 2 = 0 THEN CASE WHEN q % 13 = 0 THEN 'A2' ELSE 'A' END ELSE CASE WHEN q % 17 = 0 THEN 'B9' ELSE 'B' END END AS tp, CASE WHEN o % 40 = 1 THEN 'x' ELSE concat('n', p % 10) END AS label, width, CASE WHEN o % 40 = 2 THEN 'bit' ELSE 'logic' END AS signal_type
   FROM (SELECT *, CASE WHEN p % 11 = 0 AND p + 1 IN (SELECT p_partkey FROM part) THEN p + 1 ELSE p END AS q FROM lines WHERE o % 50 <> 7)
  UNION ALL SELECT 'aux', concat('c:', n_nationkey), concat(CASE WHEN r = 1 THEN '' ELSE 'm-' END, 'nation:', n_nationkey), concat('m-nation:', nx), NULL, 'q', 1, 'logic' FROM {_CHAIN} WHERE nx IS NOT NULL),
rx AS MATERIALIZED (SELECT scope, s AS id, 'out' AS dir, t AS other, '-' AS own, coalesce(substring(tp, 1, 1), '-') AS far FROM re UNION ALL SELECT scope, t, 'in', s, coalesce(substring(tp, 1, 1), '-'), '-' FROM re),
cx AS MATERIALIZED (SELECT scope, s AS id, 'out' AS dir, t AS other, '-' AS own, coalesce(substring(tp, 1, 1), '-') AS far FROM ce UNION ALL SELECT scope, t, 'in', s, coalesce(substring(tp, 1, 1), '-'), '-' FROM ce),
exact AS MATERIALIZED (SELECT r.scope, r.id AS ref_id, c.id AS cand_id FROM rn r JOIN cn c ON r.scope = c.scope AND r.id = c.id AND r.kind = c.kind AND (r.kind <> 'operator' OR coalesce(r.glyph, r.label) = coalesce(c.glyph, c.label))),
named AS MATERIALIZED (SELECT r.scope, r.id AS ref_id, c.id AS cand_id FROM {_ONCE(f"(SELECT id, {_NAMED} FROM {_LEFT('r', 'ref_id', 'exact')} WHERE kind IN ('module', 'input', 'output', 'inout'))", "scope, kind, label, d, sig")} r
  JOIN {_ONCE(f"(SELECT id, {_NAMED} FROM {_LEFT('c', 'cand_id', 'exact')} WHERE kind IN ('module', 'input', 'output', 'inout'))", "scope, kind, label, d, sig")} c
  ON r.scope = c.scope AND r.kind = c.kind AND r.label = c.label AND r.d IS NOT DISTINCT FROM c.d AND r.sig = c.sig),
m_named AS (SELECT * FROM exact UNION ALL SELECT * FROM named),
sourced AS MATERIALIZED (SELECT r.scope, r.id AS ref_id, c.id AS cand_id FROM {_LEFT("r", "ref_id", "m_named")} r JOIN supplier x ON r.id = concat('supplier:', x.s_suppkey) AND r.scope = 'top' AND x.s_suppkey % 16 <> 13
  JOIN {_LEFT("c", "cand_id", "m_named")} c ON c.scope = 'top' AND c.kind = r.kind AND c.id IN (concat('supplier:', x.s_suppkey), concat('v2-supplier:', x.s_suppkey))),
m0 AS MATERIALIZED (SELECT *, 'exact' AS method, 1.0::DOUBLE AS score FROM exact UNION ALL SELECT *, 'named', 0.98::DOUBLE FROM named UNION ALL SELECT *, 'source', 0.95::DOUBLE FROM sourced),
{", ".join(_round(k) for k in range(1, ROUNDS + 1))},
matches AS MATERIALIZED (SELECT * FROM m{ROUNDS}),
port_pairs AS (SELECT m.scope, m.ref_id, m.cand_id, p.p_partkey AS k, x.port AS ref_port, CASE WHEN x.port = 'A' AND p.p_partkey % 13 = 0 THEN 'A2' WHEN x.port = 'B' AND p.p_partkey % 17 = 0 THEN 'B9' ELSE x.port END AS cand_port,
   CASE WHEN p.p_size % 5 = 0 OR (x.port = 'B' AND p.p_partkey % 17 = 0) THEN 'modified' ELSE 'unchanged' END AS status FROM matches m JOIN part p ON m.ref_id = concat('part:', p.p_partkey) AND m.cand_id = m.ref_id AND m.scope = 'top', (VALUES ('A'), ('B'), ('Y')) x(port)),
paired AS MATERIALIZED (SELECT coalesce(r.scope, c.scope) AS scope, r.id AS ref_id, c.id AS cand_id, r.method, r.score, coalesce(c.kind, r.kind) AS kind, CASE WHEN c.id IS NULL THEN r.label ELSE c.label END AS label, CASE WHEN c.id IS NULL THEN r.glyph ELSE c.glyph END AS glyph,
    CASE WHEN c.id IS NULL THEN r.definition_name ELSE c.definition_name END AS definition_name, CASE WHEN c.id IS NULL THEN r.parameters_json ELSE c.parameters_json END AS parameters_json,
    CASE WHEN c.id IS NULL THEN 'removed' WHEN r.id IS NULL THEN 'added' WHEN r.kind = c.kind AND r.label = c.label AND r.glyph IS NOT DISTINCT FROM c.glyph AND r.definition_name IS NOT DISTINCT FROM c.definition_name AND coalesce(regexp_extract(r.parameters_json, '[0-9]+"'), '') = coalesce(regexp_extract(c.parameters_json, '[0-9]+"'), '')
      AND NOT EXISTS (SELECT 1 FROM port_pairs p WHERE p.ref_id = r.id AND p.scope = r.scope AND p.status = 'modified') THEN 'unchanged' ELSE 'modified' END AS status
  FROM (SELECT n.*, m.cand_id, m.method, m.score FROM rn n LEFT JOIN matches m ON n.scope = m.scope AND n.id = m.ref_id) r FULL JOIN cn c ON r.scope = c.scope AND r.cand_id = c.id),
re_to AS MATERIALIZED (SELECT e.*, coalesce(ms.cand_id, 'ref only ' || e.s) AS s2, coalesce(mt.cand_id, 'ref only ' || e.t) AS t2, CASE WHEN e.tp IS NULL THEN '' ELSE coalesce(p.cand_port, 'ref only ' || e.tp) END AS tp2 FROM re e LEFT JOIN matches ms ON ms.scope = e.scope AND ms.ref_id = e.s
  LEFT JOIN matches mt ON mt.scope = e.scope AND mt.ref_id = e.t LEFT JOIN port_pairs p ON p.scope = e.scope AND p.ref_id = e.t AND p.ref_port = e.tp),
ce_to AS MATERIALIZED (SELECT *, coalesce(tp, '') AS tp2 FROM ce),
edge_exact AS MATERIALIZED (SELECT r.scope, r.id FROM re_to r JOIN ce_to c ON r.scope = c.scope AND r.id = c.id AND r.s2 = c.s AND r.t2 = c.t AND r.tp2 = c.tp2),
edge_met AS MATERIALIZED (SELECT scope, id AS ref_edge, id AS cand_edge, 'exact' AS method FROM edge_exact UNION ALL
  SELECT r.scope, r.id, c.id, 'structural' FROM (SELECT scope, s2, t2, tp2, min(id) AS id FROM re_to a WHERE NOT EXISTS (SELECT 1 FROM edge_exact x WHERE x.scope = a.scope AND x.id = a.id) GROUP BY ALL HAVING count(*) = 1) r
  JOIN (SELECT scope, s, t, tp2, min(id) AS id FROM ce_to a WHERE NOT EXISTS (SELECT 1 FROM edge_exact x WHERE x.scope = a.scope AND x.id = a.id) GROUP BY ALL HAVING count(*) = 1) c ON r.scope = c.scope AND r.s2 = c.s AND r.t2 = c.t AND r.tp2 = c.tp2),
edge_paired AS MATERIALIZED (SELECT coalesce(r.scope, c.scope) AS scope, r.id AS ref_edge, c.id AS cand_edge, r.method, coalesce(c.label, r.label) AS label, coalesce(c.width, r.width) AS width, coalesce(c.signal_type, r.signal_type) AS signal_type,
    CASE WHEN c.id IS NULL THEN 'removed' WHEN r.id IS NULL THEN 'added' WHEN r.label = c.label AND r.width = c.width AND r.signal_type = c.signal_type THEN 'unchanged' ELSE 'modified' END AS status
  FROM (SELECT e.*, m.cand_edge, m.method FROM re e LEFT JOIN edge_met m ON m.scope = e.scope AND m.ref_edge = e.id) r FULL JOIN ce c ON r.scope = c.scope AND r.cand_edge = c.id)
"""


def with_modules(body: str) -> str:
    own = body.lstrip().removeprefix("WITH ")
    return f"WITH RECURSIVE {CTES.rstrip()}{MODULES}{', ' if own != body.lstrip() else ''}\n{own}"


def with_view(body: str) -> str:
    own = body.lstrip().removeprefix("WITH RECURSIVE ")
    return f"WITH RECURSIVE {CTES}, {own}" if own != body.lstrip() else f"WITH RECURSIVE {CTES}\n{body}"
