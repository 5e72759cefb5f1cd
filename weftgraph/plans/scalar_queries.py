"""Queries of the scalar rules over columns made from the driver's tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from weftgraph.functions import ids, scalars
from weftgraph.operators import connect
from weftgraph.plans.registry import query


def _pick(values: tuple[str, ...], key: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _pick_sql(values: tuple[str, ...], key: str) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[{key} % {len(values)} + 1]"


# Every cell type with its kind and label, every port name with its roles.
_CELL_ROWS = """
('$add','operator','+'),('$sub','operator','−'),('$xor','operator','^'),('$reduce_xor','operator','^'),('$_XOR_','operator','^'),('$xnor','operator','~^'),('$reduce_xnor','operator','~^'),('$_XNOR_','operator','~^'),
('$and','operator','&'),('$reduce_and','operator','&'),('$_AND_','operator','&'),('$nand','operator','NAND'),('$_NAND_','operator','NAND'),('$logic_and','operator','&&'),('$or','operator','|'),('$_OR_','operator','|'),
('$nor','operator','NOR'),('$_NOR_','operator','NOR'),('$logic_or','operator','||'),('$reduce_or','operator','≥1'),('$reduce_bool','operator','≠0'),('$not','operator','~'),('$_NOT_','operator','~'),('$logic_not','operator','!'),
('$shl','operator','≪'),('$sshl','operator','≪'),('$shr','operator','≫'),('$sshr','operator','≫'),('$shift','operator','⇆'),('$shiftx','operator','⇆'),('$mul','operator','×'),('$div','operator','÷'),('$divfloor','operator','÷'),
('$mod','operator','%'),('$modfloor','operator','%'),('$pow','operator','**'),('$eq','operator','=='),('$eqx','operator','=='),('$ne','operator','!='),('$nex','operator','!='),('$lt','operator','<'),('$le','operator','≤'),
('$gt','operator','>'),('$ge','operator','≥'),('$neg','operator','−'),('$buf','operator','→'),('$_BUF_','operator','→'),('$pos','operator','+'),('$concat','operator','{}'),('$slice','operator','[]'),
('$mux','mux','MUX'),('$pmux','mux','MUX'),('$bmux','mux','MUX'),('$demux','mux','MUX'),('$dff','register','DFF'),('$dffe','register','DFF'),('$adff','register','DFF'),('$adffe','register','DFF'),('$aldff','register','DFF'),
('$aldffe','register','DFF'),('$sdff','register','DFF'),('$sdffe','register','DFF'),('$sdffce','register','DFF'),('$dlatch','latch','LATCH'),('$adlatch','latch','LATCH'),('$mem','memory','MEM'),('$mem_v2','memory','MEM'),('$memrd','memory','MEM'),
('$_MUX_','primitive','$_MUX_'),('$_DFF_P_','primitive','$_DFF_P_'),('$bwmux','unknown','$bwmux'),('$ff','unknown','$ff'),('$dffsr','unknown','$dffsr'),('$dffsre','unknown','$dffsre'),('$sr','unknown','$sr'),('$dlatchsr','unknown','$dlatchsr'),
('$odd','unknown','$odd'),('fifo','module','u_cell'),('\\fifo','module','u_cell')"""
_CELL_TYPES = re.findall(r"\('([^']+)','[a-z]+'", _CELL_ROWS)
_PORT_ROWS = """
('CLK','clock','clock'),('c','clock','clock'),('ARST','reset','reset'),('srst','reset','reset'),('ALOAD','reset','reset'),('CLR','reset','reset'),('RESET','reset','reset'),('\\RST','reset','reset'),('EN','enable','enable'),('E','enable','enable'),
('CE','enable','enable'),('S','select',NULL),('D','data','data'),('AD','data','data'),('A','data','data'),('B','data','data'),('Q','data','data'),('Y','data','data'),('ADDR','address','address'),('RD_ADDR','address','address'),
('WR_ADDR','address','address'),('DATA','data','data'),('RD_DATA','data','data'),('wr_data','data','data'),('R',NULL,NULL),('T',NULL,NULL),('other',NULL,NULL)"""
_PORT_NAMES = re.findall(r"\('([^']+)',(?:'[a-z]+'|NULL),", _PORT_ROWS)


def _each(x, values: list[str], name: str):
    """id of every part, and one of the values by its number."""
    return x.raw("part").select(F.col("p_partkey").alias("id"), _pick(tuple(values), "p_partkey").alias(name))


def _each_sql(values: list[str], name: str) -> str:
    return f"(SELECT p_partkey AS id, {_pick_sql(tuple(values), 'p_partkey')} AS {name} FROM part)"


def _rows(x, values: list[str], name: str):
    """The values as a table, made where it runs."""
    return x.spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))


@query(f"""SELECT id, type, kind, label, CASE WHEN kind = 'operator' THEN label END AS glyph, CASE WHEN kind = 'module' THEN 'fifo' END AS definition FROM (VALUES {_CELL_ROWS}) v(type, kind, label) JOIN {_each_sql(_CELL_TYPES, "type")} USING (type)""", view=False)
def classify_cells(x):
    t = F.col("type")
    return _each(x, _CELL_TYPES, "type").select("id", "type", scalars.cell_kind(t).alias("kind"), scalars.cell_label(F.lit("\\u_cell"), t).alias("label"), scalars.cell_glyph(t).alias("glyph"), scalars.cell_definition(t).alias("definition"))


@query(f"""SELECT id, port, cell, CASE WHEN cell = '$mux' THEN of_mux ELSE of_other END AS role, CASE (CASE WHEN cell = '$mux' THEN of_mux ELSE of_other END) WHEN 'clock' THEN 'clock' WHEN 'reset' THEN 'reset' WHEN 'enable' THEN 'control' WHEN 'select' THEN 'control' ELSE 'data' END AS edge_role,
 CASE WHEN cell <> '$dff' AND port = 'A' THEN 0 WHEN cell <> '$dff' AND port = 'B' THEN 1 END AS operand FROM (VALUES {_PORT_ROWS}) v(port, of_mux, of_other) JOIN {_each_sql(_PORT_NAMES, "port")} USING (port), (VALUES ('$mux'), ('$modfloor'), ('$dff')) c(cell)""", view=False)
def port_roles(x):
    p = _each(x, _PORT_NAMES, "port").withColumn("cell", F.explode(F.array(F.lit("$mux"), F.lit("$modfloor"), F.lit("$dff"))))
    role = scalars.port_role(F.col("cell"), F.col("port"))
    return p.select("id", "port", "cell", role.alias("role"), scalars.edge_role(role, F.lit(None).cast("string")).alias("edge_role"), scalars.operand_index(F.col("cell"), F.col("port")).alias("operand"))


_ORDERED = ("$mux", "$sub", "$shl", "$sshl", "$shr", "$sshr", "$shift", "$shiftx", "$div", "$divfloor", "$mod", "$modfloor", "$pow", "$lt", "$le", "$gt", "$ge")


@query(f"""SELECT id, type, port, CASE WHEN type IN ({", ".join(f"'{c}'" for c in _ORDERED)}) THEN CASE port WHEN '\\a' THEN 0 WHEN 'B' THEN 1 END END AS operand FROM {_each_sql(_CELL_TYPES, "type")} v, (VALUES ('\\a'), ('B'), ('Y')) p(port)""", view=False)
def operand_indexes(x):
    t = _each(x, _CELL_TYPES, "type").withColumn("port", F.explode(F.array(F.lit("\\a"), F.lit("B"), F.lit("Y"))))
    return t.select("id", "type", "port", scalars.operand_index(F.col("type"), F.col("port")).alias("operand"))


_GLYPH_ROWS = """
('+','Add',NULL),('−','Subtract',NULL),('^','Exclusive or','xor'),('~^','Exclusive nor','xnor'),('NAND','Nand','nand'),('NOR','Nor','nor'),('&','And','and'),('&&','Logical and','and'),('|','Or','or'),('||','Logical or','or'),('≥1','Or','or'),
('≠0','Boolean reduction','or'),('~','Bitwise not','not'),('!','Logical not','not'),('≪','Shift left',NULL),('≫','Shift right',NULL),('×','Multiply',NULL),('÷','Divide',NULL),('%','Modulo',NULL),('⇆','Dynamic shift',NULL),('**','Power',NULL),('==','Equal',NULL),
('!=','Not equal',NULL),('<','Less than',NULL),('≤','Less than or equal',NULL),('>','Greater than',NULL),('≥','Greater than or equal',NULL),('→','Buffer','buffer'),('{}','Concatenate',NULL),('[]','Slice',NULL),('@','Operator @',NULL)"""


_GLYPHS = re.findall(r"\('([^']+)','[^']+',", _GLYPH_ROWS)


@query(f"SELECT id, glyph, name, gate FROM (VALUES {_GLYPH_ROWS}) v(glyph, name, gate) JOIN {_each_sql(_GLYPHS, 'glyph')} USING (glyph)", view=False)
def operator_names(x):
    g = _each(x, _GLYPHS, "glyph")
    return g.select("id", "glyph", scalars.operator_name(F.col("glyph")).alias("name"), scalars.gate_class(F.col("glyph")).alias("gate"))


@query("""SELECT DISTINCT event_type AS raw, CASE lower(event_type) WHEN 'input' THEN 'input' ELSE 'unknown' END AS direction, 'inout' AS shown FROM events
 UNION ALL SELECT * FROM (VALUES ('INPUT', 'input', 'input'), ('output', 'output', 'output'), ('InOut', 'inout', 'inout'), ('', 'unknown', 'inout'))""", view=False)
def port_directions(x):
    raw = x.raw("events").select(F.col("event_type").alias("raw")).distinct().union(_rows(x, ["INPUT", "output", "InOut", ""], "raw"))
    return raw.select("raw", scalars.port_direction(F.col("raw")).alias("direction"), scalars.shown_direction(scalars.port_direction(F.col("raw"))).alias("shown"))


@query("""SELECT event_id AS id, NOT (a < 1 OR b < 1 OR c < 1 OR d < 1 OR c < a OR (c = a AND d <= b)) AS valid, (a <= c + 2 AND c - 1 <= a) AS same_lines,
 (a > 2 OR (a = 2 AND b >= 2)) AND (c < 6 OR (c = 6 AND d <= 4)) AS inside FROM (SELECT event_id, event_id % 7 AS a, user_id % 5 AS b, event_id % 9 AS c, user_id % 6 AS d FROM events)""", view=False)
def range_rules(x):
    e = x.raw("events").select("event_id", (F.col("event_id") % 7).alias("a"), (F.col("user_id") % 5).alias("b"), (F.col("event_id") % 9).alias("c"), (F.col("user_id") % 6).alias("d"))
    a, b, c, d = map(F.col, "abcd")
    return e.select(
        F.col("event_id").alias("id"), scalars.valid_range(a, b, c, d).alias("valid"), scalars.lines_overlap(a, a, c - 1, c + 2).alias("same_lines"), scalars.contains((F.lit(2).cast("long"), F.lit(2).cast("long"), F.lit(6).cast("long"), F.lit(4).cast("long")), (a, b, c, d)).alias("inside")
    )


@query("""SELECT n_name AS module, w AS wanted, CASE WHEN w <> 'auto' THEN w WHEN (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + 2 * (SELECT count(*) FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) >= 2000 THEN 'fast' ELSE 'detailed' END AS profile
 FROM nation, (VALUES ('auto'), ('wide')) p(w)""", view=False)
def layout_profiles(x):
    kids = x.raw("customer").groupBy("c_nationkey").agg(F.count("*").alias("nodes"))
    wires = x.raw("orders").join(x.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("edges"))
    n = x.raw("nation").withColumn("c_nationkey", F.col("n_nationkey")).join(kids, "c_nationkey", "left").join(wires, "c_nationkey", "left").fillna(0, ["nodes", "edges"])
    n = n.withColumn("wanted", F.explode(F.array(F.lit("auto"), F.lit("wide"))))
    return n.select(F.col("n_name").alias("module"), "wanted", scalars.layout_profile(F.col("wanted"), F.col("nodes"), F.col("edges")).alias("profile"))


_TEXTS = """
('',''),('A','a'),('a','b'),('a','ab'),('__','__'),('Foo Bar','foobar'),('é','è'),('abc','abd'),('aaaa','aa'),('x$1','X$1'),('clk_i','clk'),(NULL,'a'),('a',NULL),('- -','---'),('n','N!')"""
_PAIRS = [[None if v == "NULL" else v[1:-1] for v in p] for p in re.findall(r"\((NULL|'[^']*'),(NULL|'[^']*')\)", _TEXTS)]
_LIST = lambda i: "([" + ", ".join("NULL" if p[i] is None else f"'{p[i]}'" for p in _PAIRS) + f"])[p_partkey % {len(_PAIRS)} + 1]"


@query(f"""WITH v AS (SELECT p_partkey AS id, {_LIST(0)} AS a, {_LIST(1)} AS b FROM part), p AS (SELECT *, regexp_replace(lower(coalesce(a, '')), '[^a-z0-9_$]', '', 'g') AS x, regexp_replace(lower(coalesce(b, '')), '[^a-z0-9_$]', '', 'g') AS y FROM v),
g AS (SELECT id, unnest(list_transform(range(1, length(x)), lambda i: substring(x, i, 2))) AS g, 1 AS u, 0 AS w FROM p UNION ALL SELECT id, unnest(list_transform(range(1, length(y)), lambda i: substring(y, i, 2))), 0, 1 FROM p),
c AS (SELECT id, sum(least(u, w)) AS n FROM (SELECT id, g, sum(u) AS u, sum(w) AS w FROM g GROUP BY ALL) GROUP BY ALL)
SELECT p.id, p.a, p.b, round(CASE WHEN coalesce(p.a, '') = '' OR coalesce(p.b, '') = '' THEN 0 WHEN p.a = p.b THEN 1 WHEN x = '' OR y = '' THEN 0 WHEN x = y THEN 1 WHEN length(x) = 1 OR length(y) = 1 THEN 0
 ELSE 2.0 * coalesce(n, 0) / (length(x) + length(y) - 2) END, 6)::DOUBLE AS similarity FROM p LEFT JOIN c ON c.id = p.id""", view=False)
def string_similarity_edges(x):
    at = (F.col("p_partkey") % len(_PAIRS) + 1).cast("int")
    p = x.raw("part").select(F.col("p_partkey").alias("id"), *(F.element_at(F.array(*(F.lit(v[i]).cast("string") for v in _PAIRS)), at).alias(n) for i, n in enumerate("ab")))
    return p.select("id", "a", "b", F.round(scalars.string_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("SELECT p_partkey AS id, concat('3''b', CASE WHEN p_size % 8 = 0 THEN '0' ELSE concat((p_size // 4) % 2, (p_size // 2) % 2, p_size % 2) END) AS label FROM part", view=False)
def constant_labels(x):
    bit = lambda k: (F.floor(F.col("p_size") / k) % 2).cast("string")
    return x.raw("part").select(F.col("p_partkey").alias("id"), scalars.constant_label(F.array(bit(1), bit(2), bit(4))).alias("label"))


@query("SELECT id, CASE WHEN length(s) > 24 THEN substring(s, 1, 24) || '…' ELSE s END AS short FROM (SELECT c_custkey AS id, string_split_regex(concat('top::', c_mktsegment, '.', c_name, CASE WHEN c_custkey % 2 = 0 THEN '_first_stage' ELSE '' END), '::|\\.|/')[-1] AS s FROM customer)", view=False)
def short_names(x):
    name = F.concat(F.lit("top::"), "c_mktsegment", F.lit("."), "c_name", F.when(F.col("c_custkey") % 2 == 0, "_first_stage").otherwise(""))
    return x.raw("customer").select(F.col("c_custkey").alias("id"), scalars.short_name(name).alias("short"))


@query(r"""SELECT page_id AS id, p AS path, (length(p) > 0 AND NOT contains(p, '\') AND len(list_filter(string_split(p, '/'), lambda q: q IN ('', '.', '..'))) = 0) AS safe FROM
 (SELECT page_id, regexp_replace(regexp_replace(replace(concat('.\', url), '\', '/'), '^\./', ''), '/+', '/', 'g') AS p FROM pages)""", view=False)
def path_forms(x):
    p = x.raw("pages").select(F.col("page_id").alias("id"), scalars.normal_path(F.concat(F.lit(".\\"), "url")).alias("path"))
    return p.select("id", "path", scalars.safe_path(F.col("path")).alias("safe"))


@query("""WITH p AS (SELECT n_nationkey AS id, n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT id, 0 AS side, unnest(list_transform(range(1, length(s)), lambda i: substring(s, i, 2))) AS g FROM (SELECT id, regexp_replace(lower(a), '[^a-z0-9_$]', '', 'g') AS s FROM p)
 UNION ALL SELECT id, 1, unnest(list_transform(range(1, length(s)), lambda i: substring(s, i, 2))) FROM (SELECT id, regexp_replace(lower(b), '[^a-z0-9_$]', '', 'g') AS s FROM p)),
c AS (SELECT id, g, sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS x, sum(side) AS y FROM g GROUP BY ALL)
SELECT p.id, round(CASE WHEN p.a = p.b THEN 1.0 ELSE 2.0 * sum(least(x, y)) / sum(x + y) END, 6)::DOUBLE AS similarity FROM p JOIN c USING (id) GROUP BY p.id, p.a, p.b""", view=False)
def string_similarity(x):
    p = x.raw("nation").join(x.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return p.select(F.col("n_nationkey").alias("id"), F.round(scalars.string_similarity(F.col("n_name"), F.col("r_name")), 6).alias("similarity"))


_JSON = ("true", "0", "3", '"1"', '"000"', "1.5", "null", '"01x"')


@query(f"SELECT event_id AS id, v IN ('true', '3', '\"1\"', '\"01x\"') AS truth FROM (SELECT event_id, {_pick_sql(_JSON, 'event_id')} AS v FROM events)", view=False)
def truthiness(x):
    return x.raw("events").select(F.col("event_id").alias("id"), scalars.is_true(_pick(_JSON, "event_id")).alias("truth"))


@query("""SELECT event_id AS id, concat(event_type, '.sv') AS file, event_id % 90 + 1 AS start_line, user_id % 9 + 1 AS start_col, event_id % 90 + 3 AS end_line, 5::BIGINT AS end_col FROM events
 UNION ALL SELECT event_id, 'c:/x.sv', 7, 2, 7, NULL FROM events WHERE event_id % 2 = 0""", view=False)
def source_attributes(x):
    own = F.concat("event_type", F.lit(".sv:"), F.col("event_id") % 90 + 1, F.lit("."), F.col("user_id") % 9 + 1, F.lit("-"), F.col("event_id") % 90 + 3, F.lit(".5"))
    text = F.concat(own, F.when(F.col("event_id") % 2 == 0, "|c:/x.sv:7.2").otherwise("|nowhere"))
    return x.raw("events").select(F.col("event_id").alias("id"), F.explode(scalars.source_ranges(text)).alias("r")).select("id", "r.*")


@query("""SELECT id AS node_id, concat('node-', lpad(lower(to_hex(CAST(list_reduce(list_concat([14695981039346656037::HUGEINT], list_transform(string_split('node', ''), lambda c: ord(c)::HUGEINT), [255::HUGEINT], list_transform(string_split(id, ''), lambda c: ord(c)::HUGEINT)),
 lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS UBIGINT))), 16, '0')) AS stable_id FROM ref_nodes WHERE kind IN ('module', 'input')""")
def stable_ids(x):
    return x.ref_nodes().where("kind in ('module', 'input')").select(F.col("id").alias("node_id"), ids.stable_id("node", F.col("id")).alias("stable_id"))


@query("SELECT path, sha256 FROM sources")
def source_digests(x):
    return x.sources().select("path", "sha256")


@query("""SELECT id, pos - r AS run, min(pos) AS first, string_agg(b, '' ORDER BY pos) AS digits FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS r FROM (
 SELECT p_partkey AS id, i AS pos, CAST(i % 2 AS VARCHAR) AS b FROM part, range(8) t(i) WHERE (p_partkey >> i) % 2 = 1)) GROUP BY id, pos - r""", view=False)
def constant_runs(x):
    pos = F.explode(F.sequence(F.lit(0), F.lit(7)))
    bits = x.raw("part").select(F.col("p_partkey").alias("cell"), F.lit("A").alias("port"), pos.alias("pos")).withColumn("constant", F.when(F.expr("shiftright(cell, pos)") % 2 == 1, (F.col("pos") % 2).cast("string")))
    runs = connect.constant_runs(bits)
    held = runs.select(F.col("cell").alias("id"), "first", F.array_join("digits", "").alias("digits"))
    w = F.sum(F.length("digits")).over(connect.Window.partitionBy("id").orderBy("first").rowsBetween(connect.Window.unboundedPreceding, -1))
    return held.select("id", (F.col("first") - F.coalesce(w, F.lit(0)) - 1).alias("run"), F.col("first").cast("long").alias("first"), "digits")


@query("SELECT p_partkey AS id, CAST(i AS INTEGER) AS part, [p_size, p_size + i] AS bits FROM part, range(3) t(i) WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 0, [p_size, p_size, p_size, p_size + 1, p_size] FROM part WHERE p_partkey % 2 = 1", view=False)
def packed_ports(x):
    s = F.col("p_size")
    even = F.array(s, s, s, s + 1, s, s + 2)
    p = x.raw("part").select(F.col("p_partkey").alias("id"), F.lit(2).alias("by"), F.when(F.col("p_partkey") % 2 == 0, even).otherwise(F.slice(even, 1, 5)).alias("bits"))
    return connect.split_port(p, "bits", "by").select("id", "part", "bits")
