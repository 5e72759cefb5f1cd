"""What a viewer shows of a graph: control signals, flat boundaries, constants, effective settings, instance paths."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftgraph.schema import LIMITS
from weftgraph.session import materialise


def control_signals(edges: DataFrame, nodes: DataFrame, ports: DataFrame) -> DataFrame:
    """key, name, role of clock and reset signals.

    An edge (ord, id, source_node, source_port, target_node, target_port, label, role) is a control signal by its role,
    else by its label, its source's label or its ports' names, reset before clock. The signal is called by the first of
    these names that fits the role, else by label or id. Of edges with one key the last one stays.
    """
    n = nodes.select(F.col("id").alias("source_node"), F.col("label").alias("source_label"))
    port = lambda end: ports.select(F.col("node_id").alias(f"{end}_node"), F.col("port_id").alias(f"{end}_port"), F.col("name").alias(f"{end}_name"))
    own = edges.join(n, "source_node", "left").join(port("source"), ["source_node", "source_port"], "left").join(port("target"), ["target_node", "target_port"], "left")
    names = F.filter(F.array("label", "source_label", "source_name", "target_name"), lambda x: x.isNotNull() & (x != ""))
    fits = lambda pattern: F.filter(names, lambda x: F.lower(x).rlike(pattern))
    reset, clock = fits("rst|reset"), fits("clk|clock")
    role = F.when(F.col("role").isin("clock", "reset"), F.col("role")).when(F.size(reset) > 0, "reset").when(F.size(clock) > 0, "clock")
    found = own.withColumn("signal", role).where("signal is not null")
    name = F.coalesce(F.try_element_at(F.when(F.col("signal") == "reset", reset).otherwise(clock), F.lit(1)), F.col("label"), F.col("id"))
    keyed = found.select("ord", "signal", name.alias("name"), F.concat_ws(":", "signal", "source_node", name).alias("key"))
    return keyed.groupBy("key").agg(F.max_by(F.struct("name", "signal"), "ord").alias("x")).select("key", "x.name", F.col("x.signal").alias("role"))


def flat_boundaries(edges: DataFrame, boundaries: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Edges (id, source_node, source_port, target_node, target_port) with the boundaries (id, kind, ord) spliced out.

    A boundary's incoming edges meet its outgoing ones; the id, and with it the payload, comes from the outgoing edge of
    an output and from the incoming one of any other kind. Boundaries go in the order of ``ord``. Those that come before
    all boundaries they touch don't affect each other, so each round takes all of them: chains need rounds by their
    rises in ``ord``, not by their number. Self-loops of a boundary vanish. Edges that share an id afterwards get
    ``~flat-`` and a number, in the order of their ends.
    """
    left = boundaries.select(F.col("id").alias("node"), "kind", F.col("ord").alias("at"))
    now = edges.select("id", "source_node", "source_port", "target_node", "target_port").withColumn("spliced", F.lit(False))
    side = lambda end: left.select(F.col("node").alias(end), F.col("at").alias(f"{end}_at"), F.col("kind").alias(f"{end}_kind"))
    for _ in range(most_rounds):
        held = materialise(now.join(side("source_node"), "source_node", "left").join(side("target_node"), "target_node", "left"), "flat-edges")
        ends = held.where("source_node <> target_node and (source_node_at is not null or target_node_at is not null)")
        touch = ends.select(F.col("source_node").alias("node"), F.col("source_node_at").alias("at"), F.col("target_node_at").alias("other")).union(ends.select("target_node", "target_node_at", "source_node_at"))
        first = touch.where("at is not null").groupBy("node").agg(F.first("at").alias("at"), F.min("other").alias("other")).where("other is null or at < other").select("node")
        if first.isEmpty():
            now = held.where("source_node_at is null or source_node <> target_node")
            break
        gone = materialise(first, "flat-first")
        into = held.join(gone.select(F.col("node").alias("target_node")), "target_node", "left_semi").where("source_node <> target_node")
        out = held.join(gone.select(F.col("node").alias("source_node")), "source_node", "left_semi").where("source_node <> target_node")
        met = into.alias("i").join(out.alias("o"), F.col("i.target_node") == F.col("o.source_node"))
        spliced = met.select(
            F.when(F.col("i.target_node_kind") == "output", F.col("o.id")).otherwise(F.col("i.id")).alias("id"),
            "i.source_node", "i.source_port", "o.target_node", "o.target_port", F.lit(True).alias("spliced"),
        )
        rest = held.join(gone.select(F.col("node").alias("target_node")), "target_node", "left_anti").join(gone.select(F.col("node").alias("source_node")), "source_node", "left_anti")
        now = rest.select(spliced.columns).union(spliced)
    else:
        raise RuntimeError(f"boundaries left after {most_rounds} rounds")
    n = F.row_number().over(Window.partitionBy("id").orderBy("spliced", "source_node", "target_node", "source_port", "target_port"))
    named = F.when(n > 1, F.concat("id", F.lit("~flat-"), (n - 2).cast("string"))).otherwise(F.col("id"))
    return now.select(named.alias("id"), F.col("id").alias("payload"), "source_node", "source_port", "target_node", "target_port")


@F.pandas_udf(StringType())
def _decimal(bits: pd.Series) -> pd.Series:
    return bits.map(lambda b: None if b is None else str(int(b, 2)))


def _let(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made(value)`` with the value worked out once a row, however often it is named."""
    return F.transform(F.array(value), made)[0]


def constant_literal(literal: Column, radix: str) -> Column:
    """A binary literal (``8'b0101``) as binary, hex or decimal; any other text, and widths out of bounds, stay as they are.

    Missing digits are zeros, or the digit itself where it is a lone x or z. Unknown bits keep a number binary unless all
    are alike, or, in hex, alike within each digit.
    """
    form = r"^\s*([0-9]+)'[bB]([01xXzZ?_]+)\s*$"
    width = F.regexp_extract(literal, form, 1).try_cast("long")
    read = F.struct(width.alias("width"), F.translate(F.lower(F.regexp_extract(literal, form, 2)), "?_", "x").alias("digits"))

    def sized(r: Column) -> Column:
        held = (r.width >= 1) & (r.width <= LIMITS["constant_bits"]) & (F.length(r.digits) <= r.width)
        size = F.when(F.coalesce(held, F.lit(False)), r.width.cast("int"))
        return F.struct(size.alias("size"), F.when(r.digits.isin("x", "z"), F.repeat(r.digits, size)).otherwise(F.lpad(r.digits, size, F.lit("0"))).alias("bits"))

    def uniform(p: Column) -> Column:
        alike = F.regexp_extract(p.bits, "^(?:(0)0*|(x)x*|(z)z*)$", 0)
        return F.struct(p.size.alias("size"), p.bits.alias("bits"), F.when(alike != "", F.substring(alike, 1, 1)).alias("uniform"))

    parts = _let(_let(read, sized), uniform)

    def shown(p: Column) -> Column:
        text = F.concat(p.size.cast("string"), F.lit("'"))
        binary, unknown = F.concat(text, F.lit("b"), F.coalesce(p.uniform, p.bits)), p.uniform.isin("x", "z")
        if radix == "binary":
            return binary
        if radix == "decimal":
            return F.when(unknown, F.concat(text, F.lit("d"), p.uniform)).when(p.number.isNotNull(), F.concat(text, F.lit("d"), p.number)).otherwise(binary)
        digit = lambda b: F.when(b == "xxxx", "x").when(b == "zzzz", "z").when(b.rlike("^[01]{4}$"), F.lower(F.conv(b, 2, 16)))
        count = F.ceil(p.size / 4).cast("int")
        each = _let(F.lpad(p.bits, count * 4, F.lit("0")), lambda padded: F.transform(F.sequence(F.lit(0), count - 1), lambda i: _let(F.substring(padded, i * 4 + 1, F.lit(4)), digit)))
        joined = lambda e: F.when(F.exists(e, lambda d: d.isNull()), binary).otherwise(F.concat(text, F.lit("h"), _let(F.array_join(e, ""), lambda h: F.when(h.rlike("^0+$"), "0").otherwise(h))))
        return F.when(unknown, F.concat(text, F.lit("h"), p.uniform)).otherwise(_let(each, joined))

    if radix == "decimal":
        plain = _let(parts, lambda p: F.when(~p.bits.rlike("[xz]") & (p.size <= LIMITS["decimal_bits"]), p.bits))
        parts = _let(F.struct(parts.alias("p"), _decimal(plain).alias("number")), lambda x: F.struct(x.p.size.alias("size"), x.p.bits.alias("bits"), x.p.uniform.alias("uniform"), x.number.alias("number")))
    return F.coalesce(_let(parts, shown), literal)


def effective_settings(arguments: DataFrame, overrides: DataFrame) -> DataFrame:
    """kind, name, value of the settings in force, from filelist arguments (ord, kind, value) and overrides (kind, name, value).

    Of repeated arguments the first counts. Filelist undefines take away filelist defines; then override defines win over
    filelist undefines, and override undefines over everything. Override parameters replace filelist ones.
    """
    named = arguments.select("ord", "kind", F.when(F.col("kind") == "undefine", F.col("value")).otherwise(F.split_part("value", F.lit("="), F.lit(1))).alias("name"), F.when(F.col("value").contains("=") & (F.col("kind") != "undefine"), F.expr("substring(value, instr(value, '=') + 1)")).alias("value"))
    known = named.where("kind <> 'parameter' or value is not null")
    file = known.groupBy("kind", "name").agg(F.min_by(F.struct("value"), "ord")["value"].alias("value"))
    given = overrides.groupBy("kind", "name").agg(F.max("value").alias("value"))
    # Ranks: the higher one decides between the two kinds of a define, and between filelist and override.
    rank = lambda base: F.when(F.col("kind") == "undefine", base + 1).otherwise(base)
    every = file.withColumn("rank", rank(0)).union(given.withColumn("rank", rank(2))).withColumn("what", F.when(F.col("kind") == "parameter", "parameter").otherwise("define"))
    best = every.groupBy("what", "name").agg(F.max_by(F.struct("kind", "value"), "rank").alias("x"))
    return best.select("x.kind", "name", "x.value")


def instance_paths(instances: DataFrame, parents: DataFrame, groups: DataFrame) -> DataFrame:
    """id, path: the parent's path, the name of the group that holds the instance (if any), and its label, by dots.

    Frames (id, parent_id, label), (id, path) and (child_node_id, name).
    """
    own = instances.join(parents.select(F.col("id").alias("parent_id"), "path"), "parent_id", "left").join(groups.select(F.col("child_node_id").alias("id"), "name"), "id", "left")
    return own.select("id", F.concat_ws(".", "path", "name", "label").alias("path"))


def shared_neighbours(edges: DataFrame, nodes: DataFrame, matched: DataFrame) -> DataFrame:
    """anchor, kind, id: unmatched nodes next to each matched node (id, partner), under its partner's name."""
    ends = edges.select(F.col("source_node").alias("id"), F.col("target_node").alias("near")).union(edges.select("target_node", "source_node")).where("id <> near")
    open_ends = ends.join(matched.select("id"), "id", "left_anti").distinct()
    return open_ends.join(matched.select(F.col("id").alias("near"), F.col("partner").alias("anchor")), "near").join(nodes.select("id", "kind"), "id").select("anchor", "kind", "id")
