"""Scalar rules of graphs: labels, roles, classes, similarity scores and path forms."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions import ids

# Labels of operator cells, the other cells with a kind of their own, roles of port names, classes of glyphs.
OPERATOR_LABELS = {
    "$add": "+", "$sub": "−", "$xor": "^", "$reduce_xor": "^", "$_XOR_": "^", "$xnor": "~^", "$reduce_xnor": "~^", "$_XNOR_": "~^",
    "$and": "&", "$reduce_and": "&", "$_AND_": "&", "$nand": "NAND", "$_NAND_": "NAND", "$logic_and": "&&", "$or": "|", "$_OR_": "|",
    "$nor": "NOR", "$_NOR_": "NOR", "$logic_or": "||", "$reduce_or": "≥1", "$reduce_bool": "≠0", "$not": "~", "$_NOT_": "~", "$logic_not": "!",
    "$shl": "≪", "$sshl": "≪", "$shr": "≫", "$sshr": "≫", "$shift": "⇆", "$shiftx": "⇆", "$mul": "×", "$div": "÷", "$divfloor": "÷",
    "$mod": "%", "$modfloor": "%", "$pow": "**", "$eq": "==", "$eqx": "==", "$ne": "!=", "$nex": "!=", "$lt": "<", "$le": "≤", "$gt": ">", "$ge": "≥",
    "$neg": "−", "$buf": "→", "$_BUF_": "→", "$pos": "+", "$concat": "{}", "$slice": "[]",
}
MUX_CELLS = ("$mux", "$pmux", "$bmux", "$demux")
REGISTER_CELLS = ("$dff", "$dffe", "$adff", "$adffe", "$aldff", "$aldffe", "$sdff", "$sdffe", "$sdffce")
LATCH_CELLS = ("$dlatch", "$adlatch")
PORT_ROLES = {
    "CLK": "clock", "C": "clock", "ARST": "reset", "SRST": "reset", "ALOAD": "reset", "CLR": "reset", "RESET": "reset", "RST": "reset",
    "EN": "enable", "E": "enable", "CE": "enable", "D": "data", "AD": "data", "A": "data", "B": "data", "Q": "data", "Y": "data",
    "ADDR": "address", "RD_ADDR": "address", "WR_ADDR": "address", "DATA": "data", "RD_DATA": "data", "WR_DATA": "data",
}
ORDERED_CELLS = ("$mux", "$sub", "$shl", "$sshl", "$shr", "$sshr", "$shift", "$shiftx", "$div", "$divfloor", "$mod", "$modfloor", "$pow", "$lt", "$le", "$gt", "$ge")
GATES = {
    "&": "and", "&&": "and", "|": "or", "||": "or", "≥1": "or", "≠0": "or", "^": "xor", "~^": "xnor", "NAND": "nand", "NOR": "nor", "~": "not", "!": "not", "→": "buffer",
}
OPERATOR_NAMES = {
    "+": "Add", "−": "Subtract", "^": "Exclusive or", "~^": "Exclusive nor", "NAND": "Nand", "NOR": "Nor", "&": "And", "&&": "Logical and", "|": "Or",
    "||": "Logical or", "≥1": "Or", "≠0": "Boolean reduction", "~": "Bitwise not", "!": "Logical not", "≪": "Shift left", "≫": "Shift right", "×": "Multiply",
    "÷": "Divide", "%": "Modulo", "⇆": "Dynamic shift", "**": "Power", "==": "Equal", "!=": "Not equal", "<": "Less than", "≤": "Less than or equal",
    ">": "Greater than", "≥": "Greater than or equal", "→": "Buffer", "{}": "Concatenate", "[]": "Slice",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items())), key)


def cell_kind(cell_type: Column) -> Column:
    """Node kind of a netlist cell type; types without a leading $ are module instances, $_ ones primitives unless an operator."""
    return (
        F.when(cell_type.isin(list(OPERATOR_LABELS)), "operator").when(cell_type.isin(*MUX_CELLS), "mux").when(cell_type.isin(*REGISTER_CELLS), "register")
        .when(cell_type.isin(*LATCH_CELLS), "latch").when(cell_type.startswith("$mem"), "memory").when(~cell_type.startswith("$"), "module")
        .when(cell_type.startswith("$_"), "primitive").otherwise("unknown")
    )


def cell_label(cell_name: Column, cell_type: Column) -> Column:
    """Operators show their sign, instances their name, other cells a fixed word or their type."""
    kind = cell_kind(cell_type)
    return (
        F.when(kind == "operator", _lookup(OPERATOR_LABELS, cell_type)).when(kind == "mux", "MUX").when(kind == "register", "DFF").when(kind == "latch", "LATCH")
        .when(kind == "memory", "MEM").when(kind == "module", display_name(cell_name)).otherwise(display_name(cell_type))
    )


def cell_definition(cell_type: Column) -> Column:
    return F.when(cell_kind(cell_type) == "module", display_name(cell_type))


def cell_glyph(cell_type: Column) -> Column:
    return _lookup(OPERATOR_LABELS, cell_type)


def _port_name(name: Column) -> Column:
    return F.translate(F.ltrim(name, F.lit("\\")), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def port_role(cell_type: Column, name: Column) -> Column:
    """Role of a cell's port by its name; S selects on the mux cells alone."""
    port = _port_name(name)
    return F.when((port == "S") & cell_type.isin(*MUX_CELLS), "select").otherwise(_lookup(PORT_ROLES, port))


def gate_class(glyph: Column) -> Column:
    return _lookup(GATES, glyph)


def operator_name(glyph: Column) -> Column:
    """Shown name of an operator by its sign."""
    return F.coalesce(_lookup(OPERATOR_NAMES, glyph), F.concat(F.lit("Operator "), glyph))


def shown_direction(direction: Column) -> Column:
    """Unknown directions are shown as inout."""
    return F.when(direction == "unknown", "inout").otherwise(direction)


def shown_role(role: Column) -> Column:
    """Roles that are shown; any other is none."""
    return F.when(role.isin("clock", "reset", "enable", "select", "data"), role)


def operand_index(cell_type: Column, port: Column) -> Column:
    """Place of an operand, for cells whose operands are ordered."""
    name = _port_name(port)
    return F.when(cell_type.isin(*ORDERED_CELLS) & (name == "A"), 0).when(cell_type.isin(*ORDERED_CELLS) & (name == "B"), 1)


def constant_label(bits: Column) -> Column:
    """``N'b`` and the digits of an array of '0', '1', 'x', 'z' (least significant first), most significant first; one digit if all are 0, x or z."""
    alike = F.array_distinct(bits)
    digits = F.when((F.size(alike) == 1) & F.element_at(alike, 1).isin("0", "x", "z"), F.element_at(alike, 1)).otherwise(F.array_join(F.reverse(bits), ""))
    return F.concat(F.size(bits).cast("string"), F.lit("'b"), digits)


def display_name(name: Column) -> Column:
    """The name without its leading backslashes."""
    return F.ltrim(name, F.lit("\\"))


def port_direction(direction: Column) -> Column:
    low = F.lower(direction)
    return F.when(low.isin("input", "output", "inout"), low).otherwise("unknown")


def short_name(name: Column) -> Column:
    """Last component of a scoped name, cut to 24 characters."""
    last = F.element_at(F.split(name, r"::|\.|/"), -1)
    return F.when(F.length(last) > 24, F.concat(F.substring(last, 1, 24), F.lit("…"))).otherwise(last)


def signal_type(text: Column) -> Column:
    return F.regexp_replace(text, "^[0-9]+ ", "")


def plain(text: Column) -> Column:
    """ASCII letters lower, digits, _ and $ alone."""
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9_$]", "")


def bigrams(clean: Column) -> Column:
    return F.when(F.length(clean) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(clean) - 1, F.lit(1))), lambda i: F.substring(clean, i, F.lit(2))))


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, v: acc + F.least(count(a, v), count(b, v)))


def numbered(values: Column) -> Column:
    """Each value with how often it came up to there: a multiset as a set of strings."""
    return F.transform(values, lambda v, i: F.concat(v, F.lit("#"), F.size(F.filter(F.slice(values, F.lit(1), i + 1), lambda w: w == v)).cast("string")))


def string_similarity(a: Column, b: Column) -> Column:
    """Dice coefficient of bigrams with multiplicity of the plain forms; missing or empty strings 0, equal ones or equal plain
    forms 1, other one-character forms 0."""
    p, q = plain(a), plain(b)
    x, y = bigrams(p), bigrams(q)
    return _similarity(a, b, p, q, x, y, overlap(x, y))


def plain_similarity(a: Column, b: Column, p: Column, q: Column, x: Column, y: Column) -> Column:
    """``string_similarity`` of two strings whose plain forms and numbered bigrams are there already."""
    return _similarity(a, b, p, q, x, y, F.size(F.array_intersect(x, y)))


def _similarity(a: Column, b: Column, p: Column, q: Column, x: Column, y: Column, shared: Column) -> Column:
    empty = F.coalesce(a, F.lit("")).eqNullSafe(F.lit("")) | F.coalesce(b, F.lit("")).eqNullSafe(F.lit(""))
    dice = 2.0 * shared / F.greatest(F.size(x) + F.size(y), F.lit(1))
    return F.when(empty, F.lit(0.0)).when(a == b, F.lit(1.0)).when((p == "") | (q == ""), F.lit(0.0)).when(p == q, F.lit(1.0)).when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(dice)


def multiset_similarity(a: Column, b: Column) -> Column:
    """Sum of least counts over sum of greatest counts; two empty multisets are alike."""
    return _share(a, b, overlap(a, b))


def numbered_similarity(x: Column, y: Column) -> Column:
    """``multiset_similarity`` of two multisets that are numbered already."""
    return _share(x, y, F.size(F.array_intersect(x, y)))


def _share(a: Column, b: Column, shared: Column) -> Column:
    total = F.size(a) + F.size(b) - shared
    return F.when(total == 0, F.lit(1.0)).otherwise(shared / total)


def semantic_score(label: Column, glyph: Column, definition: Column) -> Column:
    """Of the similarities of labels, glyphs and definitions."""
    return F.lit(0.25) + 0.35 * label + 0.2 * glyph + 0.2 * definition


def port_score(ref_pairs: Column, cand_pairs: Column, ref_tokens: Column, cand_tokens: Column, similarity=multiset_similarity) -> Column:
    """Of both nodes' multisets of (direction, role), and of (direction, role, index)."""
    return 0.75 * similarity(ref_pairs, cand_pairs) + 0.25 * similarity(ref_tokens, cand_tokens)


def source_score(distance: Column) -> Column:
    """Of the least distance in lines between two nodes' places in one file; null: no common file."""
    return F.coalesce(1.0 / (1 + distance / 20.0), F.lit(0.0))


def width_score(ref_parameters: Column, cand_parameters: Column, ref_widths: Column, cand_widths: Column) -> Column:
    """Equal parameters count half, the similarity of the multisets of port widths the other half."""
    return (ids.same_parameters(ref_parameters, cand_parameters).cast("double") + multiset_similarity(ref_widths, cand_widths)) / 2


def final_score(source: Column, semantic: Column, ports: Column, neighbours: Column, params: Column) -> Column:
    return 0.35 * source + 0.25 * semantic + 0.15 * ports + 0.2 * neighbours + 0.05 * params


def pre_score(source: Column, semantic: Column, ports: Column) -> Column:
    return 0.5 * source + 0.3 * semantic + 0.2 * ports


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.75, "medium").otherwise("low")


def normal_path(path: Column) -> Column:
    """Forward slashes, no leading ./, no doubled slash."""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", ""), "/+", "/")


def safe_path(path: Column) -> Column:
    """Relative, with no backslash, NUL, empty, . or .. component."""
    parts = F.split(path, "/")
    return (F.length(path) > 0) & ~path.contains("\\") & ~path.contains("\x00") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def path_suffixes(path: Column) -> Column:
    """All suffixes of a path at component boundaries, itself first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def edge_role(source_role: Column, target_role: Column) -> Column:
    """From the source port's role, else the target's; enable and select are control, anything else data."""
    role = F.coalesce(source_role, target_role)
    return F.when(role.isin("clock", "reset"), role).when(role.isin("enable", "select"), "control").otherwise("data")


def control_role(role: Column, *names: Column) -> Column:
    """clock or reset of an edge: its role, else its names, reset before clock."""
    text = F.lower(F.concat_ws(" ", *names))
    return F.when(role.isin("clock", "reset"), role).when(text.rlike("rst|reset"), "reset").when(text.rlike("clk|clock"), "clock")


def overlaps(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two ranges (start line, start column, end line, end column; end exclusive, null to the line's end) share a character."""
    far = F.lit(2**31)
    before = lambda l1, c1, l2, c2: (l1 < l2) | ((l1 == l2) & (c1 < c2))
    return before(a[0], a[1], b[2], F.coalesce(b[3], far)) & before(b[0], b[1], a[2], F.coalesce(a[3], far))


def range_size(start_line: Column, start_col: Column, end_line: Column, end_col: Column) -> Column:
    """Lines times 1000, plus columns where the range is on one line."""
    return (end_line - start_line) * 1000 + F.when(end_line == start_line, F.coalesce(end_col, start_col + 1) - start_col).otherwise(0)


def is_active_low_reset(role: Column, port: Column, parameters_json: Column) -> Column:
    """A reset port whose <PORT>_POLARITY parameter is all zeros."""
    value = F.try_element_at(F.from_json(parameters_json, "map<string,string>"), F.concat(F.upper(port), F.lit("_POLARITY")))
    return (role == "reset") & F.coalesce(value.rlike("^0+$"), F.lit(False))


def is_true(value_json: Column) -> Column:
    """Truth of a JSON value: true, a non-zero integer, "true", "1", or a binary string that holds a 1."""
    text = F.trim(value_json)
    return F.coalesce(
        F.when(text == "true", True).when(text.rlike(r"^-?[0-9]+$"), ~text.rlike(r"^-?0+$")).when(text.rlike(r'^"(?i:true)"$'), True).when(text.rlike(r'^"[01xz]+"$'), text.contains("1")).otherwise(False),
        F.lit(False),
    )


def source_ranges(text: Column) -> Column:
    """Ranges of a source attribute, ``file:line.col-line.col`` joined by ``|``; parts of any other form are left out."""
    form = r"^(.+):([0-9]+)\.([0-9]+)(?:-([0-9]+)\.([0-9]+))?$"
    part = lambda p, k: F.regexp_extract(p, form, k)
    number = lambda p, k: F.nullif(part(p, k), F.lit("")).cast("long")
    one = lambda p: F.struct(
        part(p, 1).alias("file"), number(p, 2).alias("start_line"), number(p, 3).alias("start_col"), F.coalesce(number(p, 4), number(p, 2)).alias("end_line"), number(p, 5).alias("end_col")
    )
    return F.transform(F.filter(F.split(text, r"\|"), lambda p: F.rlike(p, F.lit(form))), one)


def valid_range(start_line: Column, start_col: Column, end_line: Column, end_col: Column) -> Column:
    """Coordinates of 1 or more, the end after the start."""
    positive = (start_line >= 1) & (start_col >= 1) & (end_line >= 1) & (end_col >= 1)
    return F.coalesce(positive & ((end_line > start_line) | ((end_line == start_line) & (end_col > start_col))), F.lit(False))


def lines_overlap(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Whether two ranges of whole lines, ends included, share one."""
    return (start <= other_end) & (other_start <= end)


def contains(outer: tuple[Column, ...], inner: tuple[Column, ...]) -> Column:
    """Whether a range (start line, start column, end line, end column) lies within another."""
    at = lambda line, col: F.struct(line.alias("l"), col.alias("c"))
    return (at(outer[0], outer[1]) <= at(inner[0], inner[1])) & (at(inner[2], inner[3]) <= at(outer[2], outer[3]))


def layout_profile(wanted: Column, nodes: Column, edges: Column) -> Column:
    """auto becomes fast for graphs of nodes + 2 * edges >= 2000, else detailed; any other profile stays."""
    return F.when(wanted != "auto", wanted).when(nodes + 2 * edges >= 2000, "fast").otherwise("detailed")


def valid_identifier(name: Column) -> Column:
    return F.rlike(name, F.lit(r"^[A-Za-z_][A-Za-z0-9_$]*$"))
