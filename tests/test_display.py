import json
import re

from pyspark.sql import functions as F

from weftgraph.functions import display


def slow_token(text, start_line, start_col, end_line, end_col):
    """Every operator of the table at every place of the line."""
    line = dict(enumerate(re.split("\r?\n", text), 1)).get(start_line, "")
    picked = line[start_col - 1 : max(start_col, end_col - 1)].strip() if start_line == end_line else ""
    if picked in display.OPERATORS or re.fullmatch(r"[A-Za-z_$][\w$]*", picked, re.A):
        return picked.lower()
    at = min(len(line), max(0, start_col - 1))
    for o in display.OPERATORS:
        if any(line.startswith(o, p) and p <= at < p + len(o) for p in range(len(line))):
            return o
    words = [m[0] for m in re.finditer(r"[\w$]+", line, re.A) if m.start() <= at <= m.end()]
    return words[0].lower() if words else None


def test_tokens_equal_a_search_of_every_place(spark):
    lines = ["assign y = (a<<<2) ^~ b && !c;", "", "  x<=y===z ", "$clk_En|é~^q", "a>b>>c>>>d", "-"]
    text = "\r\n".join(lines)
    rows = [(text, n, c, e, d) for n in range(0, 8) for c in range(1, 32) for e, d in ((n, c + 1), (n, c + 4), (n + 1, 3), (n, 1))]
    df = spark.createDataFrame([*rows, ("", 1, 1, 1, 1)], "t string, a int, b int, c int, d int")
    found = df.select("*", display.source_token(*(F.col(c) for c in "tabcd")).alias("token")).collect()
    assert [r.token for r in found] == [slow_token(*r[:5]) for r in found]
    assert {"<<<", "===", "&&", "x", "$clk_en", None} <= {r.token for r in found}


def test_shown_values_and_their_limits(spark):
    nest = lambda n: json.loads("[" * n + "]" * n)
    cases = {
        '"1010"': "10", '"102"': "102", '""': "", " 12 ": "12", "null": "null", "true": "true", '{"b": 1, "a": [null, "é"]}': '{"b":1,"a":[null,"é"]}',
        json.dumps("1" * 4096): str(2**4096 - 1), json.dumps("1" * 4097): "1" * 4097,
    }
    omitted = "[metadata omitted: exceeds display limits]"
    for value, fits in ((nest(65), True), (nest(66), False), ([None] * 9_999, True), ([None] * 10_000, False), (["x" * 131_000], True), (["x" * 131_072], False), ({"k" * 131_072: 1}, False)):
        cases[json.dumps(value)] = json.dumps(value, separators=(",", ":")) if fits else omitted
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "v string")
    assert {r.v: r.shown for r in df.select("v", display.format_json("v").alias("shown")).collect()} == cases | {None: None}
