"""The token at a selection and metadata values as they are shown."""

from __future__ import annotations

import json
import re
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from weftgraph.schema import LIMITS

# Operators in the order in which they are looked for; what each kind of value counts for, and the limits of shown metadata.
OPERATORS = ("<<<", ">>>", "===", "!==", "<<", ">>", "<=", ">=", "==", "!=", "&&", "||", "~^", "^~", "+", "-", "*", "/", "%", "^", "&", "|", "~", "!", "<", ">")
QUOTES, KEY, OBJECT, NUMBER, TRUTH, NULL = 2, 3, 2, 32, 5, 4
SHOWN = {"depth": 64, "nodes": 10_000, "characters": 131_072}

_WORD, _LETTERS = r"^[A-Za-z_$][A-Za-z0-9_$]*$", "[A-Za-z0-9_$]*"


def source_token(text: Column, start_line: Column, start_col: Column, end_line: Column, end_col: Column) -> Column:
    """Token of a selection (1-based, end exclusive) in lower case: the selected word or operator, else the first operator of
    the table that lies at the cursor, else the word around the cursor, else null.

    What could be an operator at the cursor is one of six pieces of the line, the ones of up to three characters that cover
    the cursor's place; each is looked up in the table.
    """
    line = F.coalesce(F.get(F.split(text, "\r?\n"), start_line - 1), F.lit(""))
    upto = F.greatest(start_col, end_col - 1)
    chosen = F.regexp_replace(F.when(start_line == end_line, F.substring(line, start_col, upto - start_col + 1)).otherwise(F.lit("")), r"^\s+|\s+$", "")
    cursor = F.least(F.length(line), F.greatest(F.lit(0), start_col - 1))
    table = F.array(*map(F.lit, OPERATORS))
    pieces = [F.when((cursor >= before) & (cursor - before + size <= F.length(line)), F.substring(line, cursor - before + 1, F.lit(size))) for size in (1, 2, 3) for before in range(size)]
    ranks = F.array(*(F.array_position(table, p) for p in pieces))
    first = F.array_min(F.filter(ranks, lambda r: r > 0))
    word = F.concat(F.regexp_extract(F.substring(line, F.lit(1), cursor), f"({_LETTERS})$", 1), F.regexp_extract(F.substring(line, cursor + 1, F.length(line)), f"^({_LETTERS})", 1))
    picked = F.when(chosen.rlike(_WORD) | chosen.isin(*OPERATORS), chosen).when(first.isNotNull(), F.get(table, (first - 1).cast("int"))).when(word != "", word)
    return F.lower(picked)


def _size(value: object) -> int:
    """What a value counts for, without those it holds."""
    if isinstance(value, dict):
        return OBJECT + sum(map(len, value)) + KEY * len(value)
    if isinstance(value, list):
        return len(value) + QUOTES
    return QUOTES + len(value) if isinstance(value, str) else TRUTH if isinstance(value, bool) else NULL if value is None else NUMBER


def _within_limits(value: object) -> bool:
    """Level by level: how many levels, values and characters there are."""
    level, depth, nodes, size = [value], 0, 0, 0
    while level and depth <= SHOWN["depth"] + 1 and nodes <= SHOWN["nodes"] and size <= SHOWN["characters"]:
        depth, nodes, size = depth + 1, nodes + len(level), size + sum(map(_size, level))
        level = list(chain.from_iterable(v.values() if isinstance(v, dict) else v for v in level if isinstance(v, dict | list)))
    return depth <= SHOWN["depth"] + 1 and nodes <= SHOWN["nodes"] and size <= SHOWN["characters"]


def shown_value(text: str | None) -> str | None:
    """A JSON value as it is shown: strings of binary digits as a decimal number, other strings plain, objects and lists as JSON
    unless they exceed the limits."""
    if text is None:
        return None
    value = json.loads(text)
    if isinstance(value, str):
        return str(int(value, 2)) if len(value) <= LIMITS["decimal_bits"] and re.fullmatch("[01]+", value) else value
    if isinstance(value, list | dict):
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False) if _within_limits(value) else "[metadata omitted: exceeds display limits]"
    return text.strip()


@pandas_udf(StringType())
def format_json(text: pd.Series) -> pd.Series:
    return text.map(shown_value, na_action="ignore")
