"""Compiler filelists: tokens with their places, nested lists, and arguments by class."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.session import materialise

TOKENS = "path string, ord int, line int, col int, token string"


def tokens_of(text: str, path: str = "") -> list[tuple[int, int, str]]:
    """(line, column, token), both from 1. Quotes group, a backslash escapes (not in single quotes) or joins lines, comments begin at a token's start."""
    out, word, start, line, col, quote, i = [], "", (1, 1), 1, 1, "", 0
    while i < len(text):
        c = text[i]
        step = 1
        if not quote and not word and (c == "#" or text.startswith("//", i)):
            end = text.find("\n", i)
            step = (len(text) if end < 0 else end) - i
            c = ""
        elif not quote and c.isspace():
            if word:
                out.append((*start, word))
            word, c = "", ""
        elif text.startswith("\\\n", i):
            step, c = 2, ""
        else:
            if not word:
                start = (line, col)
            if c == "\\" and quote != "'" and i + 1 < len(text):
                step, c = 2, text[i + 1]
            elif c in "'\"" and quote in ("", c):
                quote, c = ("" if quote else c), ""
        word += c
        passed = text[i : i + step]
        line, col = (line + 1, 1) if passed.endswith("\n") else (line, col + step)
        i += step
    if quote:
        raise ValueError(f"{path}:{start[0]}:{start[1]}: quote without an end")
    return [*out, (*start, word)] if word else out


def tokenize(files: DataFrame) -> DataFrame:
    """Tokens of filelists (path, text) in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, k, *t) for p, x in zip(pdf["path"], pdf["text"], strict=True) for k, t in enumerate(tokens_of(x or "", p))]
            yield pd.DataFrame(rows, columns=["path", "ord", "line", "col", "token"])

    return files.select("path", "text").mapInPandas(run, TOKENS)


def expand(files: DataFrame, root: str, depth: int = 64) -> DataFrame:
    """Tokens of ``root`` with nested -f and -F lists in their place; -F names are relative to the list that names them.

    Returns root, place (ordinals along the way, the order), path, line, col, token, before (the token ahead in its own list). One join a level; lists nested deeper than
    ``depth`` are an error.
    """
    toks = materialise(tokenize(files), "tokens")
    step = toks.withColumns({"before": F.lag("token").over(_by_path()), "folder": F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)})
    step = materialise(step.where("token not in ('-f', '-F')").withColumn("list", F.when(F.col("before") == "-f", F.col("token")).when(F.col("before") == "-F", F.concat("folder", "token"))), "tokens")
    level = step.where(F.col("path") == root).withColumn("place", F.array("ord"))
    out = level.where("list is null")
    for _ in range(depth):
        named = level.where("list is not null").select(F.col("list").alias("path"), F.col("place").alias("up"))
        if named.isEmpty():
            return out.select(F.lit(root).alias("root"), "place", "path", "line", "col", "token", "before")
        level = materialise(named.join(step, "path", "left").withColumn("place", F.concat("up", F.array(F.coalesce("ord", F.lit(0))))).withColumn("token", F.coalesce("token", F.raise_error(F.concat(F.lit("no filelist "), "path")).cast("string"))).select(level.columns), "tokens")
        out = out.union(level.where("list is null"))
    raise ValueError(f"filelists nest deeper than {depth}")


def _by_path():
    return Window.partitionBy("path").orderBy("ord")


def arguments(expanded: DataFrame) -> DataFrame:
    """root, place, kind (source, include_dir, define, undefine, top, option), value of every argument of expanded lists; +incdir+ and
    +define+ hold several. What a token means is told by the one before it in its own list."""
    before = F.col("before")
    parts = F.slice(F.split("token", r"\+"), 3, 1 << 20)
    kind = (
        F.when(before.isin("--top", "--top-module", "-top"), "top").when(F.col("token").startswith("+incdir+"), "include_dir").when(F.col("token").startswith("+define+"), "define")
        .when(before == "-I", "include_dir").when(before == "-D", "define").when(before == "-U", "undefine").when(F.col("token").rlike("^-I."), "include_dir").when(F.col("token").rlike("^-D."), "define")
        .when(F.col("token").rlike("^-U."), "undefine").when(F.col("token").rlike("^[-+]"), "option").otherwise("source")
    )
    value = F.when(F.col("token").rlike(r"^\+(incdir|define)\+"), parts).when(F.col("token").rlike("^-[IDU]."), F.array(F.substring("token", 3, 1 << 20))).otherwise(F.array("token"))
    return expanded.select("root", "place", kind.alias("kind"), F.explode(value).alias("value")).where("not (kind = 'option' and value in ('--top', '--top-module', '-top', '-I', '-D', '-U'))")
