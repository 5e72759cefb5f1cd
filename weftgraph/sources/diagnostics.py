"""Compiler diagnostics in JSON: an array, an object with ``diagnostics``, or a single object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _first(v: Column, kind: str, *paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, f"$.{p}", kind) for p in paths])


def parse(texts: DataFrame, text: str = "value") -> DataFrame:
    """severity, message, file, start_line, start_col, end_line, end_col; objects without a message are left out, empty texts have none.

    A location is ``path:line:col`` split from the right, an object, or the diagnostic itself.
    """
    v = F.try_parse_json(F.col(text))
    every = F.coalesce(F.try_variant_get(v, "$.diagnostics", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    d = texts.where(F.trim(text) != "").select(F.posexplode(every).alias("ord", "d"))
    o = F.col("d")
    compact = F.try_variant_get(o, "$.location", "string")
    held = F.when(compact.rlike(r"^.*:[0-9]+:[0-9]+$"), compact)
    place = F.coalesce(F.when(~F.coalesce(F.schema_of_variant(F.try_variant_get(o, "$.location", "variant")).startswith("OBJECT"), F.lit(False)), F.lit(None).cast("variant")).otherwise(F.try_variant_get(o, "$.location", "variant")), F.try_variant_get(o, "$.sourceLocation", "variant"), o)
    start = F.coalesce(F.try_variant_get(place, "$.start", "variant"), place)
    end = F.coalesce(F.try_variant_get(place, "$.end", "variant"), start)
    piece = lambda k: F.nullif(F.regexp_extract(held, r"^(.*):([0-9]+):([0-9]+)$", k), F.lit(""))
    level = F.lower(_first(o, "string", "severity", "level"))
    line = F.coalesce(piece(2).cast("long"), _first(start, "bigint", "line", "lineNumber", "startLine"))
    return d.select(
        "ord",
        F.when(level.isin("fatal", "error"), "error").when(level.isin("warning", "warn"), "warning").otherwise("info").alias("severity"),
        _first(o, "string", "message", "formattedMessage", "text").alias("message"),
        F.coalesce(piece(1), _first(place, "string", "fileName", "filename", "file", "path")).alias("file"),
        line.alias("start_line"),
        F.coalesce(piece(3).cast("long"), _first(start, "bigint", "column", "columnNumber", "startColumn"), F.when(line.isNotNull(), 1)).alias("start_col"),
        F.coalesce(piece(2).cast("long"), _first(end, "bigint", "line", "lineNumber", "endLine"), line).alias("end_line"),
        F.coalesce(piece(3).cast("long"), _first(end, "bigint", "column", "columnNumber", "endColumn")).alias("end_col"),
    ).where("message is not null")
