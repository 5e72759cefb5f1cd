"""Identifiers: FNV-1a ids, injective scope ids, overlay ids and canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 64-bit FNV-1a offset, and its prime, 2**40 + 435.
FNV_OFFSET = 0xCBF29CE484222325 - (1 << 64)
FNV_LOW = 435


def fnv1a(data: Column) -> Column:
    """64-bit FNV-1a of a binary column as a signed long.

    The product with 2**40 + 435 is put together from halves, because a long product that overflows is an error.
    """
    low32 = 0xFFFFFFFF

    def step(h: Column, byte: Column) -> Column:
        x = h.bitwiseXOR(byte)
        lower = x.bitwiseAND(F.lit(low32)) * FNV_LOW
        upper = (F.shiftrightunsigned(x, 32) * FNV_LOW + F.shiftrightunsigned(lower, 32)).bitwiseAND(F.lit(low32))
        product = F.shiftleft(upper, 32).bitwiseOR(lower.bitwiseAND(F.lit(low32)))
        # x * 2**40 only has the low 24 bits of x; the sum of upper 32-bit halves is cut to 32 bits.
        high = (F.shiftrightunsigned(product, 32) + F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFF)), 8)).bitwiseAND(F.lit(low32))
        return F.shiftleft(high, 32).bitwiseOR(product.bitwiseAND(F.lit(low32)))

    hexed = F.hex(data)
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(hexed) - 1, F.lit(1)), F.lit(2)), lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("long"))
    codes = F.when(F.length(hexed) == 0, F.array().cast("array<bigint>")).otherwise(codes)
    return F.aggregate(codes, F.lit(FNV_OFFSET).cast("long"), step)


def stable_id(namespace: str, key: Column) -> Column:
    """``namespace-`` and 16 hex digits of FNV-1a over namespace, 0xFF, key."""
    data = F.concat(F.lit(namespace).cast("binary"), F.unhex(F.lit("FF")), key.cast("binary"))
    return F.concat(F.lit(f"{namespace}-"), F.lpad(F.lower(F.hex(fnv1a(data))), 16, "0"))


def projected_id(instance: Column, child: Column) -> Column:
    """Id of a child object inside an expanded instance."""
    return F.concat_ws("/", instance, child)


def scope_id(instance: Column, child: Column) -> Column:
    """Injective id of a pair: a JSON array of two strings."""
    return F.to_json(F.array(instance, child))


def overlay_id(kind: str, ref_id: Column, cand_id: Column) -> Column:
    """``kind:`` and the percent-encoded JSON pair of the two sides' ids, null for a missing side."""
    quoted = lambda c: F.coalesce(F.regexp_replace(F.to_json(F.array(c)), r"^\[(.*)\]$", "$1"), F.lit("null"))
    pair = F.concat(F.lit("["), F.when(ref_id.isNull(), F.lit("null")).otherwise(quoted(ref_id)), F.lit(","), F.when(cand_id.isNull(), F.lit("null")).otherwise(quoted(cand_id)), F.lit("]"))
    return F.concat(F.lit(f"cmp:{kind}:"), _encoded(pair))


def _encoded(text: Column) -> Column:
    code = F.url_encode(text)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        code = F.replace(code, F.lit(a), F.lit(b))
    return code


def inner_id(instance: Column, inner: Column) -> Column:
    """Id of an object of a compared child below an expanded instance; null for null. No two pairs share an id."""
    return F.when(instance.isNotNull() & inner.isNotNull(), F.concat(F.lit("cmp:projection:"), _encoded(scope_id(instance, inner))))


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys; text that is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def canonical_parameters(text: Column) -> Column:
    """Parameters as text that is equal for equal ones: keys sorted, absent the same as none."""
    return canonical_json(F.coalesce(text, F.lit("{}")))


def same_parameters(a: Column, b: Column) -> Column:
    """Never null. Equal text, which most pairs have, is not parsed."""
    return a.eqNullSafe(b) | (canonical_parameters(a) == canonical_parameters(b))
