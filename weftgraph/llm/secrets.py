"""Secret scans: patterns, and character Markov models of random strings and ordinary identifiers.

Everything here is DataFrame functions. The base patterns find assigned values, access keys and hex strings. The method
adds tokens of 20 or more characters that a first-order Markov model of random strings explains better, by mean
log-likelihood ratio, than a model of ordinary identifiers does. Both models are counted from labelled samples: random
strings are generated (hex, base 64, letters and digits) and joined by values that the base patterns find in a bounded
sample of ``SAMPLE_DOCS`` documents; identifiers are those documents' own words, joined in the usual ways. The models
together are one table of a few thousand log ratios, whatever the size of the corpus.

Defined cases: null is the empty text; spans count code points, end exclusive; a kind's matches are leftmost and don't
overlap; matches that are too short use up their characters; added spans that overlap base spans are dropped; rows
repeat as given; extra columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds in order, their patterns, and the least lengths of what must be long enough.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"

TOKEN_LEAST = 20
TOKEN = "[A-Za-z0-9+/_=-]{%d,}" % TOKEN_LEAST
#: Mean log ratio, in nats a character, from which a token counts as random.
RATIO = 0.3
SAMPLE_DOCS = 1000
GENERATED = 2048
MASK = "[SECRET]"

SPANS = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, kind: str, pattern: str, keep) -> Column:
    """Spans of the pattern's matches that ``keep`` accepts, from the lengths of matches and of what lies between."""
    k = KINDS.index(kind) + 1
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda hit, gap: F.struct(F.length(hit).alias("hit"), F.coalesce(F.length(gap), F.lit(0)).alias("gap"), (hit.isNotNull() & F.coalesce(keep(hit), F.lit(False))).alias("keep")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["hit"], F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(k).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["keep"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pairs, empty, step, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    """Spans of the base patterns, by start, then kind."""
    none = F.array().cast(SPANS)
    # The least lengths of whole matches can stand in the pattern: a run that fails holds no later match that is longer.
    found = [
        F.when(F.rlike(text, F.lit(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""")), _spans(text, "assign", ASSIGN, lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 1)) >= LEAST["assign"])).otherwise(none),
        F.when(F.contains(text, F.lit("AKIA")), _spans(text, "access", "AKIA[A-Z0-9]{%d,}" % (LEAST["access"] - 4), lambda hit: F.lit(True))).otherwise(none),
        F.when(F.rlike(text, F.lit("[0-9a-f]{%d}" % LEAST["hex"])), _spans(text, "hex", "[0-9a-f]{%d,}" % LEAST["hex"], lambda hit: F.lit(True))).otherwise(none),
    ]
    return F.array_sort(F.concat(*found))


def _pairs(strings: DataFrame) -> DataFrame:
    """Counts of neighbouring characters of the alphabet: random, a, b, n."""
    chars = strings.select("random", F.split("s", "").alias("c"))
    both = chars.select("random", F.explode(F.zip_with(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))), F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    return both.groupBy("random", "p.a", "p.b").count()


def labelled_samples(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """random (1 or 0), s: random strings and ordinary identifiers."""
    share = min(1.0, 1.25 * sample_docs / max(1, docs.count()))
    own = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(doc_id).alias("doc_id"))
    own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    values = own.select(F.explode(F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1)), F.regexp_extract_all("text", F.lit("AKIA([A-Z0-9]{16,})"), F.lit(1)), F.regexp_extract_all("text", F.lit("[0-9a-f]{24,}"), F.lit(0)))).alias("s")).where(F.length("s") >= TOKEN_LEAST // 2)
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(digest))
    made = docs.sparkSession.range(GENERATED).select(F.explode(F.array(digest, base64, F.translate(base64, "+/=", ""), F.upper(F.translate(base64, "+/=", "")))).alias("s"))
    # Words without any base match, as snake case, camel case, paths and run together.
    words = F.filter(F.split("text", "[^A-Za-z]+"), lambda w: F.length(w).between(2, 16))
    words = own.where(~F.rlike("text", F.lit(ASSIGN + "|" + ACCESS + "|[0-9a-f]{24,}"))).select(F.slice(words, 1, 200).alias("w"))
    joined = [F.array_join("w", "_"), F.array_join("w", "-"), F.array_join("w", "/"), F.array_join(F.transform("w", lambda w: F.initcap(w)), ""), F.array_join("w", ""), F.upper(F.array_join("w", "_")), F.lit("=" * 40 + "-" * 40 + "_" * 40 + "+" * 20), F.lit("1234567890-2024-01-01/2023_12_31-0000000000")]
    ordinary = words.select(F.explode(F.array(*joined)).alias("s"))
    return values.union(made).select(F.lit(1).alias("random"), "s").union(ordinary.select(F.lit(0).alias("random"), "s"))


def log_ratios(samples: DataFrame) -> list[float]:
    """Row-major table over ALPHABET x ALPHABET: log P(b | a, random) - log P(b | a, ordinary), add-half smoothed."""
    n = len(ALPHABET)
    counts = {(r.random, r.a, r.b): r["count"] for r in _pairs(samples).where(F.contains(F.lit(ALPHABET), F.col("a")) & F.contains(F.lit(ALPHABET), F.col("b"))).collect()}
    rows = {(k, a): sum(counts.get((k, a, b), 0) for b in ALPHABET) + 0.5 * n for k in (0, 1) for a in ALPHABET}
    p = lambda k, a, b: (counts.get((k, a, b), 0) + 0.5) / rows[k, a]
    return [round(math.log(p(1, a, b) / p(0, a, b)), 4) for a in ALPHABET for b in ALPHABET]


def mean_ratio(token: Column, ratios: list[float]) -> Column:
    """Mean log ratio a character pair of a token over ALPHABET."""
    n, table = len(ALPHABET), F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    last = F.greatest(F.length(token) - 1, F.lit(1))
    each = F.zip_with(F.slice(places, 1, last), F.slice(places, 2, last), lambda a, b: F.get(table, (a * n + b).cast("int")))
    return F.aggregate(each, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0))) / last


def scan(docs: DataFrame, ratios: list[float], text: str = "text") -> DataFrame:
    """row (all columns of ``docs``), base and found: spans of the base patterns and all spans, by start, then kind."""
    own = F.coalesce(F.col("text"), F.lit(""))
    added = F.when(F.rlike(own, F.lit("[A-Za-z0-9+/_=-]{%d}" % TOKEN_LEAST)), _spans(own, "random", TOKEN, lambda hit: mean_ratio(hit, ratios) >= RATIO)).otherwise(F.array().cast(SPANS))
    with_base = docs.select(F.struct("*").alias("row"), F.col(text).alias("text")).select("row", base_spans(own).alias("base"), added.alias("added"))
    free = F.filter("added", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return with_base.select("row", "base", F.array_sort(F.concat("base", free)).alias("found"))


def _joined(spans: str) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2(docs: DataFrame) -> DataFrame:
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), log_ratios(labelled_samples(docs)))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("row.doc_id", *[count(k + 1).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])], F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("found").alias("spans"))


def redact(docs: DataFrame, ratios: list[float], text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``; spans in the text, merged where they overlap, are replaced by MASK."""
    found = scan(docs, ratios, text)
    body, empty = F.col("row")[text], F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        out = F.when(new, F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    whole = F.aggregate("found", empty, step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))
    clean = F.when(F.size("found") > 0, whole).otherwise(body)
    return found.select(*[clean.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
