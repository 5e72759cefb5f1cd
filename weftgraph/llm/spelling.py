"""Groups of spelling variants: words one edit apart, joined by an even partition into two segments.

A word of length l is cut in the middle. One edit leaves one of the two segments as it is, so a word of the same length, or
one letter longer, has the first segment at its start or the second at its end, which the longer word holds one place
further on. Words are indexed under both segments and probe those of their own length and of the length below.

A segment that more than ``HOT`` words share is not paired within: the part in which the edit lies is cut in the middle
again, and the words meet under the longer keys, until no key is hot or the part is one letter. So pairs stay near linear
in the words, and none is lost.

A pair with an edit in a run of equal letters would be found under both segments; it counts only where its leftmost place
lies, which removes duplicates without a shuffle. Candidates are verified in what the keys leave of both words.

Defined cases: null and empty texts hold no words; runs of a row with a null id stay as they are; rows that repeat an id
count each; ties between forms go to the smaller word in code-point order; an empty table gives no rows. Columns other than
the two named ones are not read. Runs may be of any length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import materialise

# The letters of a word, the least length and count, the share of altered runs and the lead of a form.
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, ALTERED, LEAD = 7, 2, 31, 10
#: Words that may share a key before it is made longer.
HOT = 48


def words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word, n: the runs of all whole texts, some of them altered by the rule, that are long and frequent enough."""
    # A shorter run can't give a word: the rule only takes letters away.
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(f"({LETTERS}{{{LEAST_LENGTH},}})"), F.lit(1))
    own = docs.select(F.col(doc_id).cast("string").alias("doc"), F.explode(runs).alias("run"))
    hashed = own.select("run", F.coalesce(F.crc32(F.encode(F.concat("doc", F.lit(":"), "run"), "UTF-8")), F.lit(1)).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    made = hashed.select(F.when(F.col("h") % ALTERED == 0, cut).otherwise(F.col("run")).alias("word"))
    return made.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _sub(word: str, a: Column, b: Column) -> Column:
    """word[a:b]"""
    return F.substring(F.col(word), a + 1, b - a)


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds ``key``, a hash of what the word has outside the part [a, b) of a word of length l; only equal parts meet, so a
    collision costs a look at one more candidate."""
    more = F.length("word") - F.col("l")
    return rows.withColumn("key", F.xxhash64("l", "a", "b", _sub("word", F.lit(0), F.col("a")), _sub("word", F.col("b") + more, F.length("word"))))


def _halves(rows: DataFrame) -> DataFrame:
    """Both halves of the part [a, b)."""
    middle = (F.col("a") + F.floor((F.col("b") - F.col("a")) / 2)).cast("int")
    parts = F.array(F.struct(middle.alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), middle.alias("b")))
    return rows.select("word", "n", "l", F.explode(parts).alias("part")).select("word", "n", "l", "part.a", "part.b").where("a < b")


def _pairs(rows: DataFrame) -> DataFrame:
    """Verified pairs of words that share a key: left indexed, right of the same length and greater, or one letter longer."""
    left = rows.where(F.length("word") == F.col("l")).select("key", "l", "a", "b", F.col("word").alias("x"), F.col("n").alias("x_n"))
    right = rows.select("key", "l", "a", "b", F.col("word").alias("y"), F.col("n").alias("y_n"))
    more = F.length("y") - F.col("l")
    met = left.join(right, ["key", "l", "a", "b"]).where((more == 1) | (F.col("x") < F.col("y")))
    # equal outside the part, and the leftmost place of the edit inside it
    zero, end = F.lit(0), F.col("b") + more
    same = (_sub("x", zero, F.col("a")) == _sub("y", zero, F.col("a"))) & (_sub("x", F.col("b"), F.col("l")) == _sub("y", end, F.col("l") + more))
    first = (F.col("b") == F.col("l")) | (_sub("x", zero, F.col("b")) != _sub("y", zero, F.col("b")))
    one = F.levenshtein(_sub("x", F.col("a"), F.col("b")), _sub("y", F.col("a"), end), 1) == 1
    return met.where(same & first & one).select("x", "x_n", "y", "y_n")


def near(found: DataFrame, hot: int = HOT) -> DataFrame:
    """x, x_n, y, y_n: every pair of words (table of word, n) exactly one edit apart, once."""
    length = F.length("word")
    whole = found.select("word", "n", F.explode(F.array(length, length - 1)).alias("l")).where("l > 0")
    rows, out = _halves(whole.select("word", "n", "l", F.lit(0).alias("a"), F.col("l").alias("b"))), []
    while True:
        rows = materialise(_keyed(rows), "spelling-keys")
        crowds = rows.where(F.col("b") - F.col("a") > 1).groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > hot).select("key")
        crowds = materialise(crowds, "spelling-crowds")
        if crowds.isEmpty():
            return reduce(DataFrame.unionByName, [*out, _pairs(rows)])
        # Rows of a crowd all go on; a part of one letter never does, though its hash may meet a crowd's.
        deep = F.col("b") - F.col("a") > 1
        out.append(_pairs(rows.where(deep).join(crowds, "key", "left_anti").unionByName(rows.where(~deep))))
        rows = _halves(rows.where(deep).join(crowds, "key", "left_semi"))


def forms(found: DataFrame, pairs: DataFrame, lead: int = LEAD) -> DataFrame:
    """word, n, n_near, form, form_n of every word; form is its most frequent near word where that has ``lead`` times its count."""
    ends = F.array(F.struct(F.col("x").alias("word"), F.col("y").alias("other"), F.col("y_n").alias("m")), F.struct(F.col("y").alias("word"), F.col("x").alias("other"), F.col("x_n").alias("m")))
    sides = pairs.select(F.explode(ends).alias("e")).select("e.*")
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("other"))).alias("best"))
    leads = F.coalesce(-F.col("best.less") >= lead * F.col("n"), F.lit(False))
    shown = lambda c: F.when(leads, c)
    return found.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), shown(F.col("best.other")).alias("form"), shown(-F.col("best.less")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """Adds ``root``. Every step has at least ``LEAD`` times the count, so chains are short; each round doubles the steps."""
    jumps = materialise(formed.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialise(jumps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        jumps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return formed.join(jumps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hot: int = HOT) -> DataFrame:
    found = materialise(words(docs, text, doc_id), "spelling-words")
    formed = materialise(forms(found, near(found, hot)), "spelling-forms")
    return roots(formed).select("word", "form", "root", "n", "n_near", "form_n")


def op12(docs: DataFrame) -> DataFrame:
    return variants(docs)
