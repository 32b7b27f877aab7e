"""Sets of documents as bitmaps: one row (word, bits) for each 64 ids that hold a member, so set operations are operators on integers.

A document is bit ``doc_id & 63`` of word ``doc_id >> 6``; ids of any sign have one. Map tasks fold the postings of a term into words before
the shuffle, so a frequent term sends a row for 64 documents and a rare one a row for each. Everything stays in generated JVM code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.plans import query as Q

ID_BITS = 6


def word(doc_id: Column | str) -> Column:
    return F.shiftright(doc_id, ID_BITS)


def bit(doc_id: Column | str) -> Column:
    place = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).bitwiseAND(F.lit((1 << ID_BITS) - 1)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bitmaps(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, word, bits) of rows (keys, doc_id); repeated rows count once."""
    return rows.groupBy(*keys, word("doc_id").alias("word")).agg(F.bit_or(bit("doc_id")).alias("bits"))


def members(sets: DataFrame, *keys: str) -> DataFrame:
    """(keys, doc_id) of bitmaps (keys, word, bits), each once."""
    held = F.filter(F.sequence(F.lit(0), F.lit((1 << ID_BITS) - 1)), lambda b: F.call_function("getbit", F.col("bits"), b) == 1)
    ids = F.transform(held, lambda b: F.shiftleft("word", ID_BITS) + b)
    return sets.select(*keys, F.explode(ids).alias("doc_id"))


def size(sets: DataFrame, *keys: str) -> DataFrame:
    """(keys, n): how many members, without listing them."""
    return sets.groupBy(*keys).agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("n"))


def to_bits(node: Q.Node, bits: dict[str, Column]) -> Column:
    """A boolean tree on one word of each term. Bits of documents that do not exist may be set where the tree matches without terms."""
    match node:
        case Q.Term(t):
            return bits[t]
        case Q.Not(x):
            return F.bitwise_not(to_bits(x, bits))
        case Q.And(a, b):
            return to_bits(a, bits).bitwiseAND(to_bits(b, bits))
        case Q.Or(a, b):
            return to_bits(a, bits).bitwiseOR(to_bits(b, bits))
        case Q.Near():
            raise ValueError("windows need positions")
    return F.lit(0).cast("long")


def evaluate(node: Q.Node, postings: DataFrame, documents: DataFrame) -> DataFrame:
    """(word, bits) of the documents that a boolean tree matches. postings: (term, doc_id) of its terms; documents: (doc_id) of all, read only
    if the tree matches documents without any of its terms. One exchange, of words."""
    terms = sorted(Q.terms_of(node))
    rows = postings.select("term", "doc_id")
    everyone = Q.matches_without_terms(node)
    if everyone:
        rows = rows.unionByName(documents.select(F.lit(None).cast("string").alias("term"), "doc_id"))
    of = [F.coalesce(F.bit_or(F.when(F.col("term") == t, bit("doc_id"))), F.lit(0).cast("long")).alias(f"b{k}") for k, t in enumerate(terms)]
    everybody = [F.coalesce(F.bit_or(F.when(F.col("term").isNull(), bit("doc_id"))), F.lit(0).cast("long")).alias("there")] if everyone else []
    if not of and not everybody:
        return rows.select(word("doc_id").alias("word"), bit("doc_id").alias("bits")).limit(0)
    words = rows.groupBy(word("doc_id").alias("word")).agg(*of, *everybody)
    out = to_bits(node, {t: F.col(f"b{k}") for k, t in enumerate(terms)})
    if everyone:
        out = out.bitwiseAND(F.col("there"))
    return words.select("word", out.alias("bits")).where("bits <> 0")


def combine(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Union, intersection or difference of two sets (word, bits). Each is folded by word before they meet."""
    sides = left.select("word", "bits", F.lit(0).alias("side")).unionByName(right.select("word", "bits", F.lit(1).alias("side")))
    a, b = (F.coalesce(F.bit_or(F.when(F.col("side") == k, F.col("bits"))), F.lit(0).cast("long")) for k in (0, 1))
    both = sides.groupBy("word").agg(a.alias("a"), b.alias("b"))
    col = F.col("a")
    out = {"union": col.bitwiseOR(F.col("b")), "intersect": col.bitwiseAND(F.col("b")), "difference": col.bitwiseAND(F.bitwise_not(F.col("b")))}[how]
    return both.select("word", out.alias("bits")).where("bits <> 0")
