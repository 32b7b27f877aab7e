"""Filter interaction audit by the Hart-Mas-Colell potential, with DataFrame functions only.

Each document becomes a bit mask of the filters that it fails; texts end there, and a part of the corpus is counted by (mask, labels).
The removal game of a part gives each of the 32 coalitions of filters the number of documents that fail any of its members. The
potential P of a coalition S is (v(S) + the sum of P over S without one member) / |S|, P of none being 0, worked out for one coalition after
another, as those without a member have smaller numbers; it is kept as a multiple of the number of orders, so that all is in whole numbers. A filter's
Shapley value is the potential of all filters less that of all but this one. Steps of an order are differences of coalitions.

Copies: a text's SHA-256 stands for it. Documents meet their labels by id, then equal texts are counted in map tasks and meet by
hash, one row for each combination of text, part and labels with its smallest id, so copies of one text, however many, are few rows.

Defined results: a null text is an empty one (its copies are copies, too); a row without an id has no smaller id, so it is never a
copy, nor does it make another one; of rows of one id and text all count, and none is a copy of the other; a label counts if any row
of labels of the id has it, and rows of labels without an id count nothing; a null part is the empty string; texts of any length are
read whole; only named columns are read, so further ones do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import cut

#: Rows without an id are dealt in so many shares where documents meet their labels.
SHARES = 1024
COPY = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """What fails a text: A too few words, B too few distinct ones, C too many capitals, D a sign of markup or code."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 200, "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 3, "D": text.rlike(r"[#$%&*|]"),
    }


def _bits(flags: dict[str, Column], names: str) -> Column:
    out = F.lit(0)
    for name, failed in flags.items():
        out = out + F.when(failed, 1 << names.index(name)).otherwise(0)
    return out


def failures(docs: DataFrame, labels: DataFrame, names: str, flags: dict[str, Column], part: Column, text: Column, key: str = "doc_id") -> DataFrame:
    """(part, mask, good, toxic, n): documents by the set of filters that they fail. flags: conditions on a row; the filter E, if it is
    among the names, is failed by copies."""
    ids = F.col(key)
    rows = docs.select(ids.alias("id"), F.coalesce(part, F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("h"), _bits(flags, names).alias("mask"))
    # A null meets nothing, but all nulls would go to one task.
    rows = rows.withColumn("share", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("h", F.monotonically_increasing_id()), F.lit(SHARES))).otherwise(0))
    marks = labels.where(ids.isNotNull()).groupBy(ids.alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    seen = rows.join(marks.withColumn("share", F.lit(0).cast("long")), ["id", "share"], "left")
    seen = seen.select("id", "share", "part", "h", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    group = ["part", "mask", "good", "toxic"]
    if COPY not in names:
        return seen.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    by_id = seen.groupBy("id", "share", "h", *group).agg(F.count(F.lit(1)).alias("n"))
    texts = by_id.groupBy("h", *group).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"), F.min("id").alias("id"), F.min_by("n", "id").alias("n_first")
    )
    texts = cut(texts, "texts")
    firsts = texts.groupBy("h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows"))
    # Most texts are one row and have met their smallest id already.
    spread = firsts.where("rows > 1").select("h", "first")
    texts = texts.join(spread, "h", "left").withColumn("first", F.coalesce("first", "id"))
    kept = F.col("nameless") + F.when(F.col("id") == F.col("first"), F.col("n_first")).otherwise(0)
    sides = F.array(F.struct(F.lit(0).alias("copy"), kept.alias("n")), F.struct(F.lit(1 << names.index(COPY)).alias("copy"), (F.col("n") - kept).alias("n")))
    out = texts.select(*group, F.explode(sides).alias("s")).where("s.n > 0")
    return out.select("part", (F.col("mask") + F.col("s.copy")).alias("mask"), "good", "toxic", F.col("s.n").alias("n")).groupBy(*group).agg(F.sum("n").alias("n"))


def coalitions(counts: DataFrame, n_filters: int) -> DataFrame:
    """(part, total, removed, good, toxic): arrays by coalition, whose number has the bits of its members, of documents that fail any
    member, of these the good ones and the toxic ones. counts: (part, mask, good, toxic, n), at most four rows a part and mask."""
    each = counts.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit((1 << n_filters) - 1))))
    hit = F.when(F.col("mask").bitwiseAND(F.col("coalition")) != 0, F.col("n")).otherwise(0)
    values = each.groupBy("part", "coalition").agg(
        F.sum("n").alias("total"), F.sum(hit).alias("removed"), F.sum(F.when(F.col("good"), hit).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), hit).otherwise(0)).alias("toxic")
    )
    row = F.array_sort(F.collect_list(F.struct("coalition", "removed", "good", "toxic")))
    games = values.groupBy("part").agg(F.max("total").alias("total"), row.alias("game"))
    return games.select("part", "total", *(F.col(f"game.{c}").alias(c) for c in ("removed", "good", "toxic")))


def potentials(values: Column, n_filters: int) -> Column:
    """Of each coalition, the potential times the number of orders of all filters; exact, as it is the sum of dividends by sizes."""
    orders = math.factorial(n_filters)

    def of(known: Column, s: Column) -> Column:
        without = F.array(*(F.when(s.bitwiseAND(F.lit(1 << k)) != 0, F.get(known, s.bitwiseAND(F.lit(~(1 << k))))).otherwise(F.lit(0)) for k in range(n_filters)))
        total = F.get(values, s) * orders + F.aggregate(without, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.array_append(known, F.call_function("div", total, F.bit_count(s)))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << n_filters) - 1)), F.array(F.lit(0).cast("long")), of)


def steps(games: DataFrame, names: str) -> DataFrame:
    """One row for each part, order of all filters and step, by differences of coalitions and of potentials."""
    n = len(names)
    everyone = (1 << n) - 1
    orders = F.array(*(F.lit("".join(p)) for p in itertools.permutations(names)))
    rows = games.withColumn("potential", potentials(F.col("removed"), n))
    rows = rows.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))

    bits = F.create_map(*(F.lit(x) for k, name in enumerate(names) for x in (name, 1 << k)))
    letters = F.transform(F.sequence(F.lit(1), F.col("step")), lambda k: F.element_at(bits, F.substr(F.col("filter_order"), k, F.lit(1))))
    rows = rows.withColumn("after", F.aggregate(letters, F.lit(0), lambda a, b: a.bitwiseOR(b))).withColumn("own", F.element_at(letters, -1))
    rows = rows.withColumn("before", F.col("after") - F.col("own")).withColumn("others", F.lit(everyone) - F.col("own"))

    def more(values: str, large: Column | str, small: Column | str) -> Column:
        at = lambda s: F.get(F.col(values), F.col(s) if isinstance(s, str) else s)
        return at(large) - at(small)

    removed = more("removed", "after", "before")
    return rows.select(
        "part", "filter_order", "step", (F.col("total") - F.get("removed", F.col("after"))).alias("kept"), removed.alias("removed"),
        (F.get("removed", F.col("own")) - removed).alias("redundant"), more("removed", F.lit(everyone), "others").alias("unique_fails"),
        more("good", "after", "before").alias("good_lost"), more("toxic", "after", "before").alias("toxic_lost"), more("potential", F.lit(everyone), "others").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The five filters of text_filters and copies, by part."""
    t, names = F.coalesce(F.col(text), F.lit("")), "ABCDE"
    counts = failures(docs, labels, names, text_filters(t), F.col(part), t, key)
    # Written once: small, and read by one stage after all the texts.
    return steps(coalitions(cut(counts, "masks"), len(names)), names)
