"""How filters of documents interact: every order of them, step by step, and Shapley values.

A: fewer than 200 words. B: distinct words under half of the words. C: capitals A-Z over
2 % of the characters. D: any of # $ % & * |. E: the text of a smaller id, removed or not.

A and B come from the row sums and the nonzero counts of the document-term matrix
(terms.py); C, D and a digest of the text are columns of the same pass. Rows equal in id,
text and part are counted together first, and a document is held against the smallest id of
its text by a join on both id and digest, so neither a text with very many copies nor a
repeated row makes a hot key. Everything else follows from the counts of the 32 failure
patterns of each part: whether a step removes a document depends only on the set of filters
before it, of which there are 80 with the filter itself.

Defined cases: null text is empty (it has no words, so A fails, and B does not), and equals
other empty texts; null parts are the empty string; a null id is neither smaller nor larger
than another, so E passes; repeated rows of one id and text are no copies of each other but
count each; an id with several labels is good or toxic if one of them says so, and labels
without a document count nowhere; an empty table gives no rows; very long texts are taken
whole; extra columns are ignored, whatever their names. Texts are compared by SHA-256.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, terms

FILTERS = "ABCDE"
BIT = {f: 1 << k for k, f in enumerate(FILTERS)}
LEAST_WORDS, CAPITALS, SYMBOLS = 200, "[A-Z]", "[#$%&*|]"


def failures(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, bits, n, good, toxic): documents of each part by the filters they fail, and how many have either label."""
    t = F.coalesce(F.col(common.quoted(text)), F.lit(""))
    rows = docs.select(
        F.col(common.quoted(doc_id)).alias("id"),
        F.coalesce(F.col(common.quoted(part)).cast("string"), F.lit("")).alias("part"),
        (100 * F.regexp_count(t, F.lit(CAPITALS)) > 2 * F.char_length(t)).alias("c"),
        t.rlike(SYMBOLS).alias("d"),
        F.unhex(F.sha2(t, 256)).alias("digest"),
        t.alias("text"),
    )
    local, names, buckets = terms.coded(rows)
    stats = terms.row_stats(local, names, buckets)
    fails = {"A": F.col("n_words") < LEAST_WORDS, "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"), "C": F.col("c"), "D": F.col("d")}
    bits = sum((F.when(x, BIT[f]).otherwise(0) for f, x in fails.items()), F.lit(0))
    each = common.written(stats.select("id", "digest", "part", bits.alias("bits")).groupBy("id", "digest", "part", "bits").agg(F.count("*").alias("n")), "fails")
    common.dropped(local)

    first = each.groupBy("digest").agg(F.min("id").alias("id")).where("id IS NOT NULL").withColumn("is_first", F.lit(True))
    copy = F.col("id").isNotNull() & F.col("is_first").isNull()
    marked = each.join(first, ["digest", "id"], "left").select("id", "part", "n", (F.col("bits") + F.when(copy, BIT["E"]).otherwise(0)).alias("bits"))
    said = labels.select(F.col(common.quoted(doc_id)).alias("id"), "quality", "toxic").groupBy("id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    of = lambda mark: F.sum(F.when(F.col(mark), F.col("n")).otherwise(0))
    counted = marked.join(said, "id", "left").groupBy("part", "bits").agg(F.sum("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))
    out = common.written(counted, "patterns")
    common.dropped(each)
    return out


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bits of the filters before, own bit) of all orders; a fixed number of rows."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            out.append(("".join(order), k + 1, before, BIT[f]))
            before |= BIT[f]
    return out


def report(patterns: DataFrame) -> DataFrame:
    """One row for each part, order and step, from `failures`."""
    cases = sorted({(before, own) for _, _, before, own in steps()})
    listed = F.array(*(F.struct(F.lit(b).alias("before"), F.lit(o).alias("own"), F.lit(factorial(b.bit_count()) * factorial(len(FILTERS) - 1 - b.bit_count())).alias("orders")) for b, o in cases))
    each = patterns.select("part", "bits", "n", "good", "toxic", F.explode(listed).alias("case")).select("part", "bits", "n", "good", "toxic", "case.*")
    gone, fails = F.col("bits").bitwiseAND(F.col("before")) != 0, F.col("bits").bitwiseAND(F.col("own")) != 0
    total = lambda when, n="n": F.sum(F.when(when, F.col(n)).otherwise(0))
    counts = each.groupBy("part", "before", "own", "orders").agg(
        total(~gone & ~fails).alias("kept"),
        total(~gone & fails).alias("removed"),
        total(gone & fails).alias("redundant"),
        total(F.col("bits") == F.col("own")).alias("unique_fails"),
        total(~gone & fails, "good").alias("good_lost"),
        total(~gone & fails, "toxic").alias("toxic_lost"),
    )
    valued = counts.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "own")))
    # As many rows as there are orders and steps, so it is broadcast at any input size.
    listing = patterns.sparkSession.createDataFrame(steps(), "filter_order string, step int, before int, own int")
    return valued.join(F.broadcast(listing), ["before", "own"]).select(
        "part", "filter_order", "step", *(F.col(c).cast("bigint").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    )


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    return report(failures(docs, labels, doc_id, text, part))
