"""Quality rules as a ledger of failure bits (DataFrame functions only).

`ledger` evaluates every rule once per document and stores one bit for each failed rule
beside the measurements. A policy is a versioned set of bits; applying another version,
or finding out what one rule alone removes, reads the stored bits and no text.

Null, empty and blank texts have no words: all counts are 0 and the short-text rule
fails. Repeated rows and rows that share an id are measured each on its own. Extra
columns pass through; those whose names clash with a measurement are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: One bit a rule, in this order; the first two are the base.
RULES = ("short", "repeated_words", "symbols", "shouting", "repeated_lines", "word_length")
BIT = {rule: 1 << k for k, rule in enumerate(RULES)}
#: Versions of the policy: the rules whose failure rejects a document.
POLICIES = {
    "base": ("short", "repeated_words"),
    "v1": ("short", "repeated_words", "symbols", "shouting", "word_length"),
    "strict": RULES,
}
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_bangs", "n_repeat_words")


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def _ordered(hashes: Column) -> Column:
    """(hash, start) of the windows in order of their hash, for texts in which one comes again."""
    again = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(again, F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


def _repeat_words(ordered: Column) -> Column:
    """Words that lie in windows found twice or more."""
    last = F.size(ordered)
    at = lambda i: F.get(ordered, i)
    same = lambda i, j: F.coalesce(at(i)["h"] == at(j)["h"], F.lit(False))
    starts = F.filter(F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.when(same(i, i - 1) | same(i, i + 1), at(i)["i"])), lambda x: x.isNotNull())
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["total"] + s + WINDOW - F.greatest(a["end"], s)).alias("total"), (s + WINDOW).alias("end"))
    return F.when(ordered.isNull(), F.lit(0)).otherwise(F.aggregate(F.array_sort(starts), zero, step, lambda a: a["total"]))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of MEASURES, each a count over the whole text."""
    words, hashes, lines, ordered = (common.fresh(docs, k) for k in ("words", "hashes", "lines", "ordered"))
    t = F.coalesce(F.col(common.quoted(text)), F.lit(""))
    out = docs.withColumn(words, common.blank_words(F.col(common.quoted(text))))
    out = out.withColumns({hashes: common.windows(F.col(words), WINDOW), lines: F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(common.BLANKS)) != "")})
    out = out.withColumn(ordered, _ordered(F.col(hashes)))
    w, n = F.col(words), F.col(lines)
    counts = {
        "n_words": F.size(w),
        "word_chars": F.char_length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")),
        "n_lines": F.size(n),
        "n_dup_lines": F.size(n) - F.size(F.array_distinct(n)),
        "n_bangs": F.regexp_count(t, F.lit("!!")),
        "n_repeat_words": _repeat_words(F.col(ordered)),
    }
    # A generated row keeps later filters from being moved below, where they would count again.
    kept = [common.quoted(c) for c in docs.columns if c.lower() not in counts]
    return out.select(*kept, F.inline(F.array(F.struct(*(v.cast("bigint").alias(k) for k, v in counts.items())))))


def failures() -> Column:
    """The bits of the failed rules, from the measurements."""
    n = F.col("n_words")
    rules = {
        "short": n < 20,
        "repeated_words": 100 * F.col("n_repeat_words") > 30 * n,
        "symbols": 100 * F.col("n_symbols") > 20 * n,
        "shouting": 100 * F.col("n_bangs") > 30 * n,
        "repeated_lines": 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 30 * n),
    }
    return sum((F.when(rules[r], F.lit(BIT[r])).otherwise(F.lit(0)) for r in RULES), F.lit(0))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with their measurements and `failures`, the bits of the rules that failed."""
    return measure(docs, text).withColumn("failures", failures().cast("int"))


def judge(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """A ledger with `kept` by one version of the policy."""
    return rows.withColumn("kept", F.col("failures").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that it alone rejects.

    The ledger is first counted by bit pattern (at most 2 to the number of rules), so only
    pattern counts are shuffled.
    """
    bits = mask(policy)
    patterns = rows.groupBy(F.col("failures").bitwiseAND(F.lit(bits)).alias("bits")).agg(F.count("*").alias("n"))
    names = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for r in POLICIES[policy]))
    each = patterns.select("bits", "n", F.explode(names).alias("r")).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule", "bit").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def keep(docs: DataFrame, text: str = "text", policy: str = "v1") -> DataFrame:
    """The documents that the policy accepts, with their own columns alone, as they were."""
    rows, names = common.renamed(docs, (text,))
    return common.restored(judge(ledger(rows, text), policy).where("kept"), names)
