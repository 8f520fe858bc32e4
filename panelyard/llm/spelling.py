"""Spelling variants grouped by a permuterm index of the vocabulary (DataFrame functions only).

Words are counted over all texts. Each word is marked with a terminator and rotated; in
rotated form any one character can be made the last, so the words that agree but for that
character share the rest as a prefix:

* `rest` + x for every x: words that differ by the replaced character x;
* `rest` itself as a whole rotation: the word without that character (an indel).

Rows (rest, word, skipped character) are sorted by `rest`, so a prefix range is one run of
rows. A window scans each run and tells every member how many neighbours it has there and
which is the most frequent. No pairs are made: a run holds one word for each letter of the
alphabet and one whole rotation at most, whatever the corpus, so no run is hot. A
replacement is found in exactly one run; an indel inside a row of equal letters would be
found once for each of them, so only the first of them counts.

A word's form is its most frequent neighbour, if that is `ratio` times as frequent; forms
are followed to the last by doubling pointers. Counts rise by `ratio` at every step, so a
chain has at most log(2^63) / log(ratio) links and a few rounds do.

Cost: one pass over the text with map-side counts, then 2 * length + 1 narrow rows for
each word of the vocabulary, which is far smaller than the text.

Defined cases: null and empty texts, and texts without letters, have no words; a null id
counts as empty text in the hash; repeated rows count each; without words the result is
empty; very long texts and words are taken whole; extra columns are ignored, whatever
their names. Among equally frequent neighbours the first in code-point order is the form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LETTERS = "A-Za-z\\u00C0-\\u00FF"
#: Not a letter, so it marks where a rotated word ends.
END = "$"
LEAST_CHARS, LEAST, RATIO, EVERY = 6, 5, 5, 199


def _dropped(word: Column, at: Column) -> Column:
    """word without its character `at` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """(word, n) of the words with at least `least_chars` characters and `least` occurrences.

    Runs of letters, A-Z lower-cased; if `every` divides the crc32 h of "<id>:<run>", the run
    loses its character h % length.
    """
    runs = F.regexp_extract_all(F.col(common.quoted(text)), F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))
    key = F.concat(F.coalesce(F.col(common.quoted(doc_id)).cast("string"), F.lit("")), F.lit(":"))
    each = docs.select(key.alias("key"), F.explode(runs).alias("raw"))
    lowered = each.select("key", common.ascii_lower(F.col("raw")).alias("run"))
    hashed = lowered.select("run", F.crc32(F.concat("key", "run").cast("binary")).alias("h"))
    cut = _dropped(F.col("run"), (F.col("h") % F.char_length("run")).cast("int"))
    words = hashed.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.char_length("word") >= least_chars))


def rotations(words: DataFrame) -> DataFrame:
    """(rest, skipped, first, word, n): each rotation without its last character, and each whole one.

    skipped is the character left out, null for a whole rotation; first tells whether the
    character before it in the word is another one.
    """
    w, size = F.col("word"), F.char_length("word")
    turned = lambda after, before: F.concat(F.substring(w, after, size), F.lit(END), F.substring(w, F.lit(1), before))
    letter = lambda i: F.substring(w, i + 1, F.lit(1))
    without = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.struct(turned(i + 2, i).alias("rest"), letter(i).alias("skipped"), ((i == 0) | (letter(i) != letter(i - 1))).alias("first")),
    )
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(turned(i + 1, i).alias("rest"), F.lit(None).cast("string").alias("skipped"), F.lit(False).alias("first")))
    return words.where(size > 0).select(F.explode(F.concat(without, whole)).alias("r"), "word", "n").select("r.rest", "r.skipped", "r.first", "word", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, n_near, near_n, near): for each word its neighbours' number, and the most frequent one.

    words: (word, n), each word once.
    """
    run = Window.partitionBy("rest")
    ranked = run.orderBy(F.col("skipped").isNull(), F.col("n").desc(), F.col("word")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # As an ascending key: more frequent first, then by code points (strings compare by their UTF-8 bytes).
    own = F.struct((-F.col("n")).alias("less"), F.col("word").alias("w"))
    edited, whole = F.col("skipped").isNotNull(), F.col("skipped").isNull()
    scanned = rotations(words).select(
        "word",
        "n",
        "skipped",
        "first",
        own.alias("own"),
        F.count(F.when(edited, 1)).over(ranked).alias("n_edited"),
        F.count(F.when(F.col("first"), 1)).over(ranked).alias("n_first"),
        F.first(F.when(whole, own), ignorenulls=True).over(ranked).alias("whole"),
        F.first(F.when(edited, own)).over(ranked).alias("one"),
        F.nth_value(F.when(edited, own), 2).over(ranked).alias("two"),
        F.first(F.when(F.col("first"), own), ignorenulls=True).over(ranked).alias("best_first"),
    )
    indel = F.when(F.col("first"), F.col("whole"))
    other = F.when(F.col("one") == F.col("own"), F.col("two")).otherwise(F.col("one"))
    seen = F.when(edited, F.col("n_edited") - 1 + indel.isNotNull().cast("int")).otherwise(F.col("n_first"))
    found = scanned.select("word", "n", seen.cast("bigint").alias("seen"), F.when(edited, F.least(other, indel)).otherwise(F.col("best_first")).alias("near")).where("seen > 0")
    none = words.select("word", "n", F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast(found.schema["near"].dataType).alias("near"))
    total = found.unionByName(none).groupBy("word").agg(F.first("n").alias("n"), F.sum("seen").alias("n_near"), F.min("near").alias("near"))
    return total.select("word", "n", "n_near", (-F.col("near.less")).alias("near_n"), F.col("near.w").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for links (word, form): the last form that each word leads to.

    The links have no circles (a form is more frequent than its word).
    """
    at = common.written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        before, at = at, common.written(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        common.dropped(before)
        if not at.where("moved").limit(1).count():
            return at.select("word", "root")
        at = at.drop("moved")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least: int = LEAST, ratio: int = RATIO, every: int = EVERY) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    words = common.written(vocabulary(docs, doc_id, text, least_chars, least, every), "words")
    near = neighbours(words)
    leads = F.col("near_n") >= ratio * F.col("n")
    rows = common.written(near.select("word", "n", "n_near", F.when(leads, F.col("near")).alias("form"), F.when(leads, F.col("near_n")).alias("form_n")), "forms")
    common.dropped(words)
    last = roots(rows.where("form IS NOT NULL"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
