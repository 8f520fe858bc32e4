"""Benchmark decontamination by a prefix-filtered set join (DataFrame functions only).

Benchmark items are cut into windows of ten consecutive words (an item with fewer words
is one window). Each window is a set of five-word shingles (a window of fewer words is
its own shingle). One pass over the documents hashes their shingles and keeps the places
of those that some window has. Containment must be full, so one shingle is a sufficient
prefix: the one that is rarest in the documents. Places meet the windows on that shingle
alone; the window must not start before the document does; then every shingle of the
window must lie at its own place, which is exact containment (shingles are compared by
64-bit hashes). No text takes part in a join.

Defined cases: null, empty and wordless texts have no words and match nothing; a
repeated document row gets the same result again; items may share windows, and each is
named; null item ids take part in hits but aren't listed; empty tables give no hits. The
windows' shingles (hash and count) are broadcast if they take up to BROADCAST_BYTES, which
is measured first; more are joined by shuffled hashes, with the same results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

WINDOW, SHINGLE = 10, 5
BROADCAST_BYTES = 1 << 26
#: What one hash takes in a broadcast table, about.
HASH_BYTES = 64


def item_windows(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """Distinct windows: words, their number and the items that hold them."""
    base = items.select(F.col(common.quoted(item_id)).cast("string").alias("item"), common.folded_words(F.col(common.quoted(text))).alias("w")).where("size(w) > 0")
    many = F.transform(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.slice("w", i, WINDOW))
    parts = base.select("item", F.explode(F.when(F.size("w") >= WINDOW, many).otherwise(F.array("w"))).alias("words"))
    return parts.groupBy("words").agg(F.collect_set("item").alias("items")).withColumn("len", F.size("words"))


def _shingles(rows: DataFrame, words: str, kept: list[str], sizes: list[int]) -> DataFrame:
    """kept, pos (from 1), size and h of each shingle of the given sizes.

    The hash reads the array's cells in place, so this is compiled code without copies.
    """
    each = rows.select(*kept, words, F.posexplode(words).alias("__at", "__word"))
    cells = lambda k: [F.col("__word"), *(F.get(words, F.col("__at") + i) for i in range(1, k))]
    pos = (F.col("__at") + 1).alias("pos")
    if len(sizes) == 1:
        return each.where(F.col("__at") + sizes[0] <= F.size(words)).select(*kept, pos, F.lit(sizes[0]).alias("size"), F.xxhash64(*cells(sizes[0])).alias("h"))
    made = F.array(*(F.struct(F.lit(k).alias("size"), F.when(F.col("__at") + k <= F.size(words), F.xxhash64(*cells(k))).alias("h")) for k in sizes))
    return each.select(*kept, pos, F.explode(made).alias("__s")).select(*kept, "pos", "__s.size", "__s.h").where("h is not null")


def matches(docs: DataFrame, text: str, keys: list[str], items: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every occurrence of a window in a document: the keys, start (from 1), len, items."""
    wins = common.written(item_windows(items, item_id, item_text).withColumn("id", F.xxhash64("words")), "windows")
    need = F.least("len", F.lit(SHINGLE))
    sizes = sorted(wins.agg(F.collect_set(need).alias("sizes")).first()["sizes"]) or [SHINGLE]  # at most SHINGLE
    made = [_shingles(wins.where(need == k), "words", ["id", "len"], [k]) for k in sizes]
    shingled = made[0]
    for more in made[1:]:
        shingled = shingled.unionByName(more)
    shingled = common.written(shingled.select("id", "len", (F.col("pos") - 1).alias("off"), "size", "h"), "shingles")
    vocabulary = shingled.select("size", "h").distinct()
    small = HASH_BYTES * shingled.count() <= BROADCAST_BYTES
    hint = F.broadcast if small else (lambda x: x)

    d = docs.select(*keys, common.folded_words(F.col(common.quoted(text))).alias("__w"))
    hits = common.written(_shingles(d, "__w", keys, sizes).join(hint(vocabulary), ["size", "h"], "left_semi").distinct(), "hits")
    seen = hits.groupBy("size", "h").agg(F.count("*").alias("df"))
    # The rarest shingle of each window; a window with a shingle that no document has can't occur.
    ranked = shingled.join(seen, ["size", "h"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    prefix = ranked.groupBy("id").agg(F.min(F.struct("df", "off", "size", "h")).alias("m"), F.first("len").alias("len")).where("m.df > 0").select("id", "len", "m.off", "m.size", "m.h")
    prefix = common.written(prefix, "prefix")
    met = hits.join(hint(prefix), ["size", "h"]).withColumn("start", F.col("pos") - F.col("off")).where("start >= 1").select(*keys, "start", "id", "len")
    own = shingled.select("id", "off", "size", "h")
    wanted = met.join(hint(own), "id").select(*keys, "start", "id", "len", (F.col("start") + F.col("off")).alias("pos"), "size", "h")
    found = wanted.join(hits, [*keys, "pos", "size", "h"], "left_semi").groupBy(*keys, "start", "id", "len").agg(F.count("*").alias("n"))
    whole = found.where(F.col("n") == F.greatest(F.col("len") - (SHINGLE - 1), F.lit(1)))
    return whole.join(wins.select("id", "items"), "id").select(*keys, "start", "len", "items")


def scan(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, n_hit, n_items, item_ids (sorted strings) and contaminated.

    Rows are keyed by id and a digest of the text, so rows that share an id are judged apart.
    """
    key, digest = common.fresh(docs, "key"), common.fresh(docs, "digest")
    keyed = docs.withColumns({key: F.coalesce(F.col(common.quoted(doc_id)).cast("string"), F.lit("\x00null")), digest: F.xxhash64(F.col(common.quoted(text)))})
    # One row a start: of windows that begin there the longest covers the others.
    by_start = matches(keyed, text, [key, digest], items, item_id, item_text).groupBy(key, digest, "start").agg(F.max("len").alias("len"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    w = Window.partitionBy(key, digest).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    spans = by_start.withColumn("before", F.coalesce(F.max(end).over(w), F.lit(0)))
    found = spans.groupBy(key, digest).agg(
        F.sum(F.greatest(end - F.greatest(F.col("start"), F.col("before")), F.lit(0))).cast("bigint").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
    )
    taken = ("n_words", "n_hit", "n_items", "item_ids", "contaminated")
    base = keyed.select(*(common.quoted(c) for c in keyed.columns if c.lower() not in taken), F.size(common.folded_words(F.col(common.quoted(text)))).cast("bigint").alias("n_words"))
    out = base.join(found, [key, digest], "left").drop(key, digest)
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("bigint")), "item_ids": ids, "n_items": F.size(ids).cast("bigint")}).withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, items: DataFrame, **names: str) -> DataFrame:
    """The documents without any hit word, with their own columns alone."""
    key, digest = common.fresh(docs, "key"), common.fresh(docs, "digest")
    doc_id, text = names.get("doc_id", "doc_id"), names.get("text", "text")
    keyed = docs.withColumns({key: F.coalesce(F.col(common.quoted(doc_id)).cast("string"), F.lit("\x00null")), digest: F.xxhash64(F.col(common.quoted(text)))})
    hit = matches(keyed, text, [key, digest], items, names.get("item_id", "item_id"), names.get("item_text", "text")).select(key, digest).distinct()
    return keyed.join(hit, [key, digest], "left_anti").select(*(common.quoted(c) for c in docs.columns))
