"""Quotation linking for conversations (DataFrame functions only).

A line's quote level is the number of ">" in front of it. Consecutive lines of one level
without a blank line between them are a passage, whose lines are joined and normalised
(markers off, A-Z lower-cased, white space to one blank), so re-wrapped quotes are the same
passage. Passages are hashed and joined, within a conversation, to own passages (level 0):

* an equal own passage, or one line of it: the latest one before the quote is the original;
* else, for passages of WINDOW words or more, by windows of WINDOW words: the quote's
  windows, end to end and one at its end, each meet the earliest message that has the
  window anywhere in an own passage. If all are found before the quote, the original is
  the message that had the last of them. So parts of a passage are linked too.

A message replies to the latest original of its first-level quotes, else to nothing.
Replies make threads (connected components; a thread starts at its earliest message).
Messages stand in order of their threads' starts, in a thread by turn, and so after what
they quote, with the quotes, and lines that only announce them ("... wrote:"), left out.

Own passages and windows are first counted down to one row for each conversation, hash and
turn (windows: and hash), so what every message has doesn't multiply. "Latest before" and
positions come from blocks of BLOCK turns, so a very long conversation isn't ordered in one
task; messages of one turn (or with null turns) in one conversation are.

Defined cases: null text has no lines and an empty body; rows with a null conversation
form one conversation, null turns come first and are no originals of each other; rows
equal in conversation and turn are ordered by role and text; quotes of nothing known, or
only of the same turn, are removed and counted as unlinked; an empty table gives an empty
result. Extra columns pass through, whatever their names; added columns replace those of
the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .components import connected

BLOCK, WINDOW = 1024, 8
MARKS = r"^[ \t]*>(?:[ \t]?>)*[ \t]?"
ADDED = ("body", "reply_to", "n_quoted", "n_linked", "depth", "position")


def _parsed(text: Column) -> Column:
    """(level, line, announces) of each line."""
    split = F.split(F.coalesce(text, F.lit("")), "\r?\n")
    return F.transform(
        split,
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"),
            F.regexp_replace(x, MARKS, "").alias("line"),
            F.rlike(x, F.lit(r"^[^>].*\bwrote:\s*$")).alias("announces"),
        ),
    )


def _own(lines: Column) -> Column:
    """(level, line), blank for lines of white space and for those that announce a quote."""

    def one(x: Column, k: Column) -> Column:
        announces = x["announces"] & (x["level"] == 0) & (F.coalesce(F.get(lines, k + 1)["level"], F.lit(0)) > 0)
        bare = announces | (F.trim(x["line"], F.lit(common.BLANKS)) == "")
        return F.struct(x["level"].alias("level"), F.when(bare, "").otherwise(x["line"]).alias("line"))

    return F.transform(lines, one)


def _passages(lines: Column) -> Column:
    """(level, text) of each passage: lines of one level without a blank one between them.

    They are joined and cut again by marks (characters 1 and 2, which count as 3 in a text).
    """

    def one(x: Column, k: Column) -> Column:
        last = F.get(lines, k - 1)
        goes_on = (k > 0) & (x["line"] != "") & (last["line"] != "") & (last["level"] == x["level"])
        return F.concat(F.when(F.coalesce(goes_on, F.lit(False)), " ").otherwise(F.concat(F.lit("\x01"), x["level"], F.lit("\x02"))), F.translate(x["line"], "\x01\x02", "\x03\x03"))

    cut = F.split(F.array_join(F.transform(lines, one), ""), "\x01")
    made = F.transform(cut, lambda x: F.struct(F.substring_index(x, "\x02", 1).try_cast("int").alias("level"), F.substring_index(x, "\x02", -1).alias("line")))
    return F.filter(made, lambda x: x["level"].isNotNull() & (x["line"] != ""))


def _words(line: Column) -> Column:
    return common.blank_words(common.ascii_lower(line))


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a message: its columns, body, reply_to, n_quoted, n_linked, depth, position.

    n_quoted and n_linked count passages; depth is the deepest quote level.
    """
    kept = [c for c in messages.columns if c.lower() not in ADDED]
    named = [f"k{n}" for n in range(len(kept))]  # free of any name used below
    own = [F.col(common.quoted(c)) for c in (conv, turn, role, text)]
    base = messages.select(
        *(F.col(common.quoted(c)).alias(n) for c, n in zip(kept, named, strict=True)),
        F.coalesce(own[0].cast("string"), F.lit("\x00null")).alias("c"),
        F.coalesce(own[1].cast("bigint"), F.lit(-(2**63))).alias("t"),
        F.xxhash64(own[2], own[3]).alias("d"),
        own[2].alias("r"),
        own[3].alias("x"),
        _parsed(own[3]).alias("ls"),
    )
    quoting = base.where(F.contains("x", F.lit(">"))).where(F.exists("ls", lambda x: x["level"] > 0))
    # Only conversations with a quote have anything to link.
    some = quoting.select("c").distinct()
    cut = base.join(some, "c", "left_semi").select("c", "t", "d", _own(F.col("ls")).alias("ls"))
    block = F.floor(F.col("t") / BLOCK).alias("b")
    parts = cut.select("c", "t", "d", F.posexplode(_passages(F.col("ls"))).alias("at", "p")).select("c", "t", "d", "at", F.col("p.level").alias("level"), _words(F.col("p.line")).alias("w"), block)
    parts = common.written(parts.where(F.size("w") > 0).withColumn("h", F.xxhash64("w")), "passages")
    lines = cut.select("c", "t", F.explode(F.filter("ls", lambda x: (x["level"] == 0) & (x["line"] != ""))).alias("l"), block).select("c", F.xxhash64(_words(F.col("l.line"))).alias("h"), "b", "t")
    # Repeated rows of a message have the same passages at the same places, which count once.
    quotes = parts.where("level > 0").dropDuplicates(["c", "t", "d", "at"])

    owned = parts.where("level = 0").select("c", "h", "b", "t").unionByName(lines).distinct()
    blocks = owned.groupBy("c", "h", "b").agg(F.max("t").alias("top")).unionByName(quotes.select("c", "h", "b").distinct().withColumn("top", F.lit(None).cast("bigint"))).groupBy("c", "h", "b").agg(F.max("top").alias("top"))
    earlier = blocks.withColumn("before", F.max("top").over(Window.partitionBy("c", "h").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).select("c", "h", "b", "before")
    both = owned.withColumn("own", F.col("t")).unionByName(quotes.select("c", "h", "b", "t").distinct(), allowMissingColumns=True).groupBy("c", "h", "b", "t").agg(F.max("own").alias("own"))
    near = both.withColumn("near", F.max("own").over(Window.partitionBy("c", "h", "b").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)))
    equal = near.join(earlier, ["c", "h", "b"]).select("c", "h", "t", F.coalesce("near", "before").alias("same"))
    found = quotes.join(equal, ["c", "h", "t"], "left")

    n, i = F.size("w"), F.col("i")
    window = lambda at: F.xxhash64(F.slice("w", at, WINDOW)).alias("h")
    rest = found.where(F.col("same").isNull() & (n >= WINDOW)).select("c", "t", "d", "at", "w", F.explode(F.array_distinct(F.concat(F.sequence(F.lit(1), n - WINDOW + 1, F.lit(WINDOW)), F.array(n - WINDOW + 1)))).alias("i"))
    rest = rest.select("c", "t", "d", "at", window(i))
    first = parts.where("level = 0").where(n >= WINDOW).join(rest.select("c").distinct(), "c", "left_semi").select("c", "t", "w", F.explode(F.sequence(F.lit(1), n - WINDOW + 1)).alias("i")).select("c", "t", window(i)).groupBy("c", "h").agg(F.min("t").alias("origin"))
    by_window = rest.join(first, ["c", "h"], "left").groupBy("c", "t", "d", "at").agg(F.max("origin").alias("origin"), F.bool_and(F.coalesce(F.col("origin") < F.col("t"), F.lit(False))).alias("all"))
    by_window = by_window.where("all").select("c", "t", "d", "at", "origin")

    origin = F.coalesce("same", "origin")
    links = found.join(by_window, ["c", "t", "d", "at"], "left").groupBy("c", "t", "d").agg(
        F.max(F.when(F.col("level") == 1, origin)).alias("reply_to"),
        F.count("*").alias("n_quoted"),
        F.count(origin).alias("n_linked"),
        F.max("level").alias("depth"),
    )
    links = common.written(links, "replies")
    node = lambda t: F.struct("c", F.col(t).alias("t"))
    threads = connected(links.where("reply_to is not null").select(node("t").alias("a"), node("reply_to").alias("b")))
    threads = threads.select(F.col("node.c").alias("c"), F.col("node.t").alias("t"), F.col("component.t").alias("root"))

    ls = F.col("ls")
    mine = F.filter(ls, lambda x, k: (x["level"] == 0) & ~(x["announces"] & (F.coalesce(F.get(ls, k + 1)["level"], F.lit(0)) > 0)))
    body = F.trim(F.array_join(F.transform(mine, lambda x: x["line"]), "\n"), F.lit(common.BLANKS))
    told = base.withColumn("body", body).drop("ls").join(links, ["c", "t", "d"], "left").join(threads, ["c", "t"], "left").withColumn("root", F.coalesce("root", "t"))
    # A block is a range of (root, turn): starts come from counts of ranges of roots, then of one root's turns.
    blocks = F.floor(F.col("root") / BLOCK).alias("rb"), F.floor(F.col("t") / BLOCK).alias("tb")
    counts = base.select("c", "t").join(threads, ["c", "t"], "left").withColumn("root", F.coalesce("root", "t")).groupBy("c", *blocks, "root").agg(F.count("*").alias("n"))
    counts = common.written(counts, "turns")
    running = lambda keys, order: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    outer = counts.groupBy("c", "rb").agg(F.sum("n").alias("n")).select("c", "rb", running(["c"], ["rb"]).alias("outer"))
    inner = counts.select("c", "rb", "root", "tb", running(["c", "rb"], ["root", "tb"]).alias("inner"))
    starts = inner.join(outer, ["c", "rb"]).select("c", "root", "tb", (F.col("outer") + F.col("inner")).alias("start"))
    told = told.withColumn("tb", blocks[1]).join(starts, ["c", "root", "tb"])
    place = F.row_number().over(Window.partitionBy("c", "root", "tb").orderBy("t", "r", "x"))
    none = F.lit(0).cast("bigint")
    return told.select(
        *(F.col(n).alias(c) for c, n in zip(kept, named, strict=True)),
        "body",
        F.when(F.col("reply_to") > -(2**63), F.col("reply_to")).alias("reply_to"),
        F.coalesce("n_quoted", none).alias("n_quoted"),
        F.coalesce("n_linked", none).alias("n_linked"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        (F.col("start") + place).cast("bigint").alias("position"),
    )
