"""Jaccard self-join of documents on word n-grams, as connected components.

The join is the product of the document by n-gram incidence matrix with its transpose,
kept sparse by the bounds that the sizes of two sets imply:

1. Columns: all n-gram hashes meet in buckets by value and come back with the number of
   documents that have them (exact up to 32, then to about a tenth). Each document orders
   its n-grams from rare to frequent and keeps the first few, as many as a link must share
   at least one of; of these, n-grams that no other document has can't link it and go. Its
   incidence row has the columns that some other document has too; no others can overlap.
2. Rows: documents with equal sets become one row (a class).
3. The product over the kept columns says which pairs are to be computed at all: the
   documents of a column meet its cleanest document (the one with the fewest rarer
   n-grams), if sizes and places leave room for enough overlap.
4. Blocks: the pairs of one row are dealt over SALTS blocks, each of which gets the row
   once. A task takes a block's incidence rows, maps their hashes to columns, multiplies
   the two sparse matrices on the wanted cells, and accumulates the overlaps. Cells under
   the bound num * (n + m - overlap) go.
5. Components of the links so far; then, for columns that still hold several components,
   the documents outside the cleanest one's component do the same; at last every pair
   that is still in different components, of like size and with room is computed. So no
   link between components is lost, and pairs inside one aren't expanded.

A frequent column's documents are split by hash, with its cleanest document copied to each
part, so no task holds a whole column; the last step also splits them by size, as linked
sets differ by den / num at most. Its cost is that of the pairs of different components
which share a rare n-gram and have room for a link.

Defined cases: null, empty and wordless texts have empty sets and link with nothing, as
their own component; fewer words than the n-gram size are one n-gram; repeated ids are
separate rows; the component's id is the smallest id in it, nulls ignored; an empty table
gives an empty result. `join` returns its own columns only; `representatives` passes all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, packed
from .components import connected

#: Parts that one row's pairs are dealt over, and rows of a column in one part.
SALTS, PART = 64, 1024
#: Bytes of incidence rows that are multiplied at once.
SLICE = 1 << 22
#: Rows of documents that are ordered at once.
ROWS = 1 << 9


def ngrams(text: pa.Array | pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-grams (with repeats) and the text's number of each."""
    hashes, offsets = packed.word_hashes(text, lower=True)
    found, starts = packed.window_hashes(hashes, offsets, size)
    owner = np.searchsorted(offsets, starts, "right") - 1
    counts = np.diff(offsets)
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = packed.whole_hashes(hashes, offsets, short)
    return np.concatenate((found, whole)), np.concatenate((owner, short))


def coarse(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte, in order: exact up to 32, then six steps for each doubling."""
    return np.where(counts <= 32, counts, np.minimum(32 + np.floor(6 * np.log2(np.maximum(counts, 32) / 32)), 255)).astype(np.uint8)


#: About the smallest count of each byte.
COUNTS = np.array([k if k <= 32 else math.ceil(32 * 2 ** ((k - 32) / 6)) for k in range(256)], np.int64)


def _incidence(docs: DataFrame, doc_id: str, text: str, size: int, num: int, den: int) -> DataFrame:
    """One row a document: id, n, sig (of the set), and for candidates prefix and body (its row)."""
    ids, texts = F.col(common.quoted(doc_id)), F.col(common.quoted(text))
    groups, n = packed.numbers(docs.sparkSession, packed.text_bytes(docs, texts))
    # Rows without text have no n-grams, so any group will do.
    grp = F.when(F.coalesce(F.octet_length("text"), F.lit(0)) == 0, F.floor(F.rand(1) * groups)).otherwise(F.pmod("key", F.lit(groups))).cast("int")
    grouped = docs.select(ids.alias("id"), texts.alias("text")).withColumns({"key": F.xxhash64("id", "text"), "digest": F.xxhash64("text")}).withColumn("grp", grp)

    def emit(key: tuple, rows: pa.Table) -> pa.Table:
        found, owner = ngrams(rows.column("text"), size)
        unique, inverse = np.unique(found, return_inverse=True)
        once = np.unique(owner * max(len(unique), 1) + inverse)  # a document counts once
        counts = np.bincount(once % max(len(unique), 1), minlength=len(unique))
        return packed.shipped(key[0].as_py(), unique, n, coarse(counts))

    def resolve(key: tuple, rows: pa.Table) -> pa.Table:
        senders, starts, parts, order = packed.gathered(rows)
        extra = rows.column("extra").to_pylist()
        every, own = np.concatenate(parts), np.frombuffer(b"".join(extra[k] for k in order), np.uint8)
        _, inverse = np.unique(every, return_inverse=True)
        counts = coarse(np.bincount(inverse, weights=COUNTS[own]))[inverse]
        return packed.answered(senders, key[0].as_py(), [counts[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)])

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        found, owner = ngrams(rows.column("text"), size)
        unique, inverse = np.unique(found, return_inverse=True)
        counts = np.ones(len(unique), np.uint8)
        at = packed.cuts(unique, n)
        for bucket, answer in zip(answers.column("bucket").to_pylist(), answers.column("answer").to_pylist(), strict=True):
            counts[at[bucket] : at[bucket + 1]] = np.frombuffer(answer, np.uint8)
        order = np.argsort(owner, kind="stable")
        found, owner, inverse, seen, out = None, owner[order], inverse[order], set(), []
        for k in range(0, len(rows), ROWS):
            a, b = np.searchsorted(owner, [k, k + ROWS])
            out.append(_rows(rows.slice(k, ROWS), owner[a:b] - k, inverse[a:b], unique, counts, seen))
        packed.release()
        return pa.concat_tables(out) if out else _rows(rows, owner, inverse, unique, counts, seen)

    def _rows(rows: pa.Table, owner: np.ndarray, inverse: np.ndarray, unique: np.ndarray, counts: np.ndarray, seen: set) -> pa.Table:
        # One sort puts each document's distinct n-grams in order of (frequency, hash).
        lexical = np.unique((owner.astype(np.uint64) << np.uint64(40)) | (counts[inverse].astype(np.uint64) << np.uint64(32)) | inverse.astype(np.uint64))
        doc, ref = (lexical >> np.uint64(40)).astype(np.int64), (lexical & np.uint64(0xFFFFFFFF)).astype(np.int64)
        sizes = np.bincount(doc, minlength=len(rows))
        first = np.concatenate(([0], np.cumsum(sizes)))
        place = np.arange(len(doc)) - first[doc]
        shared = counts[ref] > 1 if len(ref) else np.zeros(0, bool)
        kept = (place < (sizes - (num * sizes + den - 1) // den + 1)[doc]) & shared
        sums = [np.concatenate(([np.uint64(0)], np.cumsum(x))) for x in (unique[ref], packed.mix(unique[ref] + np.uint64(1)))]
        marks = [packed.mix(s[first[1:]] - s[first[:-1]] + sizes.astype(np.uint64)) for s in sums]
        sig = np.stack([m.astype(">u8").view(np.uint8).reshape(-1, 8) for m in marks], 1).reshape(-1, 16)
        out: dict[str, list] = {"sig": [], "prefix": [], "body": []}
        picks = np.flatnonzero(kept)
        edges = np.searchsorted(picks, first)
        for k in range(len(rows)):
            s, mine = sig[k].tobytes() if sizes[k] else None, picks[edges[k] : edges[k + 1]]
            new = len(mine) > 0 and s not in seen
            if new:
                seen.add(s)
                own = slice(first[k], first[k + 1])
            out["sig"].append(s)
            out["prefix"].append([{"h": int(h), "pos": int(p), "df": int(c)} for h, p, c in zip(unique[ref[mine]].view(np.int64), place[mine], COUNTS[counts[ref[mine]]], strict=True)] if new else None)
            out["body"].append(packed.pack(np.sort(unique[ref[own][shared[own]]])) if new else None)
        return pa.table(
            {
                "id": rows.column("id"),
                "key": rows.column("key"),
                "digest": rows.column("digest"),
                "n": pa.array(sizes, pa.int64()),
                "sig": pa.array(out["sig"], pa.binary()),
                "prefix": pa.array(out["prefix"], pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int64()), ("df", pa.int64())]))),
                "body": pa.array(out["body"], pa.binary()),
            }
        )

    kind = grouped.schema["id"].dataType.simpleString()
    hashes = grouped.groupBy("grp").applyInArrow(emit, packed.SHIPPED)
    answers = hashes.groupBy("bucket").applyInArrow(resolve, packed.ANSWER)
    return grouped.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(finish, f"id {kind}, key bigint, digest bigint, n bigint, sig binary, prefix array<struct<h:bigint,pos:bigint,df:bigint>>, body binary")


def _room(num: int, den: int) -> Column:
    """Whether the sizes na, nb and the places pa, pb of a shared n-gram leave room for a link."""
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return (den * small >= num * large) & ((num + den) * rest >= num * (F.col("na") + F.col("nb")))


def _overlaps(pairs: DataFrame, bodies: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, by a product of incidence rows in blocks."""
    right = pairs.join(bodies.select(F.col("sig").alias("b"), F.col("body").alias("y")), "b").withColumn("block", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    blocks = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("block")).distinct()
    left = blocks.join(bodies.select(F.col("sig").alias("a"), F.col("body").alias("x")), "a")
    met = right.join(left, ["a", "block"]).select("a", "b", "na", "nb", "x", "y")

    def count(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            size = np.cumsum(np.asarray(pc.binary_length(batch.column("x"))) + np.asarray(pc.binary_length(batch.column("y"))))
            k = 0
            while k < len(batch):
                j = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + SLICE, "right")))
                part = batch.slice(k, j - k)
                both = overlaps(part.column("x"), part.column("y"))
                total = np.asarray(part.column("na")) + np.asarray(part.column("nb"))
                good = np.flatnonzero(den * both >= num * (total - both))
                yield part.select(["a", "b"]).take(pa.array(good, pa.int64()))
                k = j
            packed.release()

    return met.mapInArrow(count, "a binary, b binary")


def overlaps(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Cells (k, k) of the product of two incidence matrices, whose rows are packed hashes."""
    coded = x.dictionary_encode()
    left, right = ([packed.unpack(t) for t in rows.to_pylist()] for rows in (coded.dictionary, y))
    row_of = lambda rows: np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    hashes = np.concatenate([*left, *right]) if left or right else np.zeros(0, np.uint64)
    columns = np.unique(hashes, return_inverse=True)[1]
    width, cut = int(columns.max(initial=0)) + 1, sum(map(len, left))
    cells = row_of(left) * width + columns[:cut]  # in order, as rows are and their columns are
    pair = row_of(right)
    wanted = np.asarray(coded.indices)[pair] * width + columns[cut:]
    at = np.minimum(np.searchsorted(cells, wanted), max(len(cells) - 1, 0))
    return np.bincount(pair[cells[at] == wanted], minlength=len(y)) if len(cells) else np.zeros(len(y), np.int64)


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id, key, digest, stands), one row a document.

    Links have a Jaccard similarity of num / den or more; stands marks the rows that
    represent their component; key and digest are hashes of (id, text) and text.
    """
    rows = common.written(_incidence(docs, doc_id, text, size, num, den), "incidence")
    # One of the rows with equal sets stands for the class; its body is read where it was written.
    # From here on a class is named by its set's mark and that row's key.
    named_by = F.concat("sig", F.unhex(F.lpad(F.hex("key"), 16, "0")))
    classes = rows.where("body is not null").groupBy("sig").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("prefix").alias("prefix")).withColumn("sig", named_by)
    bodies = rows.where("body is not null").select(named_by.alias("sig"), "body")
    posts = classes.select("sig", "n", F.explode("prefix").alias("p")).select(F.col("p.h").alias("h"), F.col("p.pos").alias("pos"), F.greatest(F.ceil(F.col("p.df") / PART), F.lit(1)).alias("parts"), "sig", "n")
    posts = common.written(posts.withColumn("part", F.pmod(F.xxhash64("sig"), F.col("parts"))), "columns")
    band = F.floor(F.ln("n") / (1.0001 * math.log(den / num))) if num < den else F.col("n")

    def pairs_of(lead: DataFrame, rest: DataFrame) -> DataFrame:
        met = rest.select("h", "part", F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb")).join(lead, ["h", "part"]).where(F.col("a") != F.col("b")).where(_room(num, den))
        turned = F.col("a") > F.col("b")
        swap = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
        return met.select(swap("a", "b").alias("a"), swap("b", "a").alias("b"), swap("na", "nb").alias("na"), swap("nb", "na").alias("nb")).distinct()

    def leaders(rows: DataFrame) -> DataFrame:
        least = rows.groupBy("h").agg(F.min(F.struct("pos", "n", "sig")).alias("m"), F.max("parts").alias("parts"), F.count("*").alias("c")).where("c > 1")
        return least.select("h", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("m.sig").alias("a"), F.col("m.n").alias("na"), F.col("m.pos").alias("pa"))

    links, tested, open_rows, groups, spent = None, None, posts, None, []
    for step in range(3):
        if step < 2:
            pairs = pairs_of(leaders(open_rows), open_rows)
        else:  # whatever is left: each unordered pair of different components, by size and by parts of the column
            left = open_rows.select("h", band.alias("band"), "part", F.col("sig").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("component").alias("ca"))
            near = F.explode(F.array(band - 1, band, band + 1) if num < den else F.array(band)).alias("band")
            right = open_rows.select("h", near, "parts", F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("component").alias("cb"))
            right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
            pairs = left.join(right, ["h", "band", "part"]).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))).where(_room(num, den)).select("a", "b", "na", "nb").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = common.written(pairs, "pairs")
        good = common.written(_overlaps(pairs, bodies, num, den), "good")
        links = good if links is None else links.unionByName(good)
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        spent += [pairs, good] + ([groups] if groups is not None else [])
        groups = common.written(connected(links), "components")
        if step == 2:
            break
        named = posts.join(groups.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
        # Columns with one component are done; in the others, the cleanest document's is set aside.
        seen = named.groupBy("h").agg(F.min(F.struct("pos", "n", "sig", "component")).alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("parts").alias("parts")).where("lo <> hi")
        seen = seen.select("h", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("m.component").alias("main"))
        open_rows = named.join(seen, ["h", "part"])
        open_rows = common.written(open_rows.where("component <> main").drop("main") if step == 0 else open_rows.drop("main"), "open")
        spent.append(open_rows)

    for done in (posts, *spent):  # components are written, so nothing reads what they came from
        common.dropped(done)

    # Of equal sets, then of a component, the row with the smallest id (nulls last) stands for all.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest"))
    own = rows.where("sig is not null").groupBy("sig").agg(first.alias("m"), F.min("id").alias("least"))
    linked = own.join(groups.select(F.substring("node", 1, 16).alias("sig"), "component"), "sig")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.min("m").alias("top"))
    # A component's smallest id goes to each of SALTS parts of it, so a large one is joined in parts.
    least = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    parts = linked.select("sig", "component", F.pmod(F.xxhash64("sig"), F.lit(SALTS)).alias("part")).join(least, ["component", "part"]).select("sig", "component_id", "top")
    by_class = own.join(parts, "sig", "left").select("sig", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("top", "m").alias("m"))
    out = rows.select("id", "key", "digest", F.col("n").alias("n_shingles"), "sig").join(by_class, "sig", "left")
    alone = F.col("sig").isNull()
    stands = alone | (F.col("id").eqNullSafe(F.col("m.id")) & (F.col("digest") == F.col("m.digest")))
    return out.select("id", "n_shingles", F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), "key", "digest", stands.alias("stands"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each component, the one with its smallest id (nulls last, then by digest).

    Of rows that are equal in id and text one stays. Empty sets are components of their own.
    """
    kept = join(docs, doc_id, text, size, num, den).where("stands").select("key", "digest")
    key, digest = common.fresh(docs, "key"), common.fresh(docs, "digest")
    body = F.col(common.quoted(text))
    own = docs.withColumns({key: F.xxhash64(F.col(common.quoted(doc_id)), body), digest: F.xxhash64(body)})
    kept = kept.select(F.col("key").alias(key), F.col("digest").alias(digest))
    return own.join(kept, [key, digest], "left_semi").dropDuplicates([key, digest]).select(*(common.quoted(c) for c in docs.columns))
