"""Removal of token windows that come earlier in the corpus.

Every window of `size` words gets a Rabin-Karp rolling hash; Spark gathers equal hashes
from all documents and tells each group of documents which of its windows an earlier
group has. Covered words merge into maximal intervals, which are cut from the text.

Documents are ordered by id, then by a digest of the text. Groups are ranges of that
order with about equal bytes (a heavily repeated id, or null, spans several groups), so a hash's earliest place is decided
by group number alone and no places are shipped; inside a group the order is exact.
Windows are compared by 61-bit Rabin-Karp hashes modulo a prime. Cost is linear in the
text and tasks are bounded by bytes, as packed.py states.

Defined cases: null, empty and short texts have no windows and stay as they are, in any
group, so that many of them don't load one; ids are integers or their decimal text, and
null ids and ids that are neither come last, in the order of their texts' digests; of rows
with equal id and text one is first, and such rows share a group. A text without removals
is unchanged. Elsewhere a cut takes the white space after it, or before it at the end of
the text. Extra columns pass through; added columns replace those of the same name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, packed

SIZE = 20
ADDED = ("n_words", "n_removed", "removed")


#: Parts of the mean text's size in which texts are weighed.
FINE = 4


def ranged(docs: DataFrame, doc_id: str, text: str, n: int, size: int, names: tuple[str, str, str]) -> DataFrame:
    """docs with three more columns: a range of (id, digest), the id as a number, and the digest.

    The ranges are n quantiles of bytes over ids. A text counts once and once more for each
    unit of 1 / FINE of the mean size, so a range has at most 1 + 1 / FINE times its share of
    bytes, half a share for the sketch's error, and one text.
    """
    grp, order, tie = names
    key, body = F.col(common.quoted(doc_id)).try_cast("bigint"), F.col(common.quoted(text))
    octets = F.coalesce(F.octet_length(body), F.lit(0))
    marks, found = [k / n for k in range(1, n)], None
    if marks:
        total = docs.agg(F.count("*").alias("n"), F.sum(octets).alias("size")).first()
        unit = max(1, (total["size"] or 0) // max(1, FINE * total["n"]))
        weighed = docs.select(F.explode(F.array_repeat(F.coalesce(key, F.lit(2**63 - 1)), (1 + F.floor(octets / unit)).cast("int"))).alias("key"))
        found = weighed.agg(F.percentile_approx("key", marks, max(10_000, 4 * n)).alias("m")).first()["m"]
    edges = np.array(found or [], np.int64)

    @F.pandas_udf("int")
    def place(ids, digests):  # noqa: ANN001, ANN202
        v = ids.fillna(np.iinfo(np.int64).max).to_numpy("int64")
        lo, hi = np.searchsorted(edges, v, "left"), np.searchsorted(edges, v, "right")
        share = digests.to_numpy("int64").astype(np.float64) / 2.0**64 + 0.5
        return ids.__class__(np.minimum(lo + (share * (hi - lo + 1)).astype(np.int64), hi).astype("int32"))

    tied = docs.withColumns({order: key, tie: F.xxhash64(body)})
    # A text of fewer characters than `size` words need has no windows, so its group doesn't matter.
    short = F.coalesce(F.octet_length(body), F.lit(0)) < 2 * size - 1
    return tied.withColumn(grp, F.when(short, F.floor(F.rand(1) * n).cast("int")).otherwise(place(F.coalesce(F.col(order), F.lit(2**63 - 1)), F.col(tie))))


def _ordered(rows: pa.Table, order: str, tie: str) -> pa.Table:
    keys = pa.table({"id": rows.column(order), "tie": rows.column(tie)})
    return rows.take(pa.compute.sort_indices(keys, sort_keys=[("id", "ascending"), ("tie", "ascending")], null_placement="at_end"))


def cut(text: str, runs: list[tuple[int, int]]) -> str:
    """text without the runs of words [first, last)."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    kept, done = [], 0
    for first, last in runs:
        if last < len(at):
            kept.append(raw[done : at[first][0]])
            done = at[last][0]
        else:
            kept.append(raw[done : at[first - 1][1]] if first and at[first - 1][1] > done else b"")
            done = len(raw)
    return b"".join([*kept, raw[done:]]).decode("utf-8", "surrogatepass")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """docs with repeated windows cut from the text, and n_words, n_removed and removed
    (the intervals of word numbers, from 0, end excluded)."""
    docs = docs.select(*(common.quoted(c) for c in docs.columns if c.lower() not in ADDED))
    groups, n = packed.numbers(docs.sparkSession, packed.text_bytes(docs, F.col(common.quoted(text))))
    grp, order, tie = (common.fresh(docs, k) for k in ("grp", "order", "tie"))
    grouped = ranged(docs, doc_id, text, groups, size, (grp, order, tie))

    def emit(key: tuple, rows: pa.Table) -> pa.Table:
        hashes, offsets = packed.word_hashes(rows.column(text))
        found, _ = packed.window_hashes(hashes, offsets, size)
        return packed.shipped(key[0].as_py(), np.unique(found), n)

    def resolve(key: tuple, rows: pa.Table) -> pa.Table:
        senders, starts, parts, _ = packed.gathered(rows)
        every = np.concatenate(parts)
        order = np.argsort(every, kind="stable")  # equal hashes stay in the order of groups
        ranked = every[order]
        later = np.zeros(len(every), bool)
        later[order[1:]] = ranked[1:] == ranked[:-1]
        bits = [later[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        return packed.answered(senders, key[0].as_py(), [np.packbits(x).tobytes() if x.any() else None for x in bits])

    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string("n_words bigint, n_removed bigint, removed array<struct<first:int,last:int>>").fields])

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows = _ordered(rows, order, tie)
        hashes, offsets = packed.word_hashes(rows.column(text))
        found, starts = packed.window_hashes(hashes, offsets, size)
        unique, first, inverse = np.unique(found, return_index=True, return_inverse=True)
        earlier = np.zeros(len(unique), bool)
        at = packed.cuts(unique, n)
        for bucket, answer in zip(answers.column("bucket").to_pylist(), answers.column("answer").to_pylist(), strict=True):
            a, b = at[bucket], at[bucket + 1]
            earlier[a:b] = np.unpackbits(np.frombuffer(answer, np.uint8), count=b - a).astype(bool)
        gone = starts[earlier[inverse] | (first[inverse] != np.arange(len(found)))]
        step = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(step, gone, 1)
        np.add.at(step, gone + size, -1)
        covered = np.cumsum(step)[:-1] > 0
        totals = np.concatenate(([0], np.cumsum(covered)))[offsets]
        removed = np.diff(totals)
        texts, spans = rows.column(text).to_pylist(), [[] for _ in range(len(rows))]
        for k in np.flatnonzero(removed):
            own = np.concatenate(([False], covered[offsets[k] : offsets[k + 1]], [False]))
            edges = np.flatnonzero(own[1:] != own[:-1]).tolist()
            runs = list(zip(edges[::2], edges[1::2], strict=True))
            texts[k], spans[k] = cut(texts[k], runs), [{"first": a, "last": b} for a, b in runs]
        out = {c: rows.column(c) for c in rows.column_names if c not in (grp, order, tie)}
        out[text] = pa.array(texts, pa.string())
        out["n_words"], out["n_removed"] = pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64())
        packed.release()
        out["removed"] = pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
        return pa.table(out)

    hashes = grouped.groupBy(grp).applyInArrow(emit, packed.SHIPPED)
    answers = hashes.groupBy("bucket").applyInArrow(resolve, packed.ANSWER)
    return grouped.groupBy(grp).cogroup(answers.groupBy("grp")).applyInArrow(finish, schema)


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """docs with repeated windows cut from the text and all else as it was."""
    rows, names = common.renamed(docs, (doc_id, text))
    return common.restored(dedup(rows, doc_id, text, size), names)
