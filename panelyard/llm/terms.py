"""A sparse document-term matrix in CSR shards, with one dictionary for all of them.

A task reads its documents once and cuts them into shards of about SHARD_BYTES of text. A
shard's words are coded by its own dictionary, and its rows become a local CSR block; both
go to the shared folder. Each shard then sends its distinct words once, by ranges of their
hash, to buckets that number the words of all shards, and gets the numbers back. A shard's
columns are renumbered by them: entry (d, w) of the matrix is how often document d has the
word of number w. Texts themselves are never shuffled.

Numbers are rank * buckets + bucket, the rank being that of the word's bytes in its bucket,
so they depend on the set of words and the number of buckets alone, and words are compared
as they are, not by hashes.

Cost and bounds: linear in the text. A task holds one shard (or one text, if longer) or one
bucket: the distinct words of each shard in its range, of at most packed.BUCKET_BYTES of
text altogether. A word that is in every text costs one entry a shard.

Defined cases: null and blank texts are rows without entries; very long texts are one row
each; repeated rows are a row each; null ids are kept; an empty table gives no shards. The
columns that pass through may have any name, as they are renamed inside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, packed

SHARD_BYTES = 1 << 23


def _narrow(values: np.ndarray) -> bytes:
    """Values from 0 at the least width; the first byte is that width."""
    width = next(w for w in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)


def bucket_of(words: pa.Array, buckets: int) -> np.ndarray:
    """The bucket of each word, by ranges of its hash."""
    return ((packed.hash_strings(words) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def csr(codes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """indptr, indices (rising in a row) and counts of rows whose entries are codes below `width`."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    cells, counts = np.unique(rows * max(width, 1) + codes, return_counts=True)
    return np.searchsorted(cells, np.arange(len(offsets)) * max(width, 1)), cells % max(width, 1), counts


def _coded(table: pa.Table, shard: int, buckets: int) -> pa.RecordBatch:
    """A shard's rows: one of its local matrix, then one for each bucket of its words."""
    coded, offsets = packed.words(table.column("text"))
    words = coded.dictionary
    own = bucket_of(words, buckets)
    order = np.argsort(own, kind="stable")
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    indptr, indices, counts = csr(place[np.asarray(coded.indices, np.int64)], offsets, len(words))
    full, sizes = np.unique(own, return_counts=True)
    joined = pc.binary_join_element_wise(words.take(pa.array(order)), pa.scalar("", words.type), pa.scalar(" ", words.type))
    ends = np.concatenate(([0], np.asarray(pc.binary_length(joined), np.int64).cumsum()))[np.concatenate(([0], np.cumsum(sizes)))]
    data = joined.buffers()[2]
    sent = [data[a : b - 1].to_pybytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    n = len(full) + 1
    alone = lambda x, kind: pa.array([x] + [None] * (n - 1), kind)
    kept = {}
    for name in table.column_names:
        if name != "text":
            column = table.column(name).combine_chunks()
            first = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
            kept[name] = pa.concat_arrays([first, pa.nulls(n - 1, first.type)])
    found = {
        "shard": pa.array([shard] * n, pa.int64()),
        "bucket": pa.array([-1, *full.tolist()], pa.int32()),
        "words": pa.array([None, *sent], pa.binary()),
        "indptr": alone(_narrow(indptr), pa.binary()),
        "indices": alone(_narrow(indices), pa.binary()),
        "counts": alone(_narrow(counts), pa.binary()),
        **kept,
    }
    packed.release()
    return pa.RecordBatch.from_pydict(found)


def coded(docs: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, dict[str, str], int]:
    """The written local shards, the names of the columns that pass through, and the buckets' number."""
    _, buckets = packed.numbers(docs.sparkSession, packed.text_bytes(docs, F.col(common.quoted(text))))
    names = {f"k{n}": c for n, c in enumerate(c for c in docs.columns if c != text)}
    rows = docs.select(*(F.col(common.quoted(c)).alias(n) for n, c in names.items()), F.col(common.quoted(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in packed.sliced(batch, "text", shard_bytes):
                own = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if held and size + own > shard_bytes:
                    yield _coded(pa.Table.from_batches(held), shard, buckets)
                    shard, held, size = shard + 1, [], 0
                held.append(part)
                size += own
        if held:
            yield _coded(pa.Table.from_batches(held), shard, buckets)

    fields = [T.StructField(f.name, T.ArrayType(f.dataType)) for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType([*T._parse_datatype_string("shard bigint, bucket int, words binary, indptr binary, indices binary, counts binary").fields, *fields])
    return common.written(rows.mapInArrow(run, schema), "shards"), names, buckets


def _bucket_words(rows: pa.Table) -> tuple[pa.ChunkedArray, np.ndarray]:
    """All words of a bucket's rows, one after the other, and where each row's begin."""
    lists = pc.split_pattern(rows.column("words").cast(pa.large_string()), " ").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    return lists.flatten(), np.asarray(lists.offsets, np.int64)


def _ranks(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's rank among the distinct ones in byte order, and these."""
    codes = words.dictionary_encode()
    order = np.asarray(pc.sort_indices(codes.dictionary.cast(pa.large_binary())), np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[np.asarray(codes.indices, np.int64)], codes.dictionary.take(pa.array(order))


def _numbered(local: DataFrame, buckets: int) -> DataFrame:
    """(shard, bucket, numbers): the global numbers of each shard's words, in the order sent."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        words, starts = _bucket_words(rows)
        rank, _ = _ranks(words)
        numbers = rank * buckets + key[0].as_py()
        blobs = [_narrow(numbers[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        packed.release()
        return pa.table({"shard": rows.column("shard"), "bucket": rows.column("bucket"), "numbers": pa.array(blobs, pa.binary())})

    sent = local.where("bucket >= 0").select("shard", "bucket", "words")
    return sent.groupBy("bucket").applyInArrow(run, "shard bigint, bucket int, numbers binary")


def dictionary(local: DataFrame, buckets: int) -> DataFrame:
    """(number, word) of every distinct word of the shards."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        _, distinct = _ranks(_bucket_words(rows)[0])
        return pa.table({"number": np.arange(len(distinct)) * buckets + key[0].as_py(), "word": distinct.cast(pa.string())})

    return local.where("bucket >= 0").select("bucket", "words").groupBy("bucket").applyInArrow(run, "number bigint, word string")


Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def _shards(local: DataFrame, buckets: int, make: Callable[[pa.Table, Block], pa.Table], schema: T.StructType) -> DataFrame:
    """make(columns, (indptr, indices, counts)) of every shard, its columns numbered globally."""

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        numbers = sorted(zip(found.column("bucket").to_pylist(), found.column("numbers").to_pylist(), strict=True))
        own = np.concatenate([np.zeros(0, np.int64), *(_wide(blob) for _, blob in numbers)])
        indptr, indices, counts = (_wide(rows.column(c)[0].as_py()) for c in ("indptr", "indices", "counts"))
        out = make(rows.drop_columns(["indptr", "indices", "counts"]), (indptr, own[indices], counts))
        packed.release()
        return out

    blocks = local.where("bucket < 0").drop("bucket", "words")
    return blocks.groupBy("shard").cogroup(_numbered(local, buckets).groupBy("shard")).applyInArrow(run, schema)


def matrix(local: DataFrame, names: dict[str, str], buckets: int) -> DataFrame:
    """CSR shards: shard, indptr, indices, counts, and each passed column as one array a shard."""
    kept = [local.schema[n] for n in names]
    schema = T.StructType([*T._parse_datatype_string("shard bigint, indptr array<bigint>, indices array<bigint>, counts array<bigint>").fields, *kept])

    def make(rows: pa.Table, block: Block) -> pa.Table:
        arrays = {c: pa.array([x], pa.list_(pa.int64())) for c, x in zip(("indptr", "indices", "counts"), block, strict=True)}
        return pa.table({"shard": rows.column("shard"), **arrays, **{n: rows.column(n) for n in names}})

    own = {"shard", "indptr", "indices", "counts"}
    return common.restored(_shards(local, buckets, make, schema), {**{c: c for c in own}, **{n: c if c.lower() not in own else f"doc_{c}" for n, c in names.items()}})


def row_stats(local: DataFrame, names: dict[str, str], buckets: int) -> DataFrame:
    """One row a document: the passed columns, n_words (the row's sum) and n_distinct (its nonzero entries)."""
    kept = [T.StructField(n, local.schema[n].dataType.elementType) for n in names]
    schema = T.StructType([*kept, *T._parse_datatype_string("n_words bigint, n_distinct bigint").fields])

    def make(rows: pa.Table, block: Block) -> pa.Table:
        indptr, _, counts = block
        total = np.concatenate(([0], np.cumsum(counts)))[indptr]
        each = {n: rows.column(n).combine_chunks().flatten() for n in names}
        return pa.table({**each, "n_words": np.diff(total), "n_distinct": np.diff(indptr)})

    return common.restored(_shards(local, buckets, make, schema), {**names, "n_words": "n_words", "n_distinct": "n_distinct"})
