"""Numpy and Arrow helpers for tasks, and a packed exchange of hashes between them.

Texts are dealt into groups of rows. A group's hashes (of words or windows) are made
unique, sorted, cut into buckets by value and shipped as difference-coded blobs, one row
for each group and bucket, so a hash costs six or seven bytes instead of a row. A bucket
meets all groups' hashes of its range, and answers each blob in its own order.

Cost and bounds. Every hash is packed, shipped and answered once, so bytes and CPU are
linear in the text. Groups are bounded by GROUP_BYTES of text and buckets by BUCKET_BYTES
of the text behind their hashes, whatever spark.sql.shuffle.partitions is; where that
setting asks for more of them, they are smaller. So a task holds one group or one bucket
(some 15 bytes a byte of text) at any input size. Groups and buckets are keys, not
partitions: the shuffle has as many blocks as its partitions make, each of many blobs.
100 TB are 400,000 groups and 200,000 buckets, with blobs of 1.4 KB on average; a blob's
own cost (a row, some microseconds) is a few hundredths of what its hashes cost, and stays
so down to about 200 bytes. Beyond that, raise GROUP_BYTES with the executors' memory. A
hash that is in every text is one entry a group, so frequent hashes don't load a bucket.

Hashes. A string's hash sums its bytes, each mixed with its place, and mixes the sum with
the length. A window's is a Rabin-Karp polynomial over its words' hashes modulo the prime
2^61 - 1, built by doubling. Both are mixed to 64 bits; unlike polynomials modulo 2^64
they have no families of texts that always collide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUPS = 2
GROUP_BYTES, BUCKET_BYTES = 1 << 28, 1 << 29
PRIME = np.uint64((1 << 61) - 1)
#: Base of the window polynomials, below the prime.
BASE = 0x1B873593CC9E2D51 % ((1 << 61) - 1)
SLICE = 1 << 20


def release() -> None:
    """Gives memory that is free in this process back to the system, so idle workers are small."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit values modulo the prime, but for up to seven too much."""
    return (x & PRIME) + (x >> np.uint64(61))


def times(x: np.ndarray, y: int) -> np.ndarray:
    """x * y modulo the prime, by halves of 31 bits; x as `reduced` gives it, y below the prime."""
    low, high = np.uint64(y & 0x7FFFFFFF), np.uint64(y >> 31)
    a, b = x & np.uint64(0x7FFFFFFF), x >> np.uint64(31)
    middle = a * high + b * low
    return reduced(a * low + np.uint64(2) * (b * high) + (middle >> np.uint64(30)) + ((middle & np.uint64(0x3FFFFFFF)) << np.uint64(31)))


def rolled(values: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes of every run of `size` values, one for each start; doubles the length.

    A run's hash is that of its first part times BASE to the second's length, plus the second's.
    """
    if len(values) < size:
        return np.zeros(0, np.uint64)
    own, length, out, done = reduced(values), 1, None, 0
    while True:
        if size & length:
            if out is None:
                out, done = own, length
            else:
                n = len(values) - (done + length) + 1
                out = reduced(times(own[:n], pow(BASE, done, int(PRIME))) + out[length : length + n])
                done += length
        if done == size:
            out = np.where(out >= PRIME, out - PRIME, out)
            return mix(out + np.uint64(size * 0xD6E8FEB86659FD93 % 2**64))
        n = len(own) - length
        own = reduced(times(own[:n], pow(BASE, length, int(PRIME))) + own[length : length + n])
        length *= 2


def hash_strings(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's bytes."""
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    if len(strings) == 0:
        return np.zeros(0, np.uint64)
    strings = strings.cast(pa.large_binary())
    _, offsets, data = strings.buffers()
    cuts = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    out, k = np.empty(len(strings), np.uint64), 0
    while k < len(strings):  # slices bound the memory; one long string is a slice of its own
        j = max(k + 1, int(np.searchsorted(cuts, cuts[k] + SLICE, "right")) - 1)
        j = min(j, len(strings))
        own = cuts[k : j + 1] - cuts[k]
        sizes = np.diff(own)
        part = np.arange(own[-1], dtype=np.uint64) - np.repeat(own[:-1], sizes).astype(np.uint64)
        part = mix((part << np.uint64(8)) + raw[cuts[k] : cuts[j]] + np.uint64(1))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part)))
        out[k:j] = mix(sums[own[1:]] - sums[own[:-1]] + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        k = j
    return out


def words(text: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Runs without ASCII white space of all texts, and where each text's words start.

    The words are dictionary-coded. Null has none. With lower, A-Z are lower-cased.
    """
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text.cast(pa.large_string()), "")
    if lower:
        text = pc.ascii_lower(text)
    lists = pc.ascii_split_whitespace(text)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets, flat = np.asarray(lists.offsets, np.int64), lists.values
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    before = np.concatenate(([0], np.cumsum(full)))
    return flat.filter(pa.array(full)).dictionary_encode(), before[offsets]


def word_hashes(text: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    coded, offsets = words(text, lower)
    return hash_strings(coded.dictionary)[np.asarray(coded.indices)], offsets


def window_hashes(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of all runs of `size` words within a text, and where each starts."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    inside = np.arange(len(hashes)) + size <= ends
    found = np.empty(len(hashes), np.uint64)
    for k in range(0, len(hashes), 1 << 16):  # slices that stay in the processor's cache
        part = rolled(hashes[k : k + (1 << 16) + size - 1], size)
        found[k : k + len(part)] = part
    starts = np.flatnonzero(inside)
    return found[starts], starts


def whole_hashes(hashes: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Hashes of whole texts' words, for the texts `which` of few words each."""
    out, sizes = np.zeros(len(which), np.uint64), np.diff(offsets)[which]
    for n in np.unique(sizes):
        own = which[sizes == n]
        flat = hashes[(offsets[own][:, None] + np.arange(n)).ravel()]
        out[sizes == n] = rolled(flat, int(n))[:: int(n)] if n else 0
    return out


def sliced(batch: pa.RecordBatch, column: str, limit: int) -> list[pa.RecordBatch]:
    """The batch in parts of about `limit` bytes of text, at least one row each."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)))
    out, k = [], 0
    while k < len(batch):
        j = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + limit, "right")))
        out.append(batch.slice(k, j - k))
        k = j
    return out


def pack(hashes: np.ndarray) -> bytes:
    """Sorted unique hashes as fixed-width differences; the first byte is the width."""
    if len(hashes) == 0:
        return b""
    steps = np.diff(hashes, prepend=np.uint64(0))
    rest = steps[1:]
    width = max(1, (int(rest.max()).bit_length() + 7) // 8) if len(rest) else 1
    body = rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + steps[:1].astype("<u8").tobytes() + body.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    width, body = blob[0], np.frombuffer(blob, np.uint8, offset=9)
    steps = np.zeros((len(body) // width + 1, 8), np.uint8)
    steps[0] = np.frombuffer(blob, np.uint8, count=8, offset=1)
    steps[1:, :width] = body.reshape(-1, width)
    return np.cumsum(steps.view("<u8").ravel().astype(np.uint64))


def cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of values starts and ends in sorted hashes."""
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(hashes, edges), [len(hashes)]))


def shipped(grp: int, hashes: np.ndarray, buckets: int, extra: np.ndarray | None = None) -> pa.Table:
    """A group's sorted unique hashes as rows (bucket, grp, blob, extra), one a bucket."""
    release()  # what the hashes were made of
    at = cuts(hashes, buckets)
    full = [k for k in range(buckets) if at[k] < at[k + 1]]
    return pa.table(
        {
            "bucket": pa.array(full, pa.int32()),
            "grp": pa.array([grp] * len(full), pa.int32()),
            "blob": pa.array([pack(hashes[at[k] : at[k + 1]]) for k in full], pa.binary()),
            "extra": pa.array([None if extra is None else extra[at[k] : at[k + 1]].tobytes() for k in full], pa.binary()),
        }
    )


SHIPPED = "bucket int, grp int, blob binary, extra binary"
ANSWER = "grp int, bucket int, answer binary"


def text_bytes(texts: DataFrame, text: Column) -> int:
    return int(texts.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0)


def numbers(spark: SparkSession, size: int) -> tuple[int, int]:
    """How many groups and how many buckets, for so many bytes of text."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(GROUPS * n, -(-size // GROUP_BYTES)), max(n, -(-size // BUCKET_BYTES))


def gathered(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """A bucket's groups in order, where each one's hashes start, the hashes, and row order."""
    groups = np.asarray(rows.column("grp"))
    order = np.argsort(groups, kind="stable")
    blobs = rows.column("blob").to_pylist()
    parts = [unpack(blobs[k]) for k in order]
    return groups[order], np.concatenate(([0], np.cumsum([len(p) for p in parts]))), parts, order


def answered(groups: np.ndarray, bucket: int, answers: list[bytes | None]) -> pa.Table:
    release()
    kept = [k for k, a in enumerate(answers) if a is not None]
    return pa.table(
        {
            "grp": pa.array([int(groups[k]) for k in kept], pa.int32()),
            "bucket": pa.array([bucket] * len(kept), pa.int32()),
            "answer": pa.array([answers[k] for k in kept], pa.binary()),
        }
    )
