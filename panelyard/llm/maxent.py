"""A hashed maximum-entropy language model with class-factored softmax.

P(word | context) = P(class | context) P(cell | class, context) P(word | cell). Classes
hold words of similar counts, in parts of about equal mass, so a frequent word is a class
or nearly one; a class's words are dealt into cells by their hash. Both first factors are
softmaxes with hashed n-gram and skip features. That of the class has a bias (the log
masses), the word before, the word before that one (a skip), and the pair of both; that of
the cell has a bias, the word before with the class, and the pair with the class. Words
that share a cell split it by (count + 1); the last class's first cell also holds one
unknown word. Without training the model is the add-one unigram model; gradients move both
softmaxes away from it.

Counts come from all training tokens by the packed exchange: a group of documents sends
each distinct word once and gets its count back. Documents then become code and class
numbers, three bytes a token, written to the shared folder. Training takes ROUNDS rounds
over disjoint parts of all training documents: tasks start from the broadcast weights
(whose size is a parameter), take mini-batch steps with row-wise adaptive rates, and send
what they moved; Spark averages that by how often each row was updated, WAY shares at a time. Scoring gathers
only the feature rows of a slice's tokens; slices have SLICE tokens however long texts are.

Defined cases: null text is empty (its one token is the end); null ids count as training;
repeated rows count and are scored each; an empty table gives an empty result; without
training tokens every score is 0. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, packed

#: Classes, and cells of each; the softmaxes are equally wide.
CLASSES = 24
ROUNDS, BATCH, RATE, SLICE = 2, 8192, 0.5, 1 << 17
#: Rows of the features: word before, word before that, and both; then both kinds with the class.
ROWS = (1 << 14, 1 << 14, 1 << 15)
CELL_ROWS = (1 << 15, 1 << 15)
BLOCK = 512
END = np.uint64(0x5851F42D4C957F2D)
#: Marks an unknown word in the byte that holds its class.
UNKNOWN = 128


@dataclass
class Classes:
    """Class of a word by its count, and the classes' masses."""

    total: int  # training tokens
    distinct: int
    lowest: np.ndarray  # smallest rounded count of each class, falling
    mass: np.ndarray  # sum of count + 1 of each class and cell, and 1 for the unknown word

    def of(self, counts: np.ndarray) -> np.ndarray:
        k = np.searchsorted(-self.lowest.astype(np.int64), -rounded(counts).astype(np.int64), "left")
        return np.minimum(k, len(self.lowest) - 1)


def rounded(counts: np.ndarray) -> np.ndarray:
    """Counts cut to ten significant bits."""
    counts = counts.astype(np.int64)
    shift = np.maximum(np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) - 9, 0)
    return (counts >> shift) << shift


def squeeze(values: np.ndarray) -> bytes:
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unsqueeze(blob: bytes) -> np.ndarray:
    body = np.frombuffer(blob, np.uint8, offset=1)
    out = np.zeros((len(body) // blob[0], 8), np.uint8)
    out[:, : blob[0]] = body.reshape(-1, blob[0])
    return out.view("<u8").ravel().astype(np.int64)


def _tokens(text: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the words and the end, the place among them of each token (a text's
    end is its last), and where each text starts."""
    coded, offsets = packed.words(text, lower=True)
    unique, place = np.unique(np.append(packed.hash_strings(coded.dictionary), END), return_inverse=True)
    return unique, np.insert(place[np.asarray(coded.indices)], offsets[1:], place[-1]), offsets + np.arange(len(offsets))


def _classes(hist: list, n_classes: int) -> Classes:
    """Classes of about equal mass, from (rounded count, words, tokens) of the training words."""
    keys = sorted(((r["key"], r["n"], r["mass"]) for r in hist), reverse=True)
    total, distinct = sum(k[2] for k in keys), sum(k[1] for k in keys)
    lowest, own = [], 0
    left, part = total + distinct + 1, n_classes
    for key, n, m in keys:
        own += m + n
        if own >= left / part and part > 1:
            lowest.append(key)
            left, part, own = left - own, part - 1, 0
    lowest.append(0)
    mass = np.zeros((len(lowest), CLASSES))
    mass[-1, 0] = 1
    return Classes(total, distinct, np.array(lowest, np.int64), mass)


def cell_of(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    return np.where(kinds >= UNKNOWN, 0, codes % CLASSES)


def _coded(docs: DataFrame, n_classes: int) -> tuple[DataFrame, Classes]:
    """One row a document: its counts, base score and codes; and the classes."""
    groups, n = packed.numbers(docs.sparkSession, packed.text_bytes(docs, F.col("text")))
    grouped = docs.withColumn("grp", F.pmod(F.xxhash64("id", "text"), F.lit(groups)).cast("int"))

    def emit(key: tuple, rows: pa.Table) -> pa.Table:
        unique, inverse, offsets = _tokens(rows.column("text"))
        learn = np.repeat(~np.asarray(rows.column("held_out")), np.diff(offsets))
        counts = np.bincount(inverse[learn], minlength=len(unique))
        at = packed.cuts(unique, n)
        sent = packed.shipped(key[0].as_py(), unique, n)
        return sent.set_column(3, "extra", pa.array([squeeze(counts[at[k] : at[k + 1]]) for k in range(n) if at[k] < at[k + 1]], pa.binary()))

    def resolve(key: tuple, rows: pa.Table) -> pa.Table:
        senders, starts, parts, order = packed.gathered(rows)
        extra = rows.column("extra").to_pylist()
        unique, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.zeros(len(unique), np.int64)
        np.add.at(counts, inverse, np.concatenate([unsqueeze(extra[k]) for k in order]))
        seen = counts[counts > 0]
        both = rounded(seen) * CLASSES + ((unique[counts > 0] >> np.uint64(48)) % np.uint64(CLASSES)).astype(np.int64)
        keys, which = np.unique(both, return_inverse=True)
        mass = np.zeros(len(keys), np.int64)
        np.add.at(mass, which, seen)
        hist = np.stack([keys // CLASSES, keys % CLASSES, np.bincount(which, minlength=len(keys)), mass]).astype("<i8").tobytes()
        back = counts[inverse]
        answers = [squeeze(back[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        return packed.answered(np.append(senders, -1), key[0].as_py(), [*answers, hist])

    def histogram(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for blob in batch.column("answer").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.frombuffer(blob, "<i8").reshape(4, -1)], ["key", "cell", "n", "mass"])

    answers = common.written(grouped.groupBy("grp").applyInArrow(emit, packed.SHIPPED).groupBy("bucket").applyInArrow(resolve, packed.ANSWER), "counts")
    hist = common.written(answers.where("grp = -1").select("answer").mapInArrow(histogram, "key bigint, cell bigint, n bigint, mass bigint"), "histogram")
    # Rounded counts are a few thousand at any input size, classes times cells a few hundred.
    classes = _classes(hist.groupBy("key").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass")).collect(), n_classes)
    lowest = F.array(*(F.lit(int(x)) for x in classes.lowest))
    kind = F.least(F.size(F.filter(lowest, lambda x: x > F.col("key"))), F.lit(len(classes.lowest) - 1))
    for r in hist.groupBy(kind.alias("kind"), "cell").agg(F.sum(F.col("n") + F.col("mass")).alias("mass")).collect():
        classes.mass[r["kind"], r["cell"]] += r["mass"]

    def finish(rows: pa.Table, found: pa.Table) -> pa.Table:
        unique, inverse, offsets = _tokens(rows.column("text"))
        counts, at = np.zeros(len(unique), np.int64), packed.cuts(unique, n)
        for bucket, answer in zip(found.column("bucket").to_pylist(), found.column("answer").to_pylist(), strict=True):
            counts[at[bucket] : at[bucket + 1]] = unsqueeze(answer)
        kind = classes.of(counts)
        base = np.log10((counts + 1) / (classes.total + classes.distinct + 1))
        short = (unique >> np.uint64(48)).astype("<u2")
        marked = (kind + np.where(counts > 0, 0, UNKNOWN)).astype(np.uint8)
        inner = np.log10((counts + 1) / classes.mass[kind, cell_of(short, marked)])
        sums = lambda x: np.add.reduceat(x[inverse], offsets[:-1]) if len(rows) else np.zeros(0)
        codes, kinds = short[inverse].tobytes(), marked[inverse].tobytes()
        return pa.table(
            {
                "id": rows.column("id"),
                "held_out": rows.column("held_out"),
                "n_tokens": pa.array(np.diff(offsets), pa.int64()),
                "n_known": pa.array(sums((counts > 0).astype(np.int64)), pa.int64()),
                "base_score": pa.array(sums(base), pa.float64()),
                "inner": pa.array(sums(inner), pa.float64()),
                "codes": pa.array([codes[2 * a : 2 * b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary()),
                "kinds": pa.array([kinds[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary()),
            }
        )

    id_type = docs.schema["id"].dataType.simpleString()
    coded = grouped.groupBy("grp").cogroup(answers.where("grp >= 0").groupBy("grp")).applyInArrow(
        finish, f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, inner double, codes binary, kinds binary"
    )
    return common.written(coded, "coded"), classes


def features(codes: np.ndarray, starts: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of each token for its class and for its cell, a line a feature.

    starts: whether a text begins at the token.
    """
    none = np.zeros(1, np.uint64)
    one = np.concatenate((none, codes[:-1].astype(np.uint64))) + np.uint64(1)
    one[starts] = 0
    two = np.concatenate((none, one[:-1]))
    two[starts] = 0  # a text's second token already sees 0 here
    pair = packed.mix(one * np.uint64(0x10001) + two)
    skip = packed.mix(two + np.uint64(77))
    own = (kinds & np.uint8(UNKNOWN - 1)).astype(np.uint64) << np.uint64(32)
    hashes = (packed.mix(one), skip, pair, packed.mix(one + own + np.uint64(1 << 40)), packed.mix((pair >> np.uint64(24)) + own))
    first, rows = 0, []
    for h, n in zip(hashes, (*ROWS, *CELL_ROWS), strict=True):
        rows.append((h & np.uint64(n - 1)).astype(np.int64) + first)  # n is a power of two
        first += n
    return np.stack(rows[:3]), np.stack(rows[3:])


def _sums(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the features' weights for each token and outcome, less each token's highest; bias is
    one line, or one a token."""
    z = weights.take(rows[0], 0)
    for r in rows[1:]:
        z += weights.take(r, 0)
    z += bias
    top = z[:, 0].copy()
    for k in range(1, z.shape[1]):  # by columns: lines are too short to go along
        np.maximum(top, z[:, k], out=top)
    z -= top[:, None]
    return z


def _logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    """Log probabilities of the outcomes for each token, or of its outcome y alone."""
    z = _sums(weights, bias, rows)
    total = np.log(np.einsum("ij->i", np.exp(z)))
    return z - total[:, None] if y is None else z[np.arange(len(y)), y] - total


def step(w: np.ndarray, scale: np.ndarray, used: np.ndarray, rows: np.ndarray, prior: np.ndarray, y: np.ndarray) -> None:
    """One gradient step for outcomes y: moves the weights of the rows by their adaptive rates, and
    counts how often each row was used. Gradients are summed by row with one count of all cells."""
    grad = _sums(w, prior, rows)
    np.exp(grad, out=grad)
    grad /= np.einsum("ij->i", grad)[:, None]
    grad[np.arange(len(y)), y] -= 1
    flat, width = grad.ravel().astype(np.float64), w.shape[1]
    for r in rows:
        first = int(r.min())
        n = np.bincount(r - first)
        own = np.flatnonzero(n)
        place = np.empty(len(n), np.int64)
        place[own] = np.arange(0, len(own) * width, width)
        g = np.bincount((place[r - first][:, None] + np.arange(width)).ravel(), flat, len(own) * width).reshape(-1, width).astype(np.float32)
        n, own = n[own], own + first
        scale[own] += np.einsum("ij,ij->i", g, g)
        used[own] += n
        g *= (RATE / np.sqrt(scale[own]))[:, None]
        w[own] = w.take(own, 0) - g


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """Of SLICE tokens at a time: which text, class, cell, and both kinds of feature rows."""
    ends = np.cumsum(np.asarray(batch.column("n_tokens")))
    codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), "<u2")
    kinds = np.frombuffer(b"".join(batch.column("kinds").to_pylist()), np.uint8)
    for k in range(0, len(codes), SLICE):
        a, b = max(k - 2, 0), min(k + SLICE, len(codes))  # features look two tokens back
        text = np.searchsorted(ends, np.arange(a, b), "right")
        begins = np.concatenate(([True], text[1:] != text[:-1]))
        first, second = features(codes[a:b], begins, kinds[a:b])
        own, named = slice(k - a, None), kinds[k:b]
        yield text[own], (named & np.uint8(UNKNOWN - 1)).astype(np.int64), cell_of(codes[k:b], named), first[:, own], second[:, own]


def _bias(classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Log shares of the classes, and of each class's cells; -inf for those that are empty."""
    mass, out = classes.mass.sum(1), np.full(CLASSES, -np.inf, np.float32)
    out[: len(mass)] = np.log(mass / mass.sum())
    with np.errstate(divide="ignore"):
        return out, np.log(classes.mass / mass[:, None]).astype(np.float32)


MOVED = "block int, part int, moved binary, used binary"
#: Shares of one block that one group averages.
WAY = 64


def averaged(moved: DataFrame, parts: int) -> DataFrame:
    """One row a block from the shares of `parts` tasks: means by how often each row was used.

    WAY shares are averaged at a time, in as many levels as that takes, so that no group
    grows with the number of tasks.
    """

    def average(key: tuple, rows: pa.Table) -> pa.Table:
        total, count = np.zeros((BLOCK, CLASSES), np.float64), np.zeros(BLOCK, np.float64)
        for m, n in zip(rows.column("moved").to_pylist(), rows.column("used").to_pylist(), strict=True):
            n = np.frombuffer(n, np.float32)
            total += np.frombuffer(m, np.float16 if len(m) == 2 * BLOCK * CLASSES else np.float32).reshape(BLOCK, CLASSES) * n[:, None]
            count += n
        mean = total / np.maximum(count, 1e-300)[:, None]
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "moved": [mean.astype(np.float32).tobytes()], "used": [count.astype(np.float32).tobytes()]})

    while True:
        parts = -(-parts // WAY)
        group = F.floor(F.col("part") / WAY).cast("int") if parts > 1 else F.lit(0)
        moved = moved.withColumn("part", group).groupBy("block", "part").applyInArrow(average, MOVED)
        if parts <= 1:
            return moved


def train(coded: DataFrame, classes: Classes, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the feature rows; each training document is in one round."""
    spark = coded.sparkSession
    weights, (bias, cells) = np.zeros((sum(ROWS) + sum(CELL_ROWS), CLASSES), np.float32), _bias(classes)
    if not classes.total:
        return weights
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(weights)

        def learn(batches):  # noqa: ANN001, ANN202
            from pyspark import TaskContext

            w, start = sent.value.copy(), sent.value  # noqa: B023
            scale, used = np.full(len(w), 1e-8, np.float32), np.zeros(len(w), np.float32)

            for batch in batches:
                for _, kind, cell, first, second in _slices(batch):
                    for k in range(0, len(kind), BATCH):
                        at = slice(k, k + BATCH)
                        step(w, scale, used, first[:, at], bias, kind[at])
                        step(w, scale, used, second[:, at], cells.take(kind[at], 0), cell[at])
            for k in range(0, len(w), BLOCK):
                n = used[k : k + BLOCK]
                if n.any():
                    moved = (w[k : k + BLOCK] - start[k : k + BLOCK]).astype(np.float16)
                    yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([moved.tobytes()]), pa.array([n.tobytes()])], ["block", "part", "moved", "used"])

        own = coded.where(~F.col("held_out")).where(F.pmod(F.xxhash64("id", "codes"), F.lit(rounds)) == turn).select("n_tokens", "codes", "kinds")
        moved = averaged(own.mapInArrow(learn, MOVED), own.rdd.getNumPartitions())
        weights = weights.copy()
        for row in moved.toLocalIterator():  # as many rows as the model has blocks
            k = row["block"] * BLOCK
            weights[k : k + BLOCK] += np.frombuffer(row["moved"], np.float32).reshape(BLOCK, CLASSES)
    return weights


def score(coded: DataFrame, classes: Classes, weights: np.ndarray) -> DataFrame:
    sent, (bias, cells) = coded.sparkSession.sparkContext.broadcast(weights), _bias(classes)
    kept = ["id", "held_out", "n_tokens", "n_known", "base_score"]

    def run(batches):  # noqa: ANN001, ANN202
        w = sent.value
        for batch in batches:
            log = np.zeros(len(batch))
            for text, kind, cell, first, second in _slices(batch):
                for k in range(0, len(kind), BATCH):
                    at = slice(k, k + BATCH)
                    own = _logits(w, bias, first[:, at], kind[at]) + _logits(w, cells.take(kind[at], 0), second[:, at], cell[at])
                    log += np.bincount(text[at], weights=own, minlength=len(batch))
            total = np.asarray(batch.column("inner")) + log / np.log(10)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(total)], [*kept, "score"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in coded.schema.fields if f.name in kept)
    return coded.select(*kept, "inner", "codes", "kinds").mapInArrow(run, f"{fields}, score double").withColumn("train_tokens", F.lit(classes.total).cast("bigint"))


def fit_and_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", classes: int = CLASSES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, base_score, score, train_tokens) of every document.

    Held out are documents with crc32(id as text) mod 7 = 2; the model learns from the others.
    """
    key = F.col(common.quoted(doc_id))
    held = F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0)) % 7 == 2
    coded, kinds = _coded(docs.select(key.alias("id"), F.col(common.quoted(text)).alias("text"), held.alias("held_out")), classes)
    return score(coded, kinds, train(coded, kinds))
