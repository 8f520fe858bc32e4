"""SentencePiece encoding and decoding by suffix arrays.

A batch's texts are cut where no piece can reach across (before a run of blanks, and
around characters that are in no piece); equal parts are encoded once. The distinct parts
are concatenated and indexed by a suffix array, as deep as the longest piece. Every piece
is looked up by binary search; its range of suffixes gives its occurrences. The resulting
edges are put in order of position and length, and relaxed: for BPE models the adjacent
pair of the best rank merges first, the leftmost of equals, which is what the model
defines; for unigram models the best sum of scores wins. Parts relax in lockstep; a part
of more than LONG symbols takes its merges from a heap instead, so n symbols without a
blank cost n log n steps. Such a part of n bytes takes about 130 n bytes of memory.

The model file is read on the driver by its path; tasks get its pieces (bounded by the
vocabulary). Text is taken as it is (identity normalisation): a blank stands for U+2581
and the text gets one blank in front if the model says so.

Defined cases: null text gives null ids, empty text none; characters in no piece become
byte pieces, or the unknown piece if the model has no bytes. Decoding gives back the text,
but U+2581 becomes a blank and, without byte pieces, unknown characters become U+2047 in
blanks; invalid bytes become U+FFFD; null ids give null; ids outside the vocabulary fail.
Extra columns pass through; added columns replace those of the same name.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, packed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of distinct parts in one suffix array.
CHUNK = 1 << 19
#: Symbols of a part that is merged by a heap.
LONG = 256
NO_RANK = np.iinfo(np.int32).max


@dataclass
class Vocabulary:
    pieces: list[bytes]  # with blanks for U+2581; empty for those that text never matches
    scores: np.ndarray
    out: list[bytes]  # what each id decodes to
    bytes_at: np.ndarray  # id of each byte's piece, or -1
    unknown: int
    prefix: bool = True
    merges: bool = True
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.pieces))
        self.ranks = np.unique(-self.scores, return_inverse=True)[1].astype(np.int32)
        inner = any(b" " in p.lstrip(b" ") for p in self.pieces)
        used = set(b"".join(self.pieces))
        self.lone = np.array([k for k in range(128) if k not in used and k != 32], np.uint8) if not inner else None


def load(path: str = MODEL, merges: bool = True, prefix: bool = True) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(size)]
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(size)]
    plain = [n.replace("▁", " ").encode() for n in names]
    at = np.full(256, -1, np.int32)
    out = list(plain)
    for i in range(size):
        if sp.is_byte(i):
            at[int(names[i][3:-1], 16)] = i
            out[i] = bytes([int(names[i][3:-1], 16)])
        elif sp.is_control(i):
            out[i] = b""
        elif sp.is_unknown(i):
            out[i] = " ⁇ ".encode()
    return Vocabulary([b"" if s else p for s, p in zip(special, plain, strict=True)], np.array([sp.get_score(i) for i in range(size)]), out, at, sp.unk_id(), prefix, merges)


def _edges(data: np.ndarray, v: Vocabulary) -> np.ndarray:
    """table[position, length - 1]: the piece that lies there, or -1."""
    deep = v.longest
    padded = np.concatenate((data, np.zeros(deep, np.uint8)))
    suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, deep)[: len(data)]).view(f"S{deep}").ravel()
    order = np.argsort(suffixes, kind="stable")
    ranked = suffixes[order]
    ids = np.array([i for i, p in enumerate(v.pieces) if p])
    keys = np.array([v.pieces[i] for i in ids], f"S{deep}")
    lengths = np.array([len(v.pieces[i]) for i in ids])
    after = np.array([v.pieces[i] + b"\xff" * (deep - len(v.pieces[i])) for i in ids], f"S{deep}")
    low, high = np.searchsorted(ranked, keys, "left"), np.searchsorted(ranked, after, "right")
    count = high - low
    rows = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    table = np.full((len(data), deep), -1, np.int32)
    table[order[rows], np.repeat(lengths - 1, count)] = np.repeat(ids, count)
    return table


def _heaped(start: np.ndarray, end: np.ndarray, table: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (start, end) of one part after all merges, best rank and leftmost first."""
    n, base, deep = len(start), int(start[0]), v.longest
    cells = memoryview(np.ascontiguousarray(table[base : int(end[-1])])).cast("B").cast("i")
    ranks, none = v.ranks.tolist(), int(NO_RANK)
    at, to = (start - base).tolist(), (end - base).tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # n: no symbol after

    def rank(k: int) -> int:
        j = after[k]
        if j == n or to[j] - at[k] > deep:
            return none
        piece = cells[at[k] * deep + to[j] - at[k] - 1]
        return ranks[piece] if piece >= 0 else none

    best = [rank(k) for k in range(n)]
    heap = [(r << 32) | k for k, r in enumerate(best) if r != none]
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        k = top & 0xFFFFFFFF
        if best[k] != top >> 32:
            continue  # one of the two has been merged since
        j = after[k]
        to[k], best[j], after[k] = to[j], -1, after[j]
        if after[k] < n:
            before[after[k]] = k
        for i in (before[k], k):
            if i >= 0:
                r = best[i] = rank(i)
                if r != none:
                    heapq.heappush(heap, (r << 32) | i)
    kept = [k for k in range(n) if best[k] != -1]
    return np.array([at[k] for k in kept], np.int64) + base, np.array([to[k] for k in kept], np.int64) + base


def _merged(data: np.ndarray, first: np.ndarray, table: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (start, end, part) after all merges; first: where each part starts."""
    start = np.flatnonzero(((data & 0xC0) != 0x80) & (data != 0) | (data == 0) & ~_separators(len(data), first))
    part = (np.searchsorted(first, start, "right") - 1).astype(np.int32)
    last = np.concatenate((first[1:], [len(data)])) - 1  # each part's end, before its separator
    end = np.minimum(np.concatenate((start[1:], [len(data)])), last[part])
    done: list[tuple[np.ndarray, ...]] = []

    def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        length = b - a
        found = np.where(length <= v.longest, table[a, np.minimum(length, v.longest) - 1], -1)
        return np.where(found >= 0, v.ranks[found], NO_RANK)

    symbols = np.bincount(part, minlength=len(first))
    for k in np.flatnonzero(symbols > LONG):
        a, b = np.searchsorted(part, [k, k + 1])
        own = _heaped(start[a:b], end[a:b], table, v)
        done.append((*own, np.full(len(own[0]), k, np.int32)))
    short = symbols[part] <= LONG
    start, end, part = start[short], end[short], part[short]
    same = part[1:] == part[:-1]
    score = np.full(len(start), NO_RANK, np.int32)
    score[:-1][same] = rank(start[:-1][same], end[1:][same])
    while len(start):
        heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        sizes = np.diff(np.concatenate((heads, [len(part)])))
        best = np.minimum.reduceat(score, heads)
        live = np.repeat(best < NO_RANK, sizes)
        if not live.all():
            done.append((start[~live], end[~live], part[~live]))
            start, end, part, score = start[live], end[live], part[live], score[live]
            if not len(start):
                break
            best, sizes = best[best < NO_RANK], sizes[best < NO_RANK]
        hits = np.flatnonzero(score == np.repeat(best, sizes))
        hits = hits[np.concatenate(([True], part[hits][1:] != part[hits][:-1]))]
        end[hits] = end[hits + 1]
        stay = np.ones(len(start), bool)
        stay[hits + 1] = False
        place = (np.cumsum(stay) - 1)[hits]
        start, end, part, score = start[stay], end[stay], part[stay], score[stay]
        for k in (place, place - 1):
            k = k[(k >= 0) & (k + 1 < len(start))]
            k = k[part[k] == part[k + 1]]
            score[k] = rank(start[k], end[k + 1])
        alone = place[(place + 1 >= len(start)) | (part[np.minimum(place + 1, len(start) - 1)] != part[place])]
        score[alone] = NO_RANK
    if not done:
        return start, end, part
    columns = [np.concatenate(x) for x in zip(*done, strict=True)]
    order = np.argsort(columns[0], kind="stable")
    return tuple(c[order] for c in columns)


def _best_path(data: np.ndarray, first: np.ndarray, table: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _merged, for the split with the greatest sum of scores (unknown characters cost most)."""
    last = np.concatenate((first[1:], [len(data)])) - 1
    head = ((data & 0xC0) != 0x80)
    width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
    total = np.full(len(data) + 1, -np.inf)
    back = np.zeros(len(data) + 1, np.int64)
    total[first] = 0
    unknown = v.scores.min() - 10
    for step in range(int((last - first).max(initial=0))):
        at = first[first + step < last] + step
        at = at[head[at] & np.isfinite(total[at])]
        for length in range(1, v.longest + 1):
            known = table[at, length - 1]
            fits = (known >= 0) | (width[at] == length)
            a, known = at[fits], known[fits]
            gain = total[a] + np.where(known >= 0, v.scores[known], unknown)
            better = gain > total[a + length]
            total[a[better] + length], back[a[better] + length] = gain[better], a[better]
    found, at, part = [], last.copy(), np.arange(len(first), dtype=np.int32)
    while len(at):
        live = at > first[part]
        at, part = at[live], part[live]
        found.append((back[at], at, part))
        at = back[at]
    columns = [np.concatenate(x) for x in zip(*found, strict=True)]
    order = np.argsort(columns[0], kind="stable")
    return tuple(c[order] for c in columns)


def _separators(n: int, first: np.ndarray) -> np.ndarray:
    mask = np.zeros(n, bool)
    mask[first[1:] - 1] = True
    if n:
        mask[-1] = True
    return mask


def _parts(strings: pa.LargeBinaryArray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct parts, one after the other, and where each part's ids start."""
    _, offsets, raw = strings.buffers()
    cuts = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    flat, sizes, k = [], [], 0
    while k < len(strings):
        j = min(len(strings), max(k + 1, int(np.searchsorted(cuts, cuts[k] + CHUNK, "right")) - 1))
        lengths = np.diff(cuts[k : j + 1])
        first = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        data = np.zeros(int((lengths + 1).sum()), np.uint8)
        own = np.ones(len(data), bool)
        own[first + lengths] = False
        data[own] = raw[cuts[k] : cuts[j]]
        table = _edges(data, v)
        start, end, part = (_merged if v.merges else _best_path)(data, first, table, v)
        length = end - start
        known = table[start, np.minimum(length, v.longest) - 1]
        bare = known < 0
        fall = bare & (v.bytes_at[data[start]] >= 0)
        width = np.where(fall, length, 1)
        ids = np.repeat(np.where(bare, v.unknown, known), width).astype(np.int32)
        spot = np.repeat(start - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(len(ids))
        as_byte = np.repeat(fall, width)
        ids[as_byte] = v.bytes_at[data[spot[as_byte]]]
        flat.append(ids)
        sizes.append(np.bincount(part, weights=width, minlength=j - k).astype(np.int64))
        k = j
    return np.concatenate(flat) if flat else np.zeros(0, np.int32), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))) if sizes else np.zeros(1, np.int64)


def _laid_out(values: np.ndarray, first: np.ndarray, which: np.ndarray) -> np.ndarray:
    """values of the runs `which`, one run after the other."""
    count = first[which + 1] - first[which]
    return values[np.repeat(first[which] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())] if len(which) else values[:0]


def encode_batch(text: pa.Array, v: Vocabulary) -> pa.ListArray:
    none = text.is_null()
    plain = pc.replace_substring(pc.fill_null(text.cast(pa.large_string()), ""), "▁", " ")
    if v.prefix:
        plain = pc.if_else(pc.equal(pc.binary_length(plain), 0), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), plain, pa.scalar("", pa.large_string())))
    plain = plain.cast(pa.large_binary())
    _, offsets, raw = plain.buffers()
    docs = np.frombuffer(offsets, np.int64)[plain.offset : plain.offset + len(plain) + 1]
    raw = np.frombuffer(raw, np.uint8)[: docs[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    begins = np.zeros(len(raw) + 1, bool)
    if v.lone is not None and len(raw):
        blank = raw == 32
        begins[1:-1] = blank[1:] & ~blank[:-1]
        lone = np.isin(raw, v.lone)
        begins[:-1] |= lone
        begins[1:] |= lone
    begins[docs] = True
    cuts = np.flatnonzero(begins) if len(raw) else np.zeros(1, np.int64)
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw)])
    coded = parts.dictionary_encode()
    ids, first = _parts(coded.dictionary.cast(pa.large_binary()), v)
    which = np.asarray(coded.indices)
    totals = np.concatenate(([0], np.cumsum(np.diff(first)[which])))
    flat = [_laid_out(ids, first, which[k : k + CHUNK]) for k in range(0, len(which), CHUNK)]
    ends = totals[np.searchsorted(cuts, docs)].astype(np.int32)
    mask = None if none.null_count == 0 and not pc.any(none).as_py() else none
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32()), mask=mask)


def decode_batch(ids: pa.ListArray, v: Vocabulary) -> pa.Array:
    sizes = np.array([len(x) for x in v.out])
    first = np.concatenate(([0], np.cumsum(sizes)))
    table = np.frombuffer(b"".join(v.out), np.uint8)
    out: list[str | None] = []
    for k in range(0, len(ids), 256):
        part = ids.slice(k, 256)
        flat = np.asarray(part.flatten()).astype(np.int64)
        if len(flat) and (flat.min() < 0 or flat.max() >= len(sizes)):
            raise ValueError("an id isn't in the vocabulary")
        raw = _laid_out(table, first, flat).tobytes()
        lengths = np.concatenate(([0], np.cumsum(sizes[flat])))
        at = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
        for a, b, some in zip(lengths[at[:-1]], lengths[at[1:]], part.is_valid().to_pylist(), strict=True):
            bare = raw[a:b]
            bare = bare[1:] if v.prefix and bare[:1] == b" " else bare
            out.append(bare.decode("utf-8", "replace") if some else None)
    return pa.array(out, pa.string())


def _put(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    keep = [c for c in batch.schema.names if c not in added]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *added.values()], [*keep, *added])


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", verify: bool = False) -> DataFrame:
    """docs with the ids of each text; with verify, also round_trip: whether they decode to it."""
    added = [ids, *(["round_trip"] if verify else [])]
    low = {c.lower() for c in added}
    docs = docs.select(*(common.quoted(c) for c in docs.columns if c.lower() not in low))
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField("round_trip", T.BooleanType())] if verify else [])])

    def run(batches):  # noqa: ANN001, ANN202
        for whole in batches:
            for batch in packed.sliced(whole, text, 1 << 25):
                column = batch.column(text)
                found = {ids: encode_batch(column, vocabulary)}
                if verify:
                    want = pc.replace_substring(column, "▁", " ")
                    found["round_trip"] = pc.fill_null(pc.equal(decode_batch(found[ids], vocabulary), want), True)
                yield _put(batch, found)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with the text that each row's ids stand for."""
    rows = rows.select(*(common.quoted(c) for c in rows.columns if c.lower() != text.lower()))
    schema = T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())])

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            yield _put(batch, {text: decode_batch(batch.column(ids).cast(pa.list_(pa.int32())), vocabulary)})

    return rows.mapInArrow(run, schema)
