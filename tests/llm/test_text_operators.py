"""Text operators against brute force, on small documents with every awkward case."""

import itertools
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

SPACE = re.compile("[^\x20\x09-\x0d]+")
FOLD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id bigint, text string, n_words string, Key string, __key int"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def passage(k, n=30):
    return " ".join(f"w{(k * 7919 + i * 31) % 997}" for i in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [passage(k, 60) for k in range(6)]
    texts = [
        None, "", "   \n\t ", "one", "one two THREE", base[0], base[0], base[0] + " tail", base[1] + " " + base[2],
        "start " + base[2] + " end", base[3].upper(), base[3], passage(9, 25) + "\n" + passage(9, 25), "É à ß " + base[4], base[4] + "  x",
        " ".join(["same"] * 200), base[5].replace("w1", "W1"), base[5], passage(40, 400), "x" * 5000,
    ]
    out = [(k, t, "x", "k", k) for k, t in enumerate(texts)]
    return [*out, out[5], out[8], (None, base[1], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_substrings(spark, docs, rows):
    from panelyard.llm import substrings

    got = substrings.dedup(docs.where("doc_id is not null"))
    assert got.columns[:2] == ["doc_id", "text"] and "Key" in got.columns
    seen, want = set(), Counter()
    some = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    for r in some:
        w = SPACE.findall(r[1] or "")
        gone = set()
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                gone.update(range(i, i + 20))
            seen.add(k)
        want[(r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    have = Counter((r["doc_id"], r["n_words"], r["n_removed"], " ".join(SPACE.findall(r["text"] or ""))) for r in got.collect())
    assert have == want
    whole = {r["doc_id"]: r["text"] for r in got.collect() if r["n_removed"] == 0}
    assert all(whole[r[0]] == r[1] for r in some if r[0] in whole)


def test_substrings_with_null_ids_and_empty(spark, docs):
    from panelyard.llm import substrings

    got = substrings.dedup(docs).where("doc_id is null").orderBy("n_words").collect()
    assert [(r["n_words"], r["n_removed"]) for r in got] == [(0, 0), (60, 60)]  # nulls come last
    assert substrings.dedup(docs.limit(0)).count() == 0


def test_substring_groups_hold_like_bytes(spark):
    """Long texts with neighbouring ids, one id on many rows, and null ids are spread over groups."""
    from panelyard.llm import substrings

    n = 20
    long = [(100 + k, passage(k, 2000)) for k in range(300)]
    rows = [*long, *((1000 + k, "a b") for k in range(3000)), *((5000, passage(k, 300)) for k in range(400)), *((None, passage(k, 200)) for k in range(300))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = substrings.ranged(docs, "doc_id", "text", n, 20, ("grp", "order", "tie"))
    sizes = [r["size"] for r in got.groupBy("grp").agg(F.sum(F.octet_length("text")).alias("size")).collect()]
    share = sum(sizes) / n
    assert max(sizes) < 2 * share + max(len(t) for _, t in rows)
    marked = got.where("length(text) > 40").select("doc_id", "grp").collect()
    order = sorted(marked, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    low = {}
    for r in order:  # ranges of ids follow each other
        low.setdefault(r["grp"], (r["doc_id"] is None, r["doc_id"] or 0))
    for r in order:
        later = [k for g, k in low.items() if g > r["grp"]]
        assert all((r["doc_id"] is None, r["doc_id"] or 0) <= k for k in later)


def test_shares_average_in_levels(spark):
    import numpy as np

    from panelyard.llm import maxent

    share = lambda x, n: (np.full((maxent.BLOCK, maxent.CLASSES), x, np.float16).tobytes(), np.full(maxent.BLOCK, n, np.float32).tobytes())
    two = spark.createDataFrame([(k, *share(x, n)) for k, (x, n) in enumerate(((1.0, 1), (4.0, 2)))], "k long, moved binary, used binary")
    tasks = spark.range(0, 5000, numPartitions=8).select(F.lit(3).alias("block"), F.col("id").cast("int").alias("part"), (F.col("id") % 2).alias("k"))
    got = maxent.averaged(tasks.join(F.broadcast(two), "k").select("block", "part", "moved", "used"), 5000).collect()
    assert len(got) == 1 and got[0]["block"] == 3
    assert np.allclose(np.frombuffer(got[0]["moved"], np.float32), 3.0) and np.allclose(np.frombuffer(got[0]["used"], np.float32), 7500)
    assert maxent.averaged(tasks.limit(0).join(two, "k").select("block", "part", "moved", "used"), 1).count() == 0


def test_cut():
    from panelyard.llm.substrings import cut

    assert cut("  a b\nc  d ", [(1, 3)]) == "  a d "
    assert cut("a b c", [(2, 3)]) == "a b" and cut("a b c", [(0, 3)]) == "" and cut("a b c d", [(0, 1), (2, 4)]) == "b"


def _sets(rows, size):
    out = []
    for r in rows:
        w = SPACE.findall(lower(r[1]))
        out.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    return out


@pytest.mark.parametrize(("size", "num"), [(4, 85), (5, 80)])
def test_jaccard(spark, docs, rows, size, num):
    from panelyard.llm import jaccard

    some = [r for r in rows if r[0] is not None]
    near = [(100 + k, " ".join([*passage(70, 100).split()[: 100 - k], *(f"z{k}{i}" for i in range(k))]), "", "", 0) for k in range(0, 24)]
    some = some + near
    sets = _sets(some, size)
    comp = list(range(len(some)))

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for a, b in itertools.combinations(range(len(some)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= num * len(x | y):
            comp[root(a)] = root(b)
    least = {}
    for k, r in enumerate(some):
        least[root(k)] = min(least.get(root(k), 10**9), r[0])
    want = Counter((r[0], len(sets[k]), least[root(k)]) for k, r in enumerate(some))
    got = jaccard.join(spark.createDataFrame(some, SCHEMA), size=size, num=num).collect()
    assert Counter((r["id"], r["n_shingles"], r["component_id"]) for r in got) == want


def test_sparse_product_counts_overlaps():
    import numpy as np
    import pyarrow as pa

    from panelyard.llm import jaccard, packed

    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**64, 60, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, n, replace=False)) for n in (0, 1, 5, 30, 60, 60, 17)]
    blobs = [packed.pack(s) for s in sets]
    pairs = [(a, b) for a in range(7) for b in range(7)]
    got = jaccard.overlaps(pa.array([blobs[a] for a, _ in pairs], pa.binary()), pa.array([blobs[b] for _, b in pairs], pa.binary()))
    assert got.tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in pairs]
    assert len(jaccard.overlaps(pa.array([], pa.binary()), pa.array([], pa.binary()))) == 0
    counts = np.arange(1, 10**6, 7)
    assert (np.diff(jaccard.coarse(counts).astype(int)) >= 0).all() and (jaccard.coarse(np.arange(33)) == np.arange(33)).all()
    assert np.abs(jaccard.COUNTS[jaccard.coarse(counts)] / counts - 1).max() < 0.15 and jaccard.coarse(np.array([2**40]))[0] <= 255


def test_jaccard_parts_change_nothing(spark, monkeypatch):
    from panelyard.llm import jaccard

    # Short texts of one template: many share a rare n-gram and most aren't linked.
    rows = [(k, " ".join([*passage(3, 12).split(), f"a{k % 9}", f"b{k % 4}", *(["c"] * (k % 3))])) for k in range(120)]
    sets = _sets(rows, 4)
    comp = {k: k for k in range(120)}
    for a, b in itertools.combinations(range(120), 2):
        if comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            lo, hi = sorted((comp[a], comp[b]))
            comp = {k: lo if v == hi else v for k, v in comp.items()}
    for name, size in (("PART", 2), ("ROWS", 5), ("SLICE", 300), ("SALTS", 3)):
        monkeypatch.setattr(jaccard, name, size)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string"), size=4, num=85)
    assert Counter(tuple(r) for r in got.select("id", "n_shingles", "component_id").collect()) == Counter((k, len(sets[k]), comp[k]) for k in range(120))


def test_jaccard_representatives(spark, docs):
    from panelyard.llm import jaccard

    got = jaccard.representatives(docs)
    assert got.columns == docs.columns
    ids = Counter(r["doc_id"] for r in got.collect())
    assert ids[5] == 1 and ids[6] == 0 and ids[7] == 0 and ids[10] + ids[11] == 1
    assert jaccard.representatives(docs.limit(0)).count() == 0


def test_decontamination(spark, docs, rows):
    from panelyard.llm import decontam

    items = [(1, passage(1, 30)), (2, passage(2, 12).upper()), (3, "One, two"), (4, None), (5, "..."), (10, passage(9, 10)), (1, passage(3, 11)), (11, "same " * 12), (12, "one"), (None, passage(5, 14))]
    windows = {}
    for i, t in items:
        w = FOLD.findall(lower(t))
        for x in [tuple(w[k : k + 10]) for k in range(len(w) - 9)] if len(w) >= 10 else [tuple(w)] if w else []:
            windows.setdefault(x, set()).update([] if i is None else [str(i)])
    want = Counter()
    for r in rows:
        w = FOLD.findall(lower(r[1]))
        hit, named = set(), set()
        for x, ids in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    named |= ids
        want[(r[0], len(w), len(hit), len(named), ",".join(sorted(named)), bool(hit))] += 1
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for limit in (decontam.BROADCAST_BYTES, 0):  # by broadcast, and by shuffled hashes
        before, decontam.BROADCAST_BYTES = decontam.BROADCAST_BYTES, limit
        try:
            got = decontam.scan(docs, bench).collect()
        finally:
            decontam.BROADCAST_BYTES = before
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["item_ids"]), r["contaminated"]) for r in got) == want
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(k[0] for k, n in want.items() for _ in range(n) if not k[5])
    assert decontam.scan(docs, bench.limit(0)).where("contaminated").count() == 0


def test_quality(spark, docs, rows):
    from panelyard.llm import quality

    want = Counter()
    for r in rows:
        t = r[1] or ""
        w = SPACE.findall(t)
        win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = Counter(win)
        rep = {i + j for i, x in enumerate(win) if n[x] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        want[(r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))] += 1
    got = quality.judge(quality.ledger(docs)).cache()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got.collect()) == want
    found = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality.ablations(got, "base").collect()}
    bits = [r["failures"] & 3 for r in got.collect()]
    assert found == {"short": (sum(b & 1 for b in bits), bits.count(1)), "repeated_words": (sum(b >> 1 for b in bits), bits.count(2))}
    for policy in ("v1", "strict"):
        mask = quality.mask(policy)
        rows = [r["failures"] & mask for r in got.collect()]
        said = {r["rule"]: (r["bit"], r["n_failed"], r["n_only"]) for r in quality.ablations(got, policy).collect()}
        assert said == {n: (quality.BIT[n], sum(b & quality.BIT[n] > 0 for b in rows), rows.count(quality.BIT[n])) for n in quality.POLICIES[policy]}
    assert quality.keep(docs).columns == docs.columns and quality.keep(docs.limit(0)).count() == 0


def test_pieces_equal_the_library(spark, docs, rows):
    sentencepiece = pytest.importorskip("sentencepiece")
    from panelyard.llm import pieces

    vocabulary = pieces.load()
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    more = [(50, "日本語 テスト\n\n\tq   ", "", "", 0), (51, "\x00a\x00 \U0001f600", "", "", 0), (52, "▁a  b", "", "", 0), (53, "a<s>b <0x41>", "", "", 0)]
    df = spark.createDataFrame([*rows, *more], SCHEMA)
    out = pieces.encode(df, vocabulary, verify=True)
    for r in out.collect():
        assert r["ids"] == (None if r["text"] is None else sp.encode(r["text"]))
        assert r["round_trip"]
    back = pieces.decode(out.withColumnRenamed("text", "was"), vocabulary)
    assert all(r["text"] == (r["was"] and r["was"].replace("▁", " ")) for r in back.collect())
    assert pieces.encode(docs.limit(0), vocabulary).count() == 0


def test_long_parts_without_blanks_equal_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    import random

    import pyarrow as pa

    from panelyard.llm import pieces

    v, sp, rng = pieces.load(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), random.Random(0)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))
    texts = [letters, "x" * 50_000, "the" * 5000 + " a " + "日本" * 3000, "\U0001f600" * 700, letters[:257], letters[:256], "short " * 9 + letters[:300]]
    assert pieces.encode_batch(pa.array(texts), v).to_pylist() == [sp.encode(t) for t in texts]


def test_unigram_path_is_the_best_sum():
    import numpy as np
    import pyarrow as pa

    from panelyard.llm.pieces import Vocabulary, decode_batch, encode_batch

    names = [" ", "a", "b", "ab", " a", "bb", "abb"]
    scores = [-2.0, -1.5, -1.5, -2.5, -2.0, -2.0, -4.5]
    v = Vocabulary([n.encode() for n in names] + [b""], np.array([*scores, 0.0]), [n.encode() for n in names] + [b"?"], np.full(256, -1, np.int32), 7, True, False)

    def best(t):
        table = {0: (0.0, [])}
        for i in range(len(t)):
            for k, n in enumerate(names):
                if i in table and t.startswith(n, i):
                    s = table[i][0] + scores[k]
                    if s > table.get(i + len(n), (-1e9,))[0]:
                        table[i + len(n)] = (s, table[i][1] + [k])
        return table[len(t)][0]

    for t in ("ab", "abb", "abbab ab", "bbb abba"):
        got = encode_batch(pa.array([t]), v)
        assert abs(sum(scores[k] for k in got.to_pylist()[0]) - best(" " + t)) < 1e-9
        assert decode_batch(got, v).to_pylist() == [t]


def test_model_scores(spark, docs, rows):
    from panelyard.llm import maxent

    more = [(1000 + k, passage(k % 5, 40) + f" q{k}", "", "", 0) for k in range(120)]
    every = [*rows, *more]
    got = maxent.fit_and_score(spark.createDataFrame(every, SCHEMA)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter()
    for r in every:
        if not held(r[0]):
            counts.update([*SPACE.findall(lower(r[1])), None])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in every:
        w = [*SPACE.findall(lower(r[1])), None]
        want[(r[0], held(r[0]), len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6))] += 1
    assert Counter((r["id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}
    out = [r for r in got if r["held_out"] and r["id"] >= 1000]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_model_is_a_distribution():
    import numpy as np

    from panelyard.llm import maxent

    counts = np.array([500, 300, 40, 40, 7, 3, 2, 2, 1, 1, 1, 1, 0])
    known = counts[:-1]
    hist = [{"key": int(k), "n": int((known == k).sum()), "mass": int(k * (known == k).sum())} for k in np.unique(known)]
    classes = maxent._classes(hist, 4)
    kinds = classes.of(counts).astype(np.uint8)
    codes = np.random.default_rng(3).integers(0, 65536, len(counts)).astype(np.uint16)
    marked = kinds + np.where(counts > 0, 0, maxent.UNKNOWN).astype(np.uint8)
    cells = maxent.cell_of(codes, marked)
    for k, c, n in zip(kinds[:-1], cells[:-1], known, strict=True):
        classes.mass[k, c] += n + 1
    assert abs(classes.mass.sum() - (known.sum() + len(known) + 1)) < 1e-9
    rng = np.random.default_rng(0)
    w = rng.normal(size=(sum(maxent.ROWS) + sum(maxent.CELL_ROWS), maxent.CLASSES)).astype(np.float32)
    bias, inner = maxent._bias(classes)
    for seed in range(5):  # one context, every word after it
        context = np.random.default_rng(seed).integers(0, 65536, 2)
        total = 0.0
        for word in range(len(counts)):
            line, start = np.array([*context, codes[word]], np.uint16), np.array([True, False, False])
            first, second = maxent.features(line, start, np.array([0, 0, marked[word]], np.uint8))
            k, c = kinds[word], cells[word]
            log = maxent._logits(w, bias, first[:, 2:])[0, k] + maxent._logits(w, inner[[k]], second[:, 2:])[0, c]
            total += np.exp(log) * (counts[word] + 1) / classes.mass[k, c]
        assert abs(total - 1) < 1e-4


def test_model_steps_equal_their_formula():
    """A step and its logarithms, against sums written out token by token; rows and outcomes repeat."""
    import numpy as np

    from panelyard.llm import maxent

    rng, n = np.random.default_rng(8), 700
    w = rng.normal(size=(sum(maxent.ROWS) + sum(maxent.CELL_ROWS), maxent.CLASSES)).astype(np.float32)
    w[5, 3] = 200.0  # beyond what exp can hold
    scale, used = np.full(len(w), 0.5, np.float32), np.zeros(len(w), np.float32)
    starts = np.cumsum((0, *maxent.ROWS[:-1]))
    rows = np.stack([a + rng.choice([5, 6, 900, size - 1, *rng.integers(0, size, 300)], n) for a, size in zip(starts, maxent.ROWS, strict=True)])
    rows[:, 0] = starts + 5
    y = rng.integers(0, maxent.CLASSES - 1, n)
    prior = np.append(rng.normal(size=maxent.CLASSES - 1), -np.inf).astype(np.float32)  # the last outcome is empty
    for bias in (prior, np.tile(prior, (n, 1)) + rng.normal(size=(n, 1)).astype(np.float32)):
        want, squares, times = w.astype(float), scale.astype(float), used.astype(float)
        logs = np.zeros(n)
        for r_of in rows:
            sums, count = {}, Counter(r_of.tolist())
            for t in range(n):
                z = w[rows[:, t]].astype(float).sum(0) + (bias if bias.ndim == 1 else bias[t])
                p = np.exp(z - z.max())
                p /= p.sum()
                logs[t] = z[y[t]] - z.max() - np.log(np.exp(z - z.max()).sum())
                p[y[t]] -= 1
                sums[r_of[t]] = sums.get(r_of[t], 0) + p
            for r, g in sums.items():
                squares[r] += (g * g).sum()
                times[r] += count[r]
                want[r] -= maxent.RATE * g / math.sqrt(squares[r])
        assert np.allclose(maxent._logits(w, bias, rows, y), logs, rtol=1e-4, atol=1e-4)
        assert np.allclose(maxent._logits(w, bias, rows)[np.arange(n), y], logs, rtol=1e-4, atol=1e-4)
        maxent.step(w, scale, used, rows, bias, y)
        assert np.allclose(w, want, rtol=1e-4, atol=1e-4) and np.allclose(scale, squares, rtol=1e-3) and (used == times).all()


def test_model_tokens_are_words_and_ends():
    import numpy as np
    import pyarrow as pa

    from panelyard.llm import maxent, packed

    texts = ["a B  b\tA", "", None, "c a", " ", "b b b"]
    unique, place, offsets = maxent._tokens(pa.chunked_array([texts[:3], texts[3:]], pa.string()))
    words = [[*SPACE.findall(lower(x or "")), None] for x in texts]
    hashes = [maxent.END if x is None else packed.hash_strings(pa.array([x]))[0] for line in words for x in line]
    assert (unique[place] == np.array(hashes, np.uint64)).all() and (np.diff(unique) > 0).all()
    assert offsets.tolist() == np.cumsum([0, *map(len, words)]).tolist()
    unique, place, offsets = maxent._tokens(pa.chunked_array([], pa.string()))
    assert unique.tolist() == [int(maxent.END)] and len(place) == 0 and offsets.tolist() == [0]


def test_model_slices_change_nothing(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from panelyard.llm import maxent

    rng = np.random.default_rng(5)
    sizes = [1, 7, 1, 2, 40, 3]
    codes = [rng.integers(0, 65536, n).astype("<u2").tobytes() for n in sizes]
    kinds = [rng.integers(0, maxent.CLASSES, n).astype(np.uint8).tobytes() for n in sizes]
    batch = pa.RecordBatch.from_pydict({"n_tokens": sizes, "codes": codes, "kinds": kinds})
    whole = [np.concatenate(x, -1) for x in zip(*maxent._slices(batch), strict=True)]
    for size in (1, 2, 3, 10):
        monkeypatch.setattr(maxent, "SLICE", size)
        parts = [np.concatenate(x, -1) for x in zip(*maxent._slices(batch), strict=True)]
        assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_model_without_training(spark):
    from panelyard.llm import maxent

    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    r = maxent.fit_and_score(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0.0, 0.0)


def test_model_of_an_empty_table(spark):
    from panelyard.llm import maxent

    out = maxent.fit_and_score(spark.createDataFrame([], "doc_id bigint, text string"))
    assert out.count() == 0 and out.columns == ["id", "held_out", "n_tokens", "n_known", "base_score", "score", "train_tokens"]


def test_very_long_texts(spark):
    from panelyard.llm import decontam, jaccard, maxent, quality, substrings

    n = 60_000
    words = [f"w{k}" for k in range(n)]
    rows = [(1, " ".join(words)), (2, "start " + " ".join(words[500:600]) + " end"), (3, " ".join([*words[:-9], "x"]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in substrings.dedup(df).collect()}
    assert [(got[k]["n_words"], got[k]["n_removed"]) for k in (1, 2, 3)] == [(n, 0), (102, 100), (n - 8, n - 9)]
    got = {r["id"]: r for r in jaccard.join(df).collect()}
    assert [(got[k]["n_shingles"], got[k]["component_id"]) for k in (1, 2, 3)] == [(n - 4, 1), (98, 2), (n - 12, 1)]
    items = spark.createDataFrame([("q", " ".join(words[n - 30 : n - 15]))], "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontam.scan(df, items).collect()}
    assert got == {1: (n, 15), 2: (102, 0), 3: (n - 8, 15)}
    got = {r["doc_id"]: (r["n_words"], r["n_repeat_words"]) for r in quality.measure(df).collect()}
    assert got == {1: (n, 0), 2: (102, 0), 3: (n - 8, 0)}
    got = {r["id"]: r["n_tokens"] for r in maxent.fit_and_score(df).collect()}
    assert got == {1: n + 1, 2: 103, 3: n - 7}


def test_hashing_matches_text():
    import pyarrow as pa

    from panelyard.llm import packed

    texts = ["a b  c", None, "", "b c a b c", " x y"]
    hashes, offsets = packed.word_hashes(pa.array(texts))
    assert offsets.tolist() == [0, 3, 3, 3, 8, 10]
    found, starts = packed.window_hashes(hashes, offsets, 2)
    assert starts.tolist() == [0, 1, 3, 4, 5, 6, 8] and found[1] == found[2] == found[5] and found[0] == found[4]
    assert len(set(found.tolist())) == 4
    import numpy as np

    some = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2))
    at = packed.cuts(some, 7)
    assert all((packed.unpack(packed.pack(some[a:b])) == some[a:b]).all() for a, b in zip(at[:-1], at[1:], strict=True))
    assert len(packed.unpack(packed.pack(some[:0]))) == 0


def test_hashes_tell_thue_morse_words_and_windows_apart():
    import numpy as np
    import pyarrow as pa

    from panelyard.llm import packed

    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    one, two, again = packed.hash_strings(pa.array([word, word.translate(str.maketrans("ab", "ba")), word]))
    assert one == again != two
    letters = np.array([5 if c == "a" else 9 for c in word], np.uint64)
    assert packed.rolled(letters, 1024)[0] != packed.rolled(letters, 1024)[1024]
    p, rng = (1 << 61) - 1, np.random.default_rng(0)
    values = rng.integers(0, 2**64, 60, dtype=np.uint64)
    for size in (1, 2, 3, 4, 5, 8, 20, 23):
        found = packed.rolled(values, size)
        assert len(found) == 61 - size
        for k in (0, 7, 60 - size):
            h = 0
            for x in values[k : k + size]:
                h = (h * packed.BASE + int(x) % p) % p
            assert found[k] == packed.mix(np.array([(h + size * 0xD6E8FEB86659FD93) % 2**64], np.uint64))[0]
    offsets = np.array([0, 3, 3, 10])
    assert packed.whole_hashes(values, offsets, np.array([2, 1, 0])).tolist() == [packed.rolled(values[3:10], 7)[0], 0, packed.rolled(values[:3], 3)[0]]


def test_groups_are_bounded_by_bytes(spark):
    from panelyard.llm import packed

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert packed.numbers(spark, 0) == packed.numbers(spark, 10**6) == (2 * n, n)
    assert packed.numbers(spark, 100 * 10**12) == (372530, 186265)


@pytest.mark.parametrize("size", [1, 10**9])
def test_group_numbers_change_nothing(spark, docs, size, monkeypatch):
    from panelyard.llm import packed, substrings

    some = docs.where("doc_id is not null")
    want = Counter(tuple(map(str, r)) for r in substrings.dedup(some).collect())
    monkeypatch.setattr(packed, "GROUP_BYTES", size if size > 1 else 900)
    monkeypatch.setattr(packed, "BUCKET_BYTES", size if size > 1 else 700)
    assert Counter(tuple(map(str, r)) for r in substrings.dedup(some).collect()) == want


def test_substrings_take_text_ids_and_any_names(spark):
    from panelyard.llm import substrings

    a, b = passage(1, 30), passage(2, 30)
    rows = [("10", a, 1, 2, 3), ("9", a, 1, 2, 3), ("x", b, 1, 2, 3), (None, b, 1, 2, 3)]
    got = substrings.dedup(spark.createDataFrame(rows, "doc_id string, text string, __grp int, `__TIE` int, hit int")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got if r["doc_id"] in ("9", "10")} == {"9": 0, "10": 30}
    assert sorted(r["n_removed"] for r in got if r["doc_id"] in ("x", None)) == [0, 30] and got[0]["__TIE"] == 2
