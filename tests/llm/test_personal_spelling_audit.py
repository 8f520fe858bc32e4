"""Personal data, spelling variants and the filter audit, against brute force on awkward rows."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

SPACE = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id bigint, text string, source string, Spans string, k0 int, word string"


def rows_of(texts):
    return [(k, t, f"s{k % 3}" if k % 7 else None, "own", k, "w") for k, t in enumerate(texts)]


# Personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def checksum(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text):
    """The contract's patterns, as they are written."""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and checksum(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_patterns_equal_plain_regexes():
    from panelyard.llm import pii

    r = random.Random(5)
    made = ["".join(r.choice("ab.@-_+ 0123456789()%é\n") for _ in range(r.randrange(60))) for _ in range(4000)]
    made += ["".join(r.choice("a@.b_") for _ in range(r.randrange(30))) for _ in range(4000)]
    made += ["".join(r.choice("0123. -+") for _ in range(r.randrange(90))) for _ in range(4000)]
    made += ["a@b.c_d@e.f", "x@y@z.w", "4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "+1 (213) 555-0199 4111111111111111", "+12", "", "999.1.1.1 0001.2.3.4"]
    for t in made:
        assert [(a, k, b) for a, b, k in pii.patterns(t)] == plain_spans(t), t


def test_patterns_take_linear_time():
    import time

    from panelyard.llm import pii

    for t in ("a" * 400_000 + "@", "1" * 400_000 + ".", "+" * 400_000, "+1" + " " * 400_000, "1 " * 200_000, "a@" * 200_000, "1." * 200_000):
        began = time.time()
        pii.patterns(t)
        assert time.time() - began < 5, t[:4]


def _field(seed):
    from panelyard.llm import pii

    r = np.random.default_rng(seed)
    return r.normal(size=(9, pii.LABELS)), np.where(pii.RESTS, r.normal(size=(pii.LABELS, pii.LABELS)), 0)


def _paths(n):
    from panelyard.llm import pii

    for path in itertools.product(range(pii.LABELS), repeat=n):
        whole = (0, *path, 0)
        if all(pii.RESTS[a, b] for a, b in itertools.pairwise(whole)):
            yield path


def _score(e, moves, path):
    whole = (0, *path, 0)
    return sum(e[k, y] for k, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(whole))


def test_viterbi_and_likelihood_equal_enumeration():
    from panelyard.llm import pii

    e, moves = _field(3)
    bounds = np.array([0, 1, 4, 6, 9])
    got = pii.viterbi(e, bounds, moves)
    labels = np.array([1, 3, 4, 4, 0, 5, 0, 0, 7])
    want = 0.0
    for a, b in itertools.pairwise(bounds):
        scored = {p: _score(e[a:b], moves, p) for p in _paths(b - a)}
        assert tuple(got[a:b]) == max(scored, key=scored.get)
        want += scored[tuple(labels[a:b])] - math.log(sum(math.exp(s) for s in scored.values()))
    value, by_emission, by_move = pii.likelihood(e, bounds, moves, labels)
    assert abs(value - want) < 1e-9
    step = 1e-6
    for k, y in ((0, 1), (3, 4), (8, 0)):
        near = e.copy()
        near[k, y] += step
        assert abs((pii.likelihood(near, bounds, moves, labels)[0] - value) / step - by_emission[k, y]) < 1e-4
    for a, b in ((0, 0), (3, 4), (0, 5), (7, 0), (1, 0)):
        near = moves.copy()
        near[a, b] += step
        assert abs((pii.likelihood(e, bounds, near, labels)[0] - value) / step - by_move[a, b]) < 1e-4


def test_chains_are_tokens_near_anchors():
    from panelyard.llm import pii

    r = random.Random(8)
    texts = [" ".join(r.choice(["a", "bé", "1", "dot", "x@", "\n"]) if r.random() < 0.3 else "plain" for _ in range(r.randrange(40))) for _ in range(200)]
    raw, offsets = pii._columns(["", "  ", *texts, "5"])
    found = pii.chains(raw, offsets)
    got = [(int(found.text[c]), pii._tokens(raw, found)[found.bounds[c] : found.bounds[c + 1]]) for c in range(len(found.text))]
    want = []
    for k, t in enumerate(["", "  ", *texts, "5"]):
        words = SPACE.findall(t)
        hot = [i for i, w in enumerate(words) if re.search(r"[0-9@+(\[]", w) or w.lower() == "dot"]
        near = sorted({j for i in hot for j in range(i - pii.REACH, i + pii.REACH + 1) if 0 <= j < len(words)})
        run = []
        for j in near:
            if run and j > run[-1] + 1:
                want.append((k, [words[i] for i in run]))
                run = []
            run.append(j)
        if run:
            want.append((k, [words[i] for i in run]))
    assert got == want


@pytest.fixture(scope="module")
def field():
    from panelyard.llm import pii

    return pii.fit(pii.default_labels())


def test_held_out_accuracy(field):
    """Lines of other fillers: nearly all spans are found, nearly nothing else is."""
    import pyarrow as pa

    from panelyard.llm import pii

    held = pii.default_labels(8, 97)
    got = pii.spans_of(pa.array([t for t, _ in held]), field)
    want = {(k, kind, a, b) for k, (_, s) in enumerate(held) for a, b, kind in s}
    have = {(k, s["kind"], s["start"], s["end"]) for k, g in enumerate(got) for s in g}
    base = {(k, s["kind"], s["start"], s["end"]) for k, g in enumerate(got) for s in g if s["base"]}
    assert len(want & have) >= 0.92 * len(want) and len(have - want) <= 0.03 * len(have)
    assert len(want & base) < 0.75 * len(want)  # the field adds what the patterns miss


def test_personal_data_query(spark, field):
    from panelyard.llm import pii

    texts = [None, "", "a@b.cd and +1 (213) 555-0199 4111111111111111", "é" * 50 + " anna [at] firma [dot] com", "call (213) 555-0199 now", "no data", "x " * 30_000 + "1.2.3.4", "1.2.3.4", "1.2.3.4"]
    docs = spark.createDataFrame([*rows_of(texts), (None, "1.2.3.4", None, None, None, None)], SCHEMA)
    got = pii.find(docs, field=field)
    assert got.columns == ["doc_id", "text", "source", "k0", "word", "spans"]
    found = {(r["doc_id"], s["kind"], r["text"][s["start"] : s["end"]], s["base"]) for r in got.collect() for s in r["spans"]}
    assert {(2, "email", "a@b.cd", True), (2, "card", "4111111111111111", False), (2, "phone", "+1 (213) 555-0199", False), (3, "email", "anna [at] firma [dot] com", False), (4, "phone", "(213) 555-0199", False), (6, "ip", "1.2.3.4", True), (None, "ip", "1.2.3.4", True)} <= found
    assert not [f for f in found if f[0] == 5]
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(docs, field=field).collect()}
    assert clean[2] == "[email] and [phone] [card]" and clean[5] == "no data" and clean[0] is None
    assert pii.find(docs.limit(0), field=field).count() == 0
    assert [s["base"] for r in pii.find(docs, field=pii.fit([])).collect() for s in r["spans"]] == [True] * 5


def test_registered_query(spark, tmp_path):
    import hashlib

    from panelyard.llm import queries

    texts = [None, "a@b.cd 1.2.3.4", "é 4111 1111 1111 1111 é a@b.cd", "call (213) 555-0199 now"]
    spark.createDataFrame(rows_of(texts), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op11_personal_data(spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        base = [f"{('email', 'ip', 'card', 'phone')[n]}:{a}:{b}" for a, n, b in plain_spans(t or "")]
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [got[k][f"n_{x}"] for x in ("email", "ip", "card", "phone")] == [sum(b.startswith(x) for b in base) for x in ("email", "ip", "card", "phone")]
        assert set(base) <= set(got[k]["spans"].split(",")) | {""}
    assert got[3]["spans"] == "phone:5:19"


# Spelling


def _edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, least_chars, least, ratio, every):
    n = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_chars and c >= least}
    forms, near = {}, {}
    for w in n:
        near[w] = [v for v in n if v != w and _edits(v, w)]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, forms[w], root, n[w], len(near[w]), n[forms[w]] if forms[w] else None))
    return out


@pytest.mark.parametrize(("alphabet", "size", "ratio"), [("ab", 6, 2), ("aBÉé", 5, 3), ("abcde", 4, 1.5)])
def test_spelling_variants(spark, alphabet, size, ratio):
    from panelyard.llm import spelling

    r = random.Random(size)
    words = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, size + 1))) for _ in range(120)]
    texts = [" ".join(words[int(len(words) * r.random() ** 3)] for _ in range(r.randrange(80))) for _ in range(40)]
    rows = rows_of([None, "", "12 $$", "×÷", *texts, " ".join(words * 30), "x" * 3000 + " " + "aab baa abb"])
    rows += [rows[7], (None, texts[0], None, None, None, None)]
    got = spelling.variants(spark.createDataFrame(rows, SCHEMA), least_chars=2, least=2, ratio=ratio, every=5)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    have = [tuple(x) for x in got.collect()]
    assert len(have) == len(set(have)) and set(have) == plain_variants(rows, 2, 2, ratio, 5)


def test_spelling_chains_and_empty(spark):
    from panelyard.llm import spelling

    words = ["abcdefg", "abcdefh", "abcdeih", "abcjeih", "abkjeih", "albkjeih"]
    text = " ".join(w for k, w in enumerate(words) for _ in range(2**k))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {r["word"]: r["root"] for r in spelling.variants(docs, least=1, ratio=2, every=10**9).collect()}
    assert got == dict.fromkeys(words, words[-1])
    assert spelling.variants(docs.limit(0)).count() == 0


def test_spelling_plan_has_no_python_or_cross_join(spark):
    from panelyard.llm import spelling

    words = spark.createDataFrame([("abc", 3)], "word string, n long")
    plan = spelling.neighbours(words)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan and "Python" not in plan


# The matrix and the audit


def test_matrix_equals_counters(spark):
    from panelyard.llm import terms

    r = random.Random(2)
    texts = [None, "", "  ", *(" ".join(r.choice(["a", "b", "É", "x1", "a,"]) for _ in range(r.randrange(30))) for _ in range(60)), "long " * 5000]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).select("doc_id", "text", "k0")
    local, names, buckets = terms.coded(docs, shard_bytes=200)
    word = {x["number"]: x["word"] for x in terms.dictionary(local, buckets).collect()}
    assert len(set(word.values())) == len(word) == len({w for t in texts for w in SPACE.findall(t or "")})
    shards = terms.matrix(local, names, buckets).collect()
    assert len(shards) > 5
    got = {}
    for s in shards:
        for k, d in enumerate(s["doc_id"]):
            a, b = s["indptr"][k], s["indptr"][k + 1]
            got[d] = {word[i]: c for i, c in zip(s["indices"][a:b], s["counts"][a:b], strict=True)}
    assert got == {k: dict(Counter(SPACE.findall(t or ""))) for k, t in enumerate(texts)}
    stats = {x["doc_id"]: (x["n_words"], x["n_distinct"], x["k0"]) for x in terms.row_stats(local, names, buckets).collect()}
    assert stats == {k: (len(SPACE.findall(t or "")), len(set(SPACE.findall(t or ""))), k) for k, t in enumerate(texts)}


def plain_audit(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    fails = []
    for r in rows:
        t = r[1] or ""
        w = SPACE.findall(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": bool(set(t) & set("#$%&*|")), "E": r[0] is not None and r[0] > first[t]}
        fails.append((r[2] or "", r[0], {k for k, v in f.items() if v}))
    out = defaultdict(lambda: [0] * 6)
    removed_by = Counter()
    for part in {p for p, _, _ in fails}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                own = out[part, order, step]
                for p, d, bad in fails:
                    if p != part:
                        continue
                    gone = bool(bad & set(order[: step - 1]))
                    own[0] += not gone and f not in bad
                    own[1] += not gone and f in bad
                    own[2] += gone and f in bad
                    own[3] += bad == {f}
                    own[4] += not gone and f in bad and d in good
                    own[5] += not gone and f in bad and d in toxic
                removed_by[part, f] += own[1]
    return {(p, o, s, *v, removed_by[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_filter_audit(spark):
    from panelyard.llm import audit

    varied = [" ".join(f"w{(k * 31 + i) % 400}" for i in range(250)) for k in range(3)]
    texts = [None, "", "A B C", *varied, varied[0], varied[0], "same " * 300, "same " * 300, "# " + varied[1], varied[2].upper(), "SHOUT " * 2000, "x" * 60_000, None]
    rows = rows_of(texts)
    rows += [rows[3], rows[6], (None, varied[0], "s1", None, None, None), (None, None, None, None, None, None), (99, varied[1], "", None, None, None)]
    labels = [(3, 1, 0), (6, 1, 1), (6, 0, 0), (9, None, 1), (500, 1, 1), (None, 1, 1), (99, 1, None)]
    docs, said = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = audit.audit(docs, said)
    have = [tuple(x) for x in got.collect()]
    assert len(have) == len(set(have)) == 600 * len({r[2] or "" for r in rows})
    assert set(have) == plain_audit(rows, labels)
    assert audit.audit(docs.limit(0), said).count() == 0
    assert {x["good_lost"] for x in audit.audit(docs, said.limit(0)).collect()} == {0}
