"""Components, URL filters, quotation linking, sharding, extraction and the pipeline."""

import re
from collections import Counter
from pathlib import Path

import pytest


def test_components(spark):
    from panelyard.llm.components import connected

    chain = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 100), (7, 7), (None, 3), (300, 301), (302, 301), (0, 40)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(chain, "a int, b int")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[100] == got[200] == 100 and got[300] == got[301] == got[302] == 300
    assert len(got) == 46
    assert connected(spark.createDataFrame([], "a int, b int")).count() == 0


def test_url_filters(spark):
    from panelyard.llm import urls

    canonical = lambda u: f'<html><head><link href="{u}" rel="canonical"></head></html>'
    pages = [
        (1, "http://A.example.org/es/x?q=1#f", None),
        (2, "https://m.example.org/en/17", "<html></html>"),
        (3, "https://example.org/de/", ""),
        (4, "ftp://x.com/de/a", None),
        (5, "http://site.net/a", canonical("https://x.com/de/a")),
        (6, "http://other.net/b", '<META HTTP-EQUIV="Refresh" content="0; url=http://site.net/a">'),
        (7, "http://free.net/c", canonical("http://x.com/fr/1")),
        (8, "http://free.net/d", canonical("/c")),
        (9, "http://free.net/e", canonical("http://x.com/de/z") + '<meta http-equiv=refresh content="1;url=http://free.net/c">'),
        (10, None, canonical("http://x.com/de/z")),
        (11, "no address", None),
        (12, "http://x.com", None),
        (13, "http://site.net/a", None),
    ]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(pages, "page_id int, url string, html string"), urls.RULES).collect()}
    said = {k: (r["rule"], r["verdict"]) for k, r in got.items()}
    assert said[1] == ("example.org/es/", "block") and got[1]["host"] == "a.example.org" and got[1]["path"] == "/es/x"
    assert said[2] == ("example.org/en/1", "block") and said[3] == ("org/", "allow") and said[4] == ("com/de/", "block")
    assert said[5] == said[6] == said[13] == (None, "block")
    assert said[7] == said[8] == said[9] == (None, "allow")  # an allowed alias goes before a blocked one
    assert said[10] == said[11] == (None, "allow") and got[10]["host"] == "" and said[12] == (None, "allow")
    assert urls.judge(spark.createDataFrame([], "page_id int, url string, html string"), urls.RULES).count() == 0


def test_quotes(spark):
    from panelyard.llm import quotes

    rows = [
        (1, 0, "user", "Hello World\nsecond  line"),
        (1, 1, "assistant", "Someone wrote:\n> hello   world\nmy answer"),
        (1, 2, "user", "> > Hello world\n>> second line\n> my answer\n\nthanks"),
        (1, 3, "user", "> unknown words\n> thanks\nok"),
        (2, 0, "user", "> hello world\nno link across conversations"),
        (2, 1, "user", None),
        (None, None, None, None),
        (1, 3, "user", "> unknown words\n> thanks\nok"),
    ]
    got = quotes.link(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).orderBy("conv_id", "position").collect()
    one = [r for r in got if r["conv_id"] == 1]
    assert [r["body"] for r in one] == ["Hello World\nsecond  line", "my answer", "thanks", "ok", "ok"]
    assert [(r["reply_to"], r["n_quoted"], r["n_linked"], r["depth"]) for r in one] == [(None, 0, 0, 0), (0, 1, 1, 1), (1, 2, 2, 2), (None, 1, 0, 1), (None, 1, 0, 1)]
    assert [r["position"] for r in one] == [1, 2, 3, 4, 5]
    two = [r for r in got if r["conv_id"] == 2]
    assert [(r["body"], r["reply_to"], r["n_linked"]) for r in two] == [("no link across conversations", None, 0), ("", None, 0)]
    assert quotes.link(spark.createDataFrame([], "conv_id int, turn int, role string, text string")).count() == 0


def test_sharding(spark):
    import xxhash

    from panelyard.llm import shards

    names = [f"n{k}" for k in range(7)]
    table = shards.fill(names, 997)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(table) == 997
    fewer = shards.fill(names[:-1], 997)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 0.3 * 997
    df = spark.createDataFrame([(k, f"t{k}", "s") for k in range(500)] + [(None, "a", None), (None, "b", None)], "doc_id bigint, text string, shard string")
    got = shards.place(df, names, "doc_id", "text", 997).collect()
    assert len(got) == 502
    for r in got:
        key = r["doc_id"].to_bytes(8, "little", signed=True) if r["doc_id"] is not None else r["text"].encode()
        slot = int.from_bytes(xxhash.xxh64(key, 42).digest(), "big", signed=True) % 997
        assert (r["slot"], r["shard"]) == (slot, names[table[slot]])
    with pytest.raises(ValueError):
        shards.fill(names, 1000)
    assert shards.place(df.limit(0), names, "doc_id", "text", 997).count() == 0


def test_extraction(spark):
    from panelyard.llm import extraction

    page = (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies</div><article><h1>Title &amp; more</h1><p>First&nbsp; <b>bold\n text</b>.<p>Ok.</p><!-- x --><div class=ad>Buy</div><blockquote>A quote &lt;p&gt;</blockquote>"
        "<form><label>Name</label><input></form></article><section id='comments'><p>Reader says</p></section><aside><p>Related</p></aside><footer>&copy; x</footer></body></html>"
    )
    plain = "<body><ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a><li><a href=d>Four</a></ul><div>" + "long text here. " * 30 + "</div><div>short.</div><div>" + "more text. " * 30 + "</div></body>"
    rows = [(1, "u", page, "x"), (2, "u", None, "x"), (3, None, "", "x"), (4, "u", plain, "x"), (5, "u", "<p>only", "x")]
    got = {r["page_id"]: r for r in extraction.extract(spark.createDataFrame(rows, "page_id int, url string, html string, TEXT string")).collect()}
    assert got[1]["text"] == "Title & more\n\nFirst bold text.\n\nOk.\n\nA quote <p>"
    assert got[2]["text"] == got[3]["text"] == "" and got[2]["n_chars"] == 0 and got[5]["text"] == "only"
    assert got[4]["text"] == "\n\n".join([("long text here. " * 30).strip(), "short.", ("more text. " * 30).strip()])


SPACE = re.compile("[^\x20\x09-\x0d]+")
FOLD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
WORDS = re.compile(r"[^\x20\x09-\x0d]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def _good(t):
    """The current quality policy, by hand."""
    w = SPACE.findall(t or "")
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times = Counter(win)
    repeated = {i + j for i, x in enumerate(win) if times[x] > 1 for j in range(8)}
    n, chars = len(w), sum(map(len, w))
    symbols, bangs = len(re.findall(r"[#*$%&|<>]", t or "")), (t or "").count("!!")
    return n >= 20 and 100 * len(repeated) <= 30 * n and 100 * symbols <= 20 * n and 100 * bangs <= 30 * n and 2 * n <= chars <= 30 * n


def _one_of_each(rows):
    """The row with the smallest id of each component of near copies (five words, 0.8)."""
    sets = []
    for r in rows:
        w = SPACE.findall(lower(r[1]))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)]))
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((comp[a], comp[b]))
                comp = [lo if c == hi else c for c in comp]
    first = {}
    for r, c in zip(rows, comp, strict=True):
        first[c] = min(first.get(c, r), r, key=lambda x: (x[0] is None, x[0] or 0))
    return list(first.values())


def _without_repeats(rows):
    """Texts without windows of 20 words that come earlier; what the cut leaves between words stays."""
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        spans = [m.span() for m in WORDS.finditer(r[1])]
        w = [r[1][a:b] for a, b in spans]
        gone = set()
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                gone.update(range(i, i + 20))
            seen.add(k)
        kept, text, at = [i for i in range(len(w)) if i not in gone], "", 0
        if gone and kept:
            for i in range(len(w)):
                end = spans[i + 1][0] if i + 1 < len(w) else len(r[1])
                if i not in gone:
                    text += r[1][at:end] if at <= spans[i][0] else r[1][spans[i][0] : end]
                at = max(at, end)
            last = kept[-1]
            if last + 1 < len(w):  # a cut at the end takes the blank before it
                text = text[: len(text) - (spans[last + 1][0] - spans[last][1])]
        out.append((r[0], text if gone else r[1], *r[2:]))
    return out


def _hit(t, items):
    w = FOLD.findall(lower(t))
    for _, x in items:
        b = FOLD.findall(lower(x))
        for win in [b[i : i + 10] for i in range(len(b) - 9)] if len(b) >= 10 else [b] if b else []:
            if any(w[i : i + len(win)] == win for i in range(len(w) - len(win) + 1)):
                return True
    return False


def test_pipeline_equals_brute_force(spark, tmp_path):
    import random

    import sentencepiece

    import corpus_pipeline
    from panelyard.llm import pieces

    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, shared, question = [prose(120) for _ in range(30)], prose(60), prose(14)
    texts = [
        *base, base[0], base[1].replace(" ", "  "), base[2].rsplit(" ", 2)[0], base[3] + " extra words", base[4].upper(), " ".join(["again and again"] * 60), prose(10), "", None, "# " * 80,
        prose(40) + "\n" + shared + "\n" + prose(30), shared + " " + prose(50), prose(50) + " " + shared, prose(40) + " " + question + " " + prose(40), prose(30) + " " + question.upper().replace(" ", ", ") + ". " + prose(30),
        prose(3000), "É à " + prose(40) + "\t日本\n", prose(25) + " ▁x", shared, prose(22) + "!!" * 3,
    ]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)]
    rows += [rows[0], rows[35], (None, base[7], None, None, None), (None, prose(70), None, None, None), (None, None, None, None, None)]
    items = [("q1", question), ("q2", None), ("q3", prose(30)), ("q4", "two words")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [r for r in rows if _good(r[1])]
    want = [r for r in _without_repeats(_one_of_each(kept)) if not _hit(r[1], items)]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 25 < len(got) < len(kept) < len(rows)
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in want)
    assert all(r["round_trip"] and r["n_chars"] == len(r["text"]) and r["ids"] == sp.encode(r["text"]) for r in got)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "text", "ids"} <= set(out.columns)


def test_stages_pass_extra_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    text = " ".join(f"word{k}x" for k in range(40))
    df = spark.createDataFrame([(k, text + f" tail{k}", k, k, k, k) for k in range(2)], "doc_id bigint, text string, n_chars bigint, `key` int, `H` int, __key int").selectExpr("*", "1 AS sig", "2 AS grp", "3 AS n_words", "4 AS pos", "5 AS __grp", "6 AS IDS")
    spark.createDataFrame([("q", "nothing of the kind")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        assert out.count() == (1 if name == "ngram_jaccard_join" else 2)
        if name != "sentencepiece_encoding":
            assert out.columns == df.columns
            assert out.select("sig", "grp", "n_words", "pos", "__grp", "IDS").distinct().collect() == [(1, 2, 3, 4, 5, 6)], name


def test_url_filters_of_long_hosts_and_missing_urls(spark):
    """A host of very many labels, one host on many pages, and many pages without URLs."""
    import time

    from panelyard.llm import urls

    long = ".".join(["a"] * 20_000) + ".example.org"
    rows = [(0, f"http://{long}/es/x"), (1, f"http://{long}/en/1/x"), (2, "http://example.org/es"), (3, "http://org/"), (4, "http://a.b.example.com/de/")]
    rows += [(10 + k, None) for k in range(300)] + [(1000 + k, f"http://hot.example.com/fr/{k}") for k in range(300)]
    began = time.time()
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), urls.RULES, html=None).collect()}
    assert time.time() - began < 30 and len(got) == len(rows)
    assert [got[k]["rule"] for k in range(5)] == ["example.org/es/", "example.org/en/1", "org/", "org/", "com/de/"]
    assert [got[k]["verdict"] for k in range(5)] == ["block", "block", "allow", "allow", "block"]
    assert all(got[10 + k]["verdict"] == "allow" and got[10 + k]["host"] == "" and got[10 + k]["rule"] is None for k in range(300))
    assert {got[1000 + k]["rule"] for k in range(300)} == {"com/fr/"}


def test_url_filters_take_any_names(spark):
    from panelyard.llm import urls

    pages = [(1, "https://m.example.org/en/17", None), (2, "http://a.net/x", '<link rel="canonical" href="http://x.com/de/q">')]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    clash = df.selectExpr("*", "1 AS rules", "2 AS other", "3 AS hit", "4 AS node", "5 AS k0", "6 AS HOST", "7 AS labels", "8 AS component", "9 AS r_host")
    out = urls.judge(clash, urls.RULES)
    assert out.columns == ["page_id", "url", "html", "rules", "other", "hit", "node", "k0", "labels", "component", "r_host", "host", "path", "rule", "verdict"]
    assert [(r["verdict"], r["rules"], r["other"], r["hit"], r["node"], r["k0"], r["r_host"], r["host"]) for r in out.orderBy("page_id").collect()] == [("block", 1, 2, 3, 4, 5, 9, "m.example.org"), ("block", 1, 2, 3, 4, 5, 9, "a.net")]


def test_lookup_table_is_filled_in_turns_by_preference(spark):
    import hashlib

    from panelyard.llm import shards

    names, size = ["red", "green", "blue"], 101
    orders = []
    for name in names:  # each shard's whole order of slots, written out
        d = hashlib.sha256(name.encode()).digest()
        start, step = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
        orders.append([(start + k * step) % size for k in range(size)])
        assert sorted(orders[-1]) == list(range(size))
    want = {}
    while len(want) < size:
        for k, order in enumerate(orders):
            if len(want) < size:
                want[next(s for s in order if s not in want)] = k
    assert shards.fill(names, size) == [want[s] for s in range(size)]


def test_shards_are_written_and_counted(spark, tmp_path):
    from panelyard.llm import shards

    df = spark.createDataFrame([(k, f"t{k}") for k in range(300)], "doc_id bigint, text string")
    placed = shards.place(df, ["a", "b"], "doc_id", "text", 101)
    shards.write(placed, str(tmp_path / "out"), 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r["shard"]: r["n_rows"] for r in shards.balance(placed).collect()} == {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()}
    assert back.count() == 300


def test_written_tables_are_deleted(spark):
    from panelyard.llm import common

    df = common.written(spark.range(5).toDF("a"), "gone")
    at = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("///", "/")
    assert Path(at).exists()
    common.dropped(df)
    assert not Path(at).exists()


@pytest.mark.parametrize("mark", ["class='content has-sidebar'", "class=with-ads", "class='main no-comments'", "id=skip-target", "class=sidebar"])
def test_extraction_keeps_what_holds_the_article(mark):
    from panelyard.llm import extraction

    inner = "<div class='article-header'><h1>Title</h1></div><p>" + "Long text. " * 20 + "</p>"
    want = "Title\n\n" + ("Long text. " * 20).strip()
    assert extraction.main_text(f"<body><nav><a href=a>Home</a></nav><div {mark}><article>{inner}</article></div><div class='site-footer'>foot</div></body>") == want
    assert extraction.main_text(f"<body><nav><a href=a>Home</a></nav><div {mark}>{inner}</div></body>") == want


def test_extraction_goes_on_after_a_list_of_links():
    from panelyard.llm import extraction

    links = "<ul>" + "".join(f"<li><a href={k}>Reference {k}</a></li>" for k in range(5)) + "</ul>"
    page = f"<body><div><p>{'First part. ' * 30}</p>{links}<p>{'Last part. ' * 20}</p></div><div>{links}</div><div><p>other</p></div></body>"
    got = extraction.main_text(page).split("\n\n")
    assert got[0].startswith("First part.") and got[1] == "Reference 0" and got[-1].startswith("Last part.") and len(got) == 7


def test_url_filters_take_every_link_decoded(spark):
    from panelyard.llm import urls

    link = lambda u, rel="canonical": f'<link rel="{rel}" href="{u}">'
    pages = [
        (1, "http://a.net/1", link("http://b.net/x?p=1&amp;q=2")),
        (2, "http://b.net/x?p=1&q=2", link("http://x.com/de/z", "alternate canonical")),
        (3, "http://a.net/3", link("http://c.net/3") + link("http://x.com/de/&#x7a;&#38;amp;")),
        (4, "http://a.net/4", '<meta http-equiv=refresh content="5"><meta http-equiv=refresh content="1;url=http://x.com/de/y">'),
        (5, "http://a.net/5", link("http://x.com/de/y", "canonical-not")),
    ]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df, urls.RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}
    assert {r["b"] for r in urls.edges(df).collect()} == {"b.net/x?p=1&q=2", "x.com/de/z", "c.net/3", "x.com/de/z&amp;", "x.com/de/y"}


def test_extraction_by_distribution_and_marks():
    from panelyard.llm.extraction import main_text

    long = ("Long text here. " * 20).strip()
    far = "<div><p>x y</p></div>" * 6
    assert main_text(f"<body><article><p>{long}</p></article>{far}<article><p>Second</p></article></body>") == f"{long}\n\nSecond"
    inside = "<h1>T</h1><p class='share-price-note'>price</p><div class='header-image'>image</div><p id='comment-on-policy'>policy</p>"
    assert main_text(f"<article>{inside}<p>{long}</p></article>") == f"T\n\nprice\n\nimage\n\npolicy\n\n{long}"
    talk = f"<ol class='comment-list'><li><article class='comment-body'><p>{long * 3}</p></article></li></ol>"
    assert main_text(f"<body><article><p>{long}</p></article><section id='comments'>{talk}</section></body>") == long
    assert main_text(f"<body><article><p>{long}</p></article><div class='post-comments'><p>{long}</p></div></body>") == long
    assert main_text(f"<article><p>tease</p></article><div><p>{long}</p><p>{long}</p></div>") == f"{long}\n\n{long}"
    assert main_text(f"<article><p>{long}</p><div class=ad>Buy</div><p>end</p><ul><li><a href=x>ref</a></ul></article><p>foot</p>") == f"{long}\n\nend\n\nref"
    assert main_text("<p>" + "<a href=x>link</a>" * 5 + "</p>") == ""
    head = f"<article><div class=header><h1>T</h1></div><header class='page-header'><p>by X</p></header><p>{long}</p><section class='reader-comments'><p>no</p></section><div class=comments>no</div></article>"
    assert main_text(head) == f"T\n\nby X\n\n{long}"


def test_stretches_equal_brute_force():
    import random

    from panelyard.llm.extraction import WINDOW, Boxes, stretches

    def spans(found, own):
        """Stretches of lines in one container, or each in one of its own."""
        boxes, placed, shared = Boxes(), [], None
        for x in found:
            shared = boxes.add(0) if own or shared is None else shared
            placed.append((*x, boxes.add(shared)))
        return stretches(placed, boxes)

    rng = random.Random(2)
    for _ in range(300):
        n, region, found = rng.randint(0, 25), 0, []
        for k in range(n):
            region = rng.choice([region] * 5 + [0, region + 1])
            w = rng.choice([0, 0, 0, 3, 10])
            found.append(("x" * 10, w, region))
        weight = [10 if r else w if 2 * w >= 10 else 0 for _, w, r in found]
        want, k = [], 0
        live = lambda a: a < n and sum(weight[b] for b in range(a, min(a + WINDOW, n)) if all(found[c][2] == found[a][2] for c in range(a, b + 1))) > 0
        while k < n:
            if not weight[k]:
                k += 1
                continue
            j = k
            while live(j) and found[j][2] == found[k][2]:
                j += 1
            last = max(i for i in range(k, j) if weight[i])
            want.append((k, last + 1, sum(weight[k : last + 1]), found[k][2]))
            k = j
        got = spans(found, True)
        joined = spans(found, False)  # in one container link lines join stretches
        assert [x for x in got] == want or all(x in want for x in got if x[3])
        assert sum(x[2] for x in joined) == sum(x[2] for x in want)


LONG = "Plain words of an article that go on and on for more than a line. " * 4
SIDE = "<div id=side><p>short text of the side</p></div>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><svg-icon name=x></svg-icon><p>{LONG}</p></body>",
        f"<body><template-part><select-x><p>{LONG}</p></body>",
        f"<body><p title=it's>{LONG}</p></body>",
        f"<body><p title=it's class=\"a\"\">{LONG}</p></body>",
        f"<body><div><svg><path d='x'></div><p>{LONG}</p></body>",
        f"<body><title><p>{LONG}</p></body>",
        f"<body><p>{LONG}</p><a href=\"x",
        f"<body><p class=\"a>{LONG}</p>",
        f"<body><p data-x='>' title = \"a > b\">{LONG}</p></body>",
        f"<body><p>{LONG}</p><script>var x = '<p>no</p>'",
        f"<body><!-- <p>no</p> --><p>{LONG}</p><? php ?><![CDATA[ x ]]></body>",
        f"<BODY><P CLASS=Text>{LONG}</P></span></BODY>",
        f"<body><math><mi>x</mi></math><p>{LONG}</p><canvas>no</canvas></body>",
    ],
)
def test_extraction_of_broken_pages(page):
    from panelyard.llm.extraction import main_text

    assert main_text(page) == LONG.strip()


def test_extraction_takes_linear_time():
    import time

    from panelyard.llm.extraction import main_text

    n = 1 << 20
    broken = ["<a ", "<a x='", "<p ", "<!--", "<![", "</", "<title>", "<script", "<div>", "<div></span>", "<div><p>x", "<a x=\">\" ", "<p class='a b c'>y", "<b>z", "</div>", "<textarea><x", "<article><i>q", "&amp", "<svg>w"]
    for piece in broken:
        page = f"<body><p>{LONG}</p>" + piece * (n // len(piece))
        began = time.time()
        main_text(page)
        assert time.time() - began < 12, piece


@pytest.mark.parametrize("name", ["gdpr-banner", "ad-unit", "related-articles", "commentSection", "AdSlot", "share-buttons", "post_comments", "adBanner"])
def test_furniture_inside_an_article(name):
    from panelyard.llm.extraction import main_text

    page = f"<body><article><p>{LONG}</p><div class='{name}'><p>{LONG} no</p></div><p class=share>Shares rose.</p><p class='intro-text'>So it was.</p></article></body>"
    assert main_text(page) == f"{LONG.strip()}\n\nShares rose.\n\nSo it was."


@pytest.mark.parametrize("name", ["topnav", "l-aside", "c-footer", "left-sidebar", "siteHeader"])
def test_furniture_outside_an_article(name):
    from panelyard.llm.extraction import main_text

    assert main_text(f"<body><div class='{name}'><p>{LONG} no</p></div><div class=story><p>{LONG}</p><p>{LONG}</p></div></body>") == f"{LONG.strip()}\n\n{LONG.strip()}"


def test_unmarked_articles_keep_all_their_stretches():
    from panelyard.llm.extraction import main_text

    links = "<figure><a href=x>picture</a></figure>" * 3
    other = "<div><ul>" + "<li><a href=x>some link</a></li>" * 6 + "</ul></div>"
    for cut in (links, other, other + links):
        page = f"<body>{SIDE}{other}<div class=story><h1>Title</h1><p>{LONG}</p>{cut}<p>{LONG}</p><p>End.</p></div>{other}{SIDE}</body>"
        got = [x for x in main_text(page).split("\n\n") if x not in ("picture", "some link")]
        assert got == ["Title", LONG.strip(), LONG.strip(), "End."], cut


def test_extraction_round_trip_of_generated_pages(spark):
    """Articles are laid into pages of random furniture; the text must come back as it was."""
    import html
    import random

    from panelyard.llm import extraction

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé&<日") for _ in range(rng.randint(1, 8)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    rows, want = [], {}
    for k in range(60):
        blocks = [words(1, 6)] + [words(20, 60) for _ in range(rng.randint(1, 6))] + ([words(1, 3)] if k % 3 else [])
        tags = ["h1"] + [rng.choice(["p", "div", "blockquote", "li", "pre"]) for _ in blocks[1:]]
        inner = "".join(f"<{t}>{html.escape(b).replace(' ', rng.choice([' ', chr(10), '  ']))}</{t}>" for t, b in zip(tags, blocks, strict=True))
        bits = [
            f"<nav><ul><li><a href=a>Home</a></ul></nav>", f"<div class='ad'>{html.escape(words(2, 9))}</div>", f"<aside><p>{html.escape(words(2, 30))}</p></aside>", f"<form><p>{html.escape(words(2, 9))}</p></form>",
            f"<div class='cookie-notice'>{html.escape(words(2, 20))}</div>", f"<script>var x='no</p>'</script>", f"<div id=comments><p>{html.escape(words(2, 10))}</p></div>", "<!-- <p>no</p> -->",
        ]
        pick = lambda: "".join(rng.sample(bits, rng.randint(0, 5)))
        wrap = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div class='content'>", "</div>")])
        rows.append((k, f"<html><head><title>T</title></head><body><header>{html.escape(words(1, 4))}</header>{pick()}{wrap[0]}{inner}{wrap[1]}{pick()}<footer>{html.escape(words(2, 8))}</footer></body></html>".replace("<header>", "<header class=x>")))
        want[k] = "\n\n".join(blocks)
    got = {r["page_id"]: r for r in extraction.extract(spark.createDataFrame(rows, "page_id int, html string")).collect()}
    assert {k: r["text"] for k, r in got.items()} == want and all(r["n_chars"] == len(want[k]) for k, r in got.items())
    assert extraction.extract(spark.createDataFrame([], "page_id int, html string")).count() == 0


QUOTED = """Thanks for the plan. I have read all of it twice now and I agree with most of what
it says about the second part."""


def _conversations():
    rewrapped = "\n".join("> " + x for x in ["Thanks for the plan. I have read all", "of it twice now and I agree with", "most of what it says about the second part."])
    part = "> read all of it twice now and I agree with most of"
    return [
        (1, 1, "a", QUOTED),
        (1, 2, "b", "yes"),
        (1, 3, "c", "Someone else"),
        (1, 4, "a", f"A wrote:\n{rewrapped}\n\nFine."),
        (1, 5, "b", f"{part}\nWhich one?"),
        (1, 6, "c", "yes"),
        (1, 7, "a", "> yes\nGood."),
        (1, 8, "b", "> Fine.\n> > " + QUOTED.replace("\n", "\n> > ") + "\nend"),
        (1, 9, "c", "> read all of it twice but I do not agree with most of\nno source"),
        (1, 9, "d", "> no source\nsame turn"),
        (2, None, "a", "null turn text that is quite long enough for a window of words"),
        (2, 5, "b", "> null turn text that is quite long enough for a window of words\nok"),
        (None, 1, None, None),
        (None, None, "x", "> yes"),
        (3, 2000, "a", "far"),
        (3, 5000, "b", "> far"),
        (3, 1, "c", "first"),
        (3, 4999, "d", "between"),
    ]


def test_passages_are_linked_rewrapped_and_in_part(spark):
    from panelyard.llm import quotes

    df = spark.createDataFrame(_conversations(), "conv_id int, turn int, role string, text string")
    got = quotes.link(df.repartition(5)).collect()
    one = {(r["turn"], r["role"]): (r["reply_to"], r["n_quoted"], r["n_linked"], r["depth"]) for r in got if r["conv_id"] == 1}
    assert one[4, "a"] == (1, 1, 1, 1) and one[5, "b"] == (1, 1, 1, 1)
    assert one[7, "a"] == (6, 1, 1, 1)  # the latest message that says so
    assert one[8, "b"] == (4, 2, 2, 2) and one[9, "c"] == (None, 1, 0, 1) and one[9, "d"] == (None, 1, 0, 1)
    order = [r["turn"] for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["position"])]
    assert order == [1, 4, 5, 8, 2, 3, 6, 7, 9, 9]  # threads by their first message
    two = {r["turn"]: (r["reply_to"], r["n_linked"], r["position"]) for r in got if r["conv_id"] == 2}
    assert two == {None: (None, 0, 1), 5: (None, 1, 2)}
    assert [r["turn"] for r in sorted((r for r in got if r["conv_id"] == 3), key=lambda r: r["position"])] == [1, 2000, 5000, 4999]
    assert next(r["body"] for r in got if r["turn"] == 4) == "Fine."


def test_quotes_equal_their_sql_and_take_any_names(spark, tmp_path):
    import duckdb

    from panelyard.llm import queries, quotes

    rows = _conversations() * 2
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    columns = ["conv_id", "turn", "role", "body", "reply_to", "n_quoted", "n_linked", "depth", "position"]
    got = Counter(tuple(r) for r in quotes.link(df).select(columns).collect())
    df.write.parquet(str(tmp_path / "c"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    assert Counter(db.execute(f"SELECT {', '.join(columns)} FROM ({queries.OP5_SQL})").fetchall()) == got
    clash = df.selectExpr("*", "1 AS c", "2 AS t", "3 AS __c", "4 AS `h`", "5 AS root", "6 AS k0", "7 AS DEPTH", "8 AS ls")
    more = quotes.link(clash)
    assert more.columns[:4] == ["conv_id", "turn", "role", "text"] and Counter(tuple(r) for r in more.select(columns).collect()) == got
    assert more.select("c", "t", "__c", "h", "root", "k0", "ls").distinct().collect() == [(1, 2, 3, 4, 5, 6, 8)]
