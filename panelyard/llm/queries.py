"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, decontam, extraction, jaccard, maxent, pieces, pii, quality, quotes, shards, spelling, substrings, urls
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = maxent.fit_and_score(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), urls.RULES).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH RECURSIVE
raw AS (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS t FROM pages),
p AS (SELECT page_id, u, t, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM raw),
named AS (
  SELECT u, host, path, regexp_extract(regexp_extract(t, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS g FROM p WHERE contains(u, '://')
  UNION ALL
  SELECT u, host, path, regexp_extract(regexp_extract(t, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM p WHERE contains(u, '://')),
target AS (SELECT u, CASE WHEN contains(g, '://') THEN g WHEN starts_with(g, '//') THEN 'http:' || g WHEN starts_with(g, '/') THEN 'http://' || host || g ELSE 'http://' || host || regexp_extract(path, '(?s)^(.*/)?') || g END AS g FROM named WHERE g <> ''),
url_of AS (SELECT DISTINCT u FROM p WHERE contains(u, '://') UNION SELECT u FROM target UNION SELECT g FROM target),
parsed AS (SELECT u, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(u, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS rest FROM url_of),
node AS (SELECT u, host, host || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END AS node, regexp_extract(CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END, '(?s)^[^?]*') AS path FROM parsed),
link AS (SELECT a.node AS a, b.node AS b FROM target JOIN node a ON a.u = target.u JOIN node b ON b.u = target.g WHERE a.node <> b.node),
sym AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT DISTINCT a AS n, a AS c FROM sym UNION SELECT sym.b, reach.c FROM reach JOIN sym ON sym.a = reach.n),
comp AS (SELECT n, min(c) AS c FROM reach GROUP BY n),
rules(rh, rp, allowed) AS (VALUES ('org', '/', true), ('example.org', '/es/', false), ('example.org', '/en/1', false), ('com', '/fr/', true), ('com', '/de/', false)),
ruled AS (SELECT DISTINCT node, host, path FROM node),
known AS (SELECT n, c, arg_max(allowed, 2 * (length(rh) + length(rp)) + CAST(allowed AS INT)) AS allowed FROM comp JOIN ruled ON node = n LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY n, c),
class AS (SELECT c, coalesce(bool_or(allowed), false) AS some_allow, coalesce(bool_or(NOT allowed), false) AS some_block FROM known GROUP BY c),
hit AS (SELECT page_id, arg_max(rh || rp, 2 * (length(rh) + length(rp)) + CAST(allowed AS INT)) AS rule, arg_max(allowed, 2 * (length(rh) + length(rp)) + CAST(allowed AS INT)) AS allowed FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, hit.rule,
  CASE WHEN hit.rule IS NOT NULL THEN CASE WHEN hit.allowed THEN 'allow' ELSE 'block' END WHEN NOT some_allow AND some_block THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN hit USING (page_id) LEFT JOIN node ON node.u = p.u LEFT JOIN comp ON comp.n = node.node LEFT JOIN class USING (c)
"""


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP3_SQL = r"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, k, n FROM (
    SELECT item, len(w) AS n, array_to_string(w, ' ') AS k FROM b WHERE len(w) BETWEEN 1 AND 9
    UNION ALL
    SELECT item, 10 AS n, array_to_string(w[i:i + 9], ' ') AS k FROM (SELECT item, w, unnest(range(1, len(w) - 8)) AS i FROM b WHERE len(w) >= 10))),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, win.item FROM dw JOIN win ON dw.k = win.k AND dw.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\x09-\\x0D]+", " "))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM late)),
one AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM one ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "body", "reply_to", "n_quoted", "n_linked", "depth", "position")


OP5_SQL = r"""
WITH RECURSIVE
m AS (SELECT conv_id, turn, role, text, coalesce(CAST(turn AS BIGINT), -9223372036854775808) AS t, row_number() OVER () AS k, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM conversations),
l AS (SELECT k, i, ls[i] AS x FROM (SELECT k, ls, unnest(range(1, len(ls) + 1)) AS i FROM m)),
q AS (
  SELECT k, i, length(regexp_replace(regexp_extract(x, '^[ \t]*>(?:[ \t]?>)*[ \t]?'), '[^>]', '', 'g')) AS level, regexp_replace(x, '^[ \t]*>(?:[ \t]?>)*[ \t]?', '') AS line,
    regexp_matches(x, '^[^>].*\bwrote:\s*$') AS announces FROM l),
n AS (SELECT *, level = 0 AND announces AND coalesce(lead(level) OVER (PARTITION BY k ORDER BY i), 0) > 0 AS telling FROM q),
e AS (SELECT *, CASE WHEN telling OR NOT regexp_matches(line, '[^\x20\x09-\x0D]') THEN '' ELSE line END AS own FROM n),
f AS (SELECT *, CASE WHEN own <> '' AND lag(own) OVER w <> '' AND lag(level) OVER w = level THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY k ORDER BY i)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS nr FROM f),
p AS (SELECT k, nr, any_value(level) AS level, regexp_extract_all(translate(string_agg(own, ' ' ORDER BY i), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM g WHERE own <> '' GROUP BY k, nr),
own AS (
  SELECT DISTINCT conv_id, t, array_to_string(w, ' ') AS h FROM p JOIN m USING (k) WHERE level = 0
  UNION SELECT conv_id, t, array_to_string(regexp_extract_all(translate(own, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') FROM e JOIN m USING (k) WHERE level = 0 AND own <> ''),
quoted AS (SELECT k, nr, level, conv_id, t, w FROM p JOIN m USING (k) WHERE level > 0),
same AS (SELECT q.k, q.nr, max(own.t) AS origin FROM quoted q JOIN own ON own.conv_id IS NOT DISTINCT FROM q.conv_id AND own.h = array_to_string(q.w, ' ') AND own.t < q.t GROUP BY ALL),
rest AS (SELECT k, nr, conv_id, t, array_to_string(w[i:i + 7], ' ') AS h FROM (
  SELECT *, unnest(list_distinct(list_append(range(1, len(w) - 6, 8), len(w) - 7))) AS i FROM quoted ANTI JOIN same USING (k, nr) WHERE len(w) >= 8)),
seen AS (SELECT conv_id, h, min(t) AS origin FROM (SELECT conv_id, t, array_to_string(w[i:i + 7], ' ') AS h FROM (SELECT conv_id, t, w, unnest(range(1, len(w) - 6)) AS i FROM p JOIN m USING (k) WHERE level = 0 AND len(w) >= 8)) GROUP BY ALL),
part AS (SELECT rest.k, rest.nr, max(origin) AS origin FROM rest LEFT JOIN seen ON seen.conv_id IS NOT DISTINCT FROM rest.conv_id AND seen.h = rest.h GROUP BY ALL HAVING bool_and(coalesce(origin < rest.t, false))),
links AS (SELECT k, max(CASE WHEN level = 1 THEN coalesce(s.origin, o.origin) END) AS reply_to, count(*) AS n_quoted, count(coalesce(s.origin, o.origin)) AS n_linked, max(level) AS depth
  FROM quoted LEFT JOIN same s USING (k, nr) LEFT JOIN part o USING (k, nr) GROUP BY k),
edge AS (SELECT coalesce(CAST(conv_id AS VARCHAR), chr(0)) AS c, t AS a, reply_to AS b FROM links JOIN m USING (k) WHERE reply_to IS NOT NULL),
sym AS (SELECT c, a, b FROM edge UNION SELECT c, b, a FROM edge),
reach AS (SELECT DISTINCT c, a AS n, a AS r FROM sym UNION SELECT sym.c, sym.b, reach.r FROM reach JOIN sym ON sym.c = reach.c AND sym.a = reach.n),
root AS (SELECT c, n, min(r) AS root FROM reach GROUP BY c, n),
body AS (SELECT k, string_agg(line, chr(10) ORDER BY i) AS body FROM n WHERE level = 0 AND NOT telling GROUP BY k)
SELECT m.conv_id, m.turn, m.role, trim(coalesce(body, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, CASE WHEN reply_to > -9223372036854775808 THEN reply_to END AS reply_to, coalesce(n_quoted, 0) AS n_quoted, coalesce(n_linked, 0) AS n_linked,
  CAST(coalesce(depth, 0) AS INTEGER) AS depth, row_number() OVER (PARTITION BY m.conv_id ORDER BY coalesce(root, t), t, m.role NULLS FIRST, m.text NULLS FIRST) AS position
FROM m LEFT JOIN links USING (k) LEFT JOIN body USING (k) LEFT JOIN root ON root.c = coalesce(CAST(m.conv_id AS VARCHAR), chr(0)) AND root.n = m.t
"""


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.join(table(spark, sf_dir, "documents"), size=4, num=85, den=100)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP6_SQL = r"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)
  UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
often AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
s2 AS (SELECT s.* FROM s SEMI JOIN often USING (k)),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s2 a JOIN s2 b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY ALL
"""


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(quality.ledger(table(spark, sf_dir, "documents")))
    base = F.col("failures").bitwiseAND(F.lit(quality.mask("base"))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failures")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
lin AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
    len(regexp_extract_all(t, '!!')) AS n_bangs, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lin USING (doc_id)),
f AS (
  SELECT *, CAST(CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_bangs > 30 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words OR word_chars > 30 * n_words THEN 32 ELSE 0 END AS INTEGER) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, (failures & 47) = 0 AS kept, failures FROM f
"""

#: Production parameters of op9: the shards' names.
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.place(table(spark, sf_dir, "documents"), SHARDS, "doc_id", "text").select("doc_id", "slot", "shard")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, pieces.load(), verify=True).select("doc_id", F.size("ids").alias("n_pieces"), "ids", "round_trip")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in pii.KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE
bits(k, c, step) AS (SELECT k, CAST(k AS BIGINT), 0 FROM range(256) r(k) UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY k) AS t FROM bits WHERE step = 8),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\xC0-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(id || run, ''), lambda x:
    CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + (unicode(x) & 63) AS BIGINT)] END))), lambda a, b: xor(a >> 8, crc.t[CAST(xor(a & 255, b) + 1 AS INTEGER)]))) AS h
  FROM each, crc),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, i, word[1:i - 1] || chr(0) || word[i + 1:] AS hole, word[1:i - 1] || word[i + 1:] AS short FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT less.word, words.word, words.n FROM less JOIN words ON words.word = less.short
  UNION SELECT words.word, less.word, less.n FROM less JOIN words ON words.word = less.short),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS near, max(n) AS near_n FROM pairs GROUP BY word),
found AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
walk(word, last, step) AS (SELECT word, word, 0 FROM found UNION ALL SELECT walk.word, found.form, step + 1 FROM walk JOIN found ON found.word = walk.last WHERE found.form IS NOT NULL),
ends AS (SELECT word, arg_max(last, step) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM found JOIN ends USING (word)
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH RECURSIVE
f(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
p(o, step, before, own) AS (SELECT f, 1, 0, bit FROM f UNION ALL SELECT o || f, step + 1, before | own, bit FROM p, f WHERE (before | own) & bit = 0),
steps AS (SELECT whole.o AS filter_order, p.step, p.before, p.own FROM p JOIN (SELECT o FROM p WHERE step = 5) whole ON starts_with(whole.o, p.o)),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
bits AS (
  SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS bits
  FROM d JOIN firsts USING (t)),
l AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic FROM labels GROUP BY doc_id),
n AS (SELECT part, bits, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM bits LEFT JOIN l USING (doc_id) GROUP BY ALL),
c AS (
  SELECT part, filter_order, step, own,
    CAST(sum(CASE WHEN bits & (before | own) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN bits & before = 0 AND bits & own <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN bits & before <> 0 AND bits & own <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN bits = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN bits & before = 0 AND bits & own <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN bits & before = 0 AND bits & own <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM n, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM c
"""


QUERIES: dict[str, Query] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_url_filters": op2_url_filters,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_html_extraction": op7_html_extraction,
    "op8_quality_rules": op8_quality_rules,
    "op9_sharding": op9_sharding,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_personal_data": op11_personal_data,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_filter_audit": op13_filter_audit,
}
SQL: dict[str, str] = {
    "op2_url_filters": OP2_SQL,
    "op3_benchmark_decontamination": OP3_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op5_chat_formatting": OP5_SQL,
    "op6_ngram_jaccard_join": OP6_SQL,
    "op8_quality_rules": OP8_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
