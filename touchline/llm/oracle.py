"""DuckDB SQL of the corpus queries that SQL can express, written from their contracts.

The others (toxicity, language models, near duplicates, language profiles, token files, PII terms) learn, iterate
or hash; the tests hold them against brute force, round trips or held-out labels.
"""

from __future__ import annotations

from .quality import FENCE, MIN_GROUP, WIDTH, Z
from .urls import ATTRIBUTE, NAMED, REFERENCE, REFRESH

_BIN = "CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) + 32 * (length(bin(v)) - 6) END"
_EDGE = "CASE WHEN b < 64 THEN b ELSE (b - 32 * (b // 32 - 1)) << (b // 32 - 1) END"


def _quartiles(keys: str) -> str:
    by = f"{keys}, " if keys else ""
    return f"""SELECT {by}metric, min(CASE WHEN 4 * upto >= total THEN edge END) AS q1, min(CASE WHEN 4 * upto >= 3 * total THEN edge END) AS q3, max(total) AS size FROM
 (SELECT *, {_EDGE} AS edge, sum(n) OVER (PARTITION BY {by}metric ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {by}metric) AS total FROM (SELECT {by}metric, b, count(*) AS n FROM bins GROUP BY ALL)) GROUP BY ALL"""


_WIDTH = " ".join(f"WHEN '{m}' THEN {s}" for m, s in WIDTH.items())


def _evident(k: str, n: str) -> str:
    """The lower end of Wilson's interval, per 10 000."""
    k, n, z = f"CAST({k} AS DOUBLE)", f"CAST({n} AS DOUBLE)", f"CAST({Z} AS DOUBLE)"
    p, a = f"least(1e0, {k} / {n})", f"({z} * {z} / {n})"
    return f"CASE WHEN {n} > 0 THEN CAST(floor(10000e0 * greatest(0e0, ({p} + {a} / 2e0 - {z} * sqrt({p} * (1e0 - {p}) / {n} + {a} / (4e0 * {n}))) / (1e0 + {a}))) AS BIGINT) ELSE 0 END"



QUALITY = f"""WITH d AS (SELECT row_number() OVER () AS rn, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
gr AS (SELECT rn, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT rn, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT rn, count(DISTINCT i + j) AS n FROM (SELECT *, count(*) OVER (PARTITION BY rn, g) AS c FROM gr), (SELECT unnest(range(8)) AS j) WHERE c > 1 GROUP BY rn),
li AS (SELECT rn, count(*) AS n, count(DISTINCT l) AS k FROM (SELECT rn, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY rn),
m AS (SELECT d.rn, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(array_to_string(w, '')) - length(regexp_replace(array_to_string(w, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
 coalesce(li.n, 0) AS n_lines, coalesce(li.n - li.k, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN li ON li.rn = d.rn LEFT JOIN rep ON rep.rn = d.rn),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
v AS (SELECT rn, lang, source, base_failed, unnest(['symbols', 'dup_lines', 'repeats', 'word_chars']) AS metric, unnest([{_evident("n_symbols", "word_chars")}, {_evident("n_dup_lines", "n_lines")}, {_evident("(n_repeat_words / 8e0)", "(n_words / 8e0)")}, CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END]) AS v FROM f),
bins AS (SELECT lang, source, metric, {_BIN} AS b FROM v WHERE NOT base_failed),
own AS ({_quartiles("lang, source")}), la AS ({_quartiles("lang")}), ev AS ({_quartiles("")}),
q AS (SELECT own.lang, own.source, own.metric, CASE WHEN own.size >= {MIN_GROUP} THEN own.q1 WHEN la.size >= {MIN_GROUP} THEN la.q1 ELSE ev.q1 END AS q1, CASE WHEN own.size >= {MIN_GROUP} THEN own.q3 WHEN la.size >= {MIN_GROUP} THEN la.q3 ELSE ev.q3 END AS q3
 FROM own JOIN la ON own.lang IS NOT DISTINCT FROM la.lang AND own.metric = la.metric JOIN ev ON own.metric = ev.metric),
bo AS (SELECT *, q1 - {FENCE} * (q3 - q1) - CASE metric {_WIDTH} END AS lo, q3 + {FENCE} * (q3 - q1) + CASE metric {_WIDTH} END AS hi FROM q),
bad AS (SELECT rn, bool_or(v.v > hi OR (v.metric = 'word_chars' AND v.v < lo)) AS bad FROM v JOIN bo ON v.lang IS NOT DISTINCT FROM bo.lang AND v.source IS NOT DISTINCT FROM bo.source AND v.metric = bo.metric GROUP BY rn)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(bad, false) AS kept FROM f LEFT JOIN bad USING (rn)"""

_HOST = "translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_RULES = "(VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) r(verdict, h, p)"
_SETTLED = f"CASE WHEN contains({{u}}, '://') THEN 'https://' || regexp_replace({_HOST}, '^(?:www|m)\\.([^.]+\\.[^.]+)', '\\1') || regexp_replace(regexp_replace({_PATH}, '(?:index)?\\.html?$', ''), '/+$', '') END"
_TAG = """(?is)<(?:link|meta|base)\\b(?:[^>"\'\']+|"[^"]*"|\'\'[^\'\']*\'\'|["\'\'])*>"""
_ATTRIBUTE = ATTRIBUTE.replace("'", "''")
_VALUE = "values_[list_position(names, '{a}')]"


def _decoded(text: str) -> str:
    """Character references read once, as the operator reads them."""
    code = "CASE WHEN starts_with(lower(r), '&#x') THEN CAST('0x' || r[4 : -2] AS INTEGER) WHEN starts_with(r, '&#') THEN CAST(r[3 : -2] AS INTEGER) END"
    named = " ".join(f"WHEN '&{n};' THEN '{c.replace(chr(39), chr(39) * 2)}'" for n, c in NAMED.items())
    one = f"CASE WHEN {code} BETWEEN 1 AND 1114111 AND NOT ({code} BETWEEN 55296 AND 57343) THEN chr({code}) ELSE CASE r {named} ELSE r END END"
    refs, gaps = f"regexp_extract_all({text}, '{REFERENCE}')", f"regexp_split_to_array({text}, '{REFERENCE}')"
    return f"array_to_string(list_transform(range(1, len({gaps}) + 1), lambda i: {gaps}[i] || coalesce(list_transform({refs}, lambda r: {one})[i], '')), '')"


_REFRESH = REFRESH.replace("'", "''")
_FOUND = f"""SELECT rn, url, tag, {_decoded(_VALUE.format(a="href"))} AS href, CASE WHEN tag = 'link' AND list_contains(regexp_split_to_array(lower({_VALUE.format(a="rel")}), '\\s+'), 'canonical') THEN trim({_decoded(_VALUE.format(a="href"))})
 WHEN tag = 'meta' AND lower(trim({_VALUE.format(a="http-equiv")})) = 'refresh' THEN regexp_extract({_decoded(_VALUE.format(a="content"))}, '{_REFRESH}', 1) END AS link, i
 FROM (SELECT rn, url, i, lower(regexp_extract(t, '^<([A-Za-z]+)', 1)) AS tag, list_transform(regexp_extract_all(t, '{_ATTRIBUTE}', 1), lambda x: lower(x)) AS names,
  list_transform(regexp_extract_all(t, '{_ATTRIBUTE}', 0), lambda x: coalesce(regexp_extract(x, '^{_ATTRIBUTE}', 2), '') || coalesce(regexp_extract(x, '^{_ATTRIBUTE}', 3), '') || coalesce(regexp_extract(x, '^{_ATTRIBUTE}', 4), '')) AS values_
  FROM (SELECT rn, url, unnest(tags) AS t, generate_subscripts(tags, 1) AS i FROM (SELECT rn, url, regexp_extract_all(regexp_replace(html, '(?s)<!--.*?(?:-->|\\z)', '', 'g'), '{_TAG}') AS tags FROM u WHERE contains(url, '://'))))"""


def _resolved(site_of: str, link: str) -> str:
    site = f"regexp_extract({site_of}, '(?s)^.*?://[^/?#]*')"
    return f"""CASE WHEN {link} = '' THEN NULL WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {link} WHEN starts_with({link}, '//') THEN regexp_extract({site_of}, '(?s)^(.*?:)//', 1) || {link} WHEN starts_with({link}, '/') THEN {site} || {link}
 WHEN starts_with({link}, '?') THEN {site} || {_PATH.format(u=site_of)} || {link} WHEN starts_with({link}, '#') THEN regexp_extract({site_of}, '(?s)^[^#]*') || {link} ELSE {site} || '/' || regexp_extract({_PATH.format(u=site_of)}, '(?s)^/(.*/)', 1) || {link} END"""


#: Links are resolved as the operator does, but for . and .. segments; a component is what recursion reaches.
URLS = f"""WITH RECURSIVE u AS (SELECT row_number() OVER () AS rn, page_id, coalesce(url, '') AS url, html FROM pages),
p AS (SELECT *, {_HOST.format(u="url")} AS host, {_PATH.format(u="url")} AS path FROM u),
fo AS ({_FOUND}),
ba AS (SELECT rn, first({_resolved("url", "trim(href)")} ORDER BY i) AS base FROM fo WHERE tag = 'base' AND href IS NOT NULL GROUP BY rn),
l0 AS (SELECT fo.url, link, CASE WHEN contains(base, '://') THEN base ELSE fo.url END AS at_ FROM fo LEFT JOIN ba USING (rn)),
l1 AS (SELECT url, {_resolved("at_", "link")} AS dst FROM l0),
ln AS (SELECT url, dst FROM l1 WHERE contains(dst, '://')),
en AS (SELECT url FROM u WHERE contains(url, '://') UNION SELECT dst FROM ln),
e0 AS (SELECT url AS a, dst AS b FROM ln UNION SELECT url, {_SETTLED.format(u="url")} FROM en),
ed AS (SELECT a, b FROM e0 WHERE a <> b UNION SELECT b, a FROM e0 WHERE a <> b),
re AS (SELECT a AS root, a AS at_ FROM ed UNION SELECT root, b FROM re JOIN ed ON at_ = a),
nr AS (SELECT at_, first(verdict ORDER BY length(h || p) DESC) AS v FROM (SELECT at_, {_HOST.format(u="at_")} AS host, {_PATH.format(u="at_")} AS path FROM (SELECT DISTINCT at_ FROM re)) LEFT JOIN {_RULES} ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY at_),
c AS (SELECT root, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' ELSE 'allow' END AS shared, count(*) AS size FROM re JOIN nr USING (at_) GROUP BY root),
o AS (SELECT rn, first(h || p ORDER BY length(h || p) DESC) AS rule, first(verdict ORDER BY length(h || p) DESC) AS verdict FROM p JOIN {_RULES} ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rn)
SELECT page_id, host, path, rule, coalesce(verdict, shared, 'allow') AS verdict, CAST(coalesce(size, 1) AS BIGINT) AS component_size FROM p LEFT JOIN o USING (rn) LEFT JOIN c ON root = url"""

_TOKENS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
LEAKS = f"""WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {_TOKENS} AS t FROM documents), b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_TOKENS} AS t FROM benchmark),
w AS (SELECT DISTINCT item, words, len(words) AS n FROM (SELECT item, CASE WHEN len(t) >= 10 THEN t[i : i + 9] ELSE t END AS words FROM (SELECT item, t, unnest(range(1, greatest(2, len(t) - 8))) AS i FROM b WHERE len(t) > 0))),
aw AS (SELECT rn, i, n, t[i : i + n - 1] AS words FROM (SELECT rn, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w))),
hit AS (SELECT rn, i, w.n, item FROM aw JOIN w ON aw.n = w.n AND aw.words = w.words),
pos AS (SELECT rn, count(DISTINCT i + j) AS n_hit FROM (SELECT rn, i, unnest(range(n)) AS j FROM hit) GROUP BY rn),
its AS (SELECT rn, count(*) AS k, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rn, item FROM hit) GROUP BY rn),
tok AS (SELECT rn, unnest(t) AS term, unnest(range(len(t))) AS pos FROM d),
wn AS (SELECT row_number() OVER () AS wid, words, len(words) - len(words) // 5 AS need FROM (SELECT DISTINCT words FROM w)),
wt AS (SELECT wid, need, unnest(words) AS term, unnest(range(len(words))) AS off FROM wn),
sp AS (SELECT rn, wid, need, off, pos - off AS s FROM tok JOIN wt USING (term)),
en AS (SELECT rn, wid FROM sp GROUP BY rn, wid, need HAVING count(DISTINCT off) >= need),
nm AS (SELECT DISTINCT rn, wid FROM (SELECT rn, wid FROM (SELECT sp.*, unnest(range(-3, 4)) AS shift FROM sp JOIN en USING (rn, wid)) GROUP BY rn, wid, need, s + shift HAVING count(DISTINCT off) >= need)),
nr AS (SELECT rn, count(DISTINCT item) AS n FROM nm JOIN wn USING (wid) JOIN w USING (words) GROUP BY rn)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.k, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(nr.n, 0) AS BIGINT) AS n_near_items
FROM d LEFT JOIN pos ON pos.rn = d.rn LEFT JOIN its ON its.rn = d.rn LEFT JOIN nr ON nr.rn = d.rn"""

#: Ranks in order up to the words that are left, in one pass over each source; the operator finds the same cut by histograms.
MIX = """WITH d AS (SELECT row_number() OVER () AS rn, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [3e0, 1e0, 2e0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 2e0 * source_size AS top FROM s0),
s2 AS (SELECT *, row_number() OVER t AS turn, (1.5e0 * sum(source_size) OVER () - coalesce(sum(top) OVER (t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)) / (sum(w) OVER () - coalesce(sum(w) OVER (t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)) AS level FROM s1 WINDOW t AS (ORDER BY top / w, source NULLS LAST)),
s3 AS (SELECT *, (SELECT level FROM s2 WHERE level * w <= top ORDER BY turn LIMIT 1) AS stop FROM s2),
s4 AS (SELECT source, source_size, CASE WHEN top > 0 THEN least(top, coalesce(stop, 1e308) * w) ELSE 0e0 END AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-12) AS BIGINT) ELSE 0 END AS whole FROM s4),
s6 AS (SELECT *, greatest(0e0, target - whole * source_size) AS room FROM s5),
b0 AS (SELECT source, CASE WHEN size < 64 THEN size ELSE (size >> (length(bin(size)) - 6)) + 32 * (length(bin(size)) - 6) END AS b, CAST(sum(size) AS DOUBLE) AS s, sum(size * sqrt(size)) AS r, max(size) AS most FROM d WHERE size > 0 GROUP BY ALL),
b1 AS (SELECT b0.*, (room - coalesce(sum(s) OVER (PARTITION BY b0.source ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)) / sum(r) OVER (PARTITION BY b0.source ORDER BY b) AS c FROM b0 JOIN s6 ON b0.source IS NOT DISTINCT FROM s6.source),
b2 AS (SELECT source, max_by(c, b) AS c FROM b1 WHERE c > 0 AND c * sqrt(most) <= 1 GROUP BY source),
r0 AS (SELECT d.*, source_size, target, whole, room, coalesce(least(1e0, c * sqrt(CAST(size AS DOUBLE))), room / source_size) AS lam, (CAST(CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(size AS VARCHAR))), 1, 12) AS BIGINT) AS DOUBLE) + 0.5e0) / 281474976710656e0 AS u
 FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source LEFT JOIN b2 ON d.source IS NOT DISTINCT FROM b2.source),
r1 AS (SELECT *, CASE WHEN lam >= 1 THEN 0e0 ELSE (u / (1 - u)) / (lam / (1 - lam)) END AS odds FROM r0),
r2 AS (SELECT rn, sum(size) OVER (PARTITION BY source ORDER BY odds / (1 + odds), doc_id NULLS FIRST, size, rn ROWS UNBOUNDED PRECEDING) - size / 2e0 AS mid FROM r1 WHERE size > 0)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN (whole + CASE WHEN room > 0 AND mid <= room THEN 1 ELSE 0 END) * size ELSE 0 END AS BIGINT) AS taken FROM r1 LEFT JOIN r2 USING (rn)"""

_LOWER = "translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
COLLOCATIONS = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format(t="text")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, s, unnest(list_transform(range(1, len(w) - s + 2), lambda i: array_to_string(w[i : i + s - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS s)),
f AS (SELECT lang, s, phrase, count(*) AS c FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE s = 1 GROUP BY lang),
c AS (SELECT lang, s, phrase, c AS a, string_split(phrase, ' ') AS x FROM f WHERE s > 1 AND c >= 10),
k AS (SELECT *, unnest(range(1, s)) AS k FROM c),
v AS (SELECT k.*, l.c AS l, r.c AS r, (1000000::HUGEINT * a * a) // (l.c::HUGEINT * r.c) AS score FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(x[1 : k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(x[k + 1 :], ' ')),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase, max(a) AS around FROM (SELECT lang, a, unnest([array_to_string(x[1 : 2], ' '), array_to_string(x[2 : 3], ' ')]) AS phrase FROM c WHERE s = 3) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM b JOIN t ON t.lang = b.lang LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase AND b.s = 2 WHERE coalesce(100 * around < 50 * a, true) QUALIFY rank <= 2000"""

#: All pairs; the forest of the query finds a pair at the threshold with the recall it is built for.
VECTORS = """WITH RECURSIVE e AS (SELECT row_number() OVER () AS rn, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT * FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT x.rn AS a, y.rn AS b FROM g x JOIN g y ON x.rn <> y.rn AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
r AS (SELECT rn AS root, rn AS at_ FROM e UNION SELECT root, b FROM r JOIN l ON at_ = a),
c AS (SELECT root, min(vec_id) AS component_id FROM r JOIN e ON e.rn = at_ GROUP BY root)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = e.rn) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM e JOIN c ON c.root = e.rn"""

_TERMS = f"regexp_extract_all({_LOWER.format(t='text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
LEXICAL = f"""WITH d AS (SELECT * FROM (SELECT row_number() OVER () AS rn, doc_id, {_TERMS} AS t FROM documents) WHERE len(t) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS total FROM d),
tf AS (SELECT rn, term, count(*) AS tf FROM (SELECT rn, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, docs),
q AS (SELECT item, item_id, term, count(*) AS often FROM (SELECT item, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS t FROM benchmark)) GROUP BY ALL),
m AS (SELECT rn, doc_id, 100 - 25 + ((25 * len(t) * docs) // total) AS m FROM d, s),
z AS (SELECT item, item_id, rn, doc_id, CAST(sum(often * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN m USING (rn) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM z WHERE score > 0 QUALIFY rank <= 20"""

ORACLE_SQL = {"op5_quality_rules": QUALITY, "op7_url_filter": URLS, "op8_mix_sources": MIX, "op10_decontaminate": LEAKS, "op11_collocations": COLLOCATIONS, "op12_embedding_near_dedup": VECTORS, "op13_lexical_search": LEXICAL}
