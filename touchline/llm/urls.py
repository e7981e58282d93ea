"""URL filters with redirect equivalence: urls joined by redirects and canonical links share their block decisions.

Edges come from the pages' own canonical links and refresh redirects (all of a page's, resolved against its url or its base),
read tag by tag: comments are cut out, a tag's attributes are split into names and values, the first of a name counts, rel is
a list of tokens, character references (numeric and the five of XML) are decoded, and a refresh needs no url=. Others come from
the redirects that sites apply to spellings of one address (scheme, www. and m. hosts, fragment, query, index suffix,
trailing slash), of pages and of link targets alike. Components of these edges are found on the cluster; an explicit allow
anywhere in a component outweighs every block in it.

A null url or one without :// has an empty host and path, no rule and no edge, and is allowed. Repeated pages are judged
alike. Null html has no links. An empty table gives an empty result. Other columns are ignored. Of rules of equal length
one url fits at most one. Long texts are searched in their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, let, materialise, table
from .graph import connected_components

#: Verdict, host, path.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
MOST_RULES = 1000


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules are compiled into one expression")
    found = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))]
    return F.coalesce(*found)


def settled(url: Column) -> Column:
    """Where a site's usual redirects take a spelling of a url; null without ://."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.(?=[^.]+\.[^.]+)", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(?:index)?\.html?$", ""), r"/+$", "")
    return F.when(url.contains("://"), F.concat(F.lit("https://"), host, path))


def without_dots(path: Column) -> Column:
    """An absolute path without its . and .. segments."""
    parts = F.split(path, "/", -1)
    step = lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.lit(1), F.size(a) - 1))).when(x == ".", a).otherwise(F.concat(a, F.array(x)))
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.aggregate(parts, F.array().cast("array<string>"), step), ends), "/")


#: How HTML writes comments, tags with quoted attributes, attributes, and character references.
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
TAG = r"""(?is)<(?:link|meta|base)\b(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+>"""
ATTRIBUTE = r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
REFERENCE = "&(?:#[xX][0-9A-Fa-f]{1,6}|#[0-9]{1,7}|amp|lt|gt|quot|apos);"
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
REFRESH = r"""(?is)^\s*(?:[0-9.]*\s*[;,]?\s*url\s*=|[0-9.]+\s*[;,\s])\s*["']?\s*([^"'\s>]+)"""


def character(reference: Column) -> Column:
    """What a match of REFERENCE stands for; itself where that is no character."""
    inner = F.substring(reference, 2, F.length(reference) - 2)
    code = F.when(F.lower(inner).startswith("#x"), F.conv(F.substring(inner, 3, 6), 16, 10)).when(inner.startswith("#"), F.substring(inner, 2, 7)).cast("int")
    real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    named = F.element_at(F.create_map(*(F.lit(x) for kv in NAMED.items() for x in kv)), inner)
    return F.coalesce(F.when(real, F.decode(F.unhex(F.lpad(F.hex(F.when(real, code).cast("long")), 8, "0")), "UTF-32")), F.when(~inner.startswith("#"), named), reference)


def decoded(text: Column) -> Column:
    """text with its character references read once, from left to right."""
    each = F.zip_with(F.split(text, REFERENCE, -1), F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), lambda gap, r: F.concat(gap, F.coalesce(character(r), F.lit(""))))
    return F.when(text.contains("&"), F.array_join(each, "")).otherwise(text)


def resolved(url: Column, link: Column) -> Column:
    """Where a link on the page at `url` leads; null where it is empty or leads to no address with ://."""
    scheme, site = F.regexp_extract(url, r"(?s)^(.*?:)//", 1), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*", 0)
    path, rest = F.regexp_extract(link, r"^[^?#]*", 0), F.regexp_extract(link, r"(?s)[?#].*$", 0)
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(url), r"(?s)^/(.*/)", 1))
    return (
        F.when(link == "", None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(link.rlike(r"^[^:]*://"), link))
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(site, without_dots(path), rest))
        .when(link.startswith("?"), F.concat(site, path_of(url), link))
        .when(link.startswith("#"), F.concat(F.regexp_extract(url, r"(?s)^[^#]*", 0), link))
        .otherwise(F.concat(site, without_dots(F.concat(folder, path)), rest))
    )


def tags_in(html: Column) -> Column:
    """The link, meta and base tags outside comments, in order: array<struct(tag, at)>, `at` being the attributes' values by
    lower-cased name."""
    groups = lambda t, k: F.regexp_extract_all(t, F.lit(ATTRIBUTE), F.lit(k))
    one, both = lambda n, v: F.struct(F.lower(n).alias("n"), v.alias("v")), lambda x, y: F.concat(x, y)
    every = lambda t: F.zip_with(groups(t, 1), F.zip_with(F.zip_with(groups(t, 2), groups(t, 3), both), groups(t, 4), both), one)
    first = lambda xs: F.filter(xs, lambda x, i: ~F.exists(F.slice(xs, 1, i), lambda y: y["n"] == x["n"]))
    tag = lambda t: F.struct(F.lower(F.regexp_extract(t, "^<([A-Za-z]+)", 1)).alias("tag"), let(every(t), lambda xs: F.map_from_entries(first(xs))).alias("at"))
    return F.transform(F.regexp_extract_all(F.regexp_replace(html, COMMENT, ""), F.lit(TAG), F.lit(0)), tag)


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst: redirects and canonical links, as urls; and every url with its usual spelling."""
    tag = lambda x, name, key: (x["tag"] == name) & x["at"][key].isNotNull()
    canonical = lambda x: tag(x, "link", "href") & F.array_contains(F.split(F.lower(x["at"]["rel"]), r"\s+"), "canonical")
    refresh = lambda x: tag(x, "meta", "content") & (F.lower(F.btrim(x["at"]["http-equiv"])) == "refresh")
    link = lambda x: F.when(canonical(x), F.btrim(decoded(x["at"]["href"]))).when(refresh(x), F.regexp_extract(decoded(x["at"]["content"]), REFRESH, 1))
    base = lambda tags: F.btrim(decoded(F.get(F.filter(tags, lambda x: tag(x, "base", "href")), F.lit(0))["at"]["href"]))
    links = lambda tags: let(base(tags), lambda b: F.transform(F.filter(F.transform(tags, link), lambda x: x.isNotNull()), lambda x: F.struct(b.alias("base"), x.alias("link"))))
    found = F.when(F.lower(html).rlike("canonical|refresh"), let(tags_in(F.col(html)), links))
    mine = pages.where(F.col(url).contains("://")).select(F.col(url).alias("src"), F.explode_outer(found).alias("e")).select("src", "e.*")
    at = let(resolved(F.col("src"), F.col("base")), lambda b: F.when(b.contains("://"), b).otherwise(F.col("src")))
    mine = mine.select("src", let(let(at, lambda a: resolved(a, F.col("link"))), lambda x: F.when(x.contains("://"), x)).alias("dst"))
    return with_spellings(mine)


def with_spellings(links: DataFrame) -> DataFrame:
    """The links, and an edge from each of their ends to its usual spelling; a null dst is no link."""
    ends = lambda c: F.struct(F.col(c).alias("src"), settled(F.col(c)).alias("dst"))
    edges = links.select(F.explode(F.array(F.struct("src", "dst"), ends("src"), ends("dst"))).alias("e")).select("e.*")
    return edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))


def filter_urls(pages: DataFrame, id_col: str = "page_id", rules=RULES, edges: DataFrame | None = None) -> DataFrame:
    """id, host, path, rule, verdict and component_size of every page. `edges` (src, dst) are further links between urls."""
    node = lambda c: F.unhex(F.md5(c))
    links = link_edges(pages) if edges is None else link_edges(pages).unionByName(with_spellings(edges.select("src", "dst")))
    links = materialise(links.distinct(), "links")
    parts = connected_components(links.select(node(F.col("src")).alias("a"), node(F.col("dst")).alias("b")), "a", "b")
    ruled = links.select(F.explode(F.array("src", "dst")).alias("url")).distinct().select(node(F.col("url")).alias("node"), rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("v"))
    parts = materialise(parts.join(ruled, "node", "left"), "parts")
    votes = parts.groupBy("root").agg(F.max((F.col("v") == "allow").cast("int")).alias("allowed"), F.max((F.col("v") == "block").cast("int")).alias("blocked"), F.count("*").alias("component_size"))
    votes = votes.select("root", "component_size", F.when(F.coalesce("allowed", F.lit(0)) == 1, "allow").when(F.coalesce("blocked", F.lit(0)) == 1, "block").otherwise("allow").alias("shared"))
    voted = parts.select("node", "root").join(votes, "root").select("node", "shared", "component_size")
    url = F.col("url")
    own = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), node(url).alias("node"), rule_of(host_of(url), path_of(url), rules).alias("r"))
    out = own.join(voted, "node", "left")
    return out.select(id_col, "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "shared", F.lit("allow")).alias("verdict"), F.coalesce("component_size", F.lit(1)).cast("long").alias("component_size"))


def op7_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
