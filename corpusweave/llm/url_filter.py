"""URL filters with redirect equivalence.

A rule blocks or allows a host with all its subdomains from a path prefix on; of the rules that fit, the
longest wins, and of equally long ones the one that allows.  Redirects and canonical links make URLs aliases: connected
components over these edges carry a block to every alias without a rule of its own, unless some alias of the
component is explicitly allowed.  DataFrame functions only.

Defined results: a null url or one without ``://`` has an empty host and path, no rule and no alias, and is
allowed; repeated rows give equal results; null html has no link; relative links are
resolved against the page's URL, or against its first base tag with an address, and lose their dot segments;
absolute ones stay as they are; links of schemes without ``://``, and links to the page itself, are no edges;
tags in comments, scripts and other elements without markup are none;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, staged

# The rules of the contract, as (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SCHEME = r"\A[A-Za-z][A-Za-z0-9+.-]*:"


def _host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*+)", 1), F.lit("")), _UPPER, _LOWER)


def _path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*+([^?#]*+)", 1), F.lit(""))


def _decide(df: DataFrame, rules: tuple) -> DataFrame:
    """Adds ``rule`` and ``decision`` of the rule that wins, null where none fits, from ``host`` and ``path``.

    The rules are a parameter of bounded length; each is a test of two short strings."""
    rule = decision = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, decision = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(decision)
    return df.withColumns({"rule": rule, "decision": decision})


def _node(url: Column) -> Column:
    """What the URL names: without its fragment, scheme and host in lower case."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*", "")
    scheme = F.lower(F.regexp_extract(bare, r"(?s)\A(.*?)://", 1))
    rest = F.regexp_extract(bare, r"(?s)\A.*?://[^/?#]*+(.*)", 1)
    return F.concat(scheme, F.lit("://"), _host(url), F.when(rest == "", F.lit("/")).otherwise(rest))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")


_NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}
_NUMBER = r"&#(x[0-9A-Fa-f]{1,6}|X[0-9A-Fa-f]{1,6}|[0-9]{1,7});?"


def _decoded(text: Column) -> Column:
    """The text with its numeric references and those of _NAMED, which are all that a URL needs, as characters."""
    digits = F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(1))
    code = lambda d: F.when(F.lower(d).startswith("x"), F.conv(F.substring(d, 2, 6), 16, 10)).otherwise(d).cast("int")
    valid = lambda n: F.when((n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF), n).otherwise(0xFFFD)
    char = lambda d: F.decode(F.unhex(F.lpad(F.hex(valid(code(d)).cast("long")), 8, "0")), "UTF-32")
    parts = F.zip_with(F.split(text, _NUMBER, -1), F.concat(F.transform(digits, char), F.array(F.lit(""))), lambda x, y: F.concat(x, y))
    out = F.when(text.contains("&#"), F.array_join(parts, "")).otherwise(text)
    for name, value in _NAMED.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(value))
    return F.when(text.contains("&"), out).otherwise(text)


def _attribute(tag: Column, name: str) -> Column:
    raw = F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return _stripped(_decoded(F.regexp_replace(raw, r"""\A["']|["']\z""", "")))


def _merged(path: Column) -> Column:
    """A path from the root without its dot segments."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("/"), F.array_join(F.concat(kept, ends), "/"))


def _resolved(target: Column, base: Column) -> Column:
    """The URL that ``target`` names in a page whose URL is ``base``."""
    root = F.regexp_extract(base, r"(?s)\A(.*?://[^/?#]*+)", 1)
    path = F.regexp_extract(target, r"(?s)\A([^?#]*+)", 1)
    rest = F.regexp_extract(target, r"(?s)\A[^?#]*+(.*)", 1)
    folder = F.regexp_extract(_path(base), r"(?s)\A(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(target.rlike(_SCHEME), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)\A(.*?:)//", 1), target))
        .when((target == "") | target.startswith("#"), base)
        .when(target.startswith("?"), F.concat(root, _path(base), target))
        .otherwise(F.concat(root, _merged(F.when(target.startswith("/"), path).otherwise(F.concat(folder, path))), rest))
    )


# comments, and elements in which a tag is no tag; each is passed over once, so the time grows with the page
_INERT = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea|title|noscript)\b[^>]*+>.*?(?:</\1\s*+>|\z)"


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target) of the canonical links and the redirects by refresh in ``pages`` (url, html)."""
    some = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv") & F.col("url").contains("://"))
    some = some.select("url", F.regexp_replace("html", _INERT, " ").alias("html"))
    tags = F.regexp_extract_all("html", F.lit(r"(?i)<(?:link|meta|base)\b[^>]*+>"), F.lit(0))
    rows = some.select("url", tags.alias("tags"))
    is_base = lambda t: t.rlike(r"(?i)\A<base")
    named = F.filter(F.transform(F.filter("tags", is_base), lambda t: _attribute(t, "href")), lambda x: x != "")
    marked = F.filter("tags", lambda t: t.rlike(r"""(?i)[\s"'/]rel\s*=\s*["']?[^"'>]*\bcanonical\b|[\s"'/]http-equiv\s*=\s*["']?refresh"""))
    rows = rows.select("url", F.coalesce(F.get(named, F.lit(0)), F.lit("")).alias("base"), F.explode(marked).alias("tag"))
    refresh = F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?i)url\s*=\s*[\"']?([^\"']+)", 1)
    target = F.when(F.col("tag").rlike(r"(?i)\A<link"), _attribute(F.col("tag"), "href")).otherwise(_stripped(refresh))
    links = staged(rows.select("url", "base", target.alias("target")), "tags")
    names_page = (F.col("target") != "") & ~F.col("target").startswith("#") & (F.col("target").rlike(_SCHEME + "//") | ~F.col("target").rlike(_SCHEME))
    links = links.where(names_page).select("url", "target", F.when(F.col("base") == "", F.col("url")).otherwise(_resolved(F.col("base"), F.col("url"))).alias("base"))
    return links.select("url", _resolved(F.col("target"), F.col("base")).alias("target")).where(F.col("target").contains("://"))


def judge(pages: DataFrame, rules: tuple = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) of every row of ``pages`` (page_id, url, html).

    ``redirects``: optional further edges (url, target), for instance of a crawler's log."""
    links = page_links(pages.select("url", "html"))
    if redirects is not None:
        links = links.unionByName(redirects.select("url", "target").where("url is not null and target is not null"))
    edges = staged(links.distinct(), "links")
    decided = _decide(pages.select("page_id", "url", _host(F.col("url")).alias("host"), _path(F.col("url")).alias("path")), rules)
    if edges.isEmpty():
        return decided.select("page_id", "url", "host", "path", "rule", F.coalesce("decision", F.lit("allow")).alias("verdict"))
    classes = connected_components(edges.select(_node(F.col("url")).alias("a"), _node(F.col("target")).alias("b")))
    known = edges.select("url").unionByName(edges.select(F.col("target").alias("url"))).distinct()
    known = _decide(known.select("url", _host(F.col("url")).alias("host"), _path(F.col("url")).alias("path")), rules)
    per = (
        known.where("decision is not null")
        .select(_node(F.col("url")).alias("node"), "decision")
        .join(classes, "node")
        .groupBy("component")
        .agg((F.bool_or(F.col("decision") == "block") & ~F.bool_or(F.col("decision") == "allow")).alias("blocked"))
    )
    # staged, so that the join can split a component of many URLs
    per = staged(per.where("blocked"), "blocked")
    blocked = classes.join(per, "component").select(F.col("node").alias("_node"), F.lit(True).alias("blocked"))
    free = F.col("decision").isNull() & F.col("url").contains("://")
    # rows that need no component get keys of their own, which lie on all partitions and equal no URL
    own = F.concat(F.lit("#"), F.xxhash64("page_id", "url").cast("string"))
    out = decided.withColumn("_key", F.when(free, _node(F.col("url"))).otherwise(own)).join(blocked, F.col("_key") == F.col("_node"), "left")
    verdict = F.coalesce("decision", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"))
