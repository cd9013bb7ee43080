"""URL filters with redirect equivalence.

Rules decide what they fit. Pages and the addresses they point to by a canonical link or an immediate refresh are nodes
of a graph whose connected components are sets of aliases (every such link of a page counts, relative ones and character
references are resolved): an address without a rule of its own takes the decision of
its aliases, an explicit allow of any alias going before every block. All of it is DataFrame operations.

Results for odd input: a null url, or one without ``://``, has an empty host and path, fits no rule and has no alias;
null html has no edges; repeated rows give repeated results; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, discard, materialise, table, without_prefix
from lodestone.llm.components import connected_components

#: (verdict, rule): the part up to the first slash is the host, the rest the path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_CANONICAL = r"""(?i)<link\s(?=[^>]*rel\s*=\s*["']?canonical)[^>]*?href\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?i)<meta\s(?=[^>]*http-equiv\s*=\s*["']?refresh)[^>]*?content\s*=\s*["']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none fits. Of equally long ones an allow goes first."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow", r[1])):
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments; one that ends with such a segment ends with a slash."""
    segments = F.split(path, "/")
    kept = F.aggregate(
        F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), F.lit(""),
        lambda held, x: F.when(x == ".", held).when(x == "..", F.regexp_replace(held, "/[^/]*$", "")).otherwise(F.concat(held, F.lit("/"), x)),
    )
    ended = F.concat(kept, F.when(F.element_at(segments, -1).isin(".", ".."), "/").otherwise(""))
    return F.when(path.startswith("/") & path.contains("/."), ended).otherwise(path)


def query_of(url: Column) -> Column:
    """From the question mark of an address, that included, up to its fragment; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*[^?#]*([^#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """An address without scheme, fragment and dot segments, its host lower-cased: the name of a graph node. Null where there is none."""
    path = without_dots(path_of(url))
    return F.when(url.contains("://"), F.concat(host_of(url), F.when(path == "", "/").otherwise(path), query_of(url)))


def unescaped(link: Column) -> Column:
    """An attribute's value with its character references as letters: numbers, and the names that markup itself needs."""

    def letter(part: Column) -> Column:
        hexed, number = F.regexp_extract(part, "^[xX]([0-9A-Fa-f]{1,6});?", 1), F.regexp_extract(part, "^([0-9]{1,7});?", 1)
        code = F.when(hexed != "", F.conv(hexed, 16, 10).cast("int")).when(number != "", number.cast("int"))
        good = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        made = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(good, F.concat(made, F.regexp_replace(part, "^([xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});?", ""))).otherwise(F.concat(F.lit("&#"), part))

    parts = F.split(link, "&#")
    numbered = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), letter), ""))
    out = F.when(link.contains("&#"), numbered).otherwise(link)
    for name, text in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):  # the ampersand last: each is read once
        out = F.replace(out, F.lit(f"&{name};"), F.lit(text))
    return out


def joined(link: Column, base: Column) -> Column:
    """A link of a page as an address: absolute, from the scheme, from the host, a query, or relative to the page's folder; null for others."""
    scheme = F.regexp_extract(base, "^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_replace(path_of(base), "[^/]*$", "")
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, path_of(base), link))
        .when(link.startswith("#") | link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )


def plain(url: Column) -> Column:
    """An address without dot segments and fragment."""
    return F.concat(F.regexp_extract(url, "^(.*?://[^/?#]*)", 1), without_dots(path_of(url)), query_of(url))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row (from_url, to_url) for each canonical link and each refresh of a page to another address."""
    page, body = F.col(f"`{url}`"), F.col(f"`{html}`")
    links = F.concat(F.regexp_extract_all(body, F.lit(_CANONICAL), 1), F.regexp_extract_all(body, F.lit(_REFRESH), 1))
    wanted = pages.where(page.contains("://") & (F.contains(F.lower(body), F.lit("canonical")) | F.contains(F.lower(body), F.lit("refresh"))))
    found = wanted.select(page.alias("from_url"), F.explode(links).alias("link")).where("link <> ''")
    whole = found.withColumn("link", unescaped(F.col("link"))).withColumn("to_url", joined(F.col("link"), F.col("from_url")))
    return whole.select("from_url", plain(F.col("to_url")).alias("to_url")).where(F.col("to_url").isNotNull())


def alias_decisions(edges: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(node, decision, alias_of) for every address that has an alias; decision is allow, block or null.

    ``edges``: from_url, to_url. Members count by what the rules say of them, pages of the table or not.
    """
    kept = materialise(edges, "alias-edges")
    try:
        both = kept.select(F.col("from_url").alias("url")).union(kept.select("to_url"))
        _, verdict = rule_for(host_of(F.col("url")), path_of(F.col("url")), rules)
        nodes = both.select(node_of(F.col("url")).alias("node"), verdict.alias("own")).distinct()
        parts = connected_components(kept.select(node_of(F.col("from_url")).alias("src"), node_of(F.col("to_url")).alias("dst")))
        # 'allow' < 'block': the minimum is the precedence
        told = nodes.join(parts, "node").groupBy("component").agg(F.min("own").alias("decision"))
        return materialise(parts.join(told, "component").select("node", "decision", F.col("component").alias("alias_of")), "alias-decisions")
    finally:
        discard(kept)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url: str = "url", html: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """All columns of ``pages`` and _u_host, _u_path, _u_rule, _u_verdict, _u_alias_of.

    ``redirects``: more edges (from_url, to_url), such as a crawler's redirect log.
    """
    pages = without_prefix(pages, "_u_")
    edges = alias_edges(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("from_url", "to_url").where("from_url like '%://%' and to_url like '%://%'"))
    told = alias_decisions(edges, rules)
    at = F.col(f"`{url}`")
    host, path = host_of(at), path_of(at)
    rule, own = rule_for(host, path, rules)
    judged = pages.select("*", host.alias("_u_host"), path.alias("_u_path"), rule.alias("_u_rule"), own.alias("_u_own"), node_of(at).alias("_u_node"))
    told = told.select(F.col("node").alias("_u_node"), F.col("decision").alias("_u_decision"), F.col("alias_of").alias("_u_alias_of"))
    out = judged.join(told, "_u_node", "left").withColumn("_u_verdict", F.coalesce("_u_own", "_u_decision", F.lit("allow")))
    return out.drop("_u_node", "_u_own", "_u_decision")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    judged = judge(pages)
    return judged.select("page_id", F.col("_u_host").alias("host"), F.col("_u_path").alias("path"), F.col("_u_rule").alias("rule"), F.col("_u_verdict").alias("verdict"))
