"""URL filter whose block decisions reach the aliases of a page.

An address is host and path in their normal form: without the scheme's own port, dot segments resolved, an empty
path being /. Rules fit a host with all its subdomains and a path prefix, read in a page's url as it is written;
the longest rule decides. All redirects (refresh) and canonical links of a page join addresses into components, and an
address without a rule of its own is blocked when any alias is blocked by rule. An explicit rule, allow
or block, always stands before what aliases bring in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismcat.llm.common import lower_ascii, numbered
from prismcat.llm.components import components
from prismcat.session import materialise

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; NULL or no ://: empty."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; NULL or no ://: empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def normal_host(url: Column) -> Column:
    """Host without the port that its scheme has anyway."""
    port = F.when(url.rlike("(?i)^http://"), r":(?:80)?$").when(url.rlike("(?i)^https://"), r":(?:443)?$").otherwise(r":$")
    return F.regexp_replace(host_of(url), port, F.lit(""))


def normal_path(path: Column) -> Column:
    """Path with ``.`` and ``..`` segments resolved; empty: /. One pass over the path for each ``..`` in it."""
    ended = F.concat(path, F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))
    plain = F.regexp_replace(ended, r"/(?:\./)+", "/")
    up = r"/(?!\.\./)[^/]*/\.\.(?=/)"
    left = F.aggregate(F.array_repeat(F.lit(0), F.regexp_count(plain, F.lit(r"/\.\.(?=/)"))), plain, lambda p, _: F.regexp_replace(p, up, ""))
    return F.when(path == "", "/").when(path.contains("/."), F.regexp_replace(left, r"^(?:/\.\.)+(?=/)", "")).otherwise(path)


def _targets(url: Column, html: Column) -> Column:
    """Addresses that a page names as its canonical forms or redirects to, relative ones resolved, in their normal form."""
    host, path = normal_host(F.coalesce(url, F.lit(""))), path_of(url)

    def address(link: Column) -> Column:
        bare = F.regexp_extract(link, r"^[^?#]*", 0)
        scheme = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]*:", 0)
        whole = F.when(bare.startswith("//"), F.concat(scheme, link)).otherwise(link)
        folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", "")
        return (
            F.when(bare == "", F.lit(None))
            .when(whole.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.concat(normal_host(whole), normal_path(path_of(whole))))
            .when(bare.startswith("/"), F.concat(host, normal_path(bare)))
            .otherwise(F.concat(host, normal_path(F.concat(folder, bare))))
        )

    html = F.coalesce(html, F.lit(""))
    links = F.concat(F.regexp_extract_all(html, F.lit(_CANONICAL), F.lit(1)), F.regexp_extract_all(html, F.lit(_REFRESH), F.lit(1)))
    return F.filter(F.transform(links, address), lambda a: a.isNotNull())


def decide(addresses: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Longest fitting rule per ``key`` of ``addresses`` (key, host, path): ``rule``, ``action``; rows without one are left out.

    Each host is joined by its suffixes, so any number of rules is one equi-join; equal length goes to allow.
    """
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    asked = addresses.select(key, "path", F.explode(suffixes).alias("rule_host"))
    fit = asked.join(rules, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = fit.groupBy(key).agg(F.max(F.struct(F.length(rule).alias("n"), (F.col("action") == "allow").alias("allows"), rule.alias("rule"), "action")).alias("top"))
    return best.select(key, "top.rule", "top.action")


def url_filter(
    pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """One row per row of ``pages``: id, ``host``, ``path``, ``rule``, ``verdict`` and whether an alias brought it (``by_alias``).

    ``rules`` are (allow or block, host, path). Pages that no rule fits are allowed unless an alias is
    blocked by rule. NULL and malformed urls have empty host and path, no alias, and are allowed.
    Repeated rows are judged alike; other columns don't matter; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    rule_table = spark.createDataFrame([(a, h, p) for a, h, p in rules], "action string, rule_host string, rule_path string")
    url, html = F.col(url_col), F.col(html_col)
    known = numbered(
        pages.select(
            F.col(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"),
            F.concat(normal_host(F.coalesce(url, F.lit(""))), normal_path(path_of(url))).alias("address"), _targets(url, html).alias("targets"),
        ),
        "url-pages",
    )
    judged = materialise(known.drop("targets").join(decide(known, rule_table, "_row"), "_row", "left"), "url-judged")
    links = known.filter("host != ''").select(F.col("address").alias("a"), F.explode("targets").alias("b")).filter("a != b")
    aliases = materialise(components(links), "url-aliases")
    parts = aliases.select("node", "component", F.regexp_extract("node", "^[^/]*", 0).alias("host"))
    parts = parts.withColumn("path", F.expr("substring(node, length(host) + 1)"))
    blocked = parts.join(decide(parts, rule_table, "node"), "node").filter("action = 'block'").select("component").distinct()
    reached = materialise(aliases.join(blocked, "component").select(F.col("node").alias("address")), "url-blocked")
    out = judged.join(reached.withColumn("by_alias", F.lit(True)), "address", "left")
    by_alias = F.col("rule").isNull() & F.coalesce("by_alias", F.lit(False))
    return out.select(
        F.col("_id").alias(id_col), "host", "path", "rule",
        F.when(F.col("rule").isNotNull(), F.col("action")).when(by_alias, "block").otherwise("allow").alias("verdict"),
        by_alias.alias("by_alias"),
    )
