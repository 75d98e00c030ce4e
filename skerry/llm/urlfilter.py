"""URL filter with redirect equivalence.

Pages whose redirects or canonical links meet are aliases: connected components over those links
carry a block from any alias to the others. A url's own rule always holds; and where an alias is allowed by a
rule, the component's urls without a rule are allowed too, whatever else is blocked (explicit allow precedence).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\??[^#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 2), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 3), F.lit(""))


def node_of(url: Column) -> Column:
    """The url without scheme and fragment, host in lower case; null where there is no `://`."""
    query = F.regexp_extract(url, PARTS, 4)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), path_of(url), query))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def resolved(href: Column, url: Column) -> Column:
    """An absolute url for a link of a page; null for empty links and other schemes than `x://`."""
    scheme, host, path = F.regexp_extract(url, PARTS, 1), F.regexp_extract(url, PARTS, 2), path_of(url)
    base = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when((href == "") | href.isNull(), None)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(F.instr(url, "://") == 0, None)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(base, href))
        .when(href.startswith("#"), None)
        .when(href.startswith("?"), F.concat(base, path, href))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(base, folder, href))
    )


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.trim(F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)]))
    # the entities that a url needs in an attribute
    for sign, entity in (("'", "(?i)&(apos|#0*39|#x0*27);"), ('"', "(?i)&(quot|#0*34|#x0*22);"), ("/", "(?i)&(sol|#0*47|#x0*2f);"), ("&", "(?i)&(amp|#0*38|#x0*26);")):
        value = F.regexp_replace(value, entity, sign)
    return value


def alias_links(pages: DataFrame) -> DataFrame:
    """(url, to) of each canonical link and refresh redirect in the pages' html."""
    link = r"""(?is)<link\s[^>]*?rel\s*=\s*(?:"[^"]*\bcanonical\b[^"]*"|'[^']*\bcanonical\b[^']*'|canonical\b)[^>]*>"""
    refresh = r"(?is)<meta\s[^>]*?http-equiv\s*=\s*[\"']?refresh\b[^>]*>"
    # tags are only cut out of pages that hold the words at all
    some = pages.where(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)canonical|http-equiv")).select("url", "html")
    tags = some.select("url", F.explode(F.concat(F.regexp_extract_all("html", F.lit(link), F.lit(0)), F.regexp_extract_all("html", F.lit(refresh), F.lit(0)))).alias("tag"))
    target = F.when(
        F.col("tag").rlike(r"(?i)^<link"), _attribute(F.col("tag"), "href")
    ).otherwise(F.trim(F.regexp_replace(F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)url\s*=\s*(.*)$", 1), r"^['\"]|['\"]$", "")))
    found = stage(tags.select("url", target.alias("href")), "link-tags")
    return found.select("url", resolved(F.col("href"), F.col("url")).alias("to"))


def judge_urls(pages: DataFrame, redirects: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Judge the url of every page (page_id, url, html); redirects may add links (url, to), as from a crawl log.

    Returns page_id, host, path, rule, verdict and alias_of (the least url of its component; null if it has no alias). A null url or one without `://` has empty host and
    path, no rule and is allowed. Null html has no links; links that lead nowhere or to the page itself don't count.
    Repeated pages are judged each; an empty table gives an empty result; other columns of pages are not looked at.
    """
    links = stage(alias_links(pages), "alias-links")
    if redirects is not None:
        links = links.unionByName(stage(redirects.select("url", resolved(F.col("to"), F.col("url")).alias("to")), "redirects"))
    edges = links.select(node_of(F.col("url")).alias("u"), node_of(F.col("to")).alias("v"))
    members = connected_components(edges, "aliases")

    own = F.struct(F.regexp_extract("node", r"^([^/?]*)", 1).alias("h"), F.regexp_extract("node", r"^[^/?]*([^?]*)", 1).alias("p"))
    ruled = members.withColumn("_o", own).withColumn("_v", rule_of(F.col("_o.h"), F.col("_o.p"), rules)["verdict"])
    marks = ruled.groupBy("component").agg(F.max(F.col("_v") == "allow").alias("_allowed"), F.max(F.col("_v") == "block").alias("_blocked"))
    by_node = members.join(marks, "component").select("node", "component", "_allowed", "_blocked")

    out = pages.select("page_id", "url", node_of(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    out = out.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).join(by_node, "node", "left")
    spread = F.when(F.coalesce(F.col("_blocked"), F.lit(False)) & ~F.coalesce(F.col("_allowed"), F.lit(False)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(F.col("_r.verdict"), spread).alias("verdict"), F.col("component").alias("alias_of"))
