"""URL filters with redirect equivalence.

A page's own url is judged by the longest fitting rule. Urls that no rule fits take the decision
of their aliases: redirect (``<meta http-equiv=refresh>``) and canonical (``<link
rel=canonical>``) links join urls into components; a component with a blocked url blocks its
unruled members, unless one of its urls is explicitly allowed. Built-in column functions only;
the components come from ``components.connected_components``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.llm.common import Scratch, skew_join
from chatprep.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Character references of HTML, and those of 128 to 159, which are read as windows-1252.
NAMED = json.dumps({"&" + k: v for k, v in html5.items()})
LATIN = json.dumps({str(i): bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160)})


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def name(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty for null and for urls without it."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def raw_host(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)


def url_host(url: Column) -> Column:
    return F.translate(raw_host(url), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def url_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, F.lit(1), at - 1)), F.lit(""))


def decoded(text: Column) -> Column:
    """An attribute's value with its character references resolved, as HTML does in attributes."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)(&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[a-zA-Z][a-zA-Z0-9]*+(?:;|(?!=))|&|[^&]+)"), F.lit(1))
    strings = "map<string,string>"

    def piece(p: Column) -> Column:
        digits = F.regexp_extract(p, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
        hexadecimal = p.rlike("^&#[xX]")
        short = F.length(digits).between(1, 7)  # longer ones are no code points
        code = F.when(short & hexadecimal, F.conv(digits, 16, 10).cast("int")).when(short, digits.cast("int")).otherwise(0)
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        letter = F.when(code.between(128, 159), F.from_json(F.lit(LATIN), strings)[code.cast("string")]).when(
            valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
        named = F.coalesce(F.from_json(F.lit(NAMED), strings)[p], p)
        return F.when(p.rlike("^&#[xX]?[0-9a-fA-F]"), letter).when(p.startswith("&"), named).otherwise(p)

    return F.when(F.instr(text, "&") > 0, F.array_join(F.transform(pieces, piece), "")).otherwise(text)


def plain_path(path: Column) -> Column:
    """The path without ``.`` and ``..`` segments."""
    dot, two = r"(?i)^(\.|%2e)$", r"(?i)^(\.|%2e){2}$"
    parts = F.split(path, "/")

    def step(done: Column, part: Column) -> Column:
        return (F.when(part.rlike(two), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1))))
                .when(part.rlike(dot), done).otherwise(F.concat(done, F.array(part))))

    ends = F.when(path.rlike(r"(?i)/(\.|%2e){1,2}$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    kept = F.concat(F.aggregate(parts, F.array().cast("array<string>"), step), ends)
    return F.when(path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), F.array_join(kept, "/")).otherwise(path)


def url_node(url: Column) -> Column:
    """The url as a node of the alias graph: scheme and host in lower case, dot segments resolved,
    without its fragment."""
    bare = F.regexp_replace(url, "(?s)#.*$", "")
    user = F.regexp_extract(raw_host(bare), "^(.*@)?", 1)
    host = F.translate(F.regexp_extract(raw_host(bare), "([^@]*)$", 1), UPPER, LOWER)
    query = F.regexp_extract(_rest(bare), r"(?s)^[^?]*(\?.*)$", 1)
    return F.when(F.instr(bare, "://") > 0, F.concat(
        F.translate(url_scheme(bare), UPPER, LOWER), F.lit("://"), user, host, plain_path(url_path(bare)), query)).otherwise(bare)


def rule_of(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, null if none fits.

    The rules are a user's list, so they become one CASE, longest first (ties: by name).
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def link_targets(url: Column, html: Column) -> Column:
    """Absolute targets of a page's redirect and canonical links, comments and scripts aside."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<!--.*?-->", ""),
                            r"(?is)<(script|style)\b.*?</(script|style)\s*>", "")

    def tags(name: str, sign: str, target: str) -> Column:
        found = F.regexp_extract_all(body, F.lit(rf"(?is)(<{name}\b[^>]*>)"), F.lit(1))
        return F.transform(F.filter(found, lambda t: t.rlike(sign)), lambda t: F.regexp_extract(t, target, 1))

    canonical = (r"(?is)[\s\"'/]rel\s*=\s*(?:\"(?:[^\"]*\s)?canonical(?:\s[^\"]*)?\"|'(?:[^']*\s)?canonical(?:\s[^']*)?'"
                 r"|canonical(?=[\s>/]))")
    refresh = F.transform(tags("meta", r"(?i)http-equiv\s*=\s*[\"']?refresh", r"(?i)url\s*=\s*['\"]?([^\"'\s>]+)"),
                          lambda t: F.regexp_extract(decoded(t), r"^['\"]?([^\"'\s]*)", 1))
    links = F.concat(F.transform(tags("link", canonical, r"(?i)[\s\"'/]href\s*=\s*[\"']?([^\"'\s>]+)"), decoded), refresh)
    site = F.concat(url_scheme(url), F.lit("://"), raw_host(url))
    folder = F.regexp_replace(F.when(url_path(url) == "", "/").otherwise(url_path(url)), "[^/]*$", "")

    def absolute(t: Column) -> Column:
        return url_node(F.when(F.instr(t, "://") > 0, t)
                        .when(t.startswith("//"), F.concat(url_scheme(url), F.lit(":"), t))
                        .when(t.startswith("/"), F.concat(site, t))
                        .otherwise(F.concat(site, folder, t)))

    return F.when(url_scheme(url) != "", F.transform(F.filter(links, lambda t: t != ""), absolute)).otherwise(
        F.array().cast("array<string>"))


def judge(pages: DataFrame, rules: list[UrlRule], scratch: Scratch, default: str = "allow",
          url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per row of ``pages``: ``keep``, host, path, rule, verdict, alias_of.

    ``alias_of`` is the smallest url of the page's component, as ``url_node`` writes it, null if it has no links. Null urls
    and urls without ``://`` have an empty host and path, fit no rule and get ``default``;
    repeated rows are judged alike; an empty table gives an empty one.
    """
    rows = (pages.select(*keep, F.col(url).alias("_url"), F.col(html).alias("_html"))
            .withColumn("host", url_host(F.col("_url"))).withColumn("path", url_path(F.col("_url"))))
    rows = scratch.table(
        rows.select(*keep, "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("own"),
                    url_node(F.col("_url")).alias("node"),
                    link_targets(F.col("_url"), F.col("_html")).alias("targets")), "judged")
    edges = rows.filter(F.size("targets") > 0).select(F.col("node").alias("a"), F.explode("targets").alias("b"))
    alias = scratch.table(connected_components(edges, scratch), "alias")
    verdict = rule_of(url_host(F.col("node")), url_path(F.col("node")), rules)["verdict"]
    group = (alias.select("label", verdict.alias("v")).groupBy("label")
             .agg(F.coalesce(F.max(F.col("v") == "allow"), F.lit(False)).alias("allowed"),
                  F.coalesce(F.max(F.col("v") == "block"), F.lit(False)).alias("blocked")))
    of_node = skew_join(alias, group, "label", F.col("node")).select(
        "node", F.col("label").alias("alias_of"), (F.col("blocked") & ~F.col("allowed")).alias("alias_blocked"))
    linked = skew_join(rows.drop("targets"), of_node, "node", F.xxhash64(*keep), "left")
    by_alias = F.when(F.coalesce("alias_blocked", F.lit(False)), "block").otherwise(F.lit(default))
    return linked.select(*keep, "host", "path", F.col("own.rule").alias("rule"),
                         F.coalesce(F.col("own.verdict"), by_alias).alias("verdict"), "alias_of")
