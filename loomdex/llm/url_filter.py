"""URL filter with redirect equivalence.

A url that a rule fits gets the rule's verdict. The other urls get that of their
aliases: addresses joined by canonical links and meta refreshes form connected
components, and a block decision on any address of a component holds for all of
it, unless a rule explicitly allows an address of the component, which takes
precedence. A component without either is allowed.

An address is host, path and query; scheme and fragment do not tell resources
apart. Link targets count as addresses even where no row has them; character
references in them are decoded.

Cases: a null url, or one without ``://``, has empty host and path, fits no rule
and has no alias (allow). A null page has no links. Repeated rows are judged each.
An empty table gives an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm.components import connected_components

#: (host, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

TAG = r"(?i)<(?:link|meta)\b[^>]*>"
#: ``canonical`` as any of the tokens of rel.
CANONICAL = (
    r"(?i)(?<![\w-])rel\s*=\s*(?:\x22(?:[^\x22]*\s)?canonical(?:\s[^\x22]*)?\x22"
    r"|\x27(?:[^\x27]*\s)?canonical(?:\s[^\x27]*)?\x27|canonical(?=[\s>]|/>))"
)
REFRESH = r"(?i)\bhttp-equiv\s*=\s*[\x22\x27]?refresh\b"
HREF = r"(?i)\bhref\s*=\s*[\x22\x27]?([^\x22\x27>\s]+)"
REFRESH_URL = r"(?i)\burl\s*=\s*[\x22\x27]?([^\x22\x27>\s]+)"
REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*[;=]?)")


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """Null where the url has no host."""
    path = path_of(url)
    query = F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1)
    whole = F.concat(host_of(url), F.when(path == "", "/").otherwise(path), query)
    return F.when(host_of(url) != "", whole)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as (rule, verdict); null where none does."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, decision in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, decision).otherwise(verdict)
    return name, verdict


def unescaped(value: str) -> str:
    """Character references of an attribute decoded. A name without semicolon counts only
    where it is whole and no ``=`` follows, so ``?a=1&copy=2`` stays."""

    def one(found: re.Match) -> str:
        text = found[0]
        return html.unescape(text) if text[1] == "#" else html5.get(text[1:], text)

    return REFERENCE.sub(one, value)


def resolved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Targets of links as absolute urls; those that cannot be read are dropped."""

    def absolute(url: str, target: str) -> str | None:
        try:
            return urljoin(url, unescaped(target))
        except ValueError:
            return None

    for frame in frames:
        yield pd.DataFrame(
            {"url": frame["url"], "target": [absolute(u, t) for u, t in zip(frame["url"], frame["target"], strict=True)]}
        )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(url, target) of canonical links and meta refreshes."""
    linked = pages.filter(F.col("url").contains("://") & F.col("html").rlike("(?i)canonical|http-equiv"))
    tags = linked.select("url", F.explode(F.regexp_extract_all("html", F.lit(TAG), F.lit(0))).alias("tag"))
    tag = F.col("tag")
    target = F.when(tag.rlike(CANONICAL), F.regexp_extract(tag, HREF, 1)).when(
        tag.rlike(REFRESH), F.regexp_extract(tag, REFRESH_URL, 1)
    )
    found = tags.select("url", target.alias("target")).filter("target <> ''")
    return found.mapInPandas(resolved, "url string, target string").filter(F.col("target").contains("://"))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the address of every row."""
    url = F.col("url")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), address_of(url).alias("address"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "own": verdict})

    edges = alias_edges(pages).select(address_of(url).alias("u"), address_of(F.col("target")).alias("v"))
    members = connected_components(edges)
    # An address has no scheme, so it is read as one with an empty scheme.
    node = F.concat(F.lit("://"), F.col("node"))
    node_verdict = rule_of(host_of(node), path_of(node), rules)[1]
    judged = members.withColumn("own", node_verdict)
    of_component = judged.groupBy("component").agg(
        F.max(F.when(F.col("own") == "allow", 1)).alias("allowed"), F.max(F.when(F.col("own") == "block", 1)).alias("blocked")
    )
    spread = members.join(of_component.filter("blocked = 1 AND allowed IS NULL"), "component").select(
        F.col("node").alias("address"), F.lit("block").alias("alias_verdict")
    )
    joined = rows.join(spread, "address", "left")
    verdict = F.coalesce("own", "alias_verdict", F.lit("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "address")
