"""URL filters with redirect equivalence.

A url is judged by the longest rule that fits its host (or a parent domain) and
the start of its path. Urls that no rule fits may be aliases: pages point to
others by ``<link rel=canonical>``, by a refresh redirect, and by redirects given
as a table. Connected components over those edges (targets need not be pages)
carry blocks: a component with a blocked member blocks its members, except those
that an explicit rule allows. Everything else is allowed.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule, and is allowed. Rows are judged by url, so repeated page_ids and
urls each get a row; a null page_id is kept. Null html has no edge. Fragments and dot
segments never tell urls apart, nor does an empty path from ``/``. Of rules that fit
and are equally long, the first by host and path counts. Other columns are not read.
"""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import ascii_lower, barrier, cut, read_table
from .components import connected_components

RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)

#: What a reader of the page skips: comments, and the insides of scripts, styles and templates.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea|noscript)\b.*?(?:</\1\s*>|\z)"
#: A tag: quoted values may hold angle brackets.
_TAG = r"(?is)<(?:link|meta|base)(?=[\s/])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
_VALUE = r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_TO = r"(?is)^[\s\d.;,]*url\s*=\s*[\"']?([^\"'\s>]+)"


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute; other attributes' values and longer names don't count."""
    before = r"(?is)^<\w+(?:[\s/]+(?!" + name + r"\s*=)[^\s=>/\"']+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?)*[\s/]+" + name + _VALUE
    return F.trim(F.concat(*[F.regexp_extract(tag, before, i) for i in (1, 2, 3)]))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """Struct of the longest fitting rule and its verdict, or null. The rules are
    a short list, compiled into one expression."""
    found = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        made = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, made) if found is None else found.when(fits, made)
    return found


@F.pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    """Character references carried out; only targets of links that count come here."""
    return text.map(unescape, na_action="ignore")


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments carried out; none leads above the root."""
    none = F.expr("cast(array() as array<string>)")
    parts = F.split(path, "/")
    kept = F.aggregate(parts, none, lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).when(p == ".", acc).otherwise(F.concat(acc, F.array(p))))
    open_end = F.element_at(parts, -1).isin(".", "..")
    return F.concat(F.array_join(kept, "/"), F.when(open_end, F.lit("/")).otherwise(F.lit("")))


def _resolved(target: Column, base: Column) -> Column:
    """An absolute url for a link's target, seen from an absolute url; null for schemes without ``//``."""
    scheme, origin = F.regexp_extract(base, r"^([^:/?#]+:)", 1), F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*\z", ""))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.startswith("?"), F.concat(origin, path, target))
        .when(target.startswith("#"), base)
        .otherwise(F.concat(origin, folder, target))
    )


def _key(url: Column) -> Column:
    """One name for a url: no fragment, scheme and host lower-cased, no dot segments, a path at least ``/``."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"^([^:/?#]+://[^/?#]*)", 1)
    rest = F.substr(bare, F.length(head) + 1)
    path = F.regexp_extract(rest, r"(?s)^([^?]*)", 1)
    clean = F.when(path.contains("/."), _without_dots(path)).when(path == "", F.lit("/")).otherwise(path)
    return F.concat(ascii_lower(head), clean, F.substr(rest, F.length(path) + 1))


def _target(value: Column) -> Column:
    """A target as a reader takes it: line breaks and tabs go, and spaces around it."""
    return F.trim(F.regexp_replace(value, r"[\t\n\r]", ""))


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``a, b``: pairs of urls that stand for one another, by every canonical link and refresh of a page.

    Targets are seen from the page's url, or from that of its first ``<base href>``."""
    html = F.regexp_replace(F.coalesce("html", F.lit("")), _HIDDEN, " ")
    tags = pages.where(F.col("url").contains("://")).select("url", F.regexp_extract_all(html, F.lit(_TAG), F.lit(0)).alias("tags")).where(F.size("tags") > 0)
    bases = F.filter(F.col("tags"), lambda t: F.lower(F.substring(t, 2, 4)) == "base")
    found = F.filter(F.transform(bases, lambda t: _attribute(t, "href")), lambda h: h != "")
    tags = barrier(tags, "base", F.when(F.size(found) > 0, found[0]), "url", "tags")
    tags = tags.select("url", "base", F.explode("tags").alias("tag"))
    named = F.struct(
        F.lower(F.substring("tag", 2, 4)).alias("kind"), F.split(F.lower(_attribute(F.col("tag"), "rel")), r"\s+").alias("rel"),
        _attribute(F.col("tag"), "href").alias("href"), F.lower(_attribute(F.col("tag"), "http-equiv")).alias("equiv"), _attribute(F.col("tag"), "content").alias("content"),
    )
    tags = barrier(tags, "t", named, "url", "base")
    canonical = (F.col("t.kind") == "link") & F.array_contains("t.rel", "canonical")
    refresh = (F.col("t.kind") == "meta") & (F.col("t.equiv") == "refresh")
    tags = tags.where(canonical | refresh).select("url", "base", F.when(canonical, F.col("t.href")).otherwise(F.regexp_extract("t.content", _TO, 1)).alias("to"))
    tags = tags.select("url", _target(_unescaped("base")).alias("base"), _target(_unescaped("to")).alias("to"))
    tags = barrier(tags.where("to <> ''"), "seen", F.coalesce(_resolved(F.col("base"), F.col("url")), F.col("url")), "url", "to")
    tags = barrier(tags, "full", _resolved(F.col("to"), F.col("seen")), "url")
    edges = tags.where(F.col("full").contains("://")).select(_key(F.col("url")).alias("a"), _key(F.col("full")).alias("b"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(_key(F.col("from_url")).alias("a"), _key(F.col("to_url")).alias("b")))
    return edges.where("a <> b").distinct()


def judge(pages: DataFrame, rules: tuple = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``."""
    members = cut(connected_components(cut(alias_edges(pages, redirects), "url-edges"), "a", "b"), "url-members")
    own = best_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    bad = members.where(own == "block").select("component").distinct()
    blocked = members.join(bad, "component", "left_semi").select("node", F.lit(True).alias("by_alias"))
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("own", best_rule(F.col("host"), F.col("path"), rules))
    # Only urls without a rule of their own look for aliases; the others, and null urls, take no part in the join.
    asks = F.col("own").isNull() & F.col("url").contains("://")
    ruled = rows.where(~F.coalesce(asks, F.lit(False))).withColumn("by_alias", F.lit(None).cast("boolean"))
    open_rows = rows.where(asks).withColumn("node", _key(F.col("url"))).join(blocked, "node", "left").drop("node")
    rows = ruled.unionByName(open_rows)
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("by_alias"), F.lit("block")), F.lit("allow"))
    return rows.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"))
