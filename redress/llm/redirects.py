"""Block lists over urls, with redirect and canonical-link equivalence.

Urls that redirect to one another or name one another as canonical are
aliases: the connected components of those edges.  A url judged by no rule of
its own takes the decision of its component: allowed if a rule allows any
member, else blocked if a rule blocks any member, else allowed.  Nodes are
whole addresses (see :func:`address`), so no two are ever confused, and
components are found by :mod:`redress.llm.components` without gathering them
anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redress.llm.common import WHITE, attach, stored
from redress.llm.components import connected_components


@dataclass(frozen=True)
class Rule:
    """A host (with all subdomains) and a path prefix; ``allow`` or ``block``."""

    host: str
    path: str
    verdict: str


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` up to ``/``, ``?`` or
    ``#``, and the path from there up to ``?`` or ``#``.  Both are empty for
    null and for a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judged(rules: list[Rule], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null.

    A path prefix may hold any character; of rules equal in host and path an
    allow comes first.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    ranked = sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host), r.verdict == "allow"))
    for r in ranked:
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        own = F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, own).otherwise(out)
    return out


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute: in double, single or no quotes."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])
    return F.trim(F.replace(value, F.lit("&amp;"), F.lit("&")), F.lit(WHITE))


def _parts(url: Column) -> tuple[Column, Column, Column]:
    """Scheme and host in lower case, path, and query of a url without its
    fragment; the first is empty if there is no ``://``."""
    plain = F.regexp_replace(url, r"(?s)#.*$", "")
    at = F.instr(plain, "://")
    host = F.regexp_extract(F.substr(plain, at + 3), r"^[^/?]*", 0)
    size = F.when(at > 0, at + 2 + F.length(host)).otherwise(0)
    head = F.translate(F.substr(plain, F.lit(1), size), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tail = F.substr(plain, size + 1)
    path = F.regexp_extract(tail, r"^[^?]*", 0)
    return head, path, F.substr(tail, F.length(path) + 1)


def _without_dots(path: Column) -> Column:
    """A path whose ``.`` and ``..`` parts are worked out."""
    parts = F.split(path, "/")

    def add(done: Column, x: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(x == ".", done).when(x == "..", up).otherwise(F.concat(done, F.array(x)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), add)
    ended = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(ended, "/")).otherwise(path)


def address(url: Column) -> Column:
    """The url that names the same resource: scheme and host in lower case,
    no fragment, no dot parts.  An empty path stays empty: the rules tell it
    from ``/``."""
    head, path, query = _parts(url)
    whole = F.concat(head, _without_dots(path), query)
    return F.when(F.instr(url, "://") > 0, whole).otherwise(F.regexp_replace(url, r"(?s)#.*$", ""))


def resolved(base: Column, target: Column) -> Column:
    """The address that ``target`` names on a page at ``base``: a whole url,
    ``//host/x``, ``/x``, ``?x`` or a path from the page's folder.  Null for an
    empty target, another scheme (``mailto:``) or a base without ``://``."""
    head, path, _ = _parts(base)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"(?s)^.*/", 0), F.lit("")), F.lit("/"))
    full = (
        F.when((target == "") | target.startswith("#"), None)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(head == "", None)
        .when(target.startswith("//"), F.concat(F.regexp_extract(head, "^[^:]*:", 0), target))
        .when(target.startswith("/"), F.concat(head, target))
        .when(target.startswith("?"), F.concat(head, path, target))
        .otherwise(F.concat(head, folder, target))
    )
    return address(full)


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(u, v): addresses of each page, and of its canonical links and the
    targets of its ``refresh`` redirects, however they are written."""
    html = F.col(html_col)
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<(?:link|meta)\s[^>]*>)"), 1)
    named = r"""(?is)^<link\s(?:.*\s)?rel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical(?=[\s/>]))"""
    sent = r"""(?is)^<meta\s(?:.*\s)?http-equiv\s*=\s*["']?\s*refresh\s*["'\s/>]"""
    canonical = F.filter(tags, lambda t: t.rlike(named))
    refresh = F.filter(tags, lambda t: t.rlike(sent))
    url = r"""(?is)\burl\s*=\s*["']?\s*([^"']*)"""
    targets = F.concat(
        F.transform(canonical, lambda t: _attribute(t, "href")),
        F.transform(refresh, lambda t: F.trim(F.regexp_extract(_attribute(t, "content"), url, 1), F.lit(WHITE))),
    )
    found = pages.where(html.rlike(r"(?i)canonical|http-equiv")).select(F.col(url_col).alias("u"), F.explode(targets).alias("v"))
    return found.where("u IS NOT NULL").select(address(F.col("u")).alias("u"), resolved(F.col("u"), F.col("v")).alias("v")).where("v IS NOT NULL")


def filter_urls(
    pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of ``pages``.

    ``redirects`` (u, v) adds known redirects to the edges found in the
    pages.  ``verdict`` is that of the longest fitting rule, else that of the
    url's aliases: ``allow`` if any alias (or the url) is allowed by a rule,
    else ``block`` if any is blocked, else ``allow``.  Urls of one
    :func:`address` are aliases.  Null urls have an empty host and path
    and no aliases.  Repeated rows and ids are kept; other columns are not
    read.
    """
    edges = page_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address(F.col("u")).alias("u"), address(F.col("v")).alias("v")))
    found = connected_components(stored(edges.where("u <> v").distinct(), "redirects"))

    # decisions of the rules on every address that has aliases
    host, path = host_path(F.col("node"))
    votes = found.select("component", judged(rules, host, path).getField("verdict").alias("verdict"))
    decided = votes.groupBy("component").agg(F.min("verdict").alias("inherited"), F.count("*").alias("_n"))
    decided = stored(decided.where("inherited IS NOT NULL"), "decisions")
    aliases = attach(found, decided, "component", "_n").where("inherited IS NOT NULL")
    aliases = aliases.select(F.col("node").alias("address"), "inherited")

    url = F.col(url_col)
    rows = stored(pages.select(F.col(id_col).alias("id"), url.alias("url"), address(url).alias("address")), "urls")
    sizes = rows.groupBy("address").agg(F.count("*").alias("_n"))
    aliases = stored(aliases.join(sizes, "address"), "aliases")
    out = attach(rows, aliases, "address", "_n")
    host, path = host_path(F.col("url"))
    own = judged(rules, F.col("host"), F.col("path"))
    return (
        out.select("id", host.alias("host"), path.alias("path"), "inherited")
        .withColumn("own", own)
        .select(
            F.col("id").alias(id_col), "host", "path", F.col("own.rule").alias("rule"),
            F.coalesce("own.verdict", "inherited", F.lit("allow")).alias("verdict"),
        )
    )
