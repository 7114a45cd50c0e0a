"""URL filters with redirect equivalence.

Explicit rules (host and path, longest match) judge a url first. Pages that no rule fits take the
decision of their aliases: urls joined by canonical-link, meta-refresh or redirect edges, and by the
canonical form of the url itself (scheme, ``www.``/``m.`` host prefix, query, fragment, ``.html`` and
trailing slash do not name another document), form connected components. An explicit allow of any
member allows the undecided members of its component; else an explicit block of any member blocks
them; else they are allowed. Ends of edges that are no pages count too: rules judge them as they judge pages.
Relative link targets are those of the page's own url.

Forms are compared as text: those with links are numbered by their rank for the components, so no two share a node.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule, has no
aliases and is allowed; repeated rows are judged alike; of rules of one length that fit, the one that sorts first
counts, and of one pattern's two verdicts allow; very long urls and pages are read whole; other columns are
ignored and never collide; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloq.llm.common import LOWER, UPPER
from colloq.operators.graph import connected_components
from colloq.operators.sampling import ranked_rows
from colloq.session import cut


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is host, slash, path; the host stands for itself and all subdomains."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


RULES = (
    UrlRule("block", "com/en/"),
    UrlRule("allow", "example.com/en/7"),
    UrlRule("allow", "net/de/"),
    UrlRule("block", "example.net/de/8"),
    UrlRule("block", "org/es/"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def best_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), else null; ties go to the rule that sorts first."""
    chain = F.lit(None).cast("struct<rule:string,verdict:string>")
    # the last to be put around the others is asked first
    by_pattern = sorted(rules, key=lambda r: (r.pattern, r.verdict != "allow"), reverse=True)
    for r in sorted(by_pattern, key=lambda r: len(r.pattern)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        chain = F.when(fits, F.struct(F.lit(r.pattern).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(chain)
    return chain


def canonical_form(host: Column, path: Column) -> Column:
    """The address without the parts that do not name another document; null for an empty host."""
    plain = F.regexp_replace(host, r"^(www|m)\.", "")
    stem = F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"\.html?$", "")
    return F.when(host != "", F.concat(plain, stem))


def linked_forms(html: Column) -> Column:
    """Targets of canonical links and meta refreshes in a page, as written."""
    canonical = F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*\brel=[\"']?canonical\b[^>]*>"), 0)
    refresh = F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*\bhttp-equiv=[\"']?refresh\b[^>]*>"), 0)
    tags = F.concat(F.coalesce(canonical, F.array().cast("array<string>")), F.coalesce(refresh, F.array().cast("array<string>")))
    targets = F.transform(tags, lambda t: F.regexp_extract(t, r"(?i)(?:\bhref|\burl)\s*=\s*[\"']?([^\"'>\s]+)", 1))
    return F.filter(targets, lambda t: t != "")


def resolved(target: Column, url: Column) -> Column:
    """``target`` as an absolute url, relative to ``url``; null if it has another scheme than a web page's."""
    scheme, authority = F.regexp_extract(url, r"^(.*?)://", 1), F.regexp_extract(url, r"^(.*?://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    ref = F.regexp_extract(target, r"^([^?#]*)", 1)  # queries and fragments do not name another document
    joined = F.when(ref == "", path).when(ref.startswith("/"), ref).otherwise(F.concat(folder, ref))
    # dot segments: names are kept unless a later ".." takes them back
    names = F.aggregate(
        F.slice(F.split(joined, "/"), 2, 1 << 30),
        F.array().cast("array<string>"),
        lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)),
    )
    end = F.when(joined.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    plain = F.concat(authority, F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(names, "/"), end)))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(~target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), plain)
    )


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the form that names the alias component.

    ``redirects`` (src, dst: urls) adds edges to those found in ``pages.html``.
    """
    host, path = url_parts(F.col("url"))
    html = F.col("html") if "html" in pages.columns else F.lit(None).cast("string")
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), F.transform(linked_forms(html), lambda t: resolved(t, F.col("url"))).alias("targets"))
    parsed = parsed.withColumn("best", best_rule(F.col("host"), F.col("path"), rules)).withColumn("form", canonical_form(F.col("host"), F.col("path")))
    parsed = cut(parsed.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled"), "form", "targets"))

    def end(url: Column) -> Column:
        host, path = url_parts(url)
        return F.struct(canonical_form(host, path).alias("form"), best_rule(host, path, rules)["verdict"].alias("ruled"))

    own = F.struct("form", "ruled")
    edges = parsed.where(F.size("targets") > 0).select(own.alias("a"), F.explode("targets").alias("target")).select("a", end(F.col("target")).alias("b"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(end(F.col("src")).alias("a"), end(F.col("dst")).alias("b")))
    links = cut(edges.where("a.form is not null and b.form is not null"))
    # pages and edge ends of one form are one node, so a form of any size is one row here
    ends = links.select(F.explode(F.array("a", "b")).alias("e")).select("e.form", "e.ruled")
    forms = parsed.where(F.col("form").isNotNull()).select("form", "ruled").unionByName(ends)
    forms = forms.groupBy("form").agg(F.max(F.col("ruled") == "allow").alias("allowed"), F.max(F.col("ruled") == "block").alias("blocked"))
    if not links.isEmpty():
        forms = forms.join(_aliases(links, ends), "form", "left")
    else:
        forms = forms.withColumn("alias", F.lit(None).cast("string"))
    forms = cut(forms.withColumn("alias", F.coalesce("alias", "form")))
    decided = forms.groupBy("alias").agg(F.max("allowed").alias("any_allow"), F.max("blocked").alias("any_block"))
    inherited = F.when(F.col("any_allow"), F.lit("allow")).when(F.col("any_block"), F.lit("block")).otherwise(F.lit("allow"))
    verdicts = forms.select("form", "alias").join(decided.select("alias", inherited.alias("inherited")), "alias")
    joined = parsed.join(verdicts, "form", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("ruled", "inherited", F.lit("allow")).alias("verdict"), "alias")


def _aliases(links: DataFrame, ends: DataFrame) -> DataFrame:
    """(form, alias): the first form in order of each linked form's component."""
    nodes = cut(ranked_rows(ends.select("form").distinct(), [F.col("form")], "node").select("form", "node"))
    edges = links.select(F.col("a.form").alias("form"), F.col("b.form").alias("other")).distinct()
    edges = edges.join(nodes.withColumnRenamed("node", "src"), "form").join(nodes.select(F.col("form").alias("other"), F.col("node").alias("dst")), "other")
    parts = connected_components(edges.select("src", "dst"))
    # the smallest node is the form that sorts first
    named = parts.join(nodes, "node").select("form", "component")
    return named.join(nodes.select(F.col("node").alias("component"), F.col("form").alias("alias")), "component").select("form", "alias")
