"""URL filters with redirect equivalence, in DataFrame functions only.

Rules name a host and a path prefix; a rule fits its host and all subdomains, and the longest that
fits decides. Pages without a rule take part in a graph: a page is joined with the target of its
redirect (meta refresh), with its canonical link, and with any edge that the caller passes (for
example logged redirects); a page that declares no canonical link is joined with its conventional
one (host without `www.` or `m.`, path without `.html` and a last slash, no tracking parameters).
Addresses that differ in scheme or fragment alone are one node. Connected components of the graph
carry block decisions to aliases: a page without a rule is blocked if its component holds a blocked
address and no explicitly allowed one; else it is allowed.

Defined cases: a null address, or one without `://`, has empty host and path, no rule and no edges,
and is allowed. Null html gives no edges of its own. Repeated rows stay. The rules are a parameter
of the driver and become one expression; thousands fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..storage import stored
from .frames import boxed, column_index, only_boxed, unboxed

Rule = tuple[str, str]  # ("block" or "allow", "host/path")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = r"(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(action, rule) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<action:string,rule:string>")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, prefix = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{prefix}")
        found = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(text).alias("rule"))).otherwise(found)
    return found


def node_of(url: Column) -> Column:
    """An address without scheme and fragment; null without a host."""
    host, query = host_of(url), query_of(url)
    return F.when(host != "", F.concat(F.lit("://"), host, path_of(url), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def conventional(url: Column) -> Column:
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(/index)?\.html?$", ""), r"/+$", "")
    query = F.regexp_replace(F.regexp_replace(query_of(url), TRACKING, ""), r"^&", "")
    return F.when(host != "", F.concat(F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


#: An attribute inside a tag: its name, and its value in double, single or no quotes. Quoted values are taken whole.
ATTRIBUTE = r"""([^\s"'<>/=]+)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
#: What a tag of a name holds up to its end; `>` inside quotes doesn't end it.
TAG = r"""(?is)<{}(?=[\s/])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
UNREAD = r"(?is)<!--.*?-->|<(script|style|template)\b.*?</\1\s*>"


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name; empty if there is none."""
    named = F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), lambda a: F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)) == name)
    value = F.regexp_extract(F.get(named, F.lit(0)), r"(?s)^[^=]*=\s*(.*)$", 1)
    bare = F.when(value.rlike(r"""^["']"""), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    return F.replace(F.coalesce(bare, F.lit("")), F.lit("&amp;"), F.lit("&"))


def _first_tag(html: Column, name: str, fits) -> Column:
    """The first tag of that name that fits."""
    return F.get(F.filter(F.regexp_extract_all(html, F.lit(TAG.format(name)), F.lit(0)), fits), F.lit(0))


def _without_dots(path: Column) -> Column:
    """A path without the segments `.` and `..`."""

    def step(a: Column, x: Column) -> Column:
        up = F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
        return F.when(x == "..", up).when(x == ".", a).otherwise(F.concat(a, F.array(x)))

    def joined(walked: Column) -> Column:
        return F.concat(F.lit("/"), F.array_join(walked, "/"))

    # A last `.` or `..` leaves the folder's slash.
    marked = F.regexp_replace(path, r"/(\.{1,2})$", "/$1/")
    walked = F.aggregate(F.slice(F.split(marked, "/"), 2, 1 << 30), F.array().cast("array<string>"), step, joined)
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), walked).otherwise(path)


def _absolute(df: DataFrame, name: str, base: str, target: Column) -> DataFrame:
    """Adds column `name`: a link's target, as seen from the address in column `base`; null if it is empty or no web address.

    The parts are columns, so that no expression holds another many times.
    """
    web, other = r"^[A-Za-z][A-Za-z0-9+.\-]*://", r"^[A-Za-z][A-Za-z0-9+.\-]*:"
    df = df.withColumns({"_to": F.trim(target), "_from": path_of(F.col(base)), "_asked": query_of(F.col(base)), "_root": F.concat(F.substring_index(base, "://", 1), F.lit("://"), host_of(F.col(base)))})
    t, root, own = F.col("_to"), F.col("_root"), F.col("_from")
    folder = F.regexp_replace(own, r"[^/]*$", "")
    path = F.regexp_extract(t, r"^[^?#]*", 0)
    df = df.withColumn("_path", F.when(t.startswith("/"), path).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path)))
    df = df.withColumn("_path", _without_dots(F.col("_path")))
    asked = F.when(F.col("_asked") != "", F.concat(F.lit("?"), F.col("_asked"))).otherwise(F.lit(""))
    found = (
        F.when(F.coalesce(t, F.lit("")) == "", F.lit(None).cast("string"))
        .when(t.rlike(web), t)
        .when(t.startswith("//"), F.concat(F.substring_index(root, "://", 1), F.lit(":"), t))
        .when(t.startswith("?"), F.concat(root, own, t))
        .when(t.startswith("#"), F.concat(root, own, asked, t))
        .when(t.rlike(other), F.lit(None).cast("string"))
        .otherwise(F.concat(root, F.col("_path"), F.regexp_extract(t, r"^[^?#]*(.*)$", 1)))
    )
    return df.withColumn(name, found).drop("_to", "_from", "_asked", "_root", "_path")


def declared_links(df: DataFrame) -> DataFrame:
    """Adds to `k_url`, `k_html` the canonical link `_canon` and the meta refresh target `_moved` of a page, absolute, or null.

    Comments, scripts, styles and templates declare nothing. Targets are resolved against `<base href>`, else the page's address.
    """
    # Only pages that may declare a link are read further.
    df = df.withColumn("_read", F.when(F.col("k_html").rlike(r"(?i)\bcanonical\b|\brefresh\b"), F.regexp_replace("k_html", UNREAD, " ")))
    read = F.col("_read")
    df = df.withColumns(
        {
            "_link": _first_tag(read, "link", lambda t: F.array_contains(F.split(F.lower(F.trim(_attribute(t, "rel"))), r"\s+"), "canonical")),
            "_meta": _first_tag(read, "meta", lambda t: F.lower(F.trim(_attribute(t, "http-equiv"))) == "refresh"),
            "_base": _first_tag(read, "base", lambda t: _attribute(t, "href") != ""),
        }
    ).drop("_read")
    df = df.withColumns({"_link": _attribute(F.col("_link"), "href"), "_content": _attribute(F.col("_meta"), "content"), "_base": _attribute(F.col("_base"), "href")})
    at = r"""(?is)^\s*[\d.]+\s*[;,\s]\s*(?:url\s*=\s*)?(?:"([^"]*).*|'([^']*).*|([^"'].*))$"""
    df = df.withColumn("_meta", F.concat(*[F.regexp_extract("_content", at, i) for i in (1, 2, 3)]))
    df = _absolute(df, "_base", "k_url", F.col("_base")).withColumn("_base", F.coalesce("_base", "k_url"))
    df = _absolute(_absolute(df, "_canon", "_base", F.col("_link")), "_moved", "_base", F.col("_meta"))
    return df.drop("_link", "_meta", "_content", "_base")


def judge(pages: DataFrame, rules: list[Rule], edges: DataFrame | None = None) -> DataFrame:
    """All rows and columns of `pages` but html, with host, path, rule and verdict.

    `edges` may add pairs of addresses, `src` and `dst`.
    """
    kept = [i for i in range(len(pages.columns)) if i != column_index(pages, "html")]
    d = only_boxed(boxed(pages, "url", "html"), kept)
    url = F.col("k_url")
    d = declared_links(d)
    d = d.select("_row", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"), conventional(url).alias("_usual"), node_of(F.col("_canon")).alias("_canon"), node_of(F.col("_moved")).alias("_moved"))
    d = stored(d.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)), "urls")
    links = d.select("node", F.explode(F.array(F.coalesce("_canon", "_usual"), "_moved")).alias("other"))
    if edges is not None:
        links = links.unionByName(edges.select(node_of(F.col("src")).alias("node"), node_of(F.col("dst")).alias("other")))
    groups = connected_components(links, "node", "other")
    action = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["action"]
    per = groups.groupBy("component").agg(F.max(F.coalesce(action == "block", F.lit(False))).alias("b"), F.max(F.coalesce(action == "allow", F.lit(False))).alias("a"))
    blocked = groups.join(per.where("b and not a"), "component").select("node", F.lit(True).alias("blocked"))
    # Rows that a rule decides, and those without a host, need no component: a hot host or very many nulls aren't joined.
    ruled = F.col("found").isNotNull() | F.col("node").isNull()
    rest = d.where(~ruled).join(blocked, "node", "left")
    d = d.where(ruled).withColumn("blocked", F.lit(None).cast("boolean")).unionByName(rest)
    verdict = F.coalesce(F.col("found.action"), F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return unboxed(d, pages, kept, host=F.col("host"), path=F.col("path"), rule=F.col("found.rule"), verdict=verdict)


#: The rules of the registered query.
QUERY_RULES: list[Rule] = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

ORACLE_SQL = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM parts),
usual AS (SELECT *, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS node,
  regexp_replace(host, '^(www|m)\.', '') AS h2, regexp_replace(regexp_replace(path, '(/index)?\.html?$', ''), '/+$', '') AS p2,
  regexp_replace(regexp_replace(query, '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') AS q2 FROM cut),
joined AS (SELECT *, h2 || p2 || CASE WHEN q2 <> '' THEN '?' || q2 ELSE '' END AS other FROM usual),
rules(action, host, prefix) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
ends AS (SELECT DISTINCT node, host, path FROM joined WHERE host <> '' UNION SELECT DISTINCT other, h2, p2 FROM joined WHERE host <> ''),
ruled AS (SELECT ends.*, arg_max(action, length(rules.host) + length(prefix)) AS action, arg_max(rules.host || prefix, length(rules.host) + length(prefix)) AS rule
  FROM ends LEFT JOIN rules ON (ends.host = rules.host OR ends.host LIKE '%.' || rules.host) AND starts_with(path, prefix) GROUP BY ALL),
edges AS (SELECT DISTINCT node AS u, other AS v FROM joined WHERE host <> '' AND node <> other),
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach(u, v) AS (SELECT u, v FROM both_ways UNION SELECT reach.u, both_ways.v FROM reach JOIN both_ways ON reach.v = both_ways.u),
decided AS (SELECT u AS node, bool_or(action = 'block') AS b, bool_or(action = 'allow') AS a FROM reach JOIN ruled ON ruled.node = reach.v GROUP BY u)
SELECT page_id, joined.host, joined.path, rule,
  coalesce(action, CASE WHEN b AND NOT coalesce(a, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM joined LEFT JOIN ruled ON ruled.node = joined.node AND ruled.host = joined.host AND ruled.path = joined.path
LEFT JOIN decided ON decided.node = joined.node
"""
