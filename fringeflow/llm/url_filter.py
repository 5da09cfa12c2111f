"""Block and allow urls by host and path rules, and carry blocks over redirects to aliases."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeflow.llm.components import connected_components
from fringeflow.sources.stage_store import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINK_TAG = r"""(?i)<(?:link|meta)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
ATTRIBUTE = r"""(?<=[\s"'/])[^\s"'<>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
REFRESH = r"""(?i)^\s*[\d.]+\s*(?:[;,]\s*|\s)(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|(.+))"""
# Character references in attributes that matter in urls; the ampersand last.
REFERENCES = {"&quot;": '"', "&#39;": "'", "&apos;": "'", "&#47;": "/", "&#x2f;": "/", "&lt;": "<", "&gt;": ">", "&#38;": "&", "&#x26;": "&", "&amp;": "&"}


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Mapping[str, str]) -> Column:
    """The longest rule that fits, else null.

    A rule is a host, a slash and the start of a path. It fits its host and
    all subdomains.
    """
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def verdict_of(rule: Column, rules: Mapping[str, str]) -> Column:
    verdict = F.lit(None).cast("string")
    for name, decision in rules.items():
        verdict = F.when(rule == name, F.lit(decision)).otherwise(verdict)
    return verdict


def alias_key(url: Column) -> Column:
    """One name for urls that servers commonly redirect to each other.

    Leaves out the scheme, a leading ``www.`` or ``m.``, a closing slash,
    ``.html``, the fragment and tracking parameters. Null without ``://``.
    """
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(query, "(^|&)(utm_[a-z]*|ref)=[^&]*", "")
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(/index)?(\.html)?/?$", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.lit("?"), query))


def _attribute(tag: Column, name: str) -> Column:
    """Value of the first attribute of that name, without quotes and character references; null without one."""
    of_name = F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), lambda a: a.rlike(rf"(?i)^{name}\s*="))
    value = F.regexp_replace(F.get(of_name, F.lit(0)), r"^[^=]*=\s*", "")
    value = F.regexp_replace(value, r"""^(["'])([\s\S]*)\1$""", "$2")
    for written, character in REFERENCES.items():
        value = F.regexp_replace(value, f"(?i){written}", character)
    return value


def _link_target(tag: Column) -> Column:
    """Where a link with ``rel`` canonical or a meta with ``http-equiv`` refresh leads, as written; null for other tags."""
    content = _attribute(tag, "content")
    refresh = F.concat(*[F.regexp_extract(content, REFRESH, group) for group in (1, 2, 3)])
    canonical = tag.rlike("(?i)^<link") & _attribute(tag, "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)")
    refreshes = tag.rlike("(?i)^<meta") & _attribute(tag, "http-equiv").rlike(r"(?i)^\s*refresh\s*$")
    return F.regexp_replace(F.when(canonical, _attribute(tag, "href")).when(refreshes, refresh), r"^\s+|\s+$", "")


def _without_dots(path: Column) -> Column:
    """A path from the root with ``.`` and ``..`` worked out."""
    parts = F.split(F.regexp_replace(path, r"/\.\.?$", "$0/"), "/")

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    nothing = F.array().cast("array<string>")
    done = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), nothing, step)
    return F.concat(F.lit("/"), F.array_join(done, "/"))


def absolute_url(url: Column, target: Column) -> Column:
    """``target`` as seen from the page at ``url``; as it is if it has a scheme."""
    scheme = F.regexp_extract(url, "^[^:/?#]*:", 0)
    root = F.concat(scheme, F.lit("//"), F.regexp_extract(_rest(url), "^[^/?#]*", 0))
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(url), "^/(.*/)?", 1))
    found = (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(root, path_of(url), target))
        .when(target.startswith("#"), F.concat(F.regexp_extract(url, "^[^#]*", 0), target))
        .when(target != "", F.concat(root, folder, target))
    )
    host, path, more = [F.regexp_extract(found, r"^([^:/?#]*://[^/?#]*)(/[^?#]*)([\s\S]*)$", group) for group in (1, 2, 3)]
    return F.when(path.contains("/."), F.concat(host, _without_dots(path), more)).otherwise(found)


def page_links(url: Column, html: Column) -> Column:
    """Absolute targets of canonical links and refresh redirects in a page."""
    tags = F.regexp_extract_all(html, F.lit(LINK_TAG), F.lit(0))
    tags = F.filter(tags, lambda tag: tag.rlike("(?i)canonical|refresh"))
    absolute = F.transform(F.transform(tags, _link_target), lambda target: absolute_url(url, target))
    return F.filter(absolute, lambda t: F.instr(t, "://") > 0)


def redirect_blocks(pages: DataFrame, rules: Mapping[str, str], redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, propagated`` for every row of ``pages(page_id, url, html)``.

    A url is judged by the longest rule that fits. Redirects, canonical
    links, refreshes and common server redirects (``alias_key``) make urls
    equivalent; connected components are formed over the links, and a block
    by rule on any member, page or mere target, blocks every member that no
    rule judges. An explicit allow on a url always wins for that url.
    ``propagated`` tells verdicts that come from an alias. ``redirects`` adds
    known ``(src, dst)`` redirects.

    A null url, or one without ``://``, has an empty host and path, no alias
    and is allowed. A null or empty html has no links. Repeated rows and ids
    are judged one by one; other columns are ignored; no rows give no rows.
    """
    url, html = F.col("url"), F.col("html")
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), alias_key(url).alias("alias"))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    judged = judged.withColumn("own", verdict_of(F.col("rule"), rules))

    links = pages.select(url.alias("src"), F.explode(page_links(url, html)).alias("dst"))
    if redirects is not None:
        links = links.unionByName(redirects.select("src", "dst"))
    links = settle(links.where("instr(src, '://') > 0 and instr(dst, '://') > 0"), "links")
    targets = links.select(F.explode(F.array("src", "dst")).alias("url"))
    targets = targets.withColumn("rule", rule_of(host_of(url), path_of(url), rules))
    blocked = judged.where("own = 'block'").select("alias").unionByName(
        targets.where(verdict_of(F.col("rule"), rules) == "block").select(alias_key(url).alias("alias"))
    )
    blocked = settle(blocked.where("alias is not null").distinct(), "blocked")

    edges = links.select(alias_key(F.col("src")).alias("src"), alias_key(F.col("dst")).alias("dst"))
    members = connected_components(edges).selectExpr("node as alias", "component")
    hit = members.join(blocked, "alias").select("component").distinct()
    reached = members.join(hit, "component").select("alias").unionByName(blocked).distinct()
    joined = judged.join(reached.withColumn("reached", F.lit(True)), "alias", "left")
    return joined.selectExpr(
        "page_id",
        "host",
        "path",
        "rule",
        "coalesce(own, case when reached then 'block' else 'allow' end) as verdict",
        "own is null and reached is not null as propagated",
    )
